"""Predicates on paths: globs, ignore rules, types, hidden names, depth, operands."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name and globs of each type; ours, extended by ``type_add`` and cut by ``type_clear``.
_TYPES = """
ada *.adb *.ads
asciidoc *.adoc *.asc *.asciidoc
asm *.asm *.s *.S
avro *.avdl *.avpr *.avsc
awk *.awk
bat *.bat *.cmd
bazel *.bazel *.bzl BUILD WORKSPACE
bitbake *.bb *.bbappend *.bbclass *.conf *.inc
bzip2 *.bz2 *.tbz2
c *.c *.h *.H *.cats
cabal *.cabal
clojure *.clj *.cljc *.cljs *.cljx
cmake *.cmake CMakeLists.txt
config *.cfg *.conf *.config *.ini
cpp *.cc *.cpp *.cxx *.c++ *.hh *.hpp *.hxx *.h++ *.inl *.C *.H *.h
crystal *.cr *.ecr Projectfile
cs *.cs
csharp *.cs
css *.css *.scss
csv *.csv
cython *.pyx *.pxd *.pxi
d *.d
dart *.dart
diff *.diff *.patch
docker *Dockerfile*
elixir *.ex *.exs *.eex *.heex *.leex
elm *.elm
erlang *.erl *.hrl
fish *.fish
fortran *.f *.F *.f77 *.f90 *.F90 *.f95 *.for
fsharp *.fs *.fsi *.fsx
gn *.gn *.gni
go *.go
gradle *.gradle *.gradle.kts
graphql *.graphql *.graphqls
groovy *.groovy *.gradle
gzip *.gz *.tgz
h *.h *.hh *.hpp
haml *.haml
haskell *.hs *.lhs *.hsc
html *.html *.htm *.ejs
idris *.idr *.lidr
java *.java *.jsp *.jspx *.properties
jinja *.j2 *.jinja *.jinja2
js *.js *.jsx *.mjs *.cjs *.vue
json *.json composer.lock
jsonl *.jsonl
julia *.jl
jupyter *.ipynb *.jpynb
kotlin *.kt *.kts
less *.less
license COPYING* LICENCE* LICENSE* EULA*
lisp *.el *.lisp *.lsp *.sc *.scm
lock *.lock package-lock.json
log *.log
lua *.lua
m4 *.ac *.m4
make *.mak *.mk Makefile makefile GNUmakefile Makefile.* makefile.*
man *.[0-9lnpx] *.[0-9][cEFMmpSx]
markdown *.markdown *.md *.mdown *.mdwn *.mdx *.mkd *.mkdn
matlab *.m
md *.markdown *.md *.mdown *.mdwn *.mdx *.mkd *.mkdn
meson meson.build meson_options.txt
mk mkfile
ml *.ml
nim *.nim *.nimf *.nimble *.nims
nix *.nix
objc *.h *.m
objcpp *.h *.mm
ocaml *.ml *.mli *.mll *.mly
org *.org *.org_archive
pascal *.pas *.dpr *.lpr *.pp *.inc
pdf *.pdf
perl *.perl *.pl *.PL *.plh *.plx *.pm *.t
php *.php *.php3 *.php4 *.php5 *.php7 *.php8 *.pht *.phtml
postscript *.eps *.ps
protobuf *.proto
ps *.cdxml *.ps1 *.ps1xml *.psd1 *.psm1
puppet *.epp *.erb *.pp *.rb
purs *.purs
py *.py *.pyi
qml *.qml
r *.R *.r *.Rmd *.Rnw
rdoc *.rdoc
readme README* *README
rst *.rst
ruby *.rb *.rbw *.gemspec Gemfile Rakefile config.ru
rust *.rs
sass *.sass *.scss
scala *.scala *.sbt
sh *.bash *.csh *.ksh *.sh *.tcsh *.zsh .bashrc .profile .zshrc
slim *.slim *.skim
sml *.sml *.sig
solidity *.sol
sql *.sql *.psql
stylus *.styl
sv *.h *.sv *.svh *.v *.vg
svelte *.svelte
svg *.svg
swift *.swift
systemd *.automount *.mount *.path *.service *.socket *.target *.timer
tcl *.tcl
tex *.bib *.cls *.dtx *.ins *.ltx *.sty *.tex
textile *.textile
tf *.auto.tfvars *.terraformrc *.tf *.tf.json *.tfrc *.tfvars
thrift *.thrift
toml *.toml Cargo.lock
ts *.cts *.mts *.ts *.tsx
twig *.twig
txt *.txt
typescript *.cts *.mts *.ts *.tsx
vala *.vala
vb *.vb
verilog *.sv *.svh *.v *.vh
vhdl *.vhd *.vhdl
vim *.vim .gvimrc .vimrc _vimrc gvimrc vimrc
vue *.vue
webidl *.idl *.webidl *.widl
xml *.dtd *.rng *.sch *.xhtml *.xml *.xml.dist *.xjb *.xsd *.xsl *.xslt
xz *.txz *.xz
yacc *.y
yaml *.yaml *.yml
zig *.zig
zsh *.zsh .zlogin .zlogout .zprofile .zshenv .zshrc zlogin zshrc
zstd *.zst *.zstd
"""
TYPES: dict[str, list[str]] = {name: globs.split() for name, globs in (x.split(" ", 1) for x in _TYPES.strip().splitlines())}
_ESCAPE = re.compile(r"[\\^$.|+()\[\]{}*?]")


def glob_regex(glob: str) -> str:
    """A glob as a whole-path regular expression; ``*`` and ``?`` stay within a component."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
            continue
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out.append(".*" if glob == "**" else "[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out.append("(?:" + "|".join(glob_regex(x) for x in glob[i + 1 : end].split(",")) + ")")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(_ESCAPE.sub(lambda m: "\\" + m[0], glob[i]))
        else:
            out.append(_ESCAPE.sub(lambda m: "\\" + m[0], c))
        i += 1
    return "".join(out)


def matches(path: Column, glob: str, ignore_case: bool = False) -> Column:
    """Whether a listing glob selects the path; without a slash it may be at any depth."""
    glob = glob if "/" in glob else f"**/{glob}"
    return path.rlike(("(?is)" if ignore_case else "(?s)") + f"^{glob_regex(glob.lstrip('/'))}$")


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file or one override."""

    regex: str
    negated: bool
    only_dirs: bool

    @classmethod
    def parse(cls, line: str, base: str = "", ignore_case: bool = False) -> Rule | None:
        line = line.rstrip("\n").rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[negated:]
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        regex = glob_regex(line.lstrip("/"))
        prefix = "".join(_ESCAPE.sub(lambda m: "\\" + m[0], base.rstrip("/") + "/")) if base else ""
        return cls(("(?i)" if ignore_case else "") + f"^{prefix}{'' if anchored else '(?:.*/)?'}{regex}$", negated, only_dirs)


def _levels(path: Column) -> Column:
    """The path's ancestors and itself, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def verdict(rules: list[Rule], level: Column, is_dir: Column) -> Column:
    """The last rule that matches decides: True ignores, False keeps, null has no opinion."""
    out = F.lit(None).cast("boolean")
    for r in rules:
        hit = level.rlike(r.regex) & (is_dir if r.only_dirs else F.lit(True))
        out = F.when(hit, F.lit(not r.negated)).otherwise(out)
    return out


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether ignore rules drop the path: an ignored directory takes all below it."""
    if not rules:
        return F.lit(False)
    return F.exists(_levels(path), lambda level: F.coalesce(verdict(rules, level, level != path), F.lit(False)))


def overridden(path: Column, globs: list[str], ignore_case: bool = False) -> Column:
    """Whether ordered -g globs keep the path: the last match wins, ``!`` drops, a positive glob drops the rest."""
    rules = [r for g in globs if (r := Rule.parse(g, ignore_case=ignore_case))]
    if not rules:
        return F.lit(True)
    positive = any(not r.negated for r in rules)
    own = F.coalesce(verdict(rules, path, F.lit(False)), F.lit(not positive))
    above = F.exists(_levels(path), lambda level: F.coalesce(~verdict(rules, level, F.lit(True)), F.lit(False)) & (level != path))
    return own & ~above


def typed(path: Column, select: list[str], drop: list[str], types: dict[str, list[str]] | None = None) -> Column:
    """-t and -T: files of a selected type (all, if none is selected) that are of no dropped one."""
    table = types or TYPES
    for name in (*select, *drop):
        if name not in table:
            raise ValueError(f"unrecognized file type: {name}")
    any_of = lambda names: F.lit(False) if not names else path.rlike("(?:^|/)(?:" + "|".join(glob_regex(g) for n in names for g in table[n]) + ")$")
    return (any_of(select) if select else F.lit(True)) & ~any_of(drop)


def type_add(types: dict[str, list[str]], definition: str) -> dict[str, list[str]]:
    """``name:glob`` or ``name:include:a,b``."""
    name, _, glob = definition.partition(":")
    if not name or not glob:
        raise ValueError(f"invalid type definition: {definition}")
    more = [g for n in glob[8:].split(",") for g in types[n]] if glob.startswith("include:") else [glob]
    return types | {name: [*types.get(name, []), *more]}


def type_clear(types: dict[str, list[str]], name: str) -> dict[str, list[str]]:
    """Without the globs of a type; the name is unknown until they are added again."""
    return {k: v for k, v in types.items() if k != name}


def type_table(changes: tuple[tuple[str, str], ...]) -> dict[str, list[str]]:
    """The types after additions and clearings in their order."""
    out = dict(TYPES)
    for what, value in changes:
        out = type_add(out, value) if what == "add" else type_clear(out, value)
    return out


def hidden(path: Column) -> Column:
    """Whether any component begins with a dot."""
    return path.rlike(r"(^|/)\.")


def shown(path: Column, globs: list[str], iglobs: list[str], glob_fold: bool, of_type: Column) -> Column:
    """Whether no component is hidden but those that a positive glob names; a type names files alone."""
    rules = [r for g, fold in (*((g, glob_fold) for g in globs), *((g, True) for g in iglobs)) if (r := Rule.parse(g, ignore_case=fold))]

    def rescued(level: Column) -> Column:
        named = F.coalesce(verdict(rules, level, level != path), F.lit(False)) if rules else F.lit(False)
        return named | ((level == path) & of_type)

    if not rules:
        return ~hidden(F.regexp_replace(path, "[^/]*$", "")) & (~path.rlike(r"(^|/)\.[^/]*$") | of_type)
    return F.forall(_levels(path), lambda level: ~level.rlike(r"(^|/)\.[^/]*$") | rescued(level))


def under(path: Column, operand: str) -> Column:
    """Whether an operand, a file or a folder, holds the path."""
    return F.lit(True) if operand in (".", "") else (path == operand) | path.startswith(operand + "/")


def below(path: Column, operand: str) -> Column:
    """The rest of a path below an operand ("" for the operand itself)."""
    return path if operand in (".", "") else F.substring(path, len(operand) + 2, 1 << 30)


def display(path: Column, folder: str = "", separator: str = "/") -> Column:
    """A path of the corpus as seen from a folder of it: relative, climbing with ``..`` where it has to."""
    parts = [p for p in folder.split("/") if p not in ("", ".")]
    out = path
    for k in range(len(parts) + 1):
        base = "/".join(parts[:k])
        rest = F.concat(F.lit("../" * (len(parts) - k)), below(path, base))
        out = rest if k == 0 else F.when(path.startswith(base + "/"), rest).otherwise(out)
    return out if separator == "/" else F.translate(out, "/", separator)


def excluded(path: Column) -> Column:
    """Never listed, whatever the options."""
    return path.rlike(r"(^|/)(\.git|\.seine)(/|$)")


def depth(path: Column, base: str = "") -> Column:
    """Levels below a directory operand."""
    return F.size(F.split(path, "/")) - (base.strip("/").count("/") + 1 if base.strip("/") else 0)


def operands(files: DataFrame, names: list[str]) -> DataFrame:
    """Files of each operand in order (``operand``), once for each that holds it."""
    table = files.sparkSession.createDataFrame([(k, n.strip("/")) for k, n in enumerate(names)], "operand int, prefix string")
    # The command line is short by nature: the driver holds its names.
    cond = (F.col("path") == F.col("prefix")) | (F.col("prefix").isin("", ".")) | F.expr("startswith(path, concat(prefix, '/'))")
    return files.join(F.broadcast(table), cond).drop("prefix")


def order_key(path: Column) -> Column:
    """Sorts component by component, so that a/b comes before a.b."""
    return F.split(path, "/")


def fnmatch_any(name: str, globs: list[str]) -> bool:
    """For names on the driver (pre-processor globs)."""
    return any(fnmatch.fnmatch(name, g) for g in globs)
