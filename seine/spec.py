"""What to search for: options as a dataclass, and command lines that say them.

Repeated and opposed flags are settled by position: the last wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: Sources of ignore rules, each of which can be turned off.
SOURCES = ("dot", "vcs", "exclude", "global", "parent")
SORTS = ("none", "path", "modified", "accessed", "created")


class UsageError(ValueError):
    """A bad command line (exit status 2)."""


@dataclass(frozen=True)
class SearchSpec:
    patterns: tuple[str, ...] = ()
    operands: tuple[str, ...] = ()
    mode: str = "lines"  # lines, count, count_matches, files, without, json, listing, types
    # Matching.
    fixed: bool = False
    case: str = "sensitive"  # sensitive, ignore, smart
    bound: str = ""  # word, line
    invert: bool = False
    multiline: bool = False
    dotall: bool = False
    unicode: bool = True
    engine: str = "default"  # default, pcre2, auto
    terminator: str = "lf"  # lf, crlf, nul
    binary: str = "quit"  # quit, convert, text
    # Which lines, and how they are shown.
    before: int = 0
    after: int = 0
    passthru: bool = False
    max_count: int | None = None
    stop_on_nonmatch: bool = False
    only: bool = False
    replacement: str | None = None
    line_numbers: bool = True
    column: bool = False
    byte_offset: bool = False
    vimgrep: bool = False
    heading: bool = False
    with_path: bool | None = None
    null: bool = False
    max_columns: int = 0
    preview: bool = False
    trim: bool = False
    include_zero: bool = False
    quiet: bool = False
    stats: bool = False
    match_separator: str = ":"
    context_separator: str = "-"
    group_separator: str | None = "--"
    path_separator: str = "/"
    color: bool = False
    hyperlink: str = ""
    hostname: str = ""
    messages: bool = True
    # Which files.
    ignore: frozenset[str] = frozenset(SOURCES)
    ignore_files: tuple[str, ...] = ()
    ignore_files_fold: bool = False
    require_git: bool = False
    hidden: bool = False
    follow: bool = False
    one_file_system: bool = False
    max_depth: int | None = None
    globs: tuple[str, ...] = ()
    iglobs: tuple[str, ...] = ()
    glob_fold: bool = False
    types: tuple[str, ...] = ()
    types_not: tuple[str, ...] = ()
    type_changes: tuple[tuple[str, str], ...] = ()  # (add or clear, definition or name), in order
    listing: str | None = None
    # How they are read.
    zip: bool = False
    encoding: str = "auto"
    pre: str = ""
    pre_globs: tuple[str, ...] = ()
    max_filesize: int | None = None
    # Order of the results, and the index.
    sort: str = "path"
    reverse: bool = False
    limit: int | None = None
    offset: int = 0
    use_index: bool = True
    ttl: int = 0

    @property
    def ignore_case(self) -> bool:
        from seine.plans.regex import smart_case

        return self.case == "ignore" or (self.case == "smart" and all(smart_case(p, self.fixed) for p in self.patterns))

    @property
    def pcre(self) -> bool:
        """Whether the patterns are for the engine with look-around: asked for, or needed under ``auto``."""
        from seine.plans.regex import RegexError, analyse

        if self.engine != "auto" or self.fixed:
            return self.engine == "pcre2"
        try:
            for p in self.patterns:
                analyse(p)
        except RegexError:
            return True
        return False

    @property
    def text(self) -> bool:
        return self.binary == "text"


def _switches() -> dict[str, dict]:
    """Flags without a value: what each sets."""
    out: dict[str, dict] = {}

    def pair(names: str, field: str, off: str = "", on: object = True, default: object = False) -> None:
        """``names`` set a field, ``off`` puts it back."""
        out.update({n: {field: on} for n in names.split()})
        out.update({n: {field: default} for n in off.split()})

    pair("-F --fixed-strings", "fixed", "--no-fixed-strings")
    pair("-i --ignore-case", "case", on="ignore")
    pair("-s --case-sensitive", "case", on="sensitive")
    pair("-S --smart-case", "case", on="smart")
    pair("-w --word-regexp", "bound", on="word")
    pair("-x --line-regexp", "bound", on="line")
    pair("-v --invert-match", "invert", "--no-invert-match")
    pair("-U --multiline", "multiline", "--no-multiline")
    pair("--multiline-dotall", "dotall", "--no-multiline-dotall")
    pair("--unicode --pcre2-unicode", "unicode", "--no-unicode --no-pcre2-unicode")
    pair("-P --pcre2", "engine", "--no-pcre2", "pcre2", "default")
    pair("--auto-hybrid-regex", "engine", "--no-auto-hybrid-regex", "auto", "default")
    pair("--crlf", "terminator", "--no-crlf", "crlf", "lf")
    pair("-a --text", "binary", "--no-text", "text", "quit")
    pair("--binary", "binary", "--no-binary", "convert", "quit")
    pair("-o --only-matching", "only")
    pair("-n --line-number", "line_numbers", "-N --no-line-number")
    pair("--column", "column", "--no-column")
    pair("-b --byte-offset", "byte_offset", "--no-byte-offset")
    pair("--heading", "heading", "--no-heading")
    pair("-H --with-filename", "with_path", "-I --no-filename")
    pair("-0 --null", "null")
    pair("--max-columns-preview", "preview", "--no-max-columns-preview")
    pair("--trim", "trim", "--no-trim")
    pair("--include-zero", "include_zero", "--no-include-zero")
    pair("-q --quiet", "quiet")
    pair("--stats", "stats", "--no-stats")
    pair("--no-messages", "messages", "--messages", False, True)
    pair("--no-context-separator", "group_separator", on=None)
    pair("--hidden -.", "hidden", "--no-hidden")
    pair("-L --follow", "follow", "--no-follow")
    pair("--one-file-system", "one_file_system", "--no-one-file-system")
    pair("--glob-case-insensitive", "glob_fold", "--no-glob-case-insensitive")
    pair("--ignore-file-case-insensitive", "ignore_files_fold", "--no-ignore-file-case-insensitive")
    pair("--require-git", "require_git", "--no-require-git")
    pair("-z --search-zip", "zip", "--no-search-zip")
    pair("--no-encoding", "encoding", on="auto")
    pair("--no-pre", "pre", on="")
    pair("--no-index", "use_index", on=False)
    pair("--sort-files", "sort", "--no-sort-files", "path", "none")
    for mode, names in {"files": "-l --files-with-matches", "without": "--files-without-match", "count": "-c --count", "count_matches": "--count-matches", "json": "--json", "types": "--type-list"}.items():
        pair(names, "mode", on=mode)
    out["--no-json"] = {"mode": "lines"}
    out["--passthru"] = out["--passthrough"] = {"passthru": True, "before": 0, "after": 0}
    out["--null-data"] = {"terminator": "nul", "binary": "text"}
    out["--stop-on-nonmatch"] = {"stop_on_nonmatch": True, "multiline": False}
    out["-U"] = out["--multiline"] = {"multiline": True, "stop_on_nonmatch": False}
    out["--vimgrep"] = {"vimgrep": True, "column": True}
    out["-p"] = out["--pretty"] = {"color": True, "heading": True, "line_numbers": True}
    no_op = "--mmap --no-mmap --no-config --block-buffered --no-block-buffered --line-buffered --no-line-buffered --debug --trace"
    no_op += " --ignore-messages --no-ignore-messages --ignore-files"
    out.update({n: {} for n in no_op.split()})
    return out


_FLAGS = _switches()
_VALUES = {
    "-e": "patterns", "--regexp": "patterns", "-f": "file", "--file": "file", "-g": "globs", "--glob": "globs", "--iglob": "iglobs",
    "-t": "types", "--type": "types", "-T": "types_not", "--type-not": "types_not", "--type-add": "add", "--type-clear": "clear",
    "-A": "after", "--after-context": "after", "-B": "before", "--before-context": "before", "-C": "around", "--context": "around",
    "-m": "max_count", "--max-count": "max_count", "-M": "max_columns", "--max-columns": "max_columns", "-d": "max_depth", "--max-depth": "max_depth", "--maxdepth": "max_depth",
    "-r": "replacement", "--replace": "replacement", "--sort": "sort", "--sortr": "sortr", "--engine": "engine", "-E": "encoding", "--encoding": "encoding",
    "--pre": "pre", "--pre-glob": "pre_globs", "--ignore-file": "ignore_files", "--max-filesize": "max_filesize", "--ttl": "ttl",
    "--context-separator": "group_separator", "--field-match-separator": "match_separator", "--field-context-separator": "context_separator", "--path-separator": "path_separator",
    "--color": "color", "--colors": "", "--hyperlink-format": "hyperlink", "--hostname-bin": "hostname", "-j": "", "--threads": "", "--regex-size-limit": "size", "--dfa-size-limit": "size",
}
_NUMBERS = {"after", "before", "around", "max_count", "max_columns", "max_depth", "ttl"}
_LISTS = ("patterns", "globs", "iglobs", "types", "types_not", "pre_globs", "ignore_files")
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "0": "\0", "\\": "\\"}


def parse_size(value: str) -> int:
    """``digits[K|M|G]``, in powers of 1024."""
    m = re.fullmatch(r"([0-9]+)([KMG]?)", value)
    if not m:
        raise UsageError(f"invalid size: {value}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2]]


def unescape(value: str) -> str:
    r"""A separator with ``\t \n \r \0 \\ \xNN``."""
    return re.sub(r"\\(?:([tnr0\\])|x([0-9A-Fa-f]{2}))", lambda m: _ESCAPES[m[1]] if m[1] else chr(int(m[2], 16)), value)


class _Reader:
    """A command line as it is read."""

    def __init__(self) -> None:
        self.set: dict = {}
        self.lists: dict[str, list[str]] = {k: [] for k in _LISTS}
        self.changes: list[tuple[str, str]] = []
        self.rest: list[str] = []
        self.ignore = set(SOURCES)
        self.around: int | None = None
        self.sided: dict[str, int] = {}
        self.given = self.no_files = False
        self.unrestricted = 0

    def flag(self, name: str) -> bool:
        """A flag without a value; False if it is none."""
        toggle = re.fullmatch(r"--(no-)?ignore(?:-(dot|vcs|exclude|global|parent))?", name)
        if toggle:
            named = {toggle[2]} if toggle[2] else set(SOURCES)
            self.ignore = self.ignore - named if toggle[1] else self.ignore | named
        elif name == "--no-ignore-files":
            self.no_files = True
        elif re.fullmatch(r"-u+|--unrestricted", name):
            self.unrestricted += 1 if name.startswith("--") else len(name) - 1
            self.ignore = set()
            self.set |= {"hidden": True} if self.unrestricted >= 2 else {}
            self.set |= {"binary": "convert"} if self.unrestricted >= 3 else {}
        elif name in _FLAGS:
            self.set |= _FLAGS[name]
        else:
            return False
        return True

    def value(self, flag: str, value: str) -> None:
        name = _VALUES[flag]
        if name in _NUMBERS:
            if not (value.isascii() and value.isdigit()):
                raise UsageError(f"{flag}: not a number: {value}")
            number = int(value)
            if name == "around":
                self.around, self.set["passthru"] = number, False
            elif name in ("before", "after"):
                self.sided[name], self.set["passthru"] = number, False
            else:
                self.set[name] = number
        elif name in self.lists:
            self.lists[name].append(value)
            self.given |= name == "patterns"
        elif name == "file":
            self.given = True
            with open(0 if value == "-" else value, encoding="utf-8", closefd=value != "-") as f:
                self.lists["patterns"] += f.read().splitlines()
        elif name in ("add", "clear"):
            self.changes.append((name, value))
        elif name in ("sort", "sortr"):
            if value not in SORTS:
                raise UsageError(f"{flag}: unknown order: {value}")
            self.set |= {"sort": value, "reverse": name == "sortr"}
        elif name == "engine":
            if value not in ("default", "pcre2", "auto"):
                raise UsageError(f"unrecognized regex engine '{value}'")
            self.set["engine"] = value
        elif name == "color":
            if value not in ("never", "auto", "always", "ansi"):
                raise UsageError(f"{flag}: unknown choice: {value}")
            self.set["color"] = value in ("always", "ansi")
        elif name == "encoding":
            try:
                "".encode("utf-8" if value in ("auto", "none") else value)
                self.set["encoding"] = value
            except LookupError:
                raise UsageError(f"unknown encoding: {value}") from None
        elif name in ("group_separator", "match_separator", "context_separator", "path_separator"):
            self.set[name] = unescape(value)
            if name == "path_separator" and len(self.set[name].encode()) != 1:
                raise UsageError(f"{flag} has to be one byte")
        elif name == "max_filesize":
            self.set[name] = parse_size(value)
        elif name == "size":
            parse_size(value)  # the engine has no such limits; the value has to be right
        elif name:
            self.set[name] = value

    def spec(self) -> SearchSpec:
        s, lists = self.set, self.lists
        if not s.get("passthru"):
            s |= {"before": self.sided.get("before", self.around or 0), "after": self.sided.get("after", self.around or 0)}
        if s.get("mode") == "types":
            pass
        elif "listing" in s:
            s["mode"] = "listing"
        elif not self.given:
            if not self.rest:
                raise UsageError("a pattern is required")
            lists["patterns"].append(self.rest.pop(0))
        if s.get("mode") == "count" and s.get("only") and not s.get("invert"):
            s["mode"] = "count_matches"
        if s.get("preview") and "max_columns" not in s:
            raise UsageError("--max-columns-preview needs --max-columns")
        if s.get("vimgrep"):
            s["heading"] = False
            s.setdefault("with_path", True)
        if self.no_files:
            lists["ignore_files"] = []
        if "vcs" not in self.ignore:  # those are sources of the version control too
            self.ignore -= {"exclude", "global"}
        operands = tuple("." if x.strip("/") in (".", "") else x.removeprefix("./").rstrip("/") for x in self.rest)
        return SearchSpec(**s, **{k: tuple(v) for k, v in lists.items()}, ignore=frozenset(self.ignore), type_changes=tuple(self.changes), operands=operands)


def parse_argv(argv: list[str]) -> SearchSpec:
    """The specification that a command line gives."""
    r, argv, i, only_rest = _Reader(), list(argv), 0, False
    while i < len(argv):
        a = argv[i]
        i += 1
        if only_rest or a == "-" or not a.startswith("-"):
            r.rest.append(a)
            continue
        if a == "--":
            only_rest = True
            continue
        value = None
        if a == "--files":  # its glob is optional: the next word, unless that is a flag
            glob = i < len(argv) and not argv[i].startswith("-")
            r.set["listing"], i = (argv[i], i + 1) if glob else ("**", i)
            continue
        if a.startswith("--") and "=" in a:
            a, value = a.split("=", 1)
            if a == "--files":
                r.set["listing"] = value
                continue
        elif not a.startswith("--") and len(a) > 2 and not re.fullmatch(r"-u+", a):  # bundled short flags, the last may take a value
            if a[:2] in _VALUES:
                a, value = a[:2], a[2:].removeprefix("=")
            else:
                argv[i:i] = ["-" + a[2:]]
                a = a[:2]
        if a in _VALUES:
            if value is None:
                if i >= len(argv):
                    raise UsageError(f"{a} needs a value")
                value, i = argv[i], i + 1
            r.value(a, value)
        elif value is not None or not r.flag(a):
            raise UsageError(f"unrecognized flag {a}")
    return r.spec()


def from_tool_request(request: dict) -> SearchSpec:
    """An agent's search request (pattern, path, glob, type, output_mode, -i, -A ...) as a specification."""
    mode = {"content": "lines", "files_with_matches": "files", "count": "count"}[request.get("output_mode", "files_with_matches")]
    around = int(request.get("-C", request.get("context", 0)) or 0)
    multiline = bool(request.get("multiline"))
    one = lambda key: tuple(filter(None, [request.get(key)]))
    spec = SearchSpec(patterns=(request["pattern"],), mode=mode, case="ignore" if request.get("-i") else "sensitive")
    return replace(
        spec, multiline=multiline, dotall=multiline, before=int(request.get("-B", around)), after=int(request.get("-A", around)), line_numbers=bool(request.get("-n", True)),
        globs=one("glob"), types=one("type"), operands=one("path"), limit=request.get("head_limit"), offset=int(request.get("offset", 0) or 0),
    )
