"""Regular expressions: parsing, required literals, trigram plans, Java dialect.

``plan`` derives groups of trigrams from a pattern: for every text that the
pattern matches, all trigrams of at least one group occur in it. Whatever the
analysis can't follow becomes a gap, and a group without trigrams makes the
plan ``None`` (scan everything), so a plan may be wide but never loses a match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import product

#: Limits of the analysis: variants of one concatenation, characters of a
#: class, copies of a repetition, groups, trigrams of a group.
VARIANTS, CLASS, COPIES, GROUPS, TRIGRAMS = 64, 64, 64, 128, 1024
GAP = None
Variants = list[tuple]  # each a tuple of literals and gaps


class RegexError(ValueError):
    """The pattern is not in the default engine's language."""


class _Parser:
    """Recursive descent to variants; refuses look-around and back-references."""

    def __init__(self, pattern: str, pcre: bool) -> None:
        self.p, self.i, self.pcre = pattern, 0, pcre
        self.fold = self.upper = self.newline = self.nul = self.opaque = False
        self.groups, self.names = 0, set()

    def fail(self, what: str) -> RegexError:
        return RegexError(f"{what} at {self.i} in {self.p!r}")

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def alternation(self) -> Variants:
        out = self.concatenation()
        while self.peek() == "|":
            self.i += 1
            out = out + self.concatenation()
        return out if len(out) <= GROUPS else [(GAP,)]

    def concatenation(self) -> Variants:
        parts: list[Variants] = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repetition(self.atom()))
        return _concatenated(parts)

    def repetition(self, node: Variants) -> Variants:
        while True:
            m = re.compile(r"\*|\+|\?|\{(\d+)(,?)(\d*)\}").match(self.p, self.i)
            if not m:
                return node
            self.i = m.end()
            if self.peek() in ("?", "+") and (self.peek() == "?" or self.pcre):
                self.i += 1
            low = 1 if m[0] == "+" else int(m[1]) if m[1] else 0
            exact = bool(m[1]) and (not m[2] or m[3] == m[1])
            if m[3] and m[1] and int(m[3]) < low:
                raise self.fail("repetition out of order")
            if low == 0:
                node = [()] if exact else [(GAP,)]
            else:
                copies = _concatenated([node] * min(low, COPIES))
                node = copies if exact and low <= COPIES else _concatenated([copies, [(GAP,)]])

    def atom(self) -> Variants:
        c = self.peek()
        self.i += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == ".":
            return [(GAP,)]
        if c in "^$":
            return [()]
        if c == "\\":
            return self.escape()
        if c in "*+?":
            raise self.fail("nothing to repeat")
        return self.literal(c)

    def literal(self, c: str) -> Variants:
        self.upper |= c.isupper()
        self.newline |= c == "\n"
        self.nul |= c == "\0"
        return [(c,)]

    def group(self) -> Variants:
        m = re.compile(r"\?(?:P?<([A-Za-z_]\w*)>|:)").match(self.p, self.i)
        flags = re.compile(r"\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])").match(self.p, self.i)
        if m:
            self.i = m.end()
            if m[1]:
                self.groups += 1
                self.names.add(m[1])
        elif flags:
            self.i = flags.end()
            if not self.pcre and (unknown := set(flags[1] + (flags[2] or "")) - set("imsUuxR")):
                raise self.fail(f"unrecognized flag {sorted(unknown)}")
            self.fold |= "i" in flags[1]
            # Literals of verbose mode have blanks and comments among them: nothing is read off.
            self.opaque |= bool(set(flags[1]) - set("imsUuR"))
            if flags[3] == ")":
                return [()]
        elif self.peek() == "?":
            if not self.pcre:
                raise self.fail("look-around is not supported")
            self.i = len(self.p)
            return [(GAP,)]
        else:
            self.groups += 1
        out = self.alternation()
        if self.peek() != ")":
            raise self.fail("unclosed group")
        self.i += 1
        return out

    def escape(self) -> Variants:
        c = self.peek()
        self.i += 1
        if not c:
            raise self.fail("trailing backslash")
        if c.isdigit() or c == "k":
            if not self.pcre:
                raise self.fail("back-references are not supported")
            return [(GAP,)]
        if c in "bBAzZG":
            return [()]
        if c in "pP":
            m = re.compile(r"\{[^}]*\}|.").match(self.p, self.i)
            self.i = m.end() if m else self.i
            return [(GAP,)]
        if c in "xu":
            m = re.compile(r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})" if c == "u" else r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{2})").match(self.p, self.i)
            if not m:
                raise self.fail("bad escape")
            self.i = m.end()
            return self.literal(chr(int(m[1] or m[2], 16)))
        simple = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
        if c in simple:
            return self.literal(simple[c])
        if c.isalpha():
            return [(GAP,)]
        return self.literal(c)

    def char_class(self) -> Variants:
        start = self.i
        negated = self.peek() == "^"
        self.i += negated
        chars: set[str] | None = set()
        first = True
        while (c := self.peek()) != "]" or first:
            if not c:
                self.i = start
                raise self.fail("unclosed class")
            first = False
            if self.p.startswith("[:", self.i) and (end := self.p.find(":]", self.i)) > 0:
                self.i, chars = end + 2, None
                continue
            if c == "[" or self.p.startswith("&&", self.i):
                chars = None
            self.i += 1
            one: str | None = c
            if c == "\\":
                got = self.escape()
                one = got[0][0] if got and got[0] and got[0][0] is not GAP else None
            if one is None or chars is None:
                chars = None
                continue
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", "", "\\"):
                last = self.p[self.i + 1]
                self.i += 2
                if ord(last) < ord(one):
                    raise self.fail("range out of order")
                chars = chars | {chr(k) for k in range(ord(one), ord(last) + 1)} if ord(last) - ord(one) <= CLASS else None
            else:
                chars.add(one)
        self.i += 1
        if negated or chars is None or len(chars) > CLASS:
            return [(GAP,)]
        return [(c,) for c in sorted(chars)]


def _concatenated(parts: list[Variants]) -> Variants:
    """Products of the parts with neighbouring literals fused; too many give a gap in place of a part."""
    out: Variants = [()]
    for part in parts:
        if len(out) * len(part) > VARIANTS:
            out, part = (out, [(GAP,)]) if len(out) <= VARIANTS else ([(GAP,)], part)
        out = [_fuse(a, b) for a, b in product(out, part)]
    return out


def _fuse(a: tuple, b: tuple) -> tuple:
    if a and b and a[-1] is not GAP and b[0] is not GAP:
        return (*a[:-1], a[-1] + b[0], *b[1:])
    return a + b if not (a and b and a[-1] is GAP and b[0] is GAP) else a + b[1:]


@dataclass(frozen=True)
class Analysis:
    variants: tuple
    fold: bool  # an inline flag ignores case
    upper: bool  # an upper-case literal
    newline: bool  # a literal line feed
    nul: bool  # a literal NUL
    groups: int  # capturing groups
    names: frozenset[str]


def analyse(pattern: str, pcre: bool = False) -> Analysis:
    p = _Parser(pattern, pcre)
    out = p.alternation()
    if p.i < len(pattern):
        raise p.fail("unopened group")
    variants = ((GAP,),) if p.opaque else tuple(out)
    return Analysis(variants, p.fold, p.upper, p.newline, p.nul, p.groups, frozenset(p.names))


def trigrams(data: bytes) -> set[int]:
    """Packed three-byte windows."""
    return {data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)}


def unpack(tri: int) -> bytes:
    return bytes((tri >> 16, tri >> 8 & 255, tri & 255))


def spellings(tri: int) -> list[int]:
    """ASCII case variants of a trigram, at most eight."""
    options = [{b, b ^ 32} if chr(b).isascii() and chr(b).isalpha() else {b} for b in unpack(tri)]
    return sorted(a << 16 | b << 8 | c for a, b, c in product(*options))


#: Most spellings of three characters; beyond it they require nothing.
SPELLINGS = 27


@cache
def _folds() -> dict[str, tuple[str, ...]]:
    """Characters that are equal when case is ignored, where there are several.

    Two are equal if their upper cases' lower cases are, as in Java's engine;
    mappings to several characters don't count.
    """
    one = lambda c, d: d if len(d) == 1 else c
    classes: dict[str, set[str]] = {}
    for k in range(0x110000):
        c = chr(k)
        if c.upper() != c or c.lower() != c:
            up = one(c, c.upper())
            low = one(up, up.lower())
            classes.setdefault(low, {low}).update((c, up))
    return {c: tuple(sorted(same)) for same in classes.values() if len(same) > 1 for c in same}


def folded(chars: str) -> list[int] | None:
    """A trigram of every spelling of three characters, ignoring case; None if there are too many.

    A spelling of more than three bytes is looked up by its first three.
    """
    options = [_folds().get(c, (c,)) for c in chars]
    if len(options[0]) * len(options[1]) * len(options[2]) > SPELLINGS:
        return None
    return sorted({int.from_bytes("".join(x).encode()[:3], "big") for x in product(*options)})


def _required(literal: str, fold: bool, unicode: bool) -> set[tuple[int, ...]]:
    """What a text with this literal has: for every element one of its trigrams."""
    if not fold:
        return {(t,) for t in trigrams(literal.encode())}
    if not unicode:
        return {tuple(spellings(t)) for t in trigrams(literal.encode()) if all(b < 128 for b in unpack(t))}
    windows = (folded(literal[k : k + 3]) for k in range(len(literal) - 2))
    return {tuple(w) for w in windows if w is not None}


def plan(pattern: str, fixed: bool = False, ignore_case: bool = False, unicode: bool = True, pcre: bool = False) -> list[list[list[int]]] | None:
    """Groups (any) of required trigrams (all), each with the spellings (any) to look up; None scans all."""
    if fixed:
        variants, fold = [(pattern,)], False
    else:
        try:
            a = analyse(pattern, pcre)
        except RegexError:
            if pcre:
                return None
            raise
        variants, fold = a.variants, a.fold
    fold = fold or ignore_case
    groups = set()
    for v in variants:
        need: set[tuple[int, ...]] = set()
        for literal in v:
            if literal is not GAP:
                need |= _required(literal, fold, unicode)
        if not need:
            return None
        groups.add(frozenset(sorted(need)[:TRIGRAMS]))
    # A group that contains another adds nothing.
    least = [g for g in groups if not any(o < g for o in groups)]
    return [[list(t) for t in sorted(g)] for g in sorted(least, key=sorted)]


#: Most alternatives that a prefilter tests.
PREFILTERS = 16


def required_literals(pattern: str, fixed: bool = False, pcre: bool = False) -> list[str] | None:
    """Literals one of which every match holds (the longest of each variant); None if there is no such list."""
    if fixed:
        return [pattern] if pattern else None
    try:
        a = analyse(pattern, pcre)
    except RegexError:
        return None
    if a.fold:
        return None
    out = {max((x for x in v if x is not GAP), key=len, default="") for v in a.variants}
    return sorted(out) if all(out) and len(out) <= PREFILTERS else None


def replacement(template: str, pattern: str, fixed: bool = False, pcre: bool = False) -> str:
    """A replacement in Java's syntax: ``$n``, ``${n}``, ``$name``, ``${name}`` (of the longest name), ``$$``.

    A group that the pattern lacks is empty; anything else stands for itself.
    """
    if fixed:
        groups, names = 0, frozenset()
    else:
        a = analyse(pattern, pcre)
        groups, names = a.groups, a.names
    out, i = [], 0
    while i < len(template):
        c = template[i]
        m = re.compile(r"\$(?:\$|([0-9A-Za-z_]+)|\{([^}]*)\})").match(template, i)
        if not m:
            out.append("\\" + c if c in "\\$" else c)
            i += 1
            continue
        i = m.end()
        if m[0] == "$$":
            out.append("\\$")
        elif (name := m[1] or m[2] or "") in names:
            out.append(f"${{{name}}}")
        elif name.isascii() and name.isdigit() and int(name) <= groups:
            out.append(f"${int(name)}")
            if template[i : i + 1].isdigit():  # it is not part of the number
                out.append("\\" + template[i])
                i += 1
    return "".join(out)


def _java_flags(m: re.Match) -> str:
    """Inline flags of the same meaning: Java has no swapped greed, and its U stands for Unicode classes."""
    on, off = (m[1].translate({ord("U"): None, ord("R"): None}), (m[2] or "").translate({ord("U"): None, ord("R"): None, ord("u"): "U"}))
    return f"(?{on}{'-' + off if off else ''}{m[3]}" if on or off or m[3] == ":" else ""


_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "xdigit": r"\p{XDigit}", "word": r"\w"}


def java(pattern: str, fixed: bool = False, ignore_case: bool = False, word: bool = False, line: bool = False, unicode: bool = True, dotall: bool = False, crlf: bool = False) -> str:
    """The pattern for Java's engine: lines end at line feeds only, classes are Unicode's by default."""
    if fixed:
        pattern = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
    else:
        pattern = re.sub(r"\(\?P<", "(?<", pattern)
        pattern = re.sub(r"(?<!\\)\(\?([imsxuUR]*)(?:-([imsxuUR]*))?([:)])", _java_flags, pattern)
        pattern = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), pattern)
    if word:
        pattern = rf"(?<!\w)(?:{pattern})(?!\w)"
    if line:
        pattern = f"^(?:{pattern})$"
    flags = "m" + ("" if crlf else "d") + ("U" if unicode else "") + ("iu" if ignore_case and unicode else "i" if ignore_case else "") + ("s" if dotall else "")
    return f"(?{flags}){pattern}"


def smart_case(pattern: str, fixed: bool = False) -> bool:
    """Whether smart case ignores case: no upper-case literal in the pattern."""
    return not any(c.isupper() for c in pattern) if fixed else not analyse(pattern, True).upper


def can_match_empty(pattern: str) -> bool:
    try:
        return re.search(re.sub(r"\[:\w+:\]", r"\\w", pattern), "") is not None
    except re.error:
        return True
