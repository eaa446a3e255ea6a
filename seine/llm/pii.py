r"""Personal data: base patterns, and candidates judged by gradient boosting.

Base spans (e-mail, IP, card, phone) are found by fixed patterns and always
stay. High-recall generators propose further, overlapping spans: obfuscated
e-mails, phone numbers without a country sign, national numbers, IBANs, secrets
(opaque tokens, and values that are assigned to a name such as ``password``),
and cards or addresses that the base drops. Of a run of digits, less its base
spans, every window of tokens is proposed. Boosted regression trees over features
of a candidate's format and context give a log-odds, which Platt scaling
calibrates; the least threshold that keeps a kind's precision at ``PRECISION``
on calibration data selects spans, best first, none overlapping another.

No table labels spans, so the trees are trained on ``TEXTS`` texts written by a
seeded generator: personal data in many formats and contexts, and numbers and
names that are none (orders, dates, versions, commits, amounts, identifiers).

Added spans overlap neither a base span nor each other, but for secrets, which
may hold a base span (sixteen digits of a key that pass for a card): the whole
of it is to be redacted.

Defined cases: a null or empty text has no spans; positions are code points,
end exclusive; repeated rows agree; very long texts, digit runs and tokens are
scanned in linear time; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read. ``redacted`` keeps all columns and a null
text null.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seine.llm.session import ids_and_texts, tune
from seine.llm.text import pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "iban", "secret")
PRECISION = 0.98
#: Texts that the trees are trained and calibrated on, half of them each.
TEXTS = 6000
_SIGNS = re.compile(r"[0-9@=]| at | dot |\[at\]|\(at\)|assw|ecret|oken", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base(text: str) -> list[Span]:
    """Base spans by kind in the order of ``BASE``, then start."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        low = at
        while low > last and text[low - 1] in _LOCAL:
            low -= 1
        m = _DOMAIN.match(text, at + 1) if low < at else None
        if m:
            out.append(("email", low, m.end()))
            last = m.end()
        # A run of local characters is visited once: it ends at this sign.
        last = max(last, at)
        at = text.find("@", at + 1)
    last = 0
    for d in _DIGITS.finditer(text):
        if d.start() >= last and (m := _IP.match(text, d.start())):
            last = m.end()
            if all(map(_byte, m[0].split("."))):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_RUN = re.compile(r"[+(]?[0-9][0-9 ().\-/]*+")
_TOKEN = re.compile(r"[^ ]+")
#: Most characters of a number that is proposed from a run.
LONGEST = 40
#: Candidates judged at once.
BLOCK = 4096
_DASHED = re.compile(r"[0-9]-[0-9]")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


#: Tokens of letters and digits that no word is, and what is assigned to a name that tells of a secret.
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9])")
_KEYED = re.compile(r"(?i:passw(?:or)?d|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|bearer)[\"']?(?: ?[:=]{1,2} ?| is | )[\"']?([^\s\"'`,;]{6,256})")


_NAMES = ("passw", "pwd", "secret", "token", "credential", "key", "bearer")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _covered(spans: list[Span]) -> list[tuple[int, int]]:
    """Ranges that the spans cover, sorted and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _outside(lo: int, hi: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a range outside the taken ones, which are sorted and apart."""
    k = max(0, bisect_left(taken, (lo, lo)) - 1)
    while k < len(taken) and taken[k][0] < hi:
        if lo < taken[k][0]:
            yield lo, taken[k][0]
        lo = max(lo, taken[k][1])
        k += 1
    if lo < hi:
        yield lo, hi


def _proposed(text: str, taken: list[tuple[int, int]]) -> Iterator[Span]:
    """Proposed spans, overlapping and of several kinds, none twice.

    Of a run of digits, without its ``taken`` ranges, every window of
    consecutive tokens whose length and digits fit a kind is proposed.
    """
    if " dot " in text.lower() or "dot]" in text.lower() or "dot)" in text.lower() or "@" in text:
        yield from (("email", *m.span()) for m in _OBFUSCATED.finditer(text))
    for m in _RUN.finditer(text):
        for low, high in _outside(*m.span(), taken):
            tokens = [(x.start(), x.start() + len(s), sum(map(s.count, "0123456789"))) for x in _TOKEN.finditer(text, low, high) if (s := x[0].rstrip("+().-/"))]
            for k, (lo, _, _) in enumerate(tokens):
                n = 0
                for j in range(k, len(tokens)):
                    _, hi, digits = tokens[j]
                    n += digits
                    if hi - lo > LONGEST or n > 19:
                        break
                    if 7 <= n <= 15:
                        yield "phone", lo, hi
                    if 13 <= n:
                        yield "card", lo, hi
                    if n <= 12 and text.count(".", lo, hi) == 3:
                        yield "ip", lo, hi
    yield from (("national_id", *m.span()) for m in (_NATIONAL.finditer(text) if _DASHED.search(text) else ()))
    yield from (("iban", *m.span()) for m in _IBAN.finditer(text))
    last = {}
    for m in _OPAQUE.finditer(text) if any(len(w) >= 16 and not w.isalpha() for w in text.split()) else ():
        if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
            last[m.span()] = None
    low = text.lower() if text.isascii() else text.translate(_LOWER)  # of the same length
    for m in _KEYED.finditer(text) if any(k in low for k in _NAMES) else ():
        if len(value := m[1].rstrip(".:)]}>")) >= 6:
            last[m.start(1), m.start(1) + len(value)] = None
    yield from (("secret", *x) for x in last)


def candidates(text: str, taken: list[tuple[int, int]] | None = None) -> list[Span]:
    """All proposed spans in order."""
    return sorted(_proposed(text, taken or []))


_CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse|login", re.I),
    "card": re.compile(r"card|visa|credit|debit|karte|carte|tarjeta|pay", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|cell|ring|anruf|appel|llam", re.I),
    "national_id": re.compile(r"ssn|social|security|national|insurance|sozial", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta|transfer", re.I),
    "secret": re.compile(r"passw|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|bearer", re.I),
}
_OTHER = re.compile(r"sha|md5|hash|checksum|etag|uuid|url|http|file|path|count|policy|order|invoice|ref|version|serial|part|item|sku|isbn|date|total|price|build|commit|amount|page|year|no\.|#|id\b", re.I)
#: The run goes on before a candidate, with a country sign, or after it.
_LED, _SIGNED, _FOLLOWED = re.compile(r"[0-9)][ ().\-/]{0,2}$"), re.compile(r"\+[0-9]{1,3}[ ().\-]{0,2}$"), re.compile(r"[ ().\-/]{0,2}[0-9]")


#: Beginnings of well-known keys, and the sign of an assignment just before a value.
_PREFIX, _ASSIGNED = re.compile(r"AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abprs]-|AIza|eyJ|glpat-"), re.compile(r"[:=] ?[\"']?$|[Bb]earer $")


def _shape(s: str) -> list[float]:
    """Whether a token looks drawn at random: entropy, changes between letters and digits, its alphabet."""
    n = len(s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    longest = max(map(len, re.findall(r"[A-Za-z]+", s) or [""]))
    return [entropy, changes / n, float(all(c in "0123456789abcdefABCDEF" for c in s)), float(s != s.lower() and s != s.upper()), sum(map(str.isdigit, s)) / n, longest / n, float(sum(map(s.count, "-_/"))), float(bool(_PREFIX.match(s)))]


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, lo, hi = span
    s, before, after = text[lo:hi], text[max(0, lo - 40) : lo], text[hi : hi + 24]
    digits = "".join(c for c in s if c in "0123456789")
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    parts = s.split(".")
    return [
        float(KINDS.index(kind)), len(s), len(digits), len(groups), max(groups), min(groups), groups[-1],
        s.count("-"), s.count(" "), s.count("."), s.count("/"), float("(" in s), float(s[:1] == "+"), float("@" in s),
        float(bool(digits) and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6")), float(digits[:1] == "0"),
        float(len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)),
        float(len(set(groups)) == 1), float(bool(_CONTEXT[kind].search(before))), float(bool(_CONTEXT[kind].search(after))),
        float(bool(_OTHER.search(before[-16:]))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#/=_-." if before else 0),
        float(after[:1] in "%€$/=_-" if after else 0), float(_iban(s)) if kind == "iban" else 0.0, float(groups in ([3, 3, 4], [1, 3, 3, 4], [3, 4])),
        float(bool(_LED.search(before))), float(bool(_SIGNED.search(before))), float(bool(_FOLLOWED.match(after))),
        float(bool(_ASSIGNED.search(before))), *(_shape(s) if kind == "secret" else [0.0] * 8),
    ]


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return s[4:].isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Trees:
    """Gradient boosting of depth-limited trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)))[1:] for c in x.T]
        b = self._bin(x)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        f, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            node, tree = np.zeros(len(y), np.int64), []
            g, h = y - p, p * (1 - p)
            for level in range(self.depth):
                at = [self._split(b[node == k], g[node == k], h[node == k]) for k in range(1 << level)]
                tree.append(at)
                feature, cut = (np.array([a[i] for a in at])[node] for i in (0, 1))
                node = node * 2 + (b[np.arange(len(b)), feature] > cut)
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            f += value[node]
            self.trees.append((tree, value))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best = (1e-6, 0, self.bins)
        for k in range(b.shape[1]):
            gs, hs = (np.cumsum(np.bincount(b[:, k], v, self.bins + 1)) for v in (g, h))
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            c = int(gain.argmax())
            best = max(best, (float(gain[c]), k, c))
        return best[1:]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bin(x), np.full(len(x), self.start)
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for at in tree:
                feature, cut = (np.array([a[i] for a in at])[node] for i in (0, 1))
                node = node * 2 + (b[np.arange(len(b)), feature] > cut)
            f += value[node]
        return f


def _written(rng: np.random.Generator) -> tuple[str, Span | None]:
    """A text with personal data, or with a number that is none."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick("an", "er", "ti", "le", "sh", "ou", "de", "que", "re") for _ in range(rng.integers(1, 4)))
    kind, said = None, ""
    if rng.random() < 0.5:
        kind = pick(*KINDS)
        said = {"email": pick("mail", "contact", "write to"), "ip": pick("ip", "host", "server"), "card": pick("card", "visa", "credit card"), "phone": pick("phone", "call", "tel"), "national_id": pick("ssn", "social security"), "iban": pick("iban", "bank account"), "secret": pick("token", "secret", "password", "api_key", "access key", "Bearer")}[kind] + pick("", ":", " is") + " "
        if kind == "email":
            s = f"{word()}{pick('', '.', '_')}{word()}{pick(' at ', ' [at] ', '(at)', '@')}{word()}{pick(' dot ', ' [dot] ', '(dot)')}{pick('com', 'org', 'net', 'de')}"
        elif kind == "ip":
            s = ".".join(str(rng.integers(0, 256)) for _ in range(4))
        elif kind == "card":
            d = pick("4", "5", "37", "6011") + num(11)
            d += next(c for c in "0123456789" if luhn(d + c))
            s = pick(d, "-".join(d[k : k + 4] for k in range(0, len(d), 4)), " ".join(d[k : k + 4] for k in range(0, len(d), 4)))
        elif kind == "phone":
            s = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(7)}", f"00{num(2)} {num(3)} {num(7)}", f"+{rng.integers(1, 100)} ({num(3)}) {num(3)}-{num(4)}", f"+{rng.integers(1, 100)} {num(3)} {num(3)} {num(4)}")
        elif kind == "national_id":
            s = f"{num(3)}-{num(2)}-{num(4)}"
        elif kind == "secret":
            letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
            drawn = lambda n, of=letters: "".join(pick(*of) for _ in range(n))
            s = [lambda: drawn(int(pick(32, 40, 64)), "0123456789abcdef"), lambda: drawn(int(rng.integers(20, 65))), lambda: drawn(int(rng.integers(20, 60)), letters + "+/_-"), lambda: "AKIA" + drawn(16, letters[26:]), lambda: f"{pick('ghp_', 'sk-', 'xoxb-', 'glpat-')}{drawn(int(rng.integers(24, 41)))}", lambda: f"{word()}{num(3)}{pick('!', '#', '$')}{word()}"][int(rng.integers(6))]()
            said = pick("token = ", "secret: ", "api_key=", "password = ", "access_key: ", "Authorization: Bearer ", "API-KEY = ", "passwd=", "my token is ")
            said += pick('"', "'", "", "") if said[-2:] in ("= ", ": ") or said[-1] == "=" else ""
            if _PREFIX.match(s):
                said = pick(said, "", "use ")
        else:
            d = pick("DE", "FR", "ES") + "00" + num(18)
            check = 98 - int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97
            d = f"{d[:2]}{check:02d}{d[4:]}"
            s = pick(d, " ".join(d[k : k + 4] for k in range(0, len(d), 4)))
    else:
        s = pick(num(rng.integers(7, 20)), f"20{num(2)}-0{rng.integers(1, 10)}-1{num(1)} 1{num(1)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(1)}.{num(2)}.{num(1)}.{num(4)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(4)}/{num(4)}", f"{num(1)} {num(3)} {num(3)}", f"{num(3)}-{num(2)}-{num(4)}", f"ZZ{num(2)} {num(4)} {num(4)} {num(4)}", f"{word()} at {word()}.{word()}", num(16))
        said = pick("order ", "invoice ", "ref ", "version ", "total ", "serial ", "", "", "", "#", "date ", "build ", "id ")
        if rng.random() < 0.4:  # what looks like a secret
            hexes = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
            said, s = [lambda: (pick("commit ", "sha1 ", "checksum: ", "md5 = ", "etag: ", "at ", ""), hexes(int(pick(32, 40, 64)))), lambda: (pick("id ", "uuid: ", ""), f"{hexes(8)}-{hexes(4)}-4{hexes(3)}-{hexes(4)}-{hexes(12)}"), lambda: (pick("see ", "file ", "path = "), "/".join(word() + pick("", num(2)) for _ in range(6))), lambda: (pick("", "in ", "call "), "_".join(word() for _ in range(5)) + num(int(rng.integers(1, 4)))), lambda: (pick("token count: ", "tokens = ", "token ", "password policy: ", "secret ", "the password ", "bearer "), pick(num(int(rng.integers(6, 9))), word() + word() + word()))][int(rng.integers(5))]()
    lead = " ".join(word() for _ in range(rng.integers(0, 6))) + " "
    # A phone number may stand beside another number, without a word that names it.
    beside = pick("", "", "", f" {num(rng.integers(1, 9))}", " " + ".".join(str(rng.integers(0, 256)) for _ in range(4))) if kind == "phone" else ""
    said = pick(said, "") if beside else said
    tail = beside + (said[-1:] if said[-1:] in ("'", '"') else "") + pick(" ", ". ", ", ") + " ".join(word() for _ in range(rng.integers(0, 6)))
    lo = len(lead) + len(said)
    return f"{lead}{said}{s}{tail}", (kind, lo, lo + len(s)) if kind else None


@dataclass
class Detector:
    trees: Trees
    scale: tuple[float, float]
    threshold: dict[str, float]

    def probabilities(self, text: str, spans: list[Span]) -> np.ndarray:
        raw = self.trees.raw(np.array([features(text, s) for s in spans]))
        return 1 / (1 + np.exp(-(self.scale[0] * raw + self.scale[1])))

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans; by kind in the order of ``KINDS``, then start."""
        if not text or not _SIGNS.search(text):
            return [], []
        sure = base(text)
        taken = _covered(sure)
        free = lambda a, b: not (k := bisect_left(taken, (b, b))) or taken[k - 1][1] <= a
        able: list[tuple[float, Span]] = []  # a run may have many candidates, only these are held
        for part in batched((s for s in _proposed(text, taken) if s[0] == "secret" or free(s[1], s[2])), BLOCK):
            able += [(-p, s) for p, s in zip(self.probabilities(text, list(part)).tolist(), part) if p >= self.threshold[s[0]]]
        added: list[Span] = []
        held: list[tuple[int, int]] = []  # selected, sorted, apart from each other
        for _, span in sorted(able):
            a, b = span[1:]
            at = bisect_left(held, (a, b))
            if (at == 0 or held[at - 1][1] <= a) and (at == len(held) or b <= held[at][0]):
                added.append(span)
                held.insert(at, (a, b))
        return sure, sorted(sure + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def train(texts: int = TEXTS, seed: int = 3, precision: float = PRECISION) -> Detector:
    """Trees on half of the written texts; calibration and thresholds on the other."""
    rng = np.random.default_rng(seed)
    halves: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
    for k in range(texts):
        text, truth = _written(rng)
        for c in candidates(text):
            x, y, kind = halves[k % 2]
            x.append(features(text, c))
            y.append(float(c == truth))
            kind.append(c[0])
    trees = Trees().fit(np.array(halves[0][0]), np.array(halves[0][1]))
    raw, y, kind = trees.raw(np.array(halves[1][0])), np.array(halves[1][1]), np.array(halves[1][2])
    a, b = 1.0, 0.0
    for _ in range(400):  # Platt scaling
        p = 1 / (1 + np.exp(-(a * raw + b)))
        a, b = a - 0.05 * float(((p - y) * raw).mean()), b - 0.05 * float((p - y).mean())
    p, threshold = 1 / (1 + np.exp(-(a * raw + b))), {}
    for name in KINDS:
        q, t = p[kind == name], y[kind == name]
        order = np.argsort(-q)
        good = np.flatnonzero(np.cumsum(t[order]) / np.arange(1, len(t) + 1) >= precision) if len(t) else []
        threshold[name] = max(0.5, float(q[order][good[-1]])) if len(good) else 1.1
    return Detector(trees, (a, b), threshold)


def _text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Per document: counts of base spans by kind, their digest, and all spans."""
    tune(documents.sparkSession)
    d = detector or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [d.spans(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for k, _, _ in sure) for sure, _ in both], pa.int64()) for kind in BASE]
            digest = [hashlib.sha256(_text(sure).encode()).hexdigest() for sure, _ in both]
            yield pa.record_batch([batch.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([_text(s) for _, s in both], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return ids_and_texts(documents).mapInArrow(run, COLUMNS)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans as one."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The documents with spans replaced in ``text``; all columns stay."""
    tune(documents.sparkSession)
    d = detector or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                at = part.schema.get_field_index("text")
                out = []
                for t in part.column("text").to_pylist():
                    spans = d.spans(t)[1] if t else []
                    out.append(redact(t, spans) if spans else t)
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)
