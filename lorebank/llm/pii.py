"""Personal data by candidate generation and gradient boosting.

Fixed patterns give the base spans. Generators of high recall propose further, overlapping candidates: written-out mail
addresses, national and bare phone numbers, defanged or ported addresses, grouped card numbers, and phone and card
numbers that stand side by side, so that the fixed patterns run through both and drop them. Boosted trees score each by
its format and the words around it; those above the calibrated threshold of their kind that overlap no base span and no
longer such candidate are redacted as well.

The trees are trained here, on generated sentences and on a bounded sample of texts: base spans, written another way,
stand in their own surroundings for personal data, and candidates away from every match of the fixed patterns for what
is none. The thresholds are set on examples that the trees were not fitted to.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import least_hashed

#: Texts with a digit or an at sign that examples are taken from, and examples of each kind, of personal data and of none, at most.
TEXTS, EXAMPLES = 2000, 400
#: Share of personal data among the held-out candidates above a threshold, and the least threshold.
PRECISE, FLOOR = 0.97, 0.8
#: Code points before and after a span that its features read.
BEFORE, AFTER = 40, 12

# The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    start: int
    end: int
    kind: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind. Each kind is scanned once, in linear time."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append(Span(start, end, 0))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append(Span(m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append(Span(m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append(Span(m.start(), m.end(), 3))
    found.sort(key=lambda s: (s.start, s.kind))
    return found


#: Kind, pattern, and strings of which a text needs one. The bounds are those of the formats: a local part has up to 64
#: letters, a label of a domain up to 63, a number with its signs up to about 20; what is longer is not proposed.
_GENERATORS = (
    (0, re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|＠)\s?[A-Za-z0-9-]{1,63}(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s|\.)[A-Za-z0-9-]{2,63}){1,4}", re.I), ("(at", "[at", "{at", "＠")),
    (0, re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}\sat\s[A-Za-z0-9-]{1,63}(?:\sdot\s[A-Za-z0-9-]{2,63}){1,4}", re.I), (" dot ",)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\])\s?[0-9]{1,3}){3}(?![0-9])", re.I), ("[.]", "(.)", "[dot]")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[.\x20_/-][0-9]{4}){3}(?![0-9])"), ()),
    (2, re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])"), ()),
    (3, re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"), ("+",)),
    (3, re.compile(r"(?<![\w+.])(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![\w])"), ()),
    (3, re.compile(r"(?<![\w+.])0[0-9]{2,4}[\x20/-][0-9]{5,8}(?![\w])"), ()),
    (3, re.compile(r"(?<![\w+.-])[0-9]{10,11}(?![\w-])"), ()),
    (3, re.compile(r"(?<![\w+.])00[1-9][0-9\x20().-]{7,18}[0-9](?![\w])"), ()),
)
#: Words near a candidate that speak for its kind, or for something else.
_NEAR = (
    ("mail", "email", "contact", "write", "reach", "correo", "courriel"),
    ("ip", "host", "server", "address", "client", "addr"),
    ("card", "visa", "credit", "pay", "tarjeta", "carte", "karte"),
    ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "whatsapp", "sms"),
    ("order", "invoice", "isbn", "version", "page", "date", "build", "serial", "part", "article", "ref", "score", "born"),
)
_WORD = re.compile(r"[a-z]+")


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    found = []
    digit = _DIGIT.search(text) is not None
    low = text.lower() if "t" in text or "T" in text or "[" in text or "(" in text or "＠" in text else text
    for kind, pattern, needs in _GENERATORS:
        if (needs and not any(x in low for x in needs)) or (kind and not digit):
            continue
        found += [Span(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return found


def features(text: str, s: Span) -> list[float]:
    """Format and context of a candidate."""
    body, before, after = text[s.start : s.end], text[max(0, s.start - BEFORE) : s.start].lower(), text[s.end : s.end + AFTER].lower()
    digits = _digits(body)
    groups = re.split(r"[^0-9]+", body.strip("()"))
    near = _WORD.findall(before)[-5:]
    signs = {c for c in body if not c.isalnum()}
    marked = any(x in body.lower() for x in ("(at", "[at", "{at", "＠", "[dot", "(dot", "{dot", "[.]", "(.)"))
    return [
        *(float(s.kind == k) for k in range(4)),
        len(body), len(digits), len(groups), max(map(len, groups)), min(map(len, groups)), len(signs),
        float(marked), float(" dot " in body.lower()), float("(" in body), float("/" in signs), float("." in signs), float("-" in signs),
        float(bool(digits) and 12 <= len(digits) <= 19 and luhn(digits)), float(len(set(digits)) <= 2),
        float(body.startswith("0")), float(body.startswith("00")), float(body.startswith("+")), float(all(0 <= int(g) <= 255 for g in groups if g and len(g) < 5) and len(groups) == 4),
        float(bool(re.match(r"(?:19|20)[0-9]{2}\b|[0-3]?[0-9][./-][01]?[0-9][./-]", body))),
        *(float(any(w in near for w in words)) for words in _NEAR),
        float(before.rstrip()[-1:] in ":="), float(before[-1:].isalnum()), float(after[:1].isalnum() or after[:2].strip()[:1] in "%$€"),
    ]


class Trees:
    """Gradient boosting of shallow regression trees for the logistic loss."""

    def __init__(self, rounds: int = 100, depth: int = 3, rate: float = 0.25, least: int = 8):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[Any] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = y.mean()
        self.bias = float(np.log(p / (1 - p)))
        cuts = [(np.unique(c)[:-1] + np.unique(c)[1:]) / 2 for c in x.T]
        cuts = [c if len(c) <= 16 else np.quantile(c, np.linspace(0, 1, 16)) for c in cuts]
        total = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-total))
            tree = self._grow(x, y - q, q * (1 - q), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            total += self._apply(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        leaf = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        if not depth or len(rows) < 2 * self.least:
            return leaf
        best, split, whole = 1e-3, None, g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f, values in enumerate(cuts):
            for c in values:
                left = x[rows, f] <= c
                k = int(left.sum())
                if min(k, len(rows) - k) < self.least:
                    continue
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - whole
                if gain > best:
                    best, split = gain, (f, float(c), left)
        if split is None:
            return leaf
        f, c, left = split
        return f, c, self._grow(x, g, h, cuts, rows[left], depth - 1), self._grow(x, g, h, cuts, rows[~left], depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, c, low, high = tree
        return np.where(x[:, f] <= c, self._apply(low, x), self._apply(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for t in self.trees:
            total += self._apply(t, x)
        return 1 / (1 + np.exp(-total))


def _examples(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Generated sentences, with the places of personal data in them."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("ba", "ri", "lo", "ten", "us", "mar", "vi", "ko")) for _ in range(r.randint(1, 3)))
    octet = lambda: str(r.randint(0, 255))

    def card(parts: tuple[str, ...] = (".", "_", "/")) -> str:
        s = r.choice("45") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        return r.choice(parts).join(s[i : i + 4] for i in range(0, 16, 4))

    def serial(n: int) -> str:
        """Digits that are no card number: those that pass by chance are redacted anyway, as the base pattern does."""
        s = d(n - 1)
        return s + r.choice([c for c in "0123456789" if not luhn(s + c)])

    def grouped(sign: str) -> str:
        s = serial(16)
        return sign.join(s[i : i + 4] for i in range(0, 16, 4))

    good = (
        lambda: (r.choice(("mail", "write to", "contact", "email:", "")), r.choice((f"{word()} at {word()} dot com", f"{word()}.{d(2)} (at) {word()} (dot) org", f"{word()}[at]{word()}.net", f"{word()} [at] {word()} [dot] de"))),
        lambda: (r.choice(("host", "client", "server ip", "")), r.choice(("[.]", "(.)", " [dot] ")).join(octet() for _ in range(4))),
        lambda: (r.choice(("card", "visa", "pay with", "")), card()),
        lambda: (r.choice(("phone", "call", "tel:", "mobile", "fax")), r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0049 {d(3)} {d(7)}", f"({d(3)}) {d(3)} {d(4)}", f"0{d(3)}/{d(7)}", f"0{d(2)} {d(8)}"))),
        lambda: (r.choice(("call", "call me at", "phone", "tel:", "mobile", "whatsapp", "fax")), d(r.choice((10, 11)))),
        lambda: (r.choice(("phone", "call", "card", "")), r.sample((r.choice((f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}")), card(("", " ", "-"))), 2)),
        lambda: (r.choice(("phone", "call", "host", "")), [f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", ".".join(octet() for _ in range(4))]),
    )
    bad = (
        lambda: (r.choice(("we met", "she was", "it stood", "look")), r.choice((f"{word()} at {word()}. {word()}", f"{word()} at {word()}. The {word()}"))),
        lambda: (r.choice(("order", "invoice", "serial", "part", "isbn", "")), r.choice((f"{d(3)}-{d(2)}-{d(4)}-{d(2)}", grouped("-"), grouped("."), f"{d(3)} {d(3)} {d(3)}", serial(r.randint(13, 19)), d(10), d(11), f"0{d(3)}-{d(5)}", f"{d(3)}-{d(4)} {serial(r.randint(13, 19))}"))),
        lambda: (r.choice(("", "id", "number", "ref", "count", "about")), d(r.choice((10, 11)))),
        lambda: (r.choice(("on", "date", "born", "since", "")), r.choice((f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.0{r.randint(1, 9)}.19{d(2)}", f"0{r.randint(1, 9)}/{r.randint(10, 28)}/20{d(2)}"))),
        lambda: (r.choice(("version", "build", "page", "score")), r.choice((f"{d(3)}.{d(2)}.{d(3)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(3)}", f"{d(3)} {d(2)} {d(2)}"))),
        lambda: (r.choice(("", "total", "about")), r.choice((f"{d(3)} {d(3)} {d(3)} %", f"{d(3)}.{d(3)}.{d(3)} $", f"{d(3)} - {d(3)} - {d(3)}"))),
    )
    for _ in range(n):
        right = r.random() < 0.5
        before, body = r.choice(good if right else bad)()
        text, truth = f"{word()} {word()} {before} ".replace("  ", " "), []
        for part in [body] if isinstance(body, str) else body:
            truth.append((len(text), len(text) + len(part)))
            text += part + " "
        yield f"{text[:-1]}, {word()} {word()}.", truth if right else []


class Examples:
    """Features, truth and kind of candidates in texts with known places of personal data."""

    def __init__(self):
        self.x: list[list[float]] = []
        self.y: list[float] = []
        self.kind: list[int] = []

    def add(self, text: str, truth: list[tuple[int, int]]) -> None:
        for s in candidates(text):
            self.x.append(features(text, s))
            self.y.append(float(any(a <= s.start and s.end <= b and s.end - s.start >= 0.7 * (b - a) for a, b in truth)))
            self.kind.append(s.kind)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.x), np.array(self.y), np.array(self.kind)


def written_otherwise(kind: int, body: str, r: random.Random) -> str | None:
    """A base span in a form that the fixed patterns do not know; None if it has none."""
    digits = _digits(body)
    if kind == 0:
        name, _, domain = body.partition("@")
        labels = domain.split(".")
        return r.choice((f"{name} at {' dot '.join(labels)}", f"{name} (at) {' (dot) '.join(labels)}", f"{name}[at]{domain}", f"{name} [at] {' [dot] '.join(labels)}"))
    if kind == 1:
        return r.choice(("[.]", "(.)", " [dot] ")).join(body.split("."))
    if kind == 2:
        return r.choice("._/").join(digits[i : i + 4] for i in range(0, 16, 4)) if len(digits) == 16 else None
    if len(digits) < 10:
        return None
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a[1:]} {b} {c}", f"0{a}/{b}{c}", f"0049 {a} {b}{c}", f"({a}) {b} {c}"))


def _loose(text: str) -> list[tuple[int, int]]:
    """Whatever the fixed patterns match before their numbers are checked, and the base spans."""
    found = [m.span() for pattern in (_IP, _CARD, _PHONE) for m in pattern.finditer(text)]
    return found + [(s.start, s.end) for s in base_spans(text)]


def surroundings(text: str) -> Iterator[tuple[int, bool, str, str, str]]:
    """(kind, personal, before, body, after) of the base spans, and of candidates away from everything that the fixed patterns match."""
    around = lambda a, b: (text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER])
    for s in base_spans(text):
        yield s.kind, True, *around(s.start, s.end)
    taken = Covered(_loose(text))
    for s in candidates(text):
        if not taken.meets(s.start, s.end):
            yield s.kind, False, *around(s.start, s.end)


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "personal", "before", "body", "after"]
    for batch in batches:
        for text in batch.column(0):
            rows = list(surroundings(text.as_py()))
            if rows:
                yield pa.record_batch([pa.array(list(c)) for c in zip(*rows, strict=True)], names)


def trained(found: tuple[tuple[int, bool, str, str, str], ...] = ()) -> tuple[Trees, tuple[float, ...]]:
    """Trees, and for each kind the least threshold at which held-out candidates are personal data in PRECISE of all cases.

    They are fitted on generated sentences and on every second of the surroundings ``found``, the others set the thresholds.
    """
    r = random.Random(7)
    parts = Examples(), Examples()
    for part, seed in zip(parts, (1, 2), strict=True):
        for text, truth in _examples(2400, seed):
            part.add(text, truth)
    for i, (kind, personal, before, body, after) in enumerate(found):
        for _ in range(2 if personal else 1):
            other, beside = written_otherwise(kind, body, r) if personal else body, ""
            if kind == 3 and personal and r.random() < 0.3:  # side by side with another number
                other, beside = body, " " + r.choice((".".join(str(r.randint(0, 255)) for _ in range(4)), str(r.randint(10**15, 10**16))))
            if other:
                span = [(len(before), len(before) + len(other))] if personal else []
                parts[i % 2].add(f"{before}{other}{beside}{after}", span)
    x, y, _ = parts[0].arrays()
    trees = Trees().fit(x, y)
    x, y, k = parts[1].arrays()
    p = trees.predict(x)
    limits = []
    for kind in range(4):
        some = k == kind
        fit = [c for c in np.arange(0.5, 1.0, 0.01) if (p[some] >= c).any() and y[some][p[some] >= c].mean() >= PRECISE]
        limits.append(float(max(FLOOR, min(fit, default=1.01))))
    return trees, tuple(limits)


@lru_cache(maxsize=1)
def plain() -> tuple[Trees, tuple[float, ...]]:
    """The model of generated sentences alone."""
    return trained()


def train(docs: DataFrame) -> tuple[Trees, tuple[float, ...]]:
    """The model with examples from ``docs`` (text): of the TEXTS different texts with a digit or an at sign that have the
    least hashes, EXAMPLES of each kind, of personal data and of none, so that every run learns the same. Without any such
    text it is plain()."""
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.lit(0).alias("one"), F.xxhash64(text).alias("hash")).where(F.col("text").rlike("[0-9@]"))
    some = least_hashed(rows, "one", "hash", TEXTS, 1).select("text").mapInArrow(_example_rows, "kind long, personal boolean, before string, body string, after string")
    some = some.withColumns({"class": F.concat_ws("-", "kind", "personal"), "hash": F.xxhash64("kind", "before", "body", "after")})
    found = sorted(tuple(r) for r in least_hashed(some, "class", "hash", EXAMPLES, 2 * len(KINDS)).select("kind", "personal", "before", "body", "after").collect())
    if not found:
        return plain()
    random.Random(3).shuffle(found)
    return trained(tuple(found))


class Covered:
    """Intervals as the union of some, in order; a query takes the logarithm of their number."""

    def __init__(self, intervals: list[tuple[int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for a, b in sorted(intervals):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.end, a)
        return i < len(self.start) and self.start[i] < b

    def add(self, a: int, b: int) -> None:
        """Adds an interval that meets none."""
        i = bisect_left(self.start, a)
        self.start.insert(i, a)
        self.end.insert(i, b)


def all_spans(texts: list[str], model: tuple[Trees, tuple[float, ...]]) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans by start, then kind."""
    trees, limits = model
    base, proposals, x = [], [], []
    for i, text in enumerate(texts):
        base.append(base_spans(text))
        taken = Covered([(b.start, b.end) for b in base[-1]])
        for s in candidates(text):
            if not taken.meets(s.start, s.end):
                proposals.append((i, s))
                x.append(features(text, s))
    more: dict[int, tuple[Covered, list[Span]]] = {}
    if x:
        p = trees.predict(np.array(x))
        for j in np.lexsort((-p, [s.start - s.end for _, s in proposals])).tolist():
            i, s = proposals[j]
            if p[j] < limits[s.kind]:
                continue
            taken, spans = more.setdefault(i, (Covered([]), []))
            if not taken.meets(s.start, s.end):
                taken.add(s.start, s.end)
                spans.append(s)
    for i, b in enumerate(base):
        yield b, sorted([*b, *more[i][1]], key=lambda s: (s.start, s.kind)) if i in more else b


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{KINDS[s.kind]}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _rows(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("__text")]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            n, base, every, clean = np.zeros((4, len(texts)), np.int64), [], [], []
            for i, (b, s) in enumerate(all_spans(texts, shipped.value)):
                for x in b:
                    n[x.kind, i] += 1
                base.append(joined(b))
                every.append(joined(s))
                clean.append(redacted(texts[i], s) if s else texts[i])
            valid = batch.column("__text").is_valid()
            text = pa.array(clean, pa.string())
            out = [batch.column(i) for i in keep] + [pa.array(x) for x in n] + [pa.array(base, pa.string()), pa.array(every, pa.string()), text, valid]
            yield pa.RecordBatch.from_arrays(out, names=[*[batch.schema.names[i] for i in keep], *(f"n_{k}" for k in KINDS), "base", "spans", "redacted", "__valid"])

    return run


def find(docs: DataFrame, keep: tuple[str | Column, ...] = ("doc_id",), model: tuple[Trees, tuple[float, ...]] | None = None) -> DataFrame:
    """The columns ``keep`` of each row of ``docs``, with n_email, n_ip, n_card, n_phone, base, spans and redacted.

    base and spans are kind:start:end lists, comma-joined by start, then kind, in code points; spans holds the base ones
    and those that the trees of ``model`` (by default plain()) add: of overlapping candidates the longest, of equally long
    ones the likeliest, then the first proposed. redacted is the text with every span replaced; it is null for a null
    text, which otherwise counts as empty. Texts are read whole however long. Rows are kept as they are, repeated or not;
    an empty table gives none. The trees, of a fixed size, are sent to the executors.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or plain())
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    found = rows.mapInArrow(_rows(shipped), f"{kinds}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string, __valid boolean")
    return found.withColumn("redacted", F.when(F.col("__valid"), F.col("redacted"))).drop("__valid")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
