r"""Personal data: candidates from generators, selected by boosted trees.

Base spans (email, ip, card, phone, as the patterns below with their checks)
always count. High-recall generators propose further spans, which may overlap:
spelt-out emails, spaced or bracketed numbers, national phone numbers, cards
that a separator splits unusually, addresses of IPv6, social security and bank
account numbers, secrets behind a key word. Gradient-boosted trees on format
and context features give each candidate a score; scores are calibrated on a
split of their own, and a threshold for each kind, the least at which the
precision there reaches PRECISION, selects. Of overlapping spans those of the
base stay, then the best score wins.

There are no labels for spans in the tables, so the trees learn from generated
examples: formats of personal data and look-alikes (versions, dates, prices,
order numbers, measures) with words around them. They are trained in
a second and depend on a seed only.

Base patterns, leftmost, not overlapping within a kind:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``;
ip ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, parts at most 255;
card ``[0-9]([\x20-]?[0-9])+``, 13 to 19 digits that pass Luhn;
phone ``\+[0-9][\x20().0-9-]+[0-9]``, 9 to 15 digits. Failing matches are
dropped without another try.

Defined results: null and empty texts have no spans. Repeated rows and ids each
return a row, a null id too. Offsets are code points, end exclusive. Extra
columns are ignored (``redact`` keeps them); an empty table returns no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read_table, to_batch

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = KINDS[:4]
PRECISION = 0.98
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits does and takes its runs whole, so no run is tried again from within
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind as listed, then start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        # a match that begins in the run before the sign takes the whole run, and fails everywhere in it or nowhere
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


#: kind, whether every match has a digit, pattern. Texts without a digit skip those; the others are run on every text.
_DIGITS, _ANY = True, False
GENERATORS: list[tuple[int, str, re.Pattern]] = [
    (0, _ANY, re.compile(r"(?i)(?<![\w.])[a-z0-9][a-z0-9._%+-]{0,63}\s?(?:@|[(\[{]\s?at\s?[)\]}]|\sat\s)\s?[a-z0-9-]{1,63}(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|\sdot\s)\s?[a-z0-9-]{2,63}){1,4}")),
    (1, _DIGITS, re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?(?:\.|[(\[]\.[)\]]|[(\[]dot[)\]])\s?[0-9]{1,3}){3}(?![\w.])")),
    (1, _ANY, re.compile(r"(?i)(?<![\w:])(?:[0-9a-f]{1,4}:){3,7}:?[0-9a-f]{1,4}(?![\w:])")),
    (2, _DIGITS, re.compile(r"(?<![\w])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![\w])")),
    (3, _DIGITS, re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)[ -]?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{2,5}(?:[ .-][0-9]{2,4})?(?![\w-])")),
    (3, _DIGITS, re.compile(r"(?<![\w+])00[1-9][0-9 ()./-]{7,18}[0-9](?!\w)")),
    (4, _DIGITS, re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")),
    (5, _DIGITS, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    (6, _ANY, re.compile(r"(?i)(?<=password)\s?[=:]\s?\"?'?[^\s\"']{6,80}|(?<=passwd)\s?[=:]\s?\"?'?[^\s\"']{6,80}|(?<=token)\s?[=:]\s?\"?'?[^\s\"']{12,200}|(?<=secret)\s?[=:]\s?\"?'?[^\s\"']{8,200}|(?<=api_key)\s?[=:]\s?\"?'?[^\s\"']{12,200}|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")),
]
_ASSIGN = re.compile(r"^\s?[=:]\s?[\"']?")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, overlaps included."""
    out = set()
    digits = _DIGIT.search(text) is not None
    for kind, needs_digit, pattern in GENERATORS:
        if digits or not needs_digit:
            for m in pattern.finditer(text):
                start = m.start()
                if kind == 6 and (skip := _ASSIGN.match(m.group())):
                    start += skip.end()
                if start < m.end():
                    out.add((kind, start, m.end()))
    return sorted(out)


_HINTS = [re.compile(p, re.I) for p in (r"mail|e-mail|contact|write", r"\bip\b|host|server|address|client", r"card|visa|credit|pay|iban", r"phone|tel|call|fax|mobile|cell", r"ssn|social|security", r"iban|account|bank", r"password|passwd|secret|token|key", r"version|v\.|release|build|section|order|invoice|ref|isbn|price|total|date|page|no\.")]


_TLD = re.compile(r"(?i)(?:\.|dot\W*)\s?(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at)$")


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, lo, hi = span
    s, before, after = text[lo:hi], text[max(0, lo - 24) : lo], text[hi : hi + 12]
    digits = _NOT_DIGIT.sub("", s)
    groups = re.findall(r"[0-9]+", s)
    parts = [int(g) for g in groups if len(g) <= 3]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(s), len(digits), sum(c.isalpha() for c in s), s.count(" "), s.count("."), s.count("-"), s.count("/") + s.count("_"), s.count("(") + s.count("["), s.count("@"), s.count(":"),
        len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float(bool(digits) and 12 < len(digits) < 20 and luhn(digits)), float(len(parts) >= 4 and max(parts) < 256), float(bool(re.search(r"[A-Z]", s)) and bool(re.search(r"[a-z0-9]", s))),
        float(digits[:1] == "0"), len(set(s.lower())) / max(1, len(s)), float(bool(re.search(r"(?i)(\.|dot\W*)\s?[a-z]{2,6}$", s))),
        float(_TLD.search(s) is not None), float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(before[-1:].isdigit() or after[:1].isdigit()), float(before[-1:] in "$€£#"), float(after[:1] in "%€°"),
        *(float(h.search(before) is not None) for h in _HINTS),
    ]


# -- boosted trees -----------------------------------------------------------


@dataclass
class Tree:
    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        f, c, lo, hi, v = map(np.array, (self.feature, self.cut, self.left, self.right, self.value))
        while (inner := f[node] >= 0).any():
            k = np.flatnonzero(inner)
            n = node[k]
            node[k] = np.where(x[k, f[n]] <= c[n], lo[n], hi[n])
        return v[node]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    t = Tree([], [], [], [], [])

    def add(rows: np.ndarray, left: int) -> int:
        k = len(t.feature)
        for field, value in zip((t.feature, t.cut, t.left, t.right, t.value), (-1, 0.0, -1, -1, -g[rows].sum() / (h[rows].sum() + 1.0)), strict=True):
            field.append(value)
        best = (1e-6, -1, 0.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        if left and len(rows) >= 20:
            for j in range(x.shape[1]):
                order = np.argsort(x[rows, j], kind="stable")
                v = x[rows[order], j]
                at = np.flatnonzero(np.diff(v) > 0)
                at = at[(at >= 4) & (at < len(v) - 5)]
                if not len(at):
                    continue
                gl, hl = np.cumsum(g[rows[order]])[at], np.cumsum(h[rows[order]])[at]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), j, float(v[at[b]] + v[at[b] + 1]) / 2)
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            t.feature[k], t.cut[k] = best[1], best[2]
            t.left[k] = add(rows[go], left - 1)
            t.right[k] = add(rows[~go], left - 1)
        return k

    add(np.arange(len(x)), depth)
    return t


@dataclass
class Selector:
    """Boosted trees, a calibration, and a threshold for each kind."""

    trees: list[Tree]
    bias: float
    rate: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (0.5,) * len(KINDS)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.raw(x) + b)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2) -> Selector:
    share = y.mean()
    s = Selector([], float(np.log(share / (1 - share))), rate)
    raw = np.full(len(y), s.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        t = _grow(x, p - y, p * (1 - p), depth)
        s.trees.append(t)
        raw += rate * t.predict(x)
    return s


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of generated candidates."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda a=2, b=9: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(a, b)))
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu"])

    def card(sep: str) -> str:
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def bad_card(sep: str) -> str:
        body = d(16)
        while luhn(body):
            body = d(16)
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    dot = lambda: r.choice([" dot ", "[dot]", " (dot) ", "."])
    good = [
        lambda: (r.choice(["mail ", "contact ", "", "write to "]), f"{w()}{r.choice(['.', '_', ''])}{w()}{r.choice([' at ', ' (at) ', '[at]', ' [at] '])}{w(3)}{dot()}{tld()}"),
        lambda: (r.choice(["ip ", "host ", "", "client "]), r.choice([" . ", "[.]", "[dot]"]).join(str(r.randint(1, 255)) for _ in range(4))),
        lambda: ("", ":".join(f"{r.randint(256, 65535):x}" for _ in range(8))),
        lambda: (r.choice(["card ", "visa ", "", "pay with "]), card(r.choice([".", "/", "_", "--", "- "]))),
        lambda: (r.choice(["phone ", "tel ", "call ", "mobile: "]), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)}{d(3)}", f"{d(3)}.{d(3)}.{d(4)}"])),
        lambda: ("", f"({r.choice('23456789')}{d(2)}) {d(3)}-{d(4)}"),
        lambda: (r.choice(["tel ", "call ", ""]), f"00{r.choice('134')}{d(1)} {d(3)} {d(3)} {d(3)}"),
        lambda: (r.choice(["ssn ", "social security ", "SSN: "]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(["iban ", "account ", ""]), r.choice(["DE", "FR", "ES"]) + d(2) + " " + " ".join(d(4) for _ in range(r.randint(4, 5)))),
        lambda: ("password=", r.choice([w(8, 12) + d(3), d(3) + w(6) + d(4), "".join(r.choice("0123456789abcdef") for _ in range(18))])),
        lambda: (r.choice(["token = \"", "secret: "]), "".join(r.choice("0123456789abcdef") for _ in range(r.randint(20, 40)))),
        lambda: ("", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
    ]
    bad = [
        lambda: ("", f"{w()} at {w(3)}. {w(3)}"),
        lambda: (r.choice(["look ", "was ", ""]), f"{w()} at {w()} dot {w(5)}"),
        lambda: (r.choice(["version ", "section ", "build ", "v. "]), ".".join(str(r.randint(0, 400)) for _ in range(4))),
        lambda: (r.choice(["order ", "ref ", "invoice ", "no. "]), bad_card(r.choice([".", "/", "_", "- ", "-"]))),
        lambda: (r.choice(["total ", "isbn ", "order ", "page ", ""]), r.choice([f"{d(3)}-{d(3)}-{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(2)}"])),
        lambda: (r.choice(["order no. ", "ref ", "date "]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(["ref ", "order "]), f"00{r.choice('123')}{d(9)}"),
        lambda: ("ref ", "AB" + d(2) + d(4) + d(4) + d(4)),
        lambda: (r.choice(["password: ", "token: ", "secret: "]), r.choice(["needed", "required", "forgotten", "whatever", "certificates"])),
        lambda: ("", ":".join(f"{r.randint(0, 59):02d}" for _ in range(4))),
    ]
    x, y, kinds = [], [], []
    for k in range(n):
        label = k % 2
        lead, core = r.choice(good if label else bad)()
        text = f"{w()} {w()} {lead}{core} {w()} {w()}"
        at = text.index(core, len(text) - len(core) - 30 if len(text) > len(core) + 40 else 0)
        for span in candidates(text):
            if span[1] < at + len(core) and span[2] > at:
                full = span[1] <= at + 1 and span[2] >= at + len(core) - 1
                x.append(features(text, span))
                y.append(float(label and full))
                kinds.append(span[0])
    return np.array(x), np.array(y), np.array(kinds)


def train(n: int = 3000, seed: int = 11) -> Selector:
    """Trees on one set of examples, calibration and thresholds on another."""
    x, y, _ = _examples(n, seed)
    s = boost(x, y)
    x, y, kinds = _examples(n, seed + 1)
    raw, a, b = s.raw(x), 1.0, 0.0
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-(a * raw + b)))
        a -= 0.05 * float(((p - y) * raw).mean())
        b -= 0.05 * float((p - y).mean())
    s.scale = (a, b)
    p, cuts = s.scores(x), []
    for k in range(len(KINDS)):
        own = np.flatnonzero(kinds == k)
        order = own[np.argsort(-p[own])]
        precise = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(precise >= PRECISION)
        cuts.append(max(0.5, float(p[order[ok[-1]]])) if len(ok) else 1.1)
    s.thresholds = tuple(cuts)
    return s


def spans(text: str, selector: Selector) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind, then start."""
    base = base_spans(text)
    found = [c for c in candidates(text) if not any(c[1] < e and s < c[2] for _, s, e in base)]
    if not found:
        return base, base
    p = selector.scores(np.array([features(text, c) for c in found]))
    chosen: list[Span] = []
    for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k])):
        c = found[k]
        if p[k] >= selector.thresholds[c[0]] and not any(c[1] < e and s < c[2] for _, s, e in chosen):
            chosen.append(c)
    return base, sorted([*base, *chosen])


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))


_SPANS = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])
_DDL = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, selector: Selector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts and hash of base spans, all spans, of each row."""
    selector = selector or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, every = spans(t or "", selector)
                counts = [sum(k == j for j, _, _ in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield to_batch(_SPANS, [b.column(0), *zip(*rows, strict=True)])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, _DDL)


def redacted(text: str, found: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, lo, hi in sorted(found, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], f"[{KINDS[kind].upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """The rows of ``docs``, whole, with spans of ``text`` replaced; a null text stays null."""
    selector = selector or train()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redacted(t, spans(t, selector)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return map_arrow(docs, run, docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
