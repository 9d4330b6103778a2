"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Words that look disguised (leet signs among letters, letters repeated three
times or more, letters set apart by spaces or points) become a lattice of
characters: a sign stands for the letters it imitates, a repeated letter may be
dropped, a separator vanishes. Viterbi decoding, exact, under a character
language model of order ORDER picks the likeliest word. The model counts the
words of all documents, which need no labels; its counts are in a table of
2**GRAM_BITS places by a hash of the n-gram, so its size is fixed, and n-grams
that share a place add up. Tokens of any length are decoded,
in time linear in it. In a run of three or more single characters each space may
vanish or be a word boundary; every word that the decoded run gives is looked
up, as decoded and as spelt. Plain words have a lattice of one path and are taken as
they stand.

A document is scored from its restored words: words and word beginnings have a
lower bound of their log odds of toxic against clean documents, learnt from
labels; a logistic unit weighs the two largest, and how many there are.

Lexicon and unit are fitted on at most SAMPLE labelled documents for each
label, chosen by a hash of the id; a training document's own count is left out
when its features are computed. The lexicon is every unit of those documents
with a bound above zero, which takes six toxic documents at least, so it has at
most a sixth of the units of SAMPLE documents. Scores use whole texts of any length.

Defined results: a null or empty text has no word and gets the score that this
implies. Repeated rows and ids are each scored; contradicting labels count as
0, labels without a document and null labels are ignored. With labels of one
kind the score is their share, with none 0; ``clean`` then rejects none. Extra columns are ignored (``clean`` keeps
them); an empty table returns no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import map_arrow, mix64, read_table, remainder, to_batch
from .mil_quality import sample_labels

SAMPLE = 4000
ORDER = 4
GRAM_BITS = 21
#: The table of counts is summed in so many parts.
PARTS = 16
PREFIXES = (3, 4, 5, 6, 7)

IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou"}
SEPARATORS = ".-_~'*/\\,"
_LETTERS = re.compile(r"[^\W\d_]+")
_LEET = re.compile(r"[013456789@$!|+€(£¡*#]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"(?:[^\s][.\-_~*/\\,]){2,}[^\s]")
_WIDE = re.compile(r"(?:[^\s.\-_~*/\\,][.\-_~*/\\,]+){2,}[^\s.\-_~*/\\,]")
_RUN = re.compile(r"(.)\1+")
_LONG = re.compile(r"(.)\1{3,}")
_EDGE = ".,;:?!\"'()[]{}<>|&%*#$+-_/\\~“”‘’…"
_PLAIN = ".,;:?!\"'"
_LEAD = "".join(c for c in _EDGE if c not in "$+(")


_EDGE_CODES = np.array([ord("^"), ord("$")], np.uint64)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER[ord("a")]:
        _LETTER[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


class CharacterModel:
    """Interpolated character n-gram model with counts in a table by hash."""

    def __init__(self, table: np.ndarray):
        self.table, self.memo = table, {}
        self.shift = 64 - (len(table).bit_length() - 1)

    def place(self, codes: list[int]) -> int:
        """Where an n-gram (its length, its code points) is counted; as count_grams has it."""
        v = 0
        for c in (len(codes), *codes):
            v = v * int(_TIMES) + c & (1 << 64) - 1
        return int(mix64(np.array([v], np.uint64))[0]) >> self.shift

    def cost(self, history: str, letter: str) -> float:
        """-log P(letter | history); histories start with ``^``, words end with ``$``.

        What follows a history is as often as the history itself is there.
        """
        key = history + letter
        if (c := self.memo.get(key)) is None:
            p, codes = 1 / 64, [*map(ord, key)]
            for k in range(min(len(history), ORDER - 1) + 1):
                own = codes[len(history) - k :]
                total = float(self.table[self.place(own[:-1])])
                p = (min(float(self.table[self.place(own)]), total) + 2 * p) / (total + 2)
            if len(self.memo) > 200_000:
                self.memo.clear()
            c = self.memo[key] = -math.log(p)
        return c

    def __getstate__(self):
        return {"table": self.table, "memo": {}, "shift": self.shift}


def count_grams(words: dict[str, int], table: np.ndarray) -> None:
    """Add the n-grams of the words' letter runs, each between ``^`` and ``$``, and their histories, to ``table``."""
    if not words:
        return
    text = "\n" + "\n".join(words) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(codes == 10) - 1
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    # of what is no letter, one place before a run is its beginning, and one behind it its end
    begins, ends = ~letter[:-1] & letter[1:], letter[:-1] & ~letter[1:]
    n = np.fromiter(words.values(), np.int64, len(words))
    run = np.cumsum(letter & ~np.concatenate(([False], letter[:-1])))
    at = np.concatenate((np.flatnonzero(begins) * 3 + 2, np.flatnonzero(letter) * 3 + 1, np.flatnonzero(ends) * 3 + 3))
    value = np.concatenate((np.full(begins.sum(), _EDGE_CODES[0]), codes[letter].astype(np.uint64), np.full(ends.sum(), _EDGE_CODES[1])))
    own = np.concatenate((run[1:][begins], run[letter], run[:-1][ends]))
    weight = np.concatenate((n[np.minimum(word[1:][begins], len(n) - 1)], n[word[letter]], n[word[:-1][ends]])).astype(float)
    order = np.argsort(at, kind="stable")
    value, own, weight = value[order], own[order], weight[order]
    shift = np.uint64(64 - (len(table).bit_length() - 1))
    first = np.concatenate(([True], own[1:] != own[:-1]))
    place = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    table[_place(np.zeros(1, np.uint64), shift)] += weight[~first].sum()  # the empty history
    v = value
    for n in range(1, ORDER + 1):
        # v: the last n - 1 values behind each place, and its own; ``^`` alone is a history only
        at = place >= n - 1
        table += np.bincount(_place(_head(n) + v[at], shift), weight[at], len(table))
        if n < ORDER:
            v = value + np.concatenate((np.zeros(1, np.uint64), v[:-1])) * _TIMES


def _head(n: int) -> np.uint64:
    """What an n-gram's length adds to its hash."""
    v = n
    for _ in range(n):
        v = v * int(_TIMES) & (1 << 64) - 1
    return np.uint64(v)


def _place(h: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (mix64(h) >> shift).astype(np.int64)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character, what it may stand for and at what cost."""
    out = []
    for i, c in enumerate(token):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
            if i and token[i - 1] == c:
                options.append(("", 0.2))
        else:
            if i and token[i - 1] == c:
                options.append(("", 0.5))
            options += [(x, 0.3 if len(IMITATES[c]) < 3 else 1.0) for x in IMITATES.get(c, "")]
            if c in SEPARATORS:
                options.append(("", 0.5))
            if not options or c.isdigit():
                options.append(("", 6.0))
        out.append(options)
    return out


def _likeliest(options_of: list[list[tuple[str, float]]], model: CharacterModel) -> list[str]:
    """What each place of a lattice stands for: Viterbi over all states, a state being the last letters."""
    states: dict[str, tuple[float, tuple | None]] = {"^": (0.0, None)}
    for options in options_of:
        new: dict[str, tuple[float, tuple | None]] = {}
        for history, (cost, path) in states.items():
            for letter, extra in options:
                if letter == " ":
                    key, c = "^", cost + extra + model.cost(history, "$")
                elif letter:
                    key, c = (history + letter)[-(ORDER - 1) :], cost + extra + model.cost(history, letter)
                else:
                    key, c = history, cost + extra
                if key not in new or c < new[key][0]:
                    new[key] = (c, (letter, path))
        states = new
    path = min((cost + model.cost(history, "$"), history, path) for history, (cost, path) in states.items())[2]
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest word behind ``token``."""
    return "".join(_likeliest(lattice(token), model))


def decode_run(run: str, model: CharacterModel) -> list[tuple[str, str]]:
    """The likeliest words of letters set apart by spaces, each with the signs it was read from.

    A space vanishes or is a word boundary.
    """
    options: list[list[tuple[str, float]]] = []
    for k, place in enumerate(lattice(run)):
        if k:
            options.append([("", 0.0), (" ", 0.0)])
        options.append(place)
    chosen = _likeliest(options, model)
    out, word, start = [], "", 0
    for k, letter in enumerate(chosen[::2]):
        word += letter
        if 2 * k + 1 == len(chosen) or chosen[2 * k + 1] == " ":
            out.append((word, run[start : k + 1]))
            word, start = "", k + 1
    return out


def disguised(token: str) -> str | None:
    """The part of a lower-case token to decode, if it looks disguised; of a long run of one sign three are kept."""
    plain = token.strip(_PLAIN)
    if plain.isalpha() and not _TRIPLE.search(plain):
        return None
    if "://" in token or ("@" in token and "." in token.rpartition("@")[2]):
        return None
    full, token = token, _LONG.sub(r"\1\1\1", token)
    core = token.rstrip(_EDGE)
    if token[len(core) :] == "$":
        core = token
    core = core.lstrip(_LEAD)
    if core[:1] == "(" and (")" in core or core[1:].isalpha()):
        core = core[1:]
    letters = sum(c.isalpha() for c in core)
    if letters < 2 or core.isalpha() and not _TRIPLE.search(core):
        return None
    if _TRIPLE.search(core) or _APART.fullmatch(core) or _WIDE.fullmatch(core):
        return core
    # a stretched sign counts once
    flat = _RUN.sub(r"\1", core) if token != full else core
    if _LEET.search(core) and (letters * 3 >= len(core) or sum(c.isalpha() for c in flat) * 3 >= len(flat)):
        return core
    return None


def units(word: str) -> list[str]:
    """What a word counts as: itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def words_of(token: str, model: CharacterModel | None) -> list[str]:
    """The words of a token, restored if it is disguised."""
    low = token.lower()
    out = _LETTERS.findall(low)
    if model is not None and (core := disguised(low)):
        out.append(decode(core, model))
    return out


def spaced(tokens: list[str]) -> list[str]:
    """Runs of single characters, which may spell words, as one token each."""
    out, run, last = [], [], -2
    for k in [*(k for k, t in enumerate(tokens) if len(t) == 1), -2]:
        if k != last + 1:
            if len(run) >= 3:
                out.append("".join(run).lower())
            run = []
        run.append(tokens[k] if k >= 0 else "")
        last = k
    return out


def bound(tp: float, fp: float, toxic: float, clean: float) -> float:
    """A lower bound of the log odds."""
    odds = math.log((tp + 0.5) / (toxic + 1)) - math.log((fp + 0.5) / (clean + 1))
    return odds - 1.64 * math.sqrt(1 / (tp + 0.5) + 1 / (fp + 0.5))


class Detector:
    def __init__(self, lexicon: dict[str, tuple[int, int]], totals: tuple[int, int], model: CharacterModel):
        self.lexicon, self.totals, self.model = lexicon, totals, model
        self.weights, self.bias = np.zeros(3), -30.0
        self.constant: float | None = None
        found = {u: bound(tp, fp, *totals) for u, (tp, fp) in lexicon.items()}
        self.whole = {u[1:]: b for u, b in found.items() if u[0] == "="}
        self.begins = {u[1:]: b for u, b in found.items() if u[0] == "^"}
        self.heads = {u[: PREFIXES[0]] for u in self.begins}

    def word(self, word: str, own: int | None = None) -> float:
        """The largest bound among a word's units; ``own``: leave out one document of this label."""
        if own is None:
            best = max(0.0, self.whole.get(word, 0.0))
            if word[: PREFIXES[0]] in self.heads:
                best = max(best, *(self.begins.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n))
            return best
        best = 0.0
        for u in units(word):
            if u in self.lexicon:
                tp, fp = self.lexicon[u]
                toxic, clean = self.totals
                tp, fp, toxic, clean = (tp - 1, fp, toxic - 1, clean) if own else (tp, fp - 1, toxic, clean - 1)
                best = max(best, bound(max(tp, 0), max(fp, 0), toxic, clean))
        return best

    def features(self, text: str, memo: _Memo) -> np.ndarray:
        tokens = text.split()
        found = [*map(memo.__getitem__, set(tokens))]
        hits = [s for s in found if s > 0]
        if min(found, default=0.0) < 0:  # there is a single character
            for t in spaced(tokens):
                hits += memo.run(t)
        hits.sort(reverse=True)
        return np.array([hits[0] if hits else 0.0, hits[1] if len(hits) > 1 else 0.0, math.log1p(sum(s > 1 for s in hits))])

    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton steps."""
        a = np.hstack((x, np.ones((len(x), 1))))
        w = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.05, 0.05, 0.001])
            w -= np.linalg.solve(h, a.T @ (weight * (p - y)) + np.array([0.05, 0.05, 0.05, 0.001]) * w)
        self.weights, self.bias = w[:3], float(w[3])


class _Memo(dict):
    """Token to bound; single characters have a mark below zero."""

    def __init__(self, detector: Detector, own: int | None = None):
        self.detector, self.own = detector, own
        self.runs: dict[str, list[float]] = {}

    def __missing__(self, token: str) -> float:
        low = token.lower()
        plain = low.strip(_PLAIN)
        if len(token) == 1:
            s = -1.0
        elif plain.isalpha() and not _TRIPLE.search(plain):
            s = self.detector.word(plain, self.own)
        else:
            s = max((self.detector.word(w, self.own) for w in words_of(token, self.detector.model)), default=0.0)
        if len(self) > 300_000:
            self.clear()
        self[token] = s
        return s

    def run(self, t: str) -> list[float]:
        """The bounds above zero of the words that a run of single characters spells."""
        if (out := self.runs.get(t)) is None:
            word, own, model = self.detector.word, self.own, self.detector.model
            out = sorted(filter(None, (max(word(w, own), word(raw, own)) for w, raw in decode_run(t, model))))
            whole = max(word(t, own), word(decode(t, model), own))
            if whole > max(out, default=0.0):
                out[-1:] = [whole]
            if len(self.runs) > 100_000:
                self.runs.clear()
            self.runs[t] = out
        return out


_UNIT = pa.schema([("u", pa.string()), ("y", pa.int32()), ("n", pa.int64())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, y, n: units by documents that have them; u starts with ``=`` or ``^``."""
    for b in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_LETTERS.findall((text or "").lower()))
            counts[y].update({u for w in words for u in units(w)})
        for y in (0, 1):
            if counts[y]:
                yield to_batch(_UNIT, [list(counts[y]), [y] * len(counts[y]), list(counts[y].values())])


_TABLE = pa.schema([("part", pa.int32()), ("value", pa.binary())])
_TABLE_DDL = "part int, value binary"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, words = np.zeros(1 << GRAM_BITS), Counter()
    for b in batches:
        found = pc.value_counts(pc.list_flatten(pc.utf8_split_whitespace(b.column(0))))
        for w, n in zip(pc.utf8_lower(found.field(0)).to_pylist(), found.field(1).to_pylist(), strict=True):
            words[w] += n
        if len(words) > 400_000:
            count_grams(words, table)
            words.clear()
    count_grams(words, table)
    cut = len(table) // PARTS
    yield to_batch(_TABLE, [list(range(PARTS)), [table[p * cut : (p + 1) * cut].tobytes() for p in range(PARTS)]])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v, np.float64) for v in pdf["value"]], axis=0)
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "value": [total.tobytes()]})


def character_model(docs: DataFrame) -> CharacterModel:
    """Counts over all texts: as many tasks as cores, a table each, summed in two levels; the driver receives PARTS rows."""
    tasks = map_arrow(docs.select("text").coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism)), _grams, _TABLE_DDL).withColumn("salt", (F.rand(7) * 64).cast("int"))
    level = tasks.groupBy("part", "salt").applyInPandas(lambda pdf: _summed(pdf), _TABLE_DDL)
    found = {r.part: np.frombuffer(bytes(r.value)) for r in level.groupBy("part").applyInPandas(lambda pdf: _summed(pdf), _TABLE_DDL).collect()}
    return CharacterModel(np.concatenate([found[p] for p in range(PARTS)]).astype(np.float32) if found else np.zeros(1 << GRAM_BITS, np.float32))


_X = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])


def _train_features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = shared.value
        memos = _Memo(detector, 0), _Memo(detector, 1)
        for b in batches:
            ys = b.column(0).to_pylist()
            yield to_batch(_X, [ys, [detector.features(t or "", memos[y]).tolist() for y, t in zip(ys, b.column(1).to_pylist(), strict=True)]])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = SAMPLE) -> Detector:
    """The detector: lexicon and unit from a bounded sample of rows, the character model from all of ``docs``.

    The driver receives the lexicon, 2 * sample rows of three numbers and PARTS rows of counts.
    """
    rows = sample_labels(docs, labels, label, train, sample).select("y", "text").repartition(24).persist(StorageLevel.DISK_ONLY)  # made anew if lost
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        rows.unpersist()
        detector = Detector({}, (toxic, clean), CharacterModel(np.zeros(1 << GRAM_BITS, np.float32)))
        detector.constant = float(toxic > 0)
        return detector
    each = map_arrow(rows, _units, "u string, y int, n long").groupBy("u").agg(F.sum(F.col("y") * F.col("n")).alias("tp"), F.sum((1 - F.col("y")) * F.col("n")).alias("fp"))
    odds = F.log((F.col("tp") + 0.5) / (toxic + 1)) - F.log((F.col("fp") + 0.5) / (clean + 1))
    lower = odds - 1.64 * F.sqrt(1 / (F.col("tp") + 0.5) + 1 / (F.col("fp") + 0.5))
    lexicon = each.filter(lower > 0).collect()
    detector = Detector({r.u: (r.tp, r.fp) for r in lexicon}, (toxic, clean), character_model(docs))
    shared = docs.sparkSession.sparkContext.broadcast(detector)  # at most a sixth of SAMPLE documents' units, and 2**GRAM_BITS counts
    got = map_arrow(rows, _train_features(shared), "y int, x array<double>").collect()
    y = np.array([r.y for r in got], float)
    detector.fit(np.array([r.x for r in got]), y, np.where(y == 1, 1.0, math.sqrt(max(1.0, toxic / clean))))
    rows.unpersist()
    return detector


_SCORE = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("score", pa.float64())])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = shared.value
        memo = _Memo(detector)
        for b in batches:
            yield to_batch(_SCORE, [b.column(0), b.column(1), [detector.score(detector.features(t or "", memo)) for t in b.column(2).to_pylist()]])

    return run


def toxicity(docs: DataFrame, detector: Detector, held: Column) -> DataFrame:
    """id, held, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)  # of bounded size, see fit
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("id"), held.alias("held"), F.col("text").alias("text")), _scorer(shared), "id long, held boolean, score double")


def clean(docs: DataFrame, detector: Detector, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores below ``threshold``; all, if there were no labels of both kinds to learn from."""
    if detector.constant is not None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(detector)  # of bounded size, see fit
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        memo = _Memo(found)
        for b in batches:
            yield b.filter(pa.array([found.score(found.features(t or "", memo)) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    found = toxicity(docs, fit(docs.select("doc_id", "text"), labels, ~held), held)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
