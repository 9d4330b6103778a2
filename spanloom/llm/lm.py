"""Language-model scoring with a hashed maximum-entropy model.

Words are 64-bit hashes of their lower-cased bytes, counted over the whole
training part. The softmax over the vocabulary is factored by nested classes:
each class is a softmax over its parts, WAYS at most, down to the words with more than
1/HEAVY of all tokens and to classes of all other words by their hash, whose
number grows with the vocabulary up to 2**CLASS_BITS. Frequent words are in few
classes. A token's probability is the product of the softmaxes of the classes
around it and, among rarer words, its share of the last class by smoothed
count, so the model is a distribution over all words seen, and the unseen.

A class's softmax starts from its parts' shares in the corpus and adds the
weights of hashed features: the class with the word one back, with the word two
back (a skip), and with the pair of the last two. Context words are the words
themselves, frequent or not. The weight table grows with the vocabulary up to
2**ROW_BITS rows of WAYS; beyond, more features share a row.

Training: ROUNDS synchronous rounds over disjoint parts of the training
documents, so that each position of each document gives its gradient once. In a
round every task starts from the common weights and takes minibatch steps
(Adagrad by row) over its share; the weights are then averaged, each row by the
tokens that moved it, in two levels of groups. There are as many tasks as the
cluster has cores, whatever the input's size, so what they send is bounded.

Scoring: one pass computes everything that depends on context; rarer words then
meet their counts in a join. Words of more than 1/HEAVY of all tokens, of which
there are fewer than HEAVY, are broadcast and left out of the join, so no key
of the join is hot.

Defined results: a null or empty text is the end alone. Repeated rows and ids
are each scored (and, in the training part, learnt) as they occur. A null id
counts as empty text in the split. With no training rows all words are unknown,
N is 0. ``score`` depends on the number of tasks that train (the cores, or the
input's partitions if there are fewer) as averages of weights do: by 4 % between
1 and 4 tasks over 1,000 documents, by less than 1 % on how rows are dealt to as
many tasks. The base columns don't depend on it. Extra columns are ignored; an
empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix64, read_table, remainder, steps, to_batch, word_table, written

HEAVY = 500_000
CLASS_BITS = 16
WAYS = 16
ROW_BITS = 16
ROUNDS = 4
RATE = 0.1
CHUNK = 1 << 13
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
#: Weights are averaged in so many parts.
PARTS = 16
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SALTS = np.array([0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D, 0xA0761D6478BD642F], np.uint64)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each token of ``texts``, each text's end included."""
    _, _, _, doc, h = word_table([lowered(t) for t in texts])
    place = np.searchsorted(doc, np.arange(len(texts)), side="right")
    return np.insert(h, place, END), np.insert(doc, place, np.arange(len(texts)))


# -- counts ------------------------------------------------------------------

_COUNT = pa.schema([("h", pa.int64()), ("c", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, inv = np.unique(h, return_inverse=True)
        return u, np.bincount(inv, c, len(u)).astype(np.int64)

    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in steps(texts):
            held.append(np.unique(tokens(texts[lo:hi])[0], return_counts=True))
            size += len(held[-1][0])
        if size > 1_000_000:
            one = merged()
            if len(one[0]) > 400_000:
                yield to_batch(_COUNT, [one[0].view(np.int64), one[1]])
                held, size = [], 0
            else:
                held, size = [one], len(one[0])
    if held:
        one = merged()
        yield to_batch(_COUNT, [one[0].view(np.int64), one[1]])


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c over the training rows of ``docs`` (text, held)."""
    return map_arrow(docs.filter("not held").select("text"), _count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


# -- model -------------------------------------------------------------------


class Tree:
    """Nested classes over leaves of given mass: a Huffman tree of WAYS ways.

    up: for each leaf, then each class, the class around it (-1 for the whole);
    slot: its place there. prior: log share of each class's parts; key: a hash
    of each class.
    """

    def __init__(self, mass: np.ndarray):
        n = len(mass)
        order = np.argsort(mass, kind="stable")
        leaf, inner, parts = mass[order].tolist(), [], []
        size = n + max(1, -(-(n - 1) // (WAYS - 1)))
        self.up, self.slot = np.full(size, -1, np.int32), np.zeros(size, np.int64)
        i = j = 0
        take = (n - 2) % (WAYS - 1) + 2 if n > 1 else 1
        while n + len(inner) < size:
            own = []
            for s in range(take):
                if j == len(inner) or i < n and leaf[i] <= inner[j]:
                    child, m = order[i], leaf[i]
                    i += 1
                else:
                    child, m = n + j, inner[j]
                    j += 1
                self.up[child], self.slot[child] = len(inner), s
                own.append(m)
            parts.append(own + [0.0] * (WAYS - take))
            inner.append(sum(own))
            take = WAYS
        shares = np.array(parts) / np.array(inner)[:, None]
        self.leaves, self.prior = n, np.log(np.maximum(shares, 1e-25)).astype(np.float32)
        self.key = mix64(np.arange(1, len(inner) + 1, dtype=np.uint64) * _ODD)


@dataclass
class Vocabulary:
    """The frequent words, the classes of the others, and the totals; fewer than HEAVY words."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    n: int
    v: int
    class_bits: int
    class_mass: np.ndarray  # smoothed
    row_bits: int
    tree: Tree  # leaves: words, then classes of other words

    def __post_init__(self):
        bits = max(1, len(self.words).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.run = int(np.diff(np.append(self.first, len(self.words))).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``h`` among the words, and whether they are there."""
        at = np.minimum(self.first[(h >> self.shift).astype(np.int64)], len(self.words) - 1)
        found = self.words[at] == h
        left = np.flatnonzero(~found)
        for _ in range(self.run - 1):
            at[left] = np.minimum(at[left] + 1, len(self.words) - 1)
            found[left] = self.words[at[left]] == h[left]
            left = left[~found[left]]
        return at, found

    def class_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.class_bits)).astype(np.int64) if self.class_bits else np.zeros(len(h), np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = int(END.view(np.int64))
    found = {r.h: r.c for r in counts.filter((F.col("c") * HEAVY > n) | (F.col("h") == end)).collect()} if n else {}
    found.setdefault(end, 0)
    words = np.sort(np.array(list(found), np.int64).view(np.uint64))
    own = np.array([found[h] for h in words.view(np.int64).tolist()])
    bits = min(CLASS_BITS, max(0, v.bit_length() - 4))
    mass = np.full(1 << bits, 0.5)
    if n:
        code = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
        for r in counts.filter((F.col("c") * HEAVY <= n) & (F.col("h") != end)).groupBy(code.alias("k")).agg(F.sum(F.col("c") + 0.5).alias("s")).collect():
            mass[r.k] += r.s
    return Vocabulary(words, own, n, v, bits, mass, min(ROW_BITS, max(10, v.bit_length())), Tree(np.concatenate((own + 0.5, mass))))


class Batch:
    """A run of tokens with their leaves and context features."""

    def __init__(self, texts: list[str | None], vocab: Vocabulary):
        self.h, self.doc = tokens(texts)
        self.at, self.heavy = vocab.find(self.h)
        self.cls = vocab.class_of(self.h)
        self.leaf = np.where(self.heavy, self.at, len(vocab.words) + self.cls)
        start = np.flatnonzero(np.diff(self.doc, prepend=-1))
        place = np.arange(len(self.h)) - np.repeat(start, np.diff(np.append(start, len(self.h))))

        def back(k: int) -> np.ndarray:
            out = np.full(len(self.h), START)
            out[k:] = self.h[:-k]
            out[place < k] = START
            return out

        a, b = back(1), back(2)
        self.features = np.stack((a * _SALTS[0], b * _SALTS[1], mix64(a * _SALTS[2] + b)))


_ONES = np.ones(WAYS, np.float32)


def walk(w: np.ndarray, vocab: Vocabulary, leaf: np.ndarray, features: np.ndarray, gradients: list | None = None) -> np.ndarray:
    """Natural log probability of each leaf in its context; ``gradients`` gets (rows, softmax less target) of each step up."""
    tree, shift = vocab.tree, np.uint64(64 - vocab.row_bits)
    out = np.zeros(len(leaf))
    on, at = np.arange(len(leaf)), leaf
    while True:
        around = tree.up.take(at)
        if (around < 0).any():
            there = np.flatnonzero(around >= 0)
            on, at, around, features = on[there], at[there], around[there], features[:, there]
        if not len(on):
            return out
        # row_bits are 16 at most
        rows = (((tree.key.take(around) ^ features) * _ODD) >> shift).astype(np.uint16)
        z = tree.prior.take(around, 0)
        for r in rows:
            z += w.take(r, 0)
        # weights are clipped, so no sum overflows
        place = np.arange(0, z.size, WAYS) + tree.slot.take(at)
        target = z.ravel().take(place)
        np.exp(z, out=z)
        total = z @ _ONES
        out[on] += target - np.log(total)
        if gradients is not None:
            z /= total[:, None]
            z.ravel()[place] -= 1
            gradients.append((rows, z))
        at = around + tree.leaves


def _sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values``, taken in ``order``, of each run (its first place and length); most runs are short."""
    out = values.take(order[first], 0)
    short, k = np.flatnonzero((n > 1) & (n <= 8)), 1
    while len(short):
        out[short] += values.take(order[first[short] + k], 0)
        k += 1
        short = short[n[short] > k]
    long = n > 8
    if long.any():
        size = n[long]
        begin = np.cumsum(size) - size
        out[long] = np.add.reduceat(values.take(order[np.repeat(long, n)], 0), begin, axis=0)
    return out


@dataclass
class Weights:
    """w: a row of WAYS for each hashed feature; squares: Adagrad's sum for each row."""

    w: np.ndarray
    squares: np.ndarray

    @staticmethod
    def zero(bits: int) -> Weights:
        return Weights(np.zeros((1 << bits, WAYS), np.float32), np.zeros(1 << bits, np.float32))

    def descend(self, seen: np.ndarray, gradients: list) -> None:
        rows = np.concatenate([r for r, _ in gradients], axis=1)
        grad, rows = np.concatenate([g for _, g in gradients]), rows.ravel()
        # 16-bit keys are sorted by radix
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ 1))
        touched, n = ordered[first], np.diff(np.append(first, len(rows)))
        g = _sums(grad, order % len(grad), first, n)
        self.squares[touched] += (g * g) @ _ONES / WAYS
        g *= (-RATE / np.sqrt(self.squares[touched] + 1.0))[:, None]
        g += self.w.take(touched, 0)
        self.w[touched] = np.clip(g, -10, 10, out=g)
        seen[touched] += n


_PART = pa.schema([("part", pa.int32()), ("value", pa.binary()), ("seen", pa.binary())])
_PART_DDL = "part int, value binary, seen binary"


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, common = shared.value
        own = Weights(common.w.copy(), common.squares.copy())
        seen = np.zeros(len(own.w), np.float32)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in steps(texts):
                x = Batch(texts[lo:hi], vocab)
                for at in range(0, len(x.h), CHUNK):
                    gradients: list = []
                    walk(own.w, vocab, x.leaf[at : at + CHUNK], x.features[:, at : at + CHUNK], gradients)
                    own.descend(seen, gradients)
        if seen.any():
            every = np.hstack((own.w, own.squares[:, None]))
            cut = len(every) // PARTS
            parts = [slice(p * cut, (p + 1) * cut) for p in range(PARTS)]
            yield to_batch(_PART, [list(range(PARTS)), [every[p].tobytes() for p in parts], [seen[p].tobytes() for p in parts]])

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of weights and their sums of squares, each by the tokens that moved it."""
    total = value = None
    for v, s in zip(pdf["value"], pdf["seen"], strict=True):
        seen = np.frombuffer(s, np.float32)
        x = np.frombuffer(v, np.float32).reshape(len(seen), -1) * seen[:, None]
        total, value = (seen.copy(), x) if total is None else (total + seen, value + x)
    value /= np.maximum(total, 1e-9)[:, None]
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "value": [value.astype(np.float32).tobytes()], "seen": [total.astype(np.float32).tobytes()]})


def train(docs: DataFrame, vocab: Vocabulary) -> Weights:
    """Weights after ROUNDS rounds over ``docs`` (id, text, held); the driver receives PARTS rows in each."""
    common = Weights.zero(vocab.row_bits)
    sc = docs.sparkSession.sparkContext
    for k in range(ROUNDS):
        shared = sc.broadcast((vocab, common))  # fewer than HEAVY words, 2**CLASS_BITS classes and 2**ROW_BITS rows
        rows = docs.filter(~F.col("held") & (F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == k)).select("text")
        tasks = map_arrow(rows.coalesce(max(1, sc.defaultParallelism)), _trainer(shared), _PART_DDL).withColumn("salt", (F.rand(7) * 64).cast("int"))
        level = tasks.groupBy("part", "salt").applyInPandas(lambda pdf: _average(pdf), _PART_DDL)
        cut = len(common.w) // PARTS
        for r in level.groupBy("part").applyInPandas(lambda pdf: _average(pdf), _PART_DDL).collect():
            moved = np.frombuffer(bytes(r.seen), np.float32) > 0
            value = np.frombuffer(bytes(r.value), np.float32).reshape(cut, WAYS + 1)
            at = np.flatnonzero(moved) + r.part * cut
            common.w[at], common.squares[at] = value[moved, :WAYS], value[moved, WAYS]
        shared.unpersist()
    return common


# -- scoring -----------------------------------------------------------------

_SCORE = pa.schema([("uid", pa.int64()), ("h", pa.int64()), ("tf", pa.int32()), ("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
_SCORE_DDL = "uid long, h long, tf int, id long, held boolean, n_tokens long, n_known long, base double, score double"


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, w = shared.value
        uid = TaskContext.get().partitionId() << 40
        log_count, known_word = np.log10(vocab.counts + 0.5), vocab.counts > 0
        log_mass = np.log10(vocab.class_mass)
        all_mass = np.log10(vocab.n + 0.5 * (vocab.v + 1))
        for b in batches:
            ids, helds, texts = (b.column(k) for k in range(3))
            texts = texts.to_pylist()
            for lo, hi in steps(texts):
                x, m = Batch(texts[lo:hi], vocab), hi - lo
                score = np.concatenate([walk(w.w, vocab, x.leaf[at : at + CHUNK], x.features[:, at : at + CHUNK]) for at in range(0, len(x.h), CHUNK)]) / np.log(10)
                rare = ~x.heavy
                score[rare] -= log_mass[x.cls[rare]]
                count = np.where(x.heavy, log_count[x.at], 0.0)
                n = np.bincount(x.doc, minlength=m)
                known = np.bincount(x.doc, x.heavy & known_word[x.at], m).astype(np.int64)
                base = np.bincount(x.doc, count, m) - n * all_mass
                own_uid = np.arange(uid, uid + m)
                uid += m
                zero = np.zeros(m, np.int64)
                yield to_batch(_SCORE, [own_uid, own_uid, zero, ids.slice(lo, m), helds.slice(lo, m), n, known, base, np.bincount(x.doc, score, m)])
                # a text's equal rare words travel as one row
                order = np.lexsort((x.h[rare], x.doc[rare]))
                h, doc = x.h[rare][order], x.doc[rare][order]
                first = np.flatnonzero((np.diff(h, prepend=np.uint64(0)) != 0) | (np.diff(doc, prepend=-1) != 0))
                tf, none = np.diff(np.append(first, len(h))), pa.nulls(len(first))
                yield to_batch(_SCORE, [own_uid[doc[first]], h[first].view(np.int64), tf, none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64())])

    return run


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, w: Weights) -> DataFrame:
    """id, held, n_tokens, n_known, base, score of each row of ``docs`` (id, text, held)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, w))  # fewer than HEAVY words, 2**CLASS_BITS classes and 2**ROW_BITS rows
    rows = map_arrow(docs.select("id", "held", "text"), _scorer(shared), _SCORE_DDL)
    seen = counts.filter(F.col("c") * HEAVY <= vocab.n).select(F.col("h").alias("word"), "c")
    # a text's own row carries its unique number as key and tf 0: no count is found for it, and no key is hot
    joined = rows.join(seen, (rows.h == seen.word) & (rows.tf > 0), "left")
    part = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    summed = joined.groupBy("uid").agg(
        F.max("id").alias("id"),
        F.max("held").alias("held"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(part)).alias("base"),
        (F.max("score") + F.sum(part)).alias("score"),
    )
    return summed.drop("uid")


def lm_scores(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", scope: str = "query") -> tuple[DataFrame, Vocabulary]:
    """Scores of all rows, learning from those where the column ``held`` is false."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    counts = written(word_counts(rows), "words", scope)
    vocab = vocabulary(counts)
    return score(rows, counts, vocab, train(rows, vocab)), vocab


def op2(spark, sf_dir: str) -> DataFrame:
    found, vocab = lm_scores(read_table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
