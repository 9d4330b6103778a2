"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage becomes a fixed
vector (shares of byte classes, word lengths, distinct and repeated words, a
signed hash of its words), is encoded by one hidden layer, and weighted by
gated attention; a logistic unit scores the weighted sum. Only documents'
labels are used; the attention finds the passages that decide.

The model is fitted on at most SAMPLE labelled documents for each label, chosen
by a hash of the id, and on every passage of each. Bags stay on the executors,
in SHARDS parts by a hash of the id; in each of EPOCHS rounds a task starts from
the common weights, makes one pass of minibatch steps (Adam) over its bags in a
fixed order, and the driver averages SHARDS sets of weights. So a very long
document costs only the task that holds it, and the same tables give the same
model, up to the order of sums.

Defined results: a null or empty text is one empty passage. Repeated rows and
ids are each scored; in training an id has one text, that with the smallest
hash. Labels that contradict each other count as 0, labels without a document
are ignored, null labels too. With labels of one kind only, or none, the score
is their share, or 0.5. Extra columns are ignored; an empty table returns no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import map_arrow, read_table, remainder, steps, to_batch, word_table

PASSAGE = 64
SAMPLE = 3000
SHARDS, EPOCHS, BAGS, RATE = 8, 14, 16, 0.006
HASHED = 24

_CLASS = np.full(256, 11, np.int64)  # bytes beyond ASCII
_CLASS[:128] = 10  # other
for _k, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#*$%&", b"|<>", b"'\"-()[]"]):
    _CLASS[list(_bytes)] = _k
CLASSES = 12
WIDTH = CLASSES + 9 + HASHED


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each passage, and the number of its text; each text has one at least."""
    joined, starts, ends, doc, h = word_table([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    m = len(texts)
    words = np.bincount(doc, minlength=m)
    each = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate(([0], np.cumsum(each)[:-1]))
    total = int(each.sum())
    owner = np.repeat(np.arange(m), each)
    x = np.zeros((total, WIDTH))
    if not len(h):
        return x.astype(np.float32), owner
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    p = base[doc] + (np.arange(len(h)) - first[doc]) // PASSAGE
    n = np.maximum(np.bincount(p, minlength=total), 1)
    begin = np.flatnonzero(np.diff(p, prepend=-1))
    # bytes from a passage's first word to the next one's belong to it
    byte_p = np.repeat(p[begin], np.diff(np.append(starts[begin], len(joined))))
    head = joined[starts[begin[0]] :]
    shares = np.bincount(byte_p * CLASSES + _CLASS[head], minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] = shares / np.maximum(shares.sum(1, keepdims=True), 1)
    size = (ends - starts).astype(float)
    x[:, CLASSES] = n / PASSAGE
    x[:, CLASSES + 1] = np.bincount(p, size, total) / n / 10
    x[:, CLASSES + 2] = np.sqrt(np.bincount(p, size * size, total) / n) / 10
    order = np.lexsort((h, p))
    same = (np.diff(p[order], prepend=-1) == 0) & (np.diff(h[order], prepend=np.uint64(0)) == 0)
    x[:, CLASSES + 3] = np.bincount(p[order], same, total) / n
    repeat = (np.diff(h, prepend=np.uint64(1)) == 0) & (np.diff(p, prepend=-1) == 0)
    x[:, CLASSES + 4] = np.bincount(p, repeat, total) / n
    two = np.concatenate(([False, False], (h[2:] == h[:-2]) & (p[2:] == p[:-2])))
    x[:, CLASSES + 5] = np.bincount(p, two[: len(h)], total) / n
    x[:, CLASSES + 6] = np.bincount(p, size == 1, total) / n
    x[:, CLASSES + 7] = np.bincount(p, _CLASS[joined[ends - 1]] >= 6, total) / n
    x[:, CLASSES + 8] = np.bincount(p, size > 20, total) / n
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)
    bag = np.bincount(p * HASHED + (h % np.uint64(HASHED)).astype(np.int64), sign, total * HASHED).reshape(total, HASHED)
    x[:, CLASSES + 9 :] = bag / np.sqrt(n)[:, None]
    return x.astype(np.float32), owner


class GatedAttention:
    """Encoder, gated attention and logistic head over bags of passages."""

    def __init__(self, width: int = WIDTH, hidden: int = 32, gate: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        init = lambda a, b: (r.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"W": init(width, hidden), "b": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1)[:, 0], "c": init(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))}

    def scores(self, x: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(m, self.constant)
        sizes = np.bincount(owner, minlength=m)
        return self._forward(x, np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)["y"].astype(float)

    def start(self) -> None:
        """Adam's averages at zero."""
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.steps = 0

    def step(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float = RATE) -> None:
        """One step of Adam on a minibatch of bags."""
        n = np.array([len(x) for x in bags])
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        g = self._gradient(self._forward(np.concatenate(bags), first, n), first, n, y, weight)
        self.steps += 1
        for name, d in g.items():
            self.m[name] = 0.9 * self.m[name] + 0.1 * d
            self.v[name] = 0.999 * self.v[name] + 0.001 * d * d
            self.p[name] = (self.p[name] - rate * (self.m[name] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[name] / (1 - 0.999**self.steps)) + 1e-8) - rate * 1e-4 * self.p[name]).astype(np.float32)

    def average(self, others: list[tuple[int, GatedAttention]]) -> None:
        """Weights and Adam's averages become those of ``others``, by their numbers of bags."""
        total = sum(n for n, _ in others)
        for part in ("p", "m", "v"):
            setattr(self, part, {k: (sum(n * getattr(o, part)[k] for n, o in others) / total).astype(np.float32) for k in self.p})
        self.steps = max(o.steps for _, o in others)

    def _gradient(self, f: dict[str, np.ndarray], first: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        e = (f["y"] - y) * weight / len(y)
        dz = np.repeat(e, n)[:, None] * p["c"]
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        gate = de[:, None] * p["w"]
        dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ e, "d": np.array([e.sum()])}


_FEATURE = pa.schema([("key", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        for lo, hi in steps(texts):
            x, owner = passages(texts[lo:hi])
            edge = np.searchsorted(owner, np.arange(hi - lo + 1))
            yield to_batch(_FEATURE, [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), [x[edge[k] : edge[k + 1]].tobytes() for k in range(hi - lo)]])


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """key (the id), y and text of at most ``limit`` documents for each label, chosen by a hash of the id.

    Of rows with one id the text with the smallest hash counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).cast("int").alias("y"))
    ids = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(limit)
        ids = some if ids is None else ids.unionByName(some)
    # at most twice ``limit`` rows of two numbers
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "_id")
    return found.groupBy(F.col("_id").alias("key"), "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _bags(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in b.column("x").to_pylist()]


_MOMENTS = pa.schema([("n", pa.int64()), ("sum", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
    for b in batches:
        for x in _bags(b):
            n, total, squares = n + len(x), total + x.sum(0, dtype=float), squares + np.square(x, dtype=float).sum(0)
    yield to_batch(_MOMENTS, [[n], [total.tolist()], [squares.tolist()]])


_MODEL = pa.schema([("n", pa.int64()), ("model", pa.binary())])


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = pickle.loads(shared.value)
        n = 0
        for b in batches:
            bags, ys = _bags(b), np.array(b.column("y").to_pylist(), np.float32)
            for at in range(0, len(bags), BAGS):
                y = ys[at : at + BAGS]
                model.step(bags[at : at + BAGS], y, np.where(y == 1, weights[1], weights[0]).astype(np.float32))
            n += len(bags)
        if n:
            yield to_batch(_MODEL, [[n], [pickle.dumps(model)]])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE) -> GatedAttention:
    """The model, from a bounded sample of rows; the driver receives SHARDS sets of weights in a round."""
    known = labels.filter(F.col(label).isNotNull() & train)
    share = known.agg(F.avg(label).alias("s")).first().s
    model = GatedAttention()
    vectors = map_arrow(sample_labels(docs, labels, label, train, sample), _vectors, "key long, y int, x binary")
    bags = vectors.repartition(SHARDS, "key").sortWithinPartitions(F.xxhash64("key"), "key").persist(StorageLevel.DISK_ONLY)  # made anew if lost
    counts = {r.y: r["count"] for r in bags.groupBy("y").count().collect()}
    if len(counts) < 2:
        model.constant = 0.5 if share is None else float(share)
        bags.unpersist()
        return model
    found = map_arrow(bags, _moments, "n long, sum array<double>, squares array<double>").collect()
    n = sum(r.n for r in found)
    mean, squares = (np.sum([r[k] for r in found], axis=0) / n for k in (1, 2))
    model.mean, model.scale = mean.astype(np.float32), (np.sqrt(np.maximum(squares - mean * mean, 0)) + 1e-3).astype(np.float32)
    # weights restore the labels' shares, tempered so that the rarer label is learnt well
    y = counts[1] / (counts[0] + counts[1])
    weights = float(np.sqrt(max(1 - share, 0.01) / max(1 - y, 0.01))), float(np.sqrt(max(share, 0.01) / max(y, 0.01)))
    model.start()
    for _ in range(EPOCHS):
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model, weights)))  # fixed size
        model.average([(r.n, pickle.loads(bytes(r.model))) for r in map_arrow(bags, _trainer(shared), "n long, model binary").collect()])
        shared.unpersist()
    bags.unpersist()
    return model


_SCORE = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("score", pa.float64())])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in steps(texts):
                x, owner = passages(texts[lo:hi])
                yield to_batch(_SCORE, [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), model.scores(x, owner, hi - lo)])

    return run


def quality(docs: DataFrame, model: GatedAttention, held: Column) -> DataFrame:
    """id, held, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("id"), held.alias("held"), F.col("text").alias("text")), _scorer(shared), "id long, held boolean, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = remainder("doc_id", 3) == 1
    found = quality(docs, fit(docs.select("doc_id", "text"), labels, ~held), held)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
