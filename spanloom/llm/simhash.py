"""SimHash near-duplicates by multi-index hashing.

A fingerprint is split into segments. Two fingerprints within ``radius`` bits
agree, in at least one segment, up to that segment's share of the radius; so
each fingerprint looks up the small Hamming ball around each of its segments in
a table keyed by segment value, and the full distance is verified inside the
join. How many segments there are follows from the number of distinct
fingerprints; every choice finds every link.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other. Repeated rows and repeated ids
each return a row. A null id returns a row; it counts in no component's smallest
id. An empty table returns no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread_join, to_batch, written

SHINGLE = 4
RADIUS = 4
#: Edges from which a node's edges are dealt to several tasks.
HUB = 100_000
_SCHEMA = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    n = max(1, len(starts) - shingle + 1)
    ends = ends[min(shingle, len(ends)) - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # long texts in steps
        upto = min(n, at + (1 << 16))
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:upto].tolist(), ends[at:upto].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tag: Column | None = None) -> DataFrame:
    """id, tag (a long of the caller's own), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield to_batch(_SCHEMA, [b.column(0), b.column(1), [_signed(fingerprint(t, shingle)) for t in b.column(2).to_pylist()]])

    tag = F.lit(None) if tag is None else tag
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), tag.cast("long").alias("tag"), F.col(text_col).alias("text")), run, "id long, tag long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def plan_segments(m: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of the segments to look up, for ``m`` segments."""
    share, left = divmod(radius, m)
    edges = [64 * i // m for i in range(m + 1)]
    return [(lo, hi - lo, r) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if (r := share - (i > left)) >= 0]


def choose_segments(n: int, radius: int = RADIUS) -> int:
    """The number of segments with the least work for ``n`` fingerprints: a look-up
    costs one unit, a candidate that it meets a twentieth. All choices are exact."""

    def cost(m: int) -> float:
        return sum(len(ball(bits, r)) * (1 + 0.05 * n / 2.0**bits) for _, bits, r in plan_segments(m, radius))

    return min(range(2, radius + 1), key=cost)


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a < b: pairs of distinct fingerprints that differ in at most ``radius`` bits."""
    segments = plan_segments(choose_segments(n, radius), radius)

    def value(lo: int, bits: int) -> Column:
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << bits) - 1))

    def entry(i: int, key: Column) -> Column:
        return F.struct(F.lit(i).alias("s"), key.alias("k"))

    table = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[entry(i, value(lo, bits)) for i, (lo, bits, _) in enumerate(segments)])).alias("e")).select("b", "e.s", "e.k")
    def around(i: int, lo: int, bits: int, r: int) -> Column:
        return F.transform(F.lit(ball(bits, r)).cast("array<bigint>"), lambda x: entry(i, value(lo, bits).bitwiseXOR(x)))

    probes = [around(i, *segment) for i, segment in enumerate(segments)]
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("e")).select("a", "e.s", "e.k")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    found = asked.alias("p").join(table.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.k") == F.col("t.k")) & near)
    return found.select("a", "b")


def components(edges: DataFrame, scope: str = "query") -> DataFrame:
    """node, root (the smallest node of its component), by alternating stars.

    ``edges``: a, b. Each round joins a neighbourhood's minimum back to its
    edges; the edges of a hub with HUB or more are dealt to several tasks. Rounds are written to the
    shared folder and grow with the logarithm of the longest chain.
    """
    state = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", scope)
    n, before = state.count(), None
    while True:
        # large star: each larger neighbour is joined to the smallest of the neighbourhood
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n"))
        large = spread_join(both.filter("v > u"), least.select("u", "m"), ["u"], least.select("u", "n"), total=n, floor=HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars", scope) if n >= HUB else large
        # small star: the node and its smaller neighbours are joined to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.select("u", "m"), ["u"], low.select("u", "n"), total=n, floor=HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        state = written(small.filter("u <> v").distinct(), "stars", scope)
        sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))]
        after = tuple(state.agg(*sums).first())
        if after == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n, before = after[0], after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, scope: str = "query", tag: Column | None = None) -> DataFrame:
    """id, tag (as given), fp, root and component of each row.

    root: the smallest fingerprint that links reach, which names the group;
    component: the smallest id of the group, null if no row of it has an id.
    """
    marks = written(fingerprints(docs, id_col, text_col, shingle, tag), "fingerprints", scope)
    fps = written(marks.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct", scope)
    roots = components(links(fps.select("fp"), fps.count(), radius), scope)
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    named = spread_join(rooted.select("fp", "root"), groups.select("root", "component"), ["root"], groups.select("root", "n"))
    return spread_join(marks, written(named, "groups", scope), ["fp"], fps.select("fp", "n")).select("id", "tag", "fp", "root", "component")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
