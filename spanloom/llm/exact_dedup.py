"""Exact deduplication with an extendible-hash index on shared files.

1. Each text is normalised, hashed, and its narrow entry (id, 64-bit hash,
   SHA-256) is written to the shared folder as a run.
2. The directory starts as one bucket and doubles while some bucket holds more
   distinct keys than its capacity: a bucket that overflows splits on the next
   bit of the hash, others keep their local depth. All slots that share a
   bucket are one row, the bucket's own prefix. It is loaded in bulk, STEP
   doublings in a round, each round over the keys of buckets that overflow
   still, to any depth that the keys need.
3. Each entry finds its bucket in the directory. A bucket is a range of the
   hash and has one owner task, in which entries of one hash form a chain.
   Chains of one entry are done. For longer ones the texts are fetched, and the
   owner compares their bytes: each distinct text of a chain is an entry of the
   index. Texts whose hash occurs once never travel; copies collapse on the map
   side, so a hot text sends one row for each task.
4. The index is written to the shared folder, bucket by bucket. Each row finds
   its bucket in the directory, and in it its entry; rows of hot entries are
   dealt to several tasks.

Native: DataFrame functions only.

Defined results: a null text equals an empty one; white space alone
normalises to one space and equals other white space, not the empty text. Of
equal rows with repeated ids, ``kept`` holds for each row with the smallest id.
A row with a null id is kept only if no row of its group has an id. Extra
columns are ignored. An empty table returns no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, spread_join, written

#: Distinct keys that a bucket holds before it splits; 2 at least.
CAPACITY = 1 << 13
#: Doublings in a round.
STEP = 14
#: Rows of the directory, or hashes that repeat, up to which they are broadcast; beyond, joins shuffle.
SMALL = 1 << 18


def normalised(column: str) -> Column:
    """Each run of white space replaced by one space; only runs that differ from it are rewritten."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def prefix(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash, 63 at most."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY, scope: str = "query") -> tuple[DataFrame, list[int]]:
    """depth, code of each bucket that has keys (local depth and prefix), and the depths that occur.

    keys: h, distinct. The shortest prefix whose keys fit the capacity is a
    bucket, as splits from the root leave it; two buckets never overlap.
    """
    if capacity < 2:
        raise ValueError("a bucket must hold two keys")
    rounds, base, rest = [], 0, keys.select("h")
    while True:
        top = min(base + STEP, 63)
        slots = rest.groupBy(prefix(F.col("h"), top).alias("slot")).agg(F.count("*").alias("n"))
        levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        sizes = written(levels.groupBy("depth", F.expr(f"shiftright(slot, {top} - depth)").alias("code")).agg(F.sum("n").alias("held")), "sizes", scope)
        above = sizes.select((F.col("depth") + 1).alias("depth"), F.col("code").alias("half"), F.col("held").alias("before"))
        split = sizes.withColumn("half", F.shiftright("code", 1)).join(above, ["depth", "half"], "left")
        rounds.append(split.filter((F.col("held") <= capacity) & (F.coalesce("before", F.lit(capacity + 1)) > capacity)).select("depth", "code"))
        over = sizes.filter((F.col("depth") == top) & (F.col("held") > capacity)).select("code")
        if over.isEmpty():
            break
        rest, base = rest.join(over, prefix(F.col("h"), top) == F.col("code"), "left_semi"), top
    found = written(reduce(DataFrame.unionByName, rounds), "directory", scope)
    return found, sorted(r.depth for r in found.select("depth").distinct().collect())


def look_up(rows: DataFrame, found: tuple[DataFrame, list[int]]) -> DataFrame:
    """``rows`` (h, ...) with the bucket that the directory gives for h; a row has one, or isn't returned."""
    buckets, depths = found
    if not depths:
        return rows.withColumn("bucket", F.lit(None).cast("long")).filter("false")
    asked = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("h"), d).alias("code")) for d in depths]))
    each = rows.withColumn("asked", asked).select(*rows.columns, "asked.depth", "asked.code")
    # a leading one keeps prefixes of different depth apart
    named = buckets.withColumn("bucket", F.expr("shiftleft(1L, depth) + code"))
    if buckets.count() <= SMALL:
        return each.join(F.broadcast(named), ["depth", "code"]).drop("depth", "code")
    return spread_join(each, named, ["depth", "code"]).drop("depth", "code")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, scope: str = "query") -> DataFrame:
    """id, keep_id, group_size, sha of each row."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    hashed = text.withColumn("h", F.xxhash64("norm"))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    runs = written(hashed.select("id", "h", sha), "runs", scope)
    found = directory(runs.select("h").distinct(), capacity, scope)

    owned = look_up(runs, found)
    chains = written(owned.groupBy("bucket", "h").agg(F.min("sha").alias("sha"), F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "chains", scope)
    long = chains.filter("group_size > 1").select("h")
    texts = hashed.join(F.broadcast(long) if long.count() <= SMALL else long, "h", "left_semi")
    # equal bytes: the text itself is a key of the chain
    compared = look_up(texts, found).groupBy("bucket", "h", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = chains.filter("group_size = 1").unionByName(compared.select("bucket", "h", sha, "keep_id", "group_size"))
    index = written(entries.repartition("bucket").sortWithinPartitions("bucket", "h"), "index", scope)

    key = ["bucket", "h", "sha"]
    answered = spread_join(look_up(runs, found), index, key, index.select(*key, F.col("group_size").alias("n")))
    return answered.select("id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("sha"))


def op7(spark, sf_dir: str) -> DataFrame:
    found = duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


SQL7 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
