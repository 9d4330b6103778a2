"""What the training-data operators share: inputs, shared scratch space, hashing of words."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.tables import small_batches

#: Bytes of text that one vectorised step handles at a time.
STEP_BYTES = 1 << 21

_written: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the Python workers' path."""
    small_batches(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is set only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _drop(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession, scope: str) -> None:
    """Remove the tables written under ``scope``; their readers must have finished."""
    _drop(spark, _written.pop(scope, []))


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            for scope in list(_written):
                clear_scratch(spark, scope)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


atexit.register(_at_exit)


def written(df: DataFrame, label: str, scope: str = "query") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(scope, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no such column, whatever the case."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


#: A key with more than 1/HOT of a join's rows is dealt to several tasks; there are fewer than HOT such keys.
HOT = 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame | None = None, how: str = "inner", hot: int = HOT, total: int | None = None, floor: int = 0) -> DataFrame:
    """Join of ``left`` with the one row that ``right`` has for a key, in which no task takes a hot key's rows.

    sizes: keys and n, how many rows of ``left`` a key has; counted if not given.
    total: all rows, or more; counted if not given. Keys with more than 1/hot of
    all rows (fewer than ``hot``) and ``floor`` rows at least come to the driver.
    Their rows are dealt by a hash of the whole row to parts of about total/hot
    rows, and their right row is copied for each part, so that at most twice
    ``hot`` copies are made. Columns other than the keys must differ in name.
    """
    if total is not None and total < floor:
        return left.join(right, keys, how)
    if sizes is None:
        sizes = left.groupBy(*keys).agg(F.count("*").alias("n"))
    total = (sizes.agg(F.sum("n")).first()[0] or 0) if total is None else total
    asked = sizes.filter((F.col("n") * hot > total) & (F.col("n") >= floor))
    found = asked.select(*keys, F.ceil(F.col("n") * hot / total).cast("int").alias("_parts")).collect() if total else []
    if not found:
        return left.join(right, keys, how)
    schema = sizes.select(*keys).schema.add("_parts", T.IntegerType())
    parts = F.broadcast(left.sparkSession.createDataFrame(found, schema))
    row = F.xxhash64(*left.columns)
    dealt = left.withColumn("_row", row).join(parts, keys, "left").withColumn("_part", F.coalesce(F.pmod("_row", F.col("_parts")), F.lit(0)).cast("int")).drop("_row", "_parts")
    copied = right.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


def remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about STEP_BYTES characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words (runs without white space) of ``texts``, in order.

    Returns the joined bytes, and for each word its start, its end, the number
    of its text, and a 64-bit hash of its bytes.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return joined, z, z, z, np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    lengths = ends - starts
    power = np.multiply.accumulate(np.full(int(lengths.max()), _ODD, np.uint64))
    inside = np.flatnonzero(~space)
    value = np.zeros(len(joined), np.uint64)
    value[inside] = _BYTE[joined[inside]] * power[inside - np.repeat(starts, lengths)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return joined, starts, ends, doc, mix64(total[ends] - total[starts] + lengths.astype(np.uint64))
