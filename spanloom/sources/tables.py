"""Sources, sinks and the keyed tables of a state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INFO_DDL = "doc_id long, key string, value string"
STYLES_DDL = "doc_id long, tag string, hash string, otag string, ctag string, flags string"


#: What an Arrow batch on its way to Python holds at most: rows, and bytes, as texts can be long.
BATCH_ROWS, BATCH_BYTES = "500", "16m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt to all cores by a hash of ``by``: a file of one row group is one task, however many texts it holds.

    For plans that do much with each row; the shuffle costs a small part of that.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), name, content: whole files, of any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("name"), "content")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of both, one for each key: the last by ``seq``; ties go to the largest row.

    An aggregate, so rows of a key meet partially before the shuffle.
    """
    rest = [c for c in table.columns if c not in keys]
    both = table.unionByName(changes)
    last = both.groupBy(*keys).agg(F.max(F.struct(seq, *[c for c in rest if c != seq])).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def value_of(info: DataFrame, doc_id: int, key: str) -> DataFrame:
    """A point look-up, pushed down to the scan."""
    return info.filter((F.col("doc_id") == doc_id) & (F.col("key") == key)).select("value")


def merged_styles(styles: DataFrame, keys: tuple[str, ...] = ("doc_id", "tag", "hash")) -> DataFrame:
    """One row for each style. Keys stand for content; ``clashes`` is 2 if hashes collide, else 1."""
    row = F.struct("otag", "ctag", "flags")
    found = styles.groupBy(*keys).agg(F.min(row).alias("x"), F.when(F.min(F.struct("otag", "ctag")) == F.max(F.struct("otag", "ctag")), 1).otherwise(2).alias("clashes"))
    return found.select(*keys, "x.*", "clashes")


#: Lines of a text file: who reads whole files holds one file at a time, and no file grows with the table.
FILE_LINES = 4000


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as text files of at most FILE_LINES lines."""
    df.select(column).write.mode("overwrite").option("maxRecordsPerFile", FILE_LINES).text(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a temporary folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/spanloom/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``, to its end."""
    p, fs = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)
