"""A corpus pipeline: toxic documents go, shared lines go, one of each near-duplicate
group stays, personal data is redacted, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
is the next stage's ``docs``. A stage's scratch tables are removed when the next
stage begins, as its result has been written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, packing, pii, simhash, toxicity
from spanloom.llm.common import clear_scratch, free_name, read_table, remainder, shared_dir, written

_SCOPE = "pipeline"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector rejects go; others stay as they are."""
    clear_scratch(spark, _SCOPE)
    detector = toxicity.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.clean(docs, detector)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; ``n_chars`` follows the text."""
    clear_scratch(spark, _SCOPE)
    found = line_dedup.dedup_lines(docs, scope=_SCOPE)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id, ids that are null last.

    Rows are told apart by id and a hash of all their columns (maps aside), so
    another text under the same id is judged by its own group. Of rows that are
    equal in all of them one stays.
    """
    clear_scratch(spark, _SCOPE)
    row, i = free_name(docs, "_row", "_id")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    last = F.lit((1 << 63) - 1)
    found = simhash.near_duplicates(docs, scope=_SCOPE, tag=whole)
    first = found.groupBy("root").agg(F.min(F.struct(F.coalesce("id", last).alias("id"), "tag")).alias("first"))
    keep = first.select(F.col("first.id").alias(i), F.col("first.tag").alias(row)).distinct()
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), last), row: whole})
    return keyed.join(keep, [i, row], "left_semi").dropDuplicates([i, row]).select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clear_scratch(spark, _SCOPE)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    clear_scratch(spark, _SCOPE)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("pii", redact), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    shared_dir(spark)
    last: str | None = None
    for k, (name, stage) in enumerate(STAGES):
        scope = f"stage-{k}"
        docs = written(stage(spark, docs, sf_dir), name, scope)
        if last:
            clear_scratch(spark, last)
        last = scope
    clear_scratch(spark, _SCOPE)
    return docs
