"""The corpus pipeline: five operators over ``documents``, each stage reading what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm import decontam, langid, mixing, near, secret_scan
from rastra.llm.common import new_path, remove, scratch, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language learned from the labelled ones; lang becomes the predicted language."""
    model = langid.fit(docs)
    found = docs.withColumn("_found", langid.language(model, F.col("text")))
    return found.where(~F.col("_found.rejected")).withColumn("lang", F.col("_found.lang")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, that with the least doc_id; rows without an id come after all others.

    Texts with a 5-word shingle similarity of 0.8 or more are linked: by SimHash fingerprints and their pivot distances, and by bands where those differ in too many bits. Repeated rows and rows that share an id are rows of their own.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), "_row")
    groups = near.components(rows, "_row").join(rows.select("_row", order.alias("order")), "_row")
    kept = groups.groupBy("component").agg(F.min("order").alias("order")).select("order._row")
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; all documents stay."""
    safe = docs.withColumn("_text", secret_scan.scan(F.col("text"))["redacted"])
    return safe.withColumns({"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its place in the mixture of sources."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", known_language),
    ("near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
]

#: Hash fingerprints, a learned classifier and decoded keys are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has read or stored is deleted after it.

    All stages but the last return the columns of documents; further columns are dropped.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{number}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
