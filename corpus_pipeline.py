"""A corpus, made ready for training: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes the documents that the one before has kept. Null texts go with the first stage, as they have no
language. Rows without a doc_id and rows that repeat one are documents like any other: the second stage groups rows, and
of each group that row stays which is first by doc_id (null last), then by a hash of its text. All stages but the last
return the columns of documents, extra ones included; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm import decontamination, jaccard, language, packing, pii
from cardwright.session import staged, stepwise

#: Words that a packing worker remembers: fewer than by itself, as the stages before have left the JVM large.
WORDS = 200_000
#: SQL can't express the trained and hashed stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects."""
    model = language.fitted(docs)
    judged = language.identify(docs.select("*", F.struct("*").alias("_row")), model)
    return judged.where(~F.col("rejected")).select("_row.*")


@stepwise
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        groups = staged(jaccard.linked(docs), "near-duplicates")
        others = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_other"))
        return docs.join(others, docs["doc_id"] == others["_other"], "left_anti")
    row = "_row"
    while row in docs.columns:
        row += "_"
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard.linked(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("_of"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", F.xxhash64("text").alias("b"), F.col(row).alias("row"))
    kept = docs.join(groups, F.col(row) == F.col("_of")).groupBy("_group").agg(F.min(order).alias("_m")).select(F.col("_m.row").alias("_kept"))
    return docs.join(staged(kept, "kept"), F.col(row) == F.col("_kept"), "left_semi").drop(row)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.flagged(docs, items, "_leaked").where(~F.col("_leaked")).drop("_leaked")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, with_ids=False, remembered=WORDS)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
