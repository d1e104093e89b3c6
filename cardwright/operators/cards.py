"""The card view: documents as cards of a catalogue, their labels as verdicts, and made-up scores in place of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(key: Column, salt: str = "") -> Column:
    """A number from 0 to 1 that depends on the key alone: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name and description of cards(). Labels, of which a document's second one would make a second card, are joined only
    if there are such: the join sends all texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL")
    single = labels.groupBy("doc_id").count().where("count > 1").isEmpty()
    return (_named(spark, sf_dir) if single else cards(spark, sf_dir)).select("id", "name", "description")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("description"), F.coalesce("lang", F.lit("")).alias("category"))
    return docs.withColumn("name", F.substring(F.substring_index("description", "\n", 1), 1, 70))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name (the first line, at most 70 characters), description, category, label (null: none). Null texts are empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic")
    return _named(spark, sf_dir).join(labels, "id", "left").select("id", "name", "description", "category", "label", "toxic")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, label, toxic and two scores, text and image, of four decimals (so with ties). No text is read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("category"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic")
    lift = F.coalesce(F.col("label"), F.lit(0)) * 0.25
    a, b = (F.round(unit(F.col("id"), s) * 0.75 + lift, 4) for s in ("text", "image"))
    return docs.join(labels, "id", "left").select("id", "category", "label", "toxic", a.alias("a"), b.alias("b"))
