"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.session import new_folder, shared_dir, staged, stepwise, unstage  # noqa: F401

#: Rows that Python works on at a time. Texts may be long, so there are few.
BATCH_ROWS = 256
#: A key is hot if it has more than this share of the rows; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3


def small(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """The batches, cut to so many rows: a lazy result runs under the caller's settings, which may send thousands."""
    for b in batches:
        for at in range(0, max(1, len(b)), rows):
            yield b.iloc[at : at + rows].reset_index(drop=True)


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers live on from task to task."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def named_texts(docs: DataFrame) -> DataFrame:
    """texts() with doc_id as a string, as it goes to Python: pandas would make ids floats beside nulls."""
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))


def numbered(named: DataFrame) -> DataFrame:
    """doc_id as a number again."""
    return named.withColumn("doc_id", F.col("doc_id").cast("long"))


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, row: Column) -> DataFrame:
    """left, with the columns of right (one row per key), or nulls.

    weight is right's number of left rows for the key. Keys beyond HOT_SHARE of total are at most 1 / HOT_SHARE rows,
    and these are broadcast; the others are joined by a shuffle. row tells left's rows apart; it spreads those which
    the broadcast has served, so that no partition gets all rows of one key.
    """
    more = [c for c in right.columns if c not in (key, weight)]
    bar = int(total * HOT_SHARE) + 1
    hot = right.where(F.col(weight) > bar).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in more])
    cold = right.where(F.col(weight) <= bar).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_key"), *more)
    spread = F.when(F.col("_hot"), F.concat(F.lit("#"), row.cast("string"))).otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))
    out = left.join(F.broadcast(hot), key, "left").withColumn("_key", spread).join(cold, "_key", "left")
    return out.select(*left.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in more])
