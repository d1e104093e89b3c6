"""Running sums, ranks, selection and curves, none of which gathers all rows of a category in one task.

A window over a category would. Here rows are dealt by ranges of (category, order), the sums of the ranges (as many as
partitions times categories) are added up, and a window runs only within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwright.session import staged


def running(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """df with before_<v> (the sum of v over the key's earlier rows) and total_<v> for each v. order must have no ties."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", *keys).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    so_far = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *keys, *[F.coalesce(F.sum(f"_s_{v}").over(so_far), F.lit(0)).alias(f"_b_{v}") for v in values], *[F.sum(f"_s_{v}").over(Window.partitionBy(*keys)).alias(f"total_{v}") for v in values])
    inner = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_w_{v}") for v in values])
    named = sums.withColumnsRenamed({k: f"_k_{k}" for k in ["_range", *keys]})
    same = local["_range"] == named["_k__range"]
    for k in keys:
        same = same & local[k].eqNullSafe(named[f"_k_{k}"])  # a null key is a key
    joined = local.join(named, same)
    return joined.select(*df.columns, *[(F.col(f"_b_{v}") + F.col(f"_w_{v}")).alias(f"before_{v}") for v in values], *[f"total_{v}" for v in values])


def tallied(df: DataFrame, keys: list[str], score: str, **sums: Column) -> DataFrame:
    """One row for each key and score, with running sums: n rows, and the given ones."""
    rows = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return running(rows, keys, [F.col(score).asc()], ["n", *sums])


def percentile_rank(df: DataFrame, keys: list[str], score: str, out: str) -> DataFrame:
    """df with out: the average rank of the score (ties share it), by the key's number of rows. Null scores get null."""
    t = tallied(df, keys, score).select(*keys, score, ((F.col("before_n") + (F.col("n") + 1) / 2) / F.col("total_n")).alias(out))
    return joined_on(df, t, [*keys, score], [out])


def joined_on(df: DataFrame, other: DataFrame, on: list[str], more: list[str]) -> DataFrame:
    """df, with the columns more of other, a row for each of the values on; null is a value."""
    named = other.select(*[F.col(c).alias(f"_o_{c}") for c in on], *more)
    same = df[on[0]].eqNullSafe(named[f"_o_{on[0]}"])
    for c in on[1:]:
        same = same & df[c].eqNullSafe(named[f"_o_{c}"])
    return df.join(named, same, "left").drop(*[f"_o_{c}" for c in on])


def rate_selected(df: DataFrame, keys: list[str], score: str, rate: float, out: str) -> DataFrame:
    """df with out: score >= the k-th largest of the key, k = max(1, rate * n rounded half to even). Ties select more."""
    t = tallied(df, keys, score)
    k = F.greatest(F.lit(1), F.bround(F.lit(rate) * F.col("total_n"), 0))
    bar = t.where(F.col("total_n") - F.col("before_n") >= k).groupBy(*keys).agg(F.max(score).alias("_bar"))
    return joined_on(df, bar, keys, ["_bar"]).withColumn(out, F.coalesce(F.col(score) >= F.col("_bar"), F.lit(False))).drop("_bar")


def top_fraction(df: DataFrame, keys: list[str], score: str, tie: str, fraction: float, out: str) -> DataFrame:
    """df with out: among the first ceil(fraction * n) by falling score, ties by the rising tie column."""
    t = running(df.withColumn("_one", F.lit(1)), keys, [F.col(score).desc_nulls_last(), F.col(tie).asc()], ["_one"])
    return t.withColumn(out, F.col("before__one") < F.ceil(F.lit(fraction) * F.col("total__one"))).drop("_one", "before__one", "total__one")


def quantile_map(df: DataFrame, ref: DataFrame, keys: list[str], score: str, out: str) -> DataFrame:
    """df with out: (reference scores below x + those up to x) / 2 / their number; without a reference 0.5."""
    both = df.select(*keys, score, F.lit(0).alias("_ref")).union(ref.select(*keys, score, F.lit(1)))
    t = tallied(both, keys, score, r=F.col("_ref"))
    at = F.when(F.col("total_r") > 0, (F.col("before_r") + F.col("r") / 2) / F.col("total_r")).otherwise(0.5)
    return joined_on(df, t.select(*keys, score, at.alias(out)), [*keys, score], [out])


def curves(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, n, positives, auc (ties count half) and ap (average precision, by steps); null where one class is absent."""
    t = tallied(df.where(F.col(label).isNotNull()), keys, score, p=F.col(label))
    neg, neg_before = F.col("n") - F.col("p"), F.col("before_n") - F.col("before_p")
    area = F.sum(F.col("p") * (neg_before + neg / 2))
    steps = F.sum(F.col("p") * (F.col("total_p") - F.col("before_p")) / (F.col("total_n") - F.col("before_n")))
    got = t.groupBy(*keys).agg(F.first("total_n").alias("n"), F.first("total_p").alias("positives"), area.alias("_area"), steps.alias("_steps"))
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return got.select(*keys, "n", "positives", F.when(mixed, F.round(F.col("_area") / (F.col("positives") * (F.col("n") - F.col("positives"))), 6)).alias("auc"), F.when(mixed, F.round(F.col("_steps") / F.col("positives"), 6)).alias("ap"))


def mean_of_decimals(score: str, digits: int) -> Column:
    """The mean of scores of so many decimals. They are added as whole numbers: a sum of doubles depends on the order of the
    rows, and so would the rounding of a mean that lies half way."""
    unit = 10**digits
    return F.sum(F.round(F.col(score) * unit).cast("long")) / (F.count(score) * unit)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where there is nothing to find and nothing found."""
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def sweep(df: DataFrame, keys: list[str], score: str, label: str, grid: list[float]) -> DataFrame:
    """keys, threshold, f1 for every threshold of the grid. Rows are counted by the thresholds they reach, then added up."""
    marks = F.array(*[F.lit(t) for t in grid])
    reach = df.where(F.col(label).isNotNull()).select(*keys, F.col(label).alias("_y"), F.size(F.filter(marks, lambda t: t <= F.col(score))).alias("_reach"))
    steps = reach.groupBy(*keys, "_reach").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    each = steps.select(*keys, "_n", "_p", "_reach", F.posexplode(marks).alias("_at", "threshold"))
    hit = F.col("_reach") > F.col("_at")
    got = each.groupBy(*keys, "threshold").agg(F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("_p"))).alias("fn"))
    return got.select(*keys, "threshold", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def best_threshold(swept: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold, f1: the greatest f1, of equal ones the smallest threshold."""
    return swept.groupBy(*keys).agg(F.max(F.struct(F.col("f1"), -F.col("threshold"))).alias("m")).select(*keys, (-F.col("m.col2")).alias("threshold"), F.round("m.f1", 6).alias("f1"))


def quantiles(df: DataFrame, keys: list[str], score: str, points: list[float]) -> DataFrame:
    """keys, point, value: linear between the neighbours by rank. Equal scores are counted, and no task sees all of them."""
    t = tallied(df, keys, score)
    marks = F.array(*[F.struct(F.lit(float(p)).alias("point"), (F.lit(float(p)) * (F.col("total_n") - 1)).alias("at")) for p in points])
    ends = t.select(*keys, F.col(score).alias("_x"), "before_n", "n", F.explode(marks).alias("_m")).select("*", F.floor("_m.at").alias("_low"), F.ceil("_m.at").alias("_high"))
    inside = lambda c: (F.col(c) >= F.col("before_n")) & (F.col(c) < F.col("before_n") + F.col("n"))
    ends = ends.where(inside("_low") | inside("_high"))
    both = ends.groupBy(*keys, F.col("_m.point").alias("point")).agg(F.max(F.when(inside("_low"), F.col("_x"))).alias("_a"), F.max(F.when(inside("_high"), F.col("_x"))).alias("_b"), F.first(F.col("_m.at") - F.col("_low")).alias("_t"))
    return both.select(*keys, "point", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("value"))
