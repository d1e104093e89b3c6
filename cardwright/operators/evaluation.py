"""Measures of scores and verdicts: F1 in its variants, threshold choice on other rows than those judged, recall at a rate,
gates, and mixtures of scores. Counts are summed before anything is divided, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwright.operators import ranking as R


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return R.f1(tp, fp, fn)


def confusion(df: DataFrame, keys: list[str], label: str, verdict: str) -> DataFrame:
    """keys, tp, fp, fn, tn of labelled rows."""
    y, v = F.col(label), F.col(verdict)
    return df.where(y.isNotNull()).groupBy(*keys).agg(F.sum(y * v).alias("tp"), F.sum((1 - y) * v).alias("fp"), F.sum(y * (1 - v)).alias("fn"), F.sum((1 - y) * (1 - v)).alias("tn"))


def f1_scores(counts: DataFrame, key: str, mean: str = "mean") -> DataFrame:
    """key, f1 (of class 1), macro (mean of both classes'); and a row with the means over keys."""
    each = counts.select(key, f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), ((f1(F.col("tp"), F.col("fp"), F.col("fn")) + f1(F.col("tn"), F.col("fn"), F.col("fp"))) / 2).alias("macro"))
    return each.unionByName(each.agg(F.avg("f1").alias("f1"), F.avg("macro").alias("macro")).withColumn(key, F.lit(mean)))


def prior_weights(df: DataFrame, keys: list[str], label: str, share: float) -> DataFrame:
    """keys, weight of a negative: so that positives have the given share; 1 where a class is absent."""
    c = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    return c.select(*keys, F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_p") * (1 - share) / (share * F.col("_q"))).otherwise(1.0).alias("negative_weight"))


def swept_counts(df: DataFrame, keys: list[str], score: str, label: str, grid: list[float]) -> DataFrame:
    """keys, threshold, tp, fp, fn for every threshold of the grid."""
    marks = F.array(*[F.lit(t) for t in grid])
    reach = df.where(F.col(label).isNotNull()).select(*keys, F.col(label).alias("_y"), F.size(F.filter(marks, lambda t: t <= F.col(score))).alias("_reach"))
    steps = reach.groupBy(*keys, "_reach").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    each = steps.select(*keys, "_n", "_p", "_reach", F.posexplode(marks).alias("_at", "threshold"))
    hit = F.col("_reach") > F.col("_at")
    return each.groupBy(*keys, "threshold").agg(F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("_p"))).alias("fn"))


def best(swept: DataFrame, keys: list[str], *order: str, value: str = "f1") -> DataFrame:
    """Of each key the row with the greatest value (nine decimals count), of equal ones that with the least of order."""
    pick = F.min(F.struct(-F.round(value, 9), *order, F.col(value).alias("_value"))).alias("_m")
    return swept.groupBy(*keys).agg(pick).select(*keys, *[f"_m.{c}" for c in order], F.col("_m._value").alias(value))


def crossfit(df: DataFrame, key: str, fold: str, score: str, label: str, grid: list[float]) -> DataFrame:
    """key, fold, threshold: chosen on the other folds of the key; none where these have one class only. The sums of the
    others are all sums less the fold's own, so no fold is read twice."""
    own = swept_counts(df, [key, fold], score, label, grid)
    every = Window.partitionBy(key, "threshold")
    rest = own.select(key, fold, "threshold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    n = df.where(F.col(label).isNotNull()).groupBy(key, fold).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    both = Window.partitionBy(key)
    usable = n.select(key, fold, ((F.sum("_p").over(both) > F.col("_p")) & (F.sum("_q").over(both) > F.col("_q"))).alias("_two")).where("_two").drop("_two")
    scored = rest.join(usable, [key, fold]).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return best(scored, [key, fold], "threshold").select(key, fold, "threshold")


def applied(df: DataFrame, thresholds: DataFrame, keys: list[str], score: str, out: str) -> DataFrame:
    """df with out: 1 where the score reaches the keys' threshold, 0 also where there is none."""
    return df.join(thresholds, keys, "left").withColumn(out, F.coalesce((F.col(score) >= F.col("threshold")).cast("int"), F.lit(0)))


def selected_by_threshold(df: DataFrame, key: str, score: str, thresholds: dict[str, float], out: str) -> DataFrame:
    """df with out: score >= the key's threshold; a key without one is an error."""
    table = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    bar = F.coalesce(F.try_element_at(table, F.col(key)), F.raise_error(F.concat(F.lit("no threshold for "), F.col(key))).cast("double"))
    return df.withColumn(out, F.col(score) >= bar)


def taken_by_weight(df: DataFrame, keys: list[str], score: str, tie: str, weight: str, rate: float) -> DataFrame:
    """df with taken: by falling score, while the weights so far are at most rate of all; the first row always."""
    t = R.running(df, keys, [F.col(score).desc_nulls_last(), F.col(tie).asc()], [weight])
    return t.withColumn("taken", (F.col(f"before_{weight}") == 0) | (F.col(f"before_{weight}") + F.col(weight) <= rate * F.col(f"total_{weight}")))


def ranked(df: DataFrame, keys: list[str], score: str, tie: str, out: str = "rank") -> DataFrame:
    """df with out: 1 for the greatest score, ties by rising tie; and n, the key's rows."""
    t = R.running(df.withColumn("_one", F.lit(1)), keys, [F.col(score).desc_nulls_last(), F.col(tie).asc()], ["_one"])
    return t.withColumns({out: F.col("before__one") + 1, "n": F.col("total__one")}).drop("_one", "before__one", "total__one")


def half_even(share: float, n: Column) -> Column:
    """At least 1."""
    return F.greatest(F.lit(1), F.bround(F.lit(share) * n, 0).cast("long"))


def judged(df: DataFrame, key: str, model: str, judge: str, tie: str, weight: float, rate: float, least: int = 50) -> DataFrame:
    """key, n, k, moved, ok: how many of the top k by the model's rank leave it as the judge's rank is mixed in. Not ok is
    a judge that moves none of them in a key of so many rows."""
    r = R.percentile_rank(R.percentile_rank(df, [key], model, "_rm"), [key], judge, "_rj")
    r = r.withColumn("_mix", F.round((1 - weight) * F.col("_rm") + weight * F.col("_rj"), 12)).select(key, tie, model, "_mix")
    r = ranked(ranked(r, [key], model, tie, "_before"), [key], "_mix", tie, "_after")
    k = half_even(rate, F.col("n"))
    out = r.groupBy(key).agg(F.max("n").alias("n"), F.max(k).alias("k"), F.count_if((F.col("_after") <= k) & (F.col("_before") > k)).alias("moved"))
    return out.withColumn("ok", (F.col("moved") > 0) | (F.col("n") < least))


def chosen_step(checkpoints: DataFrame, key: str, eps: float = 1e-6) -> DataFrame:
    """key, step of the checkpoint (key, step, sel, f1) that no later one beats: by sel, and if that is tied, by f1."""
    each = checkpoints.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "sel", "f1"))).alias("all"))  # some hundred checkpoints

    def beat(held: Column, now: Column) -> Column:
        return F.when((now["sel"] > held["sel"] + eps) | ((F.abs(now["sel"] - held["sel"]) <= eps) & (now["f1"] > held["f1"] + eps)), now).otherwise(held)

    return each.select(key, F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], beat)["step"].alias("step"))


def gated(shares: DataFrame, limit: float, what: str) -> DataFrame:
    """shares (one row, column share), or an error where the share is beyond the limit."""
    found = shares.first()
    if found is not None and found["share"] is not None and found["share"] > limit:
        raise ValueError(f"{what}: {found['share']:.4f} is more than {limit}")
    return shares
