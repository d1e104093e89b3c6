"""Folds that keep groups together, holdouts, and samples. Random draws are orders by md5(id + seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.operators import ranking as R
from cardwright.session import staged, stepwise


def drawn(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def dealt(counts: list[tuple[str, int, int]], folds: int) -> list[tuple[str, int, int, int, list[int]]]:
    """Deal groups to folds: stratum by stratum in order, large groups first, each to the fold with the least of its
    stratum, then the least of all, then the first.

    counts: stratum, size, number of groups of that size. Groups of one size are alike, so runs of them are dealt at once:
    stratum, size, rank of the first, number, and the folds that the run goes through in turn.
    """
    total, out = [0] * folds, []
    for stratum in sorted({s for s, _, _ in counts}):
        own = [0] * folds
        for size, number in sorted(((n, c) for s, n, c in counts if s == stratum), reverse=True):
            rank = 0
            while rank < number:
                turn: list[int] = []
                mine, all_ = own[:], total[:]
                while True:
                    f = min(range(folds), key=lambda i: (mine[i], all_[i], i))
                    if f in turn:
                        break
                    turn.append(f)
                    mine[f] += size
                    all_[f] += size
                others = [own[i] for i in range(folds) if i not in turn]
                # the turn repeats as it is for as long as no other fold gets to be the least
                rounds = max(1, (min(others) - 1 - max(own[i] for i in turn)) // size) if others else -(-(number - rank) // len(turn))
                many = min(number - rank, rounds * len(turn))
                out.append((stratum, size, rank, many, turn))
                for i, f in enumerate(turn):
                    got = (many - i + len(turn) - 1) // len(turn)
                    own[f] += got * size
                    total[f] += got * size
                rank += many
    return out


@stepwise
def group_folds(df: DataFrame, id_: str, group: str, strata: list[str], folds: int, seed: str) -> DataFrame:
    """group, fold. A group's stratum is its most frequent one, of equal ones that with the least id.

    The driver gets the number of groups by stratum and size, not the groups; it deals runs of equal ones (dealt), and each
    group finds its run by its rank. So the outcome is that of dealing group by group, and nothing is gathered.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in strata])
    each = df.groupBy(group, key.alias("_key")).agg(F.count("*").alias("_n"), F.min(id_).alias("_first"))
    one = each.groupBy(group).agg(F.min(F.struct(-F.col("_n"), "_first", "_key")).alias("_m"), F.sum("_n").alias("_size"))
    one = staged(one.select(group, F.col("_m._key").alias("_key"), "_size", F.lit(1).alias("_one"), drawn(F.col(group), seed).alias("_h")), "groups")
    plan = dealt([(r["_key"], r["_size"], r["count"]) for r in one.groupBy("_key", "_size").count().collect()], folds)  # a row per stratum and size
    if not plan:
        return one.select(group, F.lit(0).alias("fold"))
    runs = df.sparkSession.createDataFrame(plan, "_key string, _size long, _from long, _many long, _turn array<int>")
    placed = R.running(one, ["_key", "_size"], [F.col("_h"), F.col(group)], ["_one"]).withColumnRenamed("before__one", "_rank")
    hit = placed.join(F.broadcast(runs), ["_key", "_size"]).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_many")))
    return hit.select(group, F.element_at("_turn", ((F.col("_rank") - F.col("_from")) % F.size("_turn") + 1).cast("int")).alias("fold"))


def holdout_folds(share: float) -> int:
    """Fold 0 of so many is the holdout."""
    return max(2, round(1 / share))


def sampled(df: DataFrame, id_: str, keys: list[str], seed: str) -> DataFrame:
    """df with rank (from 0, by the draw) and n among the rows of equal keys."""
    t = R.running(df.withColumns({"_one": F.lit(1), "_h": drawn(F.col(id_), seed)}), keys, [F.col("_h"), F.col(id_)], ["_one"])
    return t.withColumns({"rank": F.col("before__one"), "n": F.col("total__one")}).drop("_one", "_h", "before__one", "total__one")


def class_sizes(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))


def downsampled(df: DataFrame, id_: str, key: str, label: str, per_positive: float, seed: str) -> DataFrame:
    """All positives and per_positive times as many negatives of the key."""
    r = sampled(df, id_, [key, label], seed).join(class_sizes(df, key, label), key)
    return r.where((F.col(label) == 1) | (F.col("rank") < F.floor(F.col("n_pos") * per_positive))).select(*df.columns)


def balanced(df: DataFrame, id_: str, key: str, label: str, rare: list[str], per_positive: float, balance: float, seed: str, most: int | None = None, only: str | None = None, everything: bool = False) -> DataFrame:
    """Rows to train on: of a rare key all positives and per_positive times as many negatives; of another balance times as
    many negatives as positives, and as many positives as negatives are taken. most: the first of the draw. only: one key."""
    rows = df.where(F.col(key) == only) if only is not None else df
    if not everything:
        r = sampled(rows, id_, [key, label], seed).join(class_sizes(rows, key, label), key)
        is_rare = F.col(key).isin(*rare)
        n_neg = F.least(F.col("n_neg"), F.floor(F.col("n_pos") * F.when(is_rare, per_positive).otherwise(balance)))
        n_pos = F.when(is_rare, F.col("n_pos")).otherwise(F.least(F.col("n_pos"), F.greatest(n_neg, F.lit(1))))
        rows = r.where(F.col("rank") < F.when(F.col(label) == 1, n_pos).otherwise(n_neg)).select(*df.columns)
    return rows if most is None else rows.orderBy(drawn(F.col(id_), seed), id_).limit(most)


def carved(df: DataFrame, id_: str, key: str, label: str, n_pos: int, n_neg: int, seed: str) -> DataFrame:
    """A validation set: so many rows of each (key, label) with cell_weight, how many rows each of them stands for."""
    want = F.when(F.col(label) == 1, n_pos).otherwise(n_neg)
    r = sampled(df.where(F.col(label).isNotNull()), id_, [key, label], seed).where(F.col("rank") < want)
    return r.withColumn("cell_weight", F.col("n") / F.least(F.col("n"), want)).drop("rank", "n")


def cell_shares(df: DataFrame, key: str, label: str, alpha: float) -> DataFrame:
    """key, label, n, share: how often a cell is drawn, as its size to the power of alpha; 0 draws all cells alike."""
    cells = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum(F.pow("n", F.lit(alpha))).alias("_all"))
    return cells.join(F.broadcast(total)).select(key, label, "n", (F.pow("n", F.lit(alpha)) / F.col("_all")).alias("share"))


def roles(fold: Column, exam: int, folds: int = 5, inner: int | None = None, probe: int = 2) -> Column:
    """What a row is for: exam, inner (validation), probe or train."""
    inside, probed = (exam + 1) % folds if inner is None else inner, (exam + probe) % folds
    if len({exam, inside, probed}) < 3:
        raise ValueError("exam, inner and probe folds must differ")
    return F.when(fold == exam, "exam").when(fold == inside, "inner").when(fold == probed, "probe").otherwise("train")


def shortened(text: Column, id_: Column, limit: int, jitter: float, seed: str) -> Column:
    """At most limit characters, less a share of up to jitter of them that depends on the id."""
    share = F.conv(F.substring(drawn(id_, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.substring(text, F.lit(1), F.floor(limit * (1 - share * jitter)).cast("int"))
