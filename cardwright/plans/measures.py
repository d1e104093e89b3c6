"""Queries on folds, samples, thresholds, measures, mixtures of scores, and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwright.operators import evaluation as E
from cardwright.operators import models as M
from cardwright.operators import ranking as R
from cardwright.operators import splits as P
from cardwright.operators.cards import cards, scored, unit
from cardwright.plans.catalog import ANSWERS, GRID, SCORED, UNIT, _RANK, answers, query
from cardwright.plans.goods import GOODS, goods
from cardwright.session import staged
from cardwright.sources import tables as S

LABELLED = "s AS (SELECT * FROM scored WHERE label IS NOT NULL)"
_F1 = lambda tp, fp, fn: f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn})::DOUBLE ELSE 0 END"
#: Groups for folds: documents of one text.
EQUAL = "eg AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS grp FROM documents)"
_DRAW = lambda seed: f"md5(CAST(id AS VARCHAR) || '{seed}')"
FOLD = "CAST('0x' || substr(md5(CAST(grp AS VARCHAR) || 'fold'), 1, 6) AS BIGINT) % 5"


def labelled(spark, sf) -> DataFrame:
    return scored(spark, sf).where("label IS NOT NULL")


def grouped(spark, sf) -> DataFrame:
    """id, grp: the least id of the documents with the same text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("id").alias("grp")), "h").select("id", "grp")


def folded(spark, sf) -> DataFrame:
    """Labelled rows with grp and a fold that depends on it alone."""
    fold = F.conv(F.substring(F.md5(F.concat(F.col("grp").cast("string"), F.lit("fold"))), 1, 6), 16, 10).cast("long") % 5
    return labelled(spark, sf).join(grouped(spark, sf), "id").withColumn("fold", fold)


# folds and samples

_DEALT = f"""{SCORED}, {EQUAL}, m AS (SELECT grp, category || '|' || coalesce(CAST(label AS VARCHAR), 'None') AS key, s.id FROM scored s JOIN eg ON s.id = eg.id),
 c AS (SELECT grp, key, count(*) AS n, min(id) AS first FROM m GROUP BY grp, key), o AS (SELECT grp, arg_min(key, (-n, first, key)) AS key, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY grp),
 t AS (SELECT *, row_number() OVER (ORDER BY key, size DESC, md5(CAST(grp AS VARCHAR) || '42'), grp) AS i FROM o)"""


def _walk(folds: int) -> str:
    pick = "list_sort(list_transform(range(1, {n} + 1), lambda f: {{'a': CASE WHEN t.key = w.key THEN w.own[f] ELSE 0 END, 'b': w.total[f], 'f': f}}))[1].f".format(n=folds)
    return f"""w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS grp, CAST('' AS VARCHAR) AS key, CAST(0 AS BIGINT) AS f, list_transform(range({folds}), lambda x: CAST(0 AS BIGINT)) AS own, list_transform(range({folds}), lambda x: CAST(0 AS BIGINT)) AS total
 UNION ALL SELECT i, grp, key, f, list_transform(range(1, {folds} + 1), lambda x: CASE WHEN fresh THEN 0 ELSE own[x] END + CASE WHEN x = f THEN size ELSE 0 END), list_transform(range(1, {folds} + 1), lambda x: total[x] + CASE WHEN x = f THEN size ELSE 0 END)
  FROM (SELECT t.i, t.grp, t.key, t.size, t.key <> w.key AS fresh, w.own, w.total, {pick} AS f FROM w JOIN t ON t.i = w.i + 1))"""


@query("g12_group_folds", f"WITH RECURSIVE {_DEALT}, {_walk(5)} SELECT eg.id, eg.grp, CAST(f - 1 AS INTEGER) AS fold FROM eg JOIN w ON eg.grp = w.grp")
def g12_group_folds(spark, sf):
    g = grouped(spark, sf)
    folds = P.group_folds(scored(spark, sf).join(g, "id"), "id", "grp", ["category", "label"], 5, "42")
    return g.join(folds, "grp").select("id", "grp", "fold")


@query("g13_holdout", f"WITH RECURSIVE {_DEALT}, {_walk(4)} SELECT eg.id, f = 1 AS held FROM eg JOIN w ON eg.grp = w.grp")
def g13_holdout(spark, sf):
    g = grouped(spark, sf)
    folds = P.group_folds(scored(spark, sf).join(g, "id"), "id", "grp", ["category", "label"], P.holdout_folds(0.25), "42")
    return g.join(folds, "grp").select("id", (F.col("fold") == 0).alias("held"))


_SIZES = "z AS (SELECT category, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM s GROUP BY category)"
_ORDERED = lambda seed: f"r AS (SELECT s.id, s.category, s.label, row_number() OVER (PARTITION BY category, label ORDER BY {_DRAW(seed)}, id) - 1 AS rank, count(*) OVER (PARTITION BY category, label) AS n FROM s)"


@query("m01_downsampled", f"WITH {SCORED}, {LABELLED}, {_SIZES}, {_ORDERED('seed')} SELECT id, category, label FROM r JOIN z USING (category) WHERE label = 1 OR rank < n_pos * 2")
def m01_downsampled(spark, sf):
    return P.downsampled(labelled(spark, sf).select("id", "category", "label"), "id", "category", "label", 2, "seed")


@query("m02_balanced", f"""WITH {SCORED}, {LABELLED}, {_SIZES}, {_ORDERED('sft')}, k AS (SELECT r.*, n_pos, least(n_neg, floor(n_pos * CASE WHEN category IN ('fr', 'es') THEN 0.5::DOUBLE ELSE 1.0 END)) AS take_neg FROM r JOIN z USING (category)),
 p AS (SELECT id, category, label FROM k WHERE rank < CASE WHEN label = 0 THEN take_neg WHEN category IN ('fr', 'es') THEN n_pos ELSE least(n_pos, greatest(take_neg, 1)) END) SELECT id, category, label FROM p ORDER BY {_DRAW('sft')}, id LIMIT 200""")
def m02_balanced(spark, sf):
    return P.balanced(labelled(spark, sf).select("id", "category", "label"), "id", "category", "label", ["fr", "es"], 0.5, 1.0, "sft", most=200)


@query("m02_one_category", f"WITH {SCORED}, {LABELLED} SELECT id, category, label FROM s WHERE category = 'en'")
def m02_one_category(spark, sf):
    return P.balanced(labelled(spark, sf).select("id", "category", "label"), "id", "category", "label", [], 1.0, 1.0, "sft", only="en", everything=True)


_CARVED = f"{_ORDERED('carve')}, v AS (SELECT id, category, label, n / least(n, CASE WHEN label = 1 THEN 30 ELSE 12 END)::DOUBLE AS cell_weight FROM r WHERE rank < CASE WHEN label = 1 THEN 30 ELSE 12 END)"


def _carved(spark, sf):
    return P.carved(scored(spark, sf), "id", "category", "label", 30, 12, "carve")


@query("m03_carved", f"WITH {SCORED}, {LABELLED}, {_CARVED} SELECT id, category, label, round(cell_weight, 6) AS cell_weight FROM v")
def m03_carved(spark, sf):
    return _carved(spark, sf).select("id", "category", "label", F.round("cell_weight", 6).alias("cell_weight"))


@query("m04_cell_shares", f"WITH {SCORED}, {LABELLED}, c AS (SELECT category, label, count(*) AS n FROM s GROUP BY category, label) SELECT category, label, n, round(pow(n, 0.5::DOUBLE) / sum(pow(n, 0.5::DOUBLE)) OVER (), 6) AS tempered, round(1 / count(*) OVER ()::DOUBLE, 6) AS alike FROM c")
def m04_cell_shares(spark, sf):
    s = labelled(spark, sf).select("category", "label")
    alike = P.cell_shares(s, "category", "label", 0.0).select("category", "label", F.round("share", 6).alias("alike"))
    return P.cell_shares(s, "category", "label", 0.5).select("category", "label", "n", F.round("share", 6).alias("tempered")).join(alike, ["category", "label"])


@query("m05_fold_halves", f"WITH {SCORED}, {LABELLED}, {EQUAL} SELECT s.id, {FOLD} AS fold, ({FOLD}) % 2 = 0 AS tunes FROM s JOIN eg ON s.id = eg.id")
def m05_fold_halves(spark, sf):
    return folded(spark, sf).select("id", "fold", (F.col("fold") % 2 == 0).alias("tunes"))


@query("m06_roles", f"WITH {SCORED}, {LABELLED}, {EQUAL} SELECT s.id, CASE {FOLD} WHEN 4 THEN 'exam' WHEN 0 THEN 'inner' WHEN 1 THEN 'probe' ELSE 'train' END AS role FROM s JOIN eg ON s.id = eg.id")
def m06_roles(spark, sf):
    return folded(spark, sf).select("id", P.roles(F.col("fold"), 4).alias("role"))


@query("m07_shortened", f"SELECT doc_id AS id, substr(coalesce(text, ''), 1, CAST(floor(800 * (1 - {UNIT.format('doc_id', 'jitter')} * 0.3::DOUBLE)) AS BIGINT)) AS text FROM documents")
def m07_shortened(spark, sf):
    return cards(spark, sf).select("id", P.shortened(F.col("description"), F.col("id"), 800, 0.3, "jitter").alias("text"))


# measures

_TRUTH = f"{SCORED}, {LABELLED}, t AS (SELECT category, label AS y, CAST(a >= 0.5 AS INTEGER) AS v FROM s), c AS (SELECT category, sum(y * v) AS tp, sum((1 - y) * v) AS fp, sum(y * (1 - v)) AS fn, sum((1 - y) * (1 - v)) AS tn FROM t GROUP BY category), f AS (SELECT category, {_F1('tp', 'fp', 'fn')} AS f1, ({_F1('tp', 'fp', 'fn')} + {_F1('tn', 'fn', 'fp')}) / 2 AS macro FROM c)"


@query("a12_mean_f1", f"WITH {_TRUTH} SELECT category, round(f1, 6) AS f1, round(macro, 6) AS macro FROM f UNION ALL SELECT 'mean', round(avg(f1), 6), round(avg(macro), 6) FROM f")
def a12_mean_f1(spark, sf):
    counts = E.confusion(scored(spark, sf).withColumn("v", (F.col("a") >= 0.5).cast("int")), ["category"], "label", "v")
    return E.f1_scores(counts, "category").select("category", F.round("f1", 6).alias("f1"), F.round("macro", 6).alias("macro"))


_PRIOR = "z AS (SELECT category, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN sum(label) * 0.9::DOUBLE / (0.1::DOUBLE * sum(1 - label)) ELSE 1 END AS w FROM s GROUP BY category)"


@query("a13_weighted_f1", f"WITH {_TRUTH}, {_PRIOR} SELECT category, round({_F1('tp', 'fp * w', 'fn')}, 6) AS f1 FROM c JOIN z USING (category)")
def a13_weighted_f1(spark, sf):
    s = scored(spark, sf).withColumn("v", (F.col("a") >= 0.5).cast("int"))
    c = E.confusion(s, ["category"], "label", "v").join(E.prior_weights(s, ["category"], "label", 0.1), "category")
    return c.select("category", F.round(E.f1(F.col("tp"), F.col("fp") * F.col("negative_weight"), F.col("fn")), 6).alias("f1"))


@query("a15_answer_stats", f"WITH {ANSWERS} SELECT count(*) AS n, min(length(comment)) AS least, median(length(comment)) AS middle, max(length(comment)) AS most, round(avg(CAST(verdict = 'не бан' AS INTEGER)), 6) AS kept FROM answers")
def a15_answer_stats(spark, sf):
    a = answers(spark, sf).select(F.length("comment").cast("long").alias("n_chars"), "verdict", F.lit(0).alias("k"))
    middle = R.quantiles(a, ["k"], "n_chars", [0.5]).select("k", F.col("value").alias("middle"))
    plain = a.groupBy("k").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg((F.col("verdict") == "не бан").cast("int")), 6).alias("kept"))
    return plain.join(middle, "k").select("n", "least", "middle", "most", "kept")


_SPOILT = f"""{ANSWERS}, sp AS (SELECT c.id, CASE WHEN c.label IS NULL AND c.category = 'fr' THEN NULL WHEN c.category = 'es' THEN 'plain text' WHEN c.category = 'de' AND c.label = 1 THEN result || '!' WHEN c.label = 0 THEN '<комментарий>short<вердикт>бан' ELSE result END AS result, c.toxic FROM cards c JOIN answers a ON c.id = a.id),
 r AS (SELECT id, result FROM sp UNION ALL SELECT id, result FROM sp WHERE toxic = 1), g AS (SELECT id, count(*) AS n FROM r GROUP BY id), k AS (SELECT *, coalesce(regexp_matches(result, '(?s)^<комментарий>.*<вердикт>.*$'), false) AS formed FROM r),
 x AS (SELECT formed, result, regexp_extract(result, '(?s)^<комментарий>(.*)<вердикт>(.*)$', 1) AS said, regexp_extract(result, '(?s)^<комментарий>(.*)<вердикт>(.*)$', 2) AS verdict FROM k)"""


@query("a16_validation", f"WITH {_SPOILT} SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM g) AS n_duplicate, count(*) FILTER (result IS NULL) AS n_null, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM r)) AS n_missing, (SELECT count(*) FROM g WHERE id NOT IN (SELECT vec_id FROM embeddings)) AS n_extra, count(*) FILTER (NOT formed) AS n_shape, count(*) FILTER (formed AND verdict NOT IN ('бан', 'не бан')) AS n_verdict, count(*) FILTER (formed AND length(said) NOT BETWEEN 50 AND 300) AS n_length FROM x")
def a16_validation(spark, sf):
    """Answers with planted faults."""
    both = cards(spark, sf).select("id", "category", "label", "toxic").join(answers(spark, sf).select("id", "result"), "id")
    label, category = F.col("label"), F.col("category")
    bad = F.when(label.isNull() & (category == "fr"), None).when(category == "es", "plain text").when((category == "de") & (label == 1), F.concat("result", F.lit("!"))).when(label == 0, "<комментарий>short<вердикт>бан").otherwise(F.col("result"))
    spoilt = both.select("id", bad.alias("result"), F.explode(F.when(F.col("toxic") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return S.faults(spoilt.select("id", "result"), spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id")))


_MARKS = "grid AS (SELECT CAST(round(0.01 + 0.005 * k, 3) AS DOUBLE) AS threshold FROM range(197) x(k))"
_SWEPT = lambda rows, keys: f"sw AS (SELECT {keys}, threshold, sum(CASE WHEN a >= threshold THEN label ELSE 0 END) AS tp, sum(CASE WHEN a >= threshold THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN a >= threshold THEN 0 ELSE label END) AS fn FROM {rows}, grid GROUP BY {keys}, threshold), sf AS (SELECT {keys}, threshold, tp, fp, fn, {_F1('tp', 'fp', 'fn')} AS f1 FROM sw)"
_SEEDS = f"sd AS (SELECT s.category, s.label, k AS seed, round(CAST('0x' || substr(md5(CAST(s.id AS VARCHAR) || 'seed' || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE * 0.75::DOUBLE + s.label * 0.25::DOUBLE, 4) AS a FROM s, range(1, 4) x(k))"


@query("a17_seed_means", f"WITH {SCORED}, {LABELLED}, {_SEEDS}, {_MARKS}, {_SWEPT('sd', 'category, seed')}, b AS (SELECT category, seed, arg_min(threshold, (-round(f1, 9), threshold)) AS threshold, max(f1) AS f1 FROM sf GROUP BY category, seed) SELECT category, round(avg(f1), 6) AS f1, round(max(f1) - min(f1), 6) AS spread, median(threshold) AS threshold FROM b GROUP BY category")
def a17_seed_means(spark, sf):
    s = labelled(spark, sf).select("id", "category", "label", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("seed"))
    h = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("seed"), F.col("seed").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    s = s.withColumn("a", F.round(h * 0.75 + F.col("label") * 0.25, 4))
    best = E.best(R.sweep(s, ["category", "seed"], "a", "label", GRID), ["category", "seed"], "threshold")
    return best.groupBy("category").agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.max("f1") - F.min("f1"), 6).alias("spread"), F.median("threshold").alias("threshold"))


@query("a18_ensemble", f"WITH {SCORED} SELECT id, round((a + b + (a + b) / 2) / 3, 6) AS score FROM scored")
def a18_ensemble(spark, sf):
    each = scored(spark, sf).select("id", F.explode(F.array("a", "b", (F.col("a") + F.col("b")) / 2)).alias("x"))
    return each.groupBy("id").agg(F.round(F.avg("x"), 6).alias("score"))


@query("a19_gates", f"WITH {SCORED}, g AS (SELECT 'empty' AS gate, avg(CAST(trim(coalesce(text, '')) = '' AS INTEGER)) AS share, 0.9::DOUBLE AS bar, count(*) AS n, 0 AS least FROM documents UNION ALL SELECT 'failed', avg(CAST(label IS NULL AS INTEGER)), 0.05, count(*), 0 FROM scored UNION ALL SELECT 'fallback', avg(CAST(a < 0.3 AS INTEGER)), 0.5, count(*), 50 FROM scored) SELECT gate, round(share, 6) AS share, n, NOT (share > bar AND n >= least) AS ok FROM g")
def a19_gates(spark, sf):
    """Shares of bad rows and whether they pass; evaluation.gated() raises where they don't."""
    share = lambda df, test, name, bar, least: df.agg(F.avg(test.cast("int")).alias("share"), F.count("*").alias("n")).select(F.lit(name).alias("gate"), F.round("share", 6).alias("share"), "n", (~((F.col("share") > bar) & (F.col("n") >= least))).alias("ok"))
    s = scored(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.trim(F.coalesce("text", F.lit(""))).alias("t"))
    return share(docs, F.col("t") == "", "empty", 0.9, 0).union(share(s, F.col("label").isNull(), "failed", 0.05, 0)).union(share(s, F.col("a") < 0.3, "fallback", 0.5, 50))


@query("a21_natural_share", f"WITH {SCORED}, {LABELLED}, {_CARVED} SELECT category, round(sum(label * cell_weight) / sum(cell_weight), 6) AS share, sum(label * cell_weight) / sum(cell_weight) > 0.001 AND sum(label * cell_weight) / sum(cell_weight) < 0.95 AS plausible FROM v GROUP BY category")
def a21_natural_share(spark, sf):
    share = F.sum(F.col("label") * F.col("cell_weight")) / F.sum("cell_weight")
    return _carved(spark, sf).groupBy("category").agg(share.alias("x")).select("category", F.round("x", 6).alias("share"), ((F.col("x") > 0.001) & (F.col("x") < 0.95)).alias("plausible"))


@query("a22_focal_mean", f"WITH {SCORED}, {LABELLED}, c AS (SELECT category, label, avg(pow(1 - a, 2) * a) AS m FROM s GROUP BY category, label) SELECT round(avg(m), 6) AS focal FROM c")
def a22_focal_mean(spark, sf):
    return labelled(spark, sf).groupBy("category", "label").agg(F.avg(F.pow(1 - F.col("a"), F.lit(2)) * F.col("a")).alias("m")).agg(F.round(F.avg("m"), 6).alias("focal"))


@query("a23_unscored", f"WITH {SCORED}, u AS (SELECT s.category, CASE WHEN v.vec_id IS NULL THEN NULL ELSE a END AS a FROM scored s LEFT JOIN embeddings v ON v.vec_id = s.id) SELECT category, count(*) AS n, round(avg(CAST(a IS NULL AS INTEGER)), 6) AS unscored, avg(CAST(a IS NULL AS INTEGER)) <= 0.02 AS ok, round(avg(coalesce(a, 0.5)), 6) AS mean FROM u GROUP BY category")
def a23_unscored(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit(1).alias("v"))
    u = scored(spark, sf).join(vectors, "id", "left").withColumn("a", F.when(F.col("v").isNotNull(), F.col("a")))
    missing = F.avg(F.col("a").isNull().cast("int"))
    return u.groupBy("category").agg(F.count("*").alias("n"), F.round(missing, 6).alias("unscored"), (missing <= 0.02).alias("ok"), F.round(F.avg(F.coalesce("a", F.lit(0.5))), 6).alias("mean"))


# ranks, mixtures, thresholds


@query("w06_category_thresholds", f"WITH {SCORED} SELECT id, a >= CASE category WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.55 WHEN 'fr' THEN 0.5 ELSE 0.45 END AS picked FROM scored")
def w06_category_thresholds(spark, sf):
    return E.selected_by_threshold(scored(spark, sf), "category", "a", {"en": 0.6, "de": 0.55, "fr": 0.5, "es": 0.45}, "picked").select("id", "picked")


_Q = lambda x, to="s": f"(SELECT (count(*) FILTER (r.{x} < {to}.{x}) + count(*) FILTER (r.{x} <= {to}.{x})) / (2.0::DOUBLE * count(*)) FROM ref r WHERE r.category = {to}.category)"
_THREE = f"{SCORED}, three AS (SELECT *, round({UNIT.format('id', 'third')}, 4) AS c FROM scored), ref AS (SELECT * FROM three WHERE label IS NOT NULL)"


def _three(spark, sf):
    return scored(spark, sf).withColumn("c", F.round(unit(F.col("id"), "third"), 4))


@query("w08_three_sources", f"WITH {_THREE}, q AS (SELECT s.id, s.category, s.a, {_Q('a')} AS qa, {_Q('b')} AS qb, {_Q('c')} AS qc FROM three s) SELECT id, round(CASE WHEN category = 'es' THEN a ELSE 0.5::DOUBLE * qa + 0.3::DOUBLE * qb + 0.2::DOUBLE * qc END, 6) AS blend FROM q")
def w08_three_sources(spark, sf):
    """A category whose weight is 0 keeps the first source's own score."""
    s = _three(spark, sf)
    ref = s.where("label IS NOT NULL")
    q = s
    for x in "abc":
        q = R.quantile_map(q, ref, ["category"], x, f"q{x}")
    return q.select("id", F.round(F.when(F.col("category") == "es", F.col("a")).otherwise(0.5 * F.col("qa") + 0.3 * F.col("qb") + 0.2 * F.col("qc")), 6).alias("blend"))


@query("w09_restricted_blend", f"WITH {SCORED} SELECT id, round(CASE WHEN category = 'en' THEN 0.8::DOUBLE * a + 0.2::DOUBLE * b ELSE a END, 6) AS score FROM scored")
def w09_restricted_blend(spark, sf):
    return scored(spark, sf).select("id", F.round(F.when(F.col("category") == "en", 0.8 * F.col("a") + 0.2 * F.col("b")).otherwise(F.col("a")), 6).alias("score"))


@query("w10_judge", f"""WITH {SCORED}, r AS (SELECT id, category, a, round(0.7::DOUBLE * {_RANK.format('a')} + 0.3::DOUBLE * {_RANK.format('b')}, 12) AS mix FROM scored),
 k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY a DESC, id) AS x, row_number() OVER (PARTITION BY category ORDER BY mix DESC, id) AS y, count(*) OVER (PARTITION BY category) AS n FROM r), t AS (SELECT *, CAST(greatest(1, round_even(0.05::DOUBLE * n, 0)) AS BIGINT) AS k FROM k)
 SELECT category, max(n) AS n, max(k) AS k, count(*) FILTER (y <= k AND x > k) AS moved, count(*) FILTER (y <= k AND x > k) > 0 OR max(n) < 50 AS ok FROM t GROUP BY category""")
def w10_judge(spark, sf):
    return E.judged(scored(spark, sf), "category", "a", "b", "id", 0.3, 0.05)


_TAKEN = f"{SCORED}, {LABELLED}, {EQUAL}, wt AS (SELECT s.*, grp, 1 + 2 * (1 - label) AS w FROM s JOIN eg ON s.id = eg.id), tk AS (SELECT *, sum(w) OVER (PARTITION BY category ORDER BY a DESC, id ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY category) AS al FROM wt), ta AS (SELECT *, upto = w OR upto <= 0.2::DOUBLE * al AS taken FROM tk)"


def _taken(spark, sf):
    s = labelled(spark, sf).join(grouped(spark, sf), "id").withColumn("w", (1 + 2 * (1 - F.col("label"))).cast("long"))
    return E.taken_by_weight(s, ["category"], "a", "id", "w", 0.2)


@query("w11_recall_at_rate", f"WITH {_TAKEN} SELECT category, round(CASE WHEN sum(w * label) > 0 THEN sum(CASE WHEN taken THEN w * label ELSE 0 END) / sum(w * label)::DOUBLE END, 6) AS recall FROM ta GROUP BY category")
def w11_recall_at_rate(spark, sf):
    pos, hit = F.sum(F.col("w") * F.col("label")), F.sum(F.when(F.col("taken"), F.col("w") * F.col("label")).otherwise(0))
    return _taken(spark, sf).groupBy("category").agg(F.round(F.when(pos > 0, hit / pos), 6).alias("recall"))


@query("w12_group_recall", f"WITH {_TAKEN} SELECT category, count(DISTINCT CASE WHEN label = 1 THEN grp END) AS n_groups, round(CASE WHEN sum(label) > 0 THEN count(DISTINCT CASE WHEN label = 1 AND taken THEN grp END) / count(DISTINCT CASE WHEN label = 1 THEN grp END)::DOUBLE END, 6) AS recall FROM ta GROUP BY category")
def w12_group_recall(spark, sf):
    by_group = _taken(spark, sf).groupBy("category", "grp").agg(F.max("label").alias("y"), F.max((F.col("taken") & (F.col("label") == 1)).cast("int")).alias("hit"))
    return by_group.groupBy("category").agg(F.sum("y").cast("long").alias("n_groups"), F.round(F.when(F.sum("y") > 0, F.sum("hit") / F.sum("y")), 6).alias("recall"))


@query("w13_largest_cluster", f"""WITH {SCORED}, {LABELLED}, {EQUAL}, k AS (SELECT s.*, grp, row_number() OVER (PARTITION BY category ORDER BY a DESC, s.id) AS rank, count(*) OVER (PARTITION BY category) AS n FROM s JOIN eg ON s.id = eg.id), p AS (SELECT category, grp, count(*) AS size FROM k WHERE label = 1 GROUP BY category, grp), b AS (SELECT category, arg_min(grp, (-size, grp)) AS grp FROM p GROUP BY category)
 SELECT k.category, k.grp, count(*) AS size, median(rank) AS middle, count(*) FILTER (rank <= greatest(1, round_even(0.1::DOUBLE * n, 0))) AS hits FROM k JOIN b ON k.category = b.category AND k.grp = b.grp WHERE label = 1 GROUP BY k.category, k.grp""")
def w13_largest_cluster(spark, sf):
    k = staged(E.ranked(labelled(spark, sf).join(grouped(spark, sf), "id").select("id", "category", "label", "a", "grp"), ["category"], "a", "id"), "ranked")
    largest = k.where("label = 1").groupBy("category", "grp").agg(F.count("*").alias("size")).groupBy("category").agg(F.min(F.struct(-F.col("size"), "grp")).alias("m")).select("category", F.col("m.grp").alias("grp"))
    of = k.where("label = 1").join(largest, ["category", "grp"])
    middle = R.quantiles(of, ["category"], "rank", [0.5]).select("category", F.col("value").alias("middle"))
    return of.groupBy("category", "grp").agg(F.count("*").alias("size"), F.count_if(F.col("rank") <= E.half_even(0.1, F.col("n"))).alias("hits")).join(middle, "category")


_MIXES = [round(0.05 * k, 2) for k in range(21)]
_FINE = [round(0.005 * k, 3) for k in range(1, 200)]


@query("w15_weight_sweep", f"""WITH {SCORED}, {LABELLED}, ref AS (SELECT * FROM s), {_PRIOR}, q AS (SELECT s.category, s.label, {_Q('a')} AS qa, {_Q('b')} AS qb FROM s), mx AS (SELECT CAST(round(0.05 * k, 2) AS DOUBLE) AS mix FROM range(21) x(k)), fg AS (SELECT CAST(round(0.005 * k, 3) AS DOUBLE) AS threshold FROM range(1, 200) x(k)),
 x AS (SELECT category, mix, label, round((1 - mix) * qa + mix * qb, 9) AS a FROM q, mx), c AS (SELECT category, mix, threshold, sum(CASE WHEN a >= threshold THEN label ELSE 0 END) AS tp, sum(CASE WHEN a >= threshold THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN a >= threshold THEN 0 ELSE label END) AS fn FROM x, fg GROUP BY category, mix, threshold),
 f AS (SELECT c.category, mix, threshold, {_F1('tp', 'fp * w', 'fn')} AS f1 FROM c JOIN z ON c.category = z.category) SELECT category, arg_min(mix, (-round(f1, 9), mix, threshold)) AS mix, arg_min(threshold, (-round(f1, 9), mix, threshold)) AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY category""")
def w15_weight_sweep(spark, sf):
    """Each row is counted once a weight, by the thresholds that it reaches; the grid is crossed with these counts only."""
    s = labelled(spark, sf).select("id", "category", "label", "a", "b")
    q = R.quantile_map(R.quantile_map(s, s, ["category"], "a", "qa"), s, ["category"], "b", "qb")
    x = q.select("category", "label", "qa", "qb", F.explode(F.array(*[F.lit(m) for m in _MIXES])).alias("mix"))
    x = x.withColumn("x", F.round((1 - F.col("mix")) * F.col("qa") + F.col("mix") * F.col("qb"), 9))
    c = E.swept_counts(x, ["category", "mix"], "x", "label", _FINE).join(E.prior_weights(s, ["category"], "label", 0.1), "category")
    f = c.withColumn("f1", E.f1(F.col("tp"), F.col("fp") * F.col("negative_weight"), F.col("fn")))
    return E.best(f, ["category"], "mix", "threshold").select("category", "mix", "threshold", F.round("f1", 6).alias("f1"))


@query("w16_mean_curves", f"""WITH {SCORED}, {LABELLED}, d AS (SELECT category, a, count(*) AS n, sum(label) AS p FROM s GROUP BY category, a),
 r AS (SELECT *, coalesce(sum(n - p) OVER u, 0) AS nb, sum(p) OVER v AS pc, sum(n) OVER v AS nc FROM d WINDOW u AS (PARTITION BY category ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY category ORDER BY a DESC)),
 c AS (SELECT category, sum(p * (nb + (n - p) / 2.0::DOUBLE)) / (sum(p) * (sum(n) - sum(p))) AS auc, sum(p * pc / nc::DOUBLE) / sum(p) AS ap FROM r GROUP BY category HAVING sum(p) > 0 AND sum(p) < sum(n)) SELECT count(*) AS n, round(avg(auc), 5) AS auc, round(avg(ap), 5) AS ap FROM c""")
def w16_mean_curves(spark, sf):
    """Means over the categories that have both classes."""
    return R.curves(scored(spark, sf), ["category"], "a", "label").agg(F.count("auc").alias("n"), F.round(F.avg("auc"), 5).alias("auc"), F.round(F.avg("ap"), 5).alias("ap"))


@query("w17_checkpoint", f"WITH {SCORED}, {LABELLED}, {_MARKS}, {_SWEPT('s', 'category')}, k AS (SELECT category, threshold AS step, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END * 0.5::DOUBLE + CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END * 0.5::DOUBLE, 1) AS sel, round(f1, 3) AS f1 FROM sf) SELECT category, arg_min(step, (-sel, -f1, step)) AS step FROM k GROUP BY category")
def w17_checkpoint(spark, sf):
    """Checkpoints are played by the thresholds of a sweep, in order."""
    c = E.swept_counts(labelled(spark, sf), ["category"], "a", "label", GRID)
    share = lambda x, y: F.when(x + y > 0, x / (x + y)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    k = c.select("category", F.col("threshold").alias("step"), F.round(share(tp, fn) * 0.5 + share(tp, fp) * 0.5, 1).alias("sel"), F.round(E.f1(tp, fp, fn), 3).alias("f1"))
    return E.chosen_step(k, "category")


_FOLDED = f"{SCORED}, {EQUAL}, s AS (SELECT sc.*, grp, {FOLD} AS fold FROM scored sc JOIN eg ON sc.id = eg.id WHERE label IS NOT NULL)"
_CROSS = lambda part: f"""pr AS (SELECT DISTINCT category, {part} AS part FROM s), tu AS (SELECT p.category, p.part, label, a FROM pr p JOIN s ON s.category = p.category AND {part} <> p.part), ok AS (SELECT category, part FROM tu GROUP BY category, part HAVING sum(label) > 0 AND sum(1 - label) > 0),
 {_MARKS}, {_SWEPT('tu JOIN ok USING (category, part)', 'category, part')}, th AS (SELECT category, part, arg_min(threshold, (-round(f1, 9), threshold)) AS threshold FROM sf GROUP BY category, part)"""  # noqa: E731


@query("w18_crossfit", f"WITH {_FOLDED}, {_CROSS('fold')} SELECT s.id, fold, CAST(coalesce(a >= threshold, false) AS INTEGER) AS verdict FROM s LEFT JOIN th ON s.category = th.category AND s.fold = th.part")
def w18_crossfit(spark, sf):
    s = folded(spark, sf)
    thresholds = E.crossfit(s, "category", "fold", "a", "label", GRID)
    return E.applied(s, thresholds, ["category", "fold"], "a", "verdict").select("id", "fold", "verdict")


@query("w19_half_crossfit", f"WITH {_FOLDED}, {_CROSS('fold % 2')}, v AS (SELECT s.category, s.label AS y, CAST(coalesce(a >= threshold, false) AS INTEGER) AS v FROM s LEFT JOIN th ON s.category = th.category AND fold % 2 = th.part), c AS (SELECT category, sum(y * v) AS tp, sum((1 - y) * v) AS fp, sum(y * (1 - v)) AS fn, sum((1 - y) * (1 - v)) AS tn FROM v GROUP BY category), f AS (SELECT category, {_F1('tp', 'fp', 'fn')} AS f1, ({_F1('tp', 'fp', 'fn')} + {_F1('tn', 'fn', 'fp')}) / 2 AS macro FROM c), m AS (SELECT category, avg(threshold) AS threshold FROM th GROUP BY category) SELECT f.category, round(f1, 6) AS f1, round(macro, 6) AS macro, round(threshold, 6) AS threshold FROM f LEFT JOIN m ON f.category = m.category")
def w19_half_crossfit(spark, sf):
    """Each half of the groups is judged by the threshold of the other."""
    s = folded(spark, sf).withColumn("half", F.col("fold") % 2)
    thresholds = staged(E.crossfit(s, "category", "half", "a", "label", GRID), "thresholds")
    counts = E.confusion(E.applied(s, thresholds, ["category", "half"], "a", "v"), ["category"], "label", "v")
    scores = E.f1_scores(counts, "category").where("category <> 'mean'")
    mean = thresholds.groupBy("category").agg(F.round(F.avg("threshold"), 6).alias("threshold"))
    return scores.select("category", F.round("f1", 6).alias("f1"), F.round("macro", 6).alias("macro")).join(mean, "category", "left")


_POINTS = [0.5 + (0.9995 - 0.5) * k / 199 for k in range(200)]


@query("w20_quantile_sweep", f"WITH {SCORED}, {LABELLED}, pt AS (SELECT 0.5::DOUBLE + (0.9995::DOUBLE - 0.5::DOUBLE) * k / 199 AS p FROM range(200) x(k)), o AS (SELECT list_sort(list(a)) AS v, count(*) AS n FROM s), cd AS (SELECT DISTINCT round(v[CAST(floor(p * (n - 1)) AS BIGINT) + 1] + (v[CAST(ceil(p * (n - 1)) AS BIGINT) + 1] - v[CAST(floor(p * (n - 1)) AS BIGINT) + 1]) * (p * (n - 1) - floor(p * (n - 1))), 9) AS t FROM o, pt), c AS (SELECT t, sum(CASE WHEN a >= t THEN label ELSE 0 END) AS tp, sum(CASE WHEN a >= t THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN a >= t THEN 0 ELSE label END) AS fn FROM s, cd GROUP BY t) SELECT count(*) AS n, round(max(2 * tp / greatest(1, 2 * tp + fp + fn)::DOUBLE), 6) AS f1 FROM c")
def w20_quantile_sweep(spark, sf):
    """Thresholds are quantiles of the score itself: 200 values, which go back as a list."""
    s = labelled(spark, sf).withColumn("k", F.lit(0))
    marks = sorted({r.value for r in R.quantiles(s, ["k"], "a", _POINTS).select(F.round("value", 9).alias("value")).collect()})
    if not marks:
        return s.agg(F.count("*").alias("n"), F.lit(0.0).alias("f1"))
    c = E.swept_counts(s, ["k"], "a", "label", marks)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.agg(F.count("*").alias("n"), F.round(F.max(2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)), 6).alias("f1"))


# sets


@query("l01_first_rows", "SELECT doc_id AS id, source FROM documents ORDER BY doc_id LIMIT 25")
def l01_first_rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "source").orderBy("id").limit(25)


@query("u01_all_columns", "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(lang, '') AS lang, '' AS turns, coalesce(source, '') AS origin FROM documents UNION ALL SELECT CAST(conv_id AS VARCHAR), '', CAST(count(*) AS VARCHAR), '' FROM conversations GROUP BY conv_id")
def u01_all_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("origin"))
    talks = spark.read.parquet(f"{sf}/conversations.parquet").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"))
    return S.all_columns(docs, talks)


@query("u02_top_difference", f"WITH {SCORED}, a AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY a DESC, id) AS k, count(*) OVER () AS n FROM scored) WHERE k <= greatest(1, round_even(0.1::DOUBLE * n, 0))), b AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY b DESC, id) AS k, count(*) OVER () AS n FROM scored) WHERE k <= greatest(1, round_even(0.1::DOUBLE * n, 0))) SELECT id FROM a EXCEPT SELECT id FROM b")
def u02_top_difference(spark, sf):
    s = scored(spark, sf).withColumn("k", F.lit(0))
    top = lambda c: E.ranked(s, ["k"], c, "id").where(F.col("rank") <= E.half_even(0.1, F.col("n"))).select("id")
    return top("a").subtract(top("b"))


@query("a05_modal_values", "WITH c AS (SELECT source, coalesce(lang, '') AS lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2) SELECT source, arg_min(lang, (-n, lang)) AS least, arg_min(lang, (-n, first)) AS seen FROM c GROUP BY source")
def a05_modal_values(spark, sf):
    """The most frequent value: of equal ones the least, or the one seen first."""
    c = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return c.groupBy("source").agg(F.min(F.struct(-F.col("n"), "lang"))["lang"].alias("least"), F.min(F.struct(-F.col("n"), "first", "lang"))["lang"].alias("seen"))


@query("p21_float_sigmoid", f"WITH {SCORED}, z AS (SELECT id, CAST((ln(exp(a) + exp(b)) - ln(exp(1 - a) + exp(1 - b))) AS FLOAT) AS z FROM scored) SELECT id, round(CAST(1 / (1 + exp(-z::DOUBLE)) AS FLOAT)::DOUBLE, 5) AS p FROM z")
def p21_float_sigmoid(spark, sf):
    """The difference of two log-sums is a float32, and so is what comes out."""
    lse = lambda *c: F.log(sum((F.exp(x) for x in c[1:]), F.exp(c[0])))
    z = (lse(F.col("a"), F.col("b")) - lse(1 - F.col("a"), 1 - F.col("b"))).cast("float")
    return scored(spark, sf).select("id", F.round((1 / (1 + F.exp(-z.cast("double")))).cast("float").cast("double"), 5).alias("p"))


# The shares of the marked category by level.
LEVELS = [0.0, 0.0488, 0.1068, 0.1766, 0.2624, 0.3703, 0.5104, 0.6990, 0.9678]


@query("p25_levels", f"WITH {GOODS}, u AS (SELECT id, category, {UNIT.format('id', '')} AS u FROM goods) SELECT id, level, CAST(category = 'БАД' AND u < {LEVELS}[greatest(0, least(8, level)) + 1] AS INTEGER) AS verdict FROM u, (SELECT unnest([-1, 3, 8, 12]) AS level)")
def p25_levels(spark, sf):
    """Verdicts that encode a level; levels out of range are the nearest one."""
    share = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.lit(0), F.least(F.lit(8), F.col("level"))) + 1)
    g = goods(spark, sf).select("id", "category", F.explode(F.array(*[F.lit(x) for x in (-1, 3, 8, 12)])).alias("level"))
    return g.select("id", "level", ((F.col("category") == "БАД") & (unit(F.col("id")) < share)).cast("int").alias("verdict"))


@query("f11_routed", f"WITH {GOODS}, {SCORED}, t AS (SELECT s.id, a, b, CASE WHEN length(g.ocr) > 15 THEN 'read' WHEN g.ocr = '' THEN 'blank' ELSE 'other' END AS kind FROM scored s JOIN goods g ON s.id = g.id) SELECT id, round(CASE WHEN kind = 'read' THEN b WHEN kind = 'blank' AND b > 0.5 THEN 1 - b ELSE a END, 6) AS score FROM t")
def f11_routed(spark, sf):
    """Kinds of cards with a score of their own; where that has no opinion, the common one stays."""
    kind = F.when(F.length("ocr") > 15, "read").when(F.col("ocr") == "", "blank").otherwise("other")
    t = scored(spark, sf).select("id", "a", "b").join(goods(spark, sf).select("id", kind.alias("kind")), "id")
    return t.select("id", F.round(M.routed(F.col("a"), F.col("kind"), {"read": F.col("b"), "blank": F.when(F.col("b") > 0.5, 1 - F.col("b"))}), 6).alias("score"))


# models: no SQL; tests look at their properties


def _texts(spark, sf):
    return cards(spark, sf).select("id", "category", "label", F.col("description").alias("text")).withColumn("label", F.col("label").cast("double"))


def _vectors(spark, sf, width=64):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") < 5).cast("double").alias("label"))
    return M.vectors(v, "embedding", width)


@query("f03_text_logistic")
def f03_text_logistic(spark, sf):
    """One classifier for each category with enough labels; f05: the others get shares of positives."""
    rows = _texts(spark, sf)
    models, priors = M.per_category(rows, "category", "label", lambda n, c=4.0: [*M.text_stages(), M.logistic(n, c)], ["en", "de", "fr"])
    return M.scored(rows, "category", models, priors, ["id", "category", "label"])


@query("f04_text_svm")
def f04_text_svm(spark, sf):
    from pyspark.ml.classification import LinearSVC

    rows = _texts(spark, sf)
    stages = lambda n, reg=0.01: [*M.text_stages(), LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, maxIter=8)]
    models, priors = M.per_category(rows, "category", "label", stages, ["en", "de"], {"de": {"reg": 0.1}})
    return M.scored(rows, "category", models, priors, ["id", "category", "label"])


@query("f05_unknown_category", f"WITH {SCORED}, p AS (SELECT category, avg(label) AS p FROM scored WHERE label IS NOT NULL GROUP BY category) SELECT s.id, round(CASE WHEN s.category IN ('en', 'de') THEN p.p ELSE (SELECT avg(p) FROM p WHERE category IN ('en', 'de')) END, 6) AS score FROM scored s LEFT JOIN p ON s.category = p.category")
def f05_unknown_category(spark, sf):
    s = scored(spark, sf)
    priors = {r.category: r.p for r in s.where("label IS NOT NULL").where(F.col("category").isin("en", "de")).groupBy("category").agg(F.avg("label").alias("p")).collect()}
    return M.scored(s, "category", {}, priors, ["id"]).select("id", F.round("score", 6).alias("score"))


@query("f06_dense_features")
def f06_dense_features(spark, sf):
    """Vectors reduced and numbers beside them, fitted on one part of the rows and applied to all."""
    from pyspark.ml import Pipeline

    rows = _vectors(spark, sf).withColumn("size", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    made = Pipeline(stages=M.dense_stages("vector", ["size"], 64)).fit(rows.where("label = 1")).transform(rows)
    return made.select("id", M.vector_to_array("features").alias("features"))


@query("f07_sparse_features")
def f07_sparse_features(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from cardwright.functions import rules as K

    g = goods(spark, sf)
    flags = K.evidence(F.col("name"), F.col("description"), F.col("ocr"))
    g = g.select("id", F.col("description").alias("text"), *[v.cast("double").alias(k) for k, v in flags.items()])
    out = Pipeline(stages=[*M.text_stages(out="words"), VectorAssembler(inputCols=["words", *flags], outputCol="features")]).fit(g).transform(g)
    return out.select("id", F.size(M.vector_to_array("features")).alias("width"))


@query("f08_learners")
def f08_learners(spark, sf):
    """learner, n, accuracy on the vectors that it was not fitted on."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = staged(M.balanced(VectorAssembler(inputCols=["vector"], outputCol="features").transform(_vectors(spark, sf)).withColumn("fold", F.pmod(F.hash("id"), F.lit(5))), "label").select("id", "features", "label", "weight", "fold"), "vectors")
    out = None
    for name, stages in M.zoo(64).items():
        judged = Pipeline(stages=stages()).fit(rows.where("fold > 0")).transform(rows.where("fold = 0"))
        one = judged.agg(F.lit(name).alias("learner"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query("f10_stacked")
def f10_stacked(spark, sf):
    """Two classifiers, of texts and of vectors, scored out of fold, and one of their scores."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    texts = _texts(spark, sf).where("label IS NOT NULL")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = staged(texts.join(vectors, "id").withColumn("fold", F.pmod(F.hash("id"), F.lit(2))), "rows")
    one = M.out_of_fold(rows, "fold", 2, lambda n: [*M.text_stages(), M.logistic(n)], "label", "by_text")
    two = M.out_of_fold(M.vectors(rows, "embedding", 64), "fold", 2, lambda n: [*M.dense_stages("vector", [], 64), M.logistic(n)], "label", "by_vector")
    both = M.balanced(rows.select("id", "label", "fold").join(one, "id").join(two, "id"), "label")
    meta = Pipeline(stages=[VectorAssembler(inputCols=["by_text", "by_vector"], outputCol="features"), M.logistic(100)]).fit(both)
    return M.positive(meta.transform(both)).select("id", "label", "by_text", "by_vector", "score")


@query("f12_vector_logistic")
def f12_vector_logistic(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler

    rows = M.balanced(_vectors(spark, sf), "label")
    scaled = StandardScaler(inputCol="vector", outputCol="features", withMean=True)
    return M.positive(Pipeline(stages=[scaled, M.logistic(rows.count(), 1.0)]).fit(rows).transform(rows)).select("id", "label", "score")
