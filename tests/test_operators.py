"""Small cases with answers worked out by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cardwright.functions import text as T
from cardwright.operators import duplicates as D
from cardwright.operators import ranking as R
from cardwright.operators.components import connected_components
from cardwright.plans import catalog

ROWS = "id long, c string, s double, y int"


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, "k", 1.0, 0), (2, "k", 2.0, 0), (3, "k", 2.0, 1), (4, "k", 3.0, 1), (5, "k", None, 1)], ROWS)
    got = {r.id: r.r for r in R.percentile_rank(df, ["c"], "s", "r").collect()}
    assert got == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}


def test_midpoint_quantiles(spark):
    ref = spark.createDataFrame([(i, "k", s, 0) for i, s in enumerate([0.0, 0.0, 0.5, 1.0])], ROWS)
    x = spark.createDataFrame([(1, "k", 0.0, 0), (2, "k", 0.5, 0), (3, "k", 0.7, 0), (4, "none", 0.7, 0)], ROWS)
    assert {r.id: r.q for r in R.quantile_map(x, ref, ["c"], "s", "q").collect()} == {1: 0.25, 2: 0.625, 3: 0.75, 4: 0.5}


def test_selection_with_ties(spark):
    df = spark.createDataFrame([(i, "k", 1.0, 0) for i in range(5)], ROWS)
    assert R.rate_selected(df, ["c"], "s", 0.5, "p").where("p").count() == 5
    assert sorted(r.id for r in R.top_fraction(df, ["c"], "s", "id", 0.4, "p").where("p").collect()) == [0, 1]


def test_equal_f1_takes_the_smaller_threshold(spark):
    df = spark.createDataFrame([(1, "k", 0.2, 0), (2, "k", 0.8, 1)], ROWS)
    assert tuple(R.best_threshold(R.sweep(df, ["c"], "s", "y", [0.1, 0.3, 0.5]), ["c"]).first()) == ("k", 0.3, 1.0)


def test_curves_of_one_class_are_null(spark):
    df = spark.createDataFrame([(1, "k", 0.2, 0), (2, "k", 0.8, 0), (3, "m", 0.5, 0), (4, "m", 0.5, 1)], ROWS)
    got = {r.c: (r.auc, r.ap) for r in R.curves(df, ["c"], "s", "y").collect()}
    assert got == {"k": (None, None), "m": (0.5, 0.5)}


def test_comments_keep_their_bounds(spark):
    texts = ["", None, "x" * 10, "x" * 49, "x" * 50, "x" * 300, "x" * 301, "x" * 400, "<b>word</b> " * 80]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.length(T.clipped(F.col("t"), "nothing else was found in this card")).alias("n")).collect()
    assert all(50 <= r.n <= 300 for r in got)


def test_short_texts_have_no_bands(spark):
    rows = [(1, "", " ".join(f"w{i}" for i in range(11)), "c", 1), (2, "", " ".join(f"w{i}" for i in range(12)), "c", 1), (3, "", "same " * 12, "c", 1)]
    cards = spark.createDataFrame(rows, "id long, name string, description string, category string, label int")
    assert [(r.id, r.ord) for r in D.bands(cards).collect()] == [(2, 0)]


def test_grouping_links_empty_cards(spark, tmp_path):
    """FIXTURES X7, with null, empty and sign-only texts, through the registered queries."""
    texts = [(1, None), (2, ""), (3, "?! ..."), (4, "a word")]
    spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, lang string").selectExpr("*", "length(text) AS n_chars", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    assert sorted(map(tuple, catalog.QUERIES["g05_links"](spark, sf).collect())) == [(1, 2), (1, 3)]
    assert {r.id: r.grp for r in catalog.QUERIES["g08_components"](spark, sf).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert [(r.n_groups, r.n_multi) for r in catalog.QUERIES["g08_duplicate_groups"](spark, sf).collect()] == [(2, 1)]
    assert [(r.n_groups, r.n_multi) for r in catalog.QUERIES["g09_ablation"](spark, sf).where("variant <> 'pictures'").collect()] == [(2, 1), (2, 1)]
    assert [(r.positives, r.with_sibling) for r in catalog.QUERIES["a03_rare_stats"](spark, sf).collect()] == [(4, 3)]
    assert {r.id for r in catalog.QUERIES["g04_exact_keys"](spark, sf).collect()} == {1, 2, 3, 4}
    assert {r.id for r in catalog.QUERIES["g04_lookup_keys"](spark, sf).collect()} == {4}


def test_crowded_bands_link_nobody(spark):
    keys = spark.createDataFrame([(i, "band", "a") for i in range(60)] + [(100 + i, "band", "b") for i in range(61)], "id long, kind string, key string")
    assert D.star_edges(keys).count() == 59


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {3: 3, 4: 3, 5: 3, 7: 7, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], ROWS)
    assert R.percentile_rank(none, ["c"], "s", "r").count() == R.curves(none, ["c"], "s", "y").count() == R.top_fraction(none, ["c"], "s", "id", 0.1, "p").count() == 0


def test_means_half_way_do_not_depend_on_the_order_of_rows(spark):
    """Eight scores whose mean is 0.4541375: a sum of doubles falls short of it in some orders."""
    scores = [0.2703, 0.5959, 0.5485, 0.7512, 0.6319, 0.2954, 0.2489, 0.291]
    orders = [random.Random(k).sample(scores, 8) for k in range(40)]
    df = spark.createDataFrame([(k, float(x)) for k, o in enumerate(orders) for x in o], "k int, s double").coalesce(1)
    assert {(r.k, r.x) for r in df.groupBy("k").agg(F.round(R.mean_of_decimals("s", 4), 6).alias("x")).collect()} == {(k, 0.454138) for k in range(40)}
    assert len({r.x for r in df.groupBy("k").agg(F.round(F.avg("s"), 6).alias("x")).collect()}) == 2


def test_char_weights_count_a_card_for_each_label(spark, tmp_path):
    """As the SQL does: a document with two labels is two cards, in the counts and in their number."""
    import duckdb

    from tests.same import same

    docs = [(i, f"common words {'rare' * (i % 3)} n{i % 4}", "en") for i in range(12)]
    for k, labels in enumerate(([(1, 1, 0), (2, 0, 0), (None, 1, 0), (None, 0, 0)], [(1, 1, 0), (1, 0, 0), (5, 0, 1)])):
        sf = f"{tmp_path}/{k}"
        spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{sf}/labels.parquet")
        con = duckdb.connect()
        for name in ("documents", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
        assert same(catalog.QUERIES["f02_char_tfidf"](spark, sf), con.sql(catalog.ORACLES["f02_char_tfidf"])) == ""
