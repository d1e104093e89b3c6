"""Rules, explanations, comments, sources, folds and measures on literals with answers worked out by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cardwright.functions import rules as K
from cardwright.functions import text as T
from cardwright.operators import evaluation as E
from cardwright.operators import features as V
from cardwright.operators import models as M
from cardwright.operators import ranking as R
from cardwright.operators import splits as P
from cardwright.plans.catalog import FALLBACK
from cardwright.sources import tables as S

CARD = "id long, name string, description string, ocr string, category string"


def flags(spark, *cards):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cards)], CARD)
    e = K.evidence(F.col("name"), F.col("description"), F.col("ocr"))
    rows = df.select("id", "name", "category", *[v.alias(k) for k, v in e.items()], K.guess(F.col("category"), lambda k: e[k]).alias("guess"), K.explanation(F.col("name"), F.col("category"), K.guess(F.col("category"), lambda k: e[k]), lambda k: e[k]).alias("comment"))
    return rows.orderBy("id").collect()


def test_evidence_reads_words_of_any_script(spark):
    got = flags(
        spark,
        ("бады", "", "", K.SUPPLEMENT), ("активной", "формы", "", K.SUPPLEMENT), ("Спички", "в коробке", "", K.FLAMMABLE), ("Мангал", "+ 2 цанговых баллона", "", K.FLAMMABLE),
        ("Чай", "не является БАД", "не является лекарством и БАД", K.SUPPLEMENT), ("Чай", "не является лекарством. БАД", "Биологически активная добавка", K.SUPPLEMENT), ("", "", "", "прочее"),
    )
    assert [r.supplement_word for r in got] == [True, False, False, False, True, True, False]
    assert got[2].ignition_source_name and got[2].guess == 1 and got[3].device_for_fire and got[3].in_kit and got[3].guess == 0
    assert got[4].explicit_not_supplement and got[4].guess == 0 and not got[4].ocr_mark_ru and got[5].ocr_mark_ru and got[5].guess == 1
    assert got[6].guess == 0 and got[6].comment.startswith("«Товар»: источника")
    assert got[2].comment == "«Спички»: товар сам является источником открытого огня. Товар относится к легковоспламеняющимся, категория указана верно."


def test_portable_patterns_agree():
    """portable() against the pattern itself, on texts that try every word bound."""
    patterns = [*K.PATTERNS.values(), *K.READ_FLAGS.values(), *[p for rules in K.FACTS.values() for *_, p in rules], *[p for _, p in K.TYPES]]
    words = ["бад", "бады", "сгр", "сгру", "гост", "ту", "5", "не является", "спички", "резак", "резаки", "веер", "веера", "газ", "газа", "печь", ".", " ", "-", "x", "suppl", "asuppl", " ", "уголь", "баллон", "+", "2", "в комплекте", "с"]
    rng, duck = random.Random(2), __import__("duckdb").connect()
    texts = ["".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(400)]
    for p in set(patterns):
        got = duck.execute("SELECT list_transform(?::VARCHAR[], lambda x: regexp_matches(x, ?))", [texts, K.portable(p)]).fetchone()[0]
        for t, hit in zip(texts, got):
            assert hit == bool(re.search(p, t, re.I)), (p, t)


def test_types_take_the_first_rule(spark):
    names = {"Чехол для мангала": "accessory_empty", "Спички": "matches", "баллон": "gas_container", "МАНГАЛ": "grill", "уголь": "charcoal", "Дуголь": "other", "": "other"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.t for r in df.select("n", K.product_type(F.col("n")).alias("t")).collect()} == names


def test_facts(spark):
    df = spark.createDataFrame([(1, "Горелка", "беречь от огня, ГОСТ", "распознано на фото больше", K.FLAMMABLE), (2, "Чай", "ничего", "мало", K.SUPPLEMENT), (3, "x", "гост", "", "прочее")], CARD)
    items = df.select("id", K.facts(F.col("name"), F.col("description"), F.col("category"), F.col("ocr")).alias("f"))
    got = {r.id: (r.f, r.b) for r in items.select("id", "f", K.facts_block(F.col("f")).alias("b")).collect()}
    assert [x[:12] for x in got[1][0]] == ["в описании е", "название нач", "в карточке у", "на фотографи"] and got[1][1].startswith(K.FACTS_HEAD + "\n- в описании")
    assert got[2] == ([], "") and got[3] == ([], "")


def test_comments(spark):
    long = "слово " * 60
    cases = {"": FALLBACK, "x" * 400: "x" * 300, long: ("слово " * 50).strip(), "а" * 290 + " , " + "б" * 50: "а" * 290, "коротко.": "коротко. " + FALLBACK, "один <вердикт> два <комментарий>" + "!" * 50: None, "x" * 49: "x" * 49 + ". " + FALLBACK, "x" * 50: "x" * 50}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.c for r in df.select("t", T.clipped(F.col("t"), FALLBACK).alias("c")).collect()}
    for t, want in cases.items():
        assert 50 <= len(got[t]) <= 300 and "<вердикт>" not in got[t] and (want is None or got[t] == want), (t, got[t])


def test_cleaned_comments():
    clean = K.clean_generated
    assert clean("<b>Ответ: Горелка работает от газа</b>") == "Решающее: горелка работает от газа."
    assert "supplement_mark" not in clean("Решающее: видно supplement_mark на фото. Товар без маркировки и без состава, это видно сразу.")
    assert clean("Решающее: товар бан.") == "Решающее: товар." and clean("") == "" and clean(None) == ""
    text = "Решающее: " + "внутри нет топлива, только корпус и решётка для углей. " * 9
    assert len(clean(text)) <= 300 and clean(text).endswith("углей.")
    cut = "Решающее: внутри находится газовый баллон с пропаном и бутаном, а хлопушка с серпант."
    assert clean(cut, hit_cap=True) == "Решающее: внутри находится газовый баллон с пропаном и бутаном."
    assert clean("Решающее: корпус металлический, топливо внешнее, не указано") == "Решающее: корпус металлический, топливо внешнее."


def test_prompts_need_their_marker(spark):
    df = spark.createDataFrame([("Карточка. Товар действительно относится?",)], "t string")
    got = df.select(T.inserted(F.col("t"), "Товар действительно", F.lit("Это чай. ")), T.tail_replaced(F.col("t"), "Товар", F.lit("Нет?"))).first()
    assert tuple(got) == ("Карточка. Это чай. Товар действительно относится?", "Карточка. Нет?")
    with pytest.raises(Exception, match="no direct question"):
        df.select(T.tail_replaced(F.col("t"), "Относится ли", F.lit("x"))).collect()


def test_folds_deal_runs_as_one_by_one():
    rng = random.Random(9)
    for _ in range(300):
        folds = rng.randint(1, 6)
        groups = [(rng.choice("ab"), rng.choice([1, 1, 1, 2, 3, 7, rng.randint(1, 60)])) for _ in range(rng.randint(0, 60))]
        counts: dict = {}
        for g in groups:
            counts[g] = counts.get(g, 0) + 1
        slow, total = {}, [0] * folds
        for stratum in sorted({s for s, _ in groups}):
            own = [0] * folds
            for size in sorted({n for s, n in groups if s == stratum}, reverse=True):
                for rank in range(counts[stratum, size]):
                    f = min(range(folds), key=lambda i: (own[i], total[i], i))
                    slow[stratum, size, rank] = f
                    own[f] += size
                    total[f] += size
        fast = {}
        for stratum, size, first, many, turn in P.dealt([(s, n, c) for (s, n), c in counts.items()], folds):
            fast.update({(stratum, size, first + k): turn[k % len(turn)] for k in range(many)})
        assert fast == slow


def test_groups_never_cross_folds(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 60), rng.choice(["x", None]), rng.choice([0, 1, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, grp long, c string, y int")
    got = {r.grp: r.fold for r in P.group_folds(df, "id", "grp", ["c", "y"], 5, "7").collect()}
    assert set(got) == {g for _, g, _, _ in rows} and set(got.values()) == set(range(5))
    loads = [sum(got[g] == f for _, g, _, _ in rows) for f in range(5)]
    assert max(loads) - min(loads) <= 30
    assert P.group_folds(df.limit(0), "id", "grp", ["c", "y"], 5, "7").count() == 0
    with pytest.raises(ValueError):
        P.roles(F.col("fold"), 1, inner=3)


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(1, None, 1.0, 1), (2, None, 2.0, 0), (3, "k", 5.0, 1)], "id long, c string, s double, y int")
    assert {r.id: r.r for r in R.percentile_rank(df, ["c"], "s", "r").collect()} == {1: 0.5, 2: 1.0, 3: 1.0}
    assert {r.id for r in R.top_fraction(df, ["c"], "s", "id", 0.5, "p").where("p").collect()} == {2, 3}
    assert {r.id for r in R.rate_selected(df, ["c"], "s", 0.5, "p").where("p").collect()} == {2, 3}
    assert R.curves(df, ["c"], "s", "y").count() == 2


def test_quantiles_and_weights(spark):
    df = spark.createDataFrame([(i, "k", float(x), 1) for i, x in enumerate([1, 2, 2, 10])], "id long, c string, s double, w long")
    assert {r.point: r.value for r in R.quantiles(df, ["c"], "s", [0.0, 0.5, 0.9, 1.0]).collect()} == pytest.approx({0.0: 1.0, 0.5: 2.0, 0.9: 7.6, 1.0: 10.0})
    heavy = spark.createDataFrame([(1, "k", 3.0, 10), (2, "k", 2.0, 1), (3, "k", 1.0, 1)], "id long, c string, s double, w long")
    assert [r.id for r in E.taken_by_weight(heavy, ["c"], "s", "id", "w", 0.1).where("taken").collect()] == [1]
    ties = spark.createDataFrame([("k", 1, 0.5, 0.2), ("k", 2, 0.5, 0.4), ("k", 3, 0.5, 0.4)], "c string, step int, sel double, f1 double")
    assert E.chosen_step(ties, "c").first().step == 2
    with pytest.raises(Exception, match="no threshold for"):
        E.selected_by_threshold(df, "c", "s", {"other": 0.5}, "p").collect()
    with pytest.raises(ValueError):
        E.gated(spark.createDataFrame([(0.5,)], "share double"), 0.1, "bad rows")


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/cards.csv"
    with open(path, "w") as f:
        f.write('Unnamed: 0,id,name,description,category,label\n0,007,"a ""b""","two\nlines",c,1\n1,8,,,,\n')
    assert sorted(map(tuple, S.read_cards(spark, path).collect())) == [("007", 'a "b"', "two\nlines", "c", 1), ("8", "", "", "", None)]
    lines = spark.createDataFrame([("# no",), ("",), (" a | b|c ",), ("plain",)], "value string")
    assert [tuple(r) for r in S.questions(lines).collect()] == [("a", "b|c")]
    good = "<комментарий>" + "x" * 60 + "<вердикт>бан"
    rows = [("1", good), ("1", good), ("2", None), ("9", good), ("3", "<комментарий>" + "x" * 60 + "<вердикт>да"), ("4", "<комментарий>x<вердикт>не бан")]
    found = S.faults(spark.createDataFrame(rows, "id string, result string"), spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")).first().asDict()
    assert found == {"n_duplicate": 1, "n_null": 1, "n_missing": 1, "n_extra": 1, "n_shape": 1, "n_verdict": 1, "n_length": 1}
    with pytest.raises(ValueError, match="n_missing"):
        S.write_answers(spark.createDataFrame([("1", good)], "id string, result string"), spark.createDataFrame([("1",), ("2",)], "id string"), f"{tmp_path}/out")
    for name in ("images/5/10.jpg", "images/5/9.png", "images/6_2.webp", "images/6_1.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.id: [f.rsplit("/", 1)[1] for f in r.files] for r in S.list_pictures(spark, f"{tmp_path}/images").collect()}
    assert got == {"5": ["9.png", "10.jpg"], "6": ["6_2.webp"]}


def test_grams_and_quantised_vectors(spark):
    df = spark.createDataFrame([(1, "ab abcd e")], "id long, text string")
    assert {r.t: r.c for r in V.char_counts(df).collect()} == {" ab": 2, "ab ": 1, " ab ": 1, "abc": 1, "bcd": 1, "cd ": 1, " abc": 1, "abcd": 1, "bcd ": 1, " abcd": 1, "abcd ": 1, " e ": 1}
    assert {r.t: r.c for r in V.word_counts(df).collect()} == {"ab": 1, "abcd": 1, "ab abcd": 1}
    vec = spark.createDataFrame([([0.0, 0.0],), ([127.0, 2.5],), ([-127.0, 3.5],)], "v array<double>")
    scale, q = V.quantised(F.col("v"))
    assert [(r.s, r.q) for r in vec.select(scale.alias("s"), q.alias("q")).collect()] == [(1.0, [0, 0]), (1.0, [127, 2]), (1.0, [-127, 4])]


def test_char_weights_in_blocks(spark, monkeypatch):
    """The same as with a row for each text and term, of which none is written; ids repeat, are null
    (a join in weighted() drops these), and have no text."""
    draw = random.Random(5)
    letters = "abé漢😀\u00a0"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(60)]
    rows = [(i % 90 if i != 7 else None, draw.choice(" \n\t").join(draw.choices(words, k=draw.randint(1, 60)))) for i in range(100)] + [(200, None), (201, ""), (202, "qqqq")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    written = []
    keep = V.staged
    monkeypatch.setattr(V, "staged", lambda d, name: (lambda made: (written.append(made.count()), made)[1])(keep(d, name)))
    got = {r.id: r for r in V.char_weighted(df, len(rows), 3, block=6000, with_terms=True).collect()}
    sent = max(written)
    plain = V.weighted(V.char_counts(df), len(rows), 3).collect()
    assert sent < len(plain) / 2
    by_id = {}
    for r in plain:
        by_id.setdefault(r.id, {})[r.t] = (r.w, r.norm)
    assert set(got) == {*by_id, None} and not {200, 201, 202} & set(got)
    for i, terms in by_id.items():
        assert dict(zip(got[i].terms, got[i].weights)) == pytest.approx({t: w for t, (w, _) in terms.items()})
        assert got[i].n_terms == len(terms) and got[i].norm == pytest.approx(next(iter(terms.values()))[1]) and got[i].top == pytest.approx(max(w for w, _ in terms.values()))
    assert V.char_weighted(df.limit(0), 0).count() == 0


def test_models_know_what_they_were_shown(spark):
    rows = [(i, "k" if i < 60 else "unknown", ("good words here" if i % 2 else "bad text there") + f" n{i % 7}", float(i % 2) if i < 60 else None) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, category string, text string, label double")
    models, priors = M.per_category(df, "category", "label", lambda n: [*M.text_stages(buckets=256), M.logistic(n)], ["k"])
    got = {r.id: r.score for r in M.scored(df, "category", models, priors, ["id"]).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(60)) and all(got[i] == pytest.approx(0.5) for i in range(60, 64))
    with pytest.raises(Exception, match="numbers but"):
        M.vectors(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", 3).collect()


def test_learners_take_rows_outside_the_range_they_were_fitted_on(spark):
    """The complement rule of naive Bayes refused a row to judge that lay below the training rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = [(i, [float(i % 2), float(1 - i % 2)], float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label double").withColumns({"features": array_to_vector("v"), "weight": F.lit(1.0)})
    odd = spark.createDataFrame([(1, [2.0, -1.0]), (0, [-1.0, 2.0])], "label int, v array<double>").withColumn("features", array_to_vector("v"))
    for name in ("complement_bayes", "ridge"):
        got = Pipeline(stages=M.zoo(2)[name]()).fit(df).transform(odd).select("label", "prediction", vector_to_array("scaled").alias("x")).collect()
        assert {r.label: r.prediction for r in got} == {1: 1.0, 0: 0.0}, name
        assert {r.label: r.x for r in got} == ({1: [2.0, 0.0], 0: [0.0, 2.0]} if name == "complement_bayes" else {1: [2.0, -1.0], 0: [-1.0, 2.0]})
