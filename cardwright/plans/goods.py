"""Queries on Russian cards (rules, facts, types, explanations), sources and sinks.

The test data has no Russian text, so each document becomes the card of a product: its name and the first sentences of
its description are drawn from the lists below by its id, and the document's whole text follows. The SQL spells out the
rules with the portable form of each pattern; flags, order and phrases are those of functions/rules.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.functions import rules as K
from cardwright.functions import text as T
from cardwright.operators import duplicates as D
from cardwright.operators.cards import cards, scored
from cardwright.plans.catalog import ANSWERS, CARDS, COLL, KNOWN, SCORED, answers, query
from cardwright.plans.catalog import _keys as keys
from cardwright.session import new_folder
from cardwright.sources import tables as S

NAMES = [
    "Спички туристические", "Зажигалка газовая", "Уголь древесный 3 кг", "Баллон с газом цанговый", "Мангал складной", "Горелка с пьезоподжигом", "Чехол для мангала", "Хлопушка пневматическая с конфетти", "Дымовая шашка цветной дым", "Набор бенгальских огней",
    "Жидкость для розжига 1 л", "Сухое горючее, таблетки", "Свеча ароматическая", "Газовая плита настольная", "Сувенир брелок граната", "Бензин для зажигалок", "БАД Кордицепс", "бады и витамины", "Омега-3, биологически активная добавка", "Протеин Whey изолят", "L-Carnitine 1000",
    "Спичечница без спичек", "Резак газовый", "ПЕЧЬ-камин Уют", "Супер-ролл для растопки", "", "Вата", "Коптильня с термометром и подставкой для дома и дачи, набор из трёх предметов в коробке",
]
DETAILS = [
    "В комплекте угольные брикеты", "Работает от баллона, газ не входит в комплект", "Не является лекарственным средством и БАД", "Свидетельство о государственной регистрации RU.77", "Биологически активная добавка к пище", "Спортивное питание для набора массы", "Беречь от огня", "Соответствует ГОСТ 1234",
    "Заправляемый корпус, переходник", "Dietary supplement", "Комплектация: подставка, 2 цанговых баллона", "Сгр получено", "Хранить вдали от источника тепла", "Активной формы кальция много", "Бенгальские огни и хлопушки", "Просто хороший товар",
]
READ = ["", "", "Биологически активная добавка, таблетки", "не является БАД и лекарством", "DIETARY SUPPLEMENT 60 caps | 1000 mg", "ГОСТ 5 | ту 12", "BCAA whey | protein", "огнеопасно | hazard", "бад к пище", "12345678901234 56"]
_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_AT = lambda salt, n: f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '{salt}'), 1, 6) AS BIGINT) % {n} + 1"
GOODS = f"""goods AS (SELECT doc_id AS id, coalesce({_LIST(NAMES)}[{_AT('name', len(NAMES))}], '') AS name,
  coalesce({_LIST(DETAILS)}[{_AT('one', len(DETAILS))}] || '. ' || {_LIST(DETAILS)}[{_AT('two', len(DETAILS))}] || '. ', '') || coalesce(text, '') AS description,
  coalesce({_LIST(READ)}[{_AT('read', len(READ))}], '') AS ocr, CASE WHEN {_AT('kind', 2)} = 1 THEN 'БАД' ELSE 'Легковоспламеняющиеся' END AS category FROM documents)"""
PARTS = {"name": "name", "text": "name || ' ' || chr(10) || ' ' || description", "ocr": "ocr", "full": "name || ' ' || chr(10) || ' ' || description || ' ' || chr(10) || ' ' || ocr", "whole": "name || ' ' || description"}


def goods(spark: SparkSession, sf: str) -> DataFrame:
    """id, name, description, ocr, category."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def drawn(values: list[str], salt: str) -> Column:
        at = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("long") % len(values)
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

    lead = F.coalesce(F.concat(drawn(DETAILS, "one"), F.lit(". "), drawn(DETAILS, "two"), F.lit(". ")), F.lit(""))
    category = F.coalesce(drawn([K.SUPPLEMENT, K.FLAMMABLE], "kind"), F.lit(K.FLAMMABLE))
    return docs.select("id", F.coalesce(drawn(NAMES, "name"), F.lit("")).alias("name"), F.concat(lead, "text").alias("description"), F.coalesce(drawn(READ, "read"), F.lit("")).alias("ocr"), category.alias("category"))


def hit(part: str, pattern: str) -> str:
    return f"regexp_matches({PARTS.get(part, part)}, '{K.portable(pattern)}')"


_FLAG = {flag: hit(part, K.PATTERNS[p]) for flag, part, p in K.EVIDENCE}
_FLAG["ocr_mark_ru"] += f" AND NOT {hit('ocr', K.PATTERNS['mark_ru_denied'])}"
_EVIDENCE = f"{GOODS}, e AS (SELECT *, " + ", ".join(f"{sql} AS {flag}" for flag, sql in _FLAG.items()) + " FROM goods)"
_GUESS = """CAST(CASE WHEN category = 'БАД' THEN CASE WHEN explicit_not_supplement THEN 0 WHEN supplement_mark OR supplement_mark_ocr THEN 1 WHEN sport_nutrition THEN 0 WHEN supplement_word THEN 1 ELSE 0 END
  WHEN accessory OR device_for_fire THEN 0 WHEN ignition_source_name OR fuel_content_name THEN 1 ELSE 0 END AS INTEGER)"""


def _flagged(spark, sf, languages=True):
    g = goods(spark, sf)
    return g.select("id", "name", "category", *[v.alias(k) for k, v in K.evidence(F.col("name"), F.col("description"), F.col("ocr"), languages).items()])


@query("p03_evidence", f"WITH {_EVIDENCE} SELECT id, {', '.join(_FLAG)} FROM e")
def p03_evidence(spark, sf):
    return _flagged(spark, sf).drop("name", "category")


@query("p06_evidence_without_languages", f"WITH {_EVIDENCE} SELECT id, {', '.join(f for f in _FLAG if f not in K.LANGUAGE_FLAGS)} FROM e")
def p06_evidence_without_languages(spark, sf):
    return _flagged(spark, sf, languages=False).drop("name", "category")


@query("p05_rule_guess", f"WITH {_EVIDENCE} SELECT id, {_GUESS} AS guess FROM e")
def p05_rule_guess(spark, sf):
    return _flagged(spark, sf).select("id", K.guess(F.col("category"), F.col).alias("guess"))


_READ = "trim(substr(regexp_replace(ocr, '[\\s\\p{Z}]+', ' ', 'g'), 1, 160))"
_ITEMS = ", ".join(f"CASE WHEN category = '{c}' AND {hit(part, p)} THEN '{phrase}' END" for c, rules in K.FACTS.items() for _, phrase, part, p in rules) + f", CASE WHEN length({_READ}) > 15 THEN '{K.READ_FACT}' || {_READ} END"
_FACTS = f"{GOODS}, f AS (SELECT id, list_filter([{_ITEMS}], lambda x: x IS NOT NULL) AS items FROM goods)"


@query("p07_facts", f"WITH {_FACTS} SELECT id, len(items) AS n, array_to_string(items, '; ') AS facts FROM f")
def p07_facts(spark, sf):
    items = goods(spark, sf).select("id", K.facts(F.col("name"), F.col("description"), F.col("category"), F.col("ocr")).alias("items"))
    return items.select("id", F.size("items").cast("long").alias("n"), F.array_join("items", "; ").alias("facts"))


@query("p08_facts_block", f"WITH {_FACTS} SELECT id, CASE WHEN len(items) > 0 THEN '{K.FACTS_HEAD}' || chr(10) || '- ' || array_to_string(items, chr(10) || '- ') || chr(10) ELSE '' END AS facts FROM f")
def p08_facts_block(spark, sf):
    items = goods(spark, sf).select("id", K.facts(F.col("name"), F.col("description"), F.col("category"), F.col("ocr")).alias("items"))
    return items.select("id", K.facts_block(F.col("items")).alias("facts"))


@query("p09_facts_frame", f"WITH {GOODS} SELECT id, category, " + ", ".join(f"CASE WHEN category = '{c}' THEN {hit(part, p)} END AS {k}" for c, rules in K.FACTS.items() for k, _, part, p in rules) + " FROM goods")
def p09_facts_frame(spark, sf):
    return goods(spark, sf).select("id", "category", *[v.alias(k) for k, v in K.fact_flags(F.col("name"), F.col("description"), F.col("category")).items()])


_TYPE = lambda text: "CASE " + " ".join(f"WHEN {hit(text, p)} THEN '{k}'" for k, p in K.TYPES) + " ELSE 'other' END"


@query("p10_product_type", f"WITH {GOODS}, t AS (SELECT id, name, name || ' ' || substr(description, 1, 200) AS longer FROM goods) SELECT id, {_TYPE('name')} AS type, {_TYPE('longer')} AS type_of_text FROM t")
def p10_product_type(spark, sf):
    longer = F.concat("name", F.lit(" "), F.substring("description", 1, 200))
    return goods(spark, sf).select("id", K.product_type(F.col("name")).alias("type"), K.product_type(longer).alias("type_of_text"))


@query("p11_type_columns", f"WITH {GOODS}, t AS (SELECT id, {_TYPE('name')} AS type FROM goods) SELECT id, " + ", ".join(f"CAST(type = '{k}' AS FLOAT) AS type_{k}" for k in K.TYPE_NAMES) + " FROM t")
def p11_type_columns(spark, sf):
    t = goods(spark, sf).select("id", K.product_type(F.col("name")).alias("type"))
    return t.select("id", *[(F.col("type") == k).cast("float").alias(f"type_{k}") for k in K.TYPE_NAMES])


@query("p12_numeric_features", f"""WITH {GOODS} SELECT id, round(ln(1 + length(name)), 5) AS name_len, round(ln(1 + length(description)), 5) AS desc_len, round(ln(2 + len(regexp_extract_all(name, '[\\s\\p{{Z}}]+'))), 5) AS name_words,
  CAST(length(description) < 5 AS INTEGER) AS desc_empty, len(regexp_extract_all(name, '\\p{{Nd}}')) AS digits_in_name, round(len(regexp_extract_all(name, '[А-ЯA-Z]')) / greatest(length(name), 1)::DOUBLE, 5) AS upper_share, (SELECT count(*) FROM embeddings v WHERE v.vec_id = goods.id) AS n_images FROM goods""")
def p12_numeric_features(spark, sf):
    n = F.length("name")
    pictures = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("n_images"))
    g = goods(spark, sf).join(pictures, "id", "left")
    return g.select("id", F.round(F.log1p(n), 5).alias("name_len"), F.round(F.log1p(F.length("description")), 5).alias("desc_len"), F.round(F.log1p(F.regexp_count("name", F.lit(r"(?U)\s+")) + 1), 5).alias("name_words"), (F.length("description") < 5).cast("int").alias("desc_empty"), F.regexp_count("name", F.lit(r"(?U)\d")).cast("long").alias("digits_in_name"), F.round(F.regexp_count("name", F.lit("[А-ЯA-Z]")) / F.greatest(n, F.lit(1)), 5).alias("upper_share"), F.coalesce("n_images", F.lit(0)).cast("long").alias("n_images"))


@query("p13_read_features", f"WITH {GOODS} SELECT id, " + ", ".join(f"CAST({hit('ocr', p)} AS FLOAT) AS {k}" for k, p in K.READ_FLAGS.items()) + ", round(ln(1 + length(ocr)), 5) AS ocr_len, CAST(length(ocr) - length(replace(ocr, '|', '')) AS FLOAT) AS ocr_n_frames FROM goods")
def p13_read_features(spark, sf):
    made = K.read_features(F.nullif(F.col("ocr"), F.lit("")))
    made["ocr_len"] = F.round(F.log1p(F.length("ocr")), 5)
    return goods(spark, sf).select("id", *[v.alias(k) for k, v in made.items()])


# Fixed value: the rules that a prompt quotes, by category; an unknown category has none.
PROMPT_RULES = {K.SUPPLEMENT: "Нужна маркировка БАД.", K.FLAMMABLE: "Товар сам горюч."}


@query("p14_prompt", f"WITH {GOODS} SELECT id, 'Категория: ' || category || chr(10) || CASE category WHEN 'БАД' THEN '{PROMPT_RULES['БАД']}' ELSE '{PROMPT_RULES[K.FLAMMABLE]}' END || chr(10) || 'Название: ' || substr(name, 1, 300) || chr(10) || substr(description, 1, 800) || CASE WHEN ocr <> '' THEN chr(10) || 'Текст, распознанный на изображениях: ' || substr(ocr, 1, 400) ELSE '' END || chr(10) || 'Относится ли товар?' AS prompt FROM goods")
def p14_prompt(spark, sf):
    template = "Категория: {category}\n{rules}\nНазвание: {name}\n{description}{ocr}\nОтносится ли товар?{unknown}"
    rules = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROMPT_RULES.items() for x in kv]), F.col("category")), F.lit(""))
    read = F.when(F.col("ocr") != "", F.concat(F.lit("\nТекст, распознанный на изображениях: "), F.substring("ocr", 1, 400))).otherwise("")
    fields = {"category": F.col("category"), "rules": rules, "name": F.substring("name", 1, 300), "description": F.substring("description", 1, 800), "ocr": read}
    return goods(spark, sf).select("id", T.filled(template, fields).alias("prompt"))


def _reason(supplement: bool, fits: int) -> str:
    reasons, default, tail = K.REASONS[supplement, fits]
    return "CASE " + " ".join(f"WHEN {flag} THEN '{phrase}'" for flag, phrase in reasons) + f" ELSE '{default}' END || '. {tail}'"


_SHORT = "CASE WHEN trim(name) = '' THEN 'Товар' WHEN length(trim(name)) > 70 THEN regexp_replace(substr(trim(name), 1, 70), ' [^ ]*$', '') ELSE trim(name) END"
_SAID = f"'«' || {_SHORT} || '»: ' || CASE WHEN category = 'БАД' THEN CASE WHEN guess = 1 THEN {_reason(True, 1)} ELSE {_reason(True, 0)} END WHEN guess = 1 THEN {_reason(False, 1)} ELSE {_reason(False, 0)} END"


@query("p15_explanation", f"WITH {_EVIDENCE}, g AS (SELECT *, {_GUESS} AS guess FROM e) SELECT id, guess, {_SAID} AS comment FROM g")
def p15_explanation(spark, sf):
    e = _flagged(spark, sf).withColumn("guess", K.guess(F.col("category"), F.col))
    return e.select("id", "guess", K.explanation(F.col("name"), F.col("category"), F.col("guess"), F.col).alias("comment"))


@query("p19_cleaned_comment")
def p19_cleaned_comment(spark, sf):
    """Generated comments are played by the cards' own texts; no SQL, as each step looks at what the one before has left."""
    return goods(spark, sf).select("id", K.cleaned(F.concat(F.lit("Ответ: <b>"), "description", F.lit("</b>")), F.length("ocr") > 15).alias("comment"))


@query("p20_pyro_bonus", f"WITH {GOODS}, s AS (SELECT id, category, 0.25::DOUBLE AS score, regexp_matches(lower(name), '{K.portable(K.PYRO)}') AS pyro, regexp_matches(lower(name), '{K.portable(K.AIR)}') AS air FROM goods) SELECT id, round(score + CASE WHEN category = 'БАД' OR NOT pyro THEN 0 WHEN air THEN -0.05 ELSE 0.05 END, 6)::DOUBLE AS score FROM s")
def p20_pyro_bonus(spark, sf):
    return goods(spark, sf).select("id", F.round(K.pyro_bonus(F.lit(0.25), F.col("name"), F.col("category"), 0.05), 6).alias("score"))


_ASK = "Категория: {0}. {1} Товар действительно относится к категории?"


@query("p28_rewritten_prompt", f"WITH {GOODS} SELECT id, 'Название: ' || name || '. Сам товар: ' || substr(description, 1, 20) || '. Товар действительно относится к категории?' AS with_answer, 'Название: ' || name || '. Относится ли товар к другой категории, чем ' || category || '?' AS negated FROM goods")
def p28_rewritten_prompt(spark, sf):
    prompt, marker = F.concat(F.lit("Название: "), "name", F.lit(". Товар действительно относится к категории?")), "Товар действительно"
    said = F.concat(F.lit("Сам товар: "), F.substring("description", 1, 20), F.lit(". "))
    other = F.concat(F.lit("Относится ли товар к другой категории, чем "), "category", F.lit("?"))
    return goods(spark, sf).select("id", T.inserted(prompt, marker, said).alias("with_answer"), T.tail_replaced(prompt, marker, other).alias("negated"))


@query("p30_frame_size", "WITH s AS (SELECT vec_id AS id, 200 + vec_id * 37 % 1900 AS w, 100 + vec_id * 53 % 1300 AS h FROM embeddings), k AS (SELECT *, least(1, sqrt(401408.0::DOUBLE / (w * h))) AS r FROM s) SELECT id, CAST(CASE WHEN w * h <= 401408 AND w % 28 = 0 AND h % 28 = 0 THEN w ELSE greatest(2, floor(w * r / 28)) * 28 END AS BIGINT) AS width, CAST(CASE WHEN w * h <= 401408 AND w % 28 = 0 AND h % 28 = 0 THEN h ELSE greatest(2, floor(h * r / 28)) * 28 END AS BIGINT) AS height FROM k")
def p30_frame_size(spark, sf):
    s = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), (200 + F.col("vec_id") * 37 % 1900).alias("w"), (100 + F.col("vec_id") * 53 % 1300).alias("h"))
    w, h = T.frame_size(F.col("w"), F.col("h"), 401408, 28)
    return s.select("id", w.alias("width"), h.alias("height"))


@query("a20_probe_measures", f"WITH {GOODS}, t AS (SELECT id, {_TYPE('name')} AS type FROM goods), {SCORED.replace('scored AS', 's AS')}, k AS (SELECT DISTINCT md5(coalesce(d.text, '')) AS h FROM documents d JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT d.doc_id AS id, md5(coalesce(d.text, '')) IN (SELECT h FROM k) AS covered, EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = d.doc_id) AS photo FROM documents d) SELECT CAST(sum(CAST(s.a >= 0.5 AS INTEGER)) AS BIGINT) AS n_selected, round(avg(CAST(photo AS INTEGER)), 6) AS with_photo, round(avg(CAST(type <> 'other' AS INTEGER)), 6) AS typed, round(avg(CAST(covered AS INTEGER)), 6) AS covered FROM t JOIN s USING (id) JOIN c USING (id)")
def a20_probe_measures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    known = docs.join(spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("h").distinct().withColumn("_k", F.lit(1))
    photos = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id")).distinct().withColumn("_p", F.lit(1))
    t = goods(spark, sf).select("id", K.product_type(F.col("name")).alias("type"))
    rows = t.join(scored(spark, sf).select("id", "a"), "id").join(docs.join(known, "h", "left"), "id").join(photos, "id", "left")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.agg(F.sum((F.col("a") >= 0.5).cast("long")).alias("n_selected"), share(F.col("_p").isNotNull()).alias("with_photo"), share(F.col("type") != "other").alias("typed"), share(F.col("_k").isNotNull()).alias("covered"))


# sources and sinks


@query("src01_cards_csv", f"WITH {CARDS} SELECT CAST(id AS VARCHAR) AS id, name, md5(description) AS description, category, label FROM cards")
def src01_cards_csv(spark, sf):
    made = cards(spark, sf).select(F.monotonically_increasing_id().alias("Unnamed: 0"), "id", "name", "description", "category", "label")
    back = S.read_cards(spark, S.write_table(made, new_folder(spark, "cards")))
    return back.select("id", "name", F.md5("description").alias("description"), "category", "label")


@query("src03_known_csv", f"WITH {KNOWN} SELECT * FROM known")
def src03_known_csv(spark, sf):
    return S.read_known(spark, S.write_table(D.known(keys(spark, sf, "lookup")), new_folder(spark, "known"), "gzip"))


@query("src04_aligned_vectors", "SELECT d.doc_id AS id, v.vec_id IS NOT NULL AS known, 64 AS width, round(coalesce(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x)), 0), 4)::DOUBLE AS squares FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id")
def src04_aligned_vectors(spark, sf):
    ids = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return S.aligned_vectors(ids, vectors, 64).select("id", (squares > 0).alias("known"), F.size("vector").alias("width"), F.round(squares, 4).alias("squares"))


_STEMS = "s AS (SELECT doc_id, lang, unnest(range(1, 2 + length(coalesce(text, '')) % 12)) AS k FROM documents), p AS (SELECT CAST(doc_id AS VARCHAR) AS id, k, CASE WHEN lang = 'en' THEN CAST(k AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) END AS stem, CASE WHEN lang = 'en' THEN 'images/' || CAST(doc_id AS VARCHAR) || '/' || CAST(k AS VARCHAR) || '.JPG' ELSE 'images/' || CAST(doc_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) || '.png' END AS path FROM s)"


@query("src06_pictures", f"WITH {_STEMS} SELECT id, count(*) AS n, string_agg(path, ',' ORDER BY length(stem), stem) AS files FROM p GROUP BY id")
def src06_pictures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("d"), "lang", F.explode(F.sequence(F.lit(1), 1 + F.length(F.coalesce("text", F.lit(""))) % 12)).alias("k"))
    path = F.when(F.col("lang") == "en", F.concat(F.lit("images/"), "d", F.lit("/"), F.col("k").cast("string"), F.lit(".JPG"))).otherwise(F.concat(F.lit("images/"), "d", F.lit("_"), F.col("k").cast("string"), F.lit(".png")))
    files = docs.select(F.explode(F.array(path, F.concat(path, F.lit(".txt")))).alias("path"))
    return S.pictures_of(files).select("id", F.size("files").cast("long").alias("n"), F.array_join("files", ",").alias("files"))


@query("src08_incremental", "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN length(coalesce(d.text, '')) ELSE -1 END AS n, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'old' END AS origin FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def src08_incremental(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    done = docs.join(spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("id", F.lit(-1).cast("long").alias("n"), F.lit("old").alias("origin"))
    return S.incremental(done, docs, lambda new: new.select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.lit("new").alias("origin")))


@query("src09_written_answers", f"WITH {ANSWERS} SELECT CAST(id AS VARCHAR) AS id, result FROM answers")
def src09_written_answers(spark, sf):
    rows = answers(spark, sf).select(F.col("id").cast("string").alias("id"), "result")
    path = S.write_answers(rows, cards(spark, sf).select(F.col("id").cast("string").alias("id")), new_folder(spark, "answers"))
    return spark.read.options(**S.CSV).schema("id string, result string").csv(path)


@query("src10_registry", """WITH o AS (SELECT source AS variant, CAST(count(*) AS VARCHAR) AS n, 'kept ' || source AS note, 'x' AS gone FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 GROUP BY source),
 w AS (SELECT source AS variant, CAST(count(*) AS VARCHAR) AS n, CAST(CAST(sum(length(text)) AS BIGINT) AS VARCHAR) AS chars FROM documents WHERE lang = 'en' GROUP BY source)
 SELECT coalesce(w.variant, o.variant) AS variant, coalesce(w.n, o.n, '') AS n, CASE WHEN w.variant IS NULL THEN '' ELSE coalesce(w.chars, '') END AS chars, coalesce(o.note, '') AS note, CASE WHEN w.variant IS NULL THEN coalesce(o.gone, '') ELSE '' END AS gone FROM w FULL JOIN o ON w.variant = o.variant""")
def src10_registry(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    old = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id").groupBy(F.col("source").alias("variant")).agg(F.count("*").cast("string").alias("n")).select("variant", "n", F.concat(F.lit("kept "), "variant").alias("note"), F.lit("x").alias("gone"))
    new = docs.where("lang = 'en'").groupBy(F.col("source").alias("variant")).agg(F.count("*").cast("string").alias("n"), F.sum(F.length("text")).cast("string").alias("chars"))
    return S.upserted(old, new, "variant", ["note"])


@query("src11_questions", "WITH l AS (SELECT trim(CASE WHEN role = 'user' THEN '# ' ELSE '' END || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '|' || replace(text, chr(10), ' ')) AS line FROM conversations) SELECT trim(substr(line, 1, position('|' IN line) - 1)) AS key, trim(substr(line, position('|' IN line) + 1)) AS question FROM l WHERE line NOT LIKE '#%'")
def src11_questions(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    line = F.concat(F.when(F.col("role") == "user", "# ").otherwise(""), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("|"), F.replace("text", F.lit("\n"), F.lit(" ")))
    return S.questions(c.select(line.alias("value")))
