"""Every named query, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwright.functions import text as T
from cardwright.operators import duplicates as D
from cardwright.operators import ranking as R
from cardwright.operators import features as V
from cardwright.operators.cards import card_texts, cards, scored, unit
from cardwright.session import stepwise
from cardwright.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CARDS = """cards AS (SELECT d.doc_id AS id, substr(split_part(coalesce(d.text, ''), chr(10), 1), 1, 70) AS name, coalesce(d.text, '') AS description,
  coalesce(d.lang, '') AS category, l.quality AS label, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
UNIT = "(CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || '{1}'), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE)"
SCORED = f"""scored AS (SELECT d.doc_id AS id, coalesce(d.lang, '') AS category, l.quality AS label, l.toxic,
  round({UNIT.format('d.doc_id', 'text')} * 0.75::DOUBLE + coalesce(l.quality, 0) * 0.25::DOUBLE, 4) AS a,
  round({UNIT.format('d.doc_id', 'image')} * 0.75::DOUBLE + coalesce(l.quality, 0) * 0.25::DOUBLE, 4) AS b
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
NORM = "trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^0-9a-zа-яё]+', ' ', 'g'))"
COLL = "trim(regexp_replace({0}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = stepwise(f)
        if sql:
            ORACLES[name] = sql
        return f

    return add


# sources, projections, predicates


@query("src01_cards", f"WITH {CARDS} SELECT id, name, length(description) AS n_description, category, label FROM cards")
def src01_cards(spark, sf):
    return cards(spark, sf).select("id", "name", F.length("description").cast("long").alias("n_description"), "category", "label")


@query("p01_normalize", f"WITH {CARDS}, t AS (SELECT id, {NORM.format('description')} AS t FROM cards) SELECT id, length(t) AS n, substr(md5(t), 1, 16) AS digest FROM t")
def p01_normalize(spark, sf):
    t = cards(spark, sf).select("id", T.normalized(F.col("description")).alias("t"))
    return t.select("id", F.length("t").cast("long").alias("n"), T.digest(F.col("t")).alias("digest"))


_MODEL_TEXT = COLL.format("replace(lower(name || ' ' || chr(10) || ' ' || substr(description, 1, 2500)), 'ё', 'е')")


@query("p02_model_text", f"WITH {CARDS} SELECT id, {_MODEL_TEXT} AS model_text FROM cards")
def p02_model_text(spark, sf):
    return cards(spark, sf).select("id", T.model_text(F.col("name"), F.col("description")).alias("model_text"))


# Fixed value: what a comment says where it has nothing of its own.
FALLBACK = "Автоматическая проверка карточки завершена, решение принято по названию, описанию и изображениям товара."
_TIDY = "trim(replace(replace({0}, '<комментарий>', ' '), '<вердикт>', ' '))".format(COLL.format("description"))
_CLIPPED = f"""pl AS (SELECT id, coalesce(label, 0) AS v, coalesce(nullif({_TIDY}, ''), '{FALLBACK}') AS t FROM cards),
 hd AS (SELECT id, v, t, substr(t, 1, 301) AS h, CASE WHEN contains(substr(t, 1, 301), ' ') THEN length(substr(t, 1, 301)) - position(' ' IN reverse(substr(t, 1, 301))) ELSE -1 END AS c FROM pl),
 ct AS (SELECT id, v, CASE WHEN length(t) <= 300 THEN t ELSE rtrim(CASE WHEN c > 50 THEN substr(h, 1, c) ELSE substr(h, 1, 300) END, ' ,;:-') END AS t FROM hd),
 cl AS (SELECT id, v, CASE WHEN length(t) < 50 THEN substr({COLL.format("rtrim(t, '. ') || '. " + FALLBACK + "'")}, 1, 300) ELSE t END AS t FROM ct)"""
ANSWERS = f"{CARDS}, {_CLIPPED}, answers AS (SELECT id, rpad(t, CAST(greatest(50, length(t)) AS INTEGER), ' ') AS comment, '<комментарий>' || rpad(t, CAST(greatest(50, length(t)) AS INTEGER), ' ') || '<вердикт>' || CASE WHEN v = 1 THEN 'не бан' ELSE 'бан' END AS result, CASE WHEN v = 1 THEN 'не бан' ELSE 'бан' END AS verdict FROM cl)"


def answers(spark, sf):
    """id, comment, result, verdict: parsed from the result again."""
    made = cards(spark, sf).select("id", T.answer(T.clipped(F.col("description"), FALLBACK), F.coalesce("label", F.lit(0))).alias("result"))
    return made.select("id", F.regexp_extract("result", S.ANSWER, 1).alias("comment"), "result", F.regexp_extract("result", S.ANSWER, 2).alias("verdict"))


@query("p16_answer", f"WITH {ANSWERS} SELECT * FROM answers")
def p16_answer(spark, sf):
    return answers(spark, sf)


@query("p21_sigmoid", f"WITH {SCORED} SELECT id, round(1 / (1 + exp(-(ln(exp(a) + exp(b)) - ln(exp(1 - a) + exp(1 - b))))), 6) AS p FROM scored")
def p21_sigmoid(spark, sf):
    lse = lambda *c: F.log(sum((F.exp(x) for x in c[1:]), F.exp(c[0])))
    return scored(spark, sf).select("id", F.round(1 / (1 + F.exp(-(lse(F.col("a"), F.col("b")) - lse(1 - F.col("a"), 1 - F.col("b"))))), 6).alias("p"))


@query("p25_probe", f"WITH {SCORED}, u AS (SELECT id, category, {UNIT.format('id', '')} AS u, a FROM scored) SELECT id, round(u, 6) AS unit, CAST((a >= 0.25) AS INTEGER) + CAST((a >= 0.5) AS INTEGER) + CAST((a >= 0.75) AS INTEGER) AS bucket, CASE WHEN category = 'en' AND u < 0.4 THEN 1 ELSE 0 END AS probe FROM u")
def p25_probe(spark, sf):
    u = unit(F.col("id"))
    bucket = sum(((F.col("a") >= e).cast("int") for e in (0.5, 0.75)), (F.col("a") >= 0.25).cast("int"))
    return scored(spark, sf).select("id", F.round(u, 6).alias("unit"), bucket.alias("bucket"), F.when((F.col("category") == "en") & (u < 0.4), 1).otherwise(0).alias("probe"))


@query("p22_forced_verdict", f"WITH {SCORED} SELECT id, CASE WHEN category IN ('fr', 'es') THEN 0 WHEN category = 'de' THEN 1 ELSE CAST(a >= 0.5 AS INTEGER) END AS verdict FROM scored")
def p22_forced_verdict(spark, sf):
    return scored(spark, sf).select("id", F.when(F.col("category").isin("fr", "es"), 0).when(F.col("category") == "de", 1).otherwise((F.col("a") >= 0.5).cast("int")).alias("verdict"))


@query("p29_short_text", f"WITH {CARDS} SELECT id, nullif(trim(substr({COLL.format('description')}, 1, 80), ' .,;:'), '') AS short FROM cards")
def p29_short_text(spark, sf):
    head = F.substring(T.collapsed(F.col("description")), 1, 80)
    return cards(spark, sf).select("id", F.nullif(F.trim(head, F.lit(" .,;:")), F.lit("")).alias("short"))


# duplicates


_NORMAL = f"n AS (SELECT id, category, label, {NORM.format('name')} AS n, {NORM.format('description')} AS d FROM cards)"
_SOME = """ UNION ALL SELECT id, category, label, 'desc', substr(md5(d), 1, 16) FROM n WHERE length(d) >= 40
  UNION ALL SELECT id, category, label, 'name', substr(md5(n), 1, 16) FROM n WHERE length(n) >= 10)"""
_KEYS = f"{_NORMAL}, keys AS (SELECT id, category, label, 'name_desc' AS kind, substr(md5(n || '|' || d), 1, 16) AS key FROM n {_SOME}"
_LOOKUP_KEYS = f"{_NORMAL}, keys AS (SELECT id, category, label, 'name_desc' AS kind, substr(md5(n || '|' || d), 1, 16) AS key FROM n WHERE length(n) > 0 AND length(d) > 0 {_SOME}"
_BANDS = f"""w AS (SELECT id, category, label, string_split({NORM.format('description')}, ' ') AS w FROM cards),
 x AS (SELECT DISTINCT id, substr(md5(array_to_string(w[i : i + 7], ' ')), 1, 12) AS h FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 12)),
 y AS (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) - 1 AS r FROM x), z AS (SELECT id, r // 4 AS b, string_agg(h, '-' ORDER BY h) AS hs, count(*) AS c FROM y WHERE r < 16 GROUP BY id, r // 4),
 bands AS (SELECT id, CAST(b AS INTEGER) AS ord, substr(md5(CAST(b AS VARCHAR) || '-' || hs), 1, 16) AS key FROM z WHERE c = 4)"""


@query("g03_bands", f"WITH {CARDS}, {_BANDS} SELECT id, ord, key FROM bands")
def g03_bands(spark, sf):
    return D.bands(cards(spark, sf)).select("id", "ord", "key")


@query("g04_exact_keys", f"WITH {CARDS}, {_KEYS} SELECT id, kind, key FROM keys")
def g04_exact_keys(spark, sf):
    return D.exact_keys(cards(spark, sf)).select("id", "kind", "key")


@query("g04_lookup_keys", f"WITH {CARDS}, {_LOOKUP_KEYS} SELECT id, kind, key FROM keys")
def g04_lookup_keys(spark, sf):
    return D.exact_keys(cards(spark, sf), lookup=True).select("id", "kind", "key")


_ALL = f"{CARDS}, {_KEYS}, {_BANDS}, allkeys AS (SELECT id, kind, key FROM keys UNION ALL SELECT id, 'band', key FROM bands)"
_EDGES = """heads AS (SELECT kind, key, min(id) AS a FROM allkeys GROUP BY kind, key HAVING count(DISTINCT id) > 1 AND (kind <> 'band' OR count(DISTINCT id) <= 60)),
 edges AS (SELECT DISTINCT a, k.id AS b FROM allkeys k JOIN heads USING (kind, key) WHERE a <> k.id)"""
_GROUPS = """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT id AS s, id AS t FROM cards UNION SELECT s, b FROM reach JOIN both_ways ON t = a),
 grouped AS (SELECT c.id, c.category, c.label, g.grp FROM cards c JOIN (SELECT s, min(t) AS grp FROM reach GROUP BY s) g ON c.id = g.s)"""
_PURITY = """g AS (SELECT category, grp, count(*) AS n, avg(label) AS m FROM grouped WHERE label IS NOT NULL GROUP BY category, grp)
 SELECT category, count(*) AS n_groups, count(*) FILTER (n > 1) AS n_multi, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_items_multi,
 count(*) FILTER (n > 1 AND m > 0 AND m < 1) AS n_mixed, round(CASE WHEN count(*) FILTER (n > 1) > 0 THEN 1 - count(*) FILTER (n > 1 AND m > 0 AND m < 1) / (count(*) FILTER (n > 1))::DOUBLE ELSE 1 END, 6) AS purity FROM g GROUP BY category"""


_OVERALL = _PURITY.replace("SELECT category, grp, count(*)", "SELECT 'all' AS category, grp, count(*)").replace("GROUP BY category, grp", "GROUP BY grp")


def _keys(spark, sf, use="grouping"):
    return D.all_keys(cards(spark, sf), use == "lookup")


def _groups(spark, sf):
    return D.groups(cards(spark, sf), _keys(spark, sf))


@query("g05_links", f"WITH {_ALL}, {_EDGES} SELECT a, b FROM edges")
def g05_links(spark, sf):
    return D.star_edges(_keys(spark, sf))


@query("g08_components", f"WITH RECURSIVE {_ALL}, {_EDGES}, {_GROUPS} SELECT id, grp FROM grouped")
def g08_components(spark, sf):
    return _groups(spark, sf).select("id", "grp")


@query("g08_duplicate_groups", f"WITH RECURSIVE {_ALL}, {_EDGES}, {_GROUPS}, {_PURITY}")
def g08_duplicate_groups(spark, sf):
    return D.purity(_groups(spark, sf), "category")


@query("a01_purity", f"WITH RECURSIVE {_ALL}, {_EDGES}, {_GROUPS}, {_OVERALL}")
def a01_purity(spark, sf):
    return D.purity(_groups(spark, sf).withColumn("category", F.lit("all")), "category")


#: Hashes of pictures, played by a document's length and origin.
_PICTURES = "pics AS (SELECT doc_id AS id, 'm' AS kind, md5(CAST(n_chars AS VARCHAR) || source) AS key FROM documents UNION ALL SELECT doc_id, 'p', substr(md5(CAST(n_chars // 4 AS VARCHAR) || source || lang), 1, 16) FROM documents)"
_PICTURE_HEADS = """heads AS (SELECT kind, key, min(id) AS a FROM pics WHERE key IS NOT NULL GROUP BY kind, key HAVING count(DISTINCT id) > 1 AND count(DISTINCT id) <= CASE kind WHEN 'm' THEN 60 ELSE 12 END),
 edges AS (SELECT DISTINCT a, k.id AS b FROM pics k JOIN heads USING (kind, key) WHERE a <> k.id)"""


def _pictures(spark, sf):
    n, where = F.col("n_chars"), F.col("source")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return D.picture_keys(docs.select(F.col("doc_id").alias("id"), F.md5(F.concat(n.cast("string"), where)).alias("exact"), T.digest(F.concat(F.floor(n / 4).cast("string"), where, "lang")).alias("like")))


@query("g06_picture_links", f"WITH {_PICTURES}, {_PICTURE_HEADS} SELECT a, b FROM edges")
def g06_picture_links(spark, sf):
    return D.star_edges(_pictures(spark, sf))


_VARIANT = lambda name, keys, tail: f"(WITH RECURSIVE {CARDS}, {keys}, {_EDGES}, {_GROUPS}, {_PURITY.replace('SELECT category, count(*) AS n_groups', f'SELECT {chr(39)}{name}{chr(39)} AS variant, category, count(*) AS n_groups')})"
_EXACT = f"{_KEYS}, allkeys AS (SELECT id, kind, key FROM keys)"
_SHINGLED = f"{_KEYS}, {_BANDS}, allkeys AS (SELECT id, kind, key FROM keys UNION ALL SELECT id, 'band', key FROM bands)"
_PICTURED = f"{_KEYS}, {_BANDS}, {_PICTURES}, allkeys AS (SELECT id, kind, key FROM keys UNION ALL SELECT id, 'band', key FROM bands UNION ALL SELECT id, kind, key FROM pics WHERE key IS NOT NULL)"
_CAPPED = lambda sql: sql.replace("(kind <> 'band' OR count(DISTINCT id) <= 60)", "(kind NOT IN ('band', 'm', 'p') OR count(DISTINCT id) <= CASE kind WHEN 'p' THEN 12 ELSE 60 END)")


@query("g09_ablation", _CAPPED(" UNION ALL ".join([_VARIANT("exact", _EXACT, ""), _VARIANT("shingles", _SHINGLED, ""), _VARIANT("pictures", _PICTURED, "")])))
def g09_ablation(spark, sf):
    """Links are made once; each variant groups by those of its kinds."""
    c, keys = cards(spark, sf), _keys(spark, sf).select("id", "kind", "key")
    exact, band, pictures = D.star_edges(keys.where("kind <> 'band'")), D.star_edges(keys.where("kind = 'band'")), D.star_edges(_pictures(spark, sf))
    variants = {"exact": exact, "shingles": exact.union(band), "pictures": exact.union(band).union(pictures)}
    done = [D.purity(D.linked_groups(c, edges), "category").withColumn("variant", F.lit(name)) for name, edges in variants.items()]
    return done[0].unionByName(done[1]).unionByName(done[2])


@query("a03_rare_stats", f"WITH RECURSIVE {_ALL}, {_EDGES}, {_GROUPS}, s AS (SELECT grp, count(*) AS n FROM grouped GROUP BY grp) SELECT category, count(*) AS positives, count(DISTINCT g.grp) AS n_groups, count(*) FILTER (n > 1) AS with_sibling FROM grouped g JOIN s ON g.grp = s.grp WHERE label = 1 GROUP BY category")
def a03_rare_stats(spark, sf):
    g = _groups(spark, sf)
    size = g.groupBy("grp").agg(F.count("*").alias("n"))
    return g.where("label = 1").join(size, "grp").groupBy("category").agg(F.count("*").alias("positives"), F.count_distinct("grp").alias("n_groups"), F.count_if(F.col("n") > 1).alias("with_sibling"))


KNOWN = f"""{CARDS}, {_LOOKUP_KEYS}, {_BANDS}, lk AS (SELECT id, category, label, kind, 0 AS ord, key FROM keys UNION ALL SELECT b.id, c.category, c.label, 'band', ord, key FROM bands b JOIN cards c ON b.id = c.id),
 m AS (SELECT kind, key, category, sum(label) AS s, count(*) AS c FROM lk WHERE label IS NOT NULL GROUP BY kind, key, category),
 known AS (SELECT kind, key, round(sum(s) / sum(c)::DOUBLE, 4) AS label, CAST(sum(c) AS BIGINT) AS n, arg_min(category, (-c, category)) AS category FROM m GROUP BY kind, key HAVING kind <> 'band' OR sum(c) <= 60)"""


@query("g10_duplicate_table", f"WITH {KNOWN} SELECT * FROM known")
def g10_duplicate_table(spark, sf):
    return D.known(_keys(spark, sf, "lookup"))


_HITS = f"""{KNOWN}, tiers AS (SELECT lk.id, CASE lk.kind WHEN 'name_desc' THEN 1 WHEN 'desc' THEN 2 WHEN 'name' THEN 3 ELSE 4 END AS tier, ord, known.label AS hit FROM lk JOIN known USING (kind, key) WHERE lk.label IS NULL),
 hits AS (SELECT id, arg_min(hit, (tier, ord)) AS hit, CAST(min(tier) AS INTEGER) AS tier FROM tiers GROUP BY id)"""


@query("j04_tiered_lookup", f"WITH {_HITS} SELECT * FROM hits")
def j04_tiered_lookup(spark, sf):
    keys = _keys(spark, sf, "lookup")
    return D.looked_up(keys.where("label IS NULL"), D.known(keys))


@query("g11_lookup", f"WITH {_HITS}, {SCORED.replace('scored AS', 'sc AS')} SELECT sc.id, hit, CASE WHEN abs(hit - 0.5) > 1e-9 THEN CAST(hit > 0.5 AS INTEGER) ELSE CAST(a >= 0.5 AS INTEGER) END AS verdict FROM sc LEFT JOIN hits USING (id) WHERE sc.label IS NULL")
def g11_lookup(spark, sf):
    keys = _keys(spark, sf, "lookup")
    model = scored(spark, sf).where("label IS NULL").select("id", (F.col("a") >= 0.5).cast("int").alias("verdict"))
    return D.applied(model, D.looked_up(keys.where("label IS NULL"), D.known(keys))).select("id", "hit", "verdict")


@query("g14_coverage", f"WITH {_HITS} SELECT count(*) AS n, count(hit) AS n_known, round(count(hit) / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER (abs(hit - 0.5) > 1e-9) AS n_decided FROM cards LEFT JOIN hits USING (id) WHERE label IS NULL")
def g14_coverage(spark, sf):
    keys = _keys(spark, sf, "lookup")
    rows = cards(spark, sf).where("label IS NULL").select("id").join(D.looked_up(keys.where("label IS NULL"), D.known(keys)), "id", "left")
    return rows.agg(F.count("*").alias("n"), F.count("hit").alias("n_known"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"), F.count_if(F.abs(F.col("hit") - 0.5) > 1e-9).alias("n_decided"))


# joins, reports, set operations


@query("j06_not_done", "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j06_not_done(spark, sf):
    docs, done = (spark.read.parquet(f"{sf}/{t}.parquet").select(F.col("doc_id").alias("id")) for t in ("documents", "labels"))
    return docs.join(done, "id", "left_anti")


@query("j07_only_known", "SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def j07_only_known(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"))
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "source").join(vectors, "id", "left_semi")


@query("j05_aligned", "SELECT d.doc_id AS id, coalesce(CAST(l.quality AS DOUBLE), 0.5) AS qa, coalesce(v.label, -1) AS cluster, coalesce(c.text, '') AS said FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id")
def j05_aligned(spark, sf):
    said = S.first_per_key(spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("id"), "turn", "text"), ["id"], ["turn"])
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("qa"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id")).join(labels, "id", "left").join(vectors, "id", "left").join(said.select("id", F.col("text").alias("said")), "id", "left")
    return rows.select("id", F.coalesce("qa", F.lit(0.5)).alias("qa"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("said", F.lit("")).alias("said"))


_THRESHOLDS = {"en": 0.6, "de": 0.55}


@query("j03_threshold_lookup", f"WITH {SCORED} SELECT id, CAST(a >= CASE category WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.55 ELSE 0.5 END AS INTEGER) AS verdict FROM scored")
def j03_threshold_lookup(spark, sf):
    at = F.create_map(*[F.lit(x) for kv in _THRESHOLDS.items() for x in kv])
    return scored(spark, sf).select("id", (F.col("a") >= F.coalesce(at[F.col("category")], F.lit(0.5))).cast("int").alias("verdict"))


@query("a06_shared_texts", "WITH g AS (SELECT md5(text) AS h, count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (n > 1) AS n_shared, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_items, round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 2)::DOUBLE AS share FROM g")
def a06_shared_texts(spark, sf):
    g = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").groupBy(F.md5("text").alias("h")).agg(F.count_distinct("doc_id").alias("n"))
    many = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return g.agg(F.count_if(F.col("n") > 1).alias("n_shared"), many.alias("n_items"), F.round(100.0 * many / F.sum("n"), 2).alias("share"))


@query("a07_turn_histogram", "WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id), h AS (SELECT turns, count(*) AS n FROM c GROUP BY turns) SELECT turns, n, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS share FROM h")
def a07_turn_histogram(spark, sf):
    h = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("turns")).groupBy("turns").agg(F.count("*").alias("n"))
    return h.select("turns", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1).alias("share"))


@query("a08_describe", "SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS least, max(n_chars) AS most, round(quantile_cont(n_chars, 0.05), 6) AS q05, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.95), 6) AS q95 FROM documents")
def a08_describe(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("n_chars", F.lit(0).alias("k"))
    c = F.col("n_chars")
    plain = rows.groupBy("k").agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"))
    at = {0.05: "q05", 0.5: "q50", 0.95: "q95"}
    points = R.quantiles(rows, ["k"], "n_chars", list(at)).groupBy("k").agg(*[F.round(F.max(F.when(F.col("point") == p, F.col("value"))), 6).alias(name) for p, name in at.items()])
    return plain.join(points, "k", "left").drop("k")


@query("a09_top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def a09_top_sources(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(5)


_FOLD = "CAST('0x' || substr(md5(CAST(id AS VARCHAR) || 'fold'), 1, 8) AS BIGINT) % 5"


def _fold():
    return (F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("fold"))), 1, 8), 16, 10).cast("long") % 5).alias("fold")


@query("a10_fold_pivot", f"WITH {SCORED}, f AS (SELECT {_FOLD} AS fold, category, label FROM scored) SELECT fold, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}_n, CAST(coalesce(sum(label) FILTER (category = '{c}'), 0) AS BIGINT) AS {c}_pos" for c in ("de", "en", "es", "fr")) + " FROM f GROUP BY fold")
def a10_fold_pivot(spark, sf):
    p = scored(spark, sf).select(_fold(), "category", "label").groupBy("fold").pivot("category", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return p.na.fill(0)


@query("a11_smoothed_scores", f"WITH RECURSIVE {_ALL}, {_EDGES}, {_GROUPS}, {SCORED.replace('scored AS', 'sc AS')}, g AS (SELECT sc.id, a, CASE WHEN sc.category = 'en' THEN grp ELSE -1 - sc.id END AS g FROM sc JOIN grouped ON sc.id = grouped.id) SELECT id, round(avg(a) OVER (PARTITION BY g), 6) AS smooth FROM g")
def a11_smoothed_scores(spark, sf):
    """Scores become the means of their near-duplicate groups, in one category only."""
    rows = scored(spark, sf).select("id", "a", "category").join(_groups(spark, sf).select("id", "grp"), "id")
    rows = rows.withColumn("g", F.when(F.col("category") == "en", F.col("grp")).otherwise(-1 - F.col("id")))
    return rows.join(rows.groupBy("g").agg(R.mean_of_decimals("a", 4).alias("x")), "g").select("id", F.round("x", 6).alias("smooth"))


_TRUTH = f"{SCORED}, t AS (SELECT category, label AS y, CAST(a >= 0.5 AS INTEGER) AS v FROM scored WHERE label IS NOT NULL), c AS (SELECT category, CAST(sum(y * v) AS BIGINT) AS tp, CAST(sum((1 - y) * v) AS BIGINT) AS fp, CAST(sum(y * (1 - v)) AS BIGINT) AS fn FROM t GROUP BY category)"


@query("a12_f1", f"WITH {_TRUTH} SELECT category, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM c")
def a12_f1(spark, sf):
    y, v = F.col("label"), (F.col("a") >= 0.5).cast("int")
    c = scored(spark, sf).where("label IS NOT NULL").groupBy("category").agg(F.sum(y * v).alias("tp"), F.sum((1 - y) * v).alias("fp"), F.sum(y * (1 - v)).alias("fn"))
    return c.withColumn("f1", F.round(R.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query("a14_prior_weights", f"WITH {SCORED}, c AS (SELECT category, sum(label) AS p, count(label) - sum(label) AS q FROM scored GROUP BY category) SELECT s.id, round(CASE WHEN s.label = 1 THEN 1 ELSE p * 0.9 / (0.1 * q) END, 6)::DOUBLE AS weight FROM scored s JOIN c USING (category) WHERE s.label IS NOT NULL AND q > 0")
def a14_prior_weights(spark, sf):
    s = scored(spark, sf).where("label IS NOT NULL").select("id", "category", "label")
    c = s.groupBy("category").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).where("q > 0")
    return s.join(c, "category").select("id", F.round(F.when(F.col("label") == 1, 1.0).otherwise(F.col("p") * 0.9 / (0.1 * F.col("q"))), 6).alias("weight"))


@query("a22_cell_mean", f"WITH {SCORED} SELECT round(avg(m), 6) AS balanced FROM (SELECT category, label, avg(a) AS m FROM scored WHERE label IS NOT NULL GROUP BY category, label)")
def a22_cell_mean(spark, sf):
    return scored(spark, sf).where("label IS NOT NULL").groupBy("category", "label").agg(F.avg("a").alias("m")).agg(F.round(F.avg("m"), 6).alias("balanced"))


# ranks, selection, curves

_RANK = "(rank() OVER (PARTITION BY category ORDER BY {0}) + (count(*) OVER (PARTITION BY category, {0}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY category)"


@query("w01_percentile_rank", f"WITH {SCORED} SELECT id, round({_RANK.format('a')}, 6) AS r FROM scored")
def w01_percentile_rank(spark, sf):
    return R.percentile_rank(scored(spark, sf), ["category"], "a", "r").select("id", F.round("r", 6).alias("r"))


@query("w03_rank_blend", f"WITH {SCORED}, r AS (SELECT id, {_RANK.format('a')} AS ra, {_RANK.format('b')} AS rb FROM scored) SELECT id, round(greatest(ra, rb), 6) AS r_max, round(0.7::DOUBLE * ra + 0.3::DOUBLE * rb, 6) AS r_mix FROM r")
def w03_rank_blend(spark, sf):
    r = R.percentile_rank(R.percentile_rank(scored(spark, sf), ["category"], "a", "ra"), ["category"], "b", "rb")
    return r.select("id", F.round(F.greatest("ra", "rb"), 6).alias("r_max"), F.round(0.7 * F.col("ra") + 0.3 * F.col("rb"), 6).alias("r_mix"))


@query("w04_rate_selection", f"WITH {SCORED}, r AS (SELECT id, category, a, row_number() OVER (PARTITION BY category ORDER BY a DESC) AS k, count(*) OVER (PARTITION BY category) AS n FROM scored), t AS (SELECT category, min(a) AS bar FROM r WHERE k <= greatest(1, round_even(0.15::DOUBLE * n, 0)) GROUP BY category) SELECT id, a >= bar AS picked FROM r JOIN t USING (category)")
def w04_rate_selection(spark, sf):
    return R.rate_selected(scored(spark, sf), ["category"], "a", 0.15, "picked").select("id", "picked")


@query("w05_top_fraction", f"WITH {SCORED} SELECT id, row_number() OVER (PARTITION BY category ORDER BY a DESC, id) <= ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY category)) AS picked FROM scored")
def w05_top_fraction(spark, sf):
    return R.top_fraction(scored(spark, sf), ["category"], "a", "id", 0.1, "picked").select("id", "picked")


@query("w08_quantile_blend", f"WITH {SCORED}, q AS (SELECT s.id, (SELECT (count(*) FILTER (r.a < s.a) + count(*) FILTER (r.a <= s.a)) / (2.0::DOUBLE * count(*)) FROM scored r WHERE r.category = s.category AND r.label IS NOT NULL) AS qa, (SELECT (count(*) FILTER (r.b < s.b) + count(*) FILTER (r.b <= s.b)) / (2.0::DOUBLE * count(*)) FROM scored r WHERE r.category = s.category AND r.label IS NOT NULL) AS qb FROM scored s) SELECT id, round(qa, 6) AS q_text, round(0.6::DOUBLE * coalesce(qa, 0.5) + 0.4::DOUBLE * coalesce(qb, 0.5), 6) AS blend FROM q")
def w08_quantile_blend(spark, sf):
    s = scored(spark, sf)
    ref = s.where("label IS NOT NULL")
    q = R.quantile_map(R.quantile_map(s, ref, ["category"], "a", "qa"), ref, ["category"], "b", "qb")
    return q.select("id", F.round("qa", 6).alias("q_text"), F.round(0.6 * F.col("qa") + 0.4 * F.col("qb"), 6).alias("blend"))


GRID = [round(0.01 + 0.005 * k, 3) for k in range(197)]
_SWEEP = "grid AS (SELECT CAST(round(0.01 + 0.005 * k, 3) AS DOUBLE) AS threshold FROM range(197) t(k)), w AS (SELECT category, threshold, sum(CASE WHEN a >= threshold THEN label ELSE 0 END) AS tp, sum(CASE WHEN a >= threshold THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN a >= threshold THEN 0 ELSE label END) AS fn FROM scored, grid WHERE label IS NOT NULL GROUP BY category, threshold), f AS (SELECT category, threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM w)"


@query("w14_threshold_sweep", f"WITH {SCORED}, {_SWEEP} SELECT category, arg_min(threshold, (-f1, threshold)) AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY category")
def w14_threshold_sweep(spark, sf):
    return R.best_threshold(R.sweep(scored(spark, sf), ["category"], "a", "label", GRID), ["category"])


@query(
    "w16_curves",
    f"""WITH {SCORED}, s AS (SELECT category, a, label AS y FROM scored WHERE label IS NOT NULL), d AS (SELECT category, a, count(*) AS n, sum(y) AS p FROM s GROUP BY category, a),
 r AS (SELECT *, coalesce(sum(n - p) OVER u, 0) AS nb, sum(p) OVER v AS pc, sum(n) OVER v AS nc FROM d WINDOW u AS (PARTITION BY category ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY category ORDER BY a DESC))
 SELECT category, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN round(sum(p * (nb + (n - p) / 2.0::DOUBLE)) / (sum(p) * (sum(n) - sum(p))), 6) END AS auc,
 CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN round(sum(p * pc / nc::DOUBLE) / sum(p), 6) END AS ap FROM r GROUP BY category""",
)
def w16_curves(spark, sf):
    return R.curves(scored(spark, sf), ["category"], "a", "label")


@query("u03_first_per_key", "SELECT source, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def u03_first_per_key(spark, sf):
    return S.first_per_key(spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "lang", "n_chars"), ["source"], ["doc_id"])


# features


@query("f15_int8", "WITH e AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS s FROM embeddings) SELECT vec_id, round(CASE WHEN s = 0 THEN 1 ELSE s END, 6)::DOUBLE AS scale, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(x::DOUBLE / CASE WHEN s = 0 THEN 1 ELSE s END, 0))) AS INTEGER)), ',') AS q FROM e")
def f15_int8(spark, sf):
    scale, q = V.quantised(F.col("embedding"))
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.round(scale, 6).alias("scale"), F.array_join(F.transform(q, lambda x: x.cast("string")), ",").alias("q"))


@query("f16_contrast", f"WITH {SCORED} SELECT id, round(a - b, 6) AS contrast, round((a - (1 - b)) / 2, 6) AS symmetric FROM scored")
def f16_contrast(spark, sf):
    return scored(spark, sf).select("id", F.round(F.col("a") - F.col("b"), 6).alias("contrast"), F.round((F.col("a") - (1 - F.col("b"))) / 2, 6).alias("symmetric"))


_TEXTS = f"txt AS (SELECT id, {_MODEL_TEXT} AS text FROM cards)"
_GRAMS = "ws AS (SELECT id, regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}') AS w FROM txt), grams AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM ws)"
_CHARS = "wd AS (SELECT id, unnest(string_split(text, ' ')) AS w FROM txt), pd AS (SELECT id, ' ' || w || ' ' AS p FROM wd WHERE w <> ''), grams AS (SELECT id, substr(p, CAST(i AS BIGINT), k) AS t FROM (SELECT id, p, k, unnest(range(1, 1 + greatest(length(p) - k + 1, 1))) AS i FROM pd, (SELECT unnest([3, 4, 5]) AS k) WHERE k = 3 OR length(p) > k - 1))"
_WEIGHTS = lambda least: f"tf AS (SELECT id, t, count(*) AS c FROM grams GROUP BY id, t), df AS (SELECT t, count(*) AS d FROM tf GROUP BY t HAVING count(*) >= {least}), nn AS (SELECT count(*) AS n FROM cards), wt AS (SELECT id, tf.t, d, (1 + ln(c)) * (ln((1 + n) / (1 + d)::DOUBLE) + 1) AS w FROM tf JOIN df ON tf.t = df.t, nn)"
_NORMS = "SELECT id, count(*) AS n_terms, round(sqrt(sum(w * w)), 4) AS norm, round(max(w) / sqrt(sum(w * w)), 5) AS top FROM wt GROUP BY id"


def _texts(spark, sf):
    return cards(spark, sf).select("id", T.model_text(F.col("name"), F.col("description")).alias("text"))


def _norms(weights):
    return weights.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.first("norm"), 4).alias("norm"), F.round(F.max("w"), 5).alias("top"))


def _many(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").count()


@query("f01_tfidf", f"WITH {CARDS}, {_TEXTS}, {_GRAMS}, {_WEIGHTS(2)} {_NORMS}")
def f01_tfidf(spark, sf):
    return _norms(V.weighted(V.word_counts(_texts(spark, sf)), _many(spark, sf)))


@query("f02_char_tfidf", f"WITH {CARDS}, {_TEXTS}, {_CHARS}, {_WEIGHTS(3)} {_NORMS}")
def f02_char_tfidf(spark, sf):
    c = card_texts(spark, sf)
    texts = c.select("id", T.model_text(F.col("name"), F.col("description")).alias("text"))
    return V.char_weighted(texts, c.count(), 3).select("id", "n_terms", F.round("norm", 4).alias("norm"), F.round("top", 5).alias("top"))


_NAMED = f"tx AS (SELECT {_MODEL_TEXT} AS text, id FROM (SELECT id, name, '' AS description FROM cards)), txt AS (SELECT min(id) AS id, text FROM tx GROUP BY text)"
_COSINES = f"{CARDS}, {_NAMED}, {_GRAMS}, {_WEIGHTS(2).replace('FROM cards', 'FROM txt')}, un AS (SELECT wt.id, t, w / norm AS w FROM wt JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id) USING (id)), cs AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS cosine FROM un x JOIN un y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id HAVING sum(x.w * y.w) >= 0.6)"


def _named(spark, sf):
    """One card for each name; equal names are one class."""
    return cards(spark, sf).select("id", T.model_text(F.col("name"), F.lit("")).alias("text")).groupBy("text").agg(F.min("id").alias("id"))


@query("j08_similar_names", f"WITH {_COSINES} SELECT a, b, round(cosine, 5) AS cosine FROM cs")
def j08_similar_names(spark, sf):
    texts = _named(spark, sf)
    return V.similar(V.weighted(V.word_counts(texts), texts.count()), 0.6).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("g07_similar_groups", f"WITH RECURSIVE {_COSINES}, members AS (SELECT tx.id AS b, txt.id AS a FROM tx JOIN txt USING (text) WHERE tx.id <> txt.id), edges AS (SELECT a, b FROM cs UNION SELECT a, b FROM members), {_GROUPS} SELECT id, grp FROM grouped")
def g07_similar_groups(spark, sf):
    """Cards whose names are equal or similar, and what these links join."""
    c, texts = cards(spark, sf), _named(spark, sf)
    links = V.similar(V.weighted(V.word_counts(texts), texts.count()), 0.6).select("a", "b")
    equal = c.select(F.col("id").alias("b"), T.model_text(F.col("name"), F.lit("")).alias("text")).join(texts.withColumnRenamed("id", "a"), "text").where("a <> b").select("a", "b")
    return D.linked_groups(c, links.union(equal)).select("id", "grp")


@query("f09_nearest", """WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT query, vec_id AS id, label, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 9) AS c FROM q, embeddings WHERE vec_id <> query),
 n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s), k AS (SELECT query, label, sum(1 / greatest(1 - c, 1e-12)) AS w FROM n WHERE rank <= 15 GROUP BY query, label)
 SELECT query, arg_min(label, (-round(w, 6), label)) AS label, round(max(w) / sum(w), 5) AS share FROM k GROUP BY query""")
def f09_nearest(spark, sf):
    """Every vector whose id 50 divides, against all."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return V.voted(V.nearest(v, v.where("id % 50 = 0"), 15))
