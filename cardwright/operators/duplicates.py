"""Duplicate cards: exact keys, bottom-k bands of word shingles, links, groups, and the lookup of known verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwright.functions.text import digest, normalized
from cardwright.operators.components import connected_components
from cardwright.session import staged

SHINGLE, KEPT, BAND = 8, 16, 4
#: Buckets with more members say nothing and link nobody; that is the operator's own rule.
CROWD = 60
#: The same for keys of pictures that look alike.
ALIKE = 12


def exact_keys(cards: DataFrame, lookup: bool = False) -> DataFrame:
    """id, category, label, kind, ord, key: whole card, description of 40 characters or more, name of 10 or more.

    Grouping takes every whole card, so empty cards are linked; a lookup takes those with a name and a description.
    """
    n, d = normalized(F.col("name")), normalized(F.col("description"))
    rows = cards.select("id", "category", "label", n.alias("n"), d.alias("d"))
    key = lambda kind, test, value: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("ord"), F.when(test, digest(value)).alias("key"))
    whole = (F.length("n") > 0) & (F.length("d") > 0) if lookup else F.lit(True)
    keys = F.array(key("name_desc", whole, F.concat_ws("|", "n", "d")), key("desc", F.length("d") >= 40, F.col("d")), key("name", F.length("n") >= 10, F.col("n")))
    return rows.select("id", "category", "label", F.explode(keys).alias("k")).select("id", "category", "label", "k.*").where("key IS NOT NULL")


def all_keys(cards: DataFrame, lookup: bool = False) -> DataFrame:
    """Exact keys and bands, made once."""
    return staged(exact_keys(cards, lookup).unionByName(bands(cards)), "keys")


def picture_keys(pictures: DataFrame) -> DataFrame:
    """id, kind, key of a table (id, exact, like): hashes of the pictures' bytes (m) and of their looks (p)."""
    each = F.array(F.struct(F.lit("m").alias("kind"), F.col("exact").alias("key")), F.struct(F.lit("p").alias("kind"), F.col("like").alias("key")))
    return pictures.select("id", F.explode(each).alias("k")).select("id", "k.kind", "k.key").where("key IS NOT NULL")


def bands(cards: DataFrame) -> DataFrame:
    """id, category, label, kind, ord, key: up to four bands of the 16 least shingle hashes; none for fewer than 12 words.

    Words and hashes are arguments of lambdas, so each is made once; a projection would be merged into the inner lambda and
    made again for every shingle. The guards are inside, as a filter on the array would be pushed below it too.
    """
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    hashed = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, SHINGLE), " ")), 1, 12))
    least = lambda w: F.when(F.size(w) >= SHINGLE + 4, F.slice(F.array_sort(F.array_distinct(hashed(w))), 1, KEPT))
    band = lambda s, b: digest(F.concat_ws("-", b.cast("string"), F.array_join(F.slice(s, b * BAND + 1, BAND), "-")))
    made = lambda s: F.when(F.size(s) >= BAND, F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / BAND).cast("int") - 1), lambda b: band(s, b)))
    found = once(once(F.split(normalized(F.col("description")), " "), least), made)
    return cards.select("id", "category", "label", F.posexplode(found).alias("ord", "key")).select("id", "category", "label", F.lit("band").alias("kind"), "ord", "key")


def star_edges(keys: DataFrame, crowd: dict[str, int] | None = None) -> DataFrame:
    """a, b: each key's least id with each other one. Kinds in crowd link nobody where a key has more members."""
    caps = {"band": CROWD, "m": CROWD, "p": ALIKE, **(crowd or {})}
    heads = keys.groupBy("kind", "key").agg(F.min("id").alias("a"), F.count_distinct("id").alias("n"))
    bar = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in caps.items()], F.lit(1 << 62))
    heads = heads.where((F.col("n") > 1) & (F.col("n") <= bar)).drop("n")
    return keys.select("kind", "key", F.col("id").alias("b")).join(heads, ["kind", "key"]).where("a <> b").select("a", "b").distinct()


def groups(cards: DataFrame, keys: DataFrame) -> DataFrame:
    """id, category, label, grp: the least id of the card's group."""
    return linked_groups(cards, star_edges(keys))


def linked_groups(cards: DataFrame, edges: DataFrame) -> DataFrame:
    """groups(), of links that are already there."""
    found = connected_components(edges)
    out = cards.select("id", "category", "label").join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left")
    return out.select("id", "category", "label", F.coalesce("c", "id").alias("grp"))


def purity(grouped: DataFrame, *by: str) -> DataFrame:
    """by, n_groups, n_multi, n_items_multi, n_mixed, purity: among groups of labelled cards."""
    g = grouped.where("label IS NOT NULL").groupBy(*by, "grp").agg(F.count("*").alias("n"), F.avg("label").alias("m"))
    multi, mixed = F.col("n") > 1, (F.col("n") > 1) & (F.col("m") > 0) & (F.col("m") < 1)
    out = g.groupBy(*by).agg(F.count("*").alias("n_groups"), F.count_if(multi).alias("n_multi"), F.coalesce(F.sum(F.when(multi, F.col("n"))), F.lit(0)).alias("n_items_multi"), F.count_if(mixed).alias("n_mixed"))
    return out.withColumn("purity", F.round(F.when(F.col("n_multi") > 0, 1 - F.col("n_mixed") / F.col("n_multi")).otherwise(1.0), 6))


def known(keys: DataFrame, crowd: int = CROWD) -> DataFrame:
    """kind, key, label (mean, four decimals), n, category (the most frequent, of equal ones the least) of labelled cards."""
    each = keys.where("label IS NOT NULL").groupBy("kind", "key", "category").agg(F.sum("label").alias("s"), F.count("*").alias("c"))
    out = each.groupBy("kind", "key").agg(F.round(F.sum("s") / F.sum("c"), 4).alias("label"), F.sum("c").alias("n"), F.min(F.struct(-F.col("c"), F.col("category"))).alias("m"))
    return out.where((F.col("kind") != "band") | (F.col("n") <= crowd)).select("kind", "key", "label", "n", F.col("m.category").alias("category"))


TIERS = ("name_desc", "desc", "name", "band")


def looked_up(keys: DataFrame, table: DataFrame) -> DataFrame:
    """id, hit, tier: the label of the strictest kind of key that the table knows, within a kind of the first key."""
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("kind"))
    found = keys.select("id", "kind", "ord", "key").join(table.select("kind", "key", F.col("label").alias("hit")), ["kind", "key"])
    best = found.groupBy("id").agg(F.min(F.struct(tier.alias("tier"), F.col("ord"), F.col("hit"))).alias("m"))
    return best.select("id", "m.hit", F.col("m.tier").cast("int").alias("tier"))


def applied(verdicts: DataFrame, hits: DataFrame) -> DataFrame:
    """verdicts (id, verdict) with hit; where a known label is not undecided it takes the place of the verdict."""
    hit = F.col("hit")
    out = verdicts.join(hits.select("id", "hit"), "id", "left")
    return out.withColumn("verdict", F.when(F.abs(hit - 0.5) > 1e-9, (hit > 0.5).cast("int")).otherwise(F.col("verdict")))
