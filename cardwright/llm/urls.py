"""URL filters: rules by host and path, then a weighted vocabulary.

An Aho-Corasick automaton finds the vocabulary's terms in the lower-cased URL; a hit counts where no letter or digit
(a-z, 0-9) stands beside it. The weights of the distinct terms are added; a strict term has the whole limit, a soft one
a part of it, so one strict or several distinct soft terms reject. The vocabulary below is a small default; a table of
(term, weight) takes its place.

Defined results: a null or empty URL has no host, path, rule or term and is allowed. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import table

LIMIT = 2
#: Rows that a vocabulary table may have: it goes to every worker.
TERMS = 200_000
#: term -> weight
STRICT = ("porn", "xxx", "casino", "viagra", "escort", "warez", "phishing", "malware")
SOFT = ("cheap", "pills", "spam", "farm", "bonus", "bet", "poker", "loan", "dating", "adult", "sexy", "replica", "crack", "torrent", "jackpot")
VOCABULARY = {**{t: LIMIT for t in STRICT}, **{t: 1 for t in SOFT}}
#: host, path, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = frozenset(LOWER + "0123456789")
FOLD = str.maketrans(UPPER, LOWER)


@cache
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    out.make_automaton()
    return out


def terms_in(url: str, terms: tuple[str, ...]) -> set[str]:
    """The distinct terms that stand alone in the URL."""
    text = url.translate(FOLD)
    found: set[str] = set()
    if not terms:
        return found
    for end, term in automaton(terms).iter(text):
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
            found.add(term)
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    empty = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(empty, pattern, 1), UPPER, LOWER), F.regexp_extract(empty, pattern, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: int | None) -> Column:
    """Of the longest rule that fits: the rule, or its part number `what`."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, F.lit(rule[0] + rule[1] if what is None else rule[what])).otherwise(out)
    return out


def vocabulary_of(weighted: DataFrame, most: int = TERMS) -> dict[str, int]:
    """Weights by lower-case term, from a table of at most so many rows (more raise an error); of a term's weights the largest."""
    rows = weighted.select(F.col("term").cast("string"), F.col("weight").cast("long")).where("term <> '' AND weight IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} rows")
    out: dict[str, int] = {}
    for r in rows:
        term = r.term.translate(FOLD)
        out[term] = max(r.weight, out.get(term, r.weight))
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: dict[str, int] | DataFrame = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, n_strict, n_soft (distinct terms), weight, verdict.

    vocabulary: weights by term, or a table (term, weight) as vocabulary_of() reads it.
    """
    vocabulary = vocabulary_of(vocabulary) if isinstance(vocabulary, DataFrame) else vocabulary
    terms = tuple(vocabulary)

    @F.pandas_udf("n_strict long, n_soft long, weight long")
    def hits(urls: pd.Series) -> pd.DataFrame:
        found = [terms_in(u, terms) if u else set() for u in urls]
        strict = [sum(vocabulary[t] >= limit for t in f) for f in found]
        return pd.DataFrame({"n_strict": strict, "n_soft": [len(f) - n for f, n in zip(found, strict)], "weight": [sum(vocabulary[t] for t in f) for f in found]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path, "hits": hits("url")})
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule_for(host, path, rules, None).alias("rule"), "hits.n_strict", "hits.n_soft", "hits.weight", F.coalesce(rule_for(host, path, rules, 2), method).alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    hit = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)"
    fits = [(h, p, v, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for h, p, _, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for _, _, v, f in fits) + f" WHEN {LIMIT} * n_strict + n_soft >= {LIMIT} THEN 'block' ELSE 'allow' END"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages),
b AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS u, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, {' + '.join(map(hit, STRICT))} AS n_strict, {' + '.join(map(hit, SOFT))} AS n_soft FROM c)
SELECT page_id, host, path, {rule} AS rule, n_strict, n_soft, {LIMIT} * n_strict + n_soft AS weight, {verdict} AS verdict FROM d
"""


ORACLE = _oracle()
