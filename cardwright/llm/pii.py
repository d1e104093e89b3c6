"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are regular expressions with a test; their spans always stay. Wider patterns
give further candidates, the added kinds: bare phone numbers, addresses written out in words, identity and account
numbers, names after a title. Labelers vote on every such candidate, for it (1), against it (-1) or not at all (0): the
strict form (regex), word lists (gazetteer), the words before it (context), its digits or letters (shape).
Expectation-maximisation over the counts of the patterns of votes estimates, kind by kind, how often each labeler casts
each of the three for true and for false candidates; a labeler that always abstains for a kind says nothing of it. Base
spans take no part: they would only drown the others. The posteriors then train the final classifier, a naive Bayes
over a span's own features; candidates that it holds for true are reported.

All statistics are sums over all candidates, by pattern of votes or by feature value; the driver gets these sums, at
most 3^4 patterns and some hundred feature values for each of five kinds, and iterates on them. Texts are read whole, once: their candidates are written as an array beside
the doc_id, and the rest runs on that.

Defined results: a null text is an empty one, with no spans; repeated rows give repeated results; without candidates
no model is fitted. Offsets are in code points, ends exclusive. Spans of two kinds may overlap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import staged, stepwise, table

#: Possessive forms of the patterns: what follows each repeat can't begin inside it, so they match the same and neither
#: go back nor grow the stack on long texts. A match can start only where the run of its characters starts, or where the
#: last match ended.
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "local_phone": r"(?<![0-9+()./-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "spelled_email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}\x20?[(\[]dot[)\]]\x20?[A-Za-z]{2,24}",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{L}{1,30}(?:\x20\p{Lu}\p{L}{1,30})?",
}
KINDS = [*BASE, *ADDED]
#: Cheap tests that a text must pass before a kind's pattern is tried: each is implied by its pattern. The other kinds need a digit.
NEEDS = {
    "email": lambda text: text.contains("@"),
    "phone": lambda text: text.contains("+"),
    "spelled_email": lambda text: text.rlike(r"(?i)[(\[]at[)\]]"),
    "person": lambda text: F.lit(True),
}
SPAN = "struct<start:int,kind:int,end:int,text:string,before:string>"
BEFORE = 32
LABELERS = ("regex", "gazetteer", "context", "shape")
CUES = r"(?i)(?:e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|iban|account|konto|ssn|social|name|from|by|an|von|de|para)\W{0,6}$"
AGAINST = r"(?i)(?:order|invoice|version|isbn|part|model|item|page|build|serial|id|no|nr)\W{0,4}$"
#: Numbers that stand in manuals and forms, digits alone.
SAMPLES = ("1234567890", "0123456789", "5555555555", "123456789", "078051120", "219099999")
COUNTRIES = "^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PT|PL|LU|IE|DK|SE|NO|FI)"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|de|fr|es|uk|io)$"
NAMES = r"(?i)\x20(?:james|mary|john|anna|maria|peter|paul|thomas|michael|sarah|laura|david|marie|jean|pierre|hans|klaus|carlos|juan|ana|lucia|sofia|emma|louis)(?:\x20|$)"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Of a string of digits; empty ones fail."""
    # every second digit from the right counts double, less 9 beyond 9
    back = F.split(F.reverse(text), "")
    marks = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(marks, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The base kinds' own tests."""
    n = F.length(digits(text))
    if kind == "ip":
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(text))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """array<SPAN> of a pattern's leftmost matches that don't overlap.

    There is no function for places; but the pieces between the matches and the matches, added up, give them. The lambda
    sees its own arguments only, so nothing is computed again for each match.
    """
    pattern = {**BASE, **ADDED}[kind]
    none = F.array().cast(f"array<{SPAN}>")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        end = at + F.length(pair["hit"])
        span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), pair["hit"].alias("text"), F.right(pair["gap"], F.lit(BEFORE)).alias("before"))
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    found = F.filter(F.aggregate(pairs, start, step, lambda acc: acc["out"]), lambda s: valid(kind, s["text"]))
    needed = NEEDS[kind](text) if kind in NEEDS else text.rlike(r"[0-9]")
    return F.when(needed & text.rlike(pattern), found).otherwise(none)


def remainder97(account: Column) -> Column:
    """Of an account number with its first four characters put last and A to Z as 10 to 35; 1 for right ones."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(turned, F.lit(0), step)


def cue(span: Column) -> Column:
    return F.when(span["before"].rlike(CUES), 1).when(span["before"].rlike(AGAINST), -1).otherwise(0)


def votes(span: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 to abstain."""
    kind, text = kind_name(span), span["text"]
    plain, yes = digits(text), lambda test: F.when(test, 1).otherwise(-1)
    strict = F.when(kind == "local_phone", yes(text.rlike(r"^(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}([.\x20-]))[2-9][0-9]{2}(?:\1|[.\x20-])[0-9]{4}$")))
    strict = strict.when(kind == "identity", yes(~text.rlike(r"^(?:000|666|9)|-00-|-0000$"))).when(kind == "account", yes(remainder97(text) == 1))
    strict = strict.when(kind == "spelled_email", yes(text.rlike(r"(?i)\(at\).*\(dot\)|\[at\].*\[dot\]"))).when(kind == "person", F.when(text.rlike(r"\p{L}\x20\p{Lu}\p{L}+$"), 1).otherwise(0)).otherwise(0)
    known = F.when(kind == "spelled_email", yes(F.regexp_replace(text, r"[)\]]", "").rlike(DOMAINS))).when(kind == "account", yes(text.rlike(COUNTRIES)))
    known = known.when(kind == "person", F.when(text.rlike(NAMES), 1).otherwise(0)).when(plain.isin(*SAMPLES), -1).otherwise(0)
    shape = F.when(kind == "account", yes(F.length(F.regexp_replace(text, " ", "")).between(15, 34) & (F.length(plain) >= 8))).when(kind == "person", yes(F.length(F.regexp_extract(text, r"\x20(\p{L}+)$", 1)) >= 3))
    shape = shape.when(kind == "spelled_email", yes(text.rlike(r"^[^(\[]*[A-Za-z][^(\[]*[A-Za-z]"))).otherwise(yes(F.size(F.array_distinct(F.split(plain, ""))) >= 4))
    return {"regex": strict, "gazetteer": known, "context": cue(span), "shape": shape}


def features(span: Column) -> dict[str, Column]:
    """What the final classifier sees; every feature has few values."""
    text, vote = span["text"], votes(span)
    return {
        "length": F.least(F.floor(F.length(text) / 4), F.lit(12)).cast("string"),
        "distinct": F.least(F.size(F.array_distinct(F.split(digits(text), ""))), F.lit(10)).cast("string"),
        "form": vote["regex"].cast("string"),
        "listed": vote["gazetteer"].cast("string"),
        "shape": vote["shape"].cast("string"),
        "cue": vote["context"].cast("string"),
        "before": F.when(span["before"] == "", "edge").when(span["before"].rlike(r"\s$"), "space").when(span["before"].rlike(r"[\p{L}\p{N}]$"), "word").otherwise("sign"),
    }


def kind_name(span: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["kind"] + 1)


@dataclass
class Model:
    """By kind: the share of true candidates, and how often each labeler casts each vote for true and for false ones;
    weights by kind, feature and value."""

    prior: dict[str, float]
    rates: dict[str, dict[str, tuple[dict[int, float], dict[int, float]]]]
    weights: dict[str, float]

    def score(self, span: Column) -> Column:
        table = F.create_map(*[F.lit(x) for kv in {**{f"{k}": math.log(p / (1 - p)) for k, p in self.prior.items()}, **self.weights, "": 0.0}.items() for x in kv])
        keys = [kind_name(span), *[F.concat_ws("|", kind_name(span), F.lit(name), value) for name, value in features(span).items()]]
        return sum((F.coalesce(F.try_element_at(table, k), F.lit(0.0)) for k in keys), F.lit(0.0))


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, and spans: all candidates of the row, by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    return rows.select(*keep, *([F.col("_text")] if "text" in keep else []), F.array_sort(F.concat(*[matches(F.col("_text"), k) for k in KINDS])).alias("spans"))


#: The first guess of a labeler's votes for true candidates; for false ones for and against change places.
GUESS = {1: 0.55, 0: 0.35, -1: 0.1}
#: Votes that the first guess counts for, so that no rate gets to 0 or 1.
TRUST = 4.0


def estimated(patterns: dict[tuple[int, ...], float], rounds: int = 100) -> tuple[float, dict[str, tuple[dict[int, float], dict[int, float]]], dict[tuple[int, ...], float]]:
    """The share of true candidates, the labelers' rates, and how likely each pattern of votes is a true one."""
    prior = 0.5
    rates = {k: (dict(GUESS), {v: GUESS[-v] for v in GUESS}) for k in LABELERS}

    def posterior() -> dict[tuple[int, ...], float]:
        out = {}
        for votes in patterns:
            z = math.log(prior / (1 - prior)) + sum(math.log(rates[k][0][v] / rates[k][1][v]) for k, v in zip(LABELERS, votes))
            out[votes] = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
        return out

    for _ in range(rounds):
        p = posterior()
        was, n = prior, sum(patterns.values())
        prior = min(0.999, max(0.001, (sum(patterns[x] * p[x] for x in patterns) + 1) / (n + 2)))
        for i, k in enumerate(LABELERS):
            for side, share in enumerate((lambda x: p[x], lambda x: 1 - p[x])):
                guess = GUESS if not side else {v: GUESS[-v] for v in GUESS}
                cast = {v: sum(patterns[x] * share(x) for x in patterns if x[i] == v) + TRUST * guess[v] for v in GUESS}
                rates[k][side].update({v: cast[v] / sum(cast.values()) for v in GUESS})
        if abs(was - prior) < 1e-6:
            break
    return prior, rates, posterior()


def fitted(found: DataFrame) -> Model:
    """Learn from the added kinds' candidates in a table with an array of candidates in each row."""
    spans = found.select(F.explode(F.filter("spans", lambda s: s["kind"] >= len(BASE))).alias("s"))
    marked = staged(spans.select(kind_name(F.col("s")).alias("kind"), F.array(*votes(F.col("s")).values()).alias("votes"), *[v.alias(f"f_{k}") for k, v in features(F.col("s")).items()]), "votes")
    patterns: dict[str, dict[tuple[int, ...], float]] = {}
    for r in marked.groupBy("kind", "votes").count().collect():
        patterns.setdefault(r.kind, {})[tuple(r.votes)] = float(r["count"])
    if not patterns:
        return Model({}, {}, {})
    learned = {kind: estimated(own) for kind, own in patterns.items()}
    likely = F.create_map(*[x for kind, (_, _, p) in learned.items() for votes, share in p.items() for x in (F.lit(f"{kind}|{'|'.join(map(str, votes))}"), F.lit(share))])
    names = list(features(F.col("s")))
    p = F.element_at(likely, F.concat_ws("|", "kind", F.array_join(F.transform("votes", lambda v: v.cast("string")), "|")))
    each = marked.select("kind", p.alias("p"), F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"f_{k}").alias("value")) for k in names])).alias("x"))
    sums = each.groupBy("kind", "x.feature", "x.value").agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")).collect()
    weights: dict[str, float] = {}
    for r in sums:
        true, false = (sum(getattr(x, side) for x in sums if (x.kind, x.feature) == (r.kind, r.feature)) for side in ("true", "false"))
        weights[f"{r.kind}|{r.feature}|{r.value}"] = round(math.log((r.true + 1) / (true + 4)) - math.log((r.false + 1) / (false + 4)), 6)
    return Model({k: x[0] for k, x in learned.items()}, {k: x[1] for k, x in learned.items()}, weights)


def kept(spans: Column, model: Model) -> Column:
    """Base spans, and those of the added kinds that the classifier takes for true."""
    return F.filter(spans, lambda s: (s["kind"] < len(BASE)) | (model.score(s) > 0))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s), s["start"], s["end"])), ",")


def number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@stepwise
def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans."""
    found = staged(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "candidates")
    spans = kept(F.col("spans"), fitted(found))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [number(F.col("spans"), k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


@stepwise
def masked(docs: DataFrame) -> DataFrame:
    """docs, with every span of the text replaced by its kind in brackets; overlapping spans become one mark. A null text stays null."""
    spans = "_spans"
    while spans in docs.columns:
        spans += "_"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = staged(docs.withColumn(spans, F.array_sort(F.concat(*[matches(text, k) for k in KINDS]))), "candidates")
    model = fitted(found.select(F.col(spans).alias("spans")))
    chosen = kept(F.col(spans), model)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"), F.col("text").alias("text"))
    mark = lambda s: F.concat(F.lit("["), F.upper(kind_name(s)), F.lit("]"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] + 1 >= acc["at"]
        piece = F.substring(acc["text"], acc["at"], s["start"] + 1 - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], F.array(piece, mark(s)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), out.alias("out"), acc["text"].alias("text"))

    done = F.aggregate(chosen, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(acc["text"], acc["at"], F.length(acc["text"]))))
    return found.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text"))).select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
