"""Document fingerprints: a canonical exact digest.

A text is brought to Unicode form NFKC, case-folded, and its white space folded to single spaces; its fingerprint is the
128-bit xxhash of that. Texts whose canonical forms are equal share it. Inside each bucket of equal hashes the canonical
bytes are compared; should two forms collide, the fingerprint gets the form's number in the bucket.

Defined results: a null text is an empty one. Documents stand in the order of doc_id (null first), rows that repeat a
doc_id in that of a hash of their texts; the next document of the last is the first, also where it is the only one.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import parts, staged, stepwise, table, texts

#: The filter of shared fingerprints has so many hexadecimal digits of slots, which bounds what the driver gets.
SLOT_DIGITS = 5


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def likeness(a: str, b: str) -> float:
    """An exact digest knows equal and other texts only."""
    return float(a == b)


def edited(text: str, after: str) -> str:
    """The last quarter, replaced by as many of the next document's first code points."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def collisions(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Fingerprints whose documents differ in their canonical bytes; marks has a fingerprint per document."""
    shared = marks.groupBy("fingerprint").count().where("count > 1")
    slots = shared.select(F.substring("fingerprint", 1, SLOT_DIGITS).alias("slot")).distinct().toPandas()["slot"]
    wanted = np.zeros(16**SLOT_DIGITS, bool)
    wanted[[int(x, 16) for x in slots]] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, packer = np.unpackbits(wanted.value), zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = {}
            for t in b["text"]:
                form = canonical(t or "")
                mark = digest(form)
                if bits[int(mark[:SLOT_DIGITS], 16)]:
                    out[mark, form] = None
            yield pd.DataFrame([(m, packer.compress(f)) for m, f in out], columns=["fingerprint", "form"])

    found = texts(docs).mapInPandas(forms, "fingerprint string, form binary")
    return found.groupBy("fingerprint").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a != b").select("fingerprint")


@stepwise
def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    base = texts(docs).select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * parts(spark)
    order = F.struct("doc_id", "tie")
    cuts = base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    edges = F.array([F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))), F.lit(0))
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket)
    base = base.withColumn("bucket", bucket)
    firsts = {r.bucket: (r.first.doc_id, r.first.tie) for r in base.groupBy("bucket").agg(F.min(order).alias("first")).collect()}  # a row per bucket
    used = sorted(firsts)
    before = {firsts[b]: used[i - 1] for i, b in enumerate(used)}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = []
            for d, tie, t, k in zip(b["doc_id"], b["tie"], b["text"], b["bucket"]):
                d, data = None if d is None else int(d), packer.compress(t.encode("utf-8", "surrogatepass"))
                name = None if d is None else str(d)
                rows.append((name, tie, k, False, data))
                if (d, tie) in before:  # the first of a bucket is also what follows the one before
                    rows.append((name, tie, before[d, tie], True, data))
            yield pd.DataFrame(rows, columns=["doc_id", "tie", "bucket", "guest", "data"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "form_sha256"]
        held = None

        def row(me: tuple, after: tuple) -> tuple:
            text = edited(me[1], after[1])
            mark = digest(canonical(text))
            return me[0], len(me[1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), me[2], mark, likeness(me[2], mark), likeness(me[2], after[2]), me[3]

        for b in batches:
            out = []
            for d, k, guest, data in zip(b["doc_id"], b["bucket"], b["guest"], b["data"]):
                text = unpacker.decompress(data).decode("utf-8", "surrogatepass")
                form = canonical(text)
                now = (d, text, digest(form), hashlib.sha256(form).hexdigest(), k)
                if held is not None and held[4] == k:
                    out.append(row(held, now))
                held = None if guest and (held is None or held[4] == k) else now
            yield pd.DataFrame(out, columns=columns)

    packed = base.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(pack, "doc_id string, tie long, bucket int, guest boolean, data binary").withColumn("doc_id", F.col("doc_id").cast("long"))
    dealt = packed.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "tie")
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "bucket", "guest", "data")
    marks = staged(dealt.mapInPandas(compare, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, form_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints")
    return told_apart(marks, collisions(docs, marks)).drop("form_sha256")


def told_apart(marks: DataFrame, clashing: DataFrame) -> DataFrame:
    """Number the canonical forms that share a hash."""
    clashing = staged(clashing, "clashes")
    if clashing.isEmpty():
        return marks
    forms = marks.join(clashing, "fingerprint", "left_semi").select("fingerprint", "form_sha256").distinct()
    rank = F.expr("row_number() OVER (PARTITION BY fingerprint ORDER BY form_sha256)")
    numbered = forms.select("fingerprint", "form_sha256", F.concat("fingerprint", F.lit("-"), rank).alias("own"))
    return marks.join(numbered, ["fingerprint", "form_sha256"], "left").withColumn("fingerprint", F.coalesce("own", "fingerprint")).drop("own")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
