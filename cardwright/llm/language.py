"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and its UTF-8 bytes cut into subwords of 2 to 4 bytes, with white space, digits and ASCII signs as
one mark of a word's bounds. Each subword's hash picks one of BUCKETS embeddings; their average goes through a linear
layer and a softmax. Embeddings and layer are trained by stochastic gradient descent in numpy on a sample of labelled
documents: of the LANGUAGES most frequent languages (others are never predicted), drawn by a hash of doc_id in equal
shares that add up to SAMPLE_ROWS, less where a language has fewer. As shares are met on average only, at most twice
SAMPLE_ROWS are taken; so many and no more ever reach the driver, as counts of subwords. Every fifth of them is kept for calibration: a temperature that fits the probabilities, and the
score under which a prediction is rejected, chosen so that at most REJECTED of the right predictions are.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; without any labelled
document all are. Null or empty labels are not learned from, nor are rows without a doc_id. Repeated rows are judged one
by one; labels that repeat count as often as they stand. Prediction reads whole texts and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import BATCH_ROWS, small, stepwise, table, trim

BUCKETS = 8192
WIDTH = 16
SIZES = (2, 3, 4)
SAMPLE_ROWS = 2000
#: Languages that are learned, the most frequent first.
LANGUAGES = 512
REJECTED = 0.001
EPOCHS = 12
UNKNOWN = "und"
#: ASCII bytes that are no letters become spaces.
MARKS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(texts: list[str]) -> np.ndarray:
    """How often each bucket is hit, a row per text; the rows add up to 1 or 0."""
    data = [b" " + t.lower().encode("utf-8", "replace").translate(MARKS) + b" " for t in texts]
    size = np.array([len(d) for d in data])
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    at = np.repeat(np.arange(len(data)), size) * BUCKETS
    out = np.zeros(len(data) * BUCKETS)
    last = np.cumsum(size)
    for n in SIZES:
        if len(raw) < n:
            continue
        gram = raw[: len(raw) - n + 1].copy()
        for k in range(1, n):
            gram |= raw[k : len(raw) - n + 1 + k] << np.uint32(8 * k)
        gram *= np.uint32(2654435761)
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(2246822519 + 2 * n)
        slot = (gram >> np.uint32(32 - 13)).astype(np.int64) + at[: len(gram)]
        inside = np.ones(len(gram), bool)
        for k in range(1, n):  # not across two texts
            inside[(last - k)[last - k < len(gram)]] = False
        out += np.bincount(slot[inside], minlength=len(out))
    out = out.reshape(len(data), BUCKETS)
    return (out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Model:
    """table: the logits that each bucket adds, so embedding and layer in one."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax((counts(texts) @ self.table + self.bias) / self.temperature)
        return [self.langs[i] for i in p.argmax(1)], p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    y, rng = np.array([names.index(v) for v in langs]), np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = (order[::5], np.delete(order, np.s_[::5])) if len(y) >= 50 else (order, order)
    scale = np.float32(16)  # averages of many buckets are small
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    lin, bias = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(0.5 * (1 - epoch / EPOCHS) + 0.02)
        rng.shuffle(used)
        for at in range(0, len(used), 16):
            pick = used[at : at + 16]
            mean = (x[pick] * scale) @ emb
            slope = softmax(mean @ lin + bias)
            slope[np.arange(len(pick)), y[pick]] -= 1
            slope /= len(pick)
            steps = ((emb, (x[pick] * scale).T @ (slope @ lin.T)), (lin, mean.T @ slope), (bias, slope.sum(0)))
            long = np.float32(max(1.0, np.sqrt(sum((g * g).sum() for _, g in steps))))  # short texts give long steps
            for w, g in steps:
                w -= rate / long * g
    table = (emb @ lin * scale).astype(np.float32)
    z = x[held] @ table + bias
    fits = [(-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 41)]
    temperature = float(min(fits)[1])
    p = softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    least = float(min(0.5, np.quantile(right, REJECTED))) if len(right) else 0.5
    return Model(names, table, bias, temperature, least)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@stepwise
def fitted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> Model:
    """Learn from documents with a label, but for the held-out ones."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    base = base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "") & ~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    found = {r.lang: r["count"] for r in base.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not found:
        return train(np.zeros((0, BUCKETS), np.float32), [])
    share = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, sample_rows / len(found) / n))])
    unit = (F.xxhash64(F.lit("language"), "doc_id") % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    sample = base.where(unit < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("text", "lang").limit(2 * sample_rows)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in small(batches):
            rows = []
            trim()
            for x, lang in zip(counts(list(b["text"])), b["lang"]):
                at = np.flatnonzero(x)
                rows.append((lang, at.astype(np.uint16).tobytes(), x[at].tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "slots", "shares"])

    rows = sorted(sample.mapInPandas(sparse, "lang string, slots binary, shares binary").collect(), key=lambda r: (r.lang, bytes(r.slots), bytes(r.shares)))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.slots, np.uint16)] = np.frombuffer(r.shares, np.float32)
    return train(x, [r.lang for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected; extra columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, at most LANGUAGES of these

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        plain = [t or "" for t in texts]
        letters = np.array([any(map(str.isalpha, t)) for t in plain], bool)
        langs, score = [], np.zeros(len(plain))
        for at in range(0, len(plain), BATCH_ROWS):
            found, score[at : at + BATCH_ROWS] = sent.value.predict(plain[at : at + BATCH_ROWS])
            langs += found
        trim()
        return pd.DataFrame({"lang_pred": np.where(letters, np.array(langs, object), UNKNOWN), "score": np.where(letters, score, 0.0).astype(float)})

    rest = docs.drop("_seen", "lang_pred", "score", "rejected").withColumn("_seen", predict(F.col("text").cast("string")))
    out = rest.withColumns({"lang_pred": F.col("_seen.lang_pred"), "score": F.col("_seen.score")}).drop("_seen")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < model.least))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return identify(rows, fitted(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
