"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links make.

A document's set is its distinct word shingles. Sets are ordered by how common a shingle is (a sketch of counts over all
documents, of fixed size), then by hash. Two sets of Jaccard similarity t or more share a shingle in their prefixes of
n - ceil(t n) + 1, and l shingles in prefixes that are l - 1 longer. Each document takes the level l that makes the
estimated cost least, from how many documents' prefixes hold its shingles, and its prefix of that length alone goes into
the buckets. A pair is a candidate if it meets in as many buckets as the smaller level of the two; only then are its sets
compared.

Equal sets are one class from the start. What is asked for is groups, so of the documents in a bucket (those that share
a prefix shingle) not all pairs are made: first one member, the pivot, is compared with all others. Most buckets then
hold one group and are done. In the others all pairs across groups are tested: listed where the bucket is small, and in
tiles of bounded size by a product of matrices where it is large; there the product costs less than the filter would.
No link between two groups is lost. Similar sets share a shingle of both their plain prefixes (those of level 1). Where its
bucket is large, they meet in a tile; tiles hold the members by their plain prefixes only. Else they meet in a small
bucket, and in as many small ones as their level asks for, less those that could be large: so many as the document with
fewer shingles in large buckets has there. Other pairs are in one group, or out of the size bound.

Defined results: null texts and texts without a word have the empty set and link with nothing; rows that repeat a doc_id
are one node, linked to all that any of them is; a null doc_id has a null component. Texts are read whole.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import hot_join, named_texts, numbered, small, staged, stepwise, table, texts, trim, unstage
from cardwright.llm.shingles import sets
from cardwright.operators.components import connected_components

WIDTH = 5
#: Similarity of a link, in hundredths.
LEAST = 80
#: Slots of the parities that tell most pairs apart without their texts.
PARITY = 2048
#: Longest prefix: so many shingles more than the plain one.
EXTRA = 3
#: Of buckets of so many members all pairs across groups are listed; of larger ones they are made in tiles.
BUCKET = 16
TILE = 256
#: Slots of the sketch, as a power of two, and of the filter of documents that need their text.
SLOT_BITS = 20
CHUNKS = 64


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest of each set; and the parts' sketches, as rows with a chunk."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << SLOT_BITS, np.int64)
        held: list[np.ndarray] = []

        def count() -> None:
            if held:
                np.add(sketch, np.bincount((np.concatenate(held) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(sketch)), out=sketch)
                held.clear()

        size = 0
        for b in batches:
            trim()
            own = sets([t or "" for t in b["text"]], width)
            held += own
            size += sum(map(len, own))
            if size > 4 << 20:
                count()
                size = 0
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(x) for x in own], "digest": [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in own], "chunk": None, "counts": None})
        count()
        if sketch.any():
            yield pd.DataFrame({"doc_id": None, "n": None, "digest": None, "chunk": range(CHUNKS), "counts": [zstandard.compress(x.tobytes(), 1) for x in np.split(sketch, CHUNKS)]})

    return staged(numbered(named_texts(docs).mapInPandas(scan, "doc_id string, n long, digest string, chunk int, counts binary")), "shingle-sets")


def added(rows: DataFrame, *keys: str) -> DataFrame:
    """The sum of the counts by keys, a row at a time."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for b in batches:
            for *now, blob in b[[*keys, "counts"]].itertuples(index=False):
                one = np.frombuffer(zstandard.decompress(blob), np.int64)
                if now == key:
                    total = total + one
                else:
                    if key is not None:
                        yield pd.DataFrame([[*key, zstandard.compress(total.tobytes(), 1)]], columns=[*keys, "counts"])
                    key, total = now, one
        if key is not None:
            yield pd.DataFrame([[*key, zstandard.compress(total.tobytes(), 1)]], columns=[*keys, "counts"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, ", ".join(f"{k} int" for k in keys) + ", counts binary")


def commonness(summary: DataFrame) -> np.ndarray:
    """How common each slot of shingles is, on a scale of quarters of powers of two."""
    rows = summary.where("chunk IS NOT NULL").select("chunk", "counts", (F.spark_partition_id() % 64).alias("branch"))
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for r in added(added(rows, "chunk", "branch"), "chunk").collect():  # CHUNKS rows of fixed size
        n = len(out) // CHUNKS
        out[r.chunk * n : (r.chunk + 1) * n] = np.frombuffer(zstandard.decompress(bytes(r.counts)), np.int64)
    return np.floor(4 * np.log2(out + 1)).astype(np.uint64)


def alpha(n: int, least: int) -> int:
    """Shingles that a set of n shares at least with a similar one."""
    return -(-least * n // 100)


def prefix(own: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """The longest prefix that is looked at, in order, and the length of the plain one."""
    key = common[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] << np.uint64(56) | own >> np.uint64(8)
    plain = len(own) - alpha(len(own), least) + 1
    return own[np.argsort(key, kind="stable")[: plain + EXTRA]], plain


def prefixes(docs: DataFrame, width: int, least: int, common) -> DataFrame:
    """token, doc, n, extra: every shingle of the prefixes, once for equal sets of one part."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for b in batches:
            trim()
            token, doc, size, extra = [], [], [], []
            for d, own in zip(b["doc_id"], sets([t or "" for t in b["text"]], width)):
                digest = xxhash.xxh3_128_digest(own.tobytes())
                if not len(own) or digest in seen:
                    continue
                seen.add(digest)
                first, plain = prefix(own, common.value, least)
                token.append(first)
                doc.append(np.full(len(first), d, np.int64))
                size.append(np.full(len(first), len(own), np.int32))
                extra.append(np.maximum(0, np.arange(len(first)) - plain + 1).astype(np.int32))
            if token:
                yield pd.DataFrame({"token": np.concatenate(token).view(np.int64), "doc": np.concatenate(doc), "n": np.concatenate(size), "extra": np.concatenate(extra)})

    return texts(docs).where("doc_id IS NOT NULL").mapInPandas(scan, "token long, doc long, n int, extra int")


def slot(doc: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc), 64 - SLOT_BITS).cast("int")


def parity(own: np.ndarray) -> bytes:
    """A bit for each of PARITY slots: whether an odd number of shingles fall in it. As many bits of two sets differ, as
    many shingles at least are in one of them alone."""
    return np.packbits(np.bincount((own & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1 > 0).tobytes()


def packed_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc, n, bits (parities), data (compressed text) of the wanted documents and a few more: a filter of fixed size passes them."""
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[wanted.select(slot(F.col("doc")).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, packer = np.unpackbits(sent.value).astype(bool), zstandard.ZstdCompressor(level=3)
        for b in batches:
            trim()
            b = b[kept[b["slot"].to_numpy(np.int64)]]
            own = sets(list(b["text"]), width)
            yield pd.DataFrame({"doc": b["doc_id"], "n": [len(x) for x in own], "bits": list(map(parity, own)), "data": [packer.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"]]})

    rows = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("slot", slot(F.col("doc_id")))
    return staged(rows.mapInPandas(pack, "doc long, n long, bits binary, data binary"), "texts")


def plausible(pairs: DataFrame, data: DataFrame, least: int) -> DataFrame:
    """Those pairs (a, b) whose parities don't tell that the sets differ in more shingles than similar ones can."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1) for c in ("bits_a", "bits_b"))
            both = (b["n_a"] + b["n_b"]).to_numpy(np.int64)
            differ = both - 2 * -(-least * both // (100 + least))
            yield b.loc[np.bitwise_count(x ^ y).sum(1) <= differ, ["a", "b"]]

    for side in ("a", "b"):
        pairs = pairs.join(data.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")).hint("merge"), side)
    return staged(pairs.mapInPandas(check, "a long, b long"), "plausible")


def verified(pairs: DataFrame, data: DataFrame, width: int, least: int) -> DataFrame:
    """a, b of the pairs (a, b) that are links."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker, held = zstandard.ZstdDecompressor(), OrderedDict()

        def own(doc: int, data: bytes) -> np.ndarray:
            if (doc, data) not in held:
                if len(held) >= 64:
                    held.popitem(last=False)
                held[doc, data] = sets([unpacker.decompress(data).decode("utf-8", "surrogatepass")], width)[0]
            held.move_to_end((doc, data))
            return held[doc, data]

        for b in batches:
            out = []
            for x, y, tx, ty in zip(b["a"], b["b"], b["ta"], b["tb"]):
                s, t = own(x, tx), own(y, ty)
                shared = len(np.intersect1d(s, t, True))
                if 100 * shared >= least * (len(s) + len(t) - shared):
                    out.append((x, y))
            yield pd.DataFrame(out, columns=["a", "b"])

    first = pairs.join(data.select(F.col("doc").alias("a"), F.col("data").alias("ta")).hint("merge"), "a")
    both = first.join(data.select(F.col("doc").alias("b"), F.col("data").alias("tb")).hint("merge"), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


def candidates(met: DataFrame, least: int) -> DataFrame:
    """a, b of the pairs that meet, a row (x, y) for each bucket, in as many buckets as the smaller level of the two (or as
    all the shingles that they must share, if these are fewer), less the large buckets that either has (lost)."""
    must = [F.floor((least * F.col(f"{side}.n") + 99) / 100).cast("int") for side in "xy"]
    level = F.least("x.level", "y.level", *must) - F.least("x.lost", "y.lost")
    pairs = met.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.count("*").alias("shared"), F.min(level).alias("level"))
    return pairs.where("shared >= level").select("a", "b")


def fits(n: Column, m: Column, least: int) -> Column:
    return (100 * F.least(n, m)) >= (least * F.greatest(n, m))


def classes(summary: DataFrame) -> DataFrame:
    """digest, rep, copies: the least doc_id of each set that is not empty."""
    rows = summary.where("chunk IS NULL AND n > 0")
    return staged(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("rep IS NOT NULL"), "classes")


@stepwise
def linked(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    summary = summaries(docs, width)
    rows = summary.where("chunk IS NULL").select("doc_id", "n", "digest")
    common = spark.sparkContext.broadcast(commonness(summary))
    groups = classes(summary)
    total = groups.agg(F.sum("copies")).first()[0] or 0
    members = staged(hot_join(rows, groups, "digest", "copies", total, F.xxhash64("doc_id")).select("doc_id", "n", "rep"), "members")

    tokens = staged(prefixes(docs, width, least, common), "prefixes")
    shared = staged(tokens.groupBy("token").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count("*").alias("many")).where("x < y").select("token", "many"), "shared-tokens")
    marked = staged(tokens.join(shared.hint("merge"), "token"), "marked")
    unstage(tokens, shared)
    # the level of least cost: a step for each entry of a bucket, and VERIFY for each candidate
    cost = [F.sum(F.when(F.col("extra") <= e, F.col("many") - 1).otherwise(0)) for e in range(EXTRA + 1)]
    costs = [(c + 20 * c / (e + 1)) for e, c in enumerate(cost)]
    best = F.array_min(F.array(*[F.struct(c.alias("c"), F.lit(e + 1).alias("level")) for e, c in enumerate(costs)]))["level"]
    levels = marked.groupBy("doc").agg(best.alias("level"))
    own = members.where("rep IS NOT NULL").select(F.col("doc_id").alias("doc"), "rep").distinct()
    base = marked.select("token", "doc", "n", "extra").join(levels, "doc").where("extra < level").join(own, "doc")
    buckets = staged(base.groupBy("token", "rep").agg(F.min("n").alias("n"), F.min("level").alias("level"), F.min("extra").alias("extra")).withColumnRenamed("rep", "doc"), "buckets")
    unstage(marked)
    data = packed_texts(docs, buckets, width)
    # rows of one doc_id are one node, so the classes of their sets are linked
    twice = own.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc", "a")
    twice = staged(own.join(twice, "doc").select("a", F.col("rep").alias("b")).where("a < b"), "twice")
    links = twice
    # first each bucket's pivot with all others: the same one for all buckets of a family that it is in
    now = mixed_buckets(buckets, grouped(links))
    member = ("doc", "n", "level", "group", "lost")
    now = now.withColumn("lost", F.lit(0).cast("long"))
    order = F.struct(F.xxhash64("doc").alias("o"), *member)
    pivots = staged(now.groupBy("token").agg(F.min(order).alias("y")), "pivots")
    across = now.withColumn("x", F.struct(*member)).join(pivots.hint("merge"), "token").where((F.col("x.group") != F.col("y.group")) & fits(F.col("x.n"), F.col("y.n"), least))
    pairs = staged(candidates(across, least), "pairs")
    links = links.union(staged(verified(plausible(pairs, data, least), data, width, least), "links"))
    # then all pairs across groups, in the buckets where there are several left
    labels = grouped(links)
    now = mixed_buckets(now.drop("group", "many", "lost"), labels)
    large = now.where(F.col("many") > BUCKET)
    lost = large.groupBy("doc").agg(F.count("*").alias("lost"))
    few = now.where(F.col("many") <= BUCKET).join(lost, "doc", "left").withColumn("lost", F.coalesce("lost", F.lit(0).cast("long")))
    lists = few.groupBy("token").agg(F.collect_list(F.struct(*member)).alias("all"))  # at most BUCKET
    each = lists.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: (y["doc"] > F.col("x.doc")) & (y["group"] != F.col("x.group")) & fits(F.col("x.n"), y["n"], least))).alias("y"))
    pairs = staged(candidates(each, least), "pairs")
    links = links.union(staged(verified(plausible(pairs, data, least), data, width, least), "links"))
    links = links.union(staged(tiled(large.where("extra = 0"), data, width, least), "links"))
    labels = grouped(links)
    return resolved(members, labels)


def grouped(links: DataFrame) -> DataFrame:
    """doc, group of all documents with a link."""
    return staged(connected_components(links).select(F.col("node").alias("doc"), F.col("component").alias("group")), "groups")


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the buckets that hold several groups, with their group and the number of members."""
    now = staged(buckets.join(labels, "doc", "left").withColumn("group", F.coalesce("group", "doc")), "grouped")
    mixed = now.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.count("*").alias("many")).where("g0 <> g1")
    out = staged(now.join(staged(mixed.select("token", "many"), "mixed").hint("merge"), "token"), "mixed-buckets")
    unstage(now)
    return out


def tiled(members: DataFrame, data: DataFrame, width: int, least: int) -> DataFrame:
    """Links between groups in large buckets.

    A bucket is dealt into parts of about TILE documents, and each two parts are a tile. In a tile the intersections of
    all sets are one product of matrices, over the shingles that at least two of its documents hold; of the links a tile
    returns those that join what it has not joined yet.
    """

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        trim()
        rows = rows.sort_values(["doc", "data"])
        own = sets([zstandard.decompress(x).decode("utf-8", "surrogatepass") for x in rows["data"]], width)
        n, doc, group, part = np.array([len(x) for x in own]), rows["doc"].to_numpy(), rows["group"].to_numpy(), rows["part"].to_numpy()
        names, code, many = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(own)), n)
        both = many[code] > 1
        column = (np.cumsum(many > 1) - 1)[code[both]]
        row, shared = row[both], np.zeros((len(own), len(own)), np.float32)
        for low in range(0, int(column.max(initial=-1)) + 1, 4096):
            at = (column >= low) & (column < low + 4096)
            block = np.zeros((len(own), 4096), np.float32)
            block[row[at], column[at] - low] = 1
            shared += block @ block.T
        link = 100 * shared >= least * (n[:, None] + n[None, :] - shared)
        link &= (group[:, None] != group[None, :]) & np.triu(np.ones_like(link), 1)
        parent, out = {g: g for g in group.tolist()}, []
        for x, y in zip(*np.nonzero(link)):
            a, b = group[x], group[y]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((doc[x], doc[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    tiles = F.ceil(F.col("many") / TILE).cast("int")
    dealt = members.withColumns({"tiles": tiles, "part": F.pmod(F.xxhash64("doc"), tiles).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "doc", "group", "part")
    full = dealt.join(data.hint("merge"), "doc").select("token", "i", "j", "doc", "group", "part", "data")
    return full.groupBy("token", "i", "j").applyInPandas(check, "a long, b long")


def resolved(members: DataFrame, groups: DataFrame) -> DataFrame:
    """From (doc_id, n, rep) and (doc = rep, group) to a row per document."""
    reps = members.where("rep IS NOT NULL").groupBy(F.col("rep").alias("doc")).agg(F.count("*").alias("copies"))
    known = staged(reps.join(groups, "doc").select(F.col("doc").alias("rep"), "group", "copies"), "known")
    total = known.agg(F.sum("copies")).first()[0] or 0
    out = hot_join(members, known, "rep", "copies", total, F.xxhash64("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("group", "rep", "doc_id")).alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), width=3, least=90)


#: The links of all pairs that share a shingle, and what can be reached by them.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS f, doc_id AS t FROM documents UNION SELECT f, y FROM r JOIN e ON t = x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT f, min(t) AS component_id FROM r GROUP BY f) m ON d.doc_id = m.f
"""
