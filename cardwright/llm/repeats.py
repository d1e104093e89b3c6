"""Exact repeats of WIDTH bytes, by a depth-limited radix sort of all suffixes.

Only the first WIDTH bytes of a suffix matter: a window. Passes from the most significant digit on split the windows into
groups by their first bytes; a group of one is done, and what is together after the last pass is a repeated window. The
digits are wide, so there are three of them, and a digit is ordered by its hash:

1. the first 32 bytes. A window is out as soon as any 32 bytes in it stand nowhere else, so the grams which are looked at
   here are those whose hash is 0 in three bits, some eight in each window; a window without any goes on;
2. the first 64 bytes: the groups of two or more get a number, those of one are done. The 64 bytes that end a window are
   numbered with them;
3. the 64 bytes that end it, by their number, within the group of the pass before. So all WIDTH bytes are compared.

Documents stand in order of doc_id in blocks of some MB, a row each, so of two blocks the one with the lower number is the
earlier. A pass looks inside each block first, where equal digits are one record; so a passage that a third of all
documents hold is sent once by each block. Records go to buckets, packed by column and sorted, and a bucket answers each
block with a bit, or a group's number, for each record. What shares its digits with other windows of its own block alone is
settled there.

The 32 and 64 bytes are compared by 43 bits of their hashes, then by numbers: equal windows agree in the 43 bits of their
first 64 bytes and the 43 of their last. The bits of the first pass only spare work. No bytes are compared across blocks.

Defined results: a null text is an empty one. The earlier of two windows is that of the smaller doc_id (null first), then,
for rows that repeat a doc_id, that of the text with the smaller hash. Texts are read whole; texts under WIDTH bytes lose
nothing. A row gets longer with the blocks and shorter with the buckets: for tens of TB give larger blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import named_texts, numbered, parts, staged, stepwise, table, texts, trim

WIDTH, FIRST, SECOND = 100, 32, 64
#: Of the grams, those are looked at in the first pass whose hash is 0 in these bits.
LOOKED_AT = np.uint64(7)
BLOCK_BYTES = 2 << 20
NULL_ID = -(1 << 63)
RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RECORDS = "bucket int, block long, n int, data binary"
ANSWERS = "block long, step int, bucket int, data binary"
#: Places of hashed bytes that are worked on at a time: they fit in a core's cache.
CHUNK = 1 << 14
#: A digit is a hash without so many low bits, where a sort keeps the place; so larger blocks sort more slowly.
SPARE = 21
KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, data: some MB of documents in each row, in order of doc_id."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, part, k, ids, data, size = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pd.DataFrame:
            nonlocal k, ids, data, size
            head = np.array([len(ids), *ids, *map(len, data)], np.int64).tobytes()
            row = pd.DataFrame([((part << 32) + k, packer.compress(head + b"".join(data)))], columns=["block", "data"])
            k, ids, data, size = k + 1, [], [], 0
            return row

        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                one = (t or "").encode("utf-8", "surrogatepass")
                if ids and size + len(one) > block_bytes:
                    yield close()
                ids.append(NULL_ID if d is None else int(d))
                data.append(one)
                size += len(one)
        if ids:
            yield close()

    # rows that are equal in id and text may stand in any order, so they can be dealt to several parts
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    rows = texts(docs).withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return named_texts(rows).mapInPandas(pack, "block long, data binary")


def mixed(h: np.ndarray) -> np.ndarray:
    """In place."""
    h *= KEYS[0]
    h ^= h >> np.uint64(29)
    h *= KEYS[1]
    h ^= h >> np.uint64(32)
    return h


def joined(h: np.ndarray, reach: int, key: int) -> np.ndarray:
    """The hash of what a place's hash covers, and of what that of the place `reach` on does."""
    return mixed(h[:-reach] * KEYS[key] + h[reach:]) if len(h) > reach else np.zeros(0, np.uint64)


def packed(numbers: np.ndarray, width: int = 8) -> bytes:
    """Numbers as zstd of their bytes, all first bytes first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpacked(data: bytes, n: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=np.uint64(0))


def sorted_with_places(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 64 - SPARE bits in order, and where each of them stood; equal ones in order of place."""
    if len(digits) > 1 << SPARE:
        order = np.argsort(digits, kind="stable")
        return digits[order], order
    both = np.sort(digits << np.uint64(SPARE) | np.arange(len(digits), dtype=np.uint64))  # far faster than to sort the places
    return both >> np.uint64(SPARE), (both & np.uint64((1 << SPARE) - 1)).astype(np.int64)


def heads(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def bucket_of(digits: np.ndarray, buckets: int) -> np.ndarray:
    """By the most significant bits, so that it rises with the digit."""
    return ((digits >> np.uint64(32 - SPARE)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class Block:
    """The documents of a block, and the hashes of the 32 bytes from each place on."""

    ids: np.ndarray
    size: np.ndarray
    ends: np.ndarray
    whole: bytes
    first: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Block:
        raw = zstandard.decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 2 * n, 8)
        ids, size, whole = head[:n], head[n:], raw[8 * (2 * n + 1) :]
        text, first = np.frombuffer(whole, np.uint8), np.empty(max(0, len(whole) - FIRST + 1), np.uint64)
        for at in range(0, len(first), CHUNK):
            a = text[at : at + CHUNK + FIRST - 1].astype(np.uint64)
            a = a[:-1] | a[1:] << np.uint64(8)
            a = a[:-2] | a[2:] << np.uint64(16)
            a = a[:-4] | a[4:] << np.uint64(32)
            first[at : at + CHUNK] = joined(joined(mixed(a), 8, 1), 16, 2)
        return cls(ids, size, np.cumsum(size), whole, first)

    def inside(self, at: np.ndarray, n: int) -> np.ndarray:
        """Those of the places (in order) from which a document has n bytes more."""
        left = self.ends[np.searchsorted(self.ends, at, side="right")] - at if len(at) else at
        return at[left >= n]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and digits that the first pass looks at."""
        at = self.inside(np.flatnonzero(self.first & LOOKED_AT == 0), FIRST)
        return at, self.first[at] >> np.uint64(SPARE)

    def second(self, place: np.ndarray) -> np.ndarray:
        """The hashes of 64 bytes."""
        return mixed(self.first[place] * KEYS[3] + self.first[place + FIRST])

    def windows(self, buckets: int, notes: Notes) -> tuple[np.ndarray, Sent, np.ndarray]:
        """Places of the windows that the first pass leaves; the digits of the 64 bytes with which one begins or ends; and
        which of the places that have a digit each place of the text is."""
        at, digit = self.grams()
        sent = Sent.of(digit, buckets)
        alone = at[~(notes.bits(1, sent) | (sent.many > 1))[sent.index]]
        gone = np.zeros(len(self.whole) + 1, np.int32)
        np.add.at(gone, np.maximum(alone - (WIDTH - FIRST), 0), np.int32(1))
        np.add.at(gone, alone + 1, np.int32(-1))
        place = self.inside(np.flatnonzero(np.cumsum(gone[:-1], dtype=np.int32) == 0), WIDTH)
        marked = np.zeros(len(self.whole) + 1, bool)
        marked[place] = True
        marked[place + (WIDTH - SECOND)] = True
        every = np.flatnonzero(marked)
        return place, Sent.of(self.second(every) >> np.uint64(SPARE), buckets), np.cumsum(marked, dtype=np.int32) - 1


def cuts_of(bucket: np.ndarray) -> tuple[list[int], list[int]]:
    """The buckets, and where each begins and the last ends."""
    at = np.flatnonzero(heads(bucket)) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at].tolist(), [*at.tolist(), len(bucket)]


@dataclass
class Sent:
    """Distinct digits in order and so by bucket, how often each stands in the block, and which one each place has."""

    digit: np.ndarray
    bucket: np.ndarray
    many: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, digits: np.ndarray, buckets: int) -> Sent:
        rising, order = sorted_with_places(digits)
        new = heads(rising)
        at = np.flatnonzero(new)
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        digit = rising[at]
        return cls(digit, bucket_of(digit, buckets), np.diff(np.append(at, len(order))), index)

    def cuts(self) -> tuple[list[int], list[int]]:
        return cuts_of(self.bucket)

    def rows(self, block: int) -> pd.DataFrame:
        names, at = self.cuts()
        return pd.DataFrame([(b, block, j - i, packed(steps(self.digit[i:j]))) for b, i, j in zip(names, at, at[1:])], columns=["bucket", "block", "n", "data"])


class Notes:
    """What the buckets have answered a block."""

    def __init__(self, rows: pd.DataFrame):
        self.data = {(s, b): x for s, b, x in zip(rows["step"], rows["bucket"], rows["data"])}

    def bits(self, step: int, sent: Sent) -> np.ndarray:
        names, at = sent.cuts()
        each = [np.unpackbits(np.frombuffer(zstandard.decompress(self.data[step, b]), np.uint8), count=j - i).astype(bool) for b, i, j in zip(names, at, at[1:])]
        return np.concatenate(each) if each else np.zeros(0, bool)

    def numbers(self, step: int, sent: Sent) -> np.ndarray:
        """The number of each digit's group, from 1; 0 where no other block has it."""
        names, at = sent.cuts()
        out = np.zeros(len(sent.digit), np.uint64)
        for b, i, j in zip(names, at, at[1:]):
            raw = self.data[step, b]
            n = (j - i + 7) // 8
            shared = np.unpackbits(np.frombuffer(raw, np.uint8, n), count=j - i).astype(bool)
            if shared.any():
                out[i:j][shared] = np.cumsum(unpacked(raw[n:], int(shared.sum()), 4))
        return out


def bits_of(marks: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(marks).tobytes())


def gathered(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.cumsum(unpacked(x, n)) for x, n in zip(rows["data"], rows["n"])]


def shared_of(each: list[np.ndarray]) -> np.ndarray:
    """The digits that several blocks have, in order."""
    every = np.sort(np.concatenate(each))
    return np.unique(every[1:][every[1:] == every[:-1]])


def among(some: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each digit stands in some, which are in order, and whether it does."""
    at = np.searchsorted(some, digits)
    return at, some[np.minimum(at, len(some) - 1)] == digits if len(some) else np.zeros(len(digits), bool)


def first_judged(rows: pd.DataFrame) -> pd.DataFrame:
    """A bit for each digit: does another block have it?"""
    trim()
    each = gathered(rows)
    some = shared_of(each)
    return pd.DataFrame([(block, 1, bucket, bits_of(among(some, x)[1])) for block, bucket, x in zip(rows["block"], rows["bucket"], each)], columns=["block", "step", "bucket", "data"])


def second_judged(rows: pd.DataFrame) -> pd.DataFrame:
    """The numbers of the groups that several blocks have."""
    trim()
    each = gathered(rows)
    some, out = shared_of(each), []
    for block, bucket, x in zip(rows["block"], rows["bucket"], each):
        at, hit = among(some, x)
        out.append((block, 2, bucket, np.packbits(hit).tobytes() + (packed(steps(at[hit].astype(np.uint64) + np.uint64(1)), 4) if hit.any() else b"")))
    return pd.DataFrame(out, columns=["block", "step", "bucket", "data"])


def last_judged(rows: pd.DataFrame) -> pd.DataFrame:
    """A bit for each window: does an earlier block have it?"""
    trim()
    rows = rows.sort_values("block")
    halves = [(unpacked(x[8 : 8 + k], n, 4), unpacked(x[8 + k :], n, 6)) for x, n in zip(rows["data"], rows["n"]) for k in [int.from_bytes(x[:8], "little")]]
    group, end = np.concatenate([np.cumsum(g) for g, _ in halves]), np.concatenate([d for _, d in halves])
    bits = int(end.max(initial=0)).bit_length()  # what both fill of 64 bits is sorted at once; stable, so earlier blocks come first
    order = np.argsort(group << np.uint64(bits) | end, kind="stable") if int(group.max(initial=0)).bit_length() + bits <= 64 else np.lexsort((end, group))
    g, d = group[order], end[order]
    late = np.zeros(len(order), bool)
    late[order[1:]] = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    out, at = [], 0
    for block, bucket, n in zip(rows["block"], rows["bucket"], rows["n"]):
        out.append((block, 3, bucket, bits_of(late[at : at + n])))
        at += n
    return pd.DataFrame(out, columns=["block", "step", "bucket", "data"])


@dataclass
class Windows:
    """The windows of a block that share their first 64 bytes with others; and the distinct ones that other blocks may have."""

    place: np.ndarray
    again: np.ndarray  # not the block's first of its kind
    kind: np.ndarray  # which of the distinct ones
    bucket: np.ndarray  # of the distinct ones which other blocks may have, as are the next three
    group: np.ndarray
    end: np.ndarray
    name: np.ndarray

    @classmethod
    def of(cls, block: Block, buckets: int, notes: Notes) -> Windows:
        place, sent, rank = block.windows(buckets, notes)
        group = notes.numbers(2, sent)
        begin, end = sent.index[rank[place]], sent.index[rank[place + (WIDTH - SECOND)]]
        several = (group > 0) | (sent.many > 1)
        stay = several[begin] & several[end]
        place, begin, end = place[stay], begin[stay], end[stay]
        # equal windows are brought together by a hash of both; should others come between them, the slow way is taken
        both, order = sorted_with_places(mixed(begin.astype(np.uint64) * KEYS[3] + end.astype(np.uint64)) >> np.uint64(SPARE))
        new = heads(begin[order]) | heads(end[order])
        if (new & ~heads(both)).any():
            order = np.lexsort((end, begin))
            new = heads(begin[order]) | heads(end[order])
        lead, kind = order[new], np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        again = np.ones(len(order), bool)
        again[lead] = False
        name = np.flatnonzero((group[begin[lead]] > 0) & (group[end[lead]] > 0))
        lead = lead[name]
        _, by_group = sorted_with_places(begin[lead].astype(np.uint64))  # and so by bucket
        lead, name = lead[by_group], name[by_group]
        first, last = begin[lead], end[lead]
        return cls(place, again, kind, sent.bucket[first], group[first], group[last] * np.uint64(buckets) + sent.bucket[last].astype(np.uint64), name)

    def cuts(self) -> tuple[list[int], list[int]]:
        return cuts_of(self.bucket)

    def rows(self, block: int) -> pd.DataFrame:
        names, at = self.cuts()
        out = []
        for b, i, j in zip(names, at, at[1:]):
            groups = packed(steps(self.group[i:j]), 4)
            out.append((b, block, j - i, len(groups).to_bytes(8, "little") + groups + packed(self.end[i:j], 6)))
        return pd.DataFrame(out, columns=["bucket", "block", "n", "data"])


def first_pass(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, data in zip(b["block"], b["data"]):
                trim()
                yield Sent.of(Block.of(data).grams()[1], buckets).rows(block)

    return run


def second_pass(buckets: int):
    def run(held: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        trim()
        return Block.of(held["data"].iloc[0]).windows(buckets, Notes(notes))[1].rows(int(held["block"].iloc[0]))

    return run


def last_pass(buckets: int):
    def run(held: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        trim()
        return Windows.of(Block.of(held["data"].iloc[0]), buckets, Notes(notes)).rows(int(held["block"].iloc[0]))

    return run


def finish(buckets: int):
    """The documents of a block without the bytes that repeated windows cover."""

    def run(held: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        trim()
        block, said = Block.of(held["data"].iloc[0]), Notes(notes)
        w = Windows.of(block, buckets, said)
        earlier = np.zeros(int(w.kind.max(initial=-1)) + 1, bool)
        names, at = w.cuts()
        for b, i, j in zip(names, at, at[1:]):
            earlier[w.name[i:j]] = np.unpackbits(np.frombuffer(zstandard.decompress(said.data[3, b]), np.uint8), count=j - i).astype(bool)
        late = w.place[w.again | earlier[w.kind]]
        cover = np.zeros(len(block.whole) + 1, np.int32)
        np.add.at(cover, late, np.int32(1))
        np.add.at(cover, late + WIDTH, np.int32(-1))
        gone, raw, out, low = np.cumsum(cover[:-1]) > 0, np.frombuffer(block.whole, np.uint8), [], 0
        for d, n in zip(block.ids.tolist(), block.size.tolist()):
            cut = gone[low : low + n]
            spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
            kept = raw[low : low + n][~cut].tobytes() if spans else block.whole[low : low + n]
            out.append((None if d == NULL_ID else str(d), n, int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
            low += n
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


@stepwise
def cut_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    blocks = staged(blocks_of(docs, block_bytes), "blocks")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # blocks are large
    buckets = max(parts(spark), blocks.count() // 8)
    with_notes = lambda notes: blocks.groupBy("block").cogroup(notes.groupBy("block"))
    notes = staged(blocks.mapInPandas(first_pass(buckets), RECORDS).groupBy("bucket").applyInPandas(first_judged, ANSWERS), "first")
    notes = notes.unionByName(staged(with_notes(notes).applyInPandas(second_pass(buckets), RECORDS).groupBy("bucket").applyInPandas(second_judged, ANSWERS), "second"))
    notes = notes.unionByName(staged(with_notes(notes).applyInPandas(last_pass(buckets), RECORDS).groupBy("bucket").applyInPandas(last_judged, ANSWERS), "last"))
    return numbered(with_notes(notes).applyInPandas(finish(buckets), RESULT))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


#: Windows as hexadecimal strings, numbered by document and start; what lies in later ones goes.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) // 2 AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS o FROM w) WHERE o > 1),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
c AS (SELECT q.doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""
