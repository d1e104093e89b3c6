"""Best-fit packing of tokenised documents into sequences of bounded length, by large-item matching.

Every document is its token ids and an end id; only documents longer than a sequence are cut. Pieces above a third of
the capacity can stand at most two in a sequence: the longest is matched with the longest that still fits, until none is
left; shorter pieces then go, longest first, where the least room is left over. All pieces of one length are alike, so
this runs on the counts of each length, of which there are as many as the capacity; what comes out are runs of like
sequences. Each piece finds its place by its rank among the pieces of its length: its rank in its own input part, plus
the counts of that length in the parts before.

Defined results: a null text is an empty one and a piece of the end id alone; repeated rows are packed each for itself;
an empty table gives no sequences. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from cardwright.llm.common import named_texts, numbered, small, staged, stepwise, table, trim

CAPACITY = 2048
END = 0
#: Words, and as many parts of words, in each of the two generations that a worker remembers, at some 120 bytes each. Fewer
#: take less memory and more time.
CACHE_WORDS = 700_000


#: A line of letters that normalisation leaves as they are, with marks before and after them, neither "'" nor "<" among
#: these: each of the three is a token group of its own. Or any other line.
SIMPLE = re.compile(r"^(?:([!-&(-/:;=-@\[-`{-~]*)([a-zß-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)|(.*))$", re.MULTILINE)


class Words:
    """Ids by the tokenizer, with a cache by word: this tokenizer's rules never look across a space.

    New simple words are taken apart, and those of their parts that are new go to the tokenizer's model as one text; the
    last id of a part tells where it ends. Other new words go to the tokenizer as one text with MARK between them; no
    other text has the ids of MARK, so these tell where a word ends.
    """

    MARK = "\u2603"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        if any("<" not in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a special token could stand in a simple word")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = CACHE_WORDS
        self.known, self.parts = {"": b""}, {"": b""}
        self.old_known: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.mark = self.plain(self.MARK)

    def age(self) -> None:
        """Words that were not met since the last time are forgotten."""
        if len(self.known) > self.limit:
            self.known, self.old_known = {"": b""}, self.known
        if len(self.parts) > self.limit:
            self.parts, self.old_parts = {"": b""}, self.parts

    @staticmethod
    def recalled(new: set[str], known: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
        """Those of the new words that the older generation doesn't know either; the others become known again."""
        again = new.intersection(old) if old else ()
        if again:
            known.update((w, old[w]) for w in again)
            new = new.difference(again)
        return new

    def plain(self, text: str, bare: bool = False) -> np.ndarray:
        tokenizer = self.bare if bare else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # without offsets

    def keep(self, into: dict[str, bytes], words: list[str], ids: np.ndarray, begin: list[int], end: list[int]) -> None:
        if len(end) != len(words):
            raise ValueError("the tokenizer has joined words")
        raw = ids.tobytes()
        into.update(zip(words, [raw[4 * i : 4 * j] for i, j in zip(begin, end)]))

    def learn_parts(self, new: list[str]) -> None:
        ids = self.plain(" ".join(new), bare=True)
        end = (np.flatnonzero(self.last[ids]) + 1).tolist()
        self.keep(self.parts, new, ids, [0, *end[:-1]], end)

    def learn_marked(self, new: list[str]) -> None:
        ids, k = self.plain(f" {self.MARK} ".join(new)), len(self.mark)
        at = np.flatnonzero(np.all([ids[i : len(ids) - k + 1 + i] == x for i, x in enumerate(self.mark)], axis=0)) if len(ids) >= k else np.zeros(0, int)
        self.keep(self.known, new, ids, [0, *(at + k).tolist()], [*at.tolist(), len(ids)])

    def learn(self, new: list[str]) -> None:
        before, letters, after, other = zip(*SIMPLE.findall("\n".join(new).lower()))
        fresh = self.recalled(set(letters).union(before, after).difference(self.parts), self.parts, self.old_parts)
        if fresh:
            self.learn_parts(list(fresh))
        of = self.parts.__getitem__
        self.known.update(zip(new, map(b"".join, zip(map(of, before), map(of, letters), map(of, after)))))
        rest = [w for w, o in zip(new, other) if o]
        self.known.update((w, self.plain(w).tobytes()) for w in rest if self.MARK in w)
        rest = [w for w in rest if self.MARK not in w]
        if rest:
            self.learn_marked(rest)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        self.age()
        new = self.recalled(set().union(*words).difference(self.known), self.known, self.old_known)
        if new:
            self.learn(list(new))
        end = END.to_bytes(4, "little")
        return [np.frombuffer(b"".join(map(self.known.__getitem__, w)) + end, "<u4") for w in words]


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One per worker: workers live on from task to task, and with them the words they know."""
    return Words(path)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Lengths of the pieces in a sequence, and the number of such sequences, for so many pieces of each length."""
    left = defaultdict(int, {n: c for n, c in counts.items() if c > 0})
    out: list[tuple[tuple[int, ...], int]] = []
    large = sorted(n for n in left if 3 * n > capacity)
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    order: list[int] = []

    def leave(slots: tuple[int, ...], count: int) -> None:
        room = capacity - sum(slots)
        if room == 0:
            out.append((slots, count))
            return
        if not rooms[room]:
            insort(order, room)
        rooms[room].append((slots, count))

    while large:
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1
        mate = large[k] if k >= 0 else 0
        if not mate or mate == n and left[n] == 1:
            k = k - 1 if mate else -1
            mate = large[k] if k >= 0 else 0
        if not mate:
            leave((n,), left[n])
            left[n] = 0
        elif mate == n:
            leave((n, n), left[n] // 2)
            left[n] %= 2
        else:
            c = min(left[n], left[mate])
            leave((n, mate), c)
            left[n] -= c
            left[mate] -= c
            if not left[mate]:
                large.pop(k)
        if not left[n]:
            large.pop()
    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k == len(order):
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    leave((n,) * each, full)
                if rest:
                    leave((n,) * rest, 1)
                left[n] = 0
                break
            room = order[k]
            slots, count = rooms[room].pop()
            if not rooms[room]:
                order.pop(k)
            each = min(room // n, max(1, left[n] // count))  # as many as fit best fit would put there one by one
            c = min(count, left[n] // each)
            left[n] -= c * each
            if c < count:
                leave(slots, count - c)
            leave(slots + (n,) * each, c)
    for room in order:
        out += rooms[room]
    return out


def places(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """length, first rank, first sequence, offset of each run of like pieces, by length and rank."""
    rows, rank, base = [], defaultdict(int), 0
    for slots, count in sequences:
        offset = 0
        for n in slots:
            rows.append((n, rank[n], base, offset))
            rank[n] += count
            offset += n
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True, remembered: int = CACHE_WORDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, its part and its rank there among pieces of its length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ranks, part = words_of(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        words.limit = remembered
        trim()
        for b in small(batches):
            rows = []
            for d, ids in zip(b["doc_id"], words.ids([t or "" for t in b["text"]])):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    n = len(piece)
                    rows.append((d, k, at, n, zlib.crc32(piece.tobytes()), part, ranks[n], *([piece] * with_ids)))
                    ranks[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * with_ids])

    return numbered(named_texts(docs).mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<long>" * with_ids))


@stepwise
def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True, remembered: int = CACHE_WORDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if wanted."""
    spark = docs.sparkSession
    pieces = staged(tokenised(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, with_ids, remembered), "pieces")
    by_part = staged(pieces.groupBy("part", "length").count(), "piece-counts")
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # a row per length, so at most capacity
    found = spark.sparkContext.broadcast(places(plan(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs = found.value
        at = np.searchsorted((runs[:, 0] << 48) + runs[:, 1], (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 2] + rank.to_numpy() - runs[at, 1], "offset": runs[at, 3]})

    out = pieces.join(before.hint("merge"), ["part", "length"])  # the counts grow with the parts: no broadcast
    out = out.withColumn("place", place("length", F.col("rank") + F.col("before")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * with_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
