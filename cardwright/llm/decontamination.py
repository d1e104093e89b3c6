"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts and benchmark items are case-folded and their white space folded to single spaces. A passage of a text that is an
item but for k edits (of bytes) shares at least m + 1 - q (k + 1) of the item's q-grams with it, m being its bytes, and
their diagonals (place in the text less place in the item) lie within k of one another. So shared q-grams are counted in
bands of 2 (k + 1) diagonals, each overlapping half of the next; only bands which reach that number are aligned, by a
dynamic program over the band's diagonals and the k on either side that the passage's ends may reach. An item's budget is
ERRORS of its bytes, less where the lemma would say nothing; items of fewer than q bytes are looked for as they are.

Every passage is reported. Of overlapping passages of one item that with the fewest edits stays, then the first.

The benchmark is written to the shared folder in blocks of at most BLOCK_BYTES (a longer item is a block of its own). The
corpus is read once; a worker holds one block at a time and takes it through CHUNK_ROWS documents, so neither the number
of scans nor any worker's memory grows with the benchmark.

Defined results: null or empty texts and items hit nothing; an item without an id is reported with a null one, an id that
repeats with the passages of each of its items; repeated documents are each reported, also without an id. Texts are read
whole.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import named_texts, new_folder, numbered, small, table, trim
from cardwright.llm.storage import Reader, opened

Q = 8
ERRORS = 0.1
BLOCK_BYTES = 4 << 20
CHUNK_ROWS = 4096
HITS = "doc_id string, item_id string, start long, end long, edits long"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BITS = 20


def canonical(text: str | None) -> bytes:
    return " ".join((text or "").casefold().split()).encode("utf-8", "replace").replace(b"\0", b" ")


def budget(m: int, q: int = Q, errors: float = ERRORS) -> int:
    """Edits allowed in an item of m bytes: so few that at least one q-gram must be shared."""
    return max(0, min(int(errors * m), m // q - 1))


def grams(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    a = raw.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    return a[:-4] | a[4:] << np.uint64(32)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int] | None:
    """Least edits that turn the item into a stretch of the text along the diagonals from low to high, and the stretch's
    first end; None beyond k. Cell d of a row is the place row + low + d of the text."""
    width = high - low + 1
    step = np.arange(width, dtype=np.int32)
    far = np.int32(len(item) + len(text) + 1)
    place = low + step.astype(np.int64)  # of the text, before the first byte of the item
    cost = np.where((place >= 0) & (place <= len(text)), np.int32(0), far).astype(np.int32)
    padded = np.concatenate([np.full(max(0, -low) + 1, -1, np.int16), text.astype(np.int16), np.full(max(0, high + len(item) - len(text)) + 1, -1, np.int16)])
    shift = max(0, -low) + 1 + low
    for i, c in enumerate(item.tolist()):
        new = cost + (padded[shift + i : shift + i + width] != c)  # the byte of the text that a step along d takes
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])
        place += 1
        new[(place < 0) | (place > len(text))] = far
        cost = np.minimum.accumulate(new - step) + step
        cost[place > len(text)] = far
        if i % 16 == 15 and cost.min() > k:
            return None
    at = int(cost.argmin())
    return (int(cost[at]), int(place[at])) if cost[at] <= k else None


class Benchmark:
    """The q-grams of a block of items, and where they stand."""

    def __init__(self, ids: list[str | None], items: list[bytes]):
        self.ids, self.items = ids, items
        self.size = np.array([len(x) for x in items], np.int64)
        self.k = np.array([budget(n) for n in self.size], np.int64)
        self.least = np.maximum(1, self.size + 1 - Q * (self.k + 1))
        own = [grams(np.frombuffer(x, np.uint8)) for x in items]
        gram = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(x) for x in own])
        place = np.concatenate([np.arange(len(x)) for x in own]) if own else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(gram)))
        self.marked = np.zeros(1 << BITS, bool)
        self.marked[self.slot(self.gram)] = True
        self.short = [i for i, n in enumerate(self.size) if n < Q]

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (gram * MULTIPLIER) >> np.uint64(64 - BITS)

    def hits(self, docs: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """Number of the document, number of the item, start, end, edits of each passage."""
        whole = (b"\0" * Q).join(docs)
        size = np.array([len(d) for d in docs], np.int64)
        begins = np.cumsum(size + Q) - size - Q
        found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        for i in self.short:
            for d, doc in enumerate(docs):
                for m in re.finditer(re.escape(self.items[i]), doc):
                    found.setdefault((d, i), set()).add((0, m.start(), m.end()))
        raw = np.frombuffer(whole, np.uint8)
        for item, low, high, left, right in self.bands(grams(raw)):
            m, k = int(self.size[item]), int(self.k[item])
            for d in range(*(np.searchsorted(begins, [left, right], side="right") + [-1, 0])):  # several, where documents are short
                first, last = max(int(begins[d]), low - k), min(int(begins[d] + size[d]), high + m + k)
                if last > first and (hit := self.verified(item, whole[first:last], low - k - first, high + k - first)):
                    shift = first - int(begins[d])
                    found.setdefault((d, item), set()).add((hit[0], hit[1] + shift, hit[2] + shift))
        out = []
        for (d, i), all_ in found.items():
            kept: list[tuple[int, int, int]] = []
            for n, s, e in sorted(all_):
                if all(e <= a or s >= b for _, a, b in kept):
                    kept.append((n, s, e))
                    out.append((d, i, s, e, n))
        return out

    def bands(self, gram: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Item, first and last diagonal, first and last place of a shared q-gram, for each band with enough shared q-grams."""
        at = np.flatnonzero(self.marked[self.slot(gram)])
        if not len(at) or not len(self.gram):
            return
        k = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        real = self.gram[k] == gram[at]
        at, k = at[real], k[real]
        many = self.many[k]
        if not many.sum():
            return
        row = np.repeat(self.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, place = self.item[row], np.repeat(at, many)
        width = self.k[item] + 1
        key = item << 40 | (place - self.place[row]) // width + (1 << 30)
        order = np.argsort(key, kind="stable")  # so a band's places rise
        key, first, count = np.unique(key[order], return_index=True, return_counts=True)
        left, right = place[order][first], place[order][first + count - 1]
        for x in np.flatnonzero(count + np.where(np.append(key[1:], 0) == key + 1, np.append(count[1:], 0), 0) >= self.least[key >> 40]).tolist():
            # a band whose first half is empty has its q-grams in the first half of the next one, and is among the k diagonals beside it
            i, joint = int(key[x] >> 40), x + 1 < len(key) and key[x + 1] == key[x] + 1
            w = int(self.k[i]) + 1
            low = (int(key[x] & ((1 << 40) - 1)) - (1 << 30)) * w
            yield i, low, low + 2 * w - 1, min(left[x], left[x + joint]), max(right[x], right[x + joint])

    def verified(self, item: int, region: bytes, low: int, high: int) -> tuple[int, int, int] | None:
        """Edits, start and end in the region, of a passage along the diagonals from low to high."""
        want, k = self.items[item], int(self.k[item])
        at = region.find(want, max(0, low))
        if 0 <= at <= high:
            return 0, at, at + len(want)
        a, b = np.frombuffer(want, np.uint8), np.frombuffer(region, np.uint8)
        if (forth := align(a, b, low, high, k)) is None:
            return None
        edits, end = forth
        back = align(a[::-1], b[:end][::-1], -k, k, k)  # backwards from the end, so along the diagonals about 0
        return edits, end - (back[1] if back else len(want)), end


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """The benchmark, written a bounded part at a time to the shared folder; the files' names."""
    folder, names = new_folder(items.sparkSession, "benchmark"), []
    ids, found, size = [], [], 0

    def close() -> None:
        nonlocal ids, found, size
        if found:
            names.append(f"{folder}/{len(names)}")
            store, path = opened(names[-1])
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path, compression=None) as f:
                f.write(pickle.dumps((ids, found)))
        ids, found, size = [], [], 0

    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        form = canonical(r.text)
        if form:
            if size + len(form) > block_bytes:
                close()
            ids.append(r.item_id)
            found.append(form)
            size += len(form)
    close()
    return names


@lru_cache(maxsize=1)
def block_of(name: str) -> Benchmark:
    """One at a time in each worker."""
    return Benchmark(*pickle.loads(Reader().whole(name)))


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per passage: doc_id, item_id, start, end (bytes of the folded text), edits."""
    names = blocks(items, block_bytes)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def search() -> Iterator[pd.DataFrame]:
            for name in names:
                bench = block_of(name)
                for b in held:
                    rows = [(b["doc_id"].iloc[d], bench.ids[i], s, e, n) for d, i, s, e, n in bench.hits([canonical(t) for t in b["text"]])]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"])
            held.clear()
            trim()

        for b in small(batches):
            held.append(b)
            if sum(map(len, held)) >= (CHUNK_ROWS if len(names) > 1 else 1):
                yield from search()
        if held:
            yield from search()

    out = numbered(named_texts(docs).mapInPandas(find, HITS))
    return out.withColumn("item_id", F.col("item_id").cast("long"))


def flagged(docs: DataFrame, items: DataFrame, column: str = "leaked", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, with a boolean column that tells whether any item is in the text; rows and other columns stay as they are."""
    names = blocks(items, block_bytes)

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        hit = np.zeros(len(column), bool)
        for name in names:
            bench = block_of(name)
            for at in range(0, len(column), 256):
                hit[[at + d for d, *_ in bench.hits([canonical(t) for t in column.iloc[at : at + 256]])]] = True
        trim()
        return pd.Series(hit)

    return docs.drop(column).withColumn(column, holds(F.col("text").cast("string")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
