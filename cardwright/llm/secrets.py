"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, then checksums.

The keywords are looked for in the lower-cased text; at each hit the kind's expression is tried at that very place in
the text, from left to right, and a hit inside the kind's last match is passed over. That finds what a search over the
whole text would find, as each of these expressions begins with its keyword. Kinds with a checksum (the last six
characters of such a token are the base-62 CRC-32 of the thirty before) are reported only where it holds. A run of
lower-case hexadecimal digits has no keyword, so its expression reads the whole text.

Defined results: a null text is an empty one, with no spans; repeated rows are scanned one by one. Offsets are in code
points, ends exclusive. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cardwright.llm.common import named_texts, numbered, small, table

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def checksum(body: str) -> str:
    """The six base-62 digits that such tokens end with."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _summed(m: re.Match) -> bool:
    return checksum(m[1]) == m[2]


#: kind -> keywords, expression, test; in the order in which kinds with one start are listed
KINDS: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": ((), re.compile(r"[0-9a-f]{24,}"), lambda m: True),
    "forge": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _summed),
    "registry": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _summed),
    "pem": (("-----begin",), re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), lambda m: True),
}
BASE = ("assign", "access", "hex")
SPANS = "doc_id string, kind string, start int, end int"


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (words, _, _) in KINDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """start, order of kind, end, by start and kind."""
    folded = text.lower()
    if len(folded) != len(text):  # a few capitals become two code points
        folded = text.translate(FOLD)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in automaton().iter(folded):
        starts.setdefault(kind, []).append(end - n + 1)
    found = []
    for k, (kind, (words, pattern, test)) in enumerate(KINDS.items()):
        if not words:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if test(m)]
            continue
        last = 0
        for at in sorted(starts.get(kind, ())):
            if at >= last and (m := pattern.match(text, at)):
                last = m.end()
                if test(m):
                    found.append((at, k, last))
    return sorted(found)


def joined(spans: list[tuple[int, int, str]], names: list[str]) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """A row per span: doc_id, kind, start, end."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(KINDS)
        for b in small(batches):
            yield pd.DataFrame([(d, names[k], s, e) for d, t in zip(b["doc_id"], b["text"]) for s, k, e in scan(t or "")], columns=["doc_id", "kind", "start", "end"])

    return numbered(named_texts(docs).mapInPandas(find, SPANS))


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row per document: counts of the base kinds, their digest, and all spans."""
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, n = list(KINDS), len(BASE)
        for b in small(batches):
            rows = []
            for t in b["text"]:
                spans = scan(t or "")
                base = [x for x in spans if x[1] < n]
                rows.append((*(sum(x[1] == k for x in base) for k in range(n)), hashlib.sha256(joined(base, names).encode()).hexdigest(), joined(spans, names)))
            out = pd.DataFrame(rows, columns=columns[1:])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return numbered(named_texts(docs).mapInPandas(find, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
