"""WARC archives with a two-level capture index.

Every row becomes a record in gzip members of `.warc.gz` files. The captures, sorted by reversed-host URL key, are cut
into compressed blocks; a sparse directory names the first key of each block. A lookup searches the parts' bounds, then
a part's directory, then one block, by bisection each, and reads the record by its byte range.

Defined results: a null payload is an empty one; a null URL has the key "-"; rows that repeat a page_id are records of
their own (all that hold the largest page_id of a payload are responses); a null page_id sorts below all others, and
such rows refer to the response if there is one. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import hot_join, new_folder, parts, staged, stepwise, table
from cardwright.llm.storage import Reader, opened

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: An archive file is closed beyond this size.
FILE_BYTES = 256 << 20
#: A block of the index has so many lines.
BLOCK_LINES = 1000
NO_ID = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"

CAPTURE = "key string, pid long, page_id long, record_type string, file string, offset long, length long"
PART = "first_key string, first_pid long, last_key string, last_pid long, blocks string, directory string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Reversed host, then the rest: http://www.example.com/a -> com,example,www)/a"""
    if url is None or "://" not in url:
        return "-" if url is None else f"){url}"
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def record_bytes(page_id, url, payload: bytes, digest: str, n: int, revisit: bool, refers_to) -> bytes:
    """One gzip member with one WARC record. A revisit keeps the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~')}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    return number("WARC-Record-ID"), None if url is None else unquote(url), n, digest, kind, number("WARC-Refers-To"), None if kind == "revisit" else payload


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, n, digest, response_id: of the equal payloads of REVISIT_BYTES or more, the largest page_id."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    groups = base.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
    groups = staged(groups.where("copies > 1"), "warc-groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    return hot_join(base, groups, "digest", "copies", total, F.xxhash64("page_id", "url"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write all records; a row per capture, of the tasks that ended well."""
    folder = new_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at, uri = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for r in batch.itertuples(index=False):
                    page_id = None if r.page_id is None else int(r.page_id)
                    to = None if r.response_id is None else int(r.response_id)
                    revisit = to is not None and to != page_id
                    member = record_bytes(page_id, r.url, r.payload, r.digest, r.n, revisit, to)
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        uri, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        store, path = opened(uri)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    out.write(member)
                    rows.append((url_key(r.url), NO_ID if page_id is None else page_id, page_id, "revisit" if revisit else "response", uri, at, len(member)))
                    at += len(member)
                got = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")])
                got["page_id"] = got["page_id"].astype("Int64")
                yield got
        finally:
            if out is not None:
                out.close()

    rows = with_roles(pages)  # the ids go as strings: pandas would make them floats beside nulls
    return rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "response_id")}).mapInPandas(write, CAPTURE)


class CaptureIndex:
    """The parts of an index; each has a file of blocks and a file with their directory."""

    def __init__(self, spark: SparkSession, rows: list):
        self.spark = spark
        self.rows = sorted(((r.first_key, r.first_pid), (r.last_key, r.last_pid), r.blocks, r.directory) for r in rows)

    @classmethod
    def build(cls, captures: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        """Sort by key and page, so that a URL of many captures is dealt to many parts."""
        spark = captures.sparkSession
        folder = new_folder(spark, "captures")

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name = f"{folder}/{uuid.uuid4().hex}"
            out, at, lines, directory, first, last = None, 0, [], [], None, None

            def close_block() -> None:
                nonlocal at, lines
                data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
                out.write(data)
                directory.append([*lines[0][:2], at, len(data)])
                at, lines = at + len(data), []

            for batch in batches:
                for r in batch.itertuples(index=False):
                    if out is None:
                        store, path = opened(name + ".blocks")
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out, first = store.open_output_stream(path, compression=None), (r.key, int(r.pid))
                    last = (r.key, int(r.pid))
                    lines.append([r.key, int(r.pid), r.file, int(r.offset), int(r.length)])
                    if len(lines) >= block_lines:
                        close_block()
            if out is not None:
                if lines:
                    close_block()
                out.close()
                store, path = opened(name + ".directory")
                with store.open_output_stream(path, compression=None) as f:
                    f.write(json.dumps(directory).encode())
                yield pd.DataFrame([(*first, *last, name + ".blocks", name + ".directory")], columns=[c.split()[0] for c in PART.split(", ")])

        made = captures.select("key", "pid", "file", "offset", "length").repartitionByRange(parts(spark), "key", "pid").sortWithinPartitions("key", "pid").mapInPandas(write, PART)
        return cls(spark, made.collect())  # a row per part, so as many as shuffle partitions

    def find(self, wanted: DataFrame) -> DataFrame:
        """The captures of each distinct (key, pid) of wanted: file, offset, length."""
        bounds = self.rows

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, blocks, directories, before = Reader(), {}, {}, None
            firsts = [b[0] for b in bounds]

            def block(part: int, k: int) -> list:
                if (part, k) not in blocks:
                    while len(blocks) >= 4:
                        blocks.pop(next(iter(blocks)))
                    _, _, at, n = directories[part][k]
                    blocks[part, k] = [json.loads(x) for x in zlib.decompress(reader.read(bounds[part][2], at, n)).decode().split("\n")]
                return blocks[part, k]

            for batch in batches:
                found = []
                for want in zip(batch["key"], batch["pid"].map(int)):
                    if want == before:
                        continue
                    before = want
                    # equal captures may stand in several blocks or parts: go back from the last that can hold them
                    part = bisect_right(firsts, want) - 1
                    while part >= 0 and bounds[part][1] >= want:
                        if part not in directories:
                            while len(directories) >= 4:
                                directories.pop(next(iter(directories)))
                            directories[part] = json.loads(reader.whole(bounds[part][3]))
                        k = bisect_right(directories[part], want, key=lambda d: (d[0], d[1])) - 1
                        while k >= 0:
                            lines = block(part, k)
                            i = bisect_right(lines, want, key=lambda x: (x[0], x[1])) - 1
                            while i >= 0 and (lines[i][0], lines[i][1]) == want:
                                found.append(lines[i][2:])
                                i -= 1
                            if i >= 0:
                                break
                            k -= 1
                        if k >= 0:
                            break
                        part -= 1
                yield pd.DataFrame(found, columns=["file", "offset", "length"])

        near = wanted.select("key", "pid").repartitionByRange(parts(self.spark), "key", "pid").sortWithinPartitions("key", "pid")
        return near.mapInPandas(search, "file string, offset long, length long")


def read_records(locations: DataFrame) -> DataFrame:
    """Read and parse each record by its byte range, in the order of the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            rows = [parse_record(reader.read(f, int(at), int(n))) for f, at, n in zip(batch["file"], batch["offset"], batch["length"])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    spark = locations.sparkSession
    return locations.repartitionByRange(parts(spark), "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(read, RECORD)


@stepwise
def round_trip(pages: DataFrame) -> DataFrame:
    """Write every row's record, index the archives, and read each row's record back through the index."""
    captures = staged(write_archives(pages), "captures")
    index = CaptureIndex.build(captures)
    key = F.pandas_udf(lambda s: s.map(url_key), "string")
    ids = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID).cast("long"))
    found = index.find(pages.select(key(F.col("url").cast("string")).alias("key"), ids.alias("pid")))
    return read_records(staged(found, "locations"))  # dealing by ranges reads its input twice


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n >= 1000) ELSE page_id END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top = page_id THEN NULL ELSE top END AS refers_to
FROM m
"""
