"""WARC archives of pages, and their index by an external merge.

Each page becomes one WARC/1.0 record; of pages with equal payloads the one with
the smallest id is the response, the others are revisits that name it. Digests
come from Spark's own functions, so a first pass reads the html and keeps a short
row for each page, and a second writes the records; html is not shuffled unless
the revisits are too many for Spark to broadcast, by the size of their stored
table. Spark's text writer puts the records into files, by classes of size, so
that a file is bounded in bytes. Reading back gives, for each file, a run of index
entries sorted by URL key and timestamp; runs are cut at common bounds, and for
each range a loser tree merges the runs' slices, so the ranges together list all
captures in order.

Defined results: a null html is an empty payload. A null url is written without
target and sorts first. Payloads shorter than ``least_bytes`` are always
responses. Rows that repeat an id are all written, and each is a response if its
id is the smallest of its payload. A null id is written without record id and
date, as a response, and sorts first. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored

LEAST_BYTES = 0
#: Bytes of a file of records, about: a file has as many records of its size class (powers of 16) as surely fit, one at least.
FILE_BYTES = 32 << 20
#: Bytes of a record's headers beside its url, at most.
HEAD_BYTES = 1 << 10
#: Index entries of a merged range, about, and sampled keys for each range's bound.
RANGE_ROWS, SAMPLE_KEYS = 20_000, 20
#: Hexadecimal and base32 digits, of which five and four hold the same 20 bits.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = "2024-01-01"
CRLF = "\r\n"


def url_key(url: str | None) -> str:
    """The host's labels turned round, then path and query: ``com,example)/a?b``."""
    m = re.match(r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    if not m:
        return ""
    labels = m[1].lower().split(".")
    return ",".join(reversed(labels[1:] if labels[0] == "www" else labels)) + ")" + (m[2] or "/")


def digest(payload: Column) -> Column:
    """The base32 SHA-1 of a text's UTF-8 bytes."""
    sha = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]), DIGITS, BASE32)


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, digest); html is not null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return own.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), digest(F.col("html")).alias("digest"))


def revisits(captures: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, first): the pages whose payload one with a smaller id has. ``captures``: stored (page_id, payload_bytes, digest)."""
    # stored before the join, so that Spark can split a payload that a large share of all pages has
    first = stored(captures.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    return captures.where(F.col("payload_bytes") >= least_bytes).join(first, "digest").where(F.col("page_id") != F.col("first")).select("page_id", "digest", "first").distinct()


def size_class(n: Column) -> Column:
    """The number of hexadecimal digits of a size in bytes."""
    return F.length(F.hex(n))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """WARC files under ``path``, in a folder for each class of size."""
    p = payloads(pages).withColumn("size", size_class(F.col("payload_bytes") + F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES))
    captures = stored(p.select("page_id", "payload_bytes", "digest", "size"), "captures")
    refers = stored(revisits(captures, least_bytes), "refers")
    sizes = sorted(r["size"] for r in captures.select("size").distinct().collect())  # sixteen at most
    for size in sizes or [1]:
        _write(p.where(F.col("size") == size).join(refers, ["page_id", "digest"], "left"), f"{path}/size={size}", max(1, file_bytes >> (4 * size)))


def _write(rows: DataFrame, path: str, file_records: int) -> None:
    revisit = F.col("first").isNotNull()
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(f"{EPOCH} 00:00:00")) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: <urn:page:"), "page_id", F.lit(">")),
        F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), F.concat(F.lit("WARC-Refers-To: <urn:page:"), "first", F.lit(">")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    record = F.concat(head, F.lit(CRLF * 2), block)
    # the separator that the writer puts after each row is the one that ends a WARC record
    rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", file_records).text(path)


HEADER = re.compile(rb"^([^:\r\n]+): ?([^\r\n]*)\r\n", re.M)


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        head = {k.decode(): v.decode() for k, v in HEADER.findall(content, at, end)}
        to = end + int(head["Content-Length"])
        if content[to : to + 4] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield at, to + 4 - at, head, content[end:to]
        at = to + 4


ENTRY = "url_key string, ts string, page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, offset long, bytes long, checked boolean"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def _entry(at: int, n: int, head: dict[str, str], block: bytes) -> dict:
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    number = lambda k: int(head[k].removeprefix("<urn:page:")[:-1]) if k in head else None
    ok = kind == "revisit" or len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    return dict(zip(NAMES, (url_key(head.get("WARC-Target-URI")), head.get("WARC-Date", ""), number("WARC-Record-ID"), head.get("WARC-Target-URI"), kind, digest, size, number("WARC-Refers-To"), at, n, ok), strict=True))


def order(entry: dict) -> str:
    """The sort key of an entry: URL key, timestamp, id."""
    page = entry["page_id"]
    return "\x00".join((entry["url_key"], entry["ts"], "" if page is None else str(page).rjust(20, "0")))


def runs(spark, path: str) -> DataFrame:
    """A row for each file: its entries, sorted by URL key, timestamp and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                found = sorted((_entry(*r) for r in records(content.as_py())), key=order)
                yield pa.RecordBatch.from_pylist([{"file": name.rsplit("/", 1)[-1], "entries": found}], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"file string, entries array<struct<{', '.join(':'.join(c.split()) for c in ENTRY.split(', '))}>>"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, ddl)


def merge(sources: list[Iterator[tuple]]) -> Iterator[tuple]:
    """A k-way merge by a loser tree: each inner node holds the source that lost there, node 0 the winner."""
    k = len(sources)
    if not k:
        return
    heads = [next(s, None) for s in sources]
    less = lambda a, b: heads[b] is None or heads[a] is not None and (heads[a], a) <= (heads[b], b)
    tree = [-1] * k

    def climb(source: int) -> None:
        node, winner = (source + k) // 2, source
        while node:
            if tree[node] < 0:  # while the tree is being built the first to come waits here
                tree[node] = winner
                return
            if less(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for s in range(k):
        climb(s)
    while heads[tree[0]] is not None:
        w = tree[0]
        yield heads[w]
        heads[w] = next(sources[w], None)
        climb(w)


def index(spark, path: str) -> DataFrame:
    """All captures of the archives under ``path``: ``range`` and ``place`` give the global order."""
    found = stored(runs(spark, path), "runs")
    keys = found.select(F.explode("entries").alias("e")).select(F.concat_ws("\x00", "e.url_key", "e.ts", F.coalesce(F.lpad(F.col("e.page_id").cast("string"), 20, "0"), F.lit(""))).alias("k"))
    n = keys.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    # a few keys for each range, whatever the number of ranges: 1 in RANGE_ROWS / SAMPLE_KEYS of all
    sample = sorted(r["k"] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(RANGE_ROWS // SAMPLE_KEYS)) == 0).collect()) if ranges > 1 else []
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, entries in zip(b["file"].to_pylist(), b["entries"].to_pylist(), strict=True):
                places = [0, *(bisect.bisect_left(entries, x, key=order) for x in bounds), len(entries)]
                rows = [{"range": i, "file": file, "entries": entries[x:y]} for i, (x, y) in enumerate(zip(places, places[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([pa.field("range", pa.int64()), *b.schema]))

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        sources = [((order(e), file, tuple(e[c] for c in NAMES)) for e in entries) for file, entries in zip(part["file"], part["entries"], strict=True)]
        rows = [(int(part["range"].iloc[0]), i, file, *e) for i, (_, file, e) in enumerate(merge(sources))]
        out = pd.DataFrame(rows, columns=["range", "place", "file", *NAMES])
        return out.assign(refers_to=out["refers_to"].astype("Int64"))

    ddl = f"range long, file string, entries {found.schema['entries'].dataType.simpleString()}"
    slices = found.mapInArrow(cut, ddl)
    return slices.groupBy("range").applyInPandas(merged, f"range long, place long, file string, {ENTRY}")


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = index(spark, path)
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url_key", "ts", "checked")


SQL = rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, array_to_string([substr('{BASE32}', 1 + CAST(
  (('0x' || substr(sha, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INT), 1) for k in range(32)], '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest),
u AS (SELECT d.*, first, regexp_extract(coalesce(url, ''), '^[^:/?#]*://([^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)', 2) AS h,
  regexp_extract(coalesce(url, ''), '^[^:/?#]*://([^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)', 4) AS rest, regexp_matches(coalesce(url, ''), '^[^:/?#]*://') AS is_url FROM d JOIN f USING (payload_digest)),
l AS (SELECT *, string_split(lower(h), '.') AS s FROM u)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CAST(CASE WHEN page_id > first THEN first END AS BIGINT) AS refers_to,
  CASE WHEN is_url THEN array_to_string(list_reverse(CASE WHEN s[1] = 'www' THEN s[2:] ELSE s END), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END ELSE '' END AS url_key,
  strftime(TIMESTAMP '{EPOCH} 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS ts, true AS checked
FROM l
"""
