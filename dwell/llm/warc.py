"""WARC archives with an external merge of their capture index (operator 5).

Archives are written by Spark's text writer, one record per row: the separator of two
records is the separator the format asks for.  Reading them back yields captures.  Every
task sorts its captures in runs of bounded size and stores them as blocks; boundaries
taken from the blocks cut all runs into key ranges, and each range is merged from its
runs by a loser tree.  The ranges in order are the captures by URL key and time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwell.llm.texts import hash_number, sample_share
from dwell.sources.storage import fresh_folder

SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Smaller payloads are always stored again.
REVISIT_BYTES = 100
FILE_RECORDS = 4000
# Captures of a run that a task sorts at a time, of a block, and of a merged range.
RUN, BLOCK, RANGE = 50_000, 1_000, 100_000
# Keys the driver looks at to choose the ranges.
SAMPLE = 4096
EPOCH = 1_700_000_000

CAPTURE = (
    "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, url string, file string, offset long, length long"
)
_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]
_NO_ID = -(1 << 63)


# ---- writing -------------------------------------------------------------------------

def _date(seconds: Column) -> Column:
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, folder: str, seconds: Column | None = None) -> None:
    """Write a record per row of ``pages`` (page_id, url, html; a null html is empty).

    Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the
    smallest page id is a response and the others revisit it; rows without an id or with
    the id of the response are responses too.  ``seconds`` is the time of capture, by
    default counted up from the page id.  The files are compressed; offsets of the index
    count uncompressed bytes.
    """
    seconds = F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)) if seconds is None else seconds
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        _date(seconds).alias("date"), body.alias("body"),
        F.octet_length(body).cast("long").alias("size"), F.sha2(body.cast("binary"), 256).alias("digest"),
    )
    firsts = (
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy(F.col("digest").alias("first_digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    )
    # A digest that a third of the pages share is split by the skew-join rule: the other
    # side has one row for it.
    joined = rows.join(firsts, rows.digest == firsts.first_digest, "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(SEPARATOR)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")

    def urn(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">\r\n"))

    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("WARC-Date: "), "date", F.lit("\r\n"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha256:"), "digest", F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn("first"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(SEPARATOR),
    )
    joined.select(F.concat(head, block).alias("value")).write.option("lineSep", SEPARATOR).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", FILE_RECORDS).text(folder)


# ---- reading -------------------------------------------------------------------------

_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*:")


@lru_cache(maxsize=10_000)
def _host_key(host: str) -> str:
    return ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))


def url_key(url: str | None) -> str:
    """The sort form of a URL: host labels in reverse, then path and query in lower case."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url if _SCHEME.match(url.lower()) else f"http://{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    at = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else ""
    return f"{_host_key(host)}{at}){(parts.path or '/').lower()}{query}"


def _number(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield at, stop + 4 - at, head, data[start:stop]
        at = stop + 4


def captures_of(file: str, data: bytes) -> Iterator[tuple]:
    """The capture of every record; the digest of a stored payload is verified."""
    for offset, length, head, block in records(data):
        cut = block.index(b"\r\n\r\n") + 4
        size = int(re.search(rb"Content-Length: (\d+)", block[:cut])[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "response" and hashlib.sha256(block[cut:]).hexdigest() != digest:
            raise ValueError(f"{file}: the payload at byte {offset} does not match its digest")
        url = head.get("WARC-Target-URI")
        page = _number(head["WARC-Record-ID"])
        yield (
            url_key(url), head["WARC-Date"], _NO_ID if page is None else page, size, digest,
            head["WARC-Type"], _number(head.get("WARC-Refers-To")), url, file, offset, length,
        )


def _columns(captures: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in CAPTURE.split(", ")]
    return [pa.array(list(c), k) for c, k in zip(zip(*captures), kinds)] if captures else [pa.array([], k) for k in kinds]


def write_runs(spark: SparkSession, archives: str, folder: str) -> None:
    """Read archives and store their captures as sorted runs, cut into blocks.

    The rows of a block carry its run and number; a file is one task's content at most.
    """
    files = spark.read.text(archives, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("data")
    )

    def run(batches):
        run_no, held = 0, []

        def sort_out():
            nonlocal run_no, held
            held.sort(key=lambda c: c[:3])
            for block, at in enumerate(range(0, len(held), BLOCK)):
                some = held[at:at + BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [*_columns(some), pa.array([first] * len(some)), pa.array([run_no] * len(some), pa.int32()),
                     pa.array([block] * len(some), pa.int32()), pa.array(range(len(some)), pa.int32())],
                    names=[*_NAMES, "run_file", "run", "block", "at"],
                )
            run_no, held = run_no + 1, []

        first = None
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                first = first or file
                for capture in captures_of(file, batch.column(1)[i].as_py()):
                    held.append(capture)
                    if len(held) >= RUN:
                        yield from sort_out()
        if held:
            yield from sort_out()

    files.mapInArrow(run, _RUNS).write.parquet(folder)


_RUNS = CAPTURE + ", run_file string, run int, block int, at int"


# ---- merging -------------------------------------------------------------------------

class LoserTree:
    """Merges sorted sequences: every inner node keeps the loser of its match."""

    def __init__(self, runs: list[list[tuple]], key):
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.size
        for leaf in range(self.size):
            self._first_match(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; equal keys go by the number of the run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _first_match(self, leaf: int) -> None:
        """Enter a leaf while the tree fills: it waits at the first empty node."""
        winner, node = leaf, (leaf + self.size) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            head = self.heads[winner] = next(self.runs[winner], None)
            self.keys[winner] = None if head is None else self.key(head)
            node = (winner + self.size) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def merge_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All captures in one global order of URL key, time and page id.

    ``range`` and ``place`` number the order; rows come sorted by both.  Ranges end at
    keys with time and page id, so a URL captured very often spans several of them.
    """
    runs = spark.read.schema(_RUNS).parquet(folder)
    order = ["urlkey", "captured", "page_id"]
    total = runs.count()
    count = max(1, -(-total // RANGE))
    bounds: list[tuple] = []
    if count > 1:
        # A bounded sample; it only decides where ranges end.
        near = runs.select(*order, hash_number(*order).alias("h")).where(F.col("h") < sample_share(SAMPLE, total))
        keys = near.orderBy("h", *order).limit(SAMPLE).select(*order).collect()
        keys = sorted(tuple(k) for k in keys)
        bounds = sorted({keys[len(keys) * i // count] for i in range(1, count)} if keys else set())

    def number(batches):
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            found = pa.array([bisect_left(bounds, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "range"])

    ranged = runs.mapInArrow(number, _RUNS + ", range int")
    parts = min(len(bounds) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranged.repartitionByRange(parts, "range").sortWithinPartitions("range", "run_file", "run", "block", "at")
    width = len(_NAMES)

    def merge(batches):
        current, run_key, held = None, None, []

        def merged():
            rows = list(LoserTree(held, lambda c: c[:3]))
            for at in range(0, len(rows), 10_000):
                some = [(*r[:2], None if r[2] == _NO_ID else r[2], *r[3:]) for r in rows[at:at + 10_000]]
                yield pa.RecordBatch.from_arrays(
                    [*_columns(some), pa.array([current] * len(some), pa.int32()),
                     pa.array(range(at, at + len(some)), pa.int64())],
                    names=[*_NAMES, "range", "place"],
                )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[-1] != current:
                    if held:
                        yield from merged()
                    current, run_key, held = row[-1], None, []
                if row[width:width + 2] != run_key:
                    run_key = row[width:width + 2]
                    held.append([])
                held[-1].append(row[:width])
        if held:
            yield from merged()

    return dealt.mapInArrow(merge, CAPTURE + ", range int, place long")


def capture_history(pages: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Archive pages, read the archives back and return their captures in global order.

    One row per page row, repeated rows included; an empty table gives none.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    write_archives(pages, f"{folder}/archives", seconds)
    write_runs(spark, f"{folder}/archives", f"{folder}/runs")
    return merge_runs(spark, f"{folder}/runs")
