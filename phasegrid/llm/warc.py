"""WARC archives of web pages, and their capture index by external merging.

Writing: equal payloads are found by digest; one capture is the response, the
others are revisits that name it. Records are lines of a text file whose line
separator is the blank line that ends a record, so Spark's own writer makes the
archives in any store it knows, and a lost task leaves no half-written one.

Reading: each archive is parsed into captures, sorted by URL key and time: a
run. Runs are written, dealt to ranges of (key, time, id), and each range is
merged by a loser tree over its runs; range after range, that is the captures
of all archives in one order. A key with very many captures lies in several
ranges, so no task holds all of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.session import scratch_path

from .common import store

BLANK = "\r\n\r\n"
RECORDS_PER_FILE = 5_000
RANGE_ROWS = 100_000
#: the time of a page without one is this many seconds plus its id since 1970
FIRST_SECOND = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32 (upper case), by expressions: ten hex digits are eight of base 32."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            date: Column | None = None) -> DataFrame:
    """(value): one WARC record per row of ``pages``, as text without its final blank line.

    Of equal payloads of at least ``least_bytes`` bytes, the rows with the largest
    id are responses and the others revisit that id; smaller payloads are all
    responses. A null page is an empty payload. A null id is below any other;
    where a payload has none but null ids, all are responses. A null URL gives a
    record without one; line breaks in a URL are percent-encoded.
    """
    seconds = F.unix_timestamp(date) if date is not None else F.lit(FIRST_SECOND) + F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), seconds.alias("seconds"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    latest = rows.groupBy("digest").agg(F.max("id").alias("latest"))
    rows = rows.join(latest, "digest")
    revisit = (F.col("size") >= least_bytes) & F.col("latest").isNotNull() & ~F.col("id").eqNullSafe(F.col("latest"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(BLANK))
    page = lambda c: F.concat(F.lit(f"<{_PAGE}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    rows = rows.withColumn("revisit", revisit).withColumn("block", F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), page(F.col("id")),
        F.lit("\r\nWARC-Date: "), F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), page(F.col("latest")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(BLANK))
    return rows.select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, folder: str, **options) -> None:
    """Gzip archives of at most RECORDS_PER_FILE records below ``folder``; ``options`` as in ``records``."""
    writer = records(pages, **options).write.option("lineSep", BLANK).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, named fields, block) of each record of an uncompressed archive; a damaged one raises."""
    at, blank = 0, BLANK.encode()
    while at < len(data):
        end = data.find(blank, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(named["content-length"])
        if data[stop:stop + 4] != blank:
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, stop + 4 - at, named, data[end + 4:stop]
        at = stop + 4


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower case: captures of a site and of a page lie side by side."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.split(".")))
    port = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{port}){parts.path or '/'}{query}".lower()


_CAPTURE = ("run string, url_key string, date string, page_id bigint, url string, record_type string, refers_to bigint, "
            "payload_digest string, payload_bytes bigint, offset bigint, length bigint")
_CAPTURE_ARROW = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split() for x in _CAPTURE.split(", "))])


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(_PAGE)
    return int(name) if name not in ("", "null") else None


def _captures(path: str, data: bytes) -> list[dict]:
    out = []
    for offset, length, named, block in parse(data):
        head, _, payload = block.partition(BLANK.encode())
        kind = named["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        digest = named["warc-payload-digest"].removeprefix("sha1:")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != size:
                raise ValueError(f"{path}: the payload at {offset} is not the one that was written")
        url = named.get("warc-target-uri")
        out.append({"run": path, "url_key": url_key(url), "date": named["warc-date"], "page_id": _page_of(named["warc-record-id"]), "url": url,
                    "record_type": kind, "refers_to": _page_of(named.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size,
                    "offset": offset, "length": length})
    return out


def _order(c: dict) -> tuple:
    return c["url_key"], c["date"], -1 if c["page_id"] is None else c["page_id"], c["run"], c["offset"]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of every archive below ``folder``; those of one archive are one sorted run."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = _captures(batch["path"][i].as_py(), gzip.decompress(batch["content"][i].as_buffer()))
                if found:
                    yield pa.RecordBatch.from_pylist(sorted(found, key=_order), schema=_CAPTURE_ARROW)

    return files.mapInArrow(run, _CAPTURE)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so a step replays one path."""

    def __init__(self, sources: list[list[tuple]]):
        self.sources, self.at, self.k = sources, [0] * len(sources), len(sources)
        self.loser = [-1] * self.k
        for s in range(self.k - 1, -1, -1):
            self._replay(s)

    def _beats(self, a: int, b: int) -> bool:
        """-1 is a place not yet played for, which beats all; an exhausted source loses to all."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.sources[a], self.sources[b]
        if self.at[a] >= len(x) or self.at[b] >= len(y):
            return self.at[b] >= len(y)
        return x[self.at[a]] <= y[self.at[b]]

    def _replay(self, s: int) -> None:
        node = (s + self.k) // 2
        while node:
            if self._beats(self.loser[node], s):
                self.loser[node], s = s, self.loser[node]
            node //= 2
        self.loser[0] = s

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            s = self.loser[0]
            if s < 0 or self.at[s] >= len(self.sources[s]):
                return
            yield self.sources[s][self.at[s]]
            self.at[s] += 1
            self._replay(s)


def merged(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures with (range, place): in that order they are sorted by URL key, time and id over all runs."""
    captures = store(captures, "runs")
    ranges = max(1, -(-captures.count() // range_rows))
    dealt = captures.repartitionByRange(ranges, "url_key", "date", "page_id")
    schema = pa.schema([*_CAPTURE_ARROW, ("range", pa.int64()), ("place", pa.int64())])

    def run(batches):
        number, parts = TaskContext.get().partitionId(), {}
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                parts.setdefault(row["run"], []).append((*_order(row), len(held)))
                held.append(row)
        for part in parts.values():
            # a range's part of a run arrives in the run's order unless a fetch was repeated
            if any(a > b for a, b in zip(part, part[1:])):
                part.sort()
        out, place = [], 0
        for key in LoserTree(list(parts.values())):
            out.append(held[key[-1]] | {"range": number, "place": place})
            place += 1
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.mapInArrow(run, f"{_CAPTURE}, range bigint, place bigint")


def index(pages: DataFrame, least_bytes: int = 0, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and merge the captures.

    One row per row of ``pages``, repeated rows included; an empty table gives none.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder, least_bytes=least_bytes, **options)
    return merged(runs(spark, folder))
