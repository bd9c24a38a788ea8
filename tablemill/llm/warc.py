"""WARC archives of pages, and the index of their captures.

Archives are written by Spark's text writer (a record ends with two line breaks, which is the writer's separator), so they reach
any store that Spark reaches and survive lost executors. Reading them back gives one sorted run of index entries per archive; the
runs are cut into ranges of (URL key, timestamp), and each range is merged from its pieces of all runs by a loser tree.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import scratch_path, staged

SMALLEST_REVISIT = 100  # payload bytes
RECORDS_PER_ARCHIVE = 8_192
ENTRIES_PER_RANGE = 200_000
FIRST_CAPTURE = 1_577_836_800  # seconds; a page without a capture time gets this plus its id, which starts over at CLOCK
CLOCK = 1 << 32
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "run string, place long, url_key string, captured_at string, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, offset long, length long"
)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """One WARC/1.1 record per row of ``pages`` below ``folder``, as HTTP responses with the UTF-8 html as payload (null: empty).

    Of records with equal payloads of at least SMALLEST_REVISIT bytes, the one with the smallest id is a response and the others are
    revisits without payload; rows that repeat the smallest id are responses each, and so are rows whose payload only rows without id
    hold. A null url is written as urn:unknown; white space and control characters in a url are percent-encoded. Other columns are not written.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    # only payloads that occur again need a first holder; while those are few, Spark joins them without moving the payloads
    firsts = rows.where(F.col("bytes") >= SMALLEST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    rows = rows.join(staged(firsts.where("times > 1").select("digest", "first")), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    target = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), r"[\x00-\x20\x7f]", "%20")
    seconds = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CLOCK)))
    when = F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(folder)
    return folder


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, no scheme, port, www or fragment."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.lower()).partition("#")[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r":\d+$", "", host.rpartition("@")[2]).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def read_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, block) of each record, by the stated lengths."""
    view, at = memoryview(content), 0
    while at < len(content):
        head_end = content.index(END, at)
        version, *lines = content[at:head_end].decode("utf-8").split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = head_end + len(END)
        stop = start + int(headers["Content-Length"])
        if content[stop : stop + len(END)] != END:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, stop - at, headers, view[start:stop]
        at = stop + len(END)


def _page(reference: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", reference or "")
    return int(found[1]) if found else None


def _entries(name: str, content: bytes) -> list[tuple]:
    """The archive's index entries, sorted. A payload that does not match its digest is an error."""
    rows = []
    for offset, length, headers, block in read_records(content):
        head, _, _ = bytes(block[:1024]).partition(END)
        stated = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if headers["WARC-Type"] == "response":
            payload = block[len(head) + len(END) :]
            if len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} in {name} is not what was written")
        url = headers["WARC-Target-URI"]
        rows.append((url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, headers["WARC-Type"], stated, digest, _page(headers.get("WARC-Refers-To")), offset, length))
    rows.sort(key=_order)
    return rows


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    types = [pa.int64() if c.split(" ")[1] == "long" else pa.string() for c in INDEX.split(", ")]
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            run = name.as_py().rpartition("/")[2]
            rows = _entries(run, content.as_py())
            columns = list(zip(*[(run, i, *row) for i, row in enumerate(rows)])) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so the next smallest takes one walk from leaf to root."""

    def __init__(self, runs: list[list], key):
        self.key = key
        self.sources = [iter(run) for run in runs]
        self.heads: list = [None] * len(runs)
        for i in range(len(runs)):
            self._next(i)
        self.losers = [-1] * max(len(runs), 1)
        self.winner = self._play(1) if runs else -1

    def _next(self, i: int) -> None:
        row = next(self.sources[i], None)
        self.heads[i] = None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        return self.heads[b] is None or (self.heads[a] is not None and self.heads[a][:2] < self.heads[b][:2])

    def _play(self, node: int) -> int:
        """The winner below a node; leaves are the nodes from k on."""
        k = len(self.heads)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self._next(i)
            node = (i + len(self.heads)) // 2
            while node >= 1:
                if self._beats(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            pieces.setdefault(row[0], []).append(row)
    if schema is None:
        return
    for rows in pieces.values():
        rows.sort(key=lambda row: row[1])  # a run's piece may come in several blocks
    ordered = list(LoserTree([pieces[run] for run in sorted(pieces)], lambda row: _order(row[2:])))
    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*ordered), schema)], schema=schema)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives below ``folder``, in order of URL key, timestamp and id over all partitions: run (archive), url_key,
    captured_at, page_id, url, record_type, payload_bytes, payload_digest, refers_to, offset and length of the record."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    runs = staged(files.mapInArrow(_runs, INDEX))
    ranges = max(1, math.ceil(runs.count() / ENTRIES_PER_RANGE))
    return runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "run", "place").mapInArrow(_merge, INDEX).drop("place")


def archive_pages(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives and read their index back; an empty table gives an empty index."""
    spark = pages.sparkSession
    return read_index(spark, write_archives(pages, folder or scratch_path(spark, "warc"), **columns))
