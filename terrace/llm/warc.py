"""WARC archives of pages, and a globally ordered index of what they hold.

Pages become WARC 1.1 records: of equal payloads one is stored and the others are revisits
that refer to it. Archives are gzip files of a bounded number of records, written and read by
Spark. The captures of one archive, sorted by URL key and time, are a run; runs are cut at
common key ranges, and each range merges its slices with a k-way loser tree.

Payload groups are counted in each map task first, only payloads that repeat are joined
back, and the join is salted, so that a payload that a third of all pages share is spread.
A NULL html is empty; a NULL page_id stays NULL and is never referred to; of repeated rows with
the largest id each is a response; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Batches, batch, folder, put

SALTS = 16
RECORDS_PER_ARCHIVE = 1000
RECORD_ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string,"
    " refers_to bigint, url_key string, captured_at string, archive string, position bigint"
)


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, captured (seconds), refers_to (NULL for a response).

    ``pages`` may give ``captured_at``; otherwise the page's number stands for its second.
    """
    seconds = F.col("captured_at") if "captured_at" in pages.columns else F.timestamp_seconds(
        F.coalesce(F.col("page_id"), F.lit(0)).cast("bigint")
    )
    whole = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
        F.unix_seconds(seconds.cast("timestamp")).alias("captured"),
    ).withColumn("digest", F.sha1("payload"))
    repeated = (
        whole.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    repeated = put(repeated).select("digest", "largest", salts.alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    joined = whole.withColumn("salt", salt).join(repeated, ["digest", "salt"], "left")
    other = F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest"))
    return joined.select("page_id", "url", "payload", "captured", other.alias("refers_to"))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, captured: int, refers_to) -> bytes:
    """One record without its last line break."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    body = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') or 'about:blank'}",
        f"WARC-Date: {datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Record-ID: <{RECORD_ID}{name}>",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n"


def write_archives(roles: DataFrame, path: str) -> None:
    """Gzip archives of at most ``RECORDS_PER_ARCHIVE`` records in the folder."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = zip(*(b[n].to_pylist() for n in b.schema.names))
            yield batch(value=pa.array([record(*row) for row in rows], pa.binary()))

    records = roles.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    (
        records.write.option("lineSep", "\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE)
        .text(path)
    )


def url_key(url: str) -> str:
    """Host parts in reverse, then path and query: neighbours of a site sort together."""
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:  # not a readable address: it is its own key
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


def read_records(archive: bytes):
    """(position, headers, block) of every record of an unpacked archive."""
    at = 0
    while at < len(archive):
        head_end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        yield at, headers, archive[start:end]
        at = end + 4


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(RECORD_ID)
    return int(number) if number else None


def capture(position: int, headers: dict, block: bytes) -> tuple:
    """One row of the index without its archive; the digest of stored payloads is computed."""
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    stored = headers["WARC-Type"] == "response"
    return (
        _page(headers["WARC-Record-ID"]),
        len(payload) if stored else int(fields["Content-Length"]),
        payload_digest(payload) if stored else headers["WARC-Payload-Digest"][len("sha1:") :],
        headers["WARC-Type"],
        _page(headers.get("WARC-Refers-To")),
        url_key(headers["WARC-Target-URI"]),
        headers["WARC-Date"],
        position,
    )


def order(row: tuple) -> tuple:
    """URL key, time, page; NULL pages first."""
    return row[5], row[6], row[0] is not None, row[0] or 0, row[7], row[8]


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    kinds += [pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in INDEX.split(", ")]
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names)


def runs(spark, path: str) -> DataFrame:
    """The captures of every archive, each archive's in order."""

    def read(batches: Batches) -> Batches:
        for b in batches:
            for name, packed in zip(b["path"].to_pylist(), b["content"]):
                archive = zlib.decompress(packed.as_py(), wbits=31)
                found = [capture(*r) for r in read_records(archive)]
                short = name.rsplit("/", 1)[-1]
                rows = sorted(((*r[:7], short, r[7]) for r in found), key=order)
                if rows:
                    yield _columns(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, INDEX)


class LoserTree:
    """Merges k sorted lists: each inner node holds the loser of its match, so that the next
    winner needs one comparison per level on a single path."""

    def __init__(self, lists: list[list], key):
        self.lists = [iter(x) for x in lists]
        self.key, self.k = key, len(lists)
        self.rows: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: the list has ended
        for i in range(self.k):
            self._advance(i)
        self.losers = [0] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _advance(self, i: int) -> None:
        self.rows[i] = next(self.lists[i], None)
        self.keys[i] = None if self.rows[i] is None else self.key(self.rows[i])

    def _first(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return self.keys[a] <= self.keys[b]

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (left, right) if self._first(left, right) else (right, left)
        return winner

    def __iter__(self):
        while self.k and self.keys[self.winner] is not None:
            best = self.winner
            yield self.rows[best]
            self._advance(best)
            node = (best + self.k) // 2
            while node:
                if self._first(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def merge_runs(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """One index in the order of URL key, time and page over all its partitions."""
    keys = ["url_key", "captured_at", "page_id", "archive", "position"]
    cut = captures.repartitionByRange(*([partitions] if partitions else []), *keys)

    def merge(batches: Batches) -> Batches:
        slices: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                slices.setdefault(row[7], []).append(row)
        for rows in slices.values():
            rows.sort(key=order)  # nearly sorted: slices come in pieces
        merged, ready = LoserTree(list(slices.values()), order), []
        for row in merged:
            ready.append(row)
            if len(ready) == 10_000:
                yield _columns(ready)
                ready = []
        if ready:
            yield _columns(ready)

    return cut.mapInArrow(merge, INDEX)


def archive_index(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives of the pages, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = folder(spark, "warc")
    write_archives(with_roles(pages, min_bytes), path)
    return merge_runs(put(runs(spark, path)))
