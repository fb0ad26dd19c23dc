"""WARC revisit resolution on whole archives.

Archives are written by Spark's text sink with the blank lines behind a
record as line separator, one gzip member for each file, and read by its
binary-file source; a task parses its files record by record.  Resolution
shuffles only the headers: the greatest page id of each payload digest is
its original (a pre-aggregated maximum), and the headers join it (a digest
with very many pages is split by the skew join).  The payloads of originals
alone then meet their new headers; revisits carry none.

Null html is an empty payload; a null url gives no target line, and control
characters in a url are dropped.  A null page id is never an original
unless its payload has no other.  Rows that repeat an original's page id
are responses too.  An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import exact, scratch, stored, text_column

CRLF = "\r\n"
DATE = "2025-01-01T00:00:00Z"
#: payloads of fewer bytes are not looked up (0: all are)
MIN_BYTES = 0
RECORDS_PER_FILE = 4000
_BATCH_BYTES = 8 << 20


def record_id(page_id: Column) -> Column:
    """A record id that depends on the page id only."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4),
                    F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def record(kind: Column, page_id: Column, uri: Column, payload: Column, payload_bytes: Column, digest: Column | None = None,
           original: Column | None = None, original_uri: Column | None = None) -> Column:
    """The text of a record up to the blank lines behind it."""
    clean = lambda u: F.regexp_replace(u, r"[\x00-\x20\x7F]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    payload_bytes.cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, payload)
    refers = F.lit("")
    if original is not None:
        refers = F.when(kind == "revisit", F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
            _line("WARC-Refers-To", record_id(original)), _line("WARC-Refers-To-Target-URI", clean(original_uri)),
            _line("WARC-Refers-To-Date", F.lit(DATE)), _line("X-Refers-To-Page", original))).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id(page_id)), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", clean(uri)), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)) if digest is not None else F.lit(""),
        refers, _line("X-Page-Id", page_id), F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archive(records: DataFrame, path: str) -> None:
    """Writes the column ``value`` as gzip WARC files."""
    records.select("value").write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", "gzip") \
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def write_responses(pages: DataFrame, path: str) -> None:
    """One response record for every row of (page_id, url, html)."""
    pages = exact(pages, "page_id", "url", "html")
    html = text_column(pages, "html")
    write_archive(pages.select(record(F.lit("response"), F.col("page_id"), F.col("url"), html, F.octet_length(html)).alias("value")), path)


class _Stream:
    """Reads a gzip byte string of any number of members bit by bit."""

    def __init__(self, data: bytes):
        self.data, self.at, self.out, self.z = memoryview(data), 0, bytearray(), zlib.decompressobj(31)

    def fill(self, n: int) -> bool:
        while len(self.out) < n:
            if self.z.eof:
                rest = self.z.unused_data
                self.at -= len(rest)
                self.z = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return False
            self.out += self.z.decompress(self.data[self.at:self.at + (1 << 20)])
            self.at += 1 << 20
            if self.z.eof:
                self.at = min(self.at, len(self.data))
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("the archive ends within a record")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def head(self) -> dict[str, str] | None:
        """The next record's header lines; None at the end."""
        n = 1024
        while (end := self.out.find(b"\r\n\r\n")) < 0:
            if not self.fill(n) and self.out.find(b"\r\n\r\n") < 0:
                if self.out.strip():
                    raise ValueError("the archive ends within a header")
                return None
            n = max(n, len(self.out)) + 1024
        lines = self.take(end + 4).decode().strip().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        return dict(x.split(": ", 1) for x in lines[1:])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header lines, payload, payload length as the HTTP header has it) of each record."""
    s = _Stream(data)
    while (h := s.head()) is not None:
        block = s.take(int(h["Content-Length"]))
        cut = block.index(b"\r\n\r\n") + 4
        length = int(block[:cut].split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
        if s.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield h, block[cut:], length


def _inflated(column: str) -> Column:
    @F.pandas_udf("string")
    def run(packed: pd.Series) -> pd.Series:
        return packed.map(lambda b: zlib.decompress(b).decode())
    return run(column)


def read_archive(spark: SparkSession, path: str, with_payload: bool = False, packed: bool = False) -> DataFrame:
    """One row per record: page_id, record_type, uri, payload_bytes, payload_digest, refers_to[, payload].

    Digest and length are those of the payload read; a revisit's are taken
    from its header.  ``packed``: the payload as a deflated binary, for
    shuffles.
    """
    schema = "page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long"
    names = ["page_id", "record_type", "uri", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] \
        + [pa.binary() if packed else pa.string()] * with_payload

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                for h, payload, length in records_of(b.column(0)[k].as_py()):
                    number = lambda x: int(h[x]) if x in h else None  # noqa: E731, B023
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if h["WARC-Type"] == "revisit":
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    row = (number("X-Page-Id"), h["WARC-Type"], h.get("WARC-Target-URI"), length, digest, number("X-Refers-To-Page"))
                    rows.append(row + (zlib.compress(payload, 1) if packed else payload.decode(),) if with_payload else row)
                    size += len(payload) * with_payload + 200
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary") \
        .format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema + (", payload binary" if packed else ", payload string") * with_payload)


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Sets record_type, refers_to and original_uri of (page_id, uri, payload_bytes, payload_digest)."""
    originals = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "uri")).alias("original"))
    joined = headers.drop("record_type", "refers_to").join(originals, "payload_digest", "left")
    again = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(again, F.col("original.page_id"))) \
        .withColumn("original_uri", F.when(again, F.col("original.uri"))).drop("original")


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Reads the archive at ``source`` and writes the deduplicated one, with fresh headers, to ``target``."""
    headers = stored(read_archive(spark, source), "warc-headers")
    decided = stored(resolve(headers, min_bytes), "warc-decided")
    col = F.col
    fresh = lambda payload: record(col("record_type"), col("page_id"), col("uri"), payload, col("payload_bytes"),
                                   col("payload_digest"), col("refers_to"), col("original_uri")).alias("value")
    # of equal rows (an id that repeats) each has its record; their payloads are equal too
    kept = decided.filter("record_type = 'response'").groupBy("page_id", "payload_digest").agg(
        F.first("uri", ignorenulls=True).alias("uri"), F.max("payload_bytes").alias("payload_bytes"), F.first("record_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("original_uri"))
    bodies = read_archive(spark, source, with_payload=True, packed=True).select(
        col("page_id").alias("_id"), col("payload_digest").alias("_digest"), "payload")
    responses = bodies.join(kept, col("_id").eqNullSafe(col("page_id")) & (col("_digest") == col("payload_digest")))
    revisits = decided.filter("record_type = 'revisit'").select(fresh(F.lit("")))
    responses = responses.withColumn("payload", _inflated("payload"))
    write_archive(responses.select(fresh(col("payload"))).unionByName(revisits), target)


def resolved_archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes, deduplicates and reads back: one row per page, and the archive's path in no column."""
    spark = pages.sparkSession
    raw, out = scratch(spark, "warc-raw"), scratch(spark, "warc-dedup")
    write_responses(pages, raw)
    deduplicate(spark, raw, out, min_bytes)
    return read_archive(spark, out)


def oracle_sql() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INTEGER + 1, 1)"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages)
      , d AS (SELECT page_id, strlen(t) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k:
                array_to_string(list_transform(range(0, 4), lambda j: {digit}), '')), '') AS payload_digest FROM p)
      , o AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id IS DISTINCT FROM original THEN original END AS refers_to
    FROM d LEFT JOIN o USING (payload_digest)"""
