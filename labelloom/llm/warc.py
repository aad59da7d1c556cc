"""WARC archives by way of a chunked record table.

A payload is never copied as a whole: it goes through tasks as rows of
(record id, chunk number) with at most ``CHUNK`` bytes each, and every row
carries the SHA-1 of the payload up to its end.  In the archive each chunk is a
record of its own, as WARC's segmentation has it: the first is the response,
the others are its continuations.

Archives are written and read by Spark's text source, whose line separator is
the empty line that ends a record, so any store that Spark reaches will do.
Files are compressed and hence read by one task in order; each has what one
task wrote.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import materialize, text_of

CHUNK = 1 << 20
SEND = 4 << 20                # bytes of chunks sent to Spark at once
BROADCAST_ROWS = 1 << 20      # repeated payloads broadcast at most: about 60 MB
DATE = "1970-01-01T00:00:00Z"  # of capture, unless the caller gives a column
SEPARATOR = b"\r\n\r\n"
_RECORD = "<urn:page:"

CHUNK_SCHEMA = ("page_id string, url string, captured string, payload_bytes long, payload_digest string, "
                "refers_to string, chunk int, last boolean, running_digest string, bytes binary")
READ_SCHEMA = ("page_id string, url string, record_type string, refers_to string, payload_bytes long, "
               "payload_digest string, chunk int, last boolean, running_digest string, bytes binary")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: twenty bits are five hexadecimal and four base 32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, captured, payload) with digests and ``refers_to``.

    Of equal payloads of at least ``min_bytes`` the one with the smallest page id
    is the response, the others refer to it.  Payloads are equal if their
    SHA-256 is.  The groups with repeats are broadcast if few, else joined by a
    shuffle in which Spark splits large groups.
    """
    rows = pages.withColumn("equal", F.unhex(F.sha2("payload", 256)))
    groups = materialize(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("equal")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
        .select("equal", "first"), "warc-repeats")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    return rows.join(groups, "equal", "left").select(
        "page_id", "url", "captured", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"), "payload")


def _digest(state) -> str:
    return b32encode(state.digest()).decode()


def _send(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _arrow(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return [c[0] for c in columns], [kinds[c[1]] for c in columns]


def _batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SEND`` bytes of chunks."""
    names, types = _arrow(schema)
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += len(row[-1]) + 200
        if size >= SEND:
            yield _send(waiting, names, types)
            waiting, size = [], 0
    if waiting:
        yield _send(waiting, names, types)


def chunk_table(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: ``CHUNK_SCHEMA``, chunks of a record in order.

    A revisit has one chunk without bytes.
    """
    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, captured, size, digest, refers = (c[i].as_py() for c in batch.columns[:6])
                payload = memoryview(batch.columns[6][i].as_buffer()) if refers is None else memoryview(b"")
                state = hashlib.sha1()
                for number, start in enumerate(range(0, max(1, len(payload)), chunk)):
                    part = payload[start:start + chunk]
                    state.update(part)
                    yield (page, url, captured, size, digest, refers, number, start + chunk >= len(payload),
                           _digest(state), bytes(part))

    texts = marked.select(F.col("page_id").cast("string"), "url", "captured", "payload_bytes", "payload_digest",
                          F.col("refers_to").cast("string"), "payload")
    return texts.mapInArrow(lambda batches: _batched(rows(batches), CHUNK_SCHEMA), CHUNK_SCHEMA)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit(_RECORD), F.coalesce(F.url_encode(page), F.lit("")), F.lit(">"))


def warc_records(chunks: DataFrame) -> DataFrame:
    """(value): one WARC record, without its closing empty line, for each chunk."""
    first, revisit = F.col("chunk") == 0, F.col("refers_to").isNotNull()
    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                  F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))).otherwise("")
    block = F.concat(F.encode(http, "UTF-8"), F.col("bytes"))

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return F.coalesce(F.when(F.lit(True) if when is None else when, text), F.lit(""))

    own = F.when(first, _record_id(F.col("page_id"))).otherwise(
        F.concat(F.lit("<urn:page-part:"), F.coalesce(F.url_encode("page_id"), F.lit("")), F.lit(":"),
                 F.col("chunk").cast("string"), F.lit(">")))
    segmented = ~(first & F.col("last"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", own), line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20"), first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), first),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block))),
        line("WARC-Refers-To", _record_id(F.col("refers_to").cast("string")), revisit),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"), segmented),
        line("WARC-Segment-Origin-ID", _record_id(F.col("page_id")), ~first),
        line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"), ~first & F.col("last")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return chunks.select(F.concat(F.encode(head, "UTF-8"), block).cast("string").alias("value"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, chunk: int = CHUNK, id_col: str = "page_id",
                  url_col: str = "url", payload: Column | None = None, captured: Column | None = None) -> None:
    """Write one record per row of ``pages``, with continuations for long ones.

    Null payloads are empty.  A null id makes a record that no revisit can
    refer to; if a group of equal payloads has no id at all, all its rows are
    responses.  Rows that repeat the id of a group's first are responses like
    it.  Null urls have no target line; control characters and blanks in them
    become %20.  Other columns are ignored; no rows make an empty archive.
    """
    payload = F.encode(text_of("html"), "UTF-8") if payload is None else F.coalesce(payload, F.lit(b""))
    captured = F.lit(DATE) if captured is None else captured
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        captured.alias("captured"), payload.alias("payload"))
    records = warc_records(chunk_table(mark_revisits(rows, min_bytes), chunk))
    records.write.option("lineSep", SEPARATOR.decode()).option("compression", "gzip").text(path)


class _Reader:
    """Reads records from fragments of an archive, holding one fragment at a time."""

    def __init__(self) -> None:
        self.buffer, self.left, self.state = b"", 0, "head"
        self.head: dict[str, str] = {}
        self.record: tuple = ()
        self.sha1, self.size, self.declared, self.number = hashlib.sha1(), 0, 0, 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while True:
            if self.state == "head":
                # If the last block ends with a line's end, its separator was split and is given anew.
                self.buffer = self.buffer.lstrip(b"\r\n")
            if self.state in ("head", "http"):
                end = self.buffer.find(SEPARATOR)
                if end < 0:
                    return
                taken, self.buffer = self.buffer[:end], self.buffer[end + 4:]
                if self.state == "head":
                    self._begin(taken.decode("utf-8", "replace"))
                else:
                    self.left -= end + 4
                    self.declared = int(_fields(taken.decode("latin-1"))["content-length"])
                    self.state = "block"
            elif self.state == "block":
                taken, self.buffer = self.buffer[:self.left], self.buffer[self.left:]
                self.left -= len(taken)
                self.sha1.update(taken)
                self.size += len(taken)
                if taken or not self.left:
                    yield self._row(taken)
                if self.left:
                    return
                self.state = "tail"
            else:
                if len(self.buffer) < 4:
                    return
                if self.buffer[:4] != SEPARATOR:
                    raise ValueError(f"record {self.record} does not end with an empty line")
                self.buffer, self.state = self.buffer[4:], "head"

    def _begin(self, text: str) -> None:
        if not text.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {text[:80]!r}")
        self.head = _fields(text)
        self.left = int(self.head["content-length"])
        if self.head["warc-type"] == "continuation":
            self.state = "block"
            return
        self.record = (_page(self.head["warc-record-id"]), self.head.get("warc-target-uri"), self.head["warc-type"],
                       _page(self.head["warc-refers-to"]) if "warc-refers-to" in self.head else None)
        self.sha1, self.size, self.number, self.state = hashlib.sha1(), 0, 0, "http"

    def _row(self, taken: bytes) -> tuple:
        revisit = self.record[2] == "revisit"
        whole = not self.left and (revisit or self.size == self.declared)
        running = _digest(self.sha1)
        given = self.head.get("warc-payload-digest", "")[5:] if revisit else running
        row = (*self.record, self.declared if revisit else self.size, given, self.number, whole, running, taken)
        self.number += 1
        return row


def _fields(text: str) -> dict[str, str]:
    lines = (line.partition(":") for line in text.split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def _page(record_id: str) -> str | None:
    return unquote_plus(record_id.removeprefix(_RECORD).removesuffix(">")) or None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of an archive: ``READ_SCHEMA``.

    ``payload_bytes`` and ``payload_digest`` hold for the payload up to the
    chunk's end, so those of the row marked ``last`` are the whole payload's;
    a revisit has the response's, as its record states them.
    """
    def rows(batches) -> Iterator[tuple]:
        reader = _Reader()
        for batch in batches:
            for value in batch.column(0):
                yield from reader.feed(value.as_py() + SEPARATOR)
        if reader.state != "head" or reader.buffer:
            raise ValueError("the archive ends within a record")

    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(lambda batches: _batched(rows(batches), READ_SCHEMA), READ_SCHEMA)
