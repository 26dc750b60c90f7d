"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata
record; request and metadata name the response in WARC-Concurrent-To.  Spark's text
writer puts the records into gzip files, each ended by the two line ends that close a
record, so tasks commit their files as any Spark output.  The reader takes the files
as binary rows and cuts them by Content-Length, whatever the payloads contain.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import Scratch

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 1000
#: Records of one archive file, three for a page, at most; files end sooner where a partition ends.
RECORDS_PER_FILE = 30_000
#: Repeated payloads that are broadcast at most; more of them meet the pages in a shuffle.
BROADCAST_DIGESTS = 200_000
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ_BYTES = 1 << 20
_ROWS = 512


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of one record without the two line ends that close it."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n")]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END)))
    return F.concat(*lines, block)


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a capture for each row of ``pages`` to gzip files under ``path``.

    A null payload is empty, a null URL empty too; line ends in a URL become blanks.
    Of captures with equal payloads (by SHA-1 and length) of ``LEAST_REVISIT_BYTES``
    or more, those with the largest id are responses and the others revisits of it;
    rows that repeat id and payload are written each, under the same record id.  Null
    ids come after all others.  No row gives no record.  Only the columns named are
    read, whatever others there are.

    A file holds the records of one partition, and adaptive execution cuts partitions
    by bytes (spark.sql.adaptive.advisoryPartitionSizeInBytes): a file passes that size
    only for a single longer payload, of which writer and reader hold a few copies.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    base = pages.select(
        F.col(id_col).alias("id"),
        F.translate(F.coalesce(F.col(url_col), F.lit("")), "\r\n", "  ").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    repeated = scratch.table(
        base.where(F.col("bytes") >= LEAST_REVISIT_BYTES)
        .groupBy("sha1", "bytes")
        .agg(F.count("*").alias("copies"), F.max("id").alias("first_id"))
        .where("copies > 1")
        .drop("copies"),
        "repeated",
    )
    few = repeated.count() <= BROADCAST_DIGESTS
    known = base.join(F.broadcast(repeated) if few else repeated, ["sha1", "bytes"], "left").hint("rebalance")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    main_id, first = _record_id("main", F.col("id"), F.col("sha1")), _record_id("main", F.col("first_id"), F.col("sha1"))
    target = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))]
    http_type = [("Content-Type", F.lit("application/http;msgtype=response"))]
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    own = [("WARC-Record-ID", main_id), *target, *digest, *http_type]
    response = _record("response", own, F.concat(head, F.col("payload")))
    again = _record("revisit", [*own, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", first)], head)
    beside = [("WARC-Concurrent-To", main_id)]
    request = _record(
        "request",
        [("WARC-Record-ID", _record_id("request", F.col("id"), F.col("sha1"))), *target, *beside, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + END)),
    )
    fields = F.concat(F.coalesce(F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: table\r\n"))
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _record_id("metadata", F.col("id"), F.col("sha1"))), *target, *beside, ("Content-Type", F.lit("application/warc-fields"))],
        fields,
    )
    records = known.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    writer = records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    scratch.drop(repeated)


RECORD_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("declared_digest", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("fields", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class _Unpacked(io.RawIOBase):
    """Bytes of a file that is gzip, of one member or many, or plain; unpacked a piece at a time."""

    def __init__(self, content: bytes):
        self.rest = memoryview(content)
        self.packed = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while len(self.rest):
            if not self.packed:
                out, self.rest = self.rest[: len(into)], self.rest[len(into) :]
            else:
                out = self.inflate.decompress(self.rest, len(into))
                self.rest = memoryview(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            if len(out):
                into[: len(out)] = out
                return len(out)
        return 0


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.partition(b":")
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def read_records(content: bytes, with_payload: bool) -> Iterator[dict]:
    """Records of one archive file."""
    stream = io.BufferedReader(_Unpacked(content), _READ_BYTES)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        head = _headers(lines)
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        kind = head.get("warc-type")
        declared = head.get("warc-payload-digest")
        row = {
            "type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "declared_digest": declared and declared.removeprefix("sha1:").lower(),
            "payload_digest": None, "payload_bytes": None, "fields": None, "payload": None,
        }
        if kind in ("response", "revisit", "request"):
            http, _, payload = block.partition(b"\r\n\r\n")
            row["fields"] = http.decode("utf-8", "replace")
            if kind == "response":
                row |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
                row["payload"] = payload if with_payload else None
            elif kind == "revisit":
                length = _headers(http.split(b"\r\n")[1:]).get("content-length")
                row |= {"payload_digest": row["declared_digest"], "payload_bytes": int(length) if length else None}
        else:
            row["fields"] = block.decode("utf-8", "replace")
        yield row


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archive files under ``path``, one row each; see ``RECORD_SCHEMA``."""
    schema = to_arrow_schema(RECORD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in read_records(content.as_py(), with_payload):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) == _ROWS or held > _READ_BYTES * 4:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """One nested row for each response or revisit: id, response, request, metadata, refers_to_id.

    Request and metadata are those that name it in WARC-Concurrent-To, null where none
    does; of several the one with the least record id.  id is the ``id`` field of the
    metadata, refers_to_id that of the response that a revisit refers to; both are cast
    to ``id_type``.  Records of other types and without a partner are left out.
    """
    kind = (id_type or T.LongType()).simpleString()
    whole = ("type", "record_id", "refers_to", "target_uri", "date", "fields", "payload_digest", "payload_bytes", "payload")
    main = records.where(F.col("type").isin("response", "revisit")).select(F.struct(*whole).alias("response"))
    part = F.struct("record_id", "target_uri", "date", "fields")
    beside = (
        records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
        .groupBy("concurrent_to")
        .agg(
            F.min(F.when(F.col("type") == "request", part)).alias("request"),
            F.min(F.when(F.col("type") == "metadata", part)).alias("metadata"),
        )
    )
    ident = F.nullif(F.regexp_extract("metadata.fields", r"(?m)^id: ([^\r\n]*)", 1), F.lit("")).cast(kind)
    joined = main.join(beside, F.col("response.record_id") == F.col("concurrent_to"), "left").select(
        ident.alias("id"), "response", "request", "metadata"
    )
    referred = records.where("refers_to is not null").select("refers_to").distinct()
    named = (
        joined.where("response.type = 'response'")
        .select(F.col("response.record_id").alias("rid"), F.col("id").alias("refers_to_id"))
        .join(referred, F.col("rid") == F.col("refers_to"), "left_semi")
        .groupBy("rid").agg(F.max("refers_to_id").alias("refers_to_id"))
    )
    return joined.join(named, F.col("response.refers_to") == F.col("rid"), "left").drop("rid")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and assemble the captures.

    See :func:`write_warc` and :func:`assemble` for nulls, repeats and very long payloads;
    an empty table gives no capture.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_warc(pages, path, id_col, url_col, payload_col)
    records = scratch.table(read_warc(pages.sparkSession, path, with_payload), "records")
    scratch.delete(path)
    return assemble(records, pages.schema[id_col].dataType)
