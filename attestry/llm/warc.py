"""WARC archives: pages written as records, records read back, captures assembled.

A page becomes three records: the request, the response (or a revisit that
names an earlier response with the same payload), and metadata. Request and
metadata name the response record as concurrent. Archives are compressed text
files written by Spark's own writer, so a lost task leaves no half file: a
record is a row, and the blank lines that end a record are the row separator.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.storage import stored
from attestry.session import shared_dir

END = "\r\n\r\n"
#: Records per file; bounds what one reading task decompresses at once, with the longest page.
FILE_RECORDS = 6000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"<urn:page:{kind}:"), number, F.lit(">"))


def record_text(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines and block; a header with a null value is left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *lines), size, block)


def one_line(value: Column) -> Column:
    """Without line breaks, which would end a header."""
    return F.translate(value, "\r\n", "  ")


def write_archive(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> None:
    """Write the records of ``pages`` as compressed archives below ``path``.

    The payload is the page in UTF-8; null is empty. Of the pages with equal payloads of at
    least ``min_bytes`` bytes, the one with the smallest id is a response and the others
    are revisits of it; smaller payloads are all responses. Pages are told apart by id;
    rows that repeat id and payload are responses, or revisits, alike. A null id is written as empty and
    is never another page's original. A null url is left out of the record.
    """
    page = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        one_line(F.col(url_column)).alias("url"),
        F.coalesce(F.col(html_column), F.lit("")).alias("payload"),
    )
    page = page.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn(
        "bytes", F.octet_length("payload").cast("long")
    )
    # Revisits are found by digests alone. The smallest id of a digest is taken task by task before
    # the shuffle; it is stored, so that the join can split the rows of a very common digest.
    digests = stored(page.where(F.col("bytes") >= min_bytes).select("digest", "page_id"), "digests")
    originals = (
        digests.groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "original")
    )
    revisits = (
        digests.join(stored(originals, "originals"), "digest")
        .where("page_id is null or page_id <> original")
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "original")
        .dropDuplicates(["_page", "_digest"])
    )
    marked = page.join(
        revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left"
    )
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("original").isNotNull()
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    target = ("WARC-Target-URI", F.col("url"))
    date = ("WARC-Date", F.lit(DATE))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    request = record_text(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", record_id("request", number)),
            ("WARC-Concurrent-To", record_id("capture", number)),
            target,
            date,
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.lit("GET / HTTP/1.1\r\n\r\n"),
    )
    response = record_text(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", record_id("capture", number)),
            target,
            date,
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, record_id("capture", F.col("original").cast("string")))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(status, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    metadata = record_text(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", record_id("metadata", number)),
            ("WARC-Concurrent-To", record_id("capture", number)),
            target,
            date,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(
            F.lit("page: "), number, F.lit("\r\nfetchedBytes: "), F.col("bytes").cast("string"),
            F.lit("\r\npayloadDigest: "), F.col("digest"), F.lit("\r\n"),
        ),
    )
    # Three records of a page in one row: the separator stands between them too.
    row = F.concat(request, F.lit(END), response, F.lit(END), metadata)
    marked.select(row.alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: ids, links, digest, fields, payload.

    The digest and length are computed from the payload where a record has one, and taken from
    the header (length: null) where it has none. Files are decompressed as a stream; a file that
    ends inside a record raises. An archive without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse_files, RECORDS)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("record_id", pa.string()),
            ("record_type", pa.string()),
            ("target_uri", pa.string()),
            ("concurrent_to", pa.list_(pa.string())),
            ("refers_to", pa.string()),
            ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()),
            ("fields", pa.map_(pa.string(), pa.string())),
            ("payload", pa.binary()),
        ]
    )
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for headers, block in records(content.as_py()):
                row = describe(headers, block)
                rows.append(row)
                held += len(block)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def records(compressed: bytes, step: int = 1 << 20) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of every record of a gzip file of one or more members."""
    inflate, rest, held = zlib.decompressobj(31), compressed, bytearray()
    while rest or held:
        cut = held.find(b"\r\n\r\n")
        need = None
        if cut >= 0:
            lines = bytes(held[:cut]).decode("utf-8").split("\r\n")
            headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])]
            need = cut + 4 + int(next(v for k, v in headers if k.lower() == "content-length"))
        if need is not None and len(held) >= need + 4:
            yield headers, bytes(held[cut + 4 : need])
            del held[: need + 4]
            continue
        if not rest:
            raise ValueError("the archive ends inside a record")
        held += inflate.decompress(rest, step)
        rest = inflate.unconsumed_tail
        if inflate.eof:
            rest = inflate.unused_data
            inflate = zlib.decompressobj(31)


def describe(headers: list[tuple[str, str]], block: bytes) -> dict:
    named = {k.lower(): v for k, v in headers}
    kind = named.get("warc-type")
    digest = named.get("warc-payload-digest", "").partition(":")[2] or None
    fields, payload = {}, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "metadata":
        lines = block.decode("utf-8").splitlines()
        fields = dict((k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines))
    return {
        "record_id": named.get("warc-record-id"),
        "record_type": kind,
        "target_uri": named.get("warc-target-uri"),
        "concurrent_to": [v for k, v in headers if k.lower() == "warc-concurrent-to"],
        "refers_to": named.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": None if payload is None else len(payload),
        "fields": list(fields.items()),
        "payload": payload,
    }


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit with its request and metadata records.

    A request or metadata record belongs to the capture it names as concurrent; a metadata record with a
    ``payloadDigest`` only to captures of that digest, so captures that share an id keep their own. Of several
    requests, or metadata records, of one capture the smallest record id is kept; a capture without one has
    null there; a record that names no capture is left out. Records without the column
    ``payload`` give responses without it: the joins move payloads, whatever is selected afterwards.
    """
    named = records.where("record_type in ('request', 'metadata')").select(
        F.explode("concurrent_to").alias("capture"), "record_type", "record_id", "fields"
    )
    named = named.withColumn("_digest", F.try_element_at("fields", F.lit("payloadDigest")))
    own = F.min(F.struct("record_id", F.map_entries("fields").alias("fields")))
    requests = named.where("record_type = 'request'").groupBy("capture").agg(own.alias("request"))
    metadata = named.where("record_type = 'metadata'")
    general = metadata.where("_digest is null").groupBy("capture").agg(own.alias("_general"))
    special = metadata.where("_digest is not null").groupBy("capture", F.col("_digest").alias("payload_digest")).agg(own.alias("_special"))
    captures = records.where("record_type in ('response', 'revisit')").withColumnRenamed("record_id", "capture")
    captures = captures.join(requests, "capture", "left").join(general, "capture", "left")
    response = ["record_type", "refers_to", "payload_digest", "payload_bytes", *(["payload"] if "payload" in records.columns else [])]
    return captures.join(special, ["capture", "payload_digest"], "left").select(
        "capture",
        "target_uri",
        "request",
        F.struct(*response).alias("response"),
        F.coalesce("_special", "_general").alias("metadata"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = True, **columns: str) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and return its captures, on request without payloads."""
    path = shared_dir(pages.sparkSession, "archive")
    write_archive(pages, path, min_bytes, **columns)
    found = read_archive(pages.sparkSession, path)
    return assemble(found if payloads else found.drop("payload"))
