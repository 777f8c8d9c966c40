"""WARC as a content-addressed archive.

An archive is two Parquet tables in one folder: `payloads` holds each distinct payload once under its
SHA-256 (compressed bytes, length), `records` holds the exact header bytes of every record and the
digest of its payload.  Of records with equal payloads of at least LEAST bytes that with the
smallest page_id is a response, the others are revisits that refer to it.  Reading joins records to
payloads on the digest and rebuilds every record's exact bytes; a payload counts only after its bytes
were unpacked and hashed again.

The digest group of a hot payload is pre-aggregated before the shuffle (one row a task); the records
that join to it are the large side of that join and have one partner each, so adaptive skew joins
split them.

Defined cases: null html is the empty payload; null urls leave out WARC-Target-URI, and a url
with blanks or line ends is percent-encoded there and kept exactly in X-Target-URL-Base64; rows with a null page_id are written as responses without a page header,
like rows whose page_id is the smallest of their payload (repeated rows are all responses); an empty
table gives an empty archive; further columns of the pages are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir

LEAST = 100
LEVEL = 9
#: The tables hold no capture time; one fixed date keeps archives reproducible.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOADS = "payload_digest string, n_bytes long, least_page_id long, packed binary"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


@dataclass(frozen=True)
class Archive:
    """Paths of an archive's tables."""

    path: str

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PAYLOADS).parquet(f"{self.path}/payloads")

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("header binary, payload_digest string").parquet(f"{self.path}/records")


def payload(html: str = "html") -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def packed_pages(pages: DataFrame) -> DataFrame:
    """page_id, digest, length and compressed bytes of every payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            data = [v.as_py() or b"" for v in batch.column(1)]
            columns = [pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array([len(d) for d in data], pa.int64()), batch.column(0), pa.array([pack(d) for d in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["payload_digest", "n_bytes", "least_page_id", "packed"])

    return pages.select("page_id", payload().alias("payload")).mapInArrow(run, PAYLOADS)


def uri() -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")


def record_id(page_id: Column) -> Column:
    """A name-based id that only depends on the page's number."""
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")).cast("binary"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line; null if the value is."""
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def headers(pages: DataFrame) -> Column:
    """Exact header bytes of a record: WARC header, blank line, and the block's HTTP header."""
    http = F.concat(F.lit(HTTP), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n_bytes"))
    lines = [
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri()),
        F.when(F.col("url") != uri(), line("X-Target-URL-Base64", F.regexp_replace(F.base64(F.col("url").cast("binary")), "[\r\n]", ""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("least_page_id"))), line("X-Refers-To-Page-ID", F.col("least_page_id").cast("string")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
    ]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"), http).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None) -> Archive:
    """Archive page_id, url and html of all pages."""
    spark = pages.sparkSession
    archive = Archive(path or f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}")
    stored = packed_pages(pages).groupBy("payload_digest").agg(F.min("n_bytes").alias("n_bytes"), F.min("least_page_id").alias("least_page_id"), F.first("packed").alias("packed"), F.max("n_bytes").alias("most"))
    same = F.when(F.col("most") == F.col("n_bytes"), F.col("n_bytes")).otherwise(F.raise_error(F.lit("payloads of one digest differ")).cast("long"))
    stored.select("payload_digest", same.alias("n_bytes"), "least_page_id", "packed").write.parquet(f"{archive.path}/payloads")
    narrow = pages.select("page_id", "url", F.sha2(payload(), 256).alias("payload_digest"))
    known = archive.payloads(spark).select("payload_digest", "n_bytes", "least_page_id")
    joined = narrow.join(known, "payload_digest")
    marked = joined.withColumn("revisit", F.coalesce((F.col("n_bytes") >= LEAST) & (F.col("page_id") != F.col("least_page_id")), F.lit(False)))
    marked.select(headers(marked).alias("header"), "payload_digest").write.parquet(f"{archive.path}/records")
    return archive


def field(name: str) -> Column:
    """A field of the WARC header, null without it; the header ends at the first blank line."""
    head = F.split_part(F.col("header").cast("string"), F.lit("\r\n\r\n"), F.lit(1))
    value = F.regexp_extract(head, f"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(head.rlike(f"(?:^|\r\n){name}: "), value)


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, header, record (its exact bytes in a WARC file) and payload (in full, for revisits too): each
    record joined to its payload, which is unpacked and must hash to its name."""
    stored = archive.payloads(spark).select("payload_digest", "packed")
    joined = archive.records(spark).join(stored.hint("merge"), "payload_digest").select("payload_digest", "header", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                (names, heads), records, payloads = (c.to_pylist() for c in part.columns[:2]), [], []
                for name, head, data in zip(names, heads, part.column(2).to_pylist()):
                    body = unpack(data) if data else b""
                    if hashlib.sha256(body).hexdigest() != name:
                        raise ValueError(f"payload {name} is damaged")
                    payloads.append(body)
                    revisit = b"\r\nWARC-Type: revisit\r\n" in head.partition(b"\r\n\r\n")[0] + b"\r\n"
                    records.append(head + (b"" if revisit else body) + b"\r\n\r\n")
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(records, pa.binary()), pa.array(payloads, pa.binary())], names=["header", "record", "payload"])

    rebuilt = joined.mapInArrow(run, "header binary, record binary, payload binary")
    return rebuilt.select(field("X-Page-ID").cast("long").alias("page_id"), "header", "record", "payload")


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Of every record as it is rebuilt: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    rebuilt = reconstruct(spark, archive)
    exact = F.decode(F.unbase64(field("X-Target-URL-Base64")), "UTF-8")
    return rebuilt.select(
        "page_id",
        F.coalesce(exact, field("WARC-Target-URI")).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )
