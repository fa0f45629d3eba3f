"""Content-addressed WARC archive: payloads once by digest, record headers apart."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, pinned

#: Fixed values of the record format.
VERSION = "WARC/1.1"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are stored as responses even if they are equal to others.
LEAST_REVISIT = 0
LAST = (1 << 63) - 1
#: Bytes of payload and number of records of a WARC file: a file is read as one row.
FILE_BYTES, FILE_RECORDS = 1 << 24, 20_000


def _base32(digest: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal; 160 bits need no padding."""

    @F.pandas_udf("string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hexes in batches:
            yield hexes.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())

    return encode(digest)


def write_archive(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str = DATE) -> None:
    """Write a record per row of (page_id, url, html) below ``path``.

    ``payloads`` holds every different payload once, by SHA-256 with its SHA-1 and
    length; ``records`` holds a header block per page, exactly as it stands in a
    WARC file, and the digest of its payload. Of equal payloads of at least
    ``least`` bytes the smallest page id is the response, the others revisit it.

    Only digests and ids are grouped, with partial sums in every task, and written
    before they meet the pages again, so a payload with a third of all pages is
    split by skew handling. The payload itself crosses a shuffle once per digest.

    * Null html: empty payload. Null url: empty target; line ends in it: percent-encoded. Null page id: after all
      others; its revisits refer to null.
    * Repeated page ids with the same payload: each is the response.
    * Empty table: an empty archive. Other columns are not stored.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id",
        _rank().alias("rank_"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.sha2(body, 256).alias("sha256"),
        F.sha1(body).alias("sha1"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    rows.write.parquet(f"{path}/digests")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/digests")
    firsts = rows.groupBy("sha256").agg(F.min("rank_").alias("rank_"), F.count("*").alias("pages"))
    firsts.write.parquet(f"{path}/firsts")
    firsts = spark.read.schema(firsts.schema).parquet(f"{path}/firsts")

    first = firsts.select("sha256", F.nullif("rank_", F.lit(LAST)).alias("first_id"))
    known = rows.join(first, "sha256")
    revisits = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisits, REVISIT).otherwise(RESPONSE)
    known = known.withColumn("kind", kind).withColumn("payload_digest", _base32(F.col("sha1")))
    known.select("page_id", "sha256", header_block(date).alias("header")).write.parquet(f"{path}/records")

    # the first page of a digest brings its bytes; pages equal in id and payload are one row here
    bodies = pages.select(_rank().alias("rank_"), body.alias("payload"))
    bodies = bodies.withColumn("sha256", F.sha2("payload", 256))
    bearers = bodies.join(firsts, ["sha256", "rank_"], "left_semi").dropDuplicates(["sha256", "rank_"])
    bearers.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _rank() -> Column:
    """Page id for the order among equal payloads: null after all others."""
    return F.coalesce(F.col("page_id").cast("long"), F.lit(LAST))


def header_block(date: str = DATE) -> Column:
    """The header lines of a record, up to and with the empty line.

    A revisit carries no payload; a response carries all of it.
    """
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    length = F.when(F.col("kind") == REVISIT, F.lit(0)).otherwise(F.col("bytes"))
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.concat(
        F.lit("WARC-Refers-To: <urn:page:"),
        F.coalesce(F.col("first_id").cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"),
    )
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("kind"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\n"), F.when(F.col("kind") == REVISIT, refers).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"),
        F.lit("\r\n\r\n"),
    )


def _field(name: str, group: str = "(.*)") -> Column:
    value = F.regexp_extract("header", rf"(?md)^{name}: {group}\r$", 1)
    return F.when(value != "", value)


def _header_fields() -> list[Column]:
    """Page id, target, declared length and digest, type and reference from ``header``."""
    name = lambda field: F.nullif(_field(field, "<urn:page:(.*)>"), F.lit("none")).cast("long")
    return [
        name("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("X-Payload-Length").cast("long").alias("payload_bytes"),
        _field("WARC-Payload-Digest", "sha1:(.*)").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        name("WARC-Refers-To").alias("refers_to"),
    ]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, from their headers: (page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, sha256, header)."""
    return spark.read.parquet(f"{path}/records").select(*_header_fields(), "sha256", "header")


def restore_records(spark: SparkSession, path: str, payload_of_revisits: bool = False) -> DataFrame:
    """Original records through a join by digest: (page_id, header, payload, record).

    ``record`` is the header block, the payload and the two closing line ends.
    With ``payload_of_revisits`` a revisit's ``payload`` is that of its response;
    its ``record`` stays without.
    """
    records = read_records(spark, path)
    payloads = spark.read.parquet(f"{path}/payloads")
    if not payload_of_revisits:
        records = records.withColumn("wanted_", F.when(F.col("record_type") == RESPONSE, F.col("sha256")))
        joined = records.join(payloads.withColumnRenamed("sha256", "wanted_"), "wanted_", "left")
    else:
        joined = records.join(payloads, "sha256", "left")
    empty = F.lit(b"").cast("binary")
    payload = F.coalesce(F.col("payload"), empty)
    held = F.when(F.col("record_type") == RESPONSE, payload).otherwise(empty)
    return joined.select(
        "page_id", "header", payload.alias("payload"),
        F.concat(F.col("header").cast("binary"), held, F.lit(b"\r\n\r\n").cast("binary")).alias("record"),
    )


def verify_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, stored_bytes, payload_digest, intact) of every stored payload, from its bytes."""
    payloads = spark.read.parquet(f"{path}/payloads")
    return payloads.select(
        "sha256",
        F.octet_length("payload").cast("long").alias("stored_bytes"),
        _base32(F.sha1("payload")).alias("stored_digest"),
        (F.sha2("payload", 256) == F.col("sha256")).alias("intact"),
    )


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per page from the WARC files below ``path``, as they were read back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to, verified).

    Length and digest are taken from payloads found in the files: a response's from its
    own, a revisit's from those of the responses with the digest it names. ``verified``
    says that they are what the header declares, and that a revisit refers to the response
    with the smallest page id. Only narrow rows are written and joined; a digest with a
    third of all pages is split on the left side.

    * A revisit whose response is missing: its declared values, not verified.
    * Empty archive: no rows. Page id or reference ``none``: null.
    """
    with few_rows(spark, 1):
        found = read_warc(spark, path).select(
            *_header_fields(),
            F.octet_length("payload").cast("long").alias("held_bytes"),
            F.sha1("payload").alias("held_sha1"),
        )
        found = pinned(found, "warc-records")
    held = found.filter(F.col("record_type") == RESPONSE)
    held = held.groupBy("held_sha1", "held_bytes").agg(F.min("page_id").alias("bearer"))
    held = held.select(_base32(F.col("held_sha1")).alias("payload_digest"), "held_bytes", "bearer")
    held = pinned(held, "warc-payloads")
    own = found.filter(F.col("record_type") == RESPONSE).select(
        "page_id", F.col("held_bytes").alias("payload_bytes"), _base32(F.col("held_sha1")).alias("held_digest"),
        F.col("payload_digest").alias("declared"), "record_type", "refers_to", F.col("payload_bytes").alias("told"),
    )
    responses = own.select(
        "page_id", "payload_bytes", F.col("held_digest").alias("payload_digest"), "record_type", "refers_to",
        F.coalesce((F.col("held_digest") == F.col("declared")) & (F.col("payload_bytes") == F.col("told")), F.lit(False)).alias("verified"),
    )
    again = found.filter(F.col("record_type") == REVISIT).drop("held_bytes", "held_sha1")
    sound = F.col("held_bytes").eqNullSafe(F.col("payload_bytes")) & F.col("bearer").eqNullSafe(F.col("refers_to"))
    revisits = again.join(held, "payload_digest", "left").select(
        "page_id", F.coalesce("held_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to", sound.alias("verified"),
    )
    return responses.unionByName(revisits)


def write_warc(spark: SparkSession, path: str, target: str, file_bytes: int = FILE_BYTES) -> None:
    """WARC files of an archive: gzip, each of about ``file_bytes`` bytes before that.

    A record ends with two line ends, which are the separator of Spark's text writer, so
    header and payload are one row. Responses meet their payloads by digest in as many
    tasks as there are files; revisits carry none and go out without a join.

    * Empty archive: a folder without records. An existing ``target`` raises.
    """
    records = read_records(spark, path)
    payloads = spark.read.parquet(f"{path}/payloads")
    size = payloads.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0
    files = 1 + size // file_bytes
    whole = records.filter(F.col("record_type") == RESPONSE).select("sha256", "header").repartition(files, "sha256")
    whole = whole.join(payloads.repartition(files, "sha256"), "sha256")
    whole = whole.select(F.concat("header", F.col("payload").cast("string")).alias("value"))
    rest = records.filter(F.col("record_type") == REVISIT).select(F.col("header").alias("value"))
    rows = whole.union(rest).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    rows.option("maxRecordsPerFile", FILE_RECORDS).text(target)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip, by their declared lengths: (header, payload).

    A file is one row of a task, so files should stay within a task's memory, as those
    of :func:`write_warc` do; its records leave in batches of a few megabytes.
    A file that ends within a record, or a record without a length, raises.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(headers, payloads):
            return pa.record_batch([pa.array(headers, pa.string()), pa.array(payloads, pa.binary())], ["header", "payload"])

        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                at, headers, payloads, held = 0, [], [], 0
                while at < len(data):
                    end = data.find(b"\r\n\r\n", at) + 4
                    header = data[at:end] if end > 3 else b""
                    size = next((int(x[15:]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    if size is None or end + size + 4 > len(data):
                        raise ValueError("a WARC record without length, or cut off")
                    headers.append(header.decode())
                    payloads.append(data[end : end + size])
                    at, held = end + size + 4, held + size
                    if held > 1 << 22:
                        yield told(headers, payloads)
                        headers, payloads, held = [], [], 0
                yield told(headers, payloads)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "header string, payload binary")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
