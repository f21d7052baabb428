"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256, which is computed again and compared when
they are read. The exact header block of each record is stored apart, with the address of its
payload. A join of the two gives every original record back, byte by byte.

Defined results
  null payload            an empty payload
  null or repeated id     each row has its own record; equal rows get equal records
  equal payloads          the record with the smallest id is ``response``, the others
                          ``revisit`` it, if the payload has ``min_revisit_bytes`` or more
  ties for smallest id    all rows with that id and payload are ``response``
  empty table             an empty archive
  a very long payload     is one value of a row, so it must fit a task
  more columns            are ignored, whatever their names
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources import opened
from . import storage

CRLF = "\r\n"
# Digits of base 32 as Java writes them, and as RFC 4648 does.
JAVA_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def records(self) -> str:
        return f"{self.path}/records"


def base32_sha1(data: Column) -> Column:
    """SHA-1 of binary data in base 32: four times 40 bits are 8 digits each."""
    digest = F.sha1(data)
    parts = [F.lpad(F.translate(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), JAVA_DIGITS, RFC_DIGITS), 8, "A") for i in range(4)]
    return F.concat(*parts)


def _source(pages: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return (
        pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(uri_col), F.lit("")), r"[\r\n]", "").alias("uri"), payload.alias("payload"))
        .withColumn("address", F.unhex(F.sha2("payload", 256)))
    )


def _header(date: str) -> Column:
    """The header block, up to and with the empty line, of a record."""
    # With the digest, rows that repeat an id have records of different names, unless their payloads are equal.
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(":"), F.col("sha1"), F.lit(">"))
    http = F.when(F.col("record_type") == "response", F.length("http")).otherwise(F.lit(0))
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(F.col("first_id")))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (http + stored).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> Archive:
    """Write one record per row. Payloads are dealt once by digest and id; only the first of each kind is stored."""
    spark, archive = pages.sparkSession, Archive(path)
    rows = _source(pages, id_col, uri_col, payload_col)
    # The id as a key that is never null: the join then deals rows by what the distinct needs, too.
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    first = rows.groupBy("address").agg(F.min("id").alias("id")).select("address", key.alias("key"))
    keep = rows.select("address", key.alias("key"), "id", "payload").join(first, ["address", "key"]).dropDuplicates(["address", "key"])
    keep.select("address", F.col("id").alias("first_id"), "payload", base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("payload_bytes")).write.option(
        "compression", "zstd"
    ).parquet(archive.payloads)

    known = spark.read.parquet(archive.payloads).select("address", "first_id", "sha1", "payload_bytes")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    records = rows.select("id", "uri", "address").join(known, "address").withColumn("http", http).withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    records = records.withColumn("header", _header(date)).withColumn("http", F.when(F.col("record_type") == "response", F.col("http")).otherwise(F.lit("")))
    records.select("address", "header", "http").write.option("compression", "zstd").parquet(archive.records)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record: the fields of its header, its payload, and its exact bytes.

    A payload whose digest is not its address ends the job with an error.
    """
    stored = spark.read.parquet(archive.payloads).select("address", "payload")
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.length("payload").cast("long")).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")).cast("long"))
    stored = stored.select("address", "payload", checked.alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    field = lambda name: F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    number = lambda text: F.regexp_extract(text, r"^<urn:page:(-?\d+):\w+>$", 1).try_cast("long")
    records = spark.read.parquet(archive.records).join(stored, "address")
    kept = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select(
        number(field("WARC-Record-ID")).alias("id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("uri"),
        number(field("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract("header", r"(?m)^WARC-Payload-Digest: sha1:(\w+)", 1).alias("stated_digest"),
        "payload_digest",
        "payload_bytes",
        "header",
        "http",
        "payload",
        F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), kept, F.lit(b"\r\n\r\n")).alias("record"),
    )


@dataclass
class _Written(WriterCommitMessage):
    part: str
    records: int


class _FileWriter(DataSourceWriter):
    """A file a task, under a name of its own until all tasks have ended."""

    def __init__(self, path: str, overwrite: bool):
        self.folder, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        store, folder = opened.at(self.folder)
        # Made here alone: what a task still writes after the job was given up has no place to go.
        store.create_dir(f"{folder}/.{self.job}", recursive=True)

    def write(self, rows: Iterator[Row]) -> _Written:
        store, folder = opened.at(self.folder)
        part, n = f"{folder}/.{self.job}/{uuid.uuid4().hex}", 0
        with store.open_output_stream(part, compression=None) as out:
            for row in rows:
                out.write(gzip.compress(bytes(row.record), 6, mtime=0))
                n += 1
        return _Written(part, n)

    def commit(self, messages: list) -> None:
        store, folder = opened.at(self.folder)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File and f.base_name.endswith(".warc.gz"):
                    store.delete_file(f.path)
        for k, m in enumerate(m for m in messages if m is not None and m.records):
            store.move(m.part, f"{folder}/part-{k:05d}-{self.job}.warc.gz")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, folder = opened.at(self.folder)
        if store.get_file_info(f"{folder}/.{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/.{self.job}")


class WarcFiles(DataSource):
    """A sink for records (column ``record``, bytes): ``.warc.gz`` files in which each record is a gzip member of its own, so it can be read alone.

    A job that fails leaves nothing; mode ``overwrite`` replaces the folder's files when the new ones are whole.
    """

    @classmethod
    def name(cls) -> str:
        return "warcfiles"

    def schema(self) -> str:
        return "record binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], overwrite)


def export_warc(records: DataFrame, path: str) -> None:
    """Write records, byte for byte, as ``.warc.gz`` files."""
    records.sparkSession.dataSource.register(WarcFiles)
    records.select("record").write.format("warcfiles").mode("append").save(path)


def content(header: Column, http: Column, record: Column, record_type: Column, payload: Column) -> Column:
    """What a record is about: of a response, its own bytes between HTTP header and the final line ends; of a revisit, the payload that it refers to."""
    before = F.octet_length(header) + F.octet_length(http)
    return F.when(record_type == "response", F.substring(record, before + 1, F.octet_length(record) - before - 4)).otherwise(payload)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = write_archive(pages, storage.new_path(spark, "warc"), min_revisit_bytes=0)
    got = read_archive(spark, archive).withColumn("content", content(*[F.col(c) for c in ("header", "http", "record", "record_type", "payload")]))
    got = got.select("id", "record_type", "refers_to", "stated_digest", F.octet_length("content").cast("long").alias("payload_bytes"), base32_sha1(F.col("content")).alias("digest"))
    same = F.when(F.col("stated_digest") == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.lit("a header states another digest")).cast("string"))
    return got.select(F.col("id").alias("page_id"), "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")
