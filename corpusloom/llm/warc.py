"""WARC archives with revisit resolution.

Headers are shuffled by payload digest, without payloads. Of equal payloads (same SHA-1 and same length)
the one with the smallest id stays a response; the others become revisit records, which name that
response and carry no payload. Then the archives are written, every record with fresh headers.

Archives are written by Spark's text writer with the record separator of the format (CRLF CRLF) as line
separator, so files are committed by task, in any store that Spark writes to, and a lost executor
leaves no half archive. Each is a gzip file of WARC/1.1 records. They are read back as whole files, so a file
holds a bounded number of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, persist_table
from .common import arrow_rows, by_group, numbered, run_of, stored, text_of

CRLF = "\r\n"
END = CRLF + CRLF
FILE_BYTES = 16 << 20   # aimed at, of payloads in one archive
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_BYTES = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"   # fixed value: digest of a revisit's empty block
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = ("page_id long, url string, date string, record_type string, payload_digest string, payload_bytes long,"
           " refers_to long, record_id string, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8: 160 bits are 32 letters of five bits."""
    # conv() takes 64 bits at most, so two halves of 80 bits go in four groups of 20 each
    digest = F.sha1(payload)
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    out = []
    for g in range(8):
        group = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.get(letters, F.shiftright(group, 15 - 5 * k).bitwiseAND(F.lit(31))) for k in range(4)]
    return F.concat(*out)


def headers(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """``__row``, id, digest and length of every payload, without the payloads, stored."""
    rows = numbered(pages, __id=id_col, __url=url_col, __text=text_col)
    return persist_table(rows.select(
        "__row", "__id", base32_sha1(text_of("__text")).alias("__digest"),
        F.octet_length(text_of("__text")).cast("long").alias("__bytes")), "headers")


def resolve_revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``__row``, ``__digest``, ``__bytes``, ``__type`` and, for revisits, ``__refers``: the row and id that stays.

    Payloads shorter than ``least_bytes`` are responses whatever they equal. A null id is larger than others.
    """
    key = ["__digest", "__bytes"]
    who = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    same = by_group(heads.filter(F.col("__bytes") >= least_bytes), key, who).select("__run", *key, "__best")
    rows = heads.withColumn("__run", run_of()).join(same, ["__run", *key], "left")
    revisit = F.coalesce(F.col("__best.row") != F.col("__row"), F.lit(False))
    return rows.select("__row", *key, F.when(revisit, "revisit").otherwise("response").alias("__type"),
                       F.when(revisit, F.col("__best")).alias("__refers"))


def _id(archive: str, row: Column) -> Column:
    """A record id of the archive's path and the row: other archives have other ids, a task run again gives the same."""
    h = F.md5(F.concat(F.lit(f"{archive}:"), row.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _clean(value: Column) -> Column:
    """Header values are one line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\\x00-\\x1F\\x7F]+", " ")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", text_col: str = "html", url_col: str = "url",
                   date: str = "2000-01-01T00:00:00Z", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Write one record per row of ``pages`` under ``path``; equal payloads are written once.

    A null payload counts as empty, a null url as empty; a null id has no ``X-Page-Id``. Repeated rows are records like
    others. Other columns of ``pages`` are not written. An empty table gives archives without records.
    """
    pages = stored(pages, id_col, text_col, url_col)
    heads = headers(pages, id_col, text_col, url_col)
    size = heads.agg(F.count(F.lit(1)), F.sum("__bytes")).first()
    per_file = max(1, int(file_bytes * size[0] // max(1, size[1] or 1)))
    rows = numbered(pages, __id=id_col, __url=url_col, __text=text_col).join(
        resolve_revisits(heads, least_bytes), "__row")
    first = F.col("__type") == "response"
    body = F.when(first, text_of("__text")).otherwise(F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("__type")), line("WARC-Record-ID", _id(path, F.col("__row"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _clean(F.col("__url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(first, F.col("__digest")).otherwise(NO_BYTES))),
        line("X-Payload-Length", F.col("__bytes")), maybe("X-Page-Id", F.col("__id")),
        F.when(first, "").otherwise(F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _id(path, F.col("__refers.row"))),
            line("WARC-Refers-To-Date", F.lit(date)),
            maybe("X-Refers-To-Page", F.col("__refers.id")))),
        line("Content-Type", F.when(first, "text/html; charset=utf-8").otherwise("application/octet-stream")),
        line("Content-Length", F.octet_length(body)), F.lit(CRLF), body)
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", per_file).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of each record of an uncompressed archive, by Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for x in lines[1:]:
            name, _, value = x.partition(": ")
            fields[name.lower()] = value
        length = int(fields["content-length"])
        begin = stop + 4
        if data[begin + length:begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[begin:begin + length]
        at = begin + length + 4


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "date", "record_type", "payload_digest", "payload_bytes", "refers_to", "record_id", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            rows: list[tuple] = []
            held = 0
            for fields, body in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                rows.append((_number(fields, "x-page-id"), fields["warc-target-uri"], fields["warc-date"],
                             fields["warc-type"], digest, int(fields["x-payload-length"]),
                             _number(fields, "x-refers-to-page"), fields["warc-record-id"], body))
                held += len(body)
                if len(rows) >= 1000 or held >= 4 << 20:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id``, ``url``, ``date``, ``record_type``, ``payload_digest``, ``payload_bytes`` (both of
    the full payload, also for revisits), ``refers_to``, ``record_id`` and ``payload`` (empty for revisits).

    Payloads of responses are held against their digests. A file that ends within a record is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, RECORDS)


def rewrite(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", **options) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back."""
    spark = pages.sparkSession
    path = write_archives(pages, fresh_path(spark, "archives"), id_col, text_col, url_col, **options)
    with arrow_rows(spark, 1):
        return persist_table(read_archives(spark, path).drop("payload"), "records")
