"""Content-addressed web archive: every payload stored once under its SHA-256, exact record headers beside it, original records by joins.

An archive is two Parquet tables: ``payloads(address, copies, body)`` and ``records(address, copies, header, http)``. ``header`` and ``http`` are
the exact bytes of a WARC/1.1 record up to its payload. :func:`restore` joins them back into records and proves every payload against its
address; :func:`export_warc` and :func:`read_warc` write and read plain WARC files. All of it is DataFrame expressions, except that files whose
payloads hold the record separator are read by lengths in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, durable, join_classes, utf8

#: Records that meet one copy of a payload when records are put together; a payload with more of them is dealt out in as many copies.
MEETING = 1000
VERSION = "WARC/1.1\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(body: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 160 bits are 32 letters, without padding."""
    digest = F.sha1(body)
    letters = []
    for k in range(8):
        twenty_bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(twenty_bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """``(_n, _id, _url, _address, _digest, _bytes, _copies, _first)``: one row for each page, ``_first`` the ``(none, id, url, n)`` of the row that its payload is kept under.

    Among equal payloads of at least ``least`` bytes the smallest id is first; null ids come last, of one id's rows the smallest url, then any
    one. Smaller payloads are each their own first. A null payload is empty. Classes are found on digests; payloads do not move.
    """
    body = F.coalesce(utf8(body_col), F.lit(b""))
    told = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_body"))
    told = told.select("_id", "_url", F.sha2("_body", 256).alias("_address"), base32_sha1(F.col("_body")).alias("_digest"), F.octet_length("_body").cast("long").alias("_bytes"))
    rows = durable(told.select(F.monotonically_increasing_id().alias("_n"), "*"))
    me = F.struct(F.col("_id").isNull().alias("none"), "_id", "_url", "_n")
    classes = rows.groupBy("_address").agg(F.count("*").alias("_copies"), F.min(me).alias("_least"))
    joined = join_classes(rows, classes.withColumn("_size", F.col("_copies")), "_address", "_size", rows.count())
    return joined.withColumn("_first", F.when(F.col("_bytes") < least, me).otherwise(F.col("_least"))).drop("_least")


def record_heads(rows: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``(address, copies, header, http)`` of :func:`classified` rows. Line breaks inside a url are percent-encoded; a null url has no target line."""
    escaped = lambda url: F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda i, n: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), n.cast("string"), F.lit(">"))
    kept = F.col("_first._n") == F.col("_n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.concat(_line("WARC-Profile", F.lit(IDENTICAL)), _line("WARC-Refers-To", name(F.col("_first._id"), F.col("_first._n"))), _line("WARC-Refers-To-Target-URI", escaped(F.col("_first._url"))))
    length = F.octet_length("_http") + F.when(kept, F.col("_bytes")).otherwise(0)
    header = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(kept, "response").otherwise("revisit")),
        _line("WARC-Record-ID", name(F.col("_id"), F.col("_n"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", escaped(F.col("_url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(kept, "").otherwise(revisit),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return rows.withColumn("_http", http).select(F.col("_address").alias("address"), F.col("_copies").alias("copies"), header.cast("binary").alias("header"), F.col("_http").cast("binary").alias("http"))


def store(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of ``pages`` under ``path``. Of each payload one copy leaves a task, so that a common payload is no hot key."""
    body = pages.select(F.coalesce(utf8(body_col), F.lit(b"")).alias("body"))
    payloads = body.groupBy(F.sha2("body", 256).alias("address")).agg(F.count("*").alias("copies"), F.first("body").alias("body"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    record_heads(classified(pages, id_col, url_col, body_col, least), date).write.option("compression", "zstd").parquet(f"{path}/records")


def restore(spark: SparkSession, path: str, meeting: int = MEETING) -> DataFrame:
    """``(header, http, payload, record)`` of every record of an archive; a payload that does not have its address's digest, or a block that does not have its header's length, is an error.

    ``record`` is the original record: a revisit has no payload in its block. At most about ``meeting`` records meet one copy of a payload.
    """
    slices = F.ceil(F.col("copies") / meeting).cast("int")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("address"))).cast("binary")
    stored = spark.read.parquet(f"{path}/payloads")
    proven = stored.select("address", "copies", F.when(F.sha2("body", 256) == F.col("address"), F.col("body")).otherwise(wrong).alias("payload"))
    dealt = proven.select("address", "payload", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    heads = spark.read.parquet(f"{path}/records").select("address", "header", "http", F.pmod(F.xxhash64("header"), slices).cast("int").alias("slice"))
    whole = heads.join(dealt, ["address", "slice"])
    tail = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    short = F.raise_error(F.concat(F.lit("block differs from its length in "), F.col("header").cast("string"))).cast("binary")
    sound = F.octet_length("http") + F.octet_length(tail) == field(F.col("header"), "Content-Length").cast("long")
    return whole.select("header", "http", "payload", F.when(sound, F.concat("header", "http", tail)).otherwise(short).alias("record"))


def field(header: Column, name: str) -> Column:
    """Value of a header line, null if there is none."""
    found = F.regexp_extract(header.cast("string"), rf"\r\n(?i:{name}):[ \t]*([^\r\n]*)\r\n", 1)
    return F.when(header.cast("string").rlike(rf"\r\n(?i:{name}):"), found)


def parsed(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``(header, http, payload)`` of whole records: the header ends at the first blank line, its length names the block, whose own head ends at its first blank line."""
    upto = lambda c: F.concat(F.substring_index(c.cast("string"), "\r\n\r\n", 1), F.lit("\r\n\r\n")).cast("binary")
    cut = records.select(upto(F.col(record_col)).alias("header"), F.col(record_col).alias("_r"))
    block = F.substring(F.col("_r"), F.octet_length("header") + 1, field(F.col("header"), "Content-Length").cast("int"))
    cut = cut.select("header", block.alias("_b")).select("header", "_b", upto(F.col("_b")).alias("http"))
    return cut.select("header", "http", F.substring(F.col("_b"), F.octet_length("http") + 1, F.octet_length("_b")).alias("payload"))


def export_warc(restored: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """Write ``record`` as plain WARC files: a record ends with two line breaks, which is what the text sink puts after each row."""
    restored.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(header, http, payload)`` of the records of plain WARC files.

    Files are split at the version line. Where a payload holds that line itself, a piece is not as long as its header says; such files are read again as a whole, by lengths.
    """
    pieces = spark.read.option("lineSep", VERSION).text(path).where("value != ''").select(F.concat(F.lit(VERSION), F.col("value")).cast("binary").alias("record"), F.col("_metadata.file_path").alias("_file"))
    head = F.octet_length(F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)) + 4
    told = pieces.withColumn("_whole", F.coalesce(F.octet_length("record") == head + field(F.col("record"), "Content-Length").cast("long") + 4, F.lit(False)))
    split = [r[0] for r in told.where("not _whole").select("_file").distinct().limit(10_001).collect()]
    if not split:
        return parsed(told)
    if len(split) > 10_000:
        return parsed(_by_lengths(spark, [path]))
    return parsed(told.where(~F.col("_file").isin(split)).select("record").unionByName(_by_lengths(spark, split)))


def _by_lengths(spark: SparkSession, paths: list[str]) -> DataFrame:
    bounded_batches(spark)
    schema = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                at, found = 0, []
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at) + 4
                    length = next(int(line.split(b":", 1)[1]) for line in content[at:end].split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    found.append(content[at : end + length])
                    at = end + length + 4
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], schema=schema)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, "record binary")
