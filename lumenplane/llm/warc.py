"""A content-addressed web archive.

An archive is two tables. `payloads` holds the bytes of each distinct payload once, under their
SHA-256; `headers` holds the exact header block of every record, with the digest of its payload.
Joining them by digest gives the original records back, and every payload read is digested anew and
compared with its key, so that a damaged payload raises an error.

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the
`response`; the others are `revisit` records that name it. Smaller ones are all responses.

Defined results: a null page is an empty payload; repeated rows all stay, each as a record of its own,
and those of the response's page_id are responses; a null page_id is the smallest; extra columns are
ignored. Payload bytes cross the network once, by page, so a payload that a third of all pages share makes
no task large, and digests that very many records share are joined without being dealt to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplane.llm.common import join_by, work_dir, written

_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal: 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write payloads/ and headers/ of pages (page_id, url, html) under path."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    told = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    told.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")).write.parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    first = facts.groupBy("digest").agg(F.max("page_id").alias("response_id"))

    # a null page_id has a key of its own, so that one exchange serves the join and the collapse
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("k")
    kept = first.select(F.coalesce(F.col("response_id").cast("long"), F.lit(-(1 << 63))).alias("k"), "digest")
    same = told.select(key, "digest", "payload").join(kept.hint("shuffle_hash"), ["k", "digest"], "left_semi")
    same.dropDuplicates(["k", "digest"]).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    linked = join_by(facts, first, "digest").withColumn("revisit", (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("response_id")))
    uuid = lambda c: F.concat(F.lit("<urn:lumenplane:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uuid(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uuid(F.col("response_id"))))).otherwise(""),
        line("Content-Type", F.lit("text/html;charset=utf-8")),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit("\r\n"),
    )
    linked.select("digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """Payloads whose bytes have the digest they are kept under; any other raises an error."""
    kept = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return kept.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: the fields of its header, and size and digest of the payload it joins."""
    field = lambda name: F.regexp_extract(F.col("header").cast("string"), f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    number = lambda name: F.regexp_extract(field(name), "page:(-?\\d+)>", 1).try_cast("long")
    sizes = _verified(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    return join_by(spark.read.parquet(f"{path}/headers"), written(sizes, f"{work_dir(spark)}/sizes"), "digest").select(
        number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), "payload_bytes", "payload_digest",
        field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))).alias("verified"),
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original records, as bytes: header block, payload and the two line ends behind it."""
    return spark.read.parquet(f"{path}/headers").join(_verified(spark, path), "digest").select("digest", F.concat("header", "payload", F.lit(bytearray(b"\r\n\r\n"))).alias("record"))
