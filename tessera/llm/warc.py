"""WARC archives in which repeated payloads are revisit records.

Headers (id, digest, length) are shuffled by payload digest; of equal payloads of
at least ``min_bytes`` the record with the largest page_id is the response and the
others become revisits of it. Archives are written with fresh headers by Spark's
text writer (so its committer deals with lost tasks), gzip-compressed, one record
after another. Every record names the run's warcinfo id in its first header
line; reading splits on that line and checks each record against its
Content-Length and each response against its digest.

Defined results: a null html is an empty payload; a null url is written empty; a
null page_id is never the original of another page; rows that repeat page_id and
html give the same record each; an empty table gives an empty archive.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import equal_nulls
from tessera.session import scratch_path

MIN_BYTES = 1000
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
DIGEST = ["_sha1", "_sha256", "_bytes"]


def headers(pages: DataFrame) -> DataFrame:
    """pages with the digests and length of the payload."""
    body = F.col("_payload").cast("binary")
    return (pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"), F.coalesce("html", F.lit("")).alias("_payload"))
            .withColumns({"_sha1": F.sha1(body), "_sha256": F.sha2(body, 256), "_bytes": F.octet_length(body).cast("long")}))


def resolve(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """records with ``_refers_to``: the page_id of the response of an equal payload, null for responses."""
    large = records.select("page_id", *DIGEST).where(F.col("_bytes") >= min_bytes)
    originals = (large.groupBy(*DIGEST).agg(F.max("page_id").alias("_refers_to"), F.count("*").alias("_copies"))
                 .where("_copies > 1").drop("_copies"))
    revisits = (large.join(originals, DIGEST).where(~F.col("page_id").eqNullSafe(F.col("_refers_to")))
                .select("page_id", "_sha256", "_refers_to").distinct())
    return records.join(revisits, equal_nulls(records, revisits, ["page_id", "_sha256"]), "left").select(
        records["*"], revisits["_refers_to"])


def record_id(page_id, digest):
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archives(records: DataFrame, path: str, run: str) -> None:
    """Write one record per row of resolve(headers(pages))."""
    revisit = F.col("_refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_payload")))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    head = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Warcinfo-ID: <urn:uuid:{run}>{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("_sha256"))),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace("_url", r"[\x00-\x20\x7f]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        line("Payload-Length", F.col("_bytes").cast("string")),
        line("Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)),
                                 line("WARC-Refers-To", record_id(F.col("_refers_to"), F.col("_sha256"))),
                                 line("Refers-To-Page-ID", F.col("_refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    (records.select(F.concat(head, block).alias("value"))
     .write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path))


def read_archives(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Records of the archives: page_id, record_id, record_type, url, digest, length, refers-to ids and payload (null in revisits)."""
    mark = f"{VERSION}{CRLF}WARC-Warcinfo-ID: <urn:uuid:{run}>{CRLF}"
    raw = spark.read.option("lineSep", mark).text(path).where("value != ''")
    cutting = raw.select("value", F.instr("value", CRLF * 2).alias("_at"))
    parts = cutting.select(F.expr("substring(value, 1, _at + 1)").alias("_head"),
                           F.expr("substring(value, _at + 4, char_length(value) - _at - 7)").alias("_block"))

    def field(name):
        return F.regexp_extract("_head", f"(?:^|\r\n){name}: ([^\r\n]*)", 1)

    length = field("Content-Length").cast("long")
    checked = F.when(F.octet_length("_block") == length, F.col("_block")).otherwise(
        F.raise_error(F.concat(F.lit("record length differs from its Content-Length: "), field("Page-ID"))))
    rec = parts.select(
        F.expr("try_cast(regexp_extract(_head, 'Page-ID: ([^\\r\\n]*)', 1) AS BIGINT)").alias("page_id"),
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("_digest"), field("Payload-Length").cast("long").alias("_bytes"),
        F.when(field("WARC-Refers-To") != "", field("WARC-Refers-To")).alias("refers_to_record"), checked.alias("_block"))
    body = F.expr("substring(_block, instr(_block, '\\r\\n\\r\\n') + 4)")
    rec = rec.withColumn("payload", F.when(F.col("record_type") == "response", body)).drop("_block")
    same = F.sha1(F.col("payload").cast("binary")) == F.col("_digest")
    return rec.withColumn("payload", F.when(F.col("payload").isNull() | same, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id")))))


def revisit_table(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take the payload's figures from the response they name."""
    response = records.where("record_type = 'response'").select(
        "page_id", "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1(F.col("payload").cast("binary")).alias("payload_digest"))
    originals = response.select(F.col("record_id").alias("refers_to_record"), "payload_bytes", "payload_digest",
                                F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_record"])
    revisits = records.where("record_type = 'revisit'").select("page_id", "refers_to_record").join(originals, "refers_to_record", "left")
    return response.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                           F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
                        F.col("refers_to").cast("long").alias("refers_to")))


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` as deduplicated archives and return the records read back."""
    spark, run = pages.sparkSession, str(uuid.uuid4())
    path = path or scratch_path(spark, f"llm/warc-{run}")
    write_archives(resolve(headers(pages), min_bytes), path, run)
    return read_archives(spark, path, run)
