"""Pages to WARC records, equal payloads as revisits, and back.

Payloads are equal by SHA-256; the smallest page id of a group of at least ``min_bytes``
is the response. A group is reduced to one row before anything is joined, and only groups
of more than one page are, so a payload that a third of all pages share is no hot key.

Defined results: null html is an empty payload; a null page id is larger than any other,
and equal payloads of null ids alone are all responses; rows that repeat the id and the
payload of a response are responses too; a null url has no target header; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table, written
from .warc import read_warc, write_warc


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages as rows for the WARC writer; revisits come without their payload."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    groups = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null"))
    # Written: its size is known to the planner, which shuffles no payload where it is small.
    groups = written(groups.select(F.col("sha").alias("g_sha"), "first_id"), "equal-payloads")
    rows = rows.join(groups, rows["sha"] == groups["g_sha"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:sylva:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(F.when(again, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"), "target_uri",
                       F.lit(None).cast("string").alias("date"), F.sha1("payload").alias("payload_digest"),
                       F.when(again, name("first_id")).alias("refers_to"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
                       F.when(~again, F.col("payload")).alias("payload"))


def page_of(name: str):
    return F.regexp_extract(name, r"^<urn:sylva:page:(-?\d+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, path: str, **names) -> DataFrame:
    """Writes the pages' archives to ``path`` and reads them back: responses with their payloads,
    which must have the digests that their headers name, and revisits by their headers."""
    spark = pages.sparkSession
    write_warc(page_records(pages, **names), path)
    full = read_warc(spark, path, F.col("record_type") == "response").withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    bare = read_warc(spark, path, F.col("record_type") == "revisit", payload="false")
    both = [x.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                     page_of("refers_to").alias("refers_to")) for x in (full, bare)]
    return both[0].unionByName(both[1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
