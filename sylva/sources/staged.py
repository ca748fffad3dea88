"""Staged views of the supplied tables, as DataFrames and as DuckDB SQL text.

Tree rules need integer or string columns, so numeric features are cast in the
staging query (the reference's convention). Each staged table has a stable
integer ``row_key`` (the seed of every hash-based sample; that of ``st_line`` is
not unique) and a class ``y``.

* ``st_line``  (lineitem): quantity, linenumber, discount_pct, tax_pct (int),
  linestatus (string); y = returnflag A/N/R -> 0/1/2.
* ``st_docs``  (documents ⋈ labels): n_chars (int), text, lang; y = quality, toxic.
* ``st_event`` (events): value_int, hour (int), user_id (bigint); y = event_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parquet import read_table


def st_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_line(read_table(spark, sf_dir, "lineitem"))


def stage_line(li: DataFrame) -> DataFrame:
    """The st_line projection of a lineitem frame (batch or streaming)."""
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_key"),
        F.floor("l_quantity").cast("int").alias("quantity"),
        F.col("l_linenumber").cast("int").alias("linenumber"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("discount_pct"),
        F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("tax_pct"),
        F.col("l_linestatus").alias("linestatus"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
        .when(F.col("l_returnflag") == "R", 2).cast("int").alias("y"),
    )


ST_LINE_SQL = """SELECT l_orderkey * 8 + l_linenumber AS row_key,
  CAST(floor(l_quantity) AS INTEGER) AS quantity,
  CAST(l_linenumber AS INTEGER) AS linenumber,
  CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS discount_pct,
  CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS tax_pct,
  l_linestatus AS linestatus,
  CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS INTEGER) AS y
FROM lineitem"""


def st_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels")
    # Plain equi-join: the planner broadcasts labels only when its measured size is
    # under spark.sql.autoBroadcastJoinThreshold, otherwise it shuffles both sides.
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_key"),
        F.col("n_chars").cast("int").alias("n_chars"),
        "text", "lang",
        F.col("quality").cast("int").alias("y"),
        F.col("toxic").cast("int").alias("toxic"),
    )


ST_DOCS_SQL = """SELECT d.doc_id AS row_key, CAST(d.n_chars AS INTEGER) AS n_chars, d.text, d.lang,
  CAST(l.quality AS INTEGER) AS y, CAST(l.toxic AS INTEGER) AS toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def st_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_key"),
        F.floor("value").cast("int").alias("value_int"),
        F.hour("ts").cast("int").alias("hour"),
        F.col("user_id"),
        F.col("event_type").alias("y"),
    )


ST_EVENT_SQL = """SELECT event_id AS row_key, CAST(floor(value) AS INTEGER) AS value_int,
  CAST(hour(ts) AS INTEGER) AS hour, user_id, event_type AS y
FROM events"""

STAGED = {"st_line": (st_line, ST_LINE_SQL), "st_docs": (st_docs, ST_DOCS_SQL), "st_event": (st_event, ST_EVENT_SQL)}


def with_staged(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the staging CTEs it uses."""
    ctes = ",\n".join(f"{n} AS (\n{STAGED[n][1]}\n)" for n in names)
    return f"WITH {ctes}\n{sql}"
