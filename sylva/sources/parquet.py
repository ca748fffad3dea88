"""Parquet sources and sinks, staging views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_views(spark: SparkSession, sources: dict[str, str]) -> dict[str, DataFrame]:
    """Read each parquet path and register it as a temp view (path -> view).

    No forced persist: the scan stays prunable and pushable for every later query.
    """
    out = {}
    for path, view in sources.items():
        df = spark.read.parquet(path)
        df.createOrReplaceTempView(view)
        out[view] = df
    return out


def view_counts(spark: SparkSession, views: list[str]) -> DataFrame:
    """S1 report: (view, n_rows) for each registered view, one job for all."""
    parts = [spark.table(v).select(F.lit(v).alias("view"), F.count(F.lit(1)).alias("n_rows")) for v in views]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Fail on an empty input (one-row probe, not a full count)."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def stage(spark: SparkSession, view: str, sql: str) -> DataFrame:
    """``CREATE OR REPLACE TEMP VIEW view AS <sql>``; returns the view."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS {sql}")
    return spark.table(view)


def staged(spark: SparkSession, view: str) -> DataFrame | None:
    """A staged table by name, or None when absent."""
    return spark.table(view) if spark.catalog.tableExists(view) else None


def register(df: DataFrame, view: str) -> DataFrame:
    """Register a result under a name (e.g. ``{label}_{target}``)."""
    df.createOrReplaceTempView(view)
    return df


def write_read_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write as parquet (overwrite) and read back, so later queries scan the
    written columnar copy instead of recomputing the source."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``SELECT COUNT(*) AS count, target FROM t GROUP BY target``."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
