"""CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def export_csv(df: DataFrame, path: str, single_file: bool = False, sort: list[str] | None = None) -> str:
    """Write with a header, NULL as the empty field and the empty string (a one-leaf
    tree's label) as ``""``. ``sort``: files of ranges of these columns, each sorted, so that the
    files in the order of their names are the sorted table, written by all tasks. ``single_file``
    coalesces to one task: only for small reports (a pivot has one row per leaf)."""
    out = df.coalesce(1) if single_file else df.orderBy(*sort) if sort else df
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)
    return path


def read_exported(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`export_csv` wrote. Spark reads ``""`` as NULL if NULL is the empty
    text; a missing field is NULL under any ``nullValue``."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "\\N").csv(path)
