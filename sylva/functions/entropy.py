"""Entropy as aggregate algebra.

Entropies here are *negative*: ``H = sum(p * log2(p)) <= 0`` (0 for a pure set).
Given per-value counts ``n`` of a group with total ``N``::

    H = sum(n * log2(n)) / N - log2(N)

so a group's entropy needs one ``sum(n)`` and one ``sum(n*log2(n))`` over its
value counts: a plain combinable aggregation, no window and no join back to the
totals. A group with a single distinct value is exactly 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xlog2x(c: Column) -> Column:
    """``n * log2(n)`` with 0 for n <= 0."""
    c = c.cast("double")
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def entropy_expr(total: Column, nlogn: Column, n_values: Column) -> Column:
    """Negative entropy from ``sum(n)``, ``sum(n log2 n)`` and the number of values."""
    total = total.cast("double")
    return F.when(n_values <= 1, F.lit(0.0)).otherwise(nlogn / total - F.log2(total))


def entropy_from_counts(counts: DataFrame, group_cols: list[str], count_col: str = "n",
                        total_name: str = "n_total", entropy_name: str = "entropy") -> DataFrame:
    """Per group: total count and negative entropy of the value distribution.

    ``counts`` holds one row per (group, value) with the value's count in ``count_col``.
    """
    agg = counts.groupBy(*group_cols).agg(
        F.sum(count_col).alias(total_name),
        F.sum(xlog2x(F.col(count_col))).alias("_nlogn"),
        F.count(F.lit(1)).alias("_nvals"),
    )
    return agg.select(
        *group_cols,
        F.col(total_name),
        entropy_expr(F.col(total_name), F.col("_nlogn"), F.col("_nvals")).alias(entropy_name),
    )


# SQL text of the same algebra, for the DuckDB oracles and for spark.sql users.
def entropy_sql(total: str, nlogn: str, n_values: str) -> str:
    return f"CASE WHEN {n_values} <= 1 THEN 0.0 ELSE {nlogn} / CAST({total} AS DOUBLE) - log2(CAST({total} AS DOUBLE)) END"


def xlog2x_sql(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({n} AS DOUBLE) * log2(CAST({n} AS DOUBLE)) ELSE 0.0 END"
