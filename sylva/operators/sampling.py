"""Deterministic sampling (M1-M4): every choice is a hash of a row key and a seed.

Unlike ``randomSplit``/``sample``, the result does not depend on partitioning,
survives recomputation after a lost executor unchanged, and can be replayed in
SQL (see :mod:`sylva.functions.hashing`).
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import PRIME, row_hash, row_hash_sql

#: Width of the hash ranges that are counted to find a cut-off; PRIME / RANGE of them, 4,096.
RANGE = 1 << 19


def test_bucket(key: str, seed: int = 0, test_fraction: float = 0.1):
    return row_hash(F.col(key), seed) < F.lit(round(test_fraction * PRIME))


def split_train_test(df: DataFrame, key: str, seed: int = 0, test_fraction: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test) — a row is a test row when its hash falls in the first
    ``test_fraction`` of the hash's range. Two filters over one scan, no shuffle."""
    is_test = test_bucket(key, seed, test_fraction)
    return df.filter(~is_test), df.filter(is_test)


def split_sql(key: str, seed: int = 0, test_fraction: float = 0.1, test: bool = True) -> str:
    op = "<" if test else ">="
    return f"{row_hash_sql(key, seed)} {op} {round(test_fraction * PRIME)}"


def sample_per_group(df: DataFrame, group_cols: list[str], key: str, k: int, seed: int = 0,
                     tiebreak: list[str] | None = None) -> DataFrame:
    """M2 / M3 / M4: the ``k`` rows with the lowest hash in each group.

    Rows are ordered by (hash, key, ``tiebreak`` columns — default all other
    columns), a total order even when the key repeats, so the sample is the same
    in every run and engine.

    Only rows that can be in the sample are sorted: a first narrow pass (group and key alone)
    counts each group's rows by ranges of the hash, the range in which the ``k``-th row lies ends
    the group's cut-off, and rows beyond it are filtered out. The cut-offs, one row per group, are
    broadcast: groups are tree nodes or classes, few by the caller's parameters.
    """
    names = [f"_g{i}" for i in range(len(group_cols))]
    h = row_hash(F.col(key), seed)
    ranges = df.select(*[F.col(g).alias(n) for g, n in zip(group_cols, names)], F.floor(h / F.lit(RANGE)).alias("_b")).groupBy(
        *names, "_b").agg(F.count(F.lit(1)).alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(*names).orderBy("_b"))
    cuts = ranges.select(*names, "_b", so_far.alias("_s")).groupBy(*names).agg(
        F.coalesce(F.min(F.when(F.col("_s") >= k, F.col("_b"))) + 1, F.lit(PRIME)).alias("_end"))
    near = df.join(F.broadcast(cuts), reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group_cols, names)], F.lit(True)))
    return lowest_per_group(near.filter(F.floor(h / F.lit(RANGE)) < F.col("_end")).drop(*names, "_end"), group_cols, key, k, seed, tiebreak)


def lowest_per_group(df: DataFrame, group_cols: list[str], key: str, k: int, seed: int = 0,
                     tiebreak: list[str] | None = None) -> DataFrame:
    """:func:`sample_per_group` by sorting all rows: ``row_number() <= k``, planned with a partial
    ``WindowGroupLimit`` before the shuffle, so each map task ships at most k rows per group."""
    if tiebreak is None:
        tiebreak = [c for c in df.columns if c != key and c not in group_cols]
    w = Window.partitionBy(*group_cols).orderBy(row_hash(F.col(key), seed), F.col(key),
                                                *[F.col(c).asc_nulls_first() for c in tiebreak])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def sample_known_sizes(df: DataFrame, group_col: str, key: str, k: int, sizes: dict[str, int], seed: int = 0,
                       wider: int = 1) -> DataFrame:
    """:func:`sample_per_group` in one pass where the groups' sizes are known: the cut-off is
    where a group's ``k`` rows are expected with ample room. A group whose keys repeat much can
    come short of ``min(k, size)`` rows; it is drawn again with a ``wider`` cut-off (see :func:`came_short`)."""
    room = wider * (k + 8 * math.sqrt(k) + 40)
    cuts = {g: PRIME if n <= room else math.ceil(PRIME * room / n) for g, n in sizes.items()}
    cut = F.try_element_at(F.from_json(F.lit(json.dumps(cuts)), "map<string,bigint>"), F.col(group_col))
    return lowest_per_group(df.filter(row_hash(F.col(key), seed) < cut), [group_col], key, k, seed)


def came_short(found: dict[str, int], sizes: dict[str, int], k: int) -> dict[str, int]:
    """The groups (and sizes) of which fewer rows were found than they have to give."""
    return {g: n for g, n in sizes.items() if found.get(g, 0) < min(k, n)}


def sample_per_group_sql(table: str, group_cols: list[str], key: str, k: int, seed: int = 0,
                         tiebreak: list[str] = ()) -> str:
    part = ", ".join(group_cols) if group_cols else "NULL"
    tb = "".join(f", {c} ASC NULLS FIRST" for c in tiebreak)
    return (f"SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {part} "
            f"ORDER BY {row_hash_sql(key, seed)}, {key}{tb}) AS _rn FROM {table}) WHERE _rn <= {k}")


def lowest_hash_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """M4: the ``n`` rows of the whole table with the lowest hash (ties by key).
    Planned as a per-partition top-n merged once (TakeOrderedAndProject), so it
    never gathers more than n rows per task."""
    return df.orderBy(row_hash(F.col(key), seed), F.col(key)).limit(n)
