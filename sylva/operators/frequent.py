"""K2 for columns with very many distinct items: the most frequent ones without shuffling them all.

Items are first counted by hash bucket, which ships ``buckets`` numbers per key whatever the
number of distinct items; a bucket's total bounds every item in it from above. The items of the fullest
buckets are then counted exactly, and the k-th of these counts bounds the result from below: a
bucket with a smaller total holds none of the k. Only the buckets that this leaves open are counted
too. The result is exact. Where counts are all alike (every item once) the bounds
decide nothing and all items are counted, as :func:`.profile.top_k` does at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profile import top_k


def frequent(items: DataFrame, keys: list[str], k: int = 10, value_col: str = "value", buckets: int = 1 << 16,
             tried: int = 8) -> DataFrame:
    """(keys..., value, n, rank): the ``k`` most frequent items per key, ties to the smaller; NULL is an
    item. ``items`` has a row per occurrence and is read three times; ``tried`` x k buckets per key are counted first."""
    dealt = items.select(*keys, value_col, F.pmod(F.xxhash64(value_col), F.lit(buckets)).alias("_b"))
    by_size = Window.partitionBy(*keys).orderBy(F.desc("_total"), "_b")
    totals = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_total")).withColumn("_r", F.row_number().over(by_size))

    def counted(chosen: DataFrame) -> DataFrame:
        """Exact counts in the ``chosen`` buckets, ``buckets`` rows per key at most."""
        own = chosen.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_b"])])
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, "_b"])]
        return dealt.join(F.broadcast(own), same, "left_semi").groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("n"))

    fullest = F.col("_r") <= tried * k
    first = top_k(counted(totals.filter(fullest)), keys, k, value_col)
    # Below the k-th count; a key with fewer items than k in its fullest buckets has none, and all its buckets stay open.
    least = first.filter(F.col("rank") == k).select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(keys)], F.col("n").alias("_least"))
    rest = totals.filter(~fullest).join(F.broadcast(least), [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(keys)], "left").filter(
        F.col("_total") >= F.coalesce("_least", F.lit(0)))
    return top_k(first.drop("rank").unionByName(counted(rest)), keys, k, value_col)
