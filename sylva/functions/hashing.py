"""Deterministic pseudo-random orders, identical in Spark and in plain SQL.

Everything random in the tree build (train/test split, the per-node row sample,
the order in which text candidates are taken) is a hash of a stable key and a
seed, so a build is reproducible under any partitioning and can be replayed in
another SQL engine. Rows use integer arithmetic modulo the Mersenne prime
2^31-1 (two multiply-add rounds with an xor between them; every product stays
below 2^62, so bigint never overflows); text terms use ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the row hash.
PRIME = 2147483647
MUL_A = 1597334677
MUL_B = 1013904223
XOR_C = 1540483477


def row_hash(key: Column, seed: int = 0) -> Column:
    """Pseudo-random bigint in [0, 2^31-1) from an integer key and a seed."""
    x = F.pmod(key.cast("bigint"), F.lit(PRIME))
    y = F.pmod(x * F.lit(MUL_A) + F.lit(int(seed) % PRIME), F.lit(PRIME))
    return F.pmod(y.bitwiseXOR(F.lit(XOR_C)) * F.lit(MUL_B), F.lit(PRIME))


def row_hash_sql(key: str, seed: int = 0) -> str:
    """The same hash as SQL text (DuckDB dialect: ``xor``, non-negative ``%``)."""
    x = f"((({key}) % {PRIME} + {PRIME}) % {PRIME})"
    y = f"(({x} * {MUL_A} + {int(seed) % PRIME}) % {PRIME})"
    return f"((xor({y}, {XOR_C}) * {MUL_B}) % {PRIME})"


def level_seed(seed: int, level: int) -> int:
    """The seed of a level of the build: far from the others, so that the rows first in
    one level's order aren't first again in the next one's."""
    return (int(seed) + level * MUL_B) % PRIME


def term_order(term: Column, seed: int = 0) -> Column:
    """Order key for candidate terms: md5 of the seed and the term."""
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), term))


def term_order_sql(term: str, seed: int = 0) -> str:
    return f"md5('{int(seed)}:' || {term})"
