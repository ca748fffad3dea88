"""Cells: a row per value, word or n-gram of the asked columns, from one scan.

All counts of a table (values, string lengths, words, n-grams, texts) come from one
``explode`` and one aggregation over (group, column, kind, value), whatever the number of
columns and kinds; entropies, moments and frequent items are read off these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_NGRAM, DEFAULT_TOKENIZER, ngrams, tokenize

#: Kinds of cells. VALUE: the value as a string, NULL too; LENGTH: a string's; TEXT: '' per string, NULL per NULL.
VALUE, LENGTH, WORD, GRAM, TEXT = "value", "length", "word", "gram", "text"

#: Bytes of input per core above which a table has splits enough for all cores.
SPLIT_BYTES = 32 << 20


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deals a small table out to all cores (or to ``partitions`` tasks) before its texts explode.
    Small is what the planner's own file statistics put under ``SPLIT_BYTES`` a core; a larger
    table has splits enough and its texts aren't shuffled. Only the plan is looked at: no job runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if partitions is None:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        partitions = cores if size < cores * SPLIT_BYTES else 0
    return df.repartition(partitions) if partitions else df


def _values(name: str, kind: str, n: int, tokenizer: str) -> Column:
    c = F.col(name)
    return {VALUE: lambda: F.array(c.cast("string")), LENGTH: lambda: F.when(c.isNotNull(), F.array(F.length(c).cast("string"))),
            WORD: lambda: tokenize(c, tokenizer), GRAM: lambda: ngrams(c, n),
            TEXT: lambda: F.array(F.when(c.isNotNull(), F.lit("")))}[kind]()


def cells(df: DataFrame, keep: list[str], wanted: list[tuple[str, str]], n: int = DEFAULT_NGRAM,
          tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(keep..., col_name, kind, value) for the ``wanted`` (column, kind) pairs."""
    return named(numbered_cells(df, keep, wanted, n, tokenizer), wanted).select(*keep, "col_name", "kind", "value")


def numbered_cells(df: DataFrame, keep: list[str], wanted: list[tuple[str, str]], n: int = DEFAULT_NGRAM,
                   tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """:func:`cells` with the number of the pair in ``wanted`` (``_part``) in place of its names, as a short
    key to count by. A single pair has none and takes one ``explode``."""
    if len(wanted) == 1:
        return df.select(*keep, F.explode(_values(*wanted[0], n, tokenizer)).alias("value"))
    parts = [F.struct(F.lit(i).alias("part"), _values(c, k, n, tokenizer).alias("values")) for i, (c, k) in enumerate(wanted)]
    return df.select(*keep, F.explode(F.array(*parts)).alias("_c")).select(
        *keep, F.col("_c.part").alias("_part"), F.explode("_c.values").alias("value"))


def part_key(wanted: list[tuple[str, str]]) -> list[str]:
    """The columns that tell the pairs of :func:`numbered_cells` apart."""
    return ["_part"] if len(wanted) > 1 else []


def named(df: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """The pairs of :func:`numbered_cells` by ``col_name`` and ``kind`` again."""
    def name(i: int) -> Column:
        return F.get(F.array(*[F.lit(w[i]) for w in wanted]), F.col("_part")) if len(wanted) > 1 else F.lit(wanted[0][i])

    return df.withColumns({"col_name": name(0), "kind": name(1)}).drop("_part")


def text_kinds(columns: list[str], kinds: tuple[str, ...], n: int = DEFAULT_NGRAM) -> list[tuple[str, str]]:
    """The (column, kind) pairs of string columns, without n-grams of no length."""
    return [(c, k) for c in columns for k in kinds if k != GRAM or n > 0]


def cell_counts(df: DataFrame, group_cols: list[str], wanted: list[tuple[str, str]], n: int = DEFAULT_NGRAM,
                tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(group..., col_name, kind, value, n)."""
    counts = numbered_cells(df, group_cols, wanted, n, tokenizer).groupBy(*group_cols, *part_key(wanted), "value").agg(
        F.count(F.lit(1)).alias("n"))
    return named(counts, wanted).select(*group_cols, "col_name", "kind", "value", "n")
