"""Blocks of documents with a dictionary each, and a join of what is known about a term
once per distinct term back to every block that holds it.

A block's row carries its dictionary as an array, and what its documents hold as
positions in it. A very common term thus has one row per block, not one per occurrence,
and the join's other side has one row per term, so a hot term can be split by AQE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that a block holds, unless one document alone is longer.
BLOCK_CHARS = 16_000_000


def in_blocks(frames: Iterator[pd.DataFrame], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of a task's frames in blocks of about ``chars`` characters, numbered so that
    a task that runs again gives the same numbers, of at most 36 bits."""
    task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
    for frame in frames:
        lengths = frame[text].str.len().fillna(0).to_numpy()
        lo = 0
        for i, n in enumerate(lengths):
            size += n + 16
            if size >= chars:
                held.append(frame.iloc[lo:i + 1])
                yield (task << 12) + k, pd.concat(held)
                k, held, size, lo = k + 1, [], 0, i + 1
        if lo < len(frame):
            held.append(frame.iloc[lo:])
    if held:
        yield (task << 12) + k, pd.concat(held)


def terms(blocks: DataFrame, *arrays: str) -> DataFrame:
    """A row per block and dictionary entry: block, idx, term and the entries of the other
    ``arrays``, which are as long as the dictionary."""
    if not arrays:
        return blocks.select("block", F.posexplode("terms").alias("idx", "term"))
    zipped = blocks.select("block", F.posexplode(F.arrays_zip("terms", *arrays)).alias("idx", "e"))
    return zipped.select("block", "idx", F.col("e.terms").alias("term"), *[F.col(f"e.{a}").alias(a) for a in arrays])


def per_block(blocks: DataFrame, known: DataFrame, fill: Callable, schema: str) -> DataFrame:
    """``fill(block_row, known_rows)`` for every block; known: block, idx and what the
    join has found. A group is one block, of bounded size."""
    def run(key, block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return fill(block.iloc[0], found)

    known = known.select(F.col("block").alias("of_block"), *[c for c in known.columns if c != "block"])
    return blocks.groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(run, schema)
