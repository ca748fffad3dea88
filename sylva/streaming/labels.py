"""Label a stream with a tree and keep running leaf x class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.tree import Tree, label


def label_stream(stream: DataFrame, tree: Tree, name: str = "cluster_id") -> DataFrame:
    """P1 on a streaming DataFrame: every arriving row gets its leaf id."""
    return label(stream, tree, name)


def label_counts(stream: DataFrame, tree: Tree, target: str, name: str = "cluster_id") -> DataFrame:
    """Running (leaf, class) counts of a labelled stream: a streaming aggregation
    whose state is one count per (leaf, class) — bounded by the tree and the
    classes, not by the stream."""
    return label_stream(stream, tree, name).groupBy(name, target).agg(F.count(F.lit(1)).alias("n"))


def label_counts_stream(stream: DataFrame, tree: Tree, target: str, sink_table: str, checkpoint: str,
                        name: str = "cluster_id", state_partitions: int | None = None) -> StreamingQuery:
    """:func:`label_counts` into an in-memory table (complete mode, all available
    input, then stop). The checkpoint (in the shared checkpoint folder) lets the
    query resume after a failure; any other sink works the same way via
    ``label_counts(...).writeStream``.

    A streaming aggregation keeps its state in ``spark.sql.shuffle.partitions``
    partitions, fixed when the query first starts (AQE does not coalesce them).
    The state here is one row per (leaf, class), so the query starts with
    ``state_partitions`` (default: the cluster's parallelism) and the session's
    setting is restored right after."""
    spark = stream.sparkSession
    n = state_partitions or spark.sparkContext.defaultParallelism
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return (label_counts(stream, tree, target, name).writeStream.outputMode("complete").format("memory")
                .queryName(sink_table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
