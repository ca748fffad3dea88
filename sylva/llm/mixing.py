"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the total in proportion to its weight; a source
that would pass ``max_epochs`` times its own size is clamped there and the excess
goes to the others by weight, until none is above. The clamped set is fixed by one
number, the level (words per unit of weight), so each round is one small aggregate.

A source's target of ``whole + fraction`` epochs is then taken as ``whole``
repetitions of all its documents and one more of a seeded part of them: documents
are ordered by a hash of their id, and the cut is put where the words taken come
nearest the target. The cut is found on sums per hash bucket first and inside one
bucket last, so no source, however hot, is ordered in one task.

Defined results: a null text has size 0; null is a source of its own, last in order;
a source of size 0 has target 0; documents that agree in id and size fall on the same
side of the cut; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.hashing import PRIME, row_hash, row_hash_sql
from .common import WORD, table, unused, written

#: Hash buckets per source in which the cut is looked for.
BUCKETS = 4096
WIDTH = PRIME // BUCKETS + 1


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def hash_of(id_: Column, seed: int) -> Column:
    return F.coalesce(row_hash(id_, seed), F.lit(0).cast("bigint"))


def cycle_weights(sources: DataFrame, weights=(5, 2, 1)) -> DataFrame:
    """``sources`` (with a column source) with a column weight: the given weights in turn
    over the sources by code point, null last. Ranks are counted over sorted partitions."""
    schema = StructType(sources.schema.fields + [StructField("_rank", LongType())])
    order = sources.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.sparkSession.createDataFrame(order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    table_ = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.element_at(table_, (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with a column target."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    while True:  # the level only rises and the clamped set only grows: at most one round per source
        clamped = F.col("weight") * F.lit(level) >= cap
        used, free = sources.agg(F.sum(F.when(clamped, cap).otherwise(0.0)),
                                 F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            return sources.withColumn("target", cap)
        new = (total - used) / free
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def plan_mix(sizes: DataFrame, share: float, max_epochs: float, weigh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per source: source_size, target, whole (repetitions of all), cut_bucket and cut
    (what of the hash order is taken once more). ``sizes``: doc_id, source, size, h."""
    sources = written(weigh(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    plan = water_fill(sources, float(total), max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = written(plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    bucket = F.floor(F.col("h") / WIDTH).alias("bucket")
    sums = sizes.groupBy("source", bucket).agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    p = plan.select(F.col("source").alias("p_source"), "extra")
    edge = (sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
            .join(p, F.col("source").eqNullSafe(F.col("p_source")))
            .filter("before <= extra and extra < upto").select("p_source", "bucket", "before", "extra"))
    edge = written(edge, "edges")  # a row per source at most
    inside = (sizes.withColumn("b", F.floor(F.col("h") / WIDTH))
              .join(edge, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("b") == F.col("bucket")))
              .groupBy("p_source", "bucket", "before", "extra", F.struct("h", "doc_id", "size").alias("at"))
              .agg(F.sum("size").alias("n")))
    sofar = F.sum("n").over(Window.partitionBy("p_source").orderBy("at"))
    cut = (inside.withColumn("mid", F.col("before") + sofar - F.col("n") / 2).filter("mid <= extra")
           .groupBy("p_source").agg(F.max("at").alias("cut")))
    edge = edge.join(cut.withColumnRenamed("p_source", "c_source"), F.col("p_source").eqNullSafe(F.col("c_source")), "left")
    edge = edge.select(F.col("p_source").alias("e_source"), F.col("bucket").alias("cut_bucket"), "cut")
    out = plan.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left")
    return written(out.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "cut_bucket", "cut"), "mix-plan")


def repeats(h: str, id_: str, size: str, prefix: str = "") -> Column:
    """How often the mix takes a document, by the plan's columns (``prefix`` before their
    names) beside the document's hash, id and size."""
    of_plan = lambda c: F.col(prefix + c)
    bucket = F.floor(F.col(h) / WIDTH)
    at = F.struct(F.col(h).alias("h"), F.col(id_).alias("doc_id"), F.col(size).alias("size"))
    more = (bucket < of_plan("cut_bucket")) | ((bucket == of_plan("cut_bucket")) & (at <= of_plan("cut")))
    return of_plan("whole") + F.when(more, 1).otherwise(0)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), seed).alias("h"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5,
        max_epochs: float = 2.0, seed: int = 17, weigh=cycle_weights) -> DataFrame:
    """A row per document: doc_id, size, source_size, target (its source's), taken."""
    sizes = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    plan = plan_mix(sizes, share, max_epochs, weigh)
    # The plan is a written table: the planner broadcasts it by its size in bytes, or else
    # shuffles, where AQE splits a hot source.
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * repeats("h", "doc_id", "size")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, weigh=cycle_weights) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken."""
    sizes = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    plan = plan_mix(sizes, share, max_epochs, weigh)
    plan = plan.select([F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    size, h, times = unused(docs, "_size", "_h", "_times")
    out = (docs.withColumn(size, size_of(F.col(text_col))).withColumn(h, hash_of(F.col(id_col), seed))
           .join(plan, F.col(source_col).eqNullSafe(F.col("_mix_p_source"))))
    out = out.withColumn(times, repeats(h, id_col, size, "_mix_").cast("int"))
    return out.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_sql(docs: str, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> str:
    """The mix in DuckDB SQL, the level in closed form: d has size, h and the columns of
    ``docs``; a row per document with ``times``, how often it is taken."""
    return f"""
WITH d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  coalesce({row_hash_sql('doc_id', seed)}, 0) AS h FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {max_epochs} * sum(size) AS cap,
        CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
      FROM d GROUP BY source),
k AS (SELECT *, ({share} * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
      FROM s WINDOW o AS (ORDER BY cap / w, source)),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT lv FROM k WHERE lv <= cap / w ORDER BY cap / w, source LIMIT 1), 1e300)) AS target FROM s),
q AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT d.source, h, doc_id, size, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT g.*, sum(n) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size) - n / 2 AS mid FROM g)
SELECT d.*, q.source_size, q.target, CAST(q.whole + CASE WHEN c.mid <= q.target - q.whole * q.source_size THEN 1 ELSE 0 END AS BIGINT) AS times
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h AND c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.size = d.size"""


SQL = f"""SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * times AS BIGINT) AS taken
FROM ({mix_sql('documents')})"""
