"""Exact duplicates by a persistent digest index.

The index is a table of one row per distinct text, ``(text_sha256, keep_id, batch)``,
bucketed and sorted by the digest. A batch is reduced to digests, grouped
(combined before the shuffle, so a group with a third of all rows is no hot key),
held against the index by a sort-merge anti-join that reads the index without a
shuffle, and what is new is appended. Only built-in functions run on this path.

The number of buckets and the type of the ids are stored beside the index when it is made and read
when it is opened again, in whatever session, so that its files are always read as they were
written. The catalog knows the table only while a batch is added. One batch at a time may be added.

Defined results: a null text counts as empty; only A-Z are lower-cased; of the equal
texts of one batch the largest id stays, unless the index already has the text, whose
``keep_id`` then stands, and no row of the batch is kept, the same row offered again included; a null id is smaller than any other; rows that repeat both the
id and the text of the row that stays are all marked kept by :meth:`DigestIndex.add`,
and :func:`keep_one` keeps one of them; an empty batch gives an empty result; columns
other than id and text, whatever their names, play no part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_path, table, unused, written


def _index_file(spark: SparkSession, path: str):
    """What describes the index at ``path``, on the store that holds it (hidden from Spark's readers)."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_index.json")
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


class DigestIndex:
    """A digest table at ``path``; an existing one is opened with the buckets and the id type it was made with, else
    an empty one is made with these. Opening with others than the stored ones is an error, and so
    is a folder that holds files but no description."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str | None = None):
        self.spark, self.path = spark, path
        store, at = _index_file(spark, path)
        if store.exists(at):
            stream = store.open(at)
            stored = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            for name, asked in (("buckets", buckets), ("id_type", id_type)):
                if asked is not None and asked != stored[name]:
                    raise ValueError(f"the index at {path} has {name} {stored[name]}, not {asked}")
        else:
            if store.exists(at.getParent()) and len(store.listStatus(at.getParent())):
                raise ValueError(f"{path} holds files, but no index description")
            stored = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "id_type": id_type or "bigint"}
            stream = store.create(at, False)
            stream.write(bytearray(json.dumps(stored).encode()))
            stream.close()
        self.buckets, self.id_type = stored["buckets"], stored["id_type"]

    @contextmanager
    def _table(self) -> Iterator[str]:
        """The catalog's name for the index, as long as it is needed."""
        name = f"sylva_digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (text_sha256 STRING, keep_id {self.id_type}, batch STRING) USING parquet "
                       f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")      # its files stay

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"text_sha256 string, keep_id {self.id_type}, batch string").parquet(self.path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch. Returns a row per row of it: id, keep_id, group_size (rows of the
        batch with this text), kept, text_sha256."""
        digests = written(docs.select(F.col(id_col).alias("doc_id"),
                                      F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256")), "digests")
        # Written: the optimiser would move the anti-join below the grouping, where a hot text is not yet one row.
        groups = written(digests.groupBy("text_sha256").agg(F.max("doc_id").alias("max_id"),
                                                            F.count(F.lit(1)).alias("group_size")), "groups")
        with self._table() as name:
            fresh = groups.join(self.spark.table(name).hint("merge"), "text_sha256", "left_anti")
            fresh.select("text_sha256", "max_id", F.lit(name)).repartition(self.buckets, "text_sha256").write.insertInto(name)
            self.spark.catalog.refreshTable(name)
            # Written: the join below then shuffles both sides, so that AQE can split a hot group.
            standing = written(groups.join(self.spark.table(name).hint("merge"), "text_sha256")
                               .select("text_sha256", "keep_id", "group_size", (F.col("batch") == name).alias("new")), "standing")
        return digests.join(standing, "text_sha256").select(
            "doc_id", "keep_id", "group_size", (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def new_index(docs: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DigestIndex:
    """An index for the ids of ``docs``: the one at ``path`` if there is one."""
    spark = docs.sparkSession
    return DigestIndex(spark, path or shared_path(spark, "digest-index"), id_type=docs.schema[id_col].dataType.simpleString())


def keep_one(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is neither in the index nor in a row
    with a larger id; of repeated rows one. The batch's texts join the index."""
    sha, = unused(docs, "text_sha256")
    stay = (index.add(docs, id_col, text_col).filter("kept")
            .select(F.col("text_sha256").alias("_k_sha"), F.col("doc_id").alias("_k_id")).distinct())
    withsha = docs.withColumn(sha, F.sha2(ascii_lower(F.col(text_col)), 256))
    # Keyed by digest and id: the copies of a hot text spread over all partitions.
    out = withsha.join(stay, (withsha[sha] == stay["_k_sha"]) & withsha[id_col].eqNullSafe(stay["_k_id"]), "left_semi")
    return out.dropDuplicates([sha, id_col]).drop(sha)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return new_index(docs).add(docs)


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
             AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)"""
