"""Validation (T10): cluster-by-class pivot, leaf class distribution, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tree import Tree, label


def distinct_classes(df: DataFrame, target: str) -> DataFrame:
    """The non-NULL classes of the target, sorted; one aggregation, no limit."""
    return df.select(target).filter(F.col(target).isNotNull()).distinct().orderBy(target)


def class_list(df: DataFrame, target: str) -> list:
    """The classes as a list, for the wide forms only: those have a column per class, so
    a target with very many classes belongs in the long ones (:func:`cluster_counts`)."""
    return [r[0] for r in distinct_classes(df, target).collect()]


def cluster_counts(df: DataFrame, label_col: str, target: str) -> DataFrame:
    """A11 in long form: (label, class, n), for any number of classes; NULL is a class."""
    return df.groupBy(label_col, target).agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame, label_col: str, target: str) -> tuple[DataFrame, list]:
    """:func:`cluster_counts`, collected, as a local table and with the classes in order: for the wide
    forms, whose result has a cell for each of these rows."""
    counts = cluster_counts(df, label_col, target)
    rows = counts.collect()
    return df.sparkSession.createDataFrame(rows, counts.schema), sorted({r[target] for r in rows if r[target] is not None})


def recode_class(df: DataFrame, target: str, prefix: str | None = None) -> DataFrame:
    """The class as the string ``{target}_{value}`` (a pivot column name)."""
    p = prefix if prefix is not None else f"{target}_"
    return df.withColumn(target, F.concat(F.lit(p), F.col(target).cast("string")))


def cluster_pivot(df: DataFrame, label_col: str, target: str, classes: list | None = None) -> DataFrame:
    """A11 + K1: rows per (cluster, class), one column ``{target}_{class}`` per
    class, NULL where a cluster has no row of a class; sorted by cluster.
    Rows with a NULL class are in no column. The (cluster, class) counts are pivoted, from one
    scan; without ``classes`` they are collected for the column names."""
    counts, classes = counted(df, label_col, target) if classes is None else (cluster_counts(df, label_col, target), classes)
    names = [f"{target}_{c}" for c in classes]
    return recode_class(counts, target).groupBy(label_col).pivot(target, names).agg(F.sum("n")).orderBy(label_col)


def leaf_distribution(df: DataFrame, label_col: str, target: str) -> DataFrame:
    """Per (leaf, class) the row count and its share of the leaf."""
    counts = df.groupBy(label_col, target).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(label_col).agg(F.sum("n").alias("leaf_rows"))
    return counts.join(totals, label_col).withColumn(
        "share", F.col("n") / F.col("leaf_rows").cast("double"))


def majority_class(counts: DataFrame, label_col: str, target: str) -> DataFrame:
    """Per leaf the most frequent class; ties go to the smallest class."""
    w = Window.partitionBy(label_col).orderBy(F.col("n").desc(), F.col(target).asc_nulls_last())
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        label_col, F.col(target).alias("predicted"))


def leaf_accuracy(test: DataFrame, label_col: str, target: str, fit: DataFrame | None = None) -> DataFrame:
    """Accuracy of predicting each leaf's majority class. The majority is
    fitted on ``fit`` (default: the test rows themselves, as the reference does)
    and measured on ``test``; a test leaf unseen in ``fit`` counts as a miss."""
    test_counts = test.groupBy(label_col, target).agg(F.count(F.lit(1)).alias("n"))
    fit_counts = test_counts if fit is None else fit.groupBy(label_col, target).agg(F.count(F.lit(1)).alias("n"))
    pred = majority_class(fit_counts, label_col, target)
    scored = test_counts.join(pred, label_col, "left")
    return scored.agg(
        (F.sum(F.when(F.col(target) == F.col("predicted"), F.col("n")).otherwise(0)).cast("double")
         / F.sum("n").cast("double")).alias("accuracy"),
        F.sum("n").alias("n_test"))


def validate(df: DataFrame, test: DataFrame, tree: Tree, target: str, fit: DataFrame | None = None,
             label_col: str = "cluster_id", classes: list | None = None) -> dict[str, DataFrame]:
    """The cluster x class pivot over the whole table ``df`` and the
    majority-class accuracy on ``test`` (fitted on ``fit`` or on ``test``)."""
    labelled_test = label(test, tree, label_col)
    return {
        "pivot": cluster_pivot(label(df, tree, label_col), label_col, target, classes),
        "accuracy": leaf_accuracy(labelled_test, label_col, target,
                                  None if fit is None else label(fit, tree, label_col)),
    }
