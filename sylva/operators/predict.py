"""Multi-tree prediction.

Each labelling function (a tree) yields a class-probability matrix: one row per
label, one column per class with P(class | label). The matrices have one row per
leaf, so they are bounded by the trees (not the data), and all are read off one
cube of row counts by (labels, class). The per-row score of a class is the product of its
probabilities over all labels, normalised over the classes, and the prediction
is the first class reaching the row maximum. A row's prediction depends on its
cell of the cube alone, so the accuracy needs no row stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tree import Tree, add_labels
from .validate import cluster_counts, counted


def class_col(target: str, c) -> str:
    return f"{target}_{c}"


def predictive_matrix(df: DataFrame, label_col: str, target: str, classes: list | None = None,
                      sort: bool = True) -> DataFrame:
    """P(class | label) per label, one column ``{target}_{class}``; a class
    never seen with a label is NULL. One aggregation (sorted by label for a
    report; unsorted when it only feeds the predictor). Without ``classes`` the (label, class) counts are
    collected, which the matrix has no fewer cells than: the classes come with them, not from a second scan."""
    cells, classes = counted(df, label_col, target) if classes is None else (cluster_counts(df, label_col, target), classes)
    m = matrices_of_cells(cells, [label_col], target, classes)[label_col]
    return m.orderBy(label_col) if sort else m


def predictive_matrix_long(df: DataFrame, label_col: str, target: str) -> DataFrame:
    """A12 in long form: (label, class, p) for any number of classes, classes seen with the
    label only. Rows without a class count in the label's total, as in the wide form."""
    counts = cluster_counts(df, label_col, target)
    totals = counts.groupBy(F.col(label_col).alias("_label")).agg(F.sum("n").alias("_rows"))
    joined = counts.join(totals, F.col(label_col).eqNullSafe(F.col("_label"))).filter(F.col(target).isNotNull())
    return joined.select(label_col, target, (F.col("n").cast("double") / F.col("_rows").cast("double")).alias("p"))


def _labelled(frame: DataFrame, labels: dict[str, "Tree | Column | None"]) -> DataFrame:
    cols = [fn.alias(name) for name, fn in labels.items() if fn is not None and not isinstance(fn, Tree)]
    out = frame.select("*", *cols) if cols else frame
    return add_labels(out, {name: fn for name, fn in labels.items() if isinstance(fn, Tree)})


def label_cells(df: DataFrame, labels: dict[str, "Tree | Column | None"], target: str) -> DataFrame:
    """The contingency cube of all labels and the class: (label..., class, n), from one scan. Every
    matrix, every prediction and the accuracy depend on a row through its cell alone."""
    return _labelled(df, labels).groupBy(*labels, target).agg(F.count(F.lit(1)).alias("n"))


def matrices_of_cells(cells: DataFrame, names: list[str], target: str, classes: list) -> dict[str, DataFrame]:
    """A12 of every label, read off the cube: all share its one aggregation."""
    total = F.sum("n").cast("double")
    cols = [F.try_divide(F.sum(F.when(F.col(target) == F.lit(c), F.col("n"))).cast("double"), total).alias(class_col(target, c)) for c in classes]
    return {name: cells.groupBy(name).agg(*cols) for name in names}


def _scored(frame: DataFrame, names: list[str], mats: dict[str, DataFrame], target: str, classes: list, keep: list[str]) -> DataFrame:
    """E1-E5 for rows or cells that carry all labels: (keep..., class, a score per class, max, predict)."""
    out = frame.select(*keep, target, *names)
    for i, name in enumerate(names):
        m = mats[name].select(name, *[F.col(class_col(target, c)).alias(f"_p{i}_{j}") for j, c in enumerate(classes)])
        out = out.join(m, name)                             # J2
    scores = {c: reduce(lambda a, b: a * b, [F.col(f"_p{i}_{j}") for i in range(len(names))])  # E2
              for j, c in enumerate(classes)}
    magnitude = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores.values()])  # E1, E3
    normed = out.select(*keep, F.col(target), *[F.try_divide(s, magnitude).alias(class_col(target, c))  # E4
                                                for c, s in scores.items()])
    mx = F.greatest(*[F.coalesce(F.col(class_col(target, c)), F.lit(0.0)) for c in classes]) if len(classes) > 1 else F.coalesce(
        F.col(class_col(target, classes[0])), F.lit(0.0))                                       # E5 / U1
    normed = normed.withColumn("max", mx)
    pred = None
    for c in reversed(classes):
        hit = F.col(class_col(target, c)) == F.col("max")
        pred = F.when(hit, F.lit(c)) if pred is None else F.when(hit, F.lit(c)).otherwise(pred)
    return normed.withColumn("predict", pred)


def predict(df: DataFrame, labels: dict[str, "Tree | Column | None"], target: str, classes: list,
            matrices: dict[str, DataFrame] | None = None, fit: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """Per row the ``keys`` columns, the class column, one normalised score per class, ``max``
    and ``predict``.

    ``labels`` maps a label column name to its tree (or column, or None when the
    column is already on ``df``). Matrices come from ``matrices`` or are fitted
    on ``fit`` (default: ``df`` itself, the in-sample form of the reference), all off one
    cube. A row whose label is missing from a matrix is dropped (inner join; the planner
    broadcasts a matrix, of one row per label, where its size allows).
    """
    names, mats = list(labels), dict(matrices or {})
    if any(n not in mats for n in names):
        mats = matrices_of_cells(label_cells(df if fit is None else fit, labels, target), names, target, classes) | mats
    return _scored(_labelled(df, labels), names, mats, target, classes, list(keys))


def forest_accuracy(df: DataFrame, labels: dict[str, "Tree | Column | None"], target: str, classes: list,
                    fit: DataFrame | None = None) -> DataFrame:
    """A18 without a prediction per row: each cell of the cube is predicted once and counts with its
    rows. One scan (two with ``fit``)."""
    names, cells = list(labels), label_cells(df, labels, target)
    fitted = cells if fit is None else label_cells(fit, labels, target)
    scored = _scored(cells, names, matrices_of_cells(fitted, names, target, classes), target, classes, ["n"])
    return _accuracy(scored, target, F.col("n"))


def _accuracy(predictions: DataFrame, target: str, weight: Column) -> DataFrame:
    hits = F.coalesce(F.sum(F.when(F.col(target) == F.col("predict"), weight)), F.lit(0)).cast("bigint")
    counted = F.coalesce(F.sum(F.when(F.col("predict").isNotNull(), weight)), F.lit(0)).cast("bigint")
    return predictions.agg(hits.alias("hits"), counted.alias("_counted")).select(
        F.try_divide(F.col("hits").cast("double"), F.col("_counted").cast("double")).alias("accuracy"), "hits",
        (F.col("_counted") - F.col("hits")).alias("misses"))


def accuracy(predictions: DataFrame, target: str) -> DataFrame:
    """Hits / (hits + misses); rows without a prediction are in neither."""
    return _accuracy(predictions, target, F.lit(1))
