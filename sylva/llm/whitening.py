"""Whitening of embeddings by the leading eigenvectors of their covariance, found by contour
integration (FEAST).

Entries become integers, so that counts, sums and the covariance come out the same however
rows are dealt: the tasks add up products of integers taken from a mean rounded to integers, and the
driver puts the rest of the mean right in whole numbers before it divides. What comes to the driver
is one matrix of the dimension, whatever the number of rows.

The spectrum is cut into intervals of a few eigenvalues by inertia counts (a symmetric
indefinite factorisation of V - s I tells how many eigenvalues lie above s). In an interval the
projector on its eigenvectors is a contour integral of the resolvent, taken by Gauss-Legendre
quadrature: complex shifted solves with V applied to a block of vectors. A Rayleigh-Ritz step in the
projected block gives the eigenpairs, which start the next turn. An interval is done when its
residuals are at rounding level and it holds as many eigenvalues as the inertia counts say; else
its block grows. A last Rayleigh-Ritz step over all intervals makes close neighbours of two of them
orthogonal.

Defined results: vectors that are null, empty, of another dimension than most (ties: the larger), or that hold
null or non-finite entries, or entries too large for an exact integer (2^49 after scaling), take no
part; directions whose variance is below 1e-11 of the largest one's bound are no components (vectors all
alike have none, and give no rows); equal eigenvalues span the same space by any basis; repeated
rows and null ids count and give rows each; a deviation beyond a long is null; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LARGEST = float(1 << 49)
TINY = 1e-11


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are greater than ``shift``: the positive ones
    of D in L D L' = v - shift I, with pivots of one or two rows (Bunch-Parlett)."""
    a, n = v - shift * np.eye(len(v)), 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal().copy()
        np.fill_diagonal(size, 0)
        one, pair = int(diagonal.argmax()), np.unravel_index(size.argmax(), size.shape)
        if diagonal[one] == 0 and size[pair] == 0:
            break
        if diagonal[one] >= 0.64 * size[pair]:
            rest = np.delete(np.arange(len(a)), one)
            column, d = a[rest, one], a[one, one]
            n += d > 0
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / d
        else:
            pair = list(pair)
            rest = np.delete(np.arange(len(a)), pair)
            columns = a[np.ix_(rest, pair)]
            n += 1      # such a pivot has one eigenvalue of either sign
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
    return int(n)


def intervals(v: np.ndarray, wanted: int, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that hold the ``wanted`` largest eigenvalues
    and no more than ``most`` each, but for clusters too narrow to cut."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    if top <= 0:
        return []
    low = TINY * top
    open_, out = [(low, top, above(v, low), 0)], []
    while open_:
        lo, hi, n_lo, n_hi = open_.pop()
        if n_lo == n_hi or n_hi >= wanted:
            continue
        wide = lo < hi / 16     # a contour so near to 0 tells its inside badly from what lies there
        if n_lo - n_hi <= most and not wide or hi - lo <= 1e-9 * hi:
            out.append((lo, hi, n_lo - n_hi))
            continue
        mid = max(lo, hi / 16) if wide else (lo + hi) / 2
        n_mid = above(v, mid)
        open_ += [(lo, mid, n_lo, n_mid), (mid, hi, n_mid, n_hi)]
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int, points: int = 8, turns: int = 40,
          seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenpairs of ``v`` in (low, high): values and unit columns."""
    d = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(points)
    around = radius * np.exp(0.5j * np.pi * (x + 1))        # the upper half; the lower is its mirror image
    tolerance = 8 * np.finfo(float).eps * np.sqrt(d) * float(np.abs(v).sum(axis=1).max())
    block = min(d, max(inside + 4, 3 * inside // 2))
    while True:
        y = np.random.default_rng(seed).standard_normal((d, block))
        for turn_left in reversed(range(turns)):
            q = sum(0.5 * wi * (zi * np.linalg.solve((centre + zi) * np.eye(d) - v, y)).real for wi, zi in zip(w, around))
            q = np.linalg.qr(q)[0]
            values, turn = np.linalg.eigh(q.T @ v @ q)
            y = q @ turn
            own = np.flatnonzero((values > low) & (values <= high))
            if len(own) < inside:
                continue
            gap = np.linalg.norm(v @ y[:, own] - y[:, own] * values[own], axis=0)
            gap = np.sort(gap)[inside - 1]      # what else is inside is no eigenvalue yet
            if len(own) == inside and gap <= tolerance * (1 if turn_left else 1e3):
                return values[own], y[:, own]
        if block == d:
            raise ArithmeticError(f"{inside} eigenvalues lie in ({low}, {high}] by inertia, {len(own)} were found")
        block = min(d, 2 * block)


def leading(v: np.ndarray, wanted: int, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of ``v``, falling, and their unit eigenvectors as
    columns (largest entry positive)."""
    parts = [feast(v, lo, hi, n) for lo, hi, n in intervals(v, wanted, most)]
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    q = np.linalg.qr(np.column_stack([x for _, x in parts]))[0]
    values, turn = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    x = q @ turn[:, order]
    return values[order], x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, v as doubles, and their dimension (0: none)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    most = (LARGEST - abs(offset)) / abs(scale)
    out = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(
        F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most)), F.lit(False)) & (F.size("v") > 0))
    size = out.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = size["d"] if size else 0
    return out.filter(F.size("v") == d), d


class Integers:
    """The integers that entries stand for, less those of ``base`` (nothing at first)."""

    def __init__(self, d: int, scale: float, offset: int):
        self.d, self.scale, self.base = d, scale, np.full(d, -offset, "i8")

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column(batch.schema.get_field_index("v"))
        return np.floor(v.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.d) * self.scale).astype("i8") - self.base


def summed(rows: DataFrame, run, keys: str, value: str) -> pd.DataFrame:
    """What tasks yield as (keys..., value), added up by keys: not more rows than the square of the dimension."""
    names = [k.split()[0] for k in keys.split(", ")]
    return rows.mapInArrow(run, f"{keys}, value {value}").groupBy(*names).agg(F.sum("value").alias("value")).toArrow().to_pandas()


def triangle(products: np.ndarray, **more) -> pa.RecordBatch:
    i, j = np.triu_indices(len(products))
    return pa.RecordBatch.from_pydict({"i": i.astype("i4"), "j": j.astype("i4"), "value": products[i, j]})


def full(parts: pd.DataFrame, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[parts["i"], parts["j"]] = out[parts["j"], parts["i"]] = parts["value"]
    return out


class Basis:
    """The fit: row count, exact sums, and the components."""

    def __init__(self, rows: DataFrame, d: int, components: int, scale: float, offset: int):
        self.cells = cells = Integers(d, scale, offset)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:       # a batch's sums fit in a long
                total = np.append(cells.of(b).sum(axis=0), b.num_rows)
                yield pa.RecordBatch.from_pydict({"i": np.arange(d + 1, dtype="i4"), "value": total})

        total = rows.mapInArrow(sums, "i int, value bigint").groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
        total = {r["i"]: int(r["s"]) for r in total.collect()}     # d + 1 rows
        self.n = n = total[d]
        mean = [(2 * total[i] + n) // (2 * n) for i in range(d)]    # rounded
        self.rest = [total[i] - n * mean[i] for i in range(d)]      # what the sums are more than n rounded means
        cells.base = cells.base + np.array(mean, "i8")

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((d, d))
            for b in batches:
                z = cells.of(b).astype("f8")
                out += z.T @ z      # whole numbers, exact up to 2^53
            yield triangle(out)

        m = full(summed(rows, products, "i int, j int", "double"), d)
        rest = self.rest
        v = np.array([[(n * int(m[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
        self.values, self.vectors = leading(v, min(components, d))
        self.explained = self.values / v.trace() if len(self.values) else self.values
        self.project = self.vectors / np.sqrt(self.values)
        self.identity_error = self._identity_error(rows) if len(self.values) else 0.0

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z - np.array(self.rest, "f8") / self.n) @ self.project

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """The squared lengths of n x - S, in whole numbers."""
        far = self.n * float(np.abs(z).max(initial=0)) + max(map(abs, self.rest))
        exact = far * far * len(self.rest) < 2.0**62
        y = z * self.n - np.array(self.rest, "i8") if exact else z.astype(object) * self.n - np.array(self.rest, object)
        return [int(s) if s < 1 << 63 else None for s in (y * y).sum(axis=1)]

    def _identity_error(self, rows: DataFrame) -> float:
        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k + 1, k + 1))
            for b in batches:
                w = self.whitened(self.cells.of(b))
                w = np.column_stack([w, np.ones(len(w))])
                out += w.T @ w
            yield triangle(out)

        k = len(self.values)
        m = full(summed(rows, products, "i int, j int", "double"), k + 1) / self.n
        return float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           scale: float = 1 << 20, offset: int = 0) -> DataFrame:
    """A row per vector and component: vec_id, component (1: most variance), n, deviation, whitened,
    explained, identity_error. An entry c stands for floor(scale c) + offset."""
    spark = vectors.sparkSession
    rows, d = usable(vectors, id_col, vector_col, scale, offset)
    id_type = rows.schema["id"].dataType.simpleString()
    if not d:
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, "
                                         "explained double, identity_error double")
    basis = Basis(rows, d, components, scale, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = basis.cells.of(b)
            w = basis.whitened(z)
            starts = np.arange(len(w) + 1, dtype="i4") * w.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(basis.deviations(z), pa.int64()),
                                              pa.ListArray.from_arrays(starts, np.ascontiguousarray(w).ravel())],
                                             names=["vec_id", "deviation", "w"])

    out = rows.mapInArrow(run, f"vec_id {id_type}, deviation bigint, w array<double>")
    explained = F.array(*[F.lit(float(e)) for e in basis.explained]) if len(basis.explained) else F.array().cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(basis.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(basis.identity_error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), scale=64, offset=1_000_000)
