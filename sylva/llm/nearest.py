"""Nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the
largest norm (0 for queries), and all vectors are turned by one seeded rotation, so that
the first components of a difference tell about all. Centres are fitted on a bounded
sample; every vector goes to the list of its nearest centre, and a query probes the lists
of its nearest centres. In a list, partial squared distances grow by blocks of columns;
after each block a candidate is abandoned when (a hypothesis test on the share of the
columns seen) it can't be among the query's nearest. What is left is measured exactly,
in double precision, on the original vectors.

Lists are dealt in slices of bounded size, candidates and queries alike, so a hot list
(one vector repeated in a third of all rows) spreads over tasks.

Defined results: vectors that are null, zero, of another dimension than most, or that hold
null or non-finite components take no part, nor does a null id; rows that repeat an id are
candidates each; a query's own id is no candidate; ties go to the smaller id; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Candidates and queries of a list that meet in one task at most, about.
SLICE, QUERY_SLICE = 16_384, 2_048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    out = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.exists("v", lambda x: x != 0))
    size = out.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return out.filter(F.size("v") == (size["d"] if size else 0))


class Space:
    """The rotation, the centres and the largest norm."""

    def __init__(self, sample: np.ndarray, top: float, lists: int, seed: int):
        self.top, rng = top, np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.candidates(sample)
        lists = max(1, min(lists, len(x)))
        self.centres = x[rng.permutation(len(x))[:lists]]
        for _ in range(8):
            own = self.nearest(x, 1)[:, 0]
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=lists)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)

    def candidates(self, v: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.top**2 - (v * v).sum(axis=1), 0))
        return np.column_stack([v, more]) @ self.turn

    def queries(self, v: np.ndarray) -> np.ndarray:
        # Scaled to the largest norm: it changes no order of inner products and keeps distances comparable.
        v = v * (self.top / np.linalg.norm(v, axis=1, keepdims=True))
        return np.column_stack([v, np.zeros(len(v))]) @ self.turn

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        n = min(n, far.shape[1])
        return np.argpartition(far, n - 1, axis=1)[:, :n]


def scan(q: np.ndarray, x: np.ndarray, k: int, block: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that survive the adaptive scan of all columns. While
    many pairs are left a block of columns is one matrix product, later a sum per pair."""
    top = max(np.sqrt((q * q).sum(axis=1).max()), np.sqrt((x * x).sum(axis=1).max()))
    q, x = (q / top).astype("f4"), (x / top).astype("f4")  # no norm over 1
    d, k, slack = x.shape[1], min(k, len(x)), np.float32(1 + 1e-4)  # for single precision

    def rounding(seen: int) -> np.float32:
        """What single precision may add to or take from a distance over ``seen`` columns: a
        rounding for each column, and some for each block, of terms of 4 at most in all."""
        return np.float32(4 * (seen + 8 * -(-seen // block)) * np.finfo("f4").eps)

    def grown(lo: int, hi: int) -> np.ndarray:
        far = q[:, lo:hi] @ x[:, lo:hi].T
        far *= -2
        far += (x[:, lo:hi]**2).sum(axis=1)
        far += (q[:, lo:hi]**2).sum(axis=1)[:, None]
        return far

    def limit(seen: int) -> np.ndarray:
        """Of the distance over ``seen`` columns: the bound's share of them, and as much more as
        a test of the candidate's being nearer than the bound allows by chance."""
        share = 1 if seen >= d else seen / d * (1 + eps / np.sqrt(seen))**2
        return bound * np.float32(share) + rounding(seen)

    part, hi = grown(0, min(block, d)), min(block, d)
    # The bound: the k-th of whole distances to the candidates that look nearest so far.
    seem = np.argpartition(part, k - 1, axis=1)[:, :k]
    bound = ((q[:, None, :] - x[seem])**2).sum(axis=2).max(axis=1) * slack + rounding(d)
    while True:
        left = part <= limit(hi)[:, None]
        if hi >= d or np.count_nonzero(left) * 8 < left.size:
            break
        lo, hi = hi, min(hi + block, d)
        part += grown(lo, hi)
    qi, xi = np.nonzero(left)
    at = part[qi, xi]
    for lo in range(hi, d, block):
        hi = min(lo + block, d)
        for s in range(0, len(qi), 1 << 18):
            own = slice(s, s + (1 << 18))
            at[own] += ((q[qi[own], lo:hi] - x[xi[own], lo:hi])**2).sum(axis=1)
        left = at <= limit(hi)[qi]
        qi, xi, at = qi[left], xi[left], at[left]
    return qi, xi


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           lists: int = 64, probes: int = 44, sample: int = 20_000, block: int = 16, eps: float = 2.1, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found. ``is_query``: a column
    of ``id``. ``sample`` bounds the rows on which the centres are fitted; all rows are indexed."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    top = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    id_type = rows.schema["id"].dataType.simpleString()
    out = f"query_id {id_type}, vec_id {id_type}, score double"
    if top is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    fitted = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()])
    space = spark.sparkContext.broadcast(Space(fitted, top, lists, seed))

    def assign(n: int, as_query: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = space.value
            for f in frames:
                v = np.stack(f["v"].to_numpy()) if len(f) else np.zeros((0, s.turn.shape[0] - 1))
                own = s.nearest(s.queries(v) if as_query else s.candidates(v), n)
                f["lists"] = list(own.astype("i4"))
                yield f
        return run

    schema = f"id {id_type}, v array<double>, lists array<int>"
    home = rows.mapInPandas(assign(1, False), schema).select("id", "v", F.col("lists")[0].alias("list"))
    asked = rows.filter(is_query).mapInPandas(assign(probes, True), schema).select("id", "v", F.explode("lists").alias("list"))
    home, asked = written(home, "lists"), written(asked, "probes")
    # As many slices as a list's members ask for; at most ``lists`` rows.
    slices = {r["list"]: max(1, -(-r["n"] // SLICE)) for r in home.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = {r["list"]: max(1, -(-r["n"] // QUERY_SLICE)) for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}

    def times(of: dict[int, int]):
        return F.coalesce(F.element_at(F.array(*[F.lit(of.get(i, 1)) for i in range(max(slices) + 1)]), F.col("list") + 1), F.lit(1))

    pick = F.pmod(F.xxhash64("id", "list"), F.col("of")).cast("int")
    here = (home.withColumn("of", times(slices)).withColumn("slice", pick)
            .withColumn("ask", F.explode(F.sequence(F.lit(0), times(asks) - 1))).select("id", "v", "list", "slice", "ask"))
    there = (asked.filter(F.col("list") <= max(slices)).withColumn("of", times(asks)).withColumn("ask", pick)
             .withColumn("slice", F.explode(F.sequence(F.lit(0), times(slices) - 1))).select("id", "v", "list", "slice", "ask"))

    def meet(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s, v = space.value, np.stack(found["v"].to_numpy())
        x, ids = s.candidates(v), found["id"].to_numpy()
        parts = []
        for lo in range(0, len(queries), 128):
            part = queries.iloc[lo:lo + 128]
            w, own = np.stack(part["v"].to_numpy()), part["id"].to_numpy()
            qi, xi = scan(s.queries(w), x, k + 1, block, eps)
            other = own[qi] != ids[xi]
            qi, xi = qi[other], xi[other]
            score = np.einsum("ij,ij->i", w[qi], v[xi])
            order = np.lexsort((ids[xi], -score, qi))
            qi, xi, score = qi[order], xi[order], score[order]
            start = np.searchsorted(qi, np.arange(len(part)))
            near = np.arange(len(qi)) - start[qi] < k
            parts.append(pd.DataFrame({"query_id": own[qi[near]], "vec_id": ids[xi[near]], "score": score[near]}))
        return pd.concat(parts)

    keys = ["list", "slice", "ask"]
    found = there.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInPandas(meet, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
