"""Quality by voting of nearest labelled neighbours in a latent-semantic space.

Terms are hashed byte trigrams and a few bins of the text's shape (case, punctuation,
repetition, length). Document frequencies are counted over all documents. A bounded,
seeded sample of the labelled rows (``references``) gives the latent space, a truncated
SVD, and the voters: their unit vectors are sent to all tasks (``references`` x ``rank``
floats, 1.5 MB at the defaults) and every document is held against all of them in exact
blocked cosine products. The score is the neighbours' labels weighted by similarity.

Defined results: a null text counts as empty, and every text has shape terms, so that an
empty one has a vector too; a document with several label rows counts by the largest;
null labels don't teach; without any labelled row every score is 0.5; repeated rows give
a row each; an empty table gives an empty result. Ids and other columns are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, table, unused

TRIGRAMS = 2048
BINS = 8
SHAPES = 6
TERMS = TRIGRAMS + BINS * SHAPES


def term_weights(text: str | None) -> np.ndarray:
    """Sublinear frequencies of a whole text's terms."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, "f4")
    a = np.frombuffer(data, "u1").astype("u4")
    if len(a) > 2:
        code = ((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(2654435761)
        out[:TRIGRAMS] = np.log1p(np.bincount(code >> np.uint32(21), minlength=TRIGRAMS))
    words = data.split()
    n, letters = max(1, len(a)), max(1, int(((a | 32) - 97 < 26).sum() + (a > 127).sum()))
    other = int(((a > 32) & (a < 128)).sum() - ((a | 32) - 97 < 26).sum())
    again = sum(x == y for x, y in zip(words, words[1:]))
    shape = (int((a - 65 < 26).sum()) / letters, other / n * 3, len(set(words)) / max(1, len(words)), again / max(1, len(words)) * 2,
             len(a) / max(1, len(words)) / 16, np.log2(n) / 20)
    for k, x in enumerate(shape):  # each value lights two neighbouring bins
        x = min(max(x, 0.0), 1.0) * (BINS - 1)
        lo = min(int(x), BINS - 2)
        out[TRIGRAMS + k * BINS + lo] = 4 * (1 - (x - lo))
        out[TRIGRAMS + k * BINS + lo + 1] = 4 * (x - lo)
    return out


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n = np.zeros(TERMS, "i8"), 0
    for f in frames:
        for t in f["text"]:
            df += term_weights(t) > 0
        n += len(f)
    yield pd.DataFrame({"term": np.arange(-1, TERMS), "n": np.concatenate([[n], df])})


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"label": f["label"], "terms": [term_weights(t).astype("f2").tobytes() for t in f["text"]]})


class Voters:
    """The latent space of labelled term vectors and the labelled unit vectors in it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, idf: np.ndarray, rank: int, neighbours: int, seed: int):
        self.idf, self.labels, self.k = idf, labels.astype("f4"), min(neighbours, len(labels))
        if not len(labels):
            return
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        rank = min(rank, len(x))
        q = np.linalg.qr(x @ rng.standard_normal((TERMS, rank + 16)).astype("f4"))[0]
        for _ in range(3):  # randomised SVD by power iterations
            q = np.linalg.qr(x @ (x.T @ q))[0]
        _, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        self.space = np.ascontiguousarray(vt[:rank].T)
        self.units = np.ascontiguousarray(self._unit(x @ self.space).T)

    def _weighed(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of a block of term vectors."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        cos = self._unit(self._weighed(x) @ self.space) @ self.units
        near = np.argpartition(-cos, self.k - 1, axis=1)[:, : self.k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype("f8") ** 4
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        references: int = 4096, rank: int = 96, neighbours: int = 15, seed: int = 5) -> Voters:
    """``labels``: the rows to learn from. ``references`` bounds the labelled rows used, those
    whose ids have the lowest hashes; document frequencies are of all ``docs``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    count = texts.select("text").mapInPandas(_frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(TERMS), 0
    for r in count:  # TERMS rows
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    taught = (labels.select(F.col(id_col).alias("lid"), F.col(label_col).alias("label")).filter("lid is not null and label is not null")
              .groupBy("lid").agg(F.max("label").alias("label")))
    chosen = taught.join(texts.select(F.col("id").alias("lid")).distinct(), "lid", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("lid", F.lit(seed)), "lid").limit(references)
    rows = (texts.join(F.broadcast(chosen), texts["id"] == chosen["lid"]).dropDuplicates(["id"])  # at most ``references`` rows
            .mapInPandas(_vectors, "label int, terms binary").collect())
    x = np.frombuffer(b"".join(r["terms"] for r in rows), "f2").reshape(-1, TERMS).astype("f4")
    idf = np.log((n + 1) / (df + 1)).astype("f4") + 0.05
    return Voters(x, np.array([r["label"] for r in rows], "f4"), idf, rank, neighbours, seed)


def classify(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted, named so that they clash with no column of theirs."""
    score, predicted = unused(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for t in texts:
            parts = [own.score(np.stack([term_weights(x) for x in t.iloc[lo:lo + 256]])) for lo in range(0, len(t), 256)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="f8")

    return docs.withColumn(score, scored(F.col(text_col))).withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    voters = fit(docs, labels.filter(id_remainder("doc_id", 5) != 0))
    return classify(docs.select("doc_id", "text"), voters).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
