"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (lower-cased, controls as blanks) that it holds,
hashed to ``GRAMS`` bins; a bin counts once however often it occurs, so that one insult tells the
same in a short and in a very long text. Every labelled document of the learning rows is
counted: the ratio of a bin is

    r = log((p + s P / N) / (P + s)) - log((q + s Q / N) / (Q + s))

with p of P toxic and q of Q other documents holding it, N = P + Q, smoothed towards r = 0. A
logistic regression on the features times their ratios is then fitted by L-BFGS; it sees
``sample`` of the learning rows (a documented bound, those whose ids have the lowest hashes).
The score of a text is the regression's probability; the product of weights and ratios,
``GRAMS`` floats (1 MB), is all that a task needs.

Defined results: a null text counts as empty, whose score is the one of no features; a document with
several label rows counts by the largest label, one with several texts teaches by each in the
counts and by the greatest in the regression; null labels don't teach; if the learning rows don't hold
both classes every score is the share of toxic ones (0.5 without any); repeated rows give a row each; an
empty table gives an empty result; whole texts are read, very long ones in pieces; ids and other
columns, whatever their names, are no inputs and are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, table, unused

BITS = 18
GRAMS = 1 << BITS
SIZES = (2, 3, 4, 5)
#: Characters of a text that are hashed at a time.
PIECE = 1 << 20
#: Features of examples that the regression holds against its weights at a time.
BLOCK = 1 << 20
BASE, SPREAD = np.uint32(1000003), np.uint32(2654435761)


def bins(text: str | None) -> np.ndarray:
    """The bins of a whole text's character n-grams, each once, ascending."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "u4")
    seen = np.zeros(GRAMS, bool)
    for lo in range(0, len(chars), PIECE):
        a = np.maximum(chars[lo:lo + PIECE + SIZES[-1] - 1], 32)
        rolling = a
        for n in range(2, SIZES[-1] + 1):
            if len(a) < n:
                break
            rolling = rolling[:-1] * BASE + a[n - 1:]
            if n in SIZES:
                seen[((rolling ^ np.uint32(n)) * SPREAD) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype("i4")


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bin, toxic and other documents that hold it); bin -1: all documents."""
    n = np.zeros((2, GRAMS), "i8")
    rows = np.zeros(2, "i8")
    for f in frames:
        for text, label in zip(f["text"], f["label"]):
            n[int(label), bins(text)] += 1
            rows[int(label)] += 1
    some = np.flatnonzero(n.any(axis=0))
    yield pd.DataFrame({"bin": np.concatenate([[-1], some]), "toxic": np.concatenate([rows[1:], n[1, some]]),
                        "other": np.concatenate([rows[:1], n[0, some]])})


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"label": f["label"], "bins": [bins(t).tobytes() for t in f["text"]]})


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, smooth: float) -> np.ndarray:
    share = n_toxic / (n_toxic + n_other)
    return (np.log((toxic + smooth * share) / (n_toxic + smooth))
            - np.log((other + smooth * (1 - share)) / (n_other + smooth)))


def lbfgs(loss, x: np.ndarray, steps: int = 100, memory: int = 10, tolerance: float = 1e-5) -> np.ndarray:
    """The minimum of a smooth convex function; ``loss(x)`` is (value, gradient)."""
    value, grad = loss(x)
    past = []
    for _ in range(steps):
        if np.abs(grad).max() < tolerance:
            break
        step, dots = -grad, []
        for s, y, sy in reversed(past):
            dots.append(s @ step / sy)
            step = step - dots[-1] * y
        if past:
            s, y, sy = past[-1]
            step = step * (sy / (y @ y))
        for (s, y, sy), a in zip(past, reversed(dots)):
            step = step + (a - y @ step / sy) * s
        size = 1.0 if past else min(1.0, 1 / np.abs(grad).sum())
        slope = grad @ step
        while True:     # halved until the value falls enough
            new_value, new_grad = loss(x + size * step)
            if new_value <= value + 1e-4 * size * slope or size < 1e-12:
                break
            size /= 2
        s, y = size * step, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory:], (s, y, s @ y)]
        if value - new_value <= 1e-9 * abs(value):
            return x + s if new_value < value else x
        x, value, grad = x + s, new_value, new_grad
    return x


class Weights:
    """weight x ratio of every bin, and the intercept."""

    def __init__(self, ratios: np.ndarray, examples: list[np.ndarray], labels: np.ndarray, ridge: float):
        lengths = np.array([len(e) for e in examples], "i8")
        ends = np.cumsum(lengths)
        flat = np.concatenate(examples)
        used = np.flatnonzero(np.bincount(flat, minlength=GRAMS))
        number = np.zeros(GRAMS, "i4")
        number[used] = np.arange(len(used), dtype="i4")
        flat, scale = number[flat], ratios[used]
        # Examples are taken in blocks, so that the passes need little besides their features.
        cuts = [0, *np.unique(np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK), "right")), len(examples)]
        blocks = [(lo, hi, slice(ends[lo] - lengths[lo], ends[hi - 1])) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]

        def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
            w, b = p[:-1], p[-1]
            value, grad, off_sum, scaled = ridge / 2 * (w @ w), np.zeros(len(used)), 0.0, w * scale
            for lo, hi, own in blocks:
                of, y = np.repeat(np.arange(hi - lo), lengths[lo:hi]), labels[lo:hi]
                margin = np.bincount(of, weights=scaled[flat[own]], minlength=hi - lo) + b
                value += np.logaddexp(0, np.where(y > 0, -margin, margin)).sum() / len(labels)
                off = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) / len(labels)
                grad += np.bincount(flat[own], weights=off[of], minlength=len(used))
                off_sum += off.sum()
            return value, np.append(grad * scale + ridge * w, off_sum)

        share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
        best = lbfgs(loss, np.append(np.zeros(len(used)), np.log(share / (1 - share))))
        self.bin = np.zeros(GRAMS, "f4")
        self.bin[used] = best[:-1] * scale
        self.intercept = float(best[-1])

    def score(self, text: str | None) -> float:
        margin = self.intercept + float(self.bin[bins(text)].sum(dtype="f8"))
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


class Share:
    """What is known without examples of both classes: one share for every text."""

    def __init__(self, share: float):
        self.share = share

    def score(self, text: str | None) -> float:
        return self.share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = 4096, smooth: float = 1.0, ridge: float = 1e-2, seed: int = 12) -> Weights | Share:
    """``labels``: the rows to learn from, label 1 toxic, any other label not. ``sample`` bounds the
    rows of the regression; the ratios count all."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taught = (labels.select(F.col(id_col).alias("lid"), F.col(label_col).alias("label")).filter("lid is not null and label is not null")
              .groupBy("lid").agg(F.max((F.col("label") == 1).cast("int")).alias("label")))
    # By a shuffle at every size: the labels grow with the documents.
    known = texts.join(taught.hint("merge"), texts["id"] == taught["lid"])
    counted = (known.select("text", "label").mapInPandas(_counts, "bin int, toxic bigint, other bigint")
               .groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow().to_pandas())   # GRAMS rows at most
    n_toxic, n_other = (int(counted.loc[counted["bin"] < 0, c].sum()) for c in ("toxic", "other"))
    if not n_toxic or not n_other:
        return Share(n_toxic / (n_toxic + n_other) if n_toxic + n_other else 0.5)
    toxic, other = np.zeros(GRAMS), np.zeros(GRAMS)
    held = counted[counted["bin"] >= 0]
    toxic[held["bin"]], other[held["bin"]] = held["toxic"], held["other"]
    chosen = taught.join(texts.select(F.col("id").alias("lid")).distinct(), "lid", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("lid", F.lit(seed)), "lid").limit(sample)
    rows = (texts.join(F.broadcast(chosen), texts["id"] == chosen["lid"])      # at most ``sample`` rows of two numbers
            .groupBy("id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
            .select("text", "label").mapInPandas(_features, "label int, bins binary").toArrow())
    order = sorted(zip(rows["label"].to_pylist(), rows["bins"].to_pylist()))    # the same sums however rows are dealt
    del rows
    return Weights(log_count_ratios(toxic, other, n_toxic, n_other, smooth),
                   [np.frombuffer(b, "i4") for _, b in order], np.array([y for y, _ in order], "f8"), ridge)


def classify(docs: DataFrame, weights: Weights | Share, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted, named so that they clash with no column of theirs."""
    score, predicted = unused(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for t in texts:
            yield pd.Series([own.score(x) for x in t], dtype="f8")

    return docs.withColumn(score, scored(F.col(text_col))).withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels.filter(id_remainder("doc_id", 4) != 2))
    return classify(docs.select("doc_id", "text"), weights).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
