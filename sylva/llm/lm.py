"""Scoring whole documents by a gated recurrent language model.

Words are counted over all training documents and looked up once per distinct word and
block of documents. The most frequent words and the end are the network's symbols; all
other words fall, by their form, into classes, and a word's share of its class is its
smoothed count. Training documents are read once, in ``rounds`` parts: every task goes on
from the common parameters over its documents of the part, and the parameters are
averaged by tokens read, in a tree. Scoring carries the state through a whole document.

Defined results: null and empty texts are the end token alone; words never seen in
training share one smoothed place in their form's class; without training documents score
and base score are those of the single unseen place; repeated rows give a row each; an
empty table gives an empty result; columns other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from .blocks import in_blocks, per_block, terms
from .common import id_remainder, table, written
from .gru import GRU

# Last characters and letters that tell forms of words apart.
ENDINGS = [",", ".", "!", "|", "[%$#&*]"]
LETTERS = ["[äöüß]", "[éèêëàùçœ]", "[áíóúñ]"]
#: Forms: an ending (or none of them) by letters of a language (or other, or ASCII alone).
FORMS = (len(ENDINGS) + 1) * (len(LETTERS) + 2)
#: Tokens that are scored, or trained on, in step.
POOL = 2_000_000
SMOOTH = 0.1


def form_of(term: Column) -> Column:
    """The class of a word that is not frequent."""
    last, ending = F.right(term, F.lit(1)), F.lit(len(ENDINGS))
    for k, e in enumerate(ENDINGS):
        ending = F.when(last.rlike(e) if len(e) > 1 else last == e, k).otherwise(ending)
    plain = F.length(term) == F.octet_length(term)
    letters = F.lit(len(LETTERS))
    for k in reversed(range(len(LETTERS))):
        letters = F.when(term.rlike(LETTERS[k]), k).otherwise(letters)
    return ending * (len(LETTERS) + 2) + F.when(plain, len(LETTERS) + 1).otherwise(letters)


class Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block, docs in in_blocks(frames):
        index, of_doc = Places(), []
        for text in docs["text"]:
            # On bytes, lower() is of A-Z alone and split() at blank and tab..return alone.
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            of_doc.append(np.fromiter(map(index.__getitem__, words), "<u4", len(words)))
        train = np.zeros(len(index), "i8")
        for at, held in zip(of_doc, docs["held_out"]):
            if not held:
                train += np.bincount(at, minlength=len(index)) if len(at) * 8 > len(index) else 0
                if len(at) * 8 <= len(index):
                    np.add.at(train, at, 1)
        yield pd.DataFrame({"block": [block], "doc_id": [docs["doc_id"].astype("Int64").tolist()], "held_out": [docs["held_out"].tolist()],
                            "n": [[len(a) for a in of_doc]], "tokens": [np.concatenate(of_doc).tobytes()],
                            "terms": [[w.decode("utf-8", "replace") for w in index]], "train": [train.tolist()]})


class Facts:
    """What scoring knows of the training words, beside the counts joined to the blocks."""

    def __init__(self, counts: DataFrame, train_docs: int, frequent: int):
        top = counts.orderBy(F.desc("c"), "term").limit(frequent - 1).select("term", "c", "form").collect()
        mass = np.full(FORMS, SMOOTH)
        total, distinct = 0, 0
        for r in counts.groupBy("form").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            mass[r["form"]] += r["c"] + SMOOTH * r["n"]
            total, distinct = total + r["c"], distinct + r["n"]
        for r in top:
            mass[r["form"]] -= r["c"] + SMOOTH
        self.mass = np.maximum(mass, SMOOTH)
        self.train_docs, self.tokens = train_docs, total + train_docs
        self.log_all = np.log10(self.tokens + SMOOTH * (distinct + (train_docs > 0) + 1))
        self.words = [r["term"] for r in top]
        # Symbol 0 is the end; places that no word has keep a small weight.
        self.weight = np.concatenate([[train_docs + SMOOTH], [r["c"] for r in top], np.full(frequent - 1 - len(top), SMOOTH), self.mass])


def symbols(docs: DataFrame, held_out: Column, id_col: str, text_col: str, frequent: int) -> tuple[DataFrame, Facts]:
    """A row per document with its symbols and all of its score that the network has no part in."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("block", LongType()), StructField("doc_id", ArrayType(id_type)), StructField("held_out", ArrayType(BooleanType())),
                         StructField("n", ArrayType(LongType())), StructField("tokens", BinaryType()), StructField("terms", ArrayType(StringType())),
                         StructField("train", ArrayType(LongType()))])
    given = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    blocks = written(given.mapInPandas(_blocks, schema), "word-blocks")
    train_docs = given.filter(~F.col("held_out")).count()
    entries = terms(blocks, "train")
    counts = entries.groupBy("term").agg(F.sum("train").alias("c")).filter("c > 0").withColumn("form", form_of(F.col("term")))
    counts = written(counts, "word-counts")
    facts = Facts(counts, train_docs, frequent)
    top = spark.createDataFrame([(w, k + 1) for k, w in enumerate(facts.words)], "t_term string, symbol int")
    # ``frequent`` rows at most.
    counts = counts.join(F.broadcast(top), F.col("term") == F.col("t_term"), "left").drop("t_term", "form")
    known = entries.join(counts, "term", "left").select(
        "block", "idx", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("symbol", F.lit(frequent) + form_of(F.col("term"))).cast("int").alias("symbol"))
    log_all, mass, end = facts.log_all, np.log10(facts.mass), facts.train_docs

    def fill(block, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("idx")
        c, symbol = found["c"].to_numpy("f8"), found["symbol"].to_numpy("i8")
        logs = np.log10(c + SMOOTH)
        rare = np.where(symbol >= frequent, logs - mass[np.maximum(symbol - frequent, 0)], 0.0)
        at, n = np.frombuffer(block["tokens"], "<u4"), np.asarray(block["n"], "i8")
        of = np.repeat(np.arange(len(n)), n)

        def per_doc(x):
            return np.bincount(of, x[at], len(n)) if len(at) else np.zeros(len(n))
        syms = np.split(symbol[at].astype("<u2"), np.cumsum(n)[:-1])
        zero = b"\0\0"
        return pd.DataFrame({
            "doc_id": pd.array(block["doc_id"], dtype="Int64"), "held_out": block["held_out"], "n_tokens": n + 1,
            "n_known": per_doc((c > 0).astype("f8")).astype("i8") + (end > 0),
            "base_score": per_doc(logs - log_all) + np.log10(end + SMOOTH) - log_all, "rare": per_doc(rare),
            "symbols": [s.tobytes() + zero for s in syms]})

    out = StructType([StructField("doc_id", id_type), StructField("held_out", BooleanType()), StructField("n_tokens", LongType()),
                      StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("rare", DoubleType()),
                      StructField("symbols", BinaryType())])
    return written(per_block(blocks.drop("terms", "train"), known, fill, out), "symbols"), facts


def _pools(frames: Iterator[pd.DataFrame], size: int = POOL) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for f in frames:
        ends = np.cumsum(f["symbols"].str.len().to_numpy() // 2)
        lo = 0
        while lo < len(f):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size - n, "right")))
            held.append(f.iloc[lo:hi])
            n += int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
            lo = hi
            if n >= size or lo < len(f):
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def _arrays(f: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(s, "<u2") for s in f["symbols"]]


def fit(rows: DataFrame, facts: Facts, frequent: int, members: int, hidden: int, rounds: int, rate: float) -> GRU:
    """``rows``: the training documents' symbols. All are read, once, in ``rounds`` parts."""
    sc, model = rows.sparkSession.sparkContext, GRU(frequent, members, facts.weight, hidden)
    for k in range(rounds):
        own = sc.broadcast(model)

        def run(frames: Iterator[pd.DataFrame], own=own, step=rate / (1 + k)) -> Iterator[pd.DataFrame]:
            import copy

            model, n = copy.deepcopy(own.value), 0
            for f in _pools(frames):
                n += model.train(_arrays(f), step)
            if n:
                yield pd.DataFrame({"n": [n], "p": [model.vector().tobytes()]})

        part = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("symbols")
        sums = part.mapInPandas(run, "n bigint, p binary").rdd.map(lambda r: (r["n"], np.frombuffer(r["p"], "f4").astype("f8") * r["n"]))
        total, vector = sums.treeAggregate((0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
        if total:
            model.load(vector / total)
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = 512, members: int = 32,
          hidden: int = 16, rounds: int = 3, rate: float = 0.01) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probabilities of the whole text). ``held_out``: documents not learnt from."""
    rows, facts = symbols(docs, held_out, id_col, text_col, frequent)
    model = fit(rows.filter(~F.col("held_out")), facts, frequent, members, hidden, rounds, rate)
    own = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _pools(frames):
            f = f.assign(score=own.value.score(_arrays(f)) / np.log(10) + f["rare"])
            yield f.drop(columns=["symbols", "rare"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) == 0)
