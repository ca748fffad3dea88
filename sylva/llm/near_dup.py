"""Near duplicates by ProbMinHash signatures, banding and exact verification.

A text is its distinct shingles of five words (A-Z lower-cased; a shorter text is one
shingle), weighted 1 + ln(count). Every shingle sends a Poisson process of arrivals, of
its weight's rate and a seed of its own hash, to random places of the signature; the
first arrival of a place is kept, and a shingle ends as soon as its next arrival is later
than the last place's. Two signatures agree in a place with the probability Jaccard
similarity of the weighted texts, which is the plain one where no shingle repeats. A text in which one does
has a second signature, of the same shingles at weight 1, so any two texts have a pair of
signatures that agree with their plain similarity.

Bands of equal places of either signature name buckets. Equal texts are one node from the start. Every node is
verified against a pivot of each of its buckets, the most central text first: the one whose
buckets are the largest, mostly the same text for all buckets of a group. Where a bucket
still holds more than one component after the turns of pivots, the members of all buckets
of one pivot form a group, and its nodes outside the largest component are counted against
all its members of other components: both sides are dealt into slices of a bounded number
of shingles, a task takes one pair of slices at a time and returns only the links.
So no pair that shares a bucket and could join two components goes untested, a bucket of
mutual copies costs a row per member, and pairs that aren't links are never rows. The
counting itself still grows with outsiders times members of a group. A link is an exact
plain Jaccard similarity of at least ``threshold``. At 0.8, 25 bands of 5 places miss a
pair with probability 5e-5 at most, whatever repeats in one text or in both.

Defined results: a null text counts as empty; texts without a word are equal only to texts
that are identical after lower-casing; of a group the smallest id is its cluster id and
marked kept (a null id only if there is no other); an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table, unused, written

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Turns in which buckets that hold several components get a pivot each.
PIVOTS = 2
#: Shingles in a slice of a group, about; distinct shingles counted at a time.
SLICE, WIDE = 65_536, 4096
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(ascii_lower(text)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct 64-bit shingle hashes of a text, sorted, with their counts."""

    def __init__(self, words: int = SHINGLE):
        import xxhash

        self.n, self.hash, self.known = words, xxhash.xxh64_intdigest, {}
        self.by = mixed(np.arange(1, words + 1, dtype="u8")) | np.uint64(1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        # On bytes, lower() is of A-Z alone and split() at blank and tab..return alone.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, "u8"), np.zeros(0, "i8")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), "u8", len(words))
        n = min(self.n, len(h))
        s = np.full(len(h) - n + 1, n, "u8")
        for k in range(n):
            s += mixed(h[k:len(h) - n + 1 + k] ^ self.by[k]) * self.by[k]
        return np.unique(mixed(s), return_counts=True)


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, places: int) -> np.ndarray:
    """ProbMinHash of ``n`` texts at once: elements with weights, each of text ``owner``.
    Returns for every place the element that arrived first."""
    best, who = np.full(n * places, np.inf), np.zeros(n * places, "u8")
    last = np.full(n, np.inf)  # the latest first arrival of each text
    state, at, element = hashes.copy(), np.zeros(len(hashes)), hashes
    while len(state):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        draw = mixed(state)
        at = at - np.log((draw >> np.uint64(11)).astype("f8") * 2.0**-53 + 2.0**-54) / weights
        going = at < last[owner]
        state, at, element, weights, owner, draw = (x[going] for x in (state, at, element, weights, owner, draw))
        slot = owner * places + (mixed(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(places)).astype("i8")
        np.minimum.at(best, slot, at)
        first = best[slot] == at
        who[slot[first]] = element[first]
        texts = np.unique(owner)
        last[texts] = best.reshape(n, places)[texts].max(axis=1)
    return who.reshape(n, places)


def _bands(bands: int, rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, by = Shingles(), mixed(np.arange(101, 101 + rows, dtype="u8")) | np.uint64(1)
        salt = mixed(np.arange(1001, 1001 + bands, dtype="u8"))

        def named(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            who = signatures(hashes, weights, np.repeat(np.arange(len(sizes)), sizes), len(sizes), bands * rows)
            return mixed((who.reshape(-1, bands, rows) * by).sum(axis=2, dtype="u8") ^ salt).view("i8")

        for frame in frames:
            for lo in range(0, len(frame), 200):
                part = frame.iloc[lo:lo + 200].copy()
                found = [cut(t) for t in part.pop("text")]
                sizes = np.array([len(h) for h, _ in found])
                hashes = np.concatenate([h for h, _ in found])
                names = named(hashes, 1 + np.log(np.concatenate([c for _, c in found])), sizes)
                names = [b if s else b[:0] for b, s in zip(names, sizes)]
                # Without repeats both signatures are the same one.
                again = np.array([bool((c > 1).any()) for _, c in found])
                if again.any():
                    plain = hashes[np.repeat(again, sizes)]
                    for k, b in zip(np.flatnonzero(again), named(plain, np.ones(len(plain)), sizes[again])):
                        names[k] = np.union1d(names[k], b)
                part["bands"] = names
                yield part

    return run


def _shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cut = Shingles()
    for frame in frames:
        for lo in range(0, len(frame), 500):
            part = frame.iloc[lo:lo + 500]
            yield pd.DataFrame({"key": part["key"], "shingles": [cut(t)[0].view("i8") for t in part["text"]]})


def similar(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingles have at least that Jaccard similarity."""
    left = shingles.select(F.col("key").alias("a"), F.col("shingles").alias("of_a"))
    right = shingles.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (pairs.join(left, "a").join(right, "b").withColumn("both", both)
            .filter(F.col("both") >= threshold * (F.size("of_a") + F.size("of_b") - F.col("both"))).select("a", "b"))


def shared_counts(left: np.ndarray, left_row: np.ndarray, right: np.ndarray, right_row: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many elements every set on the left has in common with every set on the right."""
    common = np.intersect1d(left, right)
    out = np.zeros(shape)
    for lo in range(0, len(common), WIDE):
        block, flags = common[lo:lo + WIDE], []
        for values, row, n in ((left, left_row, shape[0]), (right, right_row, shape[1])):
            at = np.minimum(np.searchsorted(block, values), len(block) - 1)
            hit = block[at] == values
            flags.append(np.zeros((n, len(block)), "f4"))
            flags[-1][row[hit], at[hit]] = 1
        out += flags[0] @ flags[1].T
    return out


def _links(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        sides = []
        for side in (True, False):
            part = group.filter(pa.compute.equal(group["outside"], side))
            arrays = part["shingles"].combine_chunks()
            sizes = pa.compute.list_value_length(arrays).to_numpy(zero_copy_only=False)
            sides.append((arrays.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), sizes, part["label"]))
        (left, left_row, n_left, a), (right, right_row, n_right, b) = sides
        both = shared_counts(left, left_row, right, right_row, (len(n_left), len(n_right)))
        i, j = np.nonzero(both >= threshold * (n_left[:, None] + n_right[None, :] - both))
        found = pa.table({"a": a.take(pa.array(i)), "b": b.take(pa.array(j))})
        return found.filter(pa.compute.not_equal(found["a"], found["b"])).group_by(["a", "b"]).aggregate([])

    return run


def remaining(groups: DataFrame, shingles: DataFrame, threshold: float, tmp: Scratch) -> DataFrame:
    """The links (a, b) between components of each of the ``groups`` (pivot, key, label)."""
    sizes = groups.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("pivot").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    rows = groups.join(shingles, "key").join(main, "pivot").withColumn("outside", F.col("label") != F.col("main"))
    rows = tmp.write(rows.drop("main").withColumn("n", F.size("shingles")), "groups")
    slices = tmp.write(rows.groupBy("pivot").agg(F.ceil(F.sum("n") / SLICE).alias("of_all"),
                                                 F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / SLICE).alias("of_outside")), "slices")
    rows = rows.join(slices, "pivot")

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64("key"), F.col(own)).alias(names[0])
        return side.select("pivot", mine, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(names[1]), "label", "shingles")

    left = dealt(rows.filter("outside"), "of_outside", "of_all", ("i", "j")).withColumn("outside", F.lit(True))
    right = dealt(rows, "of_all", "of_outside", ("j", "i")).withColumn("outside", F.lit(False))
    return left.unionByName(right).groupBy("pivot", "i", "j").applyInArrow(_links(threshold), "a binary, b binary").distinct()


def components(links: DataFrame, tmp: Scratch) -> DataFrame:
    """(key, label) of every key in ``links`` (a, b): the smallest key of its component, by
    alternating large-star and small-star steps on tables in the shared folder."""
    edges, before = links, None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, tmp.write(large.filter("a <> b").distinct(), "large-star")  # every a above its b
        tmp.drop(last)
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        stars = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        last, edges = edges, tmp.write(stars.filter("a <> b").distinct(), "small-star")
        tmp.drop(last)
        now = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("label"))
        before = now


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS,
             rows: int = ROWS) -> DataFrame:
    """A row per row of ``docs``: key (of its text), doc_id, class_id (the smallest id with this
    text), cluster_id (the smallest of its group), cluster_size (rows) and kept."""
    texts = docs.select(F.col(id_col).alias("doc_id"), key_of(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    tmp = Scratch(docs.sparkSession)
    rows_ = written(texts.mapInPandas(_bands(bands, rows), f"doc_id {id_type}, key binary, bands array<bigint>"), "signatures")
    classes = tmp.write(rows_.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"),
                                                 F.any_value("bands").alias("bands")), "classes")
    members = classes.select("key", F.explode("bands").alias("bucket"))
    shared = tmp.write(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = tmp.write(members.join(shared, "bucket"), "members")  # of buckets with more than one
    tmp.drop(shared)
    wanted = members.select("key").distinct().join(classes, "key").select(F.col("key").alias("_key"), F.col("class_id").alias("_id"))
    # By text and id: the copies of a hot text spread over all partitions.
    chosen = texts.join(wanted.hint("merge"), (texts["key"] == F.col("_key")) & texts["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    shingles = tmp.write(chosen.select("key", "text").mapInPandas(_shingles, "key binary, shingles array<bigint>").dropDuplicates(["key"]), "shingles")

    # A text near the middle of a group has its buckets in common with the most others.
    labels = tmp.write(members.groupBy("key").agg(F.sum("size").alias("central")).withColumn("label", F.col("key")), "labels")
    for turn in range(PIVOTS + 1):
        held = tmp.write(members.join(labels, "key"), "held")
        split = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                           F.max_by("key", F.struct(F.xxhash64("key") if turn == 1 else F.col("central"), "key")).alias("pivot")).filter("low <> high")
        if turn < PIVOTS:  # every bucket its own pivot, another one each turn
            split = tmp.write(split.select("bucket", "pivot").join(labels.select(F.col("key").alias("pivot"), F.col("label").alias("p_label")), "pivot"), "pivots")
            pairs = held.join(split, "bucket").filter("label <> p_label").select(
                F.greatest("key", "pivot").alias("a"), F.least("key", "pivot").alias("b"))
            found = similar(pairs.distinct(), shingles, threshold)
            # Links between components as they stand: the graph of components is what is joined up.
            left = labels.select(F.col("key").alias("a"), F.col("label").alias("of_a"))
            right = labels.select(F.col("key").alias("b"), F.col("label").alias("of_b"))
            found = found.join(left, "a").join(right, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
        else:
            groups = held.join(tmp.write(split.select("bucket", "pivot"), "split"), "bucket").select("pivot", "key", "label").distinct()
            found = remaining(tmp.write(groups, "remaining"), shingles, threshold, tmp)
        found = tmp.write(found, "links")
        if not found.isEmpty():
            merged = components(found, tmp).select(F.col("key").alias("label"), F.col("label").alias("new"))
            labels = tmp.write(labels.join(merged, "label", "left").select("key", "central", F.coalesce("new", "label").alias("label")), "labels")
        tmp.keep(classes, members, shingles, labels)

    grouped = tmp.write(labels.join(classes.drop("bands"), "key"), "grouped")
    groups = tmp.write(grouped.groupBy("label").agg(F.min("class_id").alias("cluster_id"), F.sum("n").alias("cluster_size")), "groups")
    of_key = grouped.join(groups, "label").select("key", "cluster_id", "cluster_size")
    of_key = written(classes.drop("bands").join(of_key, "key", "left").select(
        "key", "class_id", F.when(F.col("cluster_size").isNull(), F.col("class_id")).otherwise(F.col("cluster_id")).alias("cluster_id"),
        F.coalesce("cluster_size", "n").alias("cluster_size")), "clusters")
    tmp.drop()
    return rows_.drop("bands").join(of_key, "key").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("cluster_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: that with the cluster's id."""
    key, = unused(docs, "key")
    # A group's smallest id may stand on two texts of the group; the smaller key stays then.
    stay = (clusters(docs, id_col, text_col, threshold).filter("kept").groupBy("cluster_id", F.col("doc_id").alias("_k_id"))
            .agg(F.min("key").alias("_k_key")).select("_k_id", "_k_key"))
    keyed = docs.withColumn(key, key_of(F.col(text_col)))
    out = keyed.join(stay, (keyed[key] == stay["_k_key"]) & keyed[id_col].eqNullSafe(stay["_k_id"]), "left_semi")
    return out.dropDuplicates([key, id_col]).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents")).drop("key")
