"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``min_exponent`` periods and ``min_length`` words long, that no neighbouring word extends.

The automaton of a stretch of words has a state per class of factors with the same end
positions; its suffix links form a tree in which the path from a prefix's state to the root
holds all suffixes of that prefix. The words are then appended in turn: the access to the
prefix's state makes its path to the root one preferred path, coloured by the word's number.
The segments of the old colours that it passes are the suffixes by the place where they
occurred last: lengths (low, high] last ended at word p. If the distance d = i - p lies in
(low, high], the last 2d words are a square of a primitive root, and every such square shows
in this way. ``high`` is then the longest common suffix of both ends, so the square extends to
the left by it, and to the right by the words that follow; both together are the run.
Building the automaton and the accesses take O(n log n) steps (amortised, splay trees).

Only stretches that can hold a run go through the automaton: within a run every
``gram`` words stand once more in the text (one period before or after), where ``gram`` follows
from the two limits, so a word that is in no repeated gram is in no run. For 24 words and 3
periods that is 9 words; prose has few such repeats, a repeated line or table many.

Memory: some 700 bytes per word of the longest stretch. A text is one task's work.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated
rows give a row each; ids and other columns, whatever their names, play no part and are passed
on; words are bytes of UTF-8 between blanks (space and the controls tab to return), so any
script and length is exact; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, table, unused

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Any odd number: the base of the rolling hash modulo 2^64 that finds repeated grams.
BASE = np.uint64(0x9E3779B97F4A7C15)


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link per state, longest length per state, state of each prefix); state 0 is the root."""
    step, link, longest, prefix, last = [{}], [-1], [0], [], 0
    for c in words:
        new, p = len(step), last
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        prefix.append(new)
        last = new
    return link, longest, prefix


class LastEnds:
    """A link-cut forest on the suffix links. A preferred path is a splay tree by depth, and its
    root holds the path's colour: the last word at which the path's factors ended."""

    def __init__(self, link: list[int], longest: list[int]):
        n = len(link)
        self.up, self.longest = list(link), longest     # a splay tree's parent, or the path above
        self.upper, self.lower, self.colour = [-1] * n, [-1] * n, [-1] * n

    def splay(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower

        def rotate(x: int, y: int) -> None:
            z = up[y]
            if upper[y] == x:
                b = upper[y] = lower[x]
                lower[x] = y
            else:
                b = lower[y] = upper[x]
                upper[x] = y
            if b >= 0:
                up[b] = y
            if z >= 0:
                if upper[z] == y:
                    upper[z] = x
                elif lower[z] == y:
                    lower[z] = x
            up[y], up[x] = x, z

        top = x
        while True:
            y = up[x]
            if y < 0 or (upper[y] != x and lower[y] != x):
                break
            z = up[y]
            if z < 0 or (upper[z] != y and lower[z] != y):
                top = y
                rotate(x, y)
                break
            top = z
            if (upper[z] == y) == (upper[y] == x):
                rotate(y, z)
            else:
                rotate(x, y)
            rotate(x, y if up[x] == y else z)
        self.colour[x] = self.colour[top]

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolours the path from ``state`` to the root by ``end``; the segments it had, longest
        first: (longest length, colour)."""
        up, lower, colour = self.up, self.lower, self.colour
        below, x, segments = -1, state, []
        while x >= 0:
            self.splay(x)
            segments.append((self.longest[x], colour[x]))
            rest = lower[x]
            if rest >= 0:
                colour[rest] = colour[x]    # cut off: a path of its own
            lower[x] = below
            below, x = x, up[x]
        colour[below] = end
        return segments


def all_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of two periods or more."""
    link, longest, prefix = suffix_automaton(words)
    paths, found, growing = LastEnds(link, longest), [], {}
    for i, state in enumerate(prefix):
        segments = paths.access(state, i)
        segments.append((0, -1))
        for (high, last), (low, _) in zip(segments, segments[1:]):
            d = i - last
            if last >= 0 and low < d <= high:
                start = i - d - high + 1
                run = growing.get(d)
                if run is not None and run[0] == start:
                    run[1] = i
                else:
                    if run is not None:
                        found.append((run[0], run[1] - run[0] + 1, d))
                    growing[d] = [start, i]
    found += [(s, e - s + 1, d) for d, (s, e) in growing.items()]
    return found


def gram_size(min_length: int, min_exponent: Fraction) -> int:
    """The longest gram of which every place in a run has an equal one a period away: a run of
    length n and period q has n - gram + 1 places, and 2q of them are enough."""
    turn = int(min_length / min_exponent)
    n = [max(min_length, -(-(min_exponent * q) // 1)) - 2 * q + 1 for q in range(max(1, turn - 1), turn + 3)]
    return max(1, int(min(n)))


def stretches(codes: np.ndarray, gram: int, min_length: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words whose grams stand twice in the text."""
    n = len(codes) - gram + 1
    if n < 2 or len(codes) < min_length:
        return []
    rolling = np.zeros(n, "u8")
    for j in range(gram):
        rolling = rolling * BASE + codes[j:j + n]
    in_order = np.sort(rolling)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, rolling), len(twice) - 1)
    edge = np.diff(np.concatenate([[0], (twice[at] == rolling).astype("i1"), [0]]))
    out = []
    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        hi += gram - 1
        if out and lo < out[-1][1]:     # they share words
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return [s for s in out if s[1] - s[0] >= min_length]


def runs_in(words: list[bytes], min_length: int, min_exponent: Fraction) -> list[tuple[int, int, int]]:
    """The runs of a text's words: (start, length, period), by start and period."""
    if len(words) < min_length:
        return []
    codes = np.fromiter(map(hash, words), "i8", len(words)).view("u8")
    out = []
    for lo, hi in stretches(codes, gram_size(min_length, min_exponent), min_length):
        number = {}
        own = [number.setdefault(w, len(number)) for w in words[lo:hi]]
        out += [(lo + s, n, q) for s, n, q in all_runs(own) if n >= min_length and n >= min_exponent * q]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, "i8")
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(change).tolist()) if n == 0]


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = 24, min_exponent: float = 3) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start and period, and
    ``collapsed``, the text without the repeats (words joined by one space); the new columns are
    named so that they clash with none of ``docs``. ``min_exponent`` is 2 at least."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    exponent, at = Fraction(min_exponent), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = [], []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                words = (text or b"").split()    # at ASCII blanks
                found = runs_in(words, min_length, exponent)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                collapsed.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.binary()).view(pa.string())],
                                             names=[*batch.schema.names, runs_name, collapsed_name])

    runs_name, collapsed_name = unused(docs, "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, T.StructField(runs_name, T._parse_datatype_string(RUN_TYPE)),
                           T.StructField(collapsed_name, T.StringType())])
    return docs.mapInArrow(run, schema)


def most_periodic(runs: Column) -> Column:
    """Of an array of runs by start and period, the first with the greatest length / period."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def looped(text: Column, doc_id: Column) -> Column:
    """The text as the query's contract wants it: for a tenth of the ids, the words from a place
    on repeat with a period that follows from the id; the others' as they are."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.concat_ws(" ", F.transform(w, lambda x, i: F.when(i < a, x).otherwise(
            F.get(w, (a + (i - a) % p).cast("int"))))))

    return F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words), repeat)[0], F.lit(""))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text")))
    best = most_periodic(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"), best.alias("best")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
