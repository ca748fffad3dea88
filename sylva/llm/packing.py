"""Best-fit packing of tokenised documents by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides how to pack:
:func:`plan_sequences` opens a sequence with the longest length left and fills its gap
with the single, pair or triple of lengths that sums to it exactly, looked up by sum
under the counts still available; where none does, the longest piece that fits goes in
and the rest of the gap is tried again. A recipe is used as often as its lengths last,
so every recipe uses up a length and there are at most about ``capacity`` of them.

Pieces are then dealt to recipe places by their rank among pieces of equal length: a
rank within the task that tokenised them plus the sum of earlier tasks' counts. No task
sees a length's pieces together, whatever share of all documents is equally long.

Defined results: null and empty texts give one piece of the end id alone; a text longer
than ``capacity`` is cut into full pieces and a shorter last one; repeated rows are
packed each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import table, written

#: Controls that ``str.split`` takes for white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: What the short way isn't for: characters outside printable ASCII and two Latin blocks
#: (which have no combining marks and lower-case one by one), and special strings.
LONG_WAY = re.compile(r"[^\x21-\x7e\u00a1-\u012f\u0131-\u017f]|<\|").search
#: Bytes, about, that a worker remembers chunks with, and units with; a memory is emptied when full.
#: Chunks of more than LONGEST characters aren't remembered.
CHUNK_BYTES, UNIT_BYTES, LONGEST = 160 << 20, 64 << 20, 64
#: Bytes of an entry besides its text and ids: two objects and its place in the table.
ENTRY = 180
# Fixed value: the units that the vocabulary's tokenizer cuts a lower-cased chunk into.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable,
    else the next unused one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PackedIds(dict):
    """An id's four bytes, made once."""

    def __missing__(self, n: int) -> bytes:
        out = self[n] = n.to_bytes(4, "little")
        return out


class Memory(dict):
    """What has been worked out, up to a number of bytes."""

    held, limit = 0, 0

    def keep(self, text: str, ids: bytes) -> None:
        self.held += ENTRY + len(text) + len(ids)
        if self.held > self.limit:
            self.clear()
            self.held = ENTRY + len(text) + len(ids)
        self[text] = ids


class Units(Memory):
    """Unit to ids (as little-endian 32-bit bytes), by the tokenizer's merges alone."""

    def __init__(self, model):
        self.merge, self.letters, self.packed, self.limit = model.tokenize, byte_letters(), PackedIds(), UNIT_BYTES

    def work(self, unit: str) -> bytes:
        mapped = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(mapped)])

    def __missing__(self, unit: str) -> bytes:
        out = self.work(unit)
        if len(unit) <= LONGEST:
            self.keep(unit, out)
        return out


class ChunkEncoder(Memory):
    """Ids of texts by a tokenizer that drops white space, lower-cases and never joins across
    either white space or units: a text's ids are those of its chunks, a chunk's those of
    its units, and each is worked out once while it is remembered. Chunks of rarer scripts
    are left to the whole tokenizer."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.limit = Tokenizer.from_file(vocabulary), regex.compile(UNITS).findall, CHUNK_BYTES
        self.units = Units(self.tokenizer.model)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        low, units, word = chunk.lower(), self.units, chunk.rstrip(punctuation)
        if len(word) == len(chunk) and chunk.isascii() and chunk.isalpha():
            # A word in lower case is remembered as a chunk, so not as a unit too.
            out = units[low] if low != chunk else units.get(chunk) or units.work(chunk)
        elif LONG_WAY(chunk):
            out = self.whole(chunk)
        elif word.isalpha():    # letters are one unit, the signs behind them another
            n = len(word)
            out = self.get(low[:n]) or units[low[:n]]
            if n < len(low):
                out += units[low[n:]]
        else:
            out = b"".join(map(units.__getitem__, self.cut(low)))
        if len(chunk) <= LONGEST:   # as ``keep`` does
            self.held += ENTRY + len(chunk) + len(out)
            if self.held > self.limit:
                self.clear()
                self.held = ENTRY + len(chunk) + len(out)
            self[chunk] = out
        return out

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if ODD_SPACE.search(t):
                yield self.whole(t)
                continue
            yield b"".join(map(self.__getitem__, t.split()))


#: The worker's encoder, and the vocabulary that it is for: tasks that follow find what is remembered.
_own: tuple[str, ChunkEncoder] | None = None


def encoder(vocabulary: str) -> ChunkEncoder:
    global _own
    if _own is None or _own[0] != vocabulary:
        _own = vocabulary, ChunkEncoder(vocabulary)
    return _own[1]


def _pieces(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, block, seen = encoder(vocabulary), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), {}
        width = 4 * capacity
        for frame in frames:
            for lo in range(0, len(frame), 256):  # texts can be long
                part, rows = frame.iloc[lo:lo + 256], []
                for doc_id, data in zip(part["doc_id"], encode([t or "" for t in part["text"]])):
                    data += end
                    for k, at in enumerate(range(0, len(data), width)):
                        own = data[at:at + width]
                        n = len(own) // 4
                        rank = seen[n] = seen.get(n, -1) + 1
                        row = (doc_id, k, at // 4, n, zlib.crc32(own), block, rank)
                        rows.append((*row, np.frombuffer(own, "<u4").astype("int32")) if with_ids else row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"] + ["ids"] * with_ids
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
                yield out

    return run


def _exact(present: np.ndarray, count: np.ndarray, lengths: np.ndarray, gap: int) -> list[int] | None:
    """A single, pair or triple of available lengths (ascending ``lengths``) that sums to
    ``gap``; of pairs and triples the one with the longest piece."""
    if gap < len(count) and count[gap]:
        return [gap]
    pair = _pair(present, count, lengths, gap)
    if pair:
        return pair
    for c in lengths[np.searchsorted(lengths, gap, "right")::-1] if len(lengths) else ():
        if c >= gap or 3 * c < gap:
            if 3 * c < gap:  # the longest of three is at least a third
                break
            continue
        count[c] -= 1
        present[c] = count[c] > 0
        pair = _pair(present, count, lengths[: np.searchsorted(lengths, c, "right")], gap - c)
        count[c] += 1
        present[c] = True
        if pair:
            return [int(c), *pair]
    return None


def _pair(present: np.ndarray, count: np.ndarray, lengths: np.ndarray, gap: int) -> list[int] | None:
    short = lengths[: np.searchsorted(lengths, gap // 2, "right")]
    top = lengths[-1] if len(lengths) else 0
    short = short[(gap - short <= top)]
    if not len(short):
        return None
    ok = present[short] & present[gap - short]
    if 2 * short[-1] == gap:
        ok[-1] = count[short[-1]] >= 2
    k = int(ok.argmax())
    return [int(gap - short[k]), int(short[k])] if ok[k] else None


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Recipes ``(times, lengths)`` that use up the histogram {length: pieces}."""
    count = np.zeros(capacity + 1, "int64")
    for n, c in histogram.items():
        count[n] = c
    out = []
    lengths = np.flatnonzero(count)
    while len(lengths):
        left, opener = count.copy(), int(lengths[-1])
        recipe, gap, own = [opener], capacity - opener, lengths
        left[opener] -= 1
        present = left > 0
        own = own[present[own]]
        while gap and len(own) and gap >= own[0]:
            found = _exact(present, left, own, gap)
            if found is None:  # best fit: the longest that goes in
                found = [int(own[np.searchsorted(own, gap, "right") - 1])]
            for n in found:
                left[n] -= 1
                present[n] = left[n] > 0
            own = own[present[own]]
            recipe += found
            gap -= sum(found)
        used, need = np.unique(recipe, return_counts=True)
        times = int((count[used] // need).min())
        count[used] -= times * need
        lengths = lengths[count[lengths] > 0]
        out.append((times, recipe))
    return out


def _places(recipes: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys of the recipes' places with the first sequence id,
    and the offset, of each."""
    taken, rows, first = np.zeros(capacity + 1, "int64"), [], 0
    for times, recipe in recipes:
        offset = 0
        for n in recipe:
            rows.append((n, int(taken[n]), first, offset))
            taken[n] += times
            offset += n
        first += times
    a = np.array(sorted(rows), "int64").reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1,
         with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if
    asked for, the token ids. ``vocabulary``: a tokenizer file at the same path everywhere."""
    fields = [("doc_id", docs.schema[id_col].dataType), ("piece", IntegerType()), ("start", LongType()), ("length", LongType()),
              ("ids_crc32", LongType()), ("block", IntegerType()), ("rank", LongType())]
    schema = StructType([StructField(*f) for f in fields + [("ids", ArrayType(IntegerType()))] * with_ids])
    pieces = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
                     .mapInPandas(_pieces(vocabulary, capacity, end_id, with_ids), schema), "pieces")
    per_block = written(pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    lengths, ranks, firsts, offsets = _places(plan_sequences(histogram, capacity), capacity)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(per_block.withColumn("before", F.coalesce(before, F.lit(0))).drop("n").hint("merge"), ["length", "block"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (lengths << 40) | ranks  # a length's pieces number under 2^40
        for f in frames:
            rank = (f.pop("rank") + f.pop("before")).to_numpy("int64")
            k = np.searchsorted(keys, (f["length"].to_numpy("int64") << 40) | rank, "right") - 1
            f["sequence_id"], f["offset"] = firsts[k] + rank - ranks[k], offsets[k]
            yield f

    names = [f.name for f in schema if f.name not in ("block", "rank")]
    out = StructType([schema[n] for n in names] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*names, "rank", "before").mapInPandas(place, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
