"""Token counts without token ids.

A byte-level BPE first cuts a text into pre-tokens and merges inside each alone, so a
text's count is the sum over its pre-tokens of the pieces of each. Documents are reduced
to frequencies of pre-tokens, block by block. The blocks' dictionaries are dealt out and
sorted by pre-token, so equal ones meet in a run whose pieces are counted once; a common
one has a row per block there, read as a stream. The counts are joined back to the blocks
and summed per document.

Defined results: null counts as empty and has no token; the vocabulary's special strings
inside a text are one token each, as the library has it; repeated rows give a row each;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .blocks import in_blocks, per_block, terms
from .common import table, written

# The byte-level pre-token pattern, in general and over ASCII alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Bits of a place in a block's dictionary, beside the block's number in one long.
IDX_BITS = 28
#: A character outside scripts whose classes all Unicode versions in use agree on; texts
#: that have one are cut by the library itself.
RARE = "[^\x00-ԯ -⁯]"


class PreTokens:
    """Cuts texts into the library's pre-tokens; special strings come out whole."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.marks = special
        self.ascii, self.common, self.rare = re.compile(ASCII_PATTERN, re.ASCII).findall, regex.compile(PATTERN).findall, re.compile(RARE).search

    def _cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        if not self.rare(text):
            return self.common(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if not any(m in text for m in self.marks):
            return self._cut(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self._cut(part)
        return out


def _blocks(vocabulary: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = PreTokens(vocabulary)
        for block, docs in in_blocks(frames):
            index: dict[str, int] = {}
            steps, freqs, counts, sizes = [], [], [], []
            for text in docs["text"]:
                text = text or ""
                found = Counter(cut(text))
                at = np.fromiter((index.setdefault(t, len(index)) for t in found), "int64", len(found))
                order = np.argsort(at)
                # Steps between sorted positions are small, and compress well.
                steps.append(np.diff(at[order], prepend=0).astype("<u4"))
                freqs.append(np.fromiter(found.values(), "<u4", len(found))[order])
                counts.append(len(found))
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
            yield pd.DataFrame({"block": [block], "doc_id": [docs["doc_id"].astype("Int64").tolist()], "n_bytes": [sizes], "terms": [list(index)],
                                "n": [squeezed(counts)], "steps": [squeezed(np.concatenate(steps))], "freqs": [squeezed(np.concatenate(freqs))]})

    return run


def squeezed(numbers) -> bytes:
    """Small numbers as bytes, packed tight: they are shuffled and stored as they are."""
    import zstandard

    return zstandard.ZstdCompressor(3).compress(np.asarray(numbers, "<u4").tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype("i8")


#: Entries whose piece counts a task gathers before it gives them out by block.
GATHERED = 1_000_000


def _pieces(vocabulary: str):
    def by_block(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        at, pieces = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(at)
        at, pieces = at[order], pieces[order]
        block, first = np.unique(at >> IDX_BITS, return_index=True)
        ends = [*first[1:], len(at)]
        steps = [squeezed(np.diff(at[a:b] - (k << IDX_BITS), prepend=0)) for k, a, b in zip(block, first, ends)]
        return pd.DataFrame({"block": block, "steps": steps, "pieces": [squeezed(pieces[a:b]) for a, b in zip(first, ends)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last, known = PreTokens(vocabulary).tokenizer.encode_batch_fast, None, 0
        held, size = [], 0
        for f in frames:
            term = f["term"].to_numpy()
            if not len(term):
                continue
            new = np.concatenate([[term[0] != last], term[1:] != term[:-1]]).astype(bool)
            counts = [len(e.ids) for e in encode(term[new].tolist(), add_special_tokens=False)]
            pieces = np.array([known, *counts], "i8")[np.cumsum(new)]
            last, known = term[-1], pieces[-1]
            held.append((f["at"].to_numpy(), pieces))
            size += len(f)
            if size >= GATHERED:
                yield by_block(held)
                held, size = [], 0
        if held:
            yield by_block(held)

    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit."""
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("block", LongType()), StructField("doc_id", ArrayType(id_type)), StructField("n_bytes", ArrayType(LongType())),
                         StructField("terms", ArrayType(StringType())), StructField("n", BinaryType()), StructField("steps", BinaryType()),
                         StructField("freqs", BinaryType())])
    blocks = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_blocks(vocabulary), schema), "blocks")
    # Block and place in one number: the dictionaries are most of what is shuffled.
    entries = terms(blocks).select((F.col("block") * (1 << IDX_BITS) + F.col("idx")).alias("at"), "term")
    known = (entries.repartition("term").sortWithinPartitions("term")
             .mapInPandas(_pieces(vocabulary), "block bigint, steps binary, pieces binary"))

    def fill(block, found: pd.DataFrame) -> pd.DataFrame:
        place = [np.cumsum(unsqueezed(x)) for x in found["steps"]]
        pieces = np.zeros(sum(map(len, place)), "i8")
        for at, own in zip(place, found["pieces"]):
            pieces[at] = unsqueezed(own)
        n, steps, freqs = (unsqueezed(block[c]) for c in ("n", "steps", "freqs"))
        of = np.repeat(np.arange(len(n)), n)
        run = np.cumsum(steps)
        at = run - np.repeat(np.concatenate([[0], run])[np.cumsum(n) - n], n)  # cumulative within each document
        total = np.bincount(of, freqs * pieces[at], len(n)).astype("int64") if len(at) else np.zeros(len(n), "int64")
        return pd.DataFrame({"doc_id": pd.array(block["doc_id"], dtype="Int64"), "n_bytes": block["n_bytes"], "n_tokens": total, "over_limit": total > limit})

    out = StructType([StructField("doc_id", id_type), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    return per_block(blocks.drop("terms"), known, fill, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
