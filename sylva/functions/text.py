"""Tokenising and character n-grams as array expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = r"\s+"
DEFAULT_NGRAM = 6


def tokenize(text: Column, pattern: str = DEFAULT_TOKENIZER) -> Column:
    """Split on ``pattern`` with Java ``String.split`` semantics.

    The trailing run of empty tokens is dropped after splitting, so the work is linear
    in the text whatever the pattern; a leading empty token stays; a non-empty string of
    separators only gives no tokens; the empty string gives one empty token.
    """
    def without_trailing(tokens: Column) -> Column:
        last = F.array_max(F.transform(tokens, lambda t, i: F.when(t != "", i + 1)))
        return F.when((F.element_at(tokens, -1) != "") | (text == ""), tokens).otherwise(
            F.slice(tokens, 1, F.coalesce(last, F.lit(0))))

    # An array of one, so that the text is split once.
    return F.transform(F.array(F.split(text, pattern)), without_trailing)[0]


def _grams_of_length(text: Column, lo: int, hi: int) -> Column:
    """At every character position the next ``lo..hi`` characters (greedy), by a
    zero-width lookahead: one linear regex pass. (``substring(text, i, n)`` per
    position is quadratic, since UTF-8 strings are walked from the start.)"""
    quant = f"{{{lo}}}" if lo == hi else f"{{{lo},{hi}}}"
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{quant}))"), F.lit(1))


def ngrams(text: Column, n: int = DEFAULT_NGRAM) -> Column:
    """The gram starting at every character position: ``substring(text, i, n)``
    for i = 1..length, shorter at the end. Empty array for an empty string."""
    return _grams_of_length(text, 1, n)


def rule_grams(text: Column, n: int = DEFAULT_NGRAM) -> Column:
    """Grams offered as containment rules: full-length grams starting at
    positions 1..length-n (the last full gram is not offered); a string of at
    most ``n`` characters is offered whole."""
    full = _grams_of_length(text, n, n)
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.slice(full, 1, F.size(full) - 1))


def pieces(text: Column, width: int = DEFAULT_NGRAM) -> Column:
    """Every substring of 1..width characters (with repeats), ``width`` linear passes."""
    return F.concat(*[_grams_of_length(text, L, L) for L in range(1, width + 1)])


def tokenize_sql(text: str, pattern: str = DEFAULT_TOKENIZER) -> str:
    """DuckDB text of :func:`tokenize`: separators stripped from the end, then split."""
    stripped = f"regexp_replace({text}, '(?:{pattern})+$', '')"
    return (f"CASE WHEN {text} IS NULL THEN NULL WHEN length({stripped}) = 0 AND length({text}) > 0 "
            f"THEN CAST([] AS VARCHAR[]) ELSE string_split_regex({stripped}, '{pattern}') END")


def ngrams_sql(text: str, n: int = DEFAULT_NGRAM) -> str:
    """DuckDB text of :func:`ngrams` (as a list)."""
    return f"list_transform(range(1, length({text}) + 1), lambda i: substring({text}, i, {n}))"


def rule_grams_sql(text: str, n: int = DEFAULT_NGRAM) -> str:
    return (f"CASE WHEN length({text}) <= {n} THEN [{text}] ELSE "
            f"list_transform(range(1, length({text}) - {n} + 1), lambda i: substring({text}, i, {n})) END")
