"""Column-level building blocks: entropy algebra, tokenising, n-grams, hashing."""

from .entropy import entropy_from_counts, xlog2x
from .hashing import row_hash, row_hash_sql, term_order, term_order_sql
from .text import ngrams, rule_grams, tokenize

__all__ = [
    "entropy_from_counts",
    "xlog2x",
    "row_hash",
    "row_hash_sql",
    "term_order",
    "term_order_sql",
    "ngrams",
    "rule_grams",
    "tokenize",
]
