"""Saved labelling functions (P9): hand-written trees over the staged tables.

They play the part of the reference's embedded labelling expressions: fixed
trees whose labels feed the pivots, the class-probability matrices and the
multi-tree predictor, so those queries can be checked against SQL.
"""

from __future__ import annotations

from .tree import CONTAINS, LT, Rule, Tree

# st_line: quantity, linenumber, discount_pct, tax_pct (int); linestatus (string)
LINE_A = Tree.from_splits({
    "": Rule("quantity", LT, 26.0),
    "0": Rule("linestatus", CONTAINS, term="F"),
    "1": Rule("discount_pct", LT, 5.0),
    "00": Rule("tax_pct", LT, 4.0),
})
LINE_B = Tree.from_splits({
    "": Rule("tax_pct", LT, 5.0),
    "0": Rule("quantity", LT, 10.0),
    "1": Rule("linenumber", LT, 4.0),
    "01": Rule("discount_pct", LT, 8.0),
})


def halving_tree(bounds: dict[str, tuple[float, float]], depth: int) -> Tree:
    """A full tree of ``depth`` levels: the columns of ``bounds`` in turn, each halved at
    the middle of what the path has left of it."""
    splits = {}

    def grow(node_id: str, left: dict[str, tuple[float, float]]) -> None:
        if len(node_id) == depth:
            return
        column = list(bounds)[len(node_id) % len(bounds)]
        lo, hi = left[column]
        middle = (lo + hi) / 2
        splits[node_id] = Rule(column, LT, middle)
        grow(node_id + "0", left | {column: (lo, middle)})
        grow(node_id + "1", left | {column: (middle, hi)})

    grow("", bounds)
    return Tree.from_splits(splits)


# 256 leaves, the size of the largest trees in use.
LINE_DEEP = halving_tree({"quantity": (1.0, 51.0), "discount_pct": (0.0, 11.0), "tax_pct": (0.0, 9.0), "linenumber": (1.0, 8.0)}, 8)
# st_docs: n_chars (int); text, lang (string)
DOCS_A = Tree.from_splits({
    "": Rule("n_chars", LT, 2000.0),
    "0": Rule("lang", CONTAINS, term="en"),
    "1": Rule("text", CONTAINS, term="http"),
})
# st_event: value_int, hour (int), user_id (bigint)
EVENT_A = Tree.from_splits({
    "": Rule("value_int", LT, 250.0),
    "0": Rule("hour", LT, 12.0),
    "1": Rule("user_id", LT, 75.0),
})
EVENT_B = Tree.from_splits({
    "": Rule("hour", LT, 12.0),
    "0": Rule("value_int", LT, 100.0),
    "1": Rule("user_id", LT, 50.0),
})
