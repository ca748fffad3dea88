"""Tree model: a flat node table that renders as a Column, as SQL text and as
path conditions.

A node id is the path from the root, one character per level: the root is
``''``, the child where the node's rule holds is ``id + '0'``, the other child
(rule false *or NULL*) is ``id + '1'``. A leaf's id is the label every row of
that leaf gets. The tree lives on the driver; it has at most 2^depth leaves and
is never proportional to the data.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LT = "lt"
CONTAINS = "contains"

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def quote_ident(name: str, dialect: str = "spark") -> str:
    if _IDENT.match(name):
        return name
    if dialect == "spark":
        return "`" + name.replace("`", "``") + "`"
    return '"' + name.replace('"', '""') + '"'


def quote_str(value: str, dialect: str = "spark") -> str:
    """A string literal. Spark SQL treats backslash as an escape, DuckDB does not."""
    if dialect == "spark":
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + value.replace("'", "''") + "'"


def num_literal(value: float) -> str:
    v = float(value)
    if v != v or v in (float("inf"), float("-inf")):
        raise ValueError(f"threshold must be finite, got {value}")
    return repr(v)


@dataclass(frozen=True)
class Rule:
    """A binary rule: ``column < value`` (kind ``lt``) or ``column`` contains ``term``."""

    column: str
    kind: str
    value: float | None = None
    term: str | None = None

    def __post_init__(self):
        if self.kind == LT and self.value is None:
            raise ValueError("threshold rule needs a value")
        if self.kind == CONTAINS and self.term is None:
            raise ValueError("containment rule needs a term")
        if self.kind not in (LT, CONTAINS):
            raise ValueError(f"unknown rule kind {self.kind}")

    def column_expr(self) -> Column:
        c = F.col(self.column)
        if self.kind == LT:
            return c < F.lit(float(self.value))
        return c.contains(F.lit(self.term))

    def sql(self, alias: str | None = "T", dialect: str = "spark") -> str:
        ref = (alias + "." if alias else "") + quote_ident(self.column, dialect)
        if self.kind == LT:
            return f"{ref} < {num_literal(self.value)}"
        return f"contains({ref}, {quote_str(self.term, dialect)})"

    def describe(self) -> str:
        if self.kind == LT:
            return f"{self.column} < {num_literal(self.value)}"
        return f"{self.column} contains {self.term!r}"


@dataclass
class Node:
    node_id: str
    n_rows: int | None = None
    rule: Rule | None = None

    @property
    def depth(self) -> int:
        return len(self.node_id)

    @property
    def parent_id(self) -> str | None:
        return None if self.node_id == "" else self.node_id[:-1]


NODE_SCHEMA = T.StructType([
    T.StructField("node_id", T.StringType(), False),
    T.StructField("parent_id", T.StringType(), True),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("n_rows", T.LongType(), True),
    T.StructField("is_leaf", T.BooleanType(), False),
    T.StructField("rule_column", T.StringType(), True),
    T.StructField("rule_kind", T.StringType(), True),
    T.StructField("rule_value", T.DoubleType(), True),
    T.StructField("rule_term", T.StringType(), True),
])


@dataclass
class Tree:
    nodes: dict[str, Node] = field(default_factory=lambda: {"": Node("")})

    # ---- structure -------------------------------------------------------
    @classmethod
    def from_splits(cls, splits: dict[str, Rule], counts: dict[str, int] | None = None) -> "Tree":
        """A tree from ``{node_id: rule}``; every split node gets both children."""
        tree = cls()
        for node_id in sorted(splits, key=len):
            tree.split(node_id, splits[node_id])
        for nid, n in (counts or {}).items():
            if nid in tree.nodes:
                tree.nodes[nid].n_rows = n
        return tree

    def split(self, node_id: str, rule: Rule, n_true: int | None = None, n_false: int | None = None) -> None:
        node = self.nodes[node_id]
        if node.rule is not None:
            raise ValueError(f"node {node_id!r} is already split")
        node.rule = rule
        self.nodes[node_id + "0"] = Node(node_id + "0", n_true)
        self.nodes[node_id + "1"] = Node(node_id + "1", n_false)

    def children(self, node_id: str) -> list[Node]:
        return [self.nodes[c] for c in (node_id + "0", node_id + "1") if c in self.nodes]

    def leaves(self) -> list[str]:
        return sorted(n.node_id for n in self.nodes.values() if n.rule is None)

    @property
    def depth(self) -> int:
        return max(len(n) for n in self.nodes)

    # ---- P1 / P3: labelling ------------------------------------------------
    def to_column(self, node_id: str = "") -> Column:
        """Nested ``CASE``: the leaf id of every row. True branch first, the last
        child is the ``ELSE`` (it also takes NULL rule results)."""
        kids = self.children(node_id)
        node = self.nodes[node_id]
        if node.rule is None or not kids:
            return F.lit(node_id)
        if len(kids) == 1:
            return self.to_column(kids[0].node_id)
        return F.when(node.rule.column_expr(), self.to_column(kids[0].node_id)).otherwise(
            self.to_column(kids[1].node_id))

    def to_sql(self, node_id: str = "", alias: str | None = "T", dialect: str = "spark", indent: int = 0) -> str:
        """SQL text of :meth:`to_column`; leaf ids in single quotes."""
        kids = self.children(node_id)
        node = self.nodes[node_id]
        if node.rule is None or not kids:
            return quote_str(node_id, dialect)
        if len(kids) == 1:
            return self.to_sql(kids[0].node_id, alias, dialect, indent)
        pad = "  " * (indent + 1)
        return (
            "CASE\n"
            f"{pad}WHEN {node.rule.sql(alias, dialect)} THEN {self.to_sql(kids[0].node_id, alias, dialect, indent + 1)}\n"
            f"{pad}ELSE {self.to_sql(kids[1].node_id, alias, dialect, indent + 1)}\n"
            f"{'  ' * indent}END"
        )

    # ---- P2: path conditions ---------------------------------------------
    def path(self, node_id: str) -> list[tuple[Rule, bool]]:
        """(rule, outcome) pairs from the root to ``node_id``."""
        out = []
        for i, ch in enumerate(node_id):
            rule = self.nodes[node_id[:i]].rule
            if rule is None:
                raise ValueError(f"{node_id!r} is not a node of this tree")
            out.append((rule, ch == "0"))
        return out

    def conditions(self, node_id: str) -> list[Column]:
        """Predicates selecting exactly the rows routed to ``node_id`` (the false
        branch includes rows where the rule is NULL)."""
        return [r.column_expr() if ok else ~F.coalesce(r.column_expr(), F.lit(False))
                for r, ok in self.path(node_id)]

    def bounds(self, node_id: str) -> dict[str, tuple[float | None, float | None]]:
        """Per threshold column of the path its interval (low, high): low <= column < high. Without a
        ``high`` NULL is inside too, since it takes the false branch of every rule."""
        out: dict[str, tuple[float | None, float | None]] = {}
        for r, ok in self.path(node_id):
            if r.kind != LT:
                continue
            low, high = out.get(r.column, (None, None))
            v = float(r.value)
            out[r.column] = (low, v if high is None else min(high, v)) if ok else (v if low is None else max(low, v), high)
        return out

    def condition(self, node_id: str) -> Column:
        """The rows routed to ``node_id``, as one interval per threshold column and plain tests of
        the terms, which a parquet scan takes as filters."""
        conds = []
        for name, (low, high) in self.bounds(node_id).items():
            c = F.col(name)
            if high is not None:
                conds.append(c < _threshold(high))
                if low is not None:
                    conds.append(c >= _threshold(low))
            else:
                conds.append((c >= _threshold(low)) | c.isNull())
        for r, ok in self.path(node_id):
            if r.kind == CONTAINS:
                conds.append(r.column_expr() if ok else ~r.column_expr() | F.col(r.column).isNull())
        return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)

    def conditions_sql(self, node_id: str, alias: str | None = "T", dialect: str = "spark") -> list[str]:
        return [r.sql(alias, dialect) if ok else f"NOT coalesce({r.sql(alias, dialect)}, false)"
                for r, ok in self.path(node_id)]

    def condition_sql(self, node_id: str, alias: str | None = "T", dialect: str = "spark") -> str:
        conds = self.conditions_sql(node_id, alias, dialect)
        return " AND ".join(f"({c})" for c in conds) if conds else "true"

    def subtree(self, node_id: str) -> "Tree":
        """The subtree under ``node_id`` with its ids kept (labels stay global)."""
        t = Tree(nodes={})
        for nid, n in self.nodes.items():
            if nid.startswith(node_id):
                t.nodes[nid] = Node(nid, n.n_rows, n.rule)
        t._root = node_id
        return t

    # ---- T9: structure and serialisation ------------------------------------
    def structure(self, node_id: str = "") -> dict:
        """Nested ``{"id": ..., "rows": ..., "0": {...}, "1": {...}}``."""
        node = self.nodes[node_id]
        out: dict = {"id": node_id, "rows": node.n_rows}
        if node.rule is not None:
            out["rule"] = node.rule.describe()
        for k in self.children(node_id):
            out[k.node_id[-1]] = self.structure(k.node_id)
        return out

    def rows(self) -> list[tuple]:
        out = []
        for nid in sorted(self.nodes, key=lambda s: (len(s), s)):
            n = self.nodes[nid]
            r = n.rule
            out.append((nid, n.parent_id, len(nid), n.n_rows, r is None,
                        r.column if r else None, r.kind if r else None,
                        float(r.value) if r and r.value is not None else None,
                        r.term if r else None))
        return out

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_SCHEMA)

    def outline(self, spark: SparkSession) -> DataFrame:
        """T9 as a table: a row per node with its children, rule text and leaves below."""
        leaves = self.leaves()
        rows = []
        for nid, n in self.nodes.items():
            kids = [c.node_id for c in self.children(nid)] or [None, None]
            rows.append((nid, n.parent_id, *kids, n.n_rows, n.rule.describe() if n.rule else None,
                         sum(leaf.startswith(nid) for leaf in leaves)))
        return spark.createDataFrame(rows, "node_id string, parent_id string, child_true string, child_false string, "
                                           "n_rows bigint, rule string, n_leaves bigint")

    @classmethod
    def from_rows(cls, rows) -> "Tree":
        tree = cls(nodes={})
        for r in rows:
            d = r.asDict() if hasattr(r, "asDict") else dict(zip(NODE_SCHEMA.names, r))
            rule = None
            if not d["is_leaf"]:
                rule = Rule(d["rule_column"], d["rule_kind"], d["rule_value"], d["rule_term"])
            tree.nodes[d["node_id"]] = Node(d["node_id"], d["n_rows"], rule)
        return tree

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> "Tree":
        return cls.from_rows(df.collect())

    def to_json(self) -> str:
        return json.dumps([dict(zip(NODE_SCHEMA.names, r)) for r in self.rows()])

    @classmethod
    def from_json(cls, text: str) -> "Tree":
        return cls.from_rows([tuple(d[k] for k in NODE_SCHEMA.names) for d in json.loads(text)])


def _threshold(value: float) -> Column:
    """A whole number as a bigint: against an integer column it reaches the scan, a double doesn't always."""
    v = float(value)
    return F.lit(int(v)).cast("bigint") if v.is_integer() and abs(v) < 2.0**62 else F.lit(v)


#: Leaves up to which a label is one nested ``CASE``; the code of a larger one is more than the JVM compiles.
NESTED_LEAVES = 64


def is_large(tree: Tree) -> bool:
    """Too large for one ``CASE``, and every split node has both children."""
    return len(tree.leaves()) > NESTED_LEAVES and all(n.rule is None or len(tree.children(n.node_id)) == 2 for n in tree.nodes.values())


def descend(df: DataFrame, tree: Tree, name: str) -> DataFrame:
    """P4 for large trees. A row's node is a number, its path's bits behind a one. The upper levels are one nested
    ``CASE``; each level below is a projection that looks up the rule of that node (column and threshold or
    term, literals of the plan) and appends the outcome, so its code grows with the columns, not with the leaves.
    (Every projection rests on the one before: the optimiser's time grows fast with their number, so the levels
    that one method can hold are taken at once.)"""
    ints = sorted({n.rule.column for n in tree.nodes.values() if n.rule and n.rule.kind == LT})
    strs = sorted({n.rule.column for n in tree.nodes.values() if n.rule and n.rule.kind == CONTAINS})
    taken = {c.lower() for c in df.columns}
    at = next(f"_{'_' * i}at" for i in range(len(taken) + 1) if f"_{'_' * i}at" not in taken)
    upper = NESTED_LEAVES.bit_length() - 1

    def above(nid: str) -> str:
        rule = tree.nodes[nid].rule
        if rule is None or len(nid) == upper:
            return str(int("1" + nid, 2))
        return f"CASE WHEN {rule.sql(alias=None)} THEN {above(nid + '0')} ELSE {above(nid + '1')} END"

    out = df.withColumn(at, F.expr(above("")))
    for depth in range(upper, tree.depth):
        rules = [tree.nodes[nid].rule if (nid := format(i, f"0{depth}b")) in tree.nodes else None for i in range(1 << depth)]
        tests = []
        for k, (kind, columns) in enumerate(((LT, ints), (CONTAINS, strs))):
            for j, c in enumerate(columns):
                if not any(r and r.kind == kind and r.column == c for r in rules):
                    continue
                of = [j + len(ints) * k if r and r.kind == kind and r.column == c else None for r in rules]
                values = [(float(r.value) if kind == LT else r.term) if r and r.kind == kind and r.column == c else None for r in rules]
                own = f"get(from_json({quote_str(json.dumps(values))}, 'array<{'double' if kind == LT else 'string'}>'), {at} - {1 << depth})"
                held = f"{quote_ident(c)} < {own}" if kind == LT else f"contains({quote_ident(c)}, {own})"
                mine = f"get(from_json({quote_str(json.dumps([o is not None for o in of]))}, 'array<boolean>'), {at} - {1 << depth})"
                tests.append(f"WHEN {mine} THEN CASE WHEN {held} THEN {at} * 2 ELSE {at} * 2 + 1 END")
        if tests:
            out = out.withColumn(at, F.expr(f"CASE {' '.join(tests)} ELSE {at} END"))
    return out.withColumn(name, F.expr(f"substring(bin({at}), 2)")).drop(at)


def label(df: DataFrame, tree: Tree, name: str = "cluster_id") -> DataFrame:
    """Every row with its leaf id."""
    return descend(df, tree, name) if is_large(tree) else df.withColumn(name, tree.to_column())


def publish(spark: SparkSession, name: str, tree: Tree, df: DataFrame) -> str:
    """The tree as a temporary SQL function of its columns, typed as in ``df``, so that user SQL labels
    by name. Returns the call, ``name(column, ...)``."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = [c for c in df.columns if any(n.rule and n.rule.column == c for n in tree.nodes.values())]
    takes = ", ".join(f"{quote_ident(c)} {types[c]}" for c in columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quote_ident(name)}({takes}) RETURNS STRING RETURN {tree.to_sql(alias=None)}")
    return f"{quote_ident(name)}({', '.join(map(quote_ident, columns))})"


def label_subtree(df: DataFrame, tree: Tree, node_id: str, name: str = "label") -> DataFrame:
    """P5: the rows of one subtree, labelled with their leaf under it."""
    return df.filter(tree.condition(node_id)).withColumn(name, tree.to_column(node_id))


def add_labels(df: DataFrame, functions: dict[str, "Tree | str"]) -> DataFrame:
    """``T.*`` plus one label column per labelling function, given as a
    tree or as a SQL expression over the columns."""
    large = {name: fn for name, fn in functions.items() if isinstance(fn, Tree) and is_large(fn)}
    cols = [(fn.to_column() if isinstance(fn, Tree) else F.expr(fn)).alias(name) for name, fn in functions.items() if name not in large]
    out = df.select("*", *cols)
    for name, tree in large.items():
        out = descend(out, tree, name)
    return out
