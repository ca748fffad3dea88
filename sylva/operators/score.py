"""Rule scoring (T4, T5, K3) for every node and candidate of a level, without a join.

A row isn't held against every rule. Per rule column it gets one small code that tells the
outcome of all of its node's rules there: for thresholds the number of those that are at most the
value (the interval it lies in), for terms a bit each. One aggregation over (node,
entropy column, value) with map-side partial aggregation holds a sum per rule, the rows of its true
branch, read off the codes; the rest is the false branch's. (With more than ``SUMMED`` rules per node
it counts (node, column, code, entropy column, value) instead, and the branches are sums over that.) Rules are literals of the plan (nodes x columns x ``rule_samples`` at most,
parameters), looked up by the row's node. A hot node or class costs nothing extra, since the
shuffle carries distinct keys only. Fitness follows from the counts by the identity

    rows_b * H(b) = sum(n log2 n) - rows_b log2 rows_b
    N * H(route)  = sum_b rows_b log2 rows_b - N log2 N

    fitness = sum_b sum_col w_col * rows_b * H(b, col) - f * N * H(route)

(entropies negative; higher fitness is better).

Text entropy columns (A10) count their n-grams and words once per node: each distinct gram carries, per
place among the codes, how many of its occurrences lie in the true branch of the rule there, and
the rest is the false branch's; texts are never exploded per rule.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.entropy import entropy_expr, xlog2x
from ..functions.text import DEFAULT_NGRAM, DEFAULT_TOKENIZER
from ..plans.tree import quote_ident, quote_str
from .cells import GRAM, TEXT, WORD, named, numbered_cells, part_key, text_kinds
from .profile import string_entropy

RULE_SCHEMA = T.StructType([
    T.StructField("node_id", T.StringType(), False),
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("col_name", T.StringType(), False),
    T.StructField("col_pos", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("num_value", T.DoubleType(), True),
    T.StructField("term", T.StringType(), True),
    T.StructField("idx", T.IntegerType(), False),
])
#: Terms that share a code: it has 2^TERMS values at most.
TERMS = 8
#: Rules per node up to which the counts hold a sum for each.
SUMMED = 64
#: Thresholds up to which a code is a sum of comparisons; beyond, the list is searched.
UNROLLED = 16


def number_rules(rows: list, int_cols: list[str], str_cols: list[str]) -> list[tuple]:
    """Give collected candidates a rule id in tie-break order (node, column
    position, value, term) and their index into the feature arrays."""
    def key(r):
        return (r["node_id"], r["col_pos"], r["num_value"] if r["num_value"] is not None else 0.0, r["term"] or "")
    out = []
    for i, r in enumerate(sorted(rows, key=key)):
        idx = (int_cols.index(r["col_name"]) if r["kind"] == "lt" else str_cols.index(r["col_name"])) + 1
        out.append((r["node_id"], i, r["col_name"], r["col_pos"], r["kind"], r["num_value"], r["term"], idx))
    return out


def _constant(value, schema: str) -> str:
    """SQL text of a nested list as one literal (folded before the plan runs)."""
    return f"from_json({quote_str(json.dumps(value))}, '{schema}')"


class Codes:
    """The rules of a level laid out by coded column and node."""

    def __init__(self, rules: list[tuple]):
        self.rules = {r[1]: r for r in rules}
        self.nodes = sorted({r[0] for r in rules})
        at = {n: i for i, n in enumerate(self.nodes)}
        columns: dict[tuple, list[list]] = {}
        for node, rule_id, name, pos, kind, value, term, _ in sorted(rules, key=lambda r: (r[0], r[3], r[5] or 0.0, r[1])):
            part = 0
            if kind != "lt":    # the next code with a free bit
                while len(columns.get((pos, name, kind, part), [[]] * len(at))[at[node]]) == TERMS:
                    part += 1
            held = columns.setdefault((pos, name, kind, part), [[] for _ in at])
            held[at[node]].append((value if kind == "lt" else term, rule_id))
        self.columns = [(name, kind) for _, name, kind, _ in sorted(columns)]
        self.values = [[[v for v, _ in own] for own in columns[k]] for k in sorted(columns)]
        self.ids = [[[i for _, i in own] for own in columns[k]] for k in sorted(columns)]
        self.places = [max(len(own) for own in v) for v in self.values]

    def node(self, node_col: str = "node_id") -> Column:
        """The node's number, -1 for nodes without rules."""
        return F.expr(f"cast(array_position({_constant(self.nodes, 'array<string>')}, {quote_ident(node_col)}) AS int) - 1")

    def code(self, j: int) -> Column:
        """Of a row, for the ``j``-th coded column. NULL counts as beyond all thresholds and as no
        term: it is in the false branch of every rule."""
        name, kind = self.columns[j]
        item, c = "double" if kind == "lt" else "string", quote_ident(name)

        def one(s: int) -> str:
            return f"get({_constant([own[s] if s < len(own) else None for own in self.values[j]], f'array<{item}>')}, _node)"

        if kind != "lt":
            return F.expr(" + ".join(f"CASE WHEN contains({c}, {one(s)}) THEN {1 << s} ELSE 0 END" for s in range(self.places[j])))
        if self.places[j] > UNROLLED:
            passed = f"size(filter(get({_constant(self.values[j], 'array<array<double>>')}, _node), t -> t <= {c}))"
        else:
            passed = " + ".join(f"CASE WHEN {c} >= {one(s)} THEN 1 ELSE 0 END" for s in range(self.places[j]))
        return F.expr(f"CASE WHEN {c} IS NULL THEN {self.places[j]} ELSE {passed} END")

    def holds(self, j: int, s: int) -> str:
        """SQL text: whether the rule at place ``s`` of coded column ``j`` holds for a code."""
        return f"c{j} <= {s}" if self.columns[j][1] == "lt" else f"shiftright(c{j}, {s}) & 1 = 1"

    def coded(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """(node, c0, c1, ..., keep...) of the rows whose node has rules; the kept columns are k0, k1, ..."""
        rows = df.withColumn("_node", self.node()).filter(F.col("_node") >= 0)
        return rows.select(F.col("_node").alias("node"), *[self.code(j).alias(f"c{j}") for j in range(len(self.columns))],
                           *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)])


def _categorical(coded: DataFrame, codes: Codes, class_cols: list[str], keep: list[str]) -> DataFrame:
    """Per (rule, branch, column): rows and negative entropy of the column's values. Without
    class columns one made-up value stands for all, so that the branches' rows come out.

    A row goes once into the counts of its (node, column, value), which hold a sum per rule: the rows of its true branch."""
    if sum(codes.places) > SUMMED:
        return _by_code(coded, codes, class_cols, keep)
    places = [(j, s) for j in range(len(codes.columns)) for s in range(codes.places[j])]
    names = [f"t{p}" for p in range(len(places))]
    true = [F.expr(f"sum(cast({codes.holds(j, s)} AS bigint)) AS t{p}") for p, (j, s) in enumerate(places)]
    if len(class_cols) > 1:
        values = [F.struct(F.lit(c).alias("col_name"), F.col(f"k{keep.index(c)}").cast("string").alias("value")) for c in class_cols]
        cells = coded.withColumn("e", F.explode(F.array(*values))).withColumns({"col_name": F.col("e.col_name"), "value": F.col("e.value")})
        counts = cells.groupBy("node", "col_name", "value").agg(F.count(F.lit(1)).alias("n"), *true)
    elif class_cols:    # whole numbers are counted by the value itself, whose text comes one to one
        k = f"k{keep.index(class_cols[0])}"
        value = F.col(k) if isinstance(coded.schema[k].dataType, T.IntegralType) else F.col(k).cast("string")
        counts = coded.withColumn("value", value).groupBy("node", "value").agg(
            F.count(F.lit(1)).alias("n"), *true).withColumn("col_name", F.lit(class_cols[0]))
    else:
        counts = coded.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *true).withColumn("col_name", F.lit(""))
    by_rule = counts.select("node", "col_name", "n", F.posexplode(F.array(*names)).alias("p", "t")).select(
        F.expr(f"get(get({_ids(codes, places)}, p), node)").alias("rule_id"), "col_name",
        F.posexplode(F.array(F.col("t"), F.col("n") - F.col("t"))).alias("branch", "n"))
    return _per_column(by_rule.filter(F.col("rule_id").isNotNull() & (F.col("n") > 0)))


def _ids(codes: Codes, places: list[tuple[int, int]]) -> str:
    """SQL text: the rule ids by place and node."""
    return _constant([[codes.ids[j][n][s] if s < len(codes.ids[j][n]) else None for n in range(len(codes.nodes))] for j, s in places],
                     "array<array<int>>")


def _per_column(by_value: DataFrame) -> DataFrame:
    """(rule, branch, column, rows, entropy) of the counts ``n`` of each value."""
    per_col = by_value.groupBy("rule_id", "branch", "col_name").agg(
        F.sum("n").alias("rows"), F.sum(xlog2x(F.col("n"))).alias("nl"), F.count(F.lit(1)).alias("nv"))
    return per_col.select("rule_id", "branch", "col_name", "rows",
                          entropy_expr(F.col("rows"), F.col("nl"), F.col("nv")).alias("entropy"))


def _by_code(coded: DataFrame, codes: Codes, class_cols: list[str], keep: list[str]) -> DataFrame:
    """:func:`_categorical` for very many rules: a row goes into the counts once per coded column.

    A plan with a sum per rule would be more than the JVM compiles."""
    intervals = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"c{j}").alias("code")) for j in range(len(codes.columns))])
    values = [F.struct(F.lit(c).alias("col_name"), F.col(f"k{keep.index(c)}").cast("string").alias("value")) for c in class_cols]
    if not values:
        values = [F.struct(F.lit("").alias("col_name"), F.lit("").alias("value"))]
    cells = coded.select("node", intervals.alias("i"), F.explode(F.array(*values)).alias("e")).select(
        "node", "e", F.explode("i").alias("i"))
    counts = cells.groupBy("node", "i.j", "i.code", "e.col_name", "e.value").agg(F.count(F.lit(1)).alias("n"))
    own = F.expr(f"get(get({_constant(codes.ids, 'array<array<array<int>>>')}, j), node)")
    is_lt = _constant([k == "lt" for _, k in codes.columns], "array<boolean>")
    sums = counts.select("j", "code", "col_name", "value", "n", F.posexplode(own).alias("s", "rule_id")).select(
        "rule_id", "col_name", "value", "n",
        F.expr(f"CASE WHEN get({is_lt}, j) THEN cast(code > s AS int) ELSE 1 - (shiftright(code, s) & 1) END").alias("branch"))
    by_value = sums.groupBy("rule_id", "branch", "col_name", "value").agg(F.sum("n").alias("n"))
    return _per_column(by_value)


def _text(coded: DataFrame, codes: Codes, columns: list[str], keep: list[str], branches: DataFrame, ngram: int,
          tokenizer: str) -> DataFrame:
    """Per (rule, branch, text column): rows and A10. ``branches``: rows by (rule, branch)."""
    kept = ["node", *[f"c{j}" for j in range(len(codes.columns))]]
    wanted = text_kinds(columns, (GRAM, WORD, TEXT), ngram)
    key = ["node", *part_key(wanted)]
    cells = numbered_cells(coded.select(*kept, *[F.col(f"k{keep.index(c)}").alias(c) for c in columns]), kept, wanted,
                           ngram, tokenizer).filter(F.col("value").isNotNull())
    places = [(j, s) for j in range(len(codes.columns)) for s in range(codes.places[j])]
    true = [F.expr(f"sum(cast({codes.holds(j, s)} AS bigint)) AS t{p}") for p, (j, s) in enumerate(places)]
    grams = cells.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), *true)
    both = grams.select(*key, "n", F.posexplode(F.array(*[f"t{p}" for p in range(len(places))])).alias("p", "t"))
    f = F.col("n") - F.col("t")
    sums = both.groupBy(*key, "p").agg(
        F.sum("t").alias("n0"), F.sum(xlog2x(F.col("t"))).alias("nl0"), F.sum((F.col("t") > 0).cast("int")).alias("nv0"),
        F.sum(f).alias("n1"), F.sum(xlog2x(f)).alias("nl1"), F.sum((f > 0).cast("int")).alias("nv1"))
    ids = _ids(codes, places)
    sides = F.array(*[F.struct(F.lit(b).alias("branch"), F.col(f"n{b}").alias("n"),
                               entropy_expr(F.col(f"n{b}"), F.col(f"nl{b}"), F.col(f"nv{b}")).alias("h")) for b in (0, 1)])
    by_kind = named(sums, wanted).select(F.expr(f"get(get({ids}, p), node)").alias("rule_id"), "col_name", "kind", F.explode(sides).alias("b")).select(
        "rule_id", "col_name", "kind", "b.*").filter(F.col("rule_id").isNotNull() & (F.col("n") > 0))
    per_col = by_kind.groupBy("rule_id", "branch", "col_name").agg(
        F.max(F.when(F.col("kind") == GRAM, F.col("h"))).alias("gram"), F.max(F.when(F.col("kind") == WORD, F.col("h"))).alias("word"),
        F.max(F.when(F.col("kind") == TEXT, F.col("n"))).alias("texts"))
    gram = F.coalesce(F.try_divide(F.col("gram"), F.col("texts").cast("double")), F.lit(0.0))
    word = F.coalesce("word", F.lit(0.0))
    entropy = F.when((gram == 0) | (word == 0), gram + word).otherwise((gram + word) / 2)
    every = branches.select("rule_id", "branch", "rows", F.explode(F.array(*[F.lit(c) for c in columns])).alias("col_name"))
    return every.join(per_col, ["rule_id", "branch", "col_name"], "left").select(
        "rule_id", "branch", "col_name", "rows", F.coalesce(entropy, F.lit(0.0)).alias("entropy"))


def _rule_stats(df: DataFrame, codes: Codes, weights: dict[str, float], class_cols: list[str], ngram: int,
                tokenizer: str) -> DataFrame:
    """Per (rule, branch, entropy column): rows, entropy, weight."""
    cat, txt = [c for c in weights if c in class_cols], [c for c in weights if c not in class_cols]
    keep = [*cat, *txt]
    coded = codes.coded(df, keep)
    out = _categorical(coded, codes, cat, keep)
    if txt:
        first = F.lit(cat[0] if cat else "")
        text = _text(coded, codes, txt, keep, out.filter(F.col("col_name") == first), ngram, tokenizer)
        out = out.unionByName(text) if cat else text
    return out.withColumn("weight", _weight(weights))


def _weight(weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))]), F.col("col_name"))


def branch_stats(df: DataFrame, keys: list[str], weights: dict[str, float], class_cols: list[str],
                 ngram: int = DEFAULT_NGRAM, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Per (keys..., column): ``rows`` and ``entropy`` for every entropy column;
    categorical columns by value counts, text columns by A10."""
    cat = [c for c in weights if c in class_cols]
    txt = [c for c in weights if c not in class_cols]
    parts = []
    if cat:
        arr = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for c in cat])
        counts = df.select(*keys, F.explode(arr).alias("_e")).groupBy(*keys, "_e.col_name", "_e.value").agg(
            F.count(F.lit(1)).alias("n"))
        per_col = counts.groupBy(*keys, "col_name").agg(
            F.sum("n").alias("rows"), F.sum(xlog2x(F.col("n"))).alias("_nl"), F.count(F.lit(1)).alias("_nv"))
        parts.append(per_col.select(*keys, "col_name", "rows", entropy_expr(F.col("rows"), F.col("_nl"), F.col("_nv")).alias("entropy")))
    if txt:
        rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        ent = string_entropy(df.select(*keys, *txt), txt, keys, ngram, tokenizer).select(*keys, "col_name", "entropy")
        parts.append(ent.join(rows, keys).select(*keys, "col_name", "rows", "entropy"))
    return reduce(DataFrame.unionByName, parts).withColumn("weight", _weight(weights))


def _listed(rules: "DataFrame | list[tuple]") -> list[tuple]:
    return [tuple(r) for r in (rules.collect() if isinstance(rules, DataFrame) else rules)]


def _meta(codes: Codes) -> list[Column]:
    """The rule's node, column, kind, value and term, looked up by ``rule_id``."""
    top = max(codes.rules, default=-1) + 1

    def by_id(field: int, kind: str) -> Column:
        values = [codes.rules[i][field] if i in codes.rules else None for i in range(top)]
        return F.expr(f"get({_constant(values, f'array<{kind}>')}, rule_id)")

    return [by_id(0, "string").alias("node_id"), by_id(2, "string").alias("rule_column"), by_id(4, "string").alias("kind"),
            by_id(5, "double").alias("num_value"), by_id(6, "string").alias("term")]


REPORT = ("node_id string, rule_id int, branch int, col_name string, rows bigint, entropy double, weight double, n_rows bigint, "
          "n_branches bigint, route_entropy double, fitness double, rule_column string, kind string, num_value double, term string")


def score_rules(df: DataFrame, rules: "DataFrame | list[tuple]", int_cols: list[str], str_cols: list[str],
                weights: dict[str, float], class_cols: list[str], selection_factor: float = 1.0,
                ngram: int = DEFAULT_NGRAM, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """T5: per (node, rule, branch, entropy column) the branch rows and entropy,
    the rule's route entropy and fitness. ``rules`` follows ``RULE_SCHEMA``: a list, or a
    DataFrame that is collected (the candidates of a level, bounded by parameters)."""
    codes = Codes(_listed(rules))
    if not codes.nodes:
        return df.sparkSession.createDataFrame([], REPORT)
    per_col = _rule_stats(df, codes, weights, class_cols, ngram, tokenizer)
    # Rule totals by windows over the small per-column table (a self-join would
    # make Spark run the aggregation twice). Every branch has one row
    # per entropy column; the first column's rows stand for the branch.
    rep = F.col("col_name") == F.lit(next(iter(weights)))
    w = Window.partitionBy("rule_id")
    scored = per_col.select(
        "*",
        F.sum(F.when(rep, F.col("rows"))).over(w).alias("n_rows"),
        F.sum(F.when(rep, 1).otherwise(0)).over(w).alias("n_branches"),
        F.sum(F.when(rep, xlog2x(F.col("rows")))).over(w).alias("_route_nl"),
        F.sum(F.col("weight") * F.col("entropy") * F.col("rows")).over(w).alias("_branch_sum"))
    scored = scored.withColumn(
        "route_entropy", entropy_expr(F.col("n_rows"), F.col("_route_nl"), F.col("n_branches"))).withColumn(
        "fitness", F.col("_branch_sum") - F.lit(float(selection_factor)) * F.col("route_entropy") * F.col("n_rows"))
    node, *meta = _meta(codes)
    return scored.select(node, *[c for c in scored.columns if c not in ("_route_nl", "_branch_sum")], *meta)


def _compared():
    """Fitness per row of the node, as rules are compared by: the sum itself grows with
    the node, and its rounding errors with it."""
    return F.round(F.col("fitness") / (F.coalesce("rows_true", F.lit(0)) + F.coalesce("rows_false", F.lit(0))), 12)


def best_rules(report: DataFrame, require_two_branches: bool = True) -> DataFrame:
    """K3: per node the rule with the highest fitness; ties go to the lower rule
    id (column position, value, term). Fitness is compared per row of the node at 12
    decimals, so two rules whose sums differ only by floating-point summation order
    (e.g. mirror splits) tie the same way in every run, partitioning and engine,
    however large the node. One row per
    node: the winning rule and its two branch sizes."""
    per_rule = report.groupBy("node_id", "rule_id", "rule_column", "kind", "num_value", "term").agg(
        F.first("fitness").alias("fitness"), F.first("n_branches").alias("n_branches"),
        F.max(F.when(F.col("branch") == 0, F.col("rows"))).alias("rows_true"),
        F.max(F.when(F.col("branch") == 1, F.col("rows"))).alias("rows_false"),
        F.sum(F.when(F.col("branch") == 0, F.col("weight") * F.col("entropy"))).alias("entropy_true"),
        F.sum(F.when(F.col("branch") == 1, F.col("weight") * F.col("entropy"))).alias("entropy_false"))
    if require_two_branches:
        per_rule = per_rule.filter(F.col("n_branches") == 2)
    w = Window.partitionBy("node_id").orderBy(_compared().desc(), F.col("rule_id"))
    return per_rule.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def score_best(df: DataFrame, rules: "DataFrame | list[tuple]", int_cols: list[str], str_cols: list[str],
               weights: dict[str, float], class_cols: list[str], selection_factor: float = 1.0,
               ngram: int = DEFAULT_NGRAM, tokenizer: str = DEFAULT_TOKENIZER, with_rule: bool = True) -> DataFrame:
    """T4 + K3 without the per-column report: the same winners as
    ``best_rules(score_rules(...))`` (fitness compared per row), one
    aggregation per rule and one window per node — what the build needs.
    ``with_rule=False`` leaves out the rule's column/kind/value/term (a caller
    holding the numbered rules looks them up by ``rule_id``)."""
    codes = Codes(_listed(rules))
    if not codes.nodes:
        raise ValueError("no rules to score")
    per_col = _rule_stats(df, codes, weights, class_cols, ngram, tokenizer)
    rep = F.col("col_name") == F.lit(next(iter(weights)))
    went = F.col("weight") * F.col("entropy")
    # rules x branches x entropy columns rows by now: one task, no further shuffle
    per_rule = per_col.coalesce(1).groupBy("rule_id").agg(
        F.sum(F.when(rep, F.col("rows"))).alias("n_rows"),
        F.sum(F.when(rep, 1).otherwise(0)).alias("n_branches"),
        F.sum(F.when(rep, xlog2x(F.col("rows")))).alias("_route_nl"),
        F.sum(went * F.col("rows")).alias("_branch_sum"),
        F.max(F.when(rep & (F.col("branch") == 0), F.col("rows"))).alias("rows_true"),
        F.max(F.when(rep & (F.col("branch") == 1), F.col("rows"))).alias("rows_false"),
        F.sum(F.when(F.col("branch") == 0, went)).alias("entropy_true"),
        F.sum(F.when(F.col("branch") == 1, went)).alias("entropy_false"))
    route = entropy_expr(F.col("n_rows"), F.col("_route_nl"), F.col("n_branches"))
    node, *meta = _meta(codes)
    per_rule = per_rule.filter(F.col("n_branches") == 2).withColumn(
        "fitness", F.col("_branch_sum") - F.lit(float(selection_factor)) * route * F.col("n_rows")).drop("_route_nl", "_branch_sum")
    per_rule = per_rule.select(node, "*", *(meta if with_rule else []))
    w = Window.partitionBy("node_id").orderBy(_compared().desc(), F.col("rule_id"))
    return per_rule.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
