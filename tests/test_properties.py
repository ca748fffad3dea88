"""Property tests: labels from the Column and from DuckDB SQL text agree on random
tables and trees; the entropy identity equals the definition."""

import math

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sylva.functions.entropy import entropy_from_counts
from sylva.plans.tree import CONTAINS, LT, Rule, Tree

ALPHABET = "ab%_'\\ \nxé"


@st.composite
def tables_and_trees(draw):
    n = draw(st.integers(1, 25))
    rows = [(i, draw(st.one_of(st.none(), st.integers(-5, 5))),
             draw(st.one_of(st.none(), st.text(ALPHABET, max_size=6)))) for i in range(n)]
    splits = {}
    frontier = [""]
    for _ in range(draw(st.integers(0, 5))):
        node = frontier.pop(0) if frontier else None
        if node is None:
            break
        if draw(st.booleans()):
            rule = Rule("x", LT, float(draw(st.integers(-5, 5))))
        else:
            rule = Rule("s", CONTAINS, term=draw(st.text(ALPHABET, min_size=1, max_size=2)))
        splits[node] = rule
        frontier += [node + "0", node + "1"]
    return rows, Tree.from_splits(splits)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tables_and_trees())
def test_column_labels_equal_duckdb_sql_labels(spark, case):
    rows, tree = case
    df = spark.createDataFrame(rows, "k long, x int, s string")
    got = {r["k"]: r["c"] for r in df.select("k", tree.to_column().alias("c")).collect()}
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["k", "x", "s"]).astype({"x": "Int64"}))
    want = dict(con.execute(f"SELECT k, {tree.to_sql(dialect='duckdb')} AS c FROM t AS T").fetchall())
    assert got == want
    # every row lands on a leaf, and the leaf's path condition selects it
    assert set(got.values()) <= set(tree.leaves())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 1000), min_size=1, max_size=8), min_size=1, max_size=30))
def test_entropy_identity_equals_definition(spark, groups):
    rows = [(g, v, n) for g, counts in enumerate(groups) for v, n in enumerate(counts)]
    got = {r["g"]: r["entropy"] for r in entropy_from_counts(
        spark.createDataFrame(rows, "g int, v int, n long"), ["g"]).collect()}
    for g, counts in enumerate(groups):
        tot = sum(counts)
        want = sum(c / tot * math.log2(c / tot) for c in counts)
        assert math.isclose(got[g], want, abs_tol=1e-9)
