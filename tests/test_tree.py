import duckdb
import pandas as pd
from pyspark.sql import functions as F

from sylva.plans.tree import CONTAINS, LT, Rule, Tree, add_labels, label, label_subtree

TREE = Tree.from_splits({
    "": Rule("x", LT, 5.0),
    "0": Rule("s", CONTAINS, term="a%_'\\b"),
    "1": Rule("x", LT, 8.0),
})
ROWS = [(1, 1, "xa%_'\\by"), (2, 2, "zz"), (3, 6, "q"), (4, 9, "q"), (5, None, "a"), (6, 3, None)]
SCHEMA = "k long, x int, s string"


def _df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_single_node_tree_labels_with_root_id(spark):
    t = Tree()
    assert [r["c"] for r in _df(spark).select(t.to_column().alias("c")).collect()] == [""] * len(ROWS)
    assert t.to_sql() == "''"


def test_true_branch_is_zero_null_goes_to_else(spark):
    got = {r["k"]: r["cluster_id"] for r in label(_df(spark), TREE).collect()}
    # NULL x -> rule x < 5 is NULL -> ELSE child '1', then x < 8 NULL -> '11'
    # NULL s -> contains NULL -> ELSE '01'
    assert got == {1: "00", 2: "01", 3: "10", 4: "11", 5: "11", 6: "01"}


def test_sql_text_equals_column_in_spark_and_duckdb(spark):
    df = _df(spark)
    df.createOrReplaceTempView("t_tree")
    col = {r["k"]: r["cluster_id"] for r in label(df, TREE).collect()}
    via_sql = {r["k"]: r["c"] for r in spark.sql(f"SELECT k, {TREE.to_sql()} AS c FROM t_tree AS T").collect()}
    assert via_sql == col
    con = duckdb.connect()
    con.register("t_tree", pd.DataFrame(ROWS, columns=["k", "x", "s"]).astype({"x": "Int64"}))
    duck = dict(con.execute(f"SELECT k, {TREE.to_sql(dialect='duckdb')} AS c FROM t_tree AS T").fetchall())
    assert duck == col


def test_conditions_select_exactly_the_leaf_rows(spark):
    df = label(_df(spark), TREE)
    total = 0
    for leaf in TREE.leaves():
        by_cond = sorted(r["k"] for r in df.filter(TREE.condition(leaf)).collect())
        by_label = sorted(r["k"] for r in df.filter(F.col("cluster_id") == leaf).collect())
        assert by_cond == by_label
        total += len(by_cond)
    assert total == len(ROWS)


def test_subtree_labels_keep_global_ids(spark):
    got = {r["k"]: r["label"] for r in label_subtree(_df(spark), TREE, "1").collect()}
    assert got == {3: "10", 4: "11", 5: "11"}


def test_add_labels_accepts_tree_or_sql(spark):
    out = add_labels(_df(spark), {"a": TREE, "b": TREE.to_sql(alias=None)})
    assert all(r["a"] == r["b"] for r in out.collect())


def test_node_table_round_trip(spark):
    t2 = Tree.from_dataframe(TREE.to_dataframe(spark))
    assert t2.to_sql() == TREE.to_sql()
    assert Tree.from_json(TREE.to_json()).to_sql() == TREE.to_sql()
    assert TREE.structure()["1"]["id"] == "1"
