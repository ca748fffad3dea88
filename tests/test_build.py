import json

from pyspark.sql import functions as F

from sylva.functions.hashing import level_seed
from sylva.operators import validate
from sylva.operators.sampling import sample_per_group, split_train_test
from sylva.plans.build import BuildParams, build_tree, entropy_spec
from sylva.plans.tree import CONTAINS, LT, Rule, Tree, label

from .conftest import SF_SMALL


def _rule_table(spark, n=4000):
    """Class is a known rule of an int and a text column, plus 5 % noise."""
    df = spark.range(0, n).select(
        F.col("id").alias("k"),
        (F.col("id") * 7919 % 20).cast("int").alias("a"),
        (F.col("id") * 104729 % 37).cast("int").alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit("red apple pie")).when(F.col("id") % 3 == 1, F.lit("green pear tart"))
        .otherwise(F.lit("blue plum cake")).alias("t"))
    rule = F.when(F.col("a") < 10, F.when(F.col("t").contains("pear"), 1).otherwise(0)).otherwise(2)
    noise = (F.col("k") * 31 % 20) == 0
    return df.withColumn("y", F.when(noise, (rule + 1) % 3).otherwise(rule).cast("int"))


def test_build_learns_a_known_rule(spark):
    df = _rule_table(spark)
    train, test = split_train_test(df, "k")
    # thresholds come from a per-node sample, so give it enough rows to offer a < 10
    res = build_tree(train, "k", ["y"], params=BuildParams(max_depth=3, min_node_size=50, rule_samples=20))
    acc = validate.leaf_accuracy(label(test, res.tree), "cluster_id", "y",
                                 fit=label(train, res.tree)).first()["accuracy"]
    assert acc > 0.85     # 5 % of the classes are noise
    used = {n.rule.column for n in res.tree.nodes.values() if n.rule}
    assert {"a", "t"} <= used


def test_leaves_partition_the_table_and_counts_match(spark):
    df = _rule_table(spark, 3000)
    res = build_tree(df, "k", ["y"], params=BuildParams(max_depth=3, min_node_size=100))
    counts = {r["cluster_id"]: r["count"] for r in label(df, res.tree).groupBy("cluster_id").count().collect()}
    assert set(counts) == set(res.tree.leaves())
    assert sum(counts.values()) == 3000
    for leaf, n in counts.items():
        assert res.tree.nodes[leaf].n_rows == n


def test_same_tree_under_any_partitioning(spark):
    df = _rule_table(spark, 3000)
    a = build_tree(df, "k", ["y"], params=BuildParams(max_depth=3, min_node_size=100))
    b = build_tree(df.repartition(13), "k", ["y"], params=BuildParams(max_depth=3, min_node_size=100))
    assert a.tree.to_json() == b.tree.to_json()


def test_small_or_pure_nodes_stop(spark):
    df = spark.range(0, 500).select(F.col("id").alias("k"), (F.col("id") % 10).cast("int").alias("x"),
                                    F.lit(1).alias("y"))
    res = build_tree(df, "k", ["y"], params=BuildParams(max_depth=4, min_node_size=100))
    assert res.tree.leaves() == [""]          # pure root
    res = build_tree(df, "k", ["y"], params=BuildParams(max_depth=4, min_node_size=1000))
    assert res.tree.leaves() == [""]          # too small


def test_large_pure_nodes_stop_unless_bounded(spark):
    df = spark.range(0, 30_000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("int").alias("x"),
                                       (F.col("id") % 10 < 5).cast("int").alias("y"))
    res = build_tree(df.withColumn("y", F.lit(1)), "k", ["y"], params=BuildParams(max_depth=2))
    assert res.tree.leaves() == [""]          # 30,000 rows of one class
    res = build_tree(df.withColumn("y", F.lit(1)), "k", ["y"], params=BuildParams(max_depth=2, purity_limit=10_000))
    assert len(res.tree.leaves()) > 1         # the bound asked for


def test_levels_draw_other_rows(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("k"), F.lit("").alias("node"))
    drawn = [{r["k"] for r in sample_per_group(df, ["node"], "k", 50, level_seed(0, level)).collect()} for level in range(4)]
    assert all(len(a & b) < 10 for i, a in enumerate(drawn) for b in drawn[i + 1:])


def test_outline_has_a_row_per_node(spark):
    tree = Tree.from_splits({"": Rule("x", LT, 3.0), "0": Rule("t", CONTAINS, term="it's")})
    rows = {r["node_id"]: r for r in tree.outline(spark).collect()}
    assert {k: r["n_leaves"] for k, r in rows.items()} == {"": 3, "0": 2, "1": 1, "00": 1, "01": 1}
    assert (rows["0"]["child_true"], rows["0"]["child_false"], rows["1"]["child_true"]) == ("00", "01", None)


def test_sampled_scoring_and_unsupervised_mode(spark):
    df = _rule_table(spark, 2000)
    spec = entropy_spec(df, ["y"], "unsupervised", exclude=["k"])
    assert set(spec) == {"a", "b", "t"}
    res = build_tree(df, "k", ["y"], weights=spec, params=BuildParams(max_depth=2, min_node_size=100,
                                                                      sample_size=300))
    n_rows = sum(res.tree.nodes[leaf].n_rows for leaf in res.tree.leaves())
    assert n_rows == 2000


def test_build_on_supplied_table(spark):
    from sylva.sources.staged import st_event
    res = build_tree(st_event(spark, SF_SMALL), "row_key", ["y"], params=BuildParams(max_depth=2, min_node_size=100))
    s = json.loads(json.dumps(res.tree.structure()))
    assert s["rows"] == 1000


def test_written_table_build_equals_persisted_build(spark):
    df = _rule_table(spark, 2000)
    a = build_tree(df, "k", ["y"], params=BuildParams(max_depth=2, min_node_size=100))
    b = build_tree(df, "k", ["y"], params=BuildParams(max_depth=2, min_node_size=100), persist="table")
    assert a.tree.to_json() == b.tree.to_json()
