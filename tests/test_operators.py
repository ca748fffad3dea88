import pytest
from pyspark.sql import functions as F

from sylva.operators import predict as pred
from sylva.operators import validate
from sylva.operators.rules import candidates, collect_candidates, int_candidates, text_candidates
from sylva.operators.sampling import sample_per_group, split_train_test
from sylva.operators.score import RULE_SCHEMA, best_rules, number_rules, score_rules
from sylva.plans.tree import CONTAINS, LT, Rule, Tree


def test_int_candidates_drop_smallest(spark):
    s = spark.createDataFrame([("", 3), ("", 1), ("", 7), ("", 3), ("", None)], "node_id string, v int")
    got = sorted(r["num_value"] for r in int_candidates(s, ["v"]).collect())
    assert got == [3.0, 7.0]


def test_text_candidate_fraction_bounds_are_strict(spark):
    # 10 distinct strings (fractions are over distinct sampled strings):
    # 'aa' in 1 (0.1, out), 'bb' in 2 (0.2, in), 'cc' in 8 (0.8, out), 'dd' in 7 (0.7, in), the rest in 1
    strs = ["aa bb cc dd", "bb cc dd e", "cc dd f", "cc dd g", "cc dd h", "cc dd i", "cc dd j", "cc k", "x y", "z w"]
    s = spark.createDataFrame([("", t) for t in strs], "node_id string, t string")
    got = {r["term"] for r in text_candidates(s, ["t"], rule_samples=100, ngram=0).collect()}
    assert got == {"bb", "dd"}


def test_text_candidates_agree_with_brute_force(spark):
    strs = ["the cat sat on the mat", "a dog and the cat", "xyz", "mat and hat", "catalogue"]
    s = spark.createDataFrame([("n", t) for t in strs], "node_id string, t string")
    got = sorted(r["term"] for r in text_candidates(s, ["t"], rule_samples=1000).collect())
    terms = {w for t in strs for w in t.split()} | {t[i:i + 6] for t in strs for i in range(max(1, len(t) - 6))}
    assert got == sorted(x for x in terms if 0.1 < sum(x in t for t in strs) / len(strs) < 0.8)


def test_long_forms_hold_any_number_of_classes(spark):
    df = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("leaf"), (F.col("id") % 12_000).alias("y"))
    counts = validate.cluster_counts(df, "leaf", "y")
    assert counts.count() == 12_000 and counts.agg(F.sum("n")).first()[0] == 30_000
    assert validate.distinct_classes(df, "y").count() == 12_000
    sums = pred.predictive_matrix_long(df, "leaf", "y").groupBy("leaf").agg(F.sum("p").alias("p")).collect()
    assert len(sums) == 3 and all(abs(r["p"] - 1) < 1e-9 for r in sums)


def test_long_matrix_equals_the_wide_one(spark):
    rows = [("a", 1), ("a", 1), ("a", None), ("a", 2), (None, 1), ("b", None)]
    df = spark.createDataFrame(rows, "leaf string, y int")
    long = {(r["leaf"], r["y"]): r["p"] for r in pred.predictive_matrix_long(df, "leaf", "y").collect()}
    wide = {(r["leaf"], c): r[f"y_{c}"] for r in pred.predictive_matrix(df, "leaf", "y").collect() for c in (1, 2)}
    assert long == {k: v for k, v in wide.items() if v is not None} and long[("a", 1)] == 0.5


def test_sample_is_partition_independent(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"))
    a = sorted(r["k"] for r in sample_per_group(df, ["g"], "k", 5).collect())
    b = sorted(r["k"] for r in sample_per_group(df.repartition(7), ["g"], "k", 5).collect())
    assert a == b and len(a) == 15


def test_split_is_about_ten_percent_and_disjoint(spark):
    df = spark.range(0, 20000).select(F.col("id").alias("k"))
    train, test = split_train_test(df, "k")
    nt, ns = train.count(), test.count()
    assert nt + ns == 20000 and 1700 < ns < 2300
    assert train.join(test, "k").count() == 0


def _score_toy(spark):
    # class y = 1 exactly when x >= 5; the rule x < 5 separates perfectly
    rows = [(i, i % 10, "a" if i % 2 else "b", int(i % 10 >= 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x int, s string, y int").withColumn("node_id", F.lit(""))
    cands = [dict(node_id="", col_name="x", col_pos=1, kind="lt", num_value=v, term=None) for v in (3.0, 5.0, 8.0)]
    cands.append(dict(node_id="", col_name="s", col_pos=2, kind="contains", num_value=None, term="a"))
    rules = spark.createDataFrame(number_rules(cands, ["x"], ["s"]), RULE_SCHEMA)
    return score_rules(df, rules, ["x"], ["s"], {"y": 1.0}, ["y"])


def test_score_perfect_split_wins_with_fitness_n(spark):
    best = best_rules(_score_toy(spark)).first()
    assert (best["rule_column"], best["num_value"]) == ("x", 5.0)
    # both branches pure: branch term 0; route entropy -1 over 200 rows -> fitness 200
    assert best["fitness"] == pytest.approx(200.0)
    assert (best["rows_true"], best["rows_false"]) == (100, 100)


def test_single_branch_rules_are_not_chosen(spark):
    df = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "k long, x int, y int").withColumn(
        "node_id", F.lit(""))
    rules = spark.createDataFrame(number_rules(
        [dict(node_id="", col_name="x", col_pos=1, kind="lt", num_value=9.0, term=None)], ["x"], []), RULE_SCHEMA)
    assert best_rules(score_rules(df, rules, ["x"], [], {"y": 1.0}, ["y"])).count() == 0


def test_constant_column_gives_no_candidates(spark):
    df = spark.createDataFrame([(i, 4, "same") for i in range(30)], "k long, x int, s string").withColumn(
        "node_id", F.lit(""))
    assert collect_candidates(df, "k", ["x"], ["s"]) == []


def test_pivot_nulls_for_absent_pairs_and_sorted(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("a", 2), ("b", None)], "cluster_id string, y int")
    rows = validate.cluster_pivot(df, "cluster_id", "y").collect()
    assert [r["cluster_id"] for r in rows] == ["a", "b"]
    assert (rows[0]["y_1"], rows[0]["y_2"], rows[1]["y_1"], rows[1]["y_2"]) == (1, 2, 1, None)


def test_leaf_accuracy_majority_with_ties_to_smaller_class(spark):
    df = spark.createDataFrame([("0", 1), ("0", 1), ("0", 2), ("1", 3), ("1", 4)], "cluster_id string, y int")
    assert validate.leaf_accuracy(df, "cluster_id", "y").first()["accuracy"] == pytest.approx(3 / 5)


def test_matrix_rows_sum_to_one_and_predict(spark):
    rows = [(i, i % 3, i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, y int, x int")
    tree = Tree.from_splits({"": Rule("x", LT, 2.0)})
    m = pred.predictive_matrix(df.withColumn("lab", tree.to_column()), "lab", "y", [0, 1, 2])
    for r in m.collect():
        assert sum(v for k, v in r.asDict().items() if k.startswith("y_") and v is not None) == pytest.approx(1.0)
    p = pred.predict(df, {"lab": tree}, "y", [0, 1, 2])
    assert p.count() == 120
    assert p.filter(F.col("predict").isNull()).count() == 0


def test_unseen_label_is_dropped(spark):
    fit = spark.createDataFrame([(1, 0), (2, 1)], "x int, y int")
    test = spark.createDataFrame([(1, 0), (9, 1)], "x int, y int")
    tree = Tree.from_splits({"": Rule("x", LT, 5.0)})
    only_low = pred.predict(test, {"lab": tree}, "y", [0, 1], fit=fit.filter("x < 5"))
    assert only_low.count() == 1


def test_lean_scoring_picks_the_report_winners(spark):
    from sylva.operators.score import score_best
    from sylva.plans import saved
    from sylva.plans.tree import label
    from sylva.sources.staged import st_line
    from .conftest import SF_SMALL
    lab = label(st_line(spark, SF_SMALL), saved.LINE_A, "node_id")
    ints, strs = ["quantity", "linenumber", "discount_pct", "tax_pct"], ["linestatus"]
    rules = spark.createDataFrame(number_rules(collect_candidates(lab, "row_key", ints, strs), ints, strs),
                                  RULE_SCHEMA)
    a = {r["node_id"]: (r["rule_id"], r["rows_true"], r["rows_false"]) for r in
         best_rules(score_rules(lab, rules, ints, strs, {"y": 1.0}, ["y"])).collect()}
    b = {r["node_id"]: (r["rule_id"], r["rows_true"], r["rows_false"]) for r in
         score_best(lab, rules, ints, strs, {"y": 1.0}, ["y"]).collect()}
    assert a == b and len(a) == 5
