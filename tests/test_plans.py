"""What the plans do at scale, and the operators behind them against brute force."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.functions.hashing import row_hash
from sylva.operators import predict as pred
from sylva.operators import profile, validate
from sylva.operators.cells import TEXT, VALUE, WORD, cell_counts, cells
from sylva.operators.frequent import frequent
from sylva.operators.rules import candidates, collect_candidates
from sylva.operators.sampling import came_short, lowest_per_group, sample_known_sizes, sample_per_group
from sylva.operators.score import TERMS, UNROLLED, best_rules, branch_stats, score_best, score_rules
from sylva.plans import saved
from sylva.plans.build import BuildParams, build_tree, entropy_spec
from sylva.plans.tree import CONTAINS, LT, NESTED_LEAVES, Rule, Tree, add_labels, descend, label, label_subtree, publish
from sylva.sources import covtype
from sylva.sources.staged import st_docs, st_line

from .conftest import SF_SMALL


def planned(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def jobs_of(spark, compose):
    """Jobs that composing a plan runs."""
    group = f"compose-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        compose()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def rows_of(df):
    return sorted(map(str, df.collect()))


# ---------------------------------------------------------------- M2 / M3
@pytest.fixture(scope="module")
def skewed(spark):
    """Groups of 1 to some thousand rows, one with a key that most of its rows share."""
    return spark.range(0, 6000).select(
        F.when(F.col("id") < 4000, "a").when(F.col("id") < 5990, "b").when(F.col("id") < 5999, "c").otherwise(None).alias("g"),
        F.when((F.col("id") >= 4000) & (F.col("id") < 5900), F.lit(7)).otherwise(F.col("id")).alias("k"),
        (F.col("id") * 13 % 101).alias("x"))


@pytest.mark.parametrize("k, seed", [(1, 0), (5, 0), (5, 3), (300, 1), (5000, 2)])
def test_cut_off_sample_is_the_sorted_one(skewed, k, seed):
    assert rows_of(sample_per_group(skewed, ["g"], "k", k, seed)) == rows_of(lowest_per_group(skewed, ["g"], "k", k, seed))


def test_sample_by_known_sizes(skewed):
    known = skewed.filter("g is not null")
    sizes = {r["g"]: r["count"] for r in known.groupBy("g").count().collect()}
    sample = sample_known_sizes(known, "g", "k", 5, sizes)
    found = {r["g"]: r["count"] for r in sample.groupBy("g").count().collect()}
    short = came_short(found, sizes, 5)
    full = lowest_per_group(known, ["g"], "k", 5)
    assert rows_of(sample.filter(~F.col("g").isin(["", *short]))) == rows_of(full.filter(~F.col("g").isin(["", *short])))
    wide = sample_known_sizes(known, "g", "k", 5, sizes, wider=64**6)
    assert rows_of(wide) == rows_of(full)


def test_candidates_widen_a_cut_off_that_was_too_low(spark):
    # Nearly all rows of the node share one key, whose hash is high: the cut-off misses them.
    hashes = [(r["h"], r["id"]) for r in spark.range(0, 400).select("id", row_hash(F.col("id")).alias("h")).collect()]
    hot = max(hashes)[1]
    df = spark.range(0, 100_000).select(F.lit("n").alias("node_id"), F.lit(hot).alias("k"), F.col("id").cast("int").alias("x"))
    sizes = {"n": 100_000}
    assert came_short({r["node_id"]: r["count"] for r in sample_known_sizes(df, "node_id", "k", 5, sizes).groupBy("node_id").count().collect()}, sizes, 5)
    key = lambda r: (r["node_id"], r["num_value"])
    assert sorted(collect_candidates(df, "k", ["x"], [], sizes=sizes), key=key) == sorted(collect_candidates(df, "k", ["x"], []), key=key)


def test_samples_filter_before_they_sort(skewed):
    for sample in (sample_per_group(skewed, ["g"], "k", 5), sample_known_sizes(skewed, "g", "k", 5, {"a": 4000, "b": 1990})):
        plan = planned(sample)
        top = plan[:plan.index("Range (")] if "Range (" in plan else plan
        lowest_sort = top.rindex("Sort [g")
        assert re.search(r"Filter|BroadcastHashJoin", top[lowest_sort:])


# ---------------------------------------------------------------- T4 / T5
def entropy(counts):
    n = sum(counts.values())
    return sum(c / n * math.log2(c / n) for c in counts.values())


@pytest.fixture(scope="module")
def scored_table(spark):
    rng = random.Random(4)
    words = ["red", "green", "blue", "Quote'", 'say "so"', "back\\slash", "100%", "under_score", "tab\t", "naïve", "z"]
    rows = []
    for i in range(900):
        text = None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(0, 4)))
        rows.append((i, rng.choice(["", "0", "1", "9"]), None if rng.random() < 0.1 else rng.randint(-5, 40), rng.choice([1, 2, 300]), text,
                     rng.choice([0, 1, None])))
    rules, at = [], 0
    for node in ("", "0", "1"):
        for v in (range(-4, 30) if node == "0" else (3, 17)):
            rules.append((node, at, "x", 1, "lt", float(v), None, 1))
            at += 1
        rules.append((node, at, "big", 2, "lt", 2.0, None, 2))
        at += 1
        for w in (words if node != "1" else words[:1]):
            rules.append((node, at, "t", 3, "contains", None, w, 1))
            at += 1
    return spark.createDataFrame(rows, "k bigint, node_id string, x int, big bigint, t string, y int"), rows, rules


def by_force(rows, rules, entropies):
    out = {}
    for node, rule, name, _, kind, value, term, _ in rules:
        sides = {0: [], 1: []}
        for _, own, x, big, t, y in rows:
            if own == node:
                v = {"x": x, "big": big, "t": t}[name]
                sides[0 if v is not None and (v < value if kind == "lt" else term in v) else 1].append((x, big, t, y))
        total = {b: len(s) for b, s in sides.items() if s}
        n = sum(total.values())
        route = sum(c / n * math.log2(c / n) for c in total.values())
        best = -route * n
        for b, own in sides.items():
            for name_ in entropies if own else ():
                h = entropies[name_](own)
                out[rule, b, name_] = (node, len(own), h, n, route)
                best += h * len(own)
        for b in total:
            for name_ in entropies:
                out[rule, b, name_] += (best,)
    return out


def check_report(df, rows, rules, entropies, class_cols):
    report = score_rules(df, rules, ["x", "big"], ["t"], dict.fromkeys(entropies, 1.0), class_cols)
    got = {(r.rule_id, r.branch, r.col_name): (r.node_id, r.rows, r.entropy, r.n_rows, r.route_entropy, r.fitness) for r in report.collect()}
    want = by_force(rows, rules, entropies)
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key][0] == w[0] and got[key][1] == w[1] and got[key][3] == w[3], key
        assert got[key][2] == pytest.approx(w[2], abs=1e-9) and got[key][4:] == pytest.approx(w[4:], abs=1e-6), key
    return report


def test_report_by_force(scored_table):
    df, rows, rules = scored_table
    assert UNROLLED < 34 and TERMS < 11     # both long forms are used
    report = check_report(df, rows, rules, {"y": lambda own: entropy(Counter(r[3] for r in own)),
                                            "x": lambda own: entropy(Counter(r[0] for r in own))}, ["y", "x"])
    assert not re.search("NestedLoop|BroadcastHashJoin|SortMergeJoin", planned(report))
    best = {r.node_id: r.rule_id for r in best_rules(report).collect()}
    short = {r.node_id: (r.rule_id, r.rows_true, r.term) for r in score_best(df, rules, ["x", "big"], ["t"], {"y": 1.0, "x": 1.0}, ["y", "x"]).collect()}
    assert {n: s[0] for n, s in short.items()} == best and set(best) == {"", "0", "1"}


def test_report_of_very_many_rules(scored_table, monkeypatch):
    df, rows, rules = scored_table
    monkeypatch.setattr("sylva.operators.score.SUMMED", 0)
    check_report(df, rows, rules, {"y": lambda own: entropy(Counter(r[3] for r in own))}, ["y"])


def test_scoring_counts_a_row_once(scored_table):
    """With one class column a row isn't exploded by rule column before it is counted."""
    df, rows, rules = scored_table
    report = check_report(df, rows, rules, {"y": lambda own: entropy(Counter(r[3] for r in own))}, ["y"])
    below = planned(report).split("partial_count(1)")[-1]
    assert "partial_sum" in below and "Generate" not in below


def text_entropy(own):
    texts = [t for _, _, t, _ in own if t is not None]
    grams = Counter(t[i:i + 6] for t in texts for i in range(len(t)))
    words = Counter()
    for t in texts:
        parts = re.split(r"[ \t]+", t) if t else [""]
        while len(parts) > 1 and parts[-1] == "":
            parts.pop()
        words.update(parts)
    g = entropy(grams) / len(texts) if grams else 0.0
    w = entropy(words) if words else 0.0
    return g + w if g == 0 or w == 0 else (g + w) / 2


def test_report_with_text_entropy_by_force(scored_table):
    df, rows, rules = scored_table
    few = [r for r in rules if r[0] != "0" or r[1] % 5 == 0]
    check_report(df, rows, few, {"t": text_entropy}, [])
    check_report(df, rows, few, {"t": text_entropy, "y": lambda own: entropy(Counter(r[3] for r in own))}, ["y"])


def test_no_rules(scored_table):
    df, *_ = scored_table
    assert score_rules(df, [], ["x"], ["t"], {"y": 1.0}, ["y"]).count() == 0


def test_unsupervised_root_and_children_agree(spark):
    """The winners' branch entropies, which become the children's, are those of the children's own rows."""
    df = st_docs(spark, SF_SMALL)
    weights = entropy_spec(df, ["y"], "unsupervised", exclude=["row_key", "toxic"])
    assert set(weights) == {"n_chars", "text", "lang"}
    res = build_tree(df, "row_key", ["y"], weights, blacklist=["toxic"], params=BuildParams(max_depth=1, min_node_size=10))
    winner = res.levels[0]["winners"][0]
    own = branch_stats(label(df, res.tree, "node_id"), ["node_id"], weights, ["n_chars"]).collect()
    for leaf, side in (("0", "entropy_true"), ("1", "entropy_false")):
        assert sum(r["entropy"] for r in own if r["node_id"] == leaf) == pytest.approx(winner[side], rel=1e-9)


def test_cells_are_counted_by_short_keys(spark):
    """Names of columns and kinds aren't part of the key that each gram is counted by."""
    docs = spark.createDataFrame([("two words", "x"), (None, "y")], "t string, u string")
    one = planned(profile.ngram_entropy(docs, ["t"]))
    assert one.count("Generate explode") == 1 and re.findall(r"keys=\[([^]]*)\], functions=\[partial_count\(1\)", one)[-1].startswith("value#")
    several = re.findall(r"keys=\[([^]]*)\], functions=\[partial_count\(1\)", planned(profile.string_entropy(docs, ["t", "u"])))[-1]
    assert "col_name" not in several and "kind" not in several
    got = {(r.col_name, r.kind, r.value): r.n for r in cell_counts(docs, [], [("t", WORD), ("u", VALUE), ("t", TEXT)]).collect()}
    assert got == {("t", "word", "two"): 1, ("t", "word", "words"): 1, ("u", "value", "x"): 1, ("u", "value", "y"): 1,
                   ("t", "text", ""): 1, ("t", "text", None): 1}
    assert [tuple(r) for r in cell_counts(docs, ["u"], [("t", TEXT)]).orderBy("u").collect()] == [("x", "t", "text", "", 1), ("y", "t", "text", None, 1)]


# ---------------------------------------------------------------- T1
def test_profile_reads_a_table_once(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("n_chars", "text", "lang")
    plan = planned(profile.profile(docs), final=True)
    assert plan[:plan.index("Initial Plan")].count("FileScan parquet") == 1


def test_composing_runs_no_job(spark):
    docs, line = st_docs(spark, SF_SMALL), st_line(spark, SF_SMALL)

    def compose():
        profile.profile(docs)
        profile.profile_nodes(docs, saved.DOCS_A)
        profile.string_entropy(docs, ["text"])
        profile.common_words(docs, ["text"])
        candidates(label(line, saved.LINE_A, "node_id"), "row_key", ["quantity"], ["linestatus"])
        pred.predict(line, {"a": saved.LINE_A}, "y", [0, 1, 2])
        pred.forest_accuracy(line, {"a": saved.LINE_A}, "y", [0, 1, 2])

    assert jobs_of(spark, compose) == 0


def test_profile_of_nodes_is_the_profile_of_their_rows(spark):
    docs = st_docs(spark, SF_SMALL).select("n_chars", "text", "lang", "y")
    rounded = lambda df: sorted(str((r["node_id"], r["col_name"], r["metric"], r["rank"], r["item"],
                                     None if r["value"] is None else float(f"{r['value']:.9g}"))) for r in df.collect())
    leaves = profile.profile(label(docs, saved.DOCS_A, "node_id"), group_cols=["node_id"])
    assert rounded(profile.profile_nodes(docs, saved.DOCS_A, branches=False)) == rounded(leaves)
    paths = docs.withColumn("leaf", saved.DOCS_A.to_column()).withColumn("d", F.explode(F.expr("sequence(0, length(leaf) - 1)")))
    branches = profile.profile(paths.withColumn("node_id", F.expr("substring(leaf, 1, d)")).drop("leaf", "d"), group_cols=["node_id"])
    assert rounded(profile.profile_nodes(docs, saved.DOCS_A, leaves=False)) == rounded(branches)


def test_profile_of_large_numbers_and_nulls(spark):
    rows = [(2**52 + i, 2**62 + i, None if i % 2 else i, None, "") for i in range(10)]
    got = {(r.col_name, r.metric, r["rank"]): r for r in profile.profile(
        spark.createDataFrame(rows, "big bigint, huge bigint, half int, none string, empty string")).collect()}
    assert got["big", "stddev", None].value == pytest.approx(math.sqrt(8.25), rel=1e-9)     # by doubles it would be 0
    assert got["huge", "sum2", None].value == pytest.approx(10 * 2.0**124) and got["huge", "stddev", None].value >= 0
    assert got["half", "sum0", None].value == 5 and got["half", "common_values", 1].item is None
    assert got["none", "length.sum0", None].value == 0 if ("none", "length.sum0", None) in got else True
    assert got["empty", "length.max", None].value == 0 and got["empty", "common_values", 1].value == 10


# ---------------------------------------------------------------- K2 by bounds
@pytest.mark.parametrize("kind", ["distinct", "zipf", "few", "nulls"])
def test_frequent_items_by_bounds(spark, kind):
    value = {"distinct": F.col("id").cast("string"), "zipf": F.floor(F.lit(20000) / (F.col("id") + 1)).cast("string"),
             "few": (F.col("id") % 3).cast("string"), "nulls": F.when(F.col("id") % 5 == 0, F.col("id").cast("string"))}[kind]
    df = spark.range(0, 20_000).select(value.alias("v"), (F.col("id") % 2).cast("string").alias("w"))
    items = cells(df, [], [("v", VALUE), ("w", VALUE)]).drop("kind")
    want = profile.top_k(items.groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("n")), ["col_name"], 10)
    for buckets, tried in ((1 << 16, 8), (64, 1), (7, 1)):
        assert rows_of(frequent(items, ["col_name"], 10, buckets=buckets, tried=tried).select(want.columns)) == rows_of(want)


# ---------------------------------------------------------------- P2, P9, U2
def test_leaf_filter_reaches_the_scan(spark, tmp_path):
    st_line(spark, SF_SMALL).write.parquet(f"{tmp_path}/line")
    stored = spark.read.parquet(f"{tmp_path}/line")
    tree = Tree.from_splits({"": Rule("quantity", LT, 26.0), "1": Rule("quantity", LT, 40.0), "10": Rule("quantity", LT, 33.5),
                             "11": Rule("linestatus", CONTAINS, term="F")})
    plan = planned(stored.filter(tree.condition("101")).select("row_key"))
    pushed = plan[plan.index("PushedFilters"):].split("ReadSchema")[0]
    assert "GreaterThan(quantity,33)" in pushed and "LessThan(quantity,40)" in pushed
    assert tree.bounds("101") == {"quantity": (33.5, 40.0)} and tree.bounds("11") == {"quantity": (40.0, None)}
    plan = planned(stored.filter(tree.condition("111")).select("row_key"))
    assert "Or(GreaterThanOrEqual(quantity,40),IsNull(quantity))" in plan


def test_leaf_filter_is_the_label(spark):
    rng = random.Random(9)
    rows = [(None if rng.random() < 0.2 else rng.randint(0, 9), None if rng.random() < 0.2 else rng.choice(["a", "ab", "b", ""])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x int, t string")
    tree = Tree.from_splits({"": Rule("x", LT, 5.0), "0": Rule("x", LT, 2.5), "1": Rule("t", CONTAINS, term="a"), "10": Rule("x", LT, 8.0),
                             "11": Rule("t", CONTAINS, term="b"), "01": Rule("t", CONTAINS, term="%")})
    labelled = label(df, tree, "leaf")
    for node in tree.nodes:
        assert rows_of(df.filter(tree.condition(node))) == rows_of(labelled.filter(F.col("leaf").startswith(node)).drop("leaf")), node
        assert rows_of(label_subtree(df, tree, node, "leaf")) == rows_of(labelled.filter(F.col("leaf").startswith(node)))


def largest_method(df):
    codes = df._jdf.queryExecution().debug().codegenToSeq()
    return max(int(re.search(r"ByteCodeStats\((\d+)", codes.apply(i)._3().toString()).group(1)) for i in range(codes.size()))


def test_large_trees_descend(spark):
    rng = random.Random(2)
    tree = Tree()
    open_ = [""]
    while len(tree.leaves()) < 150:
        node = open_.pop(rng.randrange(len(open_)))
        tree.split(node, rng.choice([Rule("x", LT, rng.randint(0, 50) / 2), Rule("_at", LT, float(rng.randint(0, 9))),
                                     Rule("t", CONTAINS, term=rng.choice(["a", "b'", "\\", '"', "ab"]))]))
        open_ += [node + "0", node + "1"] if len(node) < 10 else []
    df = spark.createDataFrame([(i, rng.choice([None, i % 25]), i % 11, rng.choice([None, "a", "b'a", "\\", 'x"ab', ""])) for i in range(600)],
                               "k int, x int, _at bigint, t string")
    assert len(tree.leaves()) > NESTED_LEAVES
    want = rows_of(df.withColumn("leaf", tree.to_column()))
    assert rows_of(label(df, tree, "leaf")) == want == rows_of(add_labels(df, {"leaf": tree}))
    line = st_line(spark, SF_SMALL)
    deep = label(line, saved.LINE_DEEP).select("row_key", "cluster_id")
    assert largest_method(deep) <= 8000 < largest_method(line.select("row_key", saved.LINE_DEEP.to_column().alias("c")))
    one = Tree()
    assert {r.c for r in descend(df, one, "c").collect()} == {""}


def test_published_trees_in_sql(spark):
    df = spark.createDataFrame([(1, "it's"), (30, "F"), (None, None)], "quantity int, `odd name` string")
    tree = Tree.from_splits({"": Rule("quantity", LT, 26.0), "0": Rule("odd name", CONTAINS, term="'"), "1": Rule("odd name", CONTAINS, term="F")})
    df.createOrReplaceTempView("published")
    call = publish(spark, "leaf_of", tree, df)
    assert rows_of(spark.sql(f"SELECT *, {call} AS c FROM published")) == rows_of(label(df, tree, "c"))
    assert spark.sql(f"SELECT {call} AS c, count(*) AS n FROM published GROUP BY {call}").count() == 3


# ---------------------------------------------------------------- T11, A18, A11, A12
def test_accuracy_off_the_cube(spark):
    line = st_line(spark, SF_SMALL).withColumn("y", F.when(F.col("row_key") % 17 != 0, F.col("y")))
    train, test = line.filter("row_key % 3 != 0"), line.filter("row_key % 3 = 0")
    labels = {"a": saved.LINE_A, "b": saved.LINE_B}
    for df, fit in ((line, None), (test, train)):
        want = pred.accuracy(pred.predict(df, labels, "y", [0, 1, 2], fit=fit), "y").first()
        got = pred.forest_accuracy(df, labels, "y", [0, 1, 2], fit=fit)
        assert got.first() == want
        plan = planned(got, final=True)
        assert plan[:plan.index("Initial Plan")].count("FileScan parquet") == (1 if fit is None else 2)
    keyed = pred.predict(test, labels, "y", [0, 1, 2], fit=train, keys=["row_key"])
    assert keyed.columns[:2] == ["row_key", "y"] and keyed.count() == test.count()
    plan = planned(pred.predict(line, labels, "y", [0, 1, 2]), final=True)
    assert plan[:plan.index("Initial Plan")].count("FileScan parquet") == 2     # the cube, and the rows themselves


def test_wide_forms_without_a_class_list(spark):
    df = spark.createDataFrame([("l", 1), ("l", 1), ("l", None), ("m", 2), ("m", 1)], "leaf string, y int")
    assert rows_of(validate.cluster_pivot(df, "leaf", "y")) == rows_of(validate.cluster_pivot(df, "leaf", "y", [1, 2]))
    assert [tuple(r) for r in pred.predictive_matrix(df, "leaf", "y").collect()] == [("l", pytest.approx(2 / 3), None), ("m", 0.5, 0.5)]


# ---------------------------------------------------------------- S2, S3, S5
def test_ingest_with_rejects(spark, tmp_path):
    def line(soil=(5,), first="10", cls="3", end=""):
        flags = ["1" if i in soil else "0" for i in range(1, 41)]
        return ",".join([first] + ["0"] * 9 + ["1", "0", "0", "0"] + flags + [cls]) + end

    lines = [line(), line((7,)), line(first="ten"), line(end=",9"), line(())[:40], line((1, 2)), line(()), line(first=""), line(cls="")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    good, bad, counts = covtype.ingest_with_rejects(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert counts == {"rows": 9, "rejected": 7, "accepted": 2}
    assert sorted(r[covtype.DESCRIPTION] for r in good.collect()) == sorted([covtype.SOIL_TYPES[4], covtype.SOIL_TYPES[6]])
    assert good.columns == covtype.final_schema().names
    reasons = Counter(r["reason"] for r in bad.collect())
    assert reasons == {covtype.MALFORMED: 3, covtype.HOT_FLAGS: 2, covtype.EMPTY_FIELD: 2}
    assert {r["line"] for r in bad.filter("line is not null").collect()} == set(lines[2:5])
    (tmp_path / "in" / "a.csv").write_text(line(()) + "\n")
    with pytest.raises(ValueError):
        covtype.ingest_with_rejects(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_tree_json_round_trip_keeps_large_trees():
    assert Tree.from_json(saved.LINE_DEEP.to_json()).to_json() == saved.LINE_DEEP.to_json() and json.loads(saved.LINE_DEEP.to_json())
