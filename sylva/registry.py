"""The registered queries: one Spark callable and (where SQL can express it) one
DuckDB oracle per operator of the inventory. Every query reads its tables in full; only
``m4_char_entropy_sample``, whose operator is a sample, takes 250 documents of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sampling, validate
from .plans import saved
from .plans.tree import label, label_subtree, publish
from .session import scratch_path
from .sources import parquet
from .sources.staged import st_docs, st_event, st_line, with_staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def duck(tree, alias="T"):
    return tree.to_sql(alias=alias, dialect="duckdb")


# ---------------------------------------------------------------- S: sources
@query("s1_view_counts", " UNION ALL ".join(f"SELECT '{t}' AS view, count(*) AS n_rows FROM {t}" for t in parquet.TABLES))
def _s1(spark, sf):
    parquet.load_views(spark, {f"{sf}/{t}.parquet": t for t in parquet.TABLES})
    return parquet.view_counts(spark, parquet.TABLES)


@query("s6_stage_line", with_staged("SELECT * FROM st_line", "st_line"))
def _s6_line(spark, sf):
    st_line(spark, sf).createOrReplaceTempView("src_line")
    return parquet.stage(spark, "st_line", "SELECT * FROM src_line")


@query("s6_stage_docs", with_staged("SELECT * FROM st_docs", "st_docs"))
def _s6_docs(spark, sf):
    return st_docs(spark, sf)


@query("s6_stage_event", with_staged("SELECT * FROM st_event", "st_event"))
def _s6_event(spark, sf):
    return st_event(spark, sf)


@query("s11_class_count", with_staged("SELECT count(*) AS count, y FROM st_line GROUP BY y", "st_line"))
def _s11(spark, sf):
    return parquet.class_counts(st_line(spark, sf), "y")


# ---------------------------------------------------------------- P: labels and paths
@query("p4_label_rows", with_staged(f"SELECT row_key, y, {duck(saved.LINE_A)} AS cluster_id FROM st_line AS T", "st_line"))
def _p4(spark, sf):
    return label(st_line(spark, sf), saved.LINE_A).select("row_key", "y", "cluster_id")


@query("p4_label_rows_deep", with_staged(f"SELECT row_key, y, {duck(saved.LINE_DEEP)} AS cluster_id FROM st_line AS T", "st_line"))
def _p4d(spark, sf):
    return label(st_line(spark, sf), saved.LINE_DEEP).select("row_key", "y", "cluster_id")


@query("s8_s10_register_lookup", with_staged("SELECT count(*) AS count, y FROM st_line GROUP BY y", "st_line"))
def _s8(spark, sf):
    parquet.register(parquet.class_counts(st_line(spark, sf), "y"), "st_line_y")
    return parquet.staged(spark, "st_line_y")


@query("p1_label_sql_text", with_staged(
    f"SELECT row_key, {duck(saved.DOCS_A)} AS cluster_id FROM st_docs AS T", "st_docs"))
def _p1(spark, sf):
    st_docs(spark, sf).createOrReplaceTempView("st_docs")
    return spark.sql(f"SELECT row_key, {saved.DOCS_A.to_sql()} AS cluster_id FROM st_docs AS T")


@query("p2_leaf_filter", with_staged(
    f"SELECT row_key FROM st_line AS T WHERE {saved.LINE_A.condition_sql('001', dialect='duckdb')}", "st_line"))
def _p2(spark, sf):
    return st_line(spark, sf).filter(saved.LINE_A.condition("001")).select("row_key")


@query("p2_leaf_filter_stored", ORACLES["p2_leaf_filter"])
def _p2s(spark, sf):
    """The same rows from a stored copy, whose scan takes the leaf's intervals as filters."""
    stored = parquet.write_read_parquet(st_line(spark, sf), scratch_path(spark, f"st-line-{uuid.uuid4().hex}"))
    return stored.filter(saved.LINE_A.condition("001")).select("row_key")


@query("u2_sql_functions", with_staged(
    f"SELECT row_key, {duck(saved.LINE_A)} AS label_a, {duck(saved.LINE_B)} AS label_b FROM st_line AS T", "st_line"))
def _u2(spark, sf):
    """Trees called by name from SQL text."""
    df = st_line(spark, sf)
    df.createOrReplaceTempView("st_line")
    a, b = publish(spark, "leaf_a", saved.LINE_A, df), publish(spark, "leaf_b", saved.LINE_B, df)
    return spark.sql(f"SELECT row_key, {a} AS label_a, {b} AS label_b FROM st_line")


@query("p5_subtree_label", with_staged(
    f"SELECT row_key, {saved.LINE_A.to_sql('0', dialect='duckdb')} AS label FROM st_line AS T "
    f"WHERE {saved.LINE_A.condition_sql('0', dialect='duckdb')}", "st_line"))
def _p5(spark, sf):
    return label_subtree(st_line(spark, sf), saved.LINE_A, "0").select("row_key", "label")


@query("p3_route_events", with_staged(
    f"SELECT {duck(saved.EVENT_A)} AS cluster_id, count(*) AS n FROM st_event AS T GROUP BY 1", "st_event"))
def _p3(spark, sf):
    return label(st_event(spark, sf), saved.EVENT_A).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- validation
def _pivot_sql(tree, table, classes, target="y"):
    cols = ", ".join(f"NULLIF(count(*) FILTER (WHERE {target} = {c!r}), 0) AS {target}_{c}" for c in classes)
    return with_staged(f"SELECT cluster_id, {cols} FROM (SELECT *, {duck(tree)} AS cluster_id FROM {table} AS T) "
                       f"GROUP BY cluster_id", table)


@query("a11_cluster_pivot", _pivot_sql(saved.LINE_A, "st_line", [0, 1, 2]))
def _a11(spark, sf):
    return validate.cluster_pivot(label(st_line(spark, sf), saved.LINE_A), "cluster_id", "y")


@query("a11_cluster_pivot_str", _pivot_sql(saved.EVENT_A, "st_event", ["click", "error", "purchase", "signup", "view"]))
def _a11s(spark, sf):
    return validate.cluster_pivot(label(st_event(spark, sf), saved.EVENT_A), "cluster_id", "y")


@query("a16_leaf_distribution", with_staged(f"""
SELECT cluster_id, y, n, leaf_rows, n / CAST(leaf_rows AS DOUBLE) AS share FROM (
  SELECT cluster_id, y, n, CAST(sum(n) OVER (PARTITION BY cluster_id) AS BIGINT) AS leaf_rows FROM (
    SELECT cluster_id, y, count(*) AS n FROM (SELECT *, {duck(saved.DOCS_A)} AS cluster_id FROM st_docs AS T)
    GROUP BY cluster_id, y))""", "st_docs"))
def _a16(spark, sf):
    return validate.leaf_distribution(label(st_docs(spark, sf), saved.DOCS_A), "cluster_id", "y")


def _accuracy_sql(tree, table, fit_where, test_where):
    return with_staged(f"""
, lab AS (SELECT *, {duck(tree)} AS cluster_id FROM {table} AS T),
fitc AS (SELECT cluster_id, y, count(*) AS n FROM lab WHERE {fit_where} GROUP BY ALL),
pred AS (SELECT cluster_id, y AS predicted FROM (SELECT *, row_number() OVER
         (PARTITION BY cluster_id ORDER BY n DESC, y ASC NULLS LAST) AS r FROM fitc) WHERE r = 1),
testc AS (SELECT cluster_id, y, count(*) AS n FROM lab WHERE {test_where} GROUP BY ALL)
SELECT CAST(sum(CASE WHEN t.y = p.predicted THEN t.n ELSE 0 END) AS DOUBLE) / CAST(sum(t.n) AS DOUBLE) AS accuracy,
       CAST(sum(t.n) AS BIGINT) AS n_test
FROM testc t LEFT JOIN pred p ON t.cluster_id = p.cluster_id""", table).replace("\n)\n, lab", "\n), lab", 1)


@query("a17_leaf_accuracy_test", _accuracy_sql(saved.LINE_A, "st_line", sampling.split_sql("row_key"),
                                               sampling.split_sql("row_key")))
def _a17(spark, sf):
    _, test = sampling.split_train_test(st_line(spark, sf), "row_key")
    return validate.leaf_accuracy(label(test, saved.LINE_A), "cluster_id", "y")


@query("a17_leaf_accuracy_train", _accuracy_sql(saved.EVENT_A, "st_event",
                                                sampling.split_sql("row_key", test=False),
                                                sampling.split_sql("row_key")))
def _a17t(spark, sf):
    train, test = sampling.split_train_test(st_event(spark, sf), "row_key")
    return validate.leaf_accuracy(label(test, saved.EVENT_A), "cluster_id", "y", fit=label(train, saved.EVENT_A))


@query("m1_train_test_split", with_staged(
    f"SELECT ({sampling.split_sql('row_key')}) AS is_test, count(*) AS n, CAST(sum(y) AS BIGINT) AS sum_y FROM st_line GROUP BY 1",
    "st_line"))
def _m1(spark, sf):
    return st_line(spark, sf).withColumn("is_test", sampling.test_bucket("row_key")).groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"))


# ---------------------------------------------------------------- A / T1: profiles
from .functions.entropy import entropy_sql, xlog2x_sql  # noqa: E402
from .functions.text import ngrams_sql, tokenize_sql  # noqa: E402
from .operators import profile  # noqa: E402
from .operators.cells import WORD, cells, spread  # noqa: E402
from .operators.frequent import frequent  # noqa: E402


def _moments_sql(table: str, cols: list[str], of_length: bool = False, group: list[str] = ()) -> str:
    g = ", ".join(group)
    parts = []
    for c in cols:
        x = f"CAST(length({c}) AS DOUBLE)" if of_length else f"CAST({c} AS DOUBLE)"
        n = f"count({c})"
        mean = f"(sum({x}) / CAST({n} AS DOUBLE))"
        parts.append(
            f"SELECT {g + ', ' if g else ''}'{c}' AS col_name, max({x}) AS max, min({x}) AS min, {n} AS sum0, "
            f"sum({x}) AS sum1, sum({x} * {x}) AS sum2, {mean} AS mean, "
            f"stddev_pop({x}) AS stddev FROM {table}"
            + (f" GROUP BY {g}" if g else ""))
    return " UNION ALL ".join(parts)


def _unpivot_sql(table: str, cols: list[str], group: list[str] = ()) -> str:
    g = "".join(f"{x}, " for x in group)
    return " UNION ALL ".join(f"SELECT {g}'{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM {table}" for c in cols)


def _entropy_of_counts_sql(counts: str, total: str, group: list[str] = ()) -> str:
    g = "".join(f"{x}, " for x in group)
    return (f"SELECT {g}col_name, CAST(sum(n) AS BIGINT) AS {total}, "
            f"{entropy_sql('sum(n)', 'sum(' + xlog2x_sql('n') + ')', 'count(*)')} AS entropy "
            f"FROM ({counts}) GROUP BY {g}col_name")


def _value_entropy_sql(table: str, cols: list[str], group: list[str] = ()) -> str:
    g = "".join(f"{x}, " for x in group)
    counts = (f"SELECT {g}col_name, value, count(*) AS n FROM ({_unpivot_sql(table, cols, group)}) "
              f"WHERE value IS NOT NULL GROUP BY ALL")
    return _entropy_of_counts_sql(counts, "n_values", group)


def _word_counts_sql(table: str, cols: list[str], group: list[str] = ()) -> str:
    g = "".join(f"{x}, " for x in group)
    words = " UNION ALL ".join(
        f"SELECT {g}'{c}' AS col_name, unnest({tokenize_sql(c)}) AS value FROM {table} WHERE {c} IS NOT NULL"
        for c in cols)
    return f"SELECT {g}col_name, value, count(*) AS n FROM ({words}) GROUP BY ALL"


def _gram_counts_sql(table: str, cols: list[str], group: list[str] = (), n: int = 6) -> str:
    g = "".join(f"{x}, " for x in group)
    grams = " UNION ALL ".join(
        f"SELECT {g}'{c}' AS col_name, unnest({ngrams_sql(c, n)}) AS value FROM {table} WHERE {c} IS NOT NULL"
        for c in cols)
    return f"SELECT {g}col_name, value, count(*) AS n FROM ({grams}) GROUP BY ALL"


def _top_k_sql(counts: str, k: int = 10, group: list[str] = ()) -> str:
    part = ", ".join([*group, "col_name"])
    return (f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY n DESC, value ASC NULLS FIRST) "
            f"AS INTEGER) AS rank FROM ({counts})) WHERE rank <= {k}")


def _read(spark, sf, name):
    return parquet.read_table(spark, sf, name)


@query("a2_moments_double", _moments_sql("orders", ["o_totalprice"]) + " UNION ALL " + _moments_sql("customer", ["c_acctbal"]))
def _a2d(spark, sf):
    return profile.moments(_read(spark, sf, "orders"), ["o_totalprice"]).unionByName(
        profile.moments(_read(spark, sf, "customer"), ["c_acctbal"]))


@query("a2_moments_int", _moments_sql("part", ["p_size", "p_partkey"]) + " UNION ALL " + _moments_sql("lineitem", ["l_linenumber"]))
def _a2i(spark, sf):
    return profile.moments(_read(spark, sf, "part"), ["p_size", "p_partkey"]).unionByName(
        profile.moments(_read(spark, sf, "lineitem"), ["l_linenumber"]))


@query("a2_moments_by_class", with_staged(_moments_sql("st_line", ["quantity", "discount_pct"], group=["y"]), "st_line"))
def _a2g(spark, sf):
    return profile.moments(st_line(spark, sf), ["quantity", "discount_pct"], group_cols=["y"])


@query("a3_length_moments", _moments_sql("documents", ["text"], of_length=True) + " UNION ALL "
       + _moments_sql("part", ["p_name"], of_length=True))
def _a3(spark, sf):
    return profile.moments(_read(spark, sf, "documents"), ["text"], of_length=True).unionByName(
        profile.moments(_read(spark, sf, "part"), ["p_name"], of_length=True))


@query("a4_common_values", _top_k_sql(f"SELECT col_name, value, count(*) AS n FROM ({_unpivot_sql('part', ['p_size', 'p_brand', 'p_type'])}) GROUP BY ALL"))
def _a4(spark, sf):
    return profile.common_values(_read(spark, sf, "part"), ["p_size", "p_brand", "p_type"])


@query("a4_common_values_lang", _top_k_sql(f"SELECT col_name, value, count(*) AS n FROM ({_unpivot_sql('documents', ['lang', 'source'])}) GROUP BY ALL"))
def _a4l(spark, sf):
    return profile.common_values(_read(spark, sf, "documents"), ["lang", "source"])


@query("a5_common_words", _top_k_sql(_word_counts_sql("documents", ["text"])) + " UNION ALL "
       + _top_k_sql(_word_counts_sql("part", ["p_name"])))
def _a5(spark, sf):
    return profile.common_words(_read(spark, sf, "documents"), ["text"]).unionByName(
        profile.common_words(_read(spark, sf, "part"), ["p_name"]))


@query("a5_common_words_bounded", ORACLES["a5_common_words"])
def _a5b(spark, sf):
    """The same words, found by bounds on hash buckets: not every distinct word is shuffled."""
    def words(name, column):
        df = spread(_read(spark, sf, name).select(column))
        return frequent(cells(df, [], [(column, WORD)]).drop("kind"), ["col_name"])

    return words("documents", "text").unionByName(words("part", "p_name"))


@query("a6_value_entropy", _value_entropy_sql("part", ["p_size"]) + " UNION ALL " + _value_entropy_sql("lineitem", ["l_linenumber"]))
def _a6(spark, sf):
    return profile.value_entropy(_read(spark, sf, "part"), ["p_size"]).unionByName(
        profile.value_entropy(_read(spark, sf, "lineitem"), ["l_linenumber"]))


@query("a7_class_entropy_per_leaf", with_staged(
    _value_entropy_sql(f"(SELECT *, {duck(saved.LINE_A)} AS cluster_id FROM st_line AS T)", ["y"], ["cluster_id"]),
    "st_line"))
def _a7(spark, sf):
    return profile.value_entropy(label(st_line(spark, sf), saved.LINE_A), ["y"], group_cols=["cluster_id"])


@query("a8_word_entropy", _entropy_of_counts_sql(_word_counts_sql("documents", ["text"]), "n_words") + " UNION ALL "
       + _entropy_of_counts_sql(_word_counts_sql("part", ["p_name"]), "n_words"))
def _a8(spark, sf):
    return profile.word_entropy(_read(spark, sf, "documents"), ["text"]).unionByName(
        profile.word_entropy(_read(spark, sf, "part"), ["p_name"]))


@query("a9_ngram_entropy", _entropy_of_counts_sql(_gram_counts_sql("documents", ["text"]), "n_grams") + " UNION ALL "
       + _entropy_of_counts_sql(_gram_counts_sql("part", ["p_name"]), "n_grams"))
def _a9(spark, sf):
    return profile.ngram_entropy(_read(spark, sf, "documents"), ["text"]).unionByName(
        profile.ngram_entropy(_read(spark, sf, "part"), ["p_name"]))


def _string_entropy_sql(table: str, cols: list[str], group: list[str]) -> str:
    g = "".join(f"{x}, " for x in group)
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in [*group, "col_name"])
    gram = _entropy_of_counts_sql(_gram_counts_sql(table, cols, group), "n_grams", group)
    rows = " UNION ALL ".join(f"SELECT {g}'{c}' AS col_name, count({c}) AS n_rows FROM {table} GROUP BY ALL" for c in cols)
    word = _entropy_of_counts_sql(_word_counts_sql(table, cols, group), "n_words", group)
    sel = ", ".join(f"coalesce(a.{x}, b.{x}) AS {x}" for x in [*group, "col_name"])
    ng = (f"SELECT r.*, coalesce(e.entropy / CAST(r.n_rows AS DOUBLE), 0.0) AS ngram FROM ({rows}) r "
          f"LEFT JOIN ({gram}) e ON " + " AND ".join(f"r.{x} IS NOT DISTINCT FROM e.{x}" for x in [*group, "col_name"]))
    return (f"SELECT {sel}, coalesce(a.ngram, 0.0) AS ngram, coalesce(b.entropy, 0.0) AS word, "
            f"CASE WHEN coalesce(a.ngram, 0.0) = 0 OR coalesce(b.entropy, 0.0) = 0 THEN coalesce(a.ngram, 0.0) + coalesce(b.entropy, 0.0) "
            f"ELSE (coalesce(a.ngram, 0.0) + coalesce(b.entropy, 0.0)) / 2 END AS entropy "
            f"FROM ({ng}) a FULL JOIN ({word}) b ON {on}")


@query("a10_string_entropy", with_staged(_string_entropy_sql("st_docs", ["text", "lang"], ["y"]), "st_docs"))
def _a10(spark, sf):
    return profile.string_entropy(st_docs(spark, sf), ["text", "lang"], group_cols=["y"])


def _profile_sql(table: str, ints: list[str], nums: list[str], strs: list[str], group: list[str] = ()) -> str:
    g = "".join(f"{x}, " for x in group)

    def long(src: str, metrics: list[str], prefix: str = "") -> str:
        return " UNION ALL ".join(f"SELECT {g}col_name, '{prefix}{m}' AS metric, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS item, "
                                  f"CAST({m} AS DOUBLE) AS value FROM ({src})" for m in metrics)

    def top(counts: str, metric: str) -> str:
        return (f"SELECT {g}col_name, '{metric}' AS metric, rank, value AS item, CAST(n AS DOUBLE) AS value "
                f"FROM ({_top_k_sql(counts, 10, group)})")

    parts = []
    if nums:
        parts.append(long(_moments_sql(table, nums, group=group), profile.MOMENTS))
    if ints:
        parts.append(long(_value_entropy_sql(table, ints, group), ["entropy"]))
    if strs:
        parts.append(long(_moments_sql(table, strs, of_length=True, group=group), profile.MOMENTS, "length."))
        parts.append(long(_entropy_of_counts_sql(_gram_counts_sql(table, strs, group), "n_grams", group).replace(
            "AS entropy", "AS char_entropy"), ["char_entropy"]))
        parts.append(long(_entropy_of_counts_sql(_word_counts_sql(table, strs, group), "n_words", group).replace(
            "AS entropy", "AS word_entropy"), ["word_entropy"]))
        parts.append(top(_word_counts_sql(table, strs, group), "common_words"))
    parts.append(top(f"SELECT {g}col_name, value, count(*) AS n FROM ({_unpivot_sql(table, ints + strs, group)}) GROUP BY ALL", "common_values"))
    return " UNION ALL ".join(parts)


@query("t1_profile_line", with_staged(_profile_sql(
    "st_line", ["quantity", "linenumber", "discount_pct", "tax_pct", "y"],
    ["quantity", "linenumber", "discount_pct", "tax_pct", "y"], ["linestatus"]), "st_line"))
def _t1l(spark, sf):
    return profile.profile(st_line(spark, sf).drop("row_key"))


@query("t1_profile_docs", with_staged(_profile_sql("st_docs", ["n_chars", "y"], ["n_chars", "y"], ["text", "lang"]),
                                      "st_docs"))
def _t1d(spark, sf):
    return profile.profile(st_docs(spark, sf).select("n_chars", "text", "lang", "y"))


def _nodes_of(tree, table: str) -> str:
    """Every row once per node on its path, root and leaf included."""
    return (f"(SELECT * EXCLUDE (leaf, depth), left(leaf, depth) AS node_id FROM (SELECT *, unnest(range(0, length(leaf) + 1)) AS depth "
            f"FROM (SELECT *, {duck(tree)} AS leaf FROM {table} AS T)))")


@query("t1_profile_by_leaf", with_staged(_profile_sql(
    _nodes_of(saved.DOCS_A, "st_docs"), ["n_chars", "y"], ["n_chars", "y"], ["text", "lang"], ["node_id"]), "st_docs"))
def _t1n(spark, sf):
    """Branch and leaf profiles: every node of the tree."""
    return profile.profile_nodes(st_docs(spark, sf), saved.DOCS_A, ["n_chars", "text", "lang", "y"])


# ---------------------------------------------------------------- T2-T8: candidates, scores, build
from . import oracles  # noqa: E402
from .operators.rules import candidates, collect_candidates  # noqa: E402
from .operators.score import best_rules, number_rules, score_rules  # noqa: E402
from .plans.build import BuildParams, build_tree, entropy_spec  # noqa: E402

LINE_INTS = [("quantity", 1), ("linenumber", 2), ("discount_pct", 3), ("tax_pct", 4)]
LINE_STRS = [("linestatus", 5)]
DOCS_INTS = [("n_chars", 1)]
DOCS_STRS = [("text", 2), ("lang", 3)]
EVENT_INTS = [("value_int", 1), ("hour", 2), ("user_id", 3)]


def _names(cols):
    return [c for c, _ in cols]


def _lab_sql(tree, table):
    return f"(SELECT *, {duck(tree)} AS node_id FROM {table} AS T)"


@query("t2_int_candidates", with_staged(
    f"SELECT * FROM ({oracles.cands_sql(_lab_sql(saved.LINE_A, 'st_line'), 'row_key', LINE_INTS, [])})", "st_line"))
def _t2(spark, sf):
    lab = label(st_line(spark, sf), saved.LINE_A, "node_id")
    return candidates(lab, "row_key", _names(LINE_INTS), [])


@query("t3_text_candidates", with_staged(
    f"SELECT * FROM ({oracles.cands_sql(_lab_sql(saved.DOCS_A, 'st_docs'), 'row_key', [], DOCS_STRS)})", "st_docs"))
def _t3(spark, sf):
    lab = label(st_docs(spark, sf), saved.DOCS_A, "node_id")
    return candidates(lab, "row_key", [], _names(DOCS_STRS))


def _line_report(spark, sf):
    lab = spread(label(st_line(spark, sf), saved.LINE_A, "node_id"))
    ints, strs = _names(LINE_INTS), _names(LINE_STRS)
    cands = collect_candidates(lab, "row_key", ints, strs)
    return score_rules(lab, number_rules(cands, ints, strs), ints, strs, {"y": 1.0}, ["y"])


_LINE_RULES_SQL = oracles.rules_sql(oracles.cands_sql("lab", "row_key", LINE_INTS, LINE_STRS))
_LINE_REPORT_SQL = oracles.report_sql("lab", f"({_LINE_RULES_SQL})", LINE_INTS, LINE_STRS, "y")


@query("t5_candidate_report", with_staged(
    f", lab AS {_lab_sql(saved.LINE_A, 'st_line')}\nSELECT * FROM ({_LINE_REPORT_SQL})", "st_line").replace(
    "\n)\n, lab", "\n), lab", 1))
def _t5(spark, sf):
    return _line_report(spark, sf)


@query("k3_best_rule", with_staged(
    f", lab AS {_lab_sql(saved.LINE_A, 'st_line')}\nSELECT * FROM ({oracles.best_sql(_LINE_REPORT_SQL)})",
    "st_line").replace("\n)\n, lab", "\n), lab", 1))
def _k3(spark, sf):
    return best_rules(_line_report(spark, sf))


def _build_sql(table, ints, strs, **kw):
    return with_staged(f"SELECT * FROM ({oracles.build_sql(table, 'row_key', ints, strs, 'y', **kw)})", table)


@query("t7_apply_split", with_staged(f"SELECT row_key, node_id FROM ({oracles.build_sql('st_line', 'row_key', LINE_INTS, LINE_STRS, 'y', max_depth=1, output='rows')})", "st_line"))
def _t7(spark, sf):
    df = st_line(spark, sf)
    res = build_tree(df, "row_key", ["y"], params=BuildParams(max_depth=1))
    return label(df, res.tree, "node_id").select("row_key", "node_id")


@query("t8_build_tree_line", _build_sql("st_line", LINE_INTS, LINE_STRS, max_depth=4))
def _t8l(spark, sf):
    return build_tree(st_line(spark, sf), "row_key", ["y"], params=BuildParams(max_depth=4)).node_table(spark)


@query("t8_build_tree_sampled", _build_sql("st_line", LINE_INTS, LINE_STRS, max_depth=3, sample_size=1000))
def _t8s(spark, sf):
    return build_tree(st_line(spark, sf), "row_key", ["y"],
                      params=BuildParams(max_depth=3, sample_size=1000)).node_table(spark)


@query("t8_build_tree_docs", _build_sql("st_docs", DOCS_INTS, DOCS_STRS, max_depth=3, min_node=20))
def _t8d(spark, sf):
    return build_tree(st_docs(spark, sf), "row_key", ["y"], blacklist=["toxic"],
                      params=BuildParams(max_depth=3, min_node_size=20)).node_table(spark)


@query("t8_build_tree_event", _build_sql("st_event", EVENT_INTS, [], max_depth=4, min_node=500))
def _t8e(spark, sf):
    return build_tree(st_event(spark, sf), "row_key", ["y"],
                      params=BuildParams(max_depth=4, min_node_size=500)).node_table(spark)


def _docs_mode(spark, sf, mode, max_depth):
    df = st_docs(spark, sf)
    weights = entropy_spec(df, ["y"], mode, exclude=["row_key", "toxic"])
    return build_tree(df, "row_key", ["y"], weights, blacklist=["toxic"],
                      params=BuildParams(max_depth=max_depth, min_node_size=20)).node_table(spark)


@query("t8_build_tree_unsupervised", _build_sql("st_docs", DOCS_INTS, DOCS_STRS, max_depth=2, min_node=20,
                                                spec=["n_chars", "text", "lang"], texts=["text", "lang"]))
def _t8u(spark, sf):
    """No class at all; the entropies are those of every feature, texts by their grams and words."""
    return _docs_mode(spark, sf, "unsupervised", 2)


@query("t8_build_tree_semi", _build_sql("st_docs", DOCS_INTS, DOCS_STRS, max_depth=2, min_node=20,
                                        spec=["n_chars", "text", "lang", "y"], texts=["text", "lang"]))
def _t8semi(spark, sf):
    """The features' entropies and the class's."""
    return _docs_mode(spark, sf, "semi-supervised", 2)


# ---------------------------------------------------------------- T6, T9, T10
from .plans.build import node_stats  # noqa: E402


@query("t6_stop_test", with_staged(f"""
SELECT node_id, CAST(sum(n) AS BIGINT) AS rows,
  1.0 * ({entropy_sql('sum(n)', 'sum(' + xlog2x_sql('n') + ')', 'count(*)')}) AS weighted_entropy,
  (sum(n) < 1000 OR ({entropy_sql('sum(n)', 'sum(' + xlog2x_sql('n') + ')', 'count(*)')}) = 0) AS stop
FROM (SELECT node_id, y, count(*) AS n FROM {_lab_sql(saved.LINE_A, 'st_line')} GROUP BY ALL) GROUP BY node_id""", "st_line"))
def _t6(spark, sf):
    return node_stats(st_line(spark, sf), saved.LINE_A, {"y": 1.0}, ["y"])


@query("t9_tree_structure", with_staged(f"""
, nodes AS ({oracles.build_sql("st_event", "row_key", EVENT_INTS, [], "y", max_depth=3, min_node=500)})
SELECT n.node_id, n.parent_id, CASE WHEN n.is_leaf THEN NULL ELSE n.node_id || '0' END AS child_true,
  CASE WHEN n.is_leaf THEN NULL ELSE n.node_id || '1' END AS child_false, n.n_rows,
  n.rule_column || ' < ' || CAST(n.rule_value AS VARCHAR) AS rule,
  (SELECT count(*) FROM nodes m WHERE m.is_leaf AND starts_with(m.node_id, n.node_id)) AS n_leaves
FROM nodes n""", "st_event").replace("\n)\n, nodes", "\n), nodes", 1))
def _t9(spark, sf):
    res = build_tree(st_event(spark, sf), "row_key", ["y"], params=BuildParams(max_depth=3, min_node_size=500))
    return res.tree.outline(spark)


_T10_ROWS = oracles.build_sql("st_line", "row_key", LINE_INTS, LINE_STRS, "y", max_depth=3, output="rows")


@query("t10_validate_pivot", with_staged(f"""
SELECT node_id AS cluster_id, {', '.join(f'NULLIF(count(*) FILTER (WHERE y = {c}), 0) AS y_{c}' for c in (0, 1, 2))}
FROM ({_T10_ROWS}) r GROUP BY node_id""", "st_line"))
def _t10p(spark, sf):
    df = st_line(spark, sf)
    tree = build_tree(df, "row_key", ["y"], params=BuildParams(max_depth=3)).tree
    return validate.validate(df, df, tree, "y")["pivot"]


_T10_SPLIT_ROWS = oracles.build_sql("st_line", "row_key", LINE_INTS, LINE_STRS, "y", max_depth=3, output="rows",
                                   fit_where=sampling.split_sql("row_key", test=False))


@query("t10_validate_accuracy", with_staged(f"""
SELECT CAST(sum(best) AS DOUBLE) / CAST(sum(tot) AS DOUBLE) AS accuracy, CAST(sum(tot) AS BIGINT) AS n_test FROM (
  SELECT node_id, max(n) AS best, sum(n) AS tot FROM (
    SELECT node_id, y, count(*) AS n FROM ({_T10_SPLIT_ROWS}) WHERE NOT _fit GROUP BY ALL) GROUP BY node_id)""", "st_line"))
def _t10a(spark, sf):
    df = st_line(spark, sf)
    train, test = sampling.split_train_test(df, "row_key")
    tree = build_tree(train, "row_key", ["y"], params=BuildParams(max_depth=3)).tree
    return validate.validate(df, test, tree, "y")["accuracy"]


@query("m4_char_entropy_sample", _entropy_of_counts_sql(_gram_counts_sql(
    f"(SELECT * FROM documents ORDER BY {sampling.row_hash_sql('doc_id')}, doc_id LIMIT 250)", ["text"]), "n_grams"))
def _m4(spark, sf):
    docs = sampling.lowest_hash_rows(_read(spark, sf, "documents"), "doc_id", 250)
    # The limit ends in one task: the sampled rows are dealt out before their texts explode.
    return profile.ngram_entropy(docs.repartition(spark.sparkContext.defaultParallelism), ["text"])


# ---------------------------------------------------------------- S7, A12, A13, T11, A18
from .operators import predict as pred  # noqa: E402
from .plans.tree import add_labels  # noqa: E402


@query("s7_add_labels", with_staged(
    f"SELECT row_key, {duck(saved.LINE_A)} AS label_a, {duck(saved.LINE_B)} AS label_b FROM st_line AS T", "st_line"))
def _s7(spark, sf):
    return add_labels(st_line(spark, sf), {"label_a": saved.LINE_A, "label_b": saved.LINE_B.to_sql(alias=None)}).select(
        "row_key", "label_a", "label_b")


def _matrix_sql(label_name: str, classes, target="y", source="lab"):
    cols = ", ".join(f"CAST(NULLIF(count(*) FILTER (WHERE {target} = {c!r}), 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) "
                     f"AS {target}_{c}" for c in classes)
    return f"SELECT {label_name}, {cols} FROM {source} GROUP BY {label_name}"


def _predict_sql(table, trees: dict, classes, target="y", fit_where="true", where="true", lab_sql: str | None = None, keys=()):
    """Predictor SQL; labels from ``trees`` (rendered as CASE) or, when ``lab_sql``
    is given, from that query (which must carry the label columns named in ``trees``)."""
    labs = ", ".join(f"{duck(t)} AS {n}" for n, t in trees.items() if t is not None)
    names, keep = list(trees), "".join(f"{k}, " for k in keys)
    mats = ", ".join(f"m_{n} AS ({_matrix_sql(n, classes, target, f'(SELECT * FROM lab WHERE {fit_where})')})"
                     for n in names)
    joins = " ".join(f"JOIN m_{n} USING ({n})" for n in names)
    scores = ", ".join(" * ".join(f"m_{n}.{target}_{c}" for n in names) + f" AS s_{j}" for j, c in enumerate(classes))
    mag = " + ".join(f"coalesce(s_{j}, 0.0)" for j in range(len(classes)))
    normed = ", ".join(f"s_{j} / nullif({mag}, 0.0) AS {target}_{c}" for j, c in enumerate(classes))
    mx = "greatest(" + ", ".join(f"coalesce({target}_{c}, 0.0)" for c in classes) + ")"
    case = "CASE " + " ".join(f"WHEN {target}_{c} = max THEN {c!r}" for c in classes) + " END"
    return with_staged(f"""
, lab AS ({lab_sql if lab_sql else f"SELECT *, {labs} FROM {table} AS T"}), {mats},
p AS (SELECT {keep}lab.{target}, {scores} FROM (SELECT * FROM lab WHERE {where}) lab {joins}),
n AS (SELECT {keep}{target}, {normed} FROM p),
x AS (SELECT *, {mx} AS max FROM n)
SELECT *, {case} AS predict FROM x""", table).replace("\n)\n, lab", "\n), lab", 1)


def _accuracy_of(sql):
    return (f"SELECT CAST(sum(CASE WHEN y = predict THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(predict) AS DOUBLE) AS accuracy, "
            f"CAST(sum(CASE WHEN y = predict THEN 1 ELSE 0 END) AS BIGINT) AS hits, "
            f"CAST(count(predict) - sum(CASE WHEN y = predict THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM ({sql})")


@query("a12_class_matrix", with_staged(
    f", lab AS (SELECT *, {duck(saved.LINE_A)} AS label_a FROM st_line AS T)\n{_matrix_sql('label_a', [0, 1, 2])}",
    "st_line").replace("\n)\n, lab", "\n), lab", 1))
def _a12(spark, sf):
    lab = add_labels(st_line(spark, sf), {"label_a": saved.LINE_A})
    return pred.predictive_matrix(lab, "label_a", "y", [0, 1, 2])


@query("a12_class_matrix_str", with_staged(
    f", lab AS (SELECT *, {duck(saved.EVENT_A)} AS label_a FROM st_event AS T)\n"
    f"{_matrix_sql('label_a', ['click', 'error', 'purchase', 'signup', 'view'])}", "st_event").replace(
    "\n)\n, lab", "\n), lab", 1))
def _a12s(spark, sf):
    lab = add_labels(st_event(spark, sf), {"label_a": saved.EVENT_A})
    return pred.predictive_matrix(lab, "label_a", "y")


@query("a13_distinct_classes", "SELECT DISTINCT event_type AS y FROM events WHERE event_type IS NOT NULL")
def _a13(spark, sf):
    return validate.distinct_classes(st_event(spark, sf), "y")


# A class column with a value per order: only the long forms hold it.
_ORDER_LABELS = f"(SELECT *, {duck(saved.LINE_A)} AS label_a FROM (SELECT *, row_key // 8 AS many FROM st_line) AS T)"


def _many_classes(spark, sf):
    return add_labels(st_line(spark, sf), {"label_a": saved.LINE_A}).withColumn("many", F.expr("row_key div 8"))


@query("a11_cluster_counts", with_staged(f"SELECT label_a, many, count(*) AS n FROM {_ORDER_LABELS} GROUP BY ALL", "st_line"))
def _a11c(spark, sf):
    return validate.cluster_counts(_many_classes(spark, sf), "label_a", "many")


@query("a12_class_matrix_long", with_staged(
    f"SELECT label_a, many, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY label_a) AS DOUBLE) AS p "
    f"FROM {_ORDER_LABELS} GROUP BY label_a, many", "st_line"))
def _a12l(spark, sf):
    return pred.predictive_matrix_long(_many_classes(spark, sf), "label_a", "many")


_LINE_FOREST = {"label_a": saved.LINE_A, "label_b": saved.LINE_B}
_EVENT_FOREST = {"label_a": saved.EVENT_A, "label_b": saved.EVENT_B}
_EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]


@query("t11_predict", _predict_sql("st_line", _LINE_FOREST, [0, 1, 2]))
def _t11(spark, sf):
    return pred.predict(st_line(spark, sf), _LINE_FOREST, "y", [0, 1, 2])


@query("t11_predict_deep", _predict_sql("st_line", {"label_a": saved.LINE_DEEP, "label_b": saved.LINE_B}, [0, 1, 2]))
def _t11d(spark, sf):
    return pred.predict(st_line(spark, sf), {"label_a": saved.LINE_DEEP, "label_b": saved.LINE_B}, "y", [0, 1, 2])


@query("t11_predict_str", _predict_sql("st_event", _EVENT_FOREST, _EVENT_CLASSES))
def _t11s(spark, sf):
    return pred.predict(st_event(spark, sf), _EVENT_FOREST, "y", _EVENT_CLASSES)


@query("t11_predict_keyed", _predict_sql("st_event", _EVENT_FOREST, _EVENT_CLASSES, keys=["row_key"]))
def _t11k(spark, sf):
    """Predictions that can be joined back to their rows."""
    return pred.predict(st_event(spark, sf), _EVENT_FOREST, "y", _EVENT_CLASSES, keys=["row_key"])


@query("a18_predict_accuracy", _accuracy_of(_predict_sql("st_line", _LINE_FOREST, [0, 1, 2])))
def _a18(spark, sf):
    return pred.forest_accuracy(st_line(spark, sf), _LINE_FOREST, "y", [0, 1, 2])


@query("a18_predict_accuracy_heldout", _accuracy_of(_predict_sql(
    "st_event", _EVENT_FOREST, _EVENT_CLASSES, fit_where=sampling.split_sql("row_key", test=False),
    where=sampling.split_sql("row_key"))))
def _a18h(spark, sf):
    train, test = sampling.split_train_test(st_event(spark, sf), "row_key")
    return pred.forest_accuracy(test, _EVENT_FOREST, "y", _EVENT_CLASSES, fit=train)


# ---------------------------------------------------------------- S2-S4, S9, streaming
from .sources import covtype  # noqa: E402
from .sources.export import export_csv, read_exported  # noqa: E402
from .sources.staged import stage_line  # noqa: E402
from .streaming import label_counts_stream  # noqa: E402


def _covtype_like(li, *keep):
    """A cover-type shaped table derived from lineitem: ten measurements, one hot
    wilderness flag, one hot soil flag, a class."""
    meas = [((F.col("l_orderkey") + F.lit(i) * F.col("l_partkey")) % 1000).cast("int").alias(c)
            for i, c in enumerate(covtype.MEASUREMENTS)]
    wild = [((F.col("l_linenumber") % 4 + 1) == i).cast("int").alias(c) for i, c in enumerate(covtype.WILDERNESS, 1)]
    soil = [((F.col("l_partkey") % 40 + 1) == i).cast("int").alias(c) for i, c in enumerate(covtype.SOIL, 1)]
    cls = (F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)).cast("int")
    return li.select(*meas, *wild, *soil, cls.alias(covtype.CLASS), *keep)


_SOIL_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in covtype.SOIL_TYPES) + "]"


@query("s2_s4_onehot_ingest", f"""
SELECT count(*) AS count, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INTEGER) AS Cover_Type,
       {_SOIL_LIST}[CAST(l_partkey % 40 + 1 AS INTEGER)] AS Soil_Description
FROM lineitem GROUP BY ALL""")
def _s2(spark, sf):
    base = scratch_path(spark, f"covtype-{uuid.uuid4().hex}")
    _covtype_like(parquet.read_table(spark, sf, "lineitem")).write.option("compression", "gzip").csv(f"{base}/csv")
    table = covtype.ingest(spark, f"{base}/csv", f"{base}/parquet")        # S2 + S3 + S4
    table.createOrReplaceTempView("covtype")
    return spark.sql("SELECT COUNT(*) AS count, Cover_Type, Soil_Description FROM covtype "
                     "GROUP BY Cover_Type, Soil_Description")                 # S11


_SPOILT = {  # lines of lineitem whose flags or fields are spoilt, by line number
    covtype.SOIL[1]: "CASE WHEN l_linenumber = 5 THEN 1 ELSE {x} END",
    covtype.SOIL[0]: "CASE WHEN l_linenumber = 6 THEN 0 WHEN l_linenumber = 3 AND {x} = 0 THEN -1 ELSE {x} END",
    covtype.SOIL[2]: "CASE WHEN l_linenumber = 7 THEN 7 ELSE {x} END",
}


def _spoilt_sql() -> str:
    flags = [f"CAST(l_partkey % 40 + 1 = {i} AS INTEGER)" for i in range(1, 41)]
    ones = " + ".join(f"CAST(({_SPOILT.get(c, '{x}').format(x=f)}) = 1 AS INTEGER)" for c, f in zip(covtype.SOIL, flags))
    return f"""
WITH t AS (SELECT {ones} AS hot_flags, l_linenumber = 4 AND l_partkey % 5 = 0 AS no_field FROM lineitem)
SELECT hot_flags = 1 AND NOT no_field AS accepted, hot_flags, count(*) AS n FROM t GROUP BY ALL"""


@query("s3_onehot_rejects", _spoilt_sql())
def _s3(spark, sf):
    li = parquet.read_table(spark, sf, "lineitem")
    spoilt = {c: F.expr(e.format(x=c)).cast("int") for c, e in _SPOILT.items()}
    first = covtype.MEASUREMENTS[0]
    spoilt[first] = F.when(~((F.col("l_linenumber") == 4) & (F.col("l_partkey") % 5 == 0)), F.col(first))
    rows = _covtype_like(li, "l_linenumber", "l_partkey").withColumns(spoilt).drop("l_linenumber", "l_partkey")
    good, bad = covtype.decode_onehot(rows, on_bad="split")
    return (good.select(F.lit(True).alias("accepted"), F.lit(1).alias("hot_flags"))
            .unionByName(bad.select(F.lit(False).alias("accepted"), "hot_flags"))
            .groupBy("accepted", "hot_flags").agg(F.count(F.lit(1)).alias("n")))


def _broken_sql() -> str:
    """Lines of the cover-type shaped table, some of them no rows of integers, by why they are rejected."""
    return """
SELECT reason, Cover_Type, count(*) AS n FROM (
  SELECT CASE WHEN l_linenumber = 7 OR l_linenumber = 6 AND l_partkey % 2 = 0 THEN 'malformed'
              WHEN l_linenumber = 5 AND l_partkey % 3 = 0 THEN 'empty field'
              WHEN l_linenumber = 4 AND l_partkey % 40 <> 2 THEN 'hot flags' END AS reason,
         CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INTEGER) AS class,
         CASE WHEN reason IS NULL THEN class END AS Cover_Type FROM lineitem)
GROUP BY ALL"""


@query("s2_s3_ingest_rejects", _broken_sql())
def _s2r(spark, sf):
    """A CSV with broken lines: accepted rows by class, rejected ones by reason, both sides from one write."""
    base = scratch_path(spark, f"covtype-broken-{uuid.uuid4().hex}")
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    rows = _covtype_like(parquet.read_table(spark, sf, "lineitem"), "l_linenumber", "l_partkey")
    fields = {c: F.col(c).cast("string") for c in covtype.COLUMNS}
    first, second, flag = covtype.MEASUREMENTS[0], covtype.MEASUREMENTS[1], covtype.SOIL[2]
    fields[first] = F.when(line == 7, F.lit("no number")).otherwise(fields[first])
    fields[second] = F.when((line == 5) & (part % 3 == 0), F.lit("")).otherwise(fields[second])
    fields[flag] = F.when(line == 4, F.lit("1")).otherwise(fields[flag])
    whole = F.concat_ws(",", *fields.values())
    rows.select(F.when((line == 6) & (part % 2 == 0), F.concat(whole, F.lit(",1"))).otherwise(whole).alias("value")).write.text(f"{base}/csv")
    good, bad, counts = covtype.ingest_with_rejects(spark, f"{base}/csv", f"{base}/parquet")
    out = good.select(F.lit(None).cast("string").alias("reason"), covtype.CLASS).unionByName(
        bad.select("reason", F.lit(None).cast("int").alias(covtype.CLASS)))
    return out.groupBy("reason", covtype.CLASS).agg(F.count(F.lit(1)).alias("n"))


@query("s9_export_ranged", ORACLES["a11_cluster_counts"])
def _s9r(spark, sf):
    """A report of many rows, exported by all tasks in files of key ranges."""
    counts = validate.cluster_counts(_many_classes(spark, sf), "label_a", "many")
    path = export_csv(counts, scratch_path(spark, f"counts-{uuid.uuid4().hex}"), sort=["label_a", "many"])
    return read_exported(spark, path, counts.schema)


@query("s9_export_pivot", ORACLES["a11_cluster_pivot"])
def _s9(spark, sf):
    pivot = validate.cluster_pivot(label(st_line(spark, sf), saved.LINE_A), "cluster_id", "y")
    path = export_csv(pivot, scratch_path(spark, f"pivot-{uuid.uuid4().hex}"), single_file=True)
    return read_exported(spark, path, pivot.schema)


@query("st_stream_label_counts", with_staged(
    f"SELECT {duck(saved.LINE_A)} AS cluster_id, y, count(*) AS n FROM st_line AS T GROUP BY ALL", "st_line"))
def _stream(spark, sf):
    schema = parquet.read_table(spark, sf, "lineitem").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf))
    name = f"line_counts_{uuid.uuid4().hex[:8]}"
    q = label_counts_stream(stage_line(stream), saved.LINE_A, "y", name, scratch_path(spark, f"stream-{name}"))
    q.awaitTermination()
    return spark.table(name)


def _forest_built_sql():
    fit = sampling.split_sql("row_key", test=False)
    a = oracles.build_sql("st_event", "row_key", [c for c in EVENT_INTS if c[0] != "user_id"], [], "y", max_depth=3,
                          min_node=500, output="rows", fit_where=fit)
    b = oracles.build_sql("st_event", "row_key", [c for c in EVENT_INTS if c[0] != "hour"], [], "y", max_depth=3,
                          min_node=500, output="rows", fit_where=fit)
    lab = (f"SELECT a.row_key, a.y, a._fit, a.node_id AS label_a, b.node_id AS label_b FROM ({a}) a "
           f"JOIN ({b}) b ON a.row_key = b.row_key")
    return _accuracy_of(_predict_sql("st_event", {"label_a": None, "label_b": None}, _EVENT_CLASSES,
                                     fit_where="_fit", where="NOT _fit", lab_sql=lab))


@query("t11_forest_built", _forest_built_sql())
def _t11b(spark, sf):
    """The forest workflow end to end: two trees grown on train rows (one may not
    use user_id, the other not hour), their class matrices fitted on train rows,
    accuracy of the combined prediction on test rows."""
    train, test = sampling.split_train_test(st_event(spark, sf), "row_key")
    p = BuildParams(max_depth=3, min_node_size=500)
    t1 = build_tree(train, "row_key", ["y"], blacklist=["user_id"], params=p).tree
    t2 = build_tree(train, "row_key", ["y"], blacklist=["hour"], params=p).tree
    return pred.forest_accuracy(test, {"label_a": t1, "label_b": t2}, "y", _EVENT_CLASSES, fit=train)
