import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from sylva.functions.entropy import entropy_from_counts
from sylva.functions.hashing import row_hash, row_hash_sql, term_order, term_order_sql
from sylva.functions.text import ngrams, rule_grams, tokenize, tokenize_sql


def test_entropy_half_half_is_minus_one(spark):
    counts = spark.createDataFrame([("g", "a", 5), ("g", "b", 5)], "g string, v string, n long")
    r = entropy_from_counts(counts, ["g"]).first()
    assert r["n_total"] == 10
    assert r["entropy"] == pytest.approx(-1.0)


def test_entropy_pure_is_exactly_zero(spark):
    counts = spark.createDataFrame([("g", "a", 7)], "g string, v string, n long")
    assert entropy_from_counts(counts, ["g"]).first()["entropy"] == 0.0


def test_entropy_matches_definition(spark):
    ns = [1, 2, 3, 10]
    counts = spark.createDataFrame([("g", str(i), n) for i, n in enumerate(ns)], "g string, v string, n long")
    tot = sum(ns)
    expected = sum(n / tot * math.log2(n / tot) for n in ns)
    assert entropy_from_counts(counts, ["g"]).first()["entropy"] == pytest.approx(expected)


# Java String.split("\\s+") results, the semantics the tokenizer follows
@pytest.mark.parametrize("text,words", [
    ("a b  c", ["a", "b", "c"]),
    ("  a b  ", ["", "a", "b"]),
    ("a\tb\n", ["a", "b"]),
    ("   ", []),
    ("", [""]),
    ("one", ["one"]),
])
def test_tokenize_java_split(spark, text, words):
    got = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("w")).first()["w"]
    assert got == words
    con = duckdb.connect()
    assert con.execute(f"SELECT {tokenize_sql('t')} FROM (SELECT $1::VARCHAR AS t)", [text]).fetchone()[0] == words


def test_tokenize_other_patterns_and_runs_of_blanks(spark):
    rows = [("a,b,,,", ["a", "b"]), (",,a,,b", ["", "", "a", "", "b"]), (",,,", []), ("", [""]), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").coalesce(1)
    assert [r["w"] for r in df.select(tokenize(F.col("t"), ",").alias("w")).collect()] == [w for _, w in rows]
    con = duckdb.connect()
    for text, words in rows:
        assert con.execute(f"SELECT {tokenize_sql('t', ',')} FROM (SELECT $1::VARCHAR AS t)", [text]).fetchone()[0] == words
    long = spark.createDataFrame([("a" + " " * 100_000 + "b" + " " * 100_000,)], "t string").select(tokenize(F.col("t")).alias("w"))
    start = time.time()
    assert long.first()["w"] == ["a", "b"] and time.time() - start < 10


def test_ngrams_every_position_shorter_at_end(spark):
    got = spark.createDataFrame([("abcdefgh",)], "t string").select(ngrams(F.col("t"), 6).alias("g")).first()["g"]
    assert got == ["abcdef", "bcdefg", "cdefgh", "defgh", "efgh", "fgh", "gh", "h"]
    assert spark.createDataFrame([("",)], "t string").select(ngrams(F.col("t")).alias("g")).first()["g"] == []


def test_ngrams_cross_newlines_and_accents(spark):
    got = spark.createDataFrame([("é\nàb",)], "t string").select(ngrams(F.col("t"), 2).alias("g")).first()["g"]
    assert got == ["é\n", "\nà", "àb", "b"]


def test_rule_grams_skip_last_full_gram(spark):
    df = spark.createDataFrame([("abcdefg",), ("abc",), ("abcdefgh",)], "t string")
    got = [r["g"] for r in df.select(rule_grams(F.col("t"), 6).alias("g")).collect()]
    assert got == [["abcdef"], ["abc"], ["abcdef", "bcdefg"]]


def test_row_hash_is_portable(spark):
    keys = [0, 1, 2, 17, 123456789, 2**40 + 7, 9_000_000_000_000]
    s = {r["k"]: r["h"] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(
        "k", row_hash(F.col("k"), 7).alias("h")).collect()}
    con = duckdb.connect()
    d = dict(con.execute(f"SELECT k, {row_hash_sql('k', 7)} FROM (SELECT unnest($1::BIGINT[]) AS k)", [keys]).fetchall())
    assert s == d
    assert len(set(s.values())) == len(keys)


def test_term_order_is_portable(spark):
    terms = ["a", "the", "%_'", "é"]
    s = {r["t"]: r["o"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(
        "t", term_order(F.col("t"), 3).alias("o")).collect()}
    con = duckdb.connect()
    d = dict(con.execute(f"SELECT t, {term_order_sql('t', 3)} FROM (SELECT unnest($1::VARCHAR[]) AS t)", [terms]).fetchall())
    assert s == d
