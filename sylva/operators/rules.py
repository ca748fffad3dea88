"""Rule candidates (T2, T3) from a small per-node sample (M2).

Per node the ``rule_samples`` rows with the lowest hash are drawn (rows beyond a cut-off
of the hash are filtered out before any sort), so the candidate set is bounded by
``nodes x columns x rule_samples`` whatever the table size. Integer columns
offer each distinct sampled value but the smallest as a threshold ``col < v``
(both sides non-empty on the sample); string columns offer words and 6-grams of
the sampled strings that occur in more than 10 % and less than 80 % of them,
at most ``rule_samples`` per column, in seeded-md5 order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.hashing import term_order
from ..functions.text import DEFAULT_NGRAM, DEFAULT_TOKENIZER, pieces, rule_grams, tokenize
from .profile import columns_of_kind
from .sampling import came_short, sample_known_sizes, sample_per_group

#: Characters of a sample that one task takes through T3.
ONE_TASK_CHARS = 100_000

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("node_id", T.StringType(), False),
    T.StructField("col_name", T.StringType(), False),
    T.StructField("col_pos", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("num_value", T.DoubleType(), True),
    T.StructField("term", T.StringType(), True),
])


def int_candidates(sample: DataFrame, columns: list[str], node_col: str = "node_id",
                   positions: dict[str, int] | None = None) -> DataFrame:
    """Per (node, int column) the distinct sampled values, smallest dropped.
    One row per (node, column) holds its at most ``rule_samples`` distinct values
    (``collect_set``), sorted and sliced: one shuffle."""
    positions = positions or {c: i for i, c in enumerate(columns)}
    arr = F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(positions[c]).alias("col_pos"),
                             F.col(c).cast("double").alias("v")) for c in columns])
    vals = sample.select(node_col, F.explode(arr).alias("_c")).select(node_col, "_c.*").filter(F.col("v").isNotNull())
    sets = vals.groupBy(node_col, "col_name", "col_pos").agg(F.sort_array(F.collect_set("v")).alias("vs"))
    return sets.select(
        F.col(node_col).alias("node_id"), "col_name", "col_pos", F.lit("lt").alias("kind"),
        F.explode(F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(1)))).alias("num_value"),
        F.lit(None).cast("string").alias("term"))


def sample_strings(sample: DataFrame, columns: list[str], node_col: str = "node_id",
                   positions: dict[str, int] | None = None) -> DataFrame:
    """The distinct non-NULL sampled strings per (node, column) with a small dense
    id, so no row further down carries the text more than once."""
    positions = positions or {c: i for i, c in enumerate(columns)}
    arr = F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(positions[c]).alias("col_pos"),
                             F.col(c).alias("s")) for c in columns])
    strings = (sample.select(node_col, F.explode(arr).alias("_c")).select(node_col, "_c.*")
               .filter(F.col("s").isNotNull()).distinct())
    part = Window.partitionBy(node_col, "col_name")
    return strings.withColumn("sid", F.row_number().over(part.orderBy("s"))).withColumn(
        "n_strings", F.count(F.lit(1)).over(part))


def text_candidates(sample: DataFrame, columns: list[str], node_col: str = "node_id", rule_samples: int = 5,
                    seed: int = 0, ngram: int = DEFAULT_NGRAM, tokenizer: str | None = DEFAULT_TOKENIZER,
                    lo: float = 0.1, hi: float = 0.8, positions: dict[str, int] | None = None,
                    strings: DataFrame | None = None) -> DataFrame:
    """Words and grams of the sampled distinct strings whose match fraction
    over those strings is strictly inside (lo, hi); the first ``rule_samples`` per
    (node, column) by seeded md5.

    Containment is decided without scanning each string for each term: every
    string is cut into its distinct pieces of up to ``ngram`` characters; a term
    of at most that length is in a string exactly when it is one of its pieces
    (an equi-join), a longer term only when its first ``ngram`` characters are,
    and only those pairs are checked with ``contains``.
    """
    positions = positions or {c: i for i, c in enumerate(columns)}
    width = max(ngram, 1)
    if strings is None:
        strings = sample_strings(sample, columns, node_col, positions)
    term_arrays = []
    if tokenizer is not None:
        term_arrays.append(tokenize(F.col("s"), tokenizer))
    if ngram > 0:
        term_arrays.append(rule_grams(F.col("s"), ngram))
    if not term_arrays:
        return sample.sparkSession.createDataFrame([], CANDIDATE_SCHEMA)
    all_terms = term_arrays[0] if len(term_arrays) == 1 else F.concat(*term_arrays)
    terms = strings.select(node_col, "col_name", "col_pos", "n_strings", F.explode(all_terms).alias("term")).filter(
        F.length("term") > 0).distinct()

    # every distinct substring of 1..width characters of each sampled string
    pieces_ = strings.select(node_col, "col_name", "sid", F.explode(pieces(F.col("s"), width)).alias("piece")).distinct()

    keyed = terms.withColumn("piece", F.substring("term", 1, width))
    # Merge joins: in the one-task form they need neither a shuffle nor a job of their own.
    pairs = keyed.hint("merge").join(pieces_, [node_col, "col_name", "piece"]).select(
        node_col, "col_name", "col_pos", "n_strings", "term", "sid")
    short_hits = pairs.filter(F.length("term") <= width)
    # longer terms: one row per sampled string with the terms whose prefix it holds
    long_terms = pairs.filter(F.length("term") > width).groupBy(node_col, "col_name", "col_pos", "n_strings", "sid").agg(
        F.collect_set("term").alias("ts"))
    long_hits = long_terms.hint("merge").join(strings.select(node_col, "col_name", "sid", "s"), [node_col, "col_name", "sid"]).select(
        node_col, "col_name", "col_pos", "n_strings",
        F.explode(F.filter("ts", lambda t: F.col("s").contains(t))).alias("term"), "sid")
    hits = short_hits.unionByName(long_hits)
    # each (term, string) pair occurs once: terms and pieces are distinct
    frac = hits.groupBy(node_col, "col_name", "col_pos", "n_strings", "term").agg(
        F.count(F.lit(1)).alias("n_hit")).withColumn("frac", F.col("n_hit") / F.col("n_strings").cast("double"))
    ok = frac.filter((F.col("frac") > lo) & (F.col("frac") < hi))
    w = Window.partitionBy(node_col, "col_name").orderBy(term_order(F.col("term"), seed), F.col("term"))
    return ok.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= rule_samples).select(
        F.col(node_col).alias("node_id"), "col_name", "col_pos", F.lit("contains").alias("kind"),
        F.lit(None).cast("double").alias("num_value"), "term")


def rule_columns(df: DataFrame, blacklist: list[str], exclude: list[str] = ()) -> tuple[list[str], list[str]]:
    """Columns that may carry rules: integer and string columns not blacklisted."""
    cols = [c for c in df.columns if c not in set(blacklist) | set(exclude)]
    return columns_of_kind(df, ("int",), cols), columns_of_kind(df, ("str",), cols)


def candidates(df: DataFrame, key: str, int_cols: list[str], str_cols: list[str], node_col: str = "node_id",
               rule_samples: int = 5, seed: int = 0, ngram: int = DEFAULT_NGRAM,
               tokenizer: str | None = DEFAULT_TOKENIZER, sample: DataFrame | None = None,
               positions: dict[str, int] | None = None, strings: DataFrame | None = None) -> DataFrame:
    """T2 + T3 for every node of ``df`` (rows carry their ``node_col``).
    ``positions`` (column -> schema position) orders ties; default ``df``'s order."""
    positions = positions or {c: i for i, c in enumerate(df.columns)}
    if sample is None:
        sample = sample_per_group(df.select(node_col, key, *int_cols, *str_cols), [node_col], key, rule_samples, seed)
    parts = []
    if int_cols:
        parts.append(int_candidates(sample, int_cols, node_col, positions))
    if str_cols:
        parts.append(text_candidates(sample, str_cols, node_col, rule_samples, seed, ngram, tokenizer,
                                     positions=positions, strings=strings))
    if not parts:
        return df.sparkSession.createDataFrame([], CANDIDATE_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collect_candidates(df: DataFrame, key: str, int_cols: list[str], str_cols: list[str], node_col: str = "node_id",
                       rule_samples: int = 5, seed: int = 0, ngram: int = DEFAULT_NGRAM,
                       tokenizer: str | None = DEFAULT_TOKENIZER, positions: dict[str, int] | None = None,
                       sizes: dict[str, int] | None = None) -> list[dict]:
    """:func:`candidates`, collected: nodes x columns x rule_samples rows at most. ``sizes``: the nodes'
    row counts, where they are known (a build knows them); then the sample takes one pass.

    The sample (at most ``rule_samples`` rows per node) is materialised once. Where it holds few
    characters, one task takes it through T2 and T3 without a shuffle; else T3 is dealt out."""
    rows = df.select(node_col, key, *int_cols, *str_cols)
    positions = positions or {c: i for i, c in enumerate(df.columns)}
    held = []

    def drawn(sample: DataFrame) -> tuple[DataFrame, dict[str, int], int]:
        sample = sample.persist()
        held.append(sample)
        chars = reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in str_cols], F.lit(0)).cast("bigint")
        got = sample.groupBy(node_col).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars")).collect()   # a row per node
        return sample, {r[node_col]: r["n"] for r in got}, sum(r["chars"] for r in got)

    try:
        if sizes is None:
            sample, _, chars = drawn(sample_per_group(rows, [node_col], key, rule_samples, seed))
        else:
            sample, found, chars = drawn(sample_known_sizes(rows, node_col, key, rule_samples, sizes, seed))
            short, wider = came_short(found, sizes, rule_samples), 1
            while short:
                wider *= 64
                again, more, extra = drawn(sample_known_sizes(rows, node_col, key, rule_samples, short, seed, wider))
                sample = sample.filter(~F.col(node_col).isin(list(short))).unionByName(again)
                short, chars = came_short(more, short, rule_samples), chars + extra
        if chars <= ONE_TASK_CHARS:
            sample = sample.coalesce(1)
        out = candidates(df, key, int_cols, str_cols, node_col, rule_samples, seed, ngram, tokenizer,
                         sample=sample, positions=positions)
        return [r.asDict() for r in out.collect()]
    finally:
        for frame in held:
            frame.unpersist()
