"""Column profiles (T1): moments, frequent values and words, entropies.

Every metric is a combinable aggregation over all requested columns at once: a
wide ``agg`` for moments alone; for everything else the cell counts of
:mod:`.cells` (one scan, one ``explode``, one ``groupBy``), optionally per group (a
tree node, a class). The full profile reads even its moments off those counts.
Nothing is collected; top-k uses ``row_number() <= k`` which Spark plans as a partial
``WindowGroupLimit`` before the shuffle, so of a column with billions of distinct
values each task ships at most k of its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.entropy import entropy_expr, entropy_from_counts, xlog2x
from ..functions.text import DEFAULT_NGRAM, DEFAULT_TOKENIZER
from ..plans.tree import Tree
from .cells import GRAM, LENGTH, TEXT, VALUE, WORD, cell_counts, spread

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOMENTS = ["max", "min", "sum0", "sum1", "sum2", "mean", "stddev"]


def kind_of(dtype: T.DataType) -> str | None:
    """'int', 'num' or 'str' — the only three type groups that have meaning."""
    if isinstance(dtype, INTEGRAL):
        return "int"
    if isinstance(dtype, T.NumericType):
        return "num"
    if isinstance(dtype, T.StringType):
        return "str"
    return None


def columns_of_kind(df: DataFrame, kinds: tuple[str, ...], columns: list[str] | None = None) -> list[str]:
    cols = columns if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if kind_of(types[c]) in kinds]


def _moments_from(values: dict[str, Column], group_cols: list[str]) -> tuple[list[Column], list[Column]]:
    aggs, structs = [], []
    for i, (name, v) in enumerate(values.items()):
        x = v.cast("double")
        aggs += [F.max(x).alias(f"_{i}_max"), F.min(x).alias(f"_{i}_min"), F.count(v).alias(f"_{i}_n"),
                 F.sum(x).alias(f"_{i}_s1"), F.sum(x * x).alias(f"_{i}_s2"), F.stddev_pop(x).alias(f"_{i}_sd")]
        mean = F.try_divide(F.col(f"_{i}_s1"), F.col(f"_{i}_n").cast("double"))
        structs.append(F.struct(
            F.lit(name).alias("col_name"),
            F.col(f"_{i}_max").alias("max"), F.col(f"_{i}_min").alias("min"),
            F.col(f"_{i}_n").alias("sum0"), F.col(f"_{i}_s1").alias("sum1"), F.col(f"_{i}_s2").alias("sum2"),
            mean.alias("mean"), F.col(f"_{i}_sd").alias("stddev"),
        ))
    return aggs, structs


def moments(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None,
            of_length: bool = False) -> DataFrame:
    """A2 / A3: max, min, sum0 (count of non-NULL), sum1, sum2, mean and the
    population standard deviation per column, all columns in one
    pass. ``of_length`` profiles ``length(col)`` of string columns instead."""
    group_cols = list(group_cols or [])
    if of_length:
        cols = columns_of_kind(df, ("str",), columns)
        values = {c: F.length(F.col(c)) for c in cols}
    else:
        cols = columns_of_kind(df, ("int", "num"), columns)
        values = {c: F.col(c) for c in cols}
    if not values:
        raise ValueError("no columns to profile")
    aggs, structs = _moments_from(values, group_cols)
    wide = df.groupBy(*group_cols).agg(*aggs)
    return wide.select(*group_cols, F.explode(F.array(*structs)).alias("m")).select(*group_cols, "m.*")


def _unpivot_values(df: DataFrame, columns: list[str], group_cols: list[str], keep_nulls: bool) -> DataFrame:
    """(group..., column, value-as-string) — one row per cell."""
    arr = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for c in columns])
    out = df.select(*group_cols, F.explode(arr).alias("_c")).select(*group_cols, "_c.col_name", "_c.value")
    return out if keep_nulls else out.filter(F.col("value").isNotNull())


def top_k(counts: DataFrame, partition_cols: list[str], k: int, value_col: str = "value",
          count_col: str = "n") -> DataFrame:
    """K2: the k most frequent per partition; ties go to the smaller value."""
    w = Window.partitionBy(*partition_cols).orderBy(F.col(count_col).desc(), F.col(value_col).asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def common_values(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None,
                  k: int = 10) -> DataFrame:
    """A4: the k most common values per column (NULL counts as a value)."""
    group_cols = list(group_cols or [])
    cols = columns_of_kind(df, ("int", "str"), columns)
    counts = _unpivot_values(df, cols, group_cols, keep_nulls=True).groupBy(*group_cols, "col_name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return top_k(counts, group_cols + ["col_name"], k)


def _text_counts(df: DataFrame, columns: list[str], group_cols: list[str] | None, kinds: tuple[str, ...], n: int,
                 tokenizer: str) -> DataFrame:
    group_cols = list(group_cols or [])
    return cell_counts(spread(df.select(*group_cols, *columns)), group_cols, [(c, k) for c in columns for k in kinds], n, tokenizer)


def word_counts(df: DataFrame, columns: list[str], group_cols: list[str] | None = None,
                tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    return _text_counts(df, columns, group_cols, (WORD,), DEFAULT_NGRAM, tokenizer).drop("kind")


def common_words(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None,
                 k: int = 10, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """A5: the k most common words per string column."""
    group_cols = list(group_cols or [])
    cols = columns_of_kind(df, ("str",), columns)
    return top_k(word_counts(df, cols, group_cols, tokenizer), group_cols + ["col_name"], k)


def value_entropy(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """Negative entropy of the (non-NULL) value distribution of each column."""
    group_cols = list(group_cols or [])
    cols = columns if columns is not None else columns_of_kind(df, ("int",))
    counts = _unpivot_values(df, cols, group_cols, keep_nulls=False).groupBy(*group_cols, "col_name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return entropy_from_counts(counts, group_cols + ["col_name"], total_name="n_values")


def word_entropy(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None,
                 tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Negative entropy of the word distribution of each string column."""
    group_cols = list(group_cols or [])
    cols = columns_of_kind(df, ("str",), columns)
    return entropy_from_counts(word_counts(df, cols, group_cols, tokenizer), group_cols + ["col_name"],
                               total_name="n_words")


def gram_counts(df: DataFrame, columns: list[str], group_cols: list[str] | None = None,
                n: int = DEFAULT_NGRAM) -> DataFrame:
    return _text_counts(df, columns, group_cols, (GRAM,), n, DEFAULT_TOKENIZER).drop("kind")


def ngram_entropy(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None,
                  n: int = DEFAULT_NGRAM, per_row: bool = False) -> DataFrame:
    """Negative entropy of the character n-grams (one gram per character
    position, shorter at the end). ``per_row`` also reports it divided by the
    number of non-NULL strings, the form used inside the split entropy (A10)."""
    group_cols = list(group_cols or [])
    cols = columns_of_kind(df, ("str",), columns)
    if n <= 0:
        raise ValueError("n-gram length must be positive")
    if not per_row:
        return entropy_from_counts(gram_counts(df, cols, group_cols, n), group_cols + ["col_name"], total_name="n_grams")
    gram, texts = _of_kind(GRAM), F.coalesce(F.max(F.when(F.col("kind") == TEXT, F.col("n_known"))), F.lit(0))
    sums = _entropies(_text_counts(df, cols, group_cols, (GRAM, TEXT), n, DEFAULT_TOKENIZER), group_cols)
    return sums.groupBy(*group_cols, "col_name").agg(
        F.coalesce(F.max(F.when(F.col("kind") == GRAM, F.col("n_known"))), F.lit(0)).alias("n_grams"), texts.alias("n_rows"),
        gram.alias("entropy"), F.coalesce(F.try_divide(gram, texts.cast("double")), F.lit(0.0)).alias("entropy_per_row"))


def _entropies(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """Of cell counts, per (group..., col_name, kind): n_known (cells that aren't NULL) and their negative entropy."""
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    sums = counts.groupBy(*group_cols, "col_name", "kind").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("n_known"), F.sum(xlog2x(known)).alias("_nl"), F.count(known).alias("_nv"))
    return sums.select(*group_cols, "col_name", "kind", "n_known", entropy_expr(F.col("n_known"), F.col("_nl"), F.col("_nv")).alias("entropy"))


def _of_kind(kind: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("entropy"))), F.lit(0.0))


def string_entropy(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None,
                   n: int = DEFAULT_NGRAM, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """A10: entropy of a string column inside a split: the mean of the n-gram
    entropy per row and the word entropy, or their sum when either is 0. One scan
    gives grams, words and the number of strings."""
    group_cols = list(group_cols or [])
    cols = columns_of_kind(df, ("str",), columns)
    sums = _entropies(_text_counts(df, cols, group_cols, (GRAM, WORD, TEXT), n, tokenizer), group_cols)
    texts = F.max(F.when(F.col("kind") == TEXT, F.col("n_known")))
    both = sums.groupBy(*group_cols, "col_name").agg(
        F.coalesce(F.try_divide(_of_kind(GRAM), texts.cast("double")), F.lit(0.0)).alias("ngram"), _of_kind(WORD).alias("word"))
    return both.withColumn("entropy", F.when((F.col("ngram") == 0) | (F.col("word") == 0), F.col("ngram") + F.col("word"))
                           .otherwise((F.col("ngram") + F.col("word")) / 2))


def _long(frame: DataFrame, group_cols: list[str], metrics: dict[str, Column]) -> DataFrame:
    """A row per metric that isn't NULL or has no other reason to be left out."""
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()])
    return frame.select(*group_cols, "col_name", F.explode(arr).alias("_m")).select(
        *group_cols, "col_name", "_m.metric", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("item"), "_m.value")


def _moments_of_counts(counts: DataFrame, group_cols: list[str], ints: list[str]) -> DataFrame:
    """Per (group..., col_name, kind): entropy, and the moments of integer values and of lengths. The
    sums are of whole numbers, so the deviation comes out without cancellation while they fit 38 digits."""
    number = F.when((F.col("kind") == LENGTH) | (F.col("kind") == VALUE) & F.col("col_name").isin(ints), F.col("value")).try_cast("decimal(19,0)")
    n, x = F.col("n").cast("decimal(19,0)"), number.cast("double")
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    sums = counts.groupBy(*group_cols, "col_name", "kind").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("sum0"), F.sum(xlog2x(known)).alias("_nl"), F.count(known).alias("_nv"),
        F.max(number).cast("double").alias("max"), F.min(number).cast("double").alias("min"),
        F.try_sum(F.try_multiply(number, n)).alias("_s1"), F.try_sum(F.try_multiply(F.try_multiply(number, number), n)).alias("_s2"),
        F.sum(x * F.col("n")).alias("_d1"), F.sum(x * x * F.col("n")).alias("_d2"))
    rows = F.col("sum0").cast("decimal(38,0)")
    exact = F.try_subtract(F.try_multiply(rows, F.col("_s2")), F.try_multiply(F.col("_s1"), F.col("_s1"))).cast("double")
    s1, s2 = (F.coalesce(F.col(f"_s{i}").cast("double"), F.col(f"_d{i}")) for i in (1, 2))
    total = F.col("sum0").cast("double")
    spread_out = F.coalesce(exact, F.greatest(total * s2 - s1 * s1, F.lit(0.0)))
    return sums.select(
        *group_cols, "col_name", "kind", "sum0", entropy_expr(F.col("sum0"), F.col("_nl"), F.col("_nv")).alias("entropy"), "max", "min",
        s1.alias("sum1"), s2.alias("sum2"), F.try_divide(s1, total).alias("mean"), F.try_divide(F.sqrt(spread_out), total).alias("stddev"))


def _top_cells(counts: DataFrame, group_cols: list[str], k: int) -> DataFrame:
    """The k most frequent values and words, as rows of the profile."""
    # One condition on kind and count, so that it stays above the counting, which the other metrics share.
    listed = counts.filter(F.when(F.col("kind").isin(VALUE, WORD), F.col("n")).otherwise(F.lit(0)) > 0)
    best = top_k(listed, [*group_cols, "col_name", "kind"], k)
    return best.select(*group_cols, "col_name", F.when(F.col("kind") == VALUE, F.lit("common_values")).otherwise(F.lit("common_words")).alias("metric"),
                       "rank", F.col("value").alias("item"), F.col("n").cast("double").alias("value"))


def _profile_of_counts(counts: DataFrame, group_cols: list[str], ints: list[str], k: int) -> DataFrame:
    sums = _moments_of_counts(counts, group_cols, ints)
    moments_ = {m: F.col(m) for m in MOMENTS}
    is_int = (F.col("kind") == VALUE) & F.col("col_name").isin(ints)
    metrics = _long(sums, [*group_cols, "kind"], {**moments_, "entropy": F.col("entropy")})
    is_moment = F.col("metric") != "entropy"
    is_int, is_length = (F.col("kind") == VALUE) & F.col("col_name").isin(ints), F.col("kind") == LENGTH
    name = (F.when(is_int, F.col("metric")).when(is_length & is_moment, F.concat(F.lit("length."), "metric"))
            .when((F.col("kind") == GRAM) & ~is_moment, F.lit("char_entropy")).when((F.col("kind") == WORD) & ~is_moment, F.lit("word_entropy")))
    metrics = metrics.withColumn("metric", name).filter(F.col("metric").isNotNull()).drop("kind")
    return metrics.unionByName(_top_cells(counts, group_cols, k))


def profile(df: DataFrame, columns: list[str] | None = None, group_cols: list[str] | None = None,
            n: int = DEFAULT_NGRAM, tokenizer: str = DEFAULT_TOKENIZER, k: int = 10) -> DataFrame:
    """T1 in long form: (group..., col_name, metric, rank, item, value) for every column in
    ``columns``: moments of numeric columns, moments of string lengths
    (``length.*``), value entropy of integer columns, char and word entropy of
    string columns, and the ``k`` most common values of both and words of string columns
    (``common_values``, ``common_words``: item by rank, value is its count; NULL is a value). One scan
    of the table, whatever the metrics; only other numeric columns take a second, narrow one."""
    group_cols, ints, strs, nums = _kinds(df, columns, group_cols)
    parts = []
    if ints or strs:
        counts = cell_counts(spread(df.select(*group_cols, *ints, *strs)), group_cols, _wanted(ints, strs, n), n, tokenizer)
        parts.append(_profile_of_counts(counts, group_cols, ints, k))
    if nums:
        parts.append(_long(moments(df, nums, group_cols), group_cols, {m: F.col(m) for m in MOMENTS}))
    if not parts:
        raise ValueError("no columns to profile")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _kinds(df: DataFrame, columns: list[str] | None, group_cols: list[str] | None) -> tuple[list[str], ...]:
    group_cols = list(group_cols or [])
    cols = [c for c in (columns if columns is not None else df.columns) if c not in group_cols]
    return group_cols, *(columns_of_kind(df, (kind,), cols) for kind in ("int", "str", "num"))


def _wanted(ints: list[str], strs: list[str], n: int) -> list[tuple[str, str]]:
    texts = (VALUE, LENGTH, WORD, GRAM) if n > 0 else (VALUE, LENGTH, WORD)
    return [(c, VALUE) for c in ints] + [(c, kind) for c in strs for kind in texts]


def profile_nodes(df: DataFrame, tree: Tree, columns: list[str] | None = None, branches: bool = True, leaves: bool = True,
                  n: int = DEFAULT_NGRAM, tokenizer: str = DEFAULT_TOKENIZER, k: int = 10) -> DataFrame:
    """T1 per node of a tree: :func:`profile` with a ``node_id``, of its leaves, of its branches (the
    nodes above, root included) or of both. Cells are counted once per leaf; a branch's counts are its leaves', added up."""
    _, ints, strs, _ = _kinds(df, columns, None)
    labelled = spread(df.select(*ints, *strs)).withColumn("node_id", tree.to_column())
    counts = cell_counts(labelled, ["node_id"], _wanted(ints, strs, n), n, tokenizer)
    shortest, steps = F.lit(0) if branches else F.length("node_id"), F.length("node_id") if leaves else F.length("node_id") - 1
    above = F.when(steps >= shortest, F.transform(F.sequence(shortest, F.greatest(steps, shortest)), lambda i: F.substring("node_id", F.lit(1), i)))
    rolled = counts.select(F.explode(above).alias("node_id"), "col_name", "kind", "value", "n").groupBy(
        "node_id", "col_name", "kind", "value").agg(F.sum("n").alias("n"))
    return _profile_of_counts(rolled, ["node_id"], ints, k)
