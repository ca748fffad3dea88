"""DuckDB SQL text of the candidate, scoring and build plans, used as
independent oracles for the Spark operators (row sampling and term order use
the portable hashes of :mod:`sylva.functions.hashing`)."""

from __future__ import annotations

from .functions.entropy import entropy_sql, xlog2x_sql
from .functions.hashing import level_seed, row_hash_sql, term_order_sql
from .functions.text import ngrams_sql, rule_grams_sql, tokenize_sql


def sample_sql(rel: str, key: str, k: int = 5, seed: int = 0, tiebreak: list[str] = ()) -> str:
    tb = "".join(f", {c} ASC NULLS FIRST" for c in tiebreak)
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY {row_hash_sql(key, seed)}, {key}{tb}) "
            f"AS _rn FROM {rel}) WHERE _rn <= {k}")


def int_cands_sql(samp: str, int_cols: list[tuple[str, int]]) -> str:
    vals = " UNION ".join(f"SELECT DISTINCT node_id, '{c}' AS col_name, {p} AS col_pos, CAST({c} AS DOUBLE) AS v "
                          f"FROM {samp} WHERE {c} IS NOT NULL" for c, p in int_cols)
    return (f"SELECT node_id, col_name, col_pos, 'lt' AS kind, v AS num_value, CAST(NULL AS VARCHAR) AS term FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY node_id, col_name ORDER BY v) AS _r FROM ({vals})) WHERE _r > 1")


def text_cands_sql(samp: str, str_cols: list[tuple[str, int]], k: int = 5, seed: int = 0) -> str:
    strings = " UNION ".join(f"SELECT DISTINCT node_id, '{c}' AS col_name, {p} AS col_pos, {c} AS s "
                             f"FROM {samp} WHERE {c} IS NOT NULL" for c, p in str_cols)
    terms = (f"SELECT DISTINCT node_id, col_name, col_pos, t AS term FROM (SELECT node_id, col_name, col_pos, "
             f"unnest(list_concat({tokenize_sql('s')}, {rule_grams_sql('s')})) AS t FROM ({strings})) WHERE length(t) > 0")
    frac = (f"SELECT t.node_id, t.col_name, t.col_pos, t.term, count(DISTINCT s.s) AS n_hit, "
            f"(SELECT count(*) FROM ({strings}) z WHERE z.node_id = t.node_id AND z.col_name = t.col_name) AS n_strings "
            f"FROM ({terms}) t JOIN ({strings}) s ON t.node_id = s.node_id AND t.col_name = s.col_name "
            f"AND contains(s.s, t.term) GROUP BY ALL")
    ok = f"SELECT * FROM ({frac}) WHERE n_hit / n_strings > 0.1 AND n_hit / n_strings < 0.8"
    return (f"SELECT node_id, col_name, col_pos, 'contains' AS kind, CAST(NULL AS DOUBLE) AS num_value, term FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY node_id, col_name ORDER BY {term_order_sql('term', seed)}, term) "
            f"AS _r FROM ({ok})) WHERE _r <= {k}")


def cands_sql(rel: str, key: str, int_cols, str_cols, k: int = 5, seed: int = 0) -> str:
    tiebreak = [c for c, _ in int_cols] + [c for c, _ in str_cols]
    samp = f"({sample_sql(rel, key, k, seed, tiebreak)})"
    parts = []
    if int_cols:
        parts.append(int_cands_sql(samp, int_cols))
    if str_cols:
        parts.append(text_cands_sql(samp, str_cols, k, seed))
    return " UNION ALL ".join(parts)


def rules_sql(cands: str) -> str:
    return (f"SELECT node_id, CAST(row_number() OVER (ORDER BY node_id, col_pos, coalesce(num_value, 0.0), "
            f"coalesce(term, '')) - 1 AS INTEGER) AS rule_id, col_name, col_pos, kind, num_value, term FROM ({cands})")


def predicate_sql(row: str, rule: str, int_cols, str_cols) -> str:
    whens = [f"WHEN '{c}' THEN {row}.{c} < {rule}.num_value" for c, _ in int_cols]
    whens += [f"WHEN '{c}' THEN contains({row}.{c}, {rule}.term)" for c, _ in str_cols]
    return f"(CASE {rule}.col_name {' '.join(whens)} END)"


def _gram_word_sql(branched: str, column: str, keys: str) -> str:
    """A10 of a text column per ``keys``: ``branched`` has the keys, a row id ``_i`` and the column. Grams and
    words are counted once per row, then added up."""
    ent = entropy_sql("sum(n)", "sum(" + xlog2x_sql("n") + ")", "count(*)")

    def part(tokens: str, name: str) -> str:
        own = (f"SELECT _i, t, count(*) AS n FROM (SELECT _i, unnest({tokens}) AS t FROM (SELECT DISTINCT _i, {column} AS s FROM {branched}) "
               f"WHERE s IS NOT NULL) GROUP BY ALL")
        return (f"SELECT {keys}, {ent} AS {name} FROM (SELECT {keys}, t, sum(n) AS n FROM {branched} JOIN ({own}) o USING (_i) "
                f"GROUP BY {keys}, t) GROUP BY {keys}")

    gram, word = "coalesce(g.gram / c.texts, 0.0)", "coalesce(w.word, 0.0)"
    return (f"SELECT {keys}, c.rows, CASE WHEN {gram} = 0 OR {word} = 0 THEN {gram} + {word} ELSE ({gram} + {word}) / 2 END AS entropy "
            f"FROM (SELECT {keys}, count(*) AS rows, count({column}) AS texts FROM {branched} GROUP BY {keys}) c "
            f"LEFT JOIN ({part(ngrams_sql('s'), 'gram')}) g USING ({keys}) LEFT JOIN ({part(tokenize_sql('s'), 'word')}) w USING ({keys})")


def _column_entropy_sql(branched: str, target: str, keys: str, texts: list[str]) -> str:
    """rows and entropy per ``keys`` of one entropy column."""
    if target in texts:
        return f"SELECT {keys}, '{target}' AS col_name, rows, entropy FROM ({_gram_word_sql(branched, target, keys)})"
    counts = f"SELECT {keys}, CAST({target} AS VARCHAR) AS value, count(*) AS n FROM {branched} GROUP BY ALL"
    return (f"SELECT {keys}, '{target}' AS col_name, CAST(sum(n) AS BIGINT) AS rows, "
            f"{entropy_sql('sum(n)', 'sum(' + xlog2x_sql('n') + ')', 'count(*)')} AS entropy FROM ({counts}) GROUP BY {keys}")


def report_sql(rel: str, rules: str, int_cols, str_cols, target: "str | list[str]", factor: float = 1.0,
               texts: list[str] = (), key: str = "row_key") -> str:
    """T5 for one or more entropy columns of weight 1; those in ``texts`` by A10 (``key`` is unique then)."""
    targets = [target] if isinstance(target, str) else list(target)
    named = ", ".join(f"l.{t}" for t in targets)
    branched = (f"(SELECT l.node_id, r.rule_id, CASE WHEN {predicate_sql('l', 'r', int_cols, str_cols)} THEN 0 ELSE 1 END "
                f"AS branch, l.{key} AS _i, {named} FROM {rel} l JOIN ({rules}) r ON l.node_id = r.node_id)")
    keys = "node_id, rule_id, branch"
    per_col = " UNION ALL ".join(f"SELECT {keys}, col_name, rows, entropy, CAST(1.0 AS DOUBLE) AS weight "
                                 f"FROM ({_column_entropy_sql(branched, t, keys, texts)})" for t in targets)
    rep = f"FILTER (WHERE col_name = '{targets[0]}')"
    per_rule = (f"SELECT node_id, rule_id, CAST(sum(rows) {rep} AS BIGINT) AS n_rows, count(*) {rep} AS n_branches, "
                f"{entropy_sql(f'(sum(rows) {rep})', f'(sum(' + xlog2x_sql('rows') + f') {rep})', f'(count(*) {rep})')} AS route_entropy, "
                f"sum(weight * entropy * rows) AS _bsum FROM ({per_col}) GROUP BY node_id, rule_id")
    return (f"SELECT c.*, p.n_rows, p.n_branches, p.route_entropy, p._bsum - {float(factor)!r} * p.route_entropy * p.n_rows "
            f"AS fitness, r.col_name AS rule_column, r.kind, r.num_value, r.term FROM ({per_col}) c "
            f"JOIN ({per_rule}) p USING (node_id, rule_id) JOIN ({rules}) r USING (node_id, rule_id)")


def best_sql(report: str) -> str:
    per_rule = (f"SELECT node_id, rule_id, rule_column, kind, num_value, term, first(fitness) AS fitness, "
                f"first(n_branches) AS n_branches, max(CASE WHEN branch = 0 THEN rows END) AS rows_true, "
                f"max(CASE WHEN branch = 1 THEN rows END) AS rows_false, "
                f"sum(CASE WHEN branch = 0 THEN weight * entropy END) AS entropy_true, "
                f"sum(CASE WHEN branch = 1 THEN weight * entropy END) AS entropy_false FROM ({report}) GROUP BY ALL")
    return (f"SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(fitness / (coalesce(rows_true, 0) + coalesce(rows_false, 0)), 12) DESC, rule_id) "
            f"AS _r FROM ({per_rule}) WHERE n_branches = 2) WHERE _r = 1")


def build_sql(staged: str, key: str, int_cols, str_cols, target: str, max_depth: int = 4, min_node: int = 1000,
              purity_limit: int | None = None, k: int = 5, seed: int = 0, output: str = "nodes",
              fit_where: str = "true", sample_size: int | None = None, spec: list[str] = (), texts: list[str] = ()) -> str:
    """T8 as one query: the node table of the level-wise build. Only rows where
    ``fit_where`` holds grow the tree; the others are routed along (output rows).
    ``sample_size``: rules are scored on that many lowest-hash rows per node. ``spec``: the entropy
    columns (default: the target), of them ``texts`` by A10."""
    spec = list(spec or [target])
    pure = "went = 0" if purity_limit is None else f"rows < {purity_limit} AND went = 0"
    tiebreak = [*(c for c, _ in int_cols), *(c for c, _ in str_cols), *(c for c in spec if c not in dict([*int_cols, *str_cols]))]
    root = " UNION ALL ".join(f"SELECT * FROM ({_column_entropy_sql(f'(SELECT *, {key} AS _i FROM lab0 WHERE _fit)', t, 'node_id', texts)})" for t in spec)
    ctes = [f"lab0 AS (SELECT *, '' AS node_id, ({fit_where}) AS _fit FROM {staged})",
            f"ent0 AS (SELECT node_id, max(rows) AS rows, sum(entropy) AS went FROM ({root}) GROUP BY node_id)",
            "nodes0 AS (SELECT node_id, rows, went FROM ent0)"]
    for L in range(max_depth):
        stop = f"(rows < {min_node} OR ({pure}))"
        scored = f"in{L}"
        if sample_size is not None:
            scored = f"({sample_sql(f'in{L}', key, sample_size, level_seed(seed, L) + 1, tiebreak)})"
        ctes += [
            f"in{L} AS (SELECT l.* EXCLUDE (_fit) FROM lab{L} l JOIN nodes{L} n ON l.node_id = n.node_id AND NOT {stop} WHERE l._fit)",
            f"rules{L} AS ({rules_sql(cands_sql(f'in{L}', key, int_cols, str_cols, k, level_seed(seed, L)))})",
            f"best{L} AS ({best_sql(report_sql(scored, f'SELECT * FROM rules{L}', int_cols, str_cols, spec, texts=texts, key=key))})",
            f"lab{L + 1} AS (SELECT l.* EXCLUDE (node_id), l.node_id || CASE WHEN b.node_id IS NULL THEN '' "
            f"WHEN {predicate_sql('l', 'b', int_cols, str_cols).replace('b.col_name', 'b.rule_column')} THEN '0' ELSE '1' END "
            f"AS node_id FROM lab{L} l LEFT JOIN best{L} b ON l.node_id = b.node_id)",
            f"nodes{L + 1} AS (SELECT node_id || '0' AS node_id, rows_true AS rows, coalesce(entropy_true, 0.0) AS went "
            f"FROM best{L} UNION ALL SELECT node_id || '1', rows_false, coalesce(entropy_false, 0.0) FROM best{L})",
        ]
        if sample_size is not None:  # the children are measured on all their rows
            ctes[-1] = (f"nodes{L + 1} AS (SELECT node_id, CAST(sum(n) AS BIGINT) AS rows, "
                        f"{entropy_sql('sum(n)', 'sum(' + xlog2x_sql('n') + ')', 'count(*)')} AS went FROM (SELECT node_id, {target}, "
                        f"count(*) AS n FROM lab{L + 1} WHERE _fit AND length(node_id) = {L + 1} GROUP BY ALL) GROUP BY node_id)")
    all_nodes = " UNION ALL ".join(f"SELECT node_id, rows FROM nodes{L}" for L in range(max_depth + 1))
    splits = " UNION ALL ".join(f"SELECT node_id, rule_column, kind, num_value, term FROM best{L}" for L in range(max_depth))
    body = (f"SELECT n.node_id, CASE WHEN n.node_id = '' THEN NULL ELSE left(n.node_id, length(n.node_id) - 1) END AS parent_id, "
            f"CAST(length(n.node_id) AS INTEGER) AS depth, n.rows AS n_rows, s.node_id IS NULL AS is_leaf, "
            f"s.rule_column, s.kind AS rule_kind, s.num_value AS rule_value, s.term AS rule_term "
            f"FROM ({all_nodes}) n LEFT JOIN ({splits}) s ON n.node_id = s.node_id")
    if output == "rows":
        body = f"SELECT * FROM lab{max_depth}" if fit_where == "true" else f"SELECT * FROM lab{max_depth}"
    return "WITH " + ",\n".join(ctes) + "\n" + body
