"""Level-wise tree build.

The reference grows the tree node by node, shuffling every node's rows into a
new DataFrame per child. Here the data never moves: the feature projection is
persisted once, and each level relabels it with the tree grown so far (the tree
*is* the node-id column), so lineage stays one projection deep at any depth.
Per level there are three steps, of a few small jobs each, whatever the number of nodes:

1. candidates: a per-node hash sample (``rule_samples`` rows, cut off by the known
   node sizes), T2 + T3; collected — bounded by nodes x columns x rule_samples;
2. scoring: every row of every open node gets a code per rule column, one
   partial/final aggregation counts the codes, then K3; the winners (one per
   node) are collected;
3. the winners' branch sizes and entropies become the children's statistics
   for the stop test (T6), so no extra pass is needed.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import level_seed
from ..functions.text import DEFAULT_NGRAM, DEFAULT_TOKENIZER
from ..operators.cells import spread
from ..operators.profile import columns_of_kind
from ..operators.rules import collect_candidates, rule_columns
from ..operators.sampling import sample_per_group
from ..operators.score import branch_stats, number_rules, score_best
from ..session import scratch_path
from ..sources.parquet import write_read_parquet
from .tree import Rule, Tree


@dataclass
class BuildParams:
    max_depth: int = 4
    min_node_size: int = 1000
    rule_samples: int = 5
    sample_size: int | None = None      # rows per node used for scoring; None = all rows
    ngram: int = DEFAULT_NGRAM
    tokenizer: str | None = DEFAULT_TOKENIZER
    selection_factor: float = 1.0
    purity_limit: int | None = None     # a bound below which alone a pure node is a leaf; None: at every size
    seed: int = 0


@dataclass
class BuildResult:
    tree: Tree
    levels: list[dict] = field(default_factory=list)   # per level: node stats, candidates, winners, timings
    sec_root: float = 0.0

    def node_table(self, spark):
        return self.tree.to_dataframe(spark)


def entropy_spec(df: DataFrame, targets: list[str], mode: str = "supervised",
                 exclude: list[str] = ()) -> dict[str, float]:
    """The entropy columns and weights. ``supervised``: the targets only;
    ``unsupervised``: every other integer or string column; ``semi-supervised``:
    both. Weight 1.0 each; ``exclude`` drops columns (e.g. a key)."""
    usable = [c for c in columns_of_kind(df, ("int", "str")) if c not in set(exclude)]
    if mode == "supervised":
        cols = list(targets)
    elif mode == "unsupervised":
        cols = [c for c in usable if c not in targets]
    elif mode in ("semi-supervised", "semi"):
        cols = list(dict.fromkeys(list(usable) + list(targets)))
    else:
        raise ValueError(f"unknown supervision mode {mode}")
    return {c: 1.0 for c in cols}


def stop(rows: int, weighted_entropy: float, p: BuildParams) -> bool:
    """Too small, or pure."""
    pure = weighted_entropy == 0.0 and (p.purity_limit is None or rows < p.purity_limit)
    return rows < p.min_node_size or pure


def build_tree(df: DataFrame, key: str, targets: list[str], weights: dict[str, float] | None = None,
               blacklist: list[str] | None = None, params: BuildParams | None = None,
               persist: bool | str = True) -> BuildResult:
    """Grow a tree over ``df`` to ``params.max_depth`` levels.

    ``targets`` are the class columns (categorical entropy, never rule columns);
    ``weights`` the entropy spec (default: supervised, the targets with weight 1);
    ``blacklist`` more columns that may not carry rules. ``key`` is a stable
    integer row key that seeds every sample. ``persist``: True keeps the feature
    projection in memory/disk (recomputed from the source if an executor is lost);
    ``"table"`` writes it as parquet under the shared ``spark.checkpoint.dir`` and
    reads it back, so a lost executor costs no rescan of the source; False reads
    the source at every level.
    """
    p = params or BuildParams()
    weights = dict(weights or {t: 1.0 for t in targets})
    blacklist = list(dict.fromkeys(list(targets) + list(blacklist or [])))
    int_cols, str_cols = rule_columns(df, blacklist, exclude=[key])
    class_cols = [c for c in weights if c in targets or c in columns_of_kind(df, ("int",))]
    need = list(dict.fromkeys([key, *int_cols, *str_cols, *weights]))
    positions = {c: i for i, c in enumerate(df.columns)}
    # A small input is dealt out to all cores; a large one has splits enough.
    data = spread(df.select(*need))
    if persist == "table":
        data = write_read_parquet(data, scratch_path(df.sparkSession, f"build-{uuid.uuid4().hex}"))
    elif persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    tree = Tree()
    result = BuildResult(tree)
    try:
        t0 = time.time()
        root = branch_stats(data.withColumn("node_id", F.lit("")), ["node_id"], weights, class_cols,
                            p.ngram, p.tokenizer or DEFAULT_TOKENIZER)
        stats = _node_stats(root.collect())
        result.sec_root = round(time.time() - t0, 3)
        if not stats:
            return result
        tree.nodes[""].n_rows = stats[""][0]
        for level in range(p.max_depth):
            open_nodes = sorted(n for n, (rows, went) in stats.items() if not stop(rows, went, p))
            info = {"level": level, "node_stats": dict(stats), "split": open_nodes}
            result.levels.append(info)
            if not open_nodes:
                break
            labelled = data.withColumn("node_id", tree.to_column()).filter(F.col("node_id").isin(open_nodes))
            t0 = time.time()
            cands = collect_candidates(labelled, key, int_cols, str_cols, rule_samples=p.rule_samples,
                                       seed=level_seed(p.seed, level), ngram=p.ngram, tokenizer=p.tokenizer, positions=positions,
                                       sizes={n: stats[n][0] for n in open_nodes})
            info["candidates"] = len(cands)
            # the literals of the scoring plan: bounded by parameters, checked
            bound = len(open_nodes) * (len(int_cols) * p.rule_samples + len(str_cols) * p.rule_samples)
            if len(cands) > bound:
                raise ValueError(f"{len(cands)} candidates, more than the bound of {bound}")
            info["sec_candidates"] = round(time.time() - t0, 3)
            if not cands:
                break
            numbered = number_rules(cands, int_cols, str_cols)
            by_id = {r[1]: r for r in numbered}     # rule_id -> (node, id, column, pos, kind, value, term, idx)
            scored_rows = labelled
            if p.sample_size is not None:
                scored_rows = sample_per_group(labelled, ["node_id"], key, p.sample_size,
                                               level_seed(p.seed, level) + 1)
            t0 = time.time()
            winners = score_best(scored_rows, numbered, int_cols, str_cols, weights, class_cols,
                                 p.selection_factor, p.ngram, p.tokenizer or DEFAULT_TOKENIZER,
                                 with_rule=False).collect()
            info["sec_scoring"] = round(time.time() - t0, 3)
            info["winners"] = [w.asDict() for w in winners]
            next_stats = {}
            for w in winners:
                _, _, column, _, kind, value, term, _ = by_id[w["rule_id"]]
                rule = Rule(column, kind, value, term)
                exact = p.sample_size is None
                tree.split(w["node_id"], rule, w["rows_true"] if exact else None, w["rows_false"] if exact else None)
                next_stats[w["node_id"] + "0"] = (w["rows_true"], w["entropy_true"] or 0.0)
                next_stats[w["node_id"] + "1"] = (w["rows_false"], w["entropy_false"] or 0.0)
            if not winners:
                break
            if p.sample_size is not None:
                # scored on a sample: measure the children on all their rows
                kids = data.withColumn("node_id", tree.to_column()).filter(F.col("node_id").isin(list(next_stats)))
                next_stats = _node_stats(branch_stats(kids, ["node_id"], weights, class_cols, p.ngram,
                                                      p.tokenizer or DEFAULT_TOKENIZER).collect())
                for nid, (rows, _) in next_stats.items():
                    tree.nodes[nid].n_rows = rows
            stats = next_stats
        return result
    finally:
        if persist and persist != "table":
            data.unpersist()


def _node_stats(rows) -> dict[str, tuple[int, float]]:
    out: dict[str, list] = {}
    for r in rows:
        cur = out.setdefault(r["node_id"], [0, 0.0])
        cur[0] = max(cur[0], r["rows"])
        cur[1] += r["weight"] * r["entropy"]
    return {k: (v[0], v[1]) for k, v in out.items()}


def node_stats(df: DataFrame, tree: Tree, weights: dict[str, float], class_cols: list[str],
               params: BuildParams | None = None) -> DataFrame:
    """T6 as a report: per leaf of ``tree`` its rows, weighted entropy and
    whether the stop test makes it final."""
    p = params or BuildParams()
    per_col = branch_stats(df.withColumn("node_id", tree.to_column()), ["node_id"], weights, class_cols,
                           p.ngram, p.tokenizer or DEFAULT_TOKENIZER)
    agg = per_col.groupBy("node_id").agg(F.max("rows").alias("rows"),
                                         F.sum(F.col("weight") * F.col("entropy")).alias("weighted_entropy"))
    pure = F.col("weighted_entropy") == 0.0
    if p.purity_limit is not None:
        pure = pure & (F.col("rows") < p.purity_limit)
    return agg.withColumn("stop", (F.col("rows") < p.min_node_size) | pure)
