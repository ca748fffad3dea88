"""The registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import (exact_dedup, lm, mixing, near_dup, nearest, packing, periodic, pii, quality, token_counts, toxicity, warc_query,
               whitening)

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_minhash_near_dup": near_dup.query,
    "op3_quality_knn": quality.query,
    "op4_gru_lm": lm.query,
    "op5_warc": warc_query.query,
    "op6_pseudonyms": pii.query,
    "op7_nearest": nearest.query,
    "op8_token_counts": token_counts.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_mixing": mixing.query,
    "op11_periodic_runs": periodic.query,
    "op12_toxicity": toxicity.query,
    "op13_whitening": whitening.query,
}
ORACLES = {
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
