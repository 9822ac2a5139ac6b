"""The corpus operators' queries and oracle SQL, as the entry module registers them."""

from __future__ import annotations

from strandline.llm import counting, exact, jaccard, mixing, packing, quality, sharding, substrings, tokenstore, vectors

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_nearest_neighbours": vectors.op5_nearest_neighbours,
    "op6_token_counts": counting.op6_token_counts,
    "op7_token_output": tokenstore.op7_token_output,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_quality": quality.op9_quality,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_exact_dedup": exact.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op10_jaccard_join": jaccard.ORACLE,
}
