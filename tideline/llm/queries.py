"""The corpus queries and their SQL twins, by name."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, mixing, packing, pii, quality, resampling, sharding, simhash_dedup, substring_dedup, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_personal_data": pii.op9_personal_data,
    "op10_packing": packing.op10_packing,
    "op11_sharding": sharding.op11_sharding,
    "op12_resampling": resampling.op12_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op1_url_filters": url_filter.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_embedding_dedup": embedding_dedup.SQL,
    "op11_sharding": sharding.SQL,
    "op12_resampling": resampling.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
