"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from sievecraft.llm import (
    chat,
    decontamination,
    language_model,
    neardup,
    neighbours,
    packing,
    phrases,
    quality,
    repeats,
    sharding,
    substrings,
    toxicity,
    variants,
)

QUERIES = (
    packing.op1_vector_packing,
    toxicity.op2_crf_toxicity,
    language_model.op3_elias_fano_lm,
    neardup.op4_setsketch_neardup,
    neighbours.op5_int8_block_neighbours,
    substrings.op6_substring_dedup,
    chat.op7_perspective_rotation,
    sharding.op8_rendezvous_shards,
    decontamination.op9_bm25_decontamination,
    quality.op10_pu_quality,
    repeats.op11_two_stage_suffix_dedup,
    phrases.op12_stripes_collocations,
    variants.op13_trie_pair_variants,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_perspective_rotation": chat.OP7_SQL, "op12_stripes_collocations": phrases.OP12_SQL}
