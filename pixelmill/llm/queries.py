"""The training-data queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, decontaminate, licenses, media, mixing, near_dup, oracles, quality, suffix_array, suffix_tree, token_counts, toxicity, vector_codes, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_suffix_array": suffix_array.op2,
    "op3_warc": warc.op3,
    "op4_licenses": licenses.op4,
    "op5_quality": quality.op5,
    "op6_toxicity": toxicity.op6,
    "op7_mixing": mixing.op7,
    "op8_media": media.op8,
    "op9_near_dup": near_dup.op9,
    "op10_suffix_trees": suffix_tree.op10,
    "op11_alignment": alignment.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_token_counts": token_counts.op13,
}

ORACLES: dict[str, str] = {
    "op2_suffix_array": oracles.OP2,
    "op3_warc": oracles.OP3,
    "op7_mixing": mixing.OP7_SQL,
    "op9_near_dup": oracles.OP9,
    "op10_suffix_trees": oracles.OP10,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
