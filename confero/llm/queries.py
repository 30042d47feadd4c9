"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprint, language, lm, mtree, neardup, packing, quality, toxicity, warc

QUERIES = {
    "op1_exact_top_k": mtree.op1_exact_top_k,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_language_id": language.op6_language_id,
    "op7_i_match": fingerprint.op7_i_match,
    "op8_minhash_neardup": neardup.op8_minhash_neardup,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": mtree.ORACLE,
    "op9_warc": warc.ORACLE,
}
