"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from impactframe.llm import byte_bpe, codeword_language, decontaminate, katz_model, line_runs, merkle_manifest
from impactframe.llm import ngram_jaccard, random_indexing, rank_array_bpe, robust_quality, suffix_dedup
from impactframe.llm import token_records, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_robust_quality": robust_quality.op3_robust_quality,
    "op4_katz_model": katz_model.op4_katz_model,
    "op5_line_dedup": line_runs.op5_line_dedup,
    "op6_token_records": token_records.op6_token_records,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_ngram_jaccard": ngram_jaccard.op8_ngram_jaccard,
    "op9_language_id": codeword_language.op9_language_id,
    "op10_quality_classifier": random_indexing.op10_quality_classifier,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_rank_array_bpe": rank_array_bpe.op13_rank_array_bpe,
}
ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_line_dedup": line_runs.OP5_SQL,
    "op11_merkle_manifest": merkle_manifest.OP11_SQL,
}
