"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_token_ids, op2_toxicity, op3_pii_surrogates, op4_language_id, op5_exact_dedup, op6_mixing, op7_exact_topk, op8_ngram_jaccard, op9_sentencepiece, op10_substring_dedup, op11_lexical_search, op12_warc, op13_token_alignment

QUERIES = {
    "op1_token_ids": op1_token_ids.op1_token_ids,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_pii_surrogates": op3_pii_surrogates.op3_pii_surrogates,
    "op4_language_id": op4_language_id.op4_language_id,
    "op5_exact_dedup": op5_exact_dedup.op5_exact_dedup,
    "op6_mix_sources": op6_mixing.op6_mix_sources,
    "op7_exact_topk": op7_exact_topk.op7_exact_topk,
    "op8_ngram_jaccard": op8_ngram_jaccard.op8_ngram_jaccard,
    "op9_sentencepiece": op9_sentencepiece.op9_sentencepiece,
    "op10_substring_dedup": op10_substring_dedup.op10_substring_dedup,
    "op11_lexical_search": op11_lexical_search.op11_lexical_search,
    "op12_warc": op12_warc.op12_warc,
    "op13_token_alignment": op13_token_alignment.op13_token_alignment,
}
ORACLES = {
    "op5_exact_dedup": op5_exact_dedup.ORACLE,
    "op6_mix_sources": op6_mixing.ORACLE,
    "op7_exact_topk": op7_exact_topk.ORACLE,
    "op11_lexical_search": op11_lexical_search.ORACLE,
    "op12_warc": op12_warc.ORACLE,
}
