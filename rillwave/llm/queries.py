"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from rillwave.llm import (alignment, ann, hardneg, language, licenses, mixing, neardup, packing, pages, secrets, sentencepieces,
                          substrings, topk)

QUERIES = [language.op1_language_id, substrings.op2_substring_dedup, pages.op3_main_text, ann.op4_nearest_neighbours,
           neardup.op5_near_duplicates, topk.op6_exact_top_k, licenses.op7_licences, packing.op8_packing,
           secrets.op9_secrets, mixing.op10_mixing, alignment.op11_alignment, hardneg.op12_hard_negatives,
           sentencepieces.op13_sentencepiece]
#: Tokenisation, training, hashing of bytes and similarity search are beyond SQL; their tests use brute force.
ORACLES = {"op5_near_duplicates": neardup.OP5_SQL, "op6_exact_top_k": topk.OP6_SQL, "op9_secrets": secrets.OP9_SQL,
           "op10_mixing": mixing.OP10_SQL, "op12_hard_negatives": hardneg.OP12_SQL}
