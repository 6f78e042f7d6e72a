"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from lanewise.llm import (
    bpe, contamination, conversations, exact, language, licenses, lines, near, pages, passages, ranked,
    suffixes, toxicity,
)

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_decontamination": contamination.op5_decontamination,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_minhash_dedup": near.op7_minhash_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_text": pages.op9_html_text,
    "op10_bpe": bpe.op10_bpe,
    "op11_suffix_array_dedup": suffixes.op11_suffix_array_dedup,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLE = {**licenses.ORACLE, **lines.ORACLE, **contamination.ORACLE, **exact.ORACLE,
          **ranked.ORACLE}
