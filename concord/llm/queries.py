"""The operators' queries and SQL, for the repository's entry point."""

from __future__ import annotations

from concord.llm import align, chat, decontaminate, html_text, langid, line_dedup, near_dup, packing, pieces, quality, tokenfile, toxicity, trie

QUERIES = {
    "op1_best_fit_packing": packing.op1_packing,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_chat_format": chat.op3_chat_format,
    "op4_token_file": tokenfile.op4_token_file,
    "op5_html_text": html_text.op5_html_text,
    "op6_language_id": langid.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_near_duplicates": near_dup.op9_near_duplicates,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_token_alignment": align.op12_alignment,
    "op13_sentence_pieces": pieces.op13_pieces,
}
ORACLE: dict[str, str] = {"op9_near_duplicates": near_dup.OP9_SQL, "op10_line_dedup": line_dedup.OP10_SQL, "op11_prefix_trie": trie.OP11_SQL}
