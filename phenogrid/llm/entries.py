"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from phenogrid.llm import alignment, ann, bpe, decontaminate, language_id, line_dedup, lm_score, mixing, near_dedup, phrases, token_counts, token_files, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_warc": warc.op3_warc,
    "op4_language_id": language_id.op4_language_id,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_token_files": token_files.op9_token_files,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_bpe": bpe.op11_bpe,
    "op12_alignment": alignment.op12_alignment,
    "op13_phrases": phrases.op13_phrases,
}

SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op13_phrases": phrases.SQL,
}
