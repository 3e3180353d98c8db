"""The registered queries of this subpackage and the SQL that some can be checked by."""

from __future__ import annotations

from caseworks.llm import audio, collocations, decontaminate, html_extract, langid, lines, lm_score, minhash, packing, ranked, repeats, toxicity, warc

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_warc_transactions": warc.op2_warc_transactions,
    "op3_language_id": langid.op3_language_id,
    "op4_retrieval_packing": packing.op4_retrieval_packing,
    "op5_suffix_dedup": repeats.op5_suffix_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_weighted_minhash": minhash.op7_weighted_minhash,
    "op8_telephony_audio": audio.op8_telephony_audio,
    "op9_gru_scores": lm_score.op9_gru_scores,
    "op10_fuzzy_lines": lines.op10_fuzzy_lines,
    "op11_collocations": collocations.op11_collocations,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_best_position": ranked.op13_best_position,
}

SQL = {
    "op2_warc_transactions": warc.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_best_position": ranked.OP13_SQL,
}
