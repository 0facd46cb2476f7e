"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tesserae.llm import langid, licences, neardup, packing, personal, quotes, ranked, runs, substring, suffixes, tiling, topk, warc

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_repeated_words": substring.op2_repeated_words,
    "op3_personal_data": personal.op3_personal_data,
    "op4_quotation_links": quotes.op4_quotation_links,
    "op5_contaminated": tiling.op5_contaminated,
    "op6_pack_sequences": packing.op6_pack_sequences,
    "op7_repeated_bytes": suffixes.op7_repeated_bytes,
    "op8_top_k": topk.op8_top_k,
    "op9_licences": licences.op9_licences,
    "op10_language_id": langid.op10_language_id,
    "op11_web_archive": warc.op11_web_archive,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_repeated_words": substring.ORACLE,
    "op4_quotation_links": quotes.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op9_licences": licences.ORACLE,
    "op11_web_archive": warc.ORACLE,
    "op12_ranked_search": ranked.ORACLE,
}
