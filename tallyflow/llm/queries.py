"""The registered queries of this subpackage and their SQL."""

from tallyflow.llm import chat_format, importance, lexical, mixing, multiset_hash, packing, quality_model, quality_rules, simhash, toxicity, url_rules, warc, wrappers

QUERIES = {
    "op1_bradley_terry_quality": quality_model.op1_bradley_terry_quality,
    "op2_segment_toxicity": toxicity.op2_segment_toxicity,
    "op3_wrapper_extraction": wrappers.op3_wrapper_extraction,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_event_sourced_chat": chat_format.op5_event_sourced_chat,
    "op6_subset_sum_mix": mixing.op6_subset_sum_mix,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_shortest_pack_first": packing.op8_shortest_pack_first,
    "op9_multiset_fingerprints": multiset_hash.op9_multiset_fingerprints,
    "op10_line_first_rules": quality_rules.op10_line_first_rules,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_warc_normaliser": warc.op12_warc_normaliser,
    "op13_ranked_search": lexical.op13_ranked_search,
}

#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {
    "op5_event_sourced_chat": chat_format.SQL,
    "op7_url_rules": url_rules.SQL,
    "op10_line_first_rules": quality_rules.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_warc_normaliser": warc.SQL,
    "op13_ranked_search": lexical.SQL,
}
