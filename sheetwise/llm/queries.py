"""The subpackage's registered queries and their DuckDB equivalents."""

from sheetwise.llm import chat_format, decontaminate, filter_audit, mixing, packing, periodic, pii, quality_rules, sharding, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_private_terms": pii.op1_private_terms,
    "op2_benchmark_leaks": decontaminate.op2_benchmark_leaks,
    "op3_jump_hash_shards": sharding.op3_jump_hash_shards,
    "op4_warc_round_trip": warc.op4_warc_round_trip,
    "op5_induced_sort_dedup": suffix_dedup.op5_induced_sort_dedup,
    "op6_string_kernel_toxicity": toxicity.op6_string_kernel_toxicity,
    "op7_prefix_targets": chat_format.op7_prefix_targets,
    "op8_decision_lists": quality_rules.op8_decision_lists,
    "op9_simhash_groups": simhash.op9_simhash_groups,
    "op10_pfair_mix": mixing.op10_pfair_mix,
    "op11_cost_balanced_packing": packing.op11_cost_balanced_packing,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES = {
    "op3_jump_hash_shards": sharding.ORACLE_OP3,
    "op4_warc_round_trip": warc.ORACLE_OP4,
    "op5_induced_sort_dedup": suffix_dedup.ORACLE_OP5,
    "op7_prefix_targets": chat_format.ORACLE_OP7,
    "op10_pfair_mix": mixing.ORACLE_OP10,
    "op12_filter_audit": filter_audit.ORACLE_OP12,
}
