"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, decontam, embedding_dedup, lm, merkle, near_dedup, packing, quality_model, quality_rules, sharding, toxicity, url_filter, warc

QUERIES = {
    "op1_quality_classifier": quality_model.query,
    "op2_quality_rules": quality_rules.query,
    "op3_best_fit_packing": packing.query,
    "op4_benchmark_decontamination": decontam.query,
    "op5_minhash_near_dedup": near_dedup.query,
    "op6_sharding": sharding.query,
    "op7_warc": warc.query,
    "op8_lm_scoring": lm.query,
    "op9_toxicity": toxicity.query,
    "op10_url_filters": url_filter.query,
    "op11_embedding_near_dedup": embedding_dedup.query,
    "op12_collocations": collocations.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op4_benchmark_decontamination": decontam.SQL,
    "op5_minhash_near_dedup": near_dedup.SQL,
    "op6_sharding": sharding.SQL,
    "op7_warc": warc.SQL,
    "op10_url_filters": url_filter.SQL,
    "op11_embedding_near_dedup": embedding_dedup.SQL,
    "op12_collocations": collocations.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
