"""Training-data operators: quality, packing, decontamination, near-dedup,
sharding, WARC archives, language-model scoring, toxicity and URL filters.

Nothing outside this subpackage imports it.
"""
