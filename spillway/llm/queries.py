"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spillway.llm import alignment, decontaminate, fingerprint, katz, neardup, packing, phrases, pii, quality, sharding, substring, tokenstore, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_quality_cnn": quality.op10_quality_cnn,
    "op11_byte_owners": alignment.op11_byte_owners,
    "op12_norm_buckets": topk.op12_norm_buckets,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
    "op1_katz_backoff": katz.op1_katz_backoff,
    "op2_collinear_chains": substring.op2_collinear_chains,
    "op3_pii_boosting": pii.op3_pii_boosting,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_external_shuffle": sharding.op5_external_shuffle,
    "op6_content_addressed_store": tokenstore.op6_content_addressed_store,
    "op7_simhash_fingerprints": fingerprint.op7_simhash_fingerprints,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_simhash_neardup": neardup.op9_simhash_neardup,
}

ORACLE_SQL: dict[str, str] = {
    "op8_benchmark_decontamination": decontaminate.OP8_SQL,
    "op12_norm_buckets": topk.OP12_SQL,
    "op13_phrase_collocations": phrases.OP13_SQL,
}
