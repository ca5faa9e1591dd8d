"""The queries of the training-data operators: opN_<name> for each, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import chat_format, decontamination, licenses, packing, prefix_trie, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_alignment, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": licenses.op1,
        "op2_sharding": sharding.op2,
        "op3_quality_rules": quality_rules.op3,
        "op4_decontamination": decontamination.op4,
        "op5_packing": packing.op5,
        "op6_quality_classifier": quality_classifier.op6,
        "op7_warc": warc.op7,
        "op8_token_counts": token_counts.op8,
        "op9_simhash_near_dedup": simhash.op9,
        "op10_suffix_dedup": suffix_dedup.op10,
        "op11_prefix_trie": prefix_trie.op11,
        "op12_chat_format": chat_format.op12,
        "op13_token_alignment": token_alignment.op13,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.OP1_SQL, "op2_sharding": sharding.OP2_SQL}
