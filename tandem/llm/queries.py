"""One registered query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import decontaminate, filter_audit, html_extract, jaccard_join, packing, permutation_index, pii, prefix_trie, quality, simhash, suffix_dedup, toxicity, warc
from tandem.llm.oracles import FILTER_AUDIT, JACCARD, PREFIX_TRIE, WARC
from tandem.session import prepare, run_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc_writer(spark, sf_dir):
    folder = run_dir(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


def op3_permutation_search(spark, sf_dir):
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark, sf_dir):
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark, sf_dir):
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op10_pii_sanitisation(spark, sf_dir):
    return pii.report(_table(spark, sf_dir, "documents"))


def op11_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, distance=2)


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.nodes(_table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_warc_writer, op3_permutation_search, op4_benchmark_decontamination, op5_html_extraction,
        op6_best_fit_packing, op7_toxicity, op8_jaccard_join, op9_suffix_dedup, op10_pii_sanitisation, op11_simhash,
        op12_prefix_trie, op13_filter_audit,
    )
}

ORACLES = {"op2_warc_writer": WARC, "op8_jaccard_join": JACCARD, "op12_prefix_trie": PREFIX_TRIE, "op13_filter_audit": FILTER_AUDIT}
