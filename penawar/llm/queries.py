"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from penawar.llm import ann, decontam, langid, licenses, mixing, negatives, ngram_join, quality, repair, secrets, substrings, url_filter, warc
from penawar.llm.common import table


def op1_secret_scan(spark, sf_dir):
    return secrets.span_digest(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_ann(spark, sf_dir):
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_decontaminate(spark, sf_dir):
    d = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark, sf_dir):
    return substrings.kept_digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(negatives.mislabelled(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


def op13_conversation_repair(spark, sf_dir):
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_url_filter, op3_warc, op4_ann, op5_language_id, op6_mix_sources, op7_quality, op8_jaccard_join, op9_decontaminate, op10_license_scan,
                                op11_substring_dedup, op12_hard_negatives, op13_conversation_repair)}
