"""Registered queries of the corpus operators, each over its whole table."""

import corpus_pipeline
from spectralake.llm import (decontamination, filter_audit, language_id, logbilinear, mixing, neighbours, ngram_join, resampling, secrets,
                             substring_dedup, toxicity, url_filter, warc)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secrets.report(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def op3_mixing(spark, sf_dir):
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_neighbours(spark, sf_dir):
    return neighbours.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_components(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


def op9_decontamination(spark, sf_dir):
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op11_lm_scoring(spark, sf_dir):
    return logbilinear.report(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark, sf_dir):
    return resampling.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (pipeline, op1_secret_scan, op2_language_id, op3_mixing, op4_toxicity, op5_warc, op6_neighbours, op7_substring_dedup, op8_ngram_jaccard_join, op9_decontamination, op10_url_filter,
                                 op11_lm_scoring, op12_filter_audit, op13_importance_resampling)}
SQL = {"op3_mixing": mixing.TAKEN_SQL, "op5_warc": warc.ROUND_TRIP_SQL, "op9_decontamination": decontamination.REPORT_SQL,
       "op12_filter_audit": filter_audit.REPORT_SQL, "op13_importance_resampling": resampling.REPORT_SQL}
