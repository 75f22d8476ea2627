"""The registered queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import decontam, extraction, licenses, neardup, neighbours, packing, quality, secrets, substrings, toxicity
from cairnspark.llm.labels import fold, labelled_sample
from cairnspark.llm.tokenizer import word_bpe_path
from cairnspark.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.digest(decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, word_bpe_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    texts, labels = labelled_sample(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"), "quality", fold("doc_id", 5) != 0, quality.FIT_ROWS)
    scored = quality.score_documents(docs, quality.fit(texts, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", quality.predicted().alias("predicted"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.pmod("id", F.lit(20)) == 0, k=20)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), shingle=2, percent=80)
    return found.select("*", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("removed")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    texts, labels = labelled_sample(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", fold("doc_id", 4) != 2, toxicity.FIT_ROWS)
    scored = toxicity.score_documents(docs, toxicity.fit(texts, labels))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", toxicity.predicted().alias("predicted"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_secret_scans, op2_decontamination, op3_best_fit_packing, op4_quality_classifier, op5_nearest_neighbours, op6_html_extraction, op7_minhash_near_dedup, op8_suffix_dedup, op9_license_scans, op10_toxicity)}
