"""The corpus pipeline: five stages over documents, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import decontam, neardup, packing, quality, secrets
from cairnspark.llm.labels import fold, labelled_sample
from cairnspark.llm.rowkeys import fresh
from cairnspark.llm.tokenizer import word_bpe_path
from cairnspark.session import ensure_checkpoint_dir, read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    texts, labels = labelled_sample(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"), "quality", fold("doc_id", 5) != 0, quality.FIT_ROWS)
    score = fresh(docs, "_score")
    scored = quality.score_documents(docs, quality.fit(texts, labels), name=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near duplicates, that of the least id: shingles of five words, similarity 0.8. Rows are told
    apart by a number that is written once, as ids may be null or repeated."""
    row = fresh(docs, "_row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = neardup.near_duplicates(keyed, shingle=5, percent=80, id_col=row).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", row)
    kept = found.join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)[row].alias(row))
    return keyed.join(kept.select(row), row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; texts, not ids, tell which."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = decontam.decontaminate(keyed, read_table(spark, sf_dir, "benchmark", "item_id", "text"), id_col=key)
    return keyed.join(found.filter(F.size("hits") > 0).select(key).distinct(), key, "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets that the scan reports; n_chars follows the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, word_bpe_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: No SQL: scores of a fitted model, and ids of a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written as Parquet and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
