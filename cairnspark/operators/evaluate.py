"""Comparisons with ground truth, between modes and between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import text


def compare(predicted: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("type",), item: str = "value") -> DataFrame:
    """True and false positives and misses for each group of truth, and overall as null, with precision and recall (null on 0)."""
    keys = [*by, item]
    p = predicted.select(*keys).distinct().join(truth.select(*by).distinct(), list(by), "left_semi").withColumn("_p", F.lit(1))
    both = p.join(truth.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "full")
    count = lambda c: F.count_if(c)
    out = both.rollup(*by).agg(count(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), count(F.col("_t").isNull()).alias("fp"), count(F.col("_p").isNull()).alias("fn"))
    return out.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))


def attainable(truth: DataFrame, sources: DataFrame) -> DataFrame:
    """Truth (report_id, type, value) that stands in the report's text, also with all white space out. The text is undone and
    folded once per report, before the join on the report."""
    bodies = sources.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_index", "text"))), lambda x: x["text"]), "\n").alias("_b"))
    bodies = bodies.select("report_id", F.lower(text.refang(F.col("_b"))).alias("_b")).withColumn("_c", F.regexp_replace("_b", r"(?U)\s+", ""))
    return truth.join(bodies, "report_id").filter(F.contains("_b", F.lower("value")) | F.contains("_c", F.lower("value"))).select("report_id", "type", "value")


def credited_domains(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted domains, and true ones that are hosts of predicted urls."""
    hosts = predicted.filter("type = 'url'").select("report_id", F.lit("domain").alias("type"), text.url_host(F.col("value")).alias("value"))
    return predicted.filter("type = 'domain'").select("report_id", "type", "value").unionByName(truth.filter("type = 'domain'").select("report_id", "type", "value").intersect(hosts)).distinct()


def not_measurable(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Types with predictions but without any truth."""
    return predicted.join(truth.select("type").distinct(), "type", "left_anti").groupBy("type").agg(F.countDistinct("value").alias("extracted"))


def difference(new: DataFrame, old: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that one mode has and the other has not, as added and dropped."""
    a, b = new.select(*keys).distinct(), old.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, list(keys), "left_anti").withColumn("change", F.lit("dropped")))


def variance(runs: DataFrame, by: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """Least, mean and greatest of each measure over a group's runs."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


def grounded_rate(judged: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Kept over proposed, before chunks are merged; a repeated survivor counts as kept."""
    kept = F.count_if(F.col("reason").isNull() | (F.col("reason") == "repeated"))
    return judged.groupBy(*by).agg(kept.alias("kept"), F.count("*").alias("proposed"), F.try_divide(kept, F.count("*")).alias("grounded_rate"))
