"""Instructions hidden in text: scanning and screening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import fixed


def pattern_counts(frame: DataFrame, id_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """(ids, severity, pattern, matches) for every pattern that matches; one scan of the text, no Python."""
    found = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(n).alias("pattern"), F.regexp_count(F.col(text_col), F.lit("(?i)" + p)).alias("matches")) for s, n, p in fixed.INJECTION_PATTERNS])
    return frame.select(*id_cols, F.explode(F.filter(found, lambda x: x["matches"] > 0)).alias("_f")).select(*id_cols, "_f.*")


def findings(frame: DataFrame, id_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """One row per match: ids, severity, pattern, position (from 0) and a snippet of SNIPPET_CHARS around it.

    Positions come from the texts between matches, so this too stays inside the JVM.
    """
    out = None
    for severity, name, pattern in fixed.INJECTION_PATTERNS:
        regex = "(?i)" + pattern
        text = F.col(text_col)
        pairs = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
        hits = frame.filter(text.rlike(regex)).select(*id_cols, text.alias("_t"), F.filter(pairs, lambda x: x["size"].isNotNull()).alias("_p"))
        hits = hits.select(*id_cols, "_t", F.posexplode("_p").alias("_i", "_m"), "_p")
        start = F.aggregate(F.slice("_p", 1, F.col("_i")), F.lit(0), lambda s, x: s + x["gap"] + x["size"]) + F.col("_m.gap")
        low = F.greatest(F.lit(0), F.col("position") + (F.col("size") / 2).cast("int") - fixed.SNIPPET_CHARS // 2)
        one = hits.select(*id_cols, F.lit(severity).alias("severity"), F.lit(name).alias("pattern"), start.alias("position"), F.col("_m.size").alias("size"), "_t")
        one = one.select(*id_cols, "severity", "pattern", "position", F.trim(F.regexp_replace(F.col("_t").substr(low + 1, F.lit(fixed.SNIPPET_CHARS)), r"(?U)\s+", " ")).alias("snippet"))
        out = one if out is None else out.unionByName(one)
    return out


def policy(frame: DataFrame, id_cols: tuple[str, ...], text_col: str, block_on: str = "high") -> DataFrame:
    """(ids, high, medium, excluded, reasons): what was found and whether the policy (high, medium or none) keeps the text back."""
    names = lambda level: F.array_sort(F.array_compact(F.array(*[F.when(F.col(text_col).rlike("(?i)" + p), F.lit(n)) for s, n, p in fixed.INJECTION_PATTERNS if s == level])))
    rows = frame.select(*id_cols, names("high").alias("high"), names("medium").alias("medium"))
    blocked = {"high": F.size("high") > 0, "medium": (F.size("high") > 0) | (F.size("medium") > 0), "none": F.lit(False)}[block_on]
    return rows.withColumn("excluded", blocked).withColumn("reasons", F.when(F.col("excluded"), F.col("high")).otherwise(F.array().cast("array<string>")))


def screen_chunks(chunks: DataFrame, block_on: str = "high") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allowed chunks, findings, excluded chunks with reasons)."""
    ids = ("report_id", "chunk_index")
    judged = policy(chunks, ids, "text", block_on)
    excluded = judged.filter("excluded").select(*ids, "reasons")
    return chunks.join(excluded, list(ids), "left_anti"), findings(chunks, ids, "text"), excluded
