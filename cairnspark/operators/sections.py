"""Where a report keeps its indicators: by headings, or else by density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions import fixed

_OPEN = r"(?iU)^\s*(?:appendix\s+[a-z0-9]+[.:]?\s*|[0-9ivx]+[.)]\s*)?(?:" + "|".join(fixed.SECTION_OPEN) + r")\s*[:.]?\s*$"


def heading_like(line: Column) -> Column:
    """Short, without a sentence's end, and in capitals or title case: what a heading looks like once fonts are gone."""
    line = F.trim(line)
    words = F.split(line, r"(?U)\s+")
    letters, capitals = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    ended = line.rlike(r"[.,;]$") & ~line.endswith("...")
    shape = F.length(line).between(3, 90) & ~ended & (F.size(words) <= 12) & (letters > 0)
    return shape & ((capitals == letters) | (titled >= F.greatest(F.lit(1), F.size(words) - 1)) | (capitals > 0.6 * letters))


def heading_pages(reports: DataFrame) -> DataFrame:
    """(report_id, page): a section opens at its heading, closes at a heading that is not about indicators, and goes on across
    pages; the last event before a line says which holds."""
    pages = reports.select("report_id", F.posexplode("pages").alias("_p", "_t"))
    lines = pages.select("report_id", (F.col("_p") + 1).alias("page"), F.posexplode(F.split("_t", "\n")).alias("line", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    opens = F.col("text").rlike(_OPEN)
    closes = heading_like(F.col("text")) & (F.col("text").rlike(rf"(?i)^\s*(?:{fixed.SECTION_CLOSE})\b") | ~F.col("text").rlike(f"(?i){fixed.SECTION_RELATED}"))
    before = Window.partitionBy("report_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(opens, F.lit(True)).when(closes, F.lit(False)), ignorenulls=True).over(before)
    return lines.withColumn("_in", F.coalesce(state, F.lit(False))).groupBy("report_id", "page").agg(F.bool_or("_in").alias("_in")).filter("_in").select("report_id", "page")


def dense_pages(pages: DataFrame) -> DataFrame:
    """(report_id, page, n) of pages (report_id, page, text) with more than DENSITY_FACTOR times their report's average of indicator
    shapes per character. Averages are sums made before the shuffle, one row a report, so no report's pages meet in one task."""
    counted = pages.select("report_id", "page", F.regexp_count("text", F.lit("(?i)" + fixed.DENSITY_PATTERN)).alias("n"), F.greatest(F.length("text"), F.lit(1)).alias("size"))
    average = counted.groupBy("report_id").agg((F.sum("n") / F.sum("size")).alias("_average")).filter("_average > 0")
    return counted.join(average, "report_id").filter(F.col("n") / F.col("size") > fixed.DENSITY_FACTOR * F.col("_average")).select("report_id", "page", "n")


def density_pages(reports: DataFrame) -> DataFrame:
    """(report_id, page) of the dense pages of reports (report_id, pages)."""
    pages = reports.select("report_id", F.posexplode("pages").alias("_p", "text"))
    return dense_pages(pages.select("report_id", (F.col("_p") + 1).alias("page"), "text")).select("report_id", "page")


def section_pages(reports: DataFrame) -> DataFrame:
    """(report_id, pages, found): pages of the section; of reports without a heading, the dense pages."""
    listed = lambda frame, name: frame.groupBy("report_id").agg(F.array_sort(F.collect_set("page")).alias(name))
    out = reports.select("report_id").distinct().join(listed(heading_pages(reports), "_h"), "report_id", "left").join(listed(density_pages(reports), "_d"), "report_id", "left")
    return out.select("report_id", F.coalesce("_h", "_d", F.array().cast("array<int>")).alias("pages")).withColumn("found", F.size("pages") > 0)
