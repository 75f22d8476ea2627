"""BM25 ranking of passages and techniques."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions import fixed

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def passages(reports: DataFrame) -> DataFrame:
    """(report_id, page, passage, text): paragraphs of at least MIN_PARAGRAPH characters with single spaces."""
    pages = reports.select("report_id", F.posexplode("pages").alias("_p", "_t"))
    blocks = pages.select("report_id", (F.col("_p") + 1).alias("page"), F.posexplode(F.split("_t", r"\n\s*\n")).alias("passage", "text"))
    return blocks.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " "))).filter(F.length("text") >= fixed.MIN_PARAGRAPH)


def bm25(corpus: DataFrame, keys: tuple[str, ...], text_col: str, query: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score, overlap) of rows that share a token with the query. ``within`` names the columns that set corpora apart.

    Only the query's own tokens leave a row: their counts and the row's length. Statistics are aggregates over those. The rare
    case of a negative idf takes EPSILON of the mean idf of all terms, which is why document frequencies of all terms are needed
    only where a query token is in over half of the rows.
    """
    asked = re.findall("[a-z0-9]+", query.lower())
    terms = sorted(set(asked))
    if not terms:
        return corpus.select(*keys, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("overlap")).limit(0)
    rows = corpus.select(*keys, tokens(F.col(text_col)).alias("_t")).withColumn("_size", F.size("_t"))
    counted = rows.select(*keys, "_size", *[F.size(F.filter("_t", _is(t))).alias(f"_c{i}") for i, t in enumerate(terms)])
    totals = counted.groupBy(*within).agg(F.count("*").alias("_n"), F.avg("_size").alias("_avg"), *[F.count_if(F.col(f"_c{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    idf_of = lambda d: F.log(F.col("_n") - d + 0.5) - F.log(d + 0.5)
    # terms of all rows are counted only where a query token has a negative idf
    common = F.lit(False)
    for i in range(len(terms)):
        common = common | (idf_of(F.col(f"_d{i}")) < 0)
    mean_of = lambda every, n: every.agg(F.avg(F.log(n - F.col("_d") + 0.5) - F.log(F.col("_d") + 0.5)).alias("_mean"))
    if within:
        needy = totals.filter(common).select(*within, "_n")
        every = rows.join(needy, list(within)).select(*within, "_n", F.explode(F.array_distinct("_t")).alias("_w")).groupBy(*within, "_n", "_w").agg(F.count("*").alias("_d"))
        scored = counted.join(totals, list(within)).join(mean_of(every.groupBy(*within), F.col("_n")), list(within), "left")
    else:
        known = totals.withColumn("_common", common).first()
        mean = 0.0
        if known["_common"]:
            mean = mean_of(rows.select(F.explode(F.array_distinct("_t")).alias("_w")).groupBy("_w").agg(F.count("*").alias("_d")).groupBy(), F.lit(known["_n"])).first()[0]
        scored = counted.withColumns({c: F.lit(known[c]) for c in totals.columns} | {"_mean": F.lit(mean)})
    total, overlap = F.lit(0.0), F.lit(0)
    for i, t in enumerate(terms):
        idf = idf_of(F.col(f"_d{i}"))
        idf = F.when(idf < 0, EPSILON * F.col("_mean")).otherwise(idf)
        c = F.col(f"_c{i}")
        part = idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("_size") / F.col("_avg")))
        total = total + F.when(c > 0, part * asked.count(t)).otherwise(0.0)
        overlap = overlap + F.when(c > 0, asked.count(t)).otherwise(0)
    return scored.select(*keys, total.alias("score"), overlap.cast("long").alias("overlap")).filter("overlap > 0")


def _is(term: str):
    return lambda x: x == term


def search_passages(reports: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The k best passages of each report: most query tokens first, then score."""
    found = passages(reports)
    scored = bm25(found, ("report_id", "page", "passage"), "text", query, ("report_id",))
    order = Window.partitionBy("report_id").orderBy(F.desc("overlap"), F.desc("score"), "page", "passage")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(found, ["report_id", "page", "passage"]).select("report_id", "rank", "page", F.substring("text", 1, fixed.PASSAGE_CHARS).alias("text"), "score", "overlap")


def lookup_techniques(techniques: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Techniques (id, name, tactics, description) for free text; an id in the text wins over the search."""
    named = re.search(r"\bT\d{4}(?:\.\d{3})?\b", query, re.I)
    exact = techniques.filter(F.upper("id") == named.group().upper()) if named else techniques.limit(0)
    if named and exact.limit(1).count():
        return exact.select("id", "name", F.lit(None).cast("double").alias("score"))
    rows = techniques.withColumn("_text", F.concat_ws(" ", "name", F.array_join("tactics", " "), "description"))
    return bm25(rows, ("id", "name"), "_text", query).filter("score > 0").orderBy(F.desc("score"), "id").limit(k).select("id", "name", "score")
