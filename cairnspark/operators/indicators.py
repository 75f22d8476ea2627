"""Indicators of compromise: scanning, deduplication, suppression and flags.

Two scans exist. ``pattern_hits`` finds plain spellings with built-in expressions and yields values. ``spelled_hits`` reads each text
once in an Arrow function and also yields offsets and the spelling as printed, defanged or not; everything after it is relational.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.functions import fixed, text
from cairnspark.operators.repair import rejoin_wrapped_hashes
from cairnspark.session import cut

# Fixed values, plain spellings by type. Boundaries are ASCII.
PATTERNS = {
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "url": r"""\b(?:https?|ftp)://[^\s<>"]+""",
    "md5": r"\b[0-9A-Fa-f]{32}\b",
    "sha1": r"\b[0-9A-Fa-f]{40}\b",
    "sha256": r"\b[0-9A-Fa-f]{64}\b",
    "sha512": r"\b[0-9A-Fa-f]{128}\b",
    "cve": r"(?i)\bCVE-[0-9]{4}-[0-9]{4,7}\b",
}


def normalized(kind: str, value: Column) -> Column:
    return {"ipv4": text.normalize_ipv4, "url": text.normalize_url, "email": text.normalize_email, "cve": text.normalize_cve, "domain": text.normalize_domain}.get(kind, text.normalize_hash)(value)


def pattern_hits(frame: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...]) -> DataFrame:
    """(id, type, value) for each match of the plain patterns, normalized; values that are none after all are dropped."""
    found = [F.transform(F.regexp_extract_all(F.col(text_col), F.lit(PATTERNS[k]), F.lit(0)), _struct_of(k)) for k in kinds]
    rows = frame.select(F.col(id_col), F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("_h"))
    return rows.select(id_col, "_h.type", "_h.value").filter(F.col("value").isNotNull())


def _struct_of(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("type"), normalized(kind, m).alias("value"))


def counted(hits: DataFrame, id_col: str) -> DataFrame:
    return hits.groupBy(id_col, "type", "value").agg(F.count("*").alias("occurrences"))


def counts_by_type(hits: DataFrame, id_col: str) -> DataFrame:
    """Distinct values of each type, as one map per report."""
    per = hits.groupBy(id_col, "type").agg(F.countDistinct("value").alias("n"))
    return per.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))


# -- spellings with offsets ---------------------------------------------------------------------

_DOT = r"(?:\.|\[\s*\.\s*\]|\(\s*\.\s*\)|\{\s*\.\s*\}|\[\s*dot\s*\]|\(\s*dot\s*\))"
_AT = r"(?:@|\[\s*(?:@|at)\s*\]|\(\s*(?:@|at)\s*\))"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_SPELLINGS = re.compile(
    "|".join(
        (
            rf"(?P<url>\b(?:h(?:tt|xx)ps?|f(?:tp|xp))(?::|\[:\]|\(:\))//[^\s<>\"]+|\b(?:h(?:tt|xx)ps?|f(?:tp|xp))\[://\][^\s<>\"]+)",
            rf"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+{_AT}{_LABEL}(?:{_DOT}{_LABEL})+)",
            r"(?P<cve>\bCVE-[0-9]{4}-[0-9]{4,7}\b)",
            r"(?P<hash>\b(?:[0-9A-Fa-f]{128}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})\b)",
            rf"(?P<ipv4>\b[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}\b(?!{_DOT}[0-9]))",
            r"(?P<ipv6>(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:]))",
            rf"(?P<domain>(?<![A-Za-z0-9@._-]){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}\b(?!{_DOT}[A-Za-z0-9]))",
        )
    ),
    re.IGNORECASE,
)
_UNDO = ((re.compile(r"\[://\]"), "://"), (re.compile(r"\[\s*:\s*\]|\(\s*:\s*\)"), ":"), (re.compile(_DOT, re.I), "."), (re.compile(_AT, re.I), "@"), (re.compile(r"^hxxp", re.I), "http"), (re.compile(r"^fxp", re.I), "ftp"))
_HASHES = {32: "md5", 40: "sha1", 64: "sha256", 128: "sha512"}
_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)(.*)$", re.S)


def _value(kind: str, spelled: str, tlds: frozenset[str]) -> tuple[str, str] | None:
    plain = spelled
    for pattern, with_ in _UNDO:
        plain = pattern.sub(with_, plain)
    if kind == "hash":
        return _HASHES[len(plain)], plain.lower()
    if kind == "cve":
        return kind, plain.upper()
    if kind == "email":
        return kind, plain.lower().rstrip(".")
    if kind == "url":
        m = _URL.match(plain.rstrip(".,;)\"'"))
        return (kind, f"{m[1].lower()}://{m[2].lower()}{m[3]}") if m else None
    if kind in ("ipv4", "ipv6"):
        try:
            return kind, str(ipaddress.ip_address(plain))
        except ValueError:
            return None
    name = plain.lower().rstrip(".")
    return (kind, name) if name.rsplit(".", 1)[-1] in tlds else None


def scan_text(source: str, tlds: frozenset[str] = frozenset(fixed.TLDS)) -> Iterator[tuple[str, str, str, int, int]]:
    """(type, value, spelling, start, end) in text order. Hosts of urls and e-mails are domains as well."""
    for m in _SPELLINGS.finditer(source):
        kind, spelled, start = m.lastgroup, m.group(), m.start()
        if kind == "url":
            spelled = spelled.rstrip(".,;)\"'" if "(" not in spelled else ".,;\"'")
        found = _value(kind, spelled, tlds)
        if found is None:
            continue
        yield (*found, spelled, start, start + len(spelled))
        if kind in ("url", "email"):
            host = re.search(r"(?<=//)[^/?#]+" if kind == "url" else rf"(?<=[@\])])(?:{_LABEL})(?:{_DOT}{_LABEL})+$", spelled, re.I)
            named = host and _value("domain", host.group().rsplit("@", 1)[-1].split(":")[0] if kind == "url" else host.group(), tlds)
            if named and not re.fullmatch(r"[0-9.]+", named[1]):
                yield (*named, host.group(), start + host.start(), start + host.end())


def spelled_hits(sources: DataFrame, repair: bool = True) -> DataFrame:
    """Sources (report_id, source_index, page, text) to hits with offsets into the text that was searched, which comes along as
    ``window`` of HASH_WINDOW characters on either side, so that no later step needs the text again."""
    schema = "report_id string, source_index int, page int, type string, value string, form string, start int, end int, window string, offset int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for report, index, page, body in zip(frame.report_id, frame.source_index, frame.page, frame.text, strict=True):
                body = rejoin_wrapped_hashes(body or "") if repair else body or ""
                for kind, value, form, start, end in scan_text(body):
                    low = max(0, start - fixed.HASH_WINDOW)
                    rows.append((report, index, page, kind, value, form, start, end, body[low : end + fixed.HASH_WINDOW], low))
            yield pd.DataFrame(rows, columns=["report_id", "source_index", "page", "type", "value", "form", "start", "end", "window", "offset"])

    return sources.select("report_id", "source_index", "page", "text").mapInPandas(run, schema)


def document_sources(reports: DataFrame) -> DataFrame:
    """Pages, numbered from 1, then table rows as text with page 0: (report_id, source_index, page, text)."""
    pages = reports.select("report_id", F.posexplode("pages").alias("source_index", "text")).withColumn("page", F.col("source_index") + 1)
    rows = F.transform("tables", lambda t: F.array_join(F.transform(t, lambda r: F.array_join(F.filter(r, lambda c: c.isNotNull() & (c != "")), " ")), "\n"))
    tables = reports.select("report_id", F.size("pages").alias("_n"), F.posexplode(rows).alias("_i", "text"))
    return pages.select("report_id", "source_index", "page", "text").unionByName(tables.select("report_id", (F.col("_n") + F.col("_i")).alias("source_index"), F.lit(0).alias("page"), "text"))


def suppress_url_only_domains(hits: DataFrame) -> DataFrame:
    """Without domains all of whose occurrences lie inside urls of the same source: a containment join on the source."""
    urls = hits.filter("type = 'url'").select("report_id", "source_index", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    domains = hits.filter("type = 'domain'").select("report_id", "value", "source_index", "start", "end")
    inside = domains.join(urls, ["report_id", "source_index"], "left").groupBy("report_id", "value", "source_index", "start", "end").agg(F.coalesce(F.bool_or((F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e"))), F.lit(False)).alias("_in"))
    gone = inside.groupBy("report_id", "value").agg(F.bool_and("_in").alias("_all")).filter("_all").select("report_id", "value", F.lit("domain").alias("type"))
    return hits.join(gone, ["report_id", "value", "type"], "left_anti")


def snippet() -> Column:
    """CONTEXT_RADIUS characters on either side, on one line, with marks where text goes on."""
    low = F.greatest(F.col("start") - fixed.CONTEXT_RADIUS, F.lit(0))
    piece = F.col("window").substr(low - F.col("offset") + 1, F.col("end") + fixed.CONTEXT_RADIUS - low)
    more = F.length("window") + F.col("offset") > F.col("end") + fixed.CONTEXT_RADIUS
    return F.concat(F.when(low > 0, "…").otherwise(""), F.trim(F.regexp_replace(piece, r"(?U)\s+", " ")), F.when(more, "…").otherwise(""))


def publisher_domains(urls: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, domain): the registrable host that most distinct urls of a report point to, if it has the floor and the share."""
    hosts = urls.select(id_col, url_col).distinct().select(id_col, text.registrable(text.url_host(F.col(url_col))).alias("domain")).filter("domain <> ''")
    counts = hosts.groupBy(id_col, "domain").agg(F.count("*").alias("urls"))
    best = counts.groupBy(id_col).agg(F.max(F.struct("urls", "domain")).alias("_b"), F.sum("urls").alias("total"))
    return best.filter((F.col("_b.urls") >= fixed.PUBLISHER_FLOOR) & (F.col("_b.urls") >= fixed.PUBLISHER_SHARE * F.col("total"))).select(id_col, F.col("_b.domain").alias("domain"), F.col("_b.urls").alias("urls"), "total")


def benign_domains(domains: DataFrame, id_col: str, domain_col: str, publishers: DataFrame | None = None, allowlist: tuple[str, ...] = fixed.ALLOWLIST) -> DataFrame:
    """Distinct (id, domain) that are, or lie under, an allowlisted domain or the report's publisher."""
    rows = domains.select(id_col, domain_col).distinct()
    listed = rows.filter(F.arrays_overlap(text.parents(F.col(domain_col)), F.array(*[F.lit(a) for a in allowlist]))) if allowlist else rows.limit(0)
    if publishers is None:
        return listed
    up = rows.withColumn("domain_", F.explode(text.parents(F.col(domain_col))))
    own = up.join(publishers.select(id_col, F.col("domain").alias("domain_")), [id_col, "domain_"]).select(id_col, domain_col)
    return listed.unionByName(own).distinct()


def aggregate(hits: DataFrame, section_pages: DataFrame | None = None) -> DataFrame:
    """One row per (report, type, value): occurrences, pages, spellings and contexts as first seen, flags in fixed order."""
    hits = suppress_url_only_domains(hits)
    publishers = publisher_domains(hits.filter("type = 'url'").select("report_id", "value"), "report_id", "value").select("report_id", "domain")
    others = hits.groupBy("report_id").agg(F.collect_set(F.when(~F.col("type").isin("md5", "sha1", "sha256", "sha512"), F.lower("value"))).alias("_values"))
    near = F.col("window").substr(F.greatest(F.col("start") - fixed.VERSION_WINDOW, F.lit(0)) - F.col("offset") + 1, F.lit(fixed.VERSION_WINDOW * 2) + F.col("end") - F.col("start"))
    order = F.struct("source_index", "start")
    lone = ~F.col("window").rlike("(?i)" + fixed.HASH_WORDS) & ~F.exists(F.regexp_extract_all("window", F.lit(r"\b[0-9a-fA-F]{32,128}\b"), F.lit(0)), lambda t: F.lower(t) != F.col("value"))
    lone = lone & ~F.exists("_values", lambda v: F.contains(F.lower(F.col("window")), v))
    is_hash = F.col("type").isin("md5", "sha1", "sha256", "sha512")
    rows = hits.join(others, "report_id").select("report_id", "type", "value", "page", "form", order.alias("_o"), snippet().alias("_context"), near.rlike("(?i)" + fixed.VERSION_WORDS).alias("_version"), F.when(is_hash, lone).alias("_lone"))
    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(c).alias("_v")))), lambda x: x["_v"]))
    out = rows.groupBy("report_id", "type", "value").agg(
        F.count("*").alias("occurrences"),
        F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"),
        in_order("form").alias("original_forms"),
        F.slice(in_order("_context"), 1, fixed.MAX_CONTEXTS).alias("contexts"),
        F.bool_or("_version").alias("_version"),
        F.bool_and("_lone").alias("_lone"),
    )
    benign = benign_domains(out.filter("type = 'domain'").withColumnRenamed("value", "domain_value"), "report_id", "domain_value", publishers)
    benign = benign.select("report_id", F.lit("domain").alias("type"), F.col("domain_value").alias("value"), F.lit(True).alias("_benign"))
    out = out.join(benign, ["report_id", "type", "value"], "left")
    address = F.when(F.col("type") == "ipv4", F.col("value"))
    conditions = {name: F.coalesce(c, F.lit(False)) for name, c in text.ipv4_flags(address).items()} | {
        "possible_version_number": (F.col("type") == "ipv4") & F.col("_version"),
        "benign_domain": F.coalesce("_benign", F.lit(False)),
        "filename_like_domain": (F.col("type") == "domain") & text.filename_like(F.col("value")),
        "hash_without_context": F.coalesce("_lone", F.lit(False)),
    }
    out = out.withColumn("flags", text.ordered_flags(conditions)).drop("_version", "_lone", "_benign")
    if section_pages is None:
        return out.withColumn("in_ioc_section", F.lit(False))
    return out.join(section_pages.select("report_id", F.col("pages").alias("_section")), "report_id", "left").withColumn("in_ioc_section", F.coalesce(F.arrays_overlap("pages", "_section"), F.lit(False))).drop("_section")


def extract_indicators(reports: DataFrame, repair: bool = True) -> DataFrame:
    """Reports (report_id, pages, tables) to their indicators. Texts are scanned once; hits, which the steps after it read several
    times, are written with the few characters around them. Without ``repair`` texts are read as they stand: for running text,
    where short words in a row ("de de de ...") would make digests that no one wrote."""
    from cairnspark.operators.sections import section_pages

    return aggregate(cut(spelled_hits(document_sources(reports), repair)), section_pages(reports))


def was_defanged(forms: Column, value: Column) -> Column:
    return F.exists(forms, lambda f: f != value)


def view(indicators: DataFrame, kinds: tuple[str, ...] = fixed.INDICATOR_TYPES, flagged: bool = True) -> DataFrame:
    """The rows a reader asked for, in type and value order."""
    wanted = F.col("type").isin(*kinds)
    return indicators.filter(wanted if flagged else wanted & (F.size("flags") == 0)).orderBy("type", "value")


def totals(indicators: DataFrame) -> DataFrame:
    """Per report: indicators, flagged ones, and counts by type."""
    by_type = indicators.groupBy("report_id", "type").agg(F.count("*").alias("n"), F.count_if(F.size("flags") > 0).alias("f"))
    return by_type.groupBy("report_id").agg(F.sum("n").alias("total"), F.sum("f").alias("flagged"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts_by_type"))


def first_hits(hits: DataFrame, per: int = 1) -> DataFrame:
    """The first occurrences of each value in text order."""
    order = Window.partitionBy("report_id", "type", "value").orderBy("source_index", "start")
    return hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per).drop("_n")


class _IndicatorTable:
    """Rows of a scan, for SQL."""

    def eval(self, source: str):  # noqa: ANN201
        yield from scan_text(rejoin_wrapped_hashes(source or ""))


def register_table_function(spark: SparkSession, name: str = "extract_indicators") -> None:
    """``SELECT r.id, i.* FROM reports r, LATERAL extract_indicators(r.text) i`` from then on."""
    spark.udtf.register(name, F.udtf(_IndicatorTable, returnType="type string, value string, form string, start int, end int"))
