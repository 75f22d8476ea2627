"""Reports, catalogs, technique bundles and ground truth as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import fixed, text

TABLES = "array<array<array<string>>>"


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, or else Latin-1, which reads anything."""
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def looks_like_pdf(content: Column) -> Column:
    return F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^[ï»¿ \t\r\n]+", "").startswith("%PDF-")


def detected_type(filename: Column, content: Column) -> Column:
    """pdf or html by content, or null where content and file ending disagree or neither tells."""
    found = F.when(looks_like_pdf(content), "pdf").when(decoded(content).rlike(r"(?i)<(?:html|body|div)[\s>]"), "html")
    ending = F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))
    return F.when(ending == "pdf", F.when(found == "pdf", "pdf")).when(ending.isin("html", "htm"), F.when(found == "html", "html")).otherwise(found)


def load_files(spark: SparkSession, path: str, most_bytes: int = fixed.MAX_REPORT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, rejected): files (report_id, filename, file_type, sha256, size_bytes, content); rejected ones with a reason.

    Sizes are filtered before contents are read into rows.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"), "content")
    kind = detected_type(F.col("filename"), F.col("content"))
    reason = F.when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > most_bytes, "too large").when(kind.isNull(), "unknown or mismatched type")
    judged = raw.withColumn("reason", reason)
    files = judged.filter("reason is null").select(text.report_node_id(F.sha2("content", 256)).alias("report_id"), "filename", kind.alias("file_type"), F.sha2("content", 256).alias("sha256"), "size_bytes", "content")
    return files, judged.filter("reason is not null").select("filename", "size_bytes", "reason")


def html_reports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, quarantine): visible text as one page each; reports without any are left to the caller to reject by page_count."""
    from cairnspark.operators.sanitize import sanitized

    pages = sanitized(files.filter("file_type = 'html'").withColumn("html", decoded(F.col("content"))), "report_id", "html")
    base = files.drop("content").join(pages, "report_id")
    reports = base.select("report_id", "filename", "file_type", "sha256", "size_bytes", F.when(F.col("text") != "", 1).otherwise(0).alias("page_count"), F.array("text").alias("pages"), F.array().cast(TABLES).alias("tables"))
    return reports, pages.select("report_id", "items")


def pdf_reports(files: DataFrame, reader: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """PDF files through a reader of the caller's: rows (report_id, pages, tables). No PDF library is assumed."""
    read = reader(files.filter("file_type = 'pdf'")).select("report_id", F.transform("pages", lambda p: clean_pdf_text(p)).alias("pages"), clean_tables(F.col("tables")).alias("tables"))
    return files.drop("content").join(read, "report_id").select("report_id", "filename", "file_type", "sha256", "size_bytes", F.size("pages").alias("page_count"), "pages", "tables")


def clean_pdf_text(page: Column) -> Column:
    return F.regexp_replace(F.replace(page, F.lit("­"), F.lit("")), r"(?U)(\w)-\n([a-z])", "$1$2")


def clean_tables(tables: Column) -> Column:
    """Trimmed cells; tables without any text are gone."""
    trimmed = F.transform(tables, lambda t: F.transform(t, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))))
    return F.filter(trimmed, lambda t: F.exists(t, lambda r: F.exists(r, lambda c: c != "")))


def joined_pages(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("[[PAGE "), (i + 1).cast("string"), F.lit("]]\n"), p)), "\n\n")


def catalog(spark: SparkSession, path: str, reports: str = "reports") -> DataFrame:
    """Entries of a JSON catalog of reports."""
    return spark.read.option("multiLine", True).json(path).selectExpr(f"inline({reports})")


def categories(entries: DataFrame) -> DataFrame:
    return entries.select("category").distinct().orderBy("category")


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    host = text.url_host(url)
    return url.startswith("https://") & F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


def techniques(bundle: DataFrame) -> DataFrame:
    """A STIX bundle (objects) to current techniques (id, name, tactics, description), by id."""
    rows = bundle.select(F.explode("objects").alias("o")).select("o.*")
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    current = rows.filter((F.col("type") == "attack-pattern") & ~F.coalesce(have("revoked").cast("boolean"), F.lit(False)) & ~F.coalesce(have("x_mitre_deprecated").cast("boolean"), F.lit(False)))
    own = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    phases = F.transform(F.filter("kill_chain_phases", lambda k: k["kill_chain_name"] == "mitre-attack"), lambda k: k["phase_name"])
    out = current.select(own.alias("id"), "name", F.coalesce(phases, F.array().cast("array<string>")).alias("tactics"), text.clean_description(F.coalesce("description", F.lit(""))).alias("description"))
    return out.filter("id is not null").orderBy("id")


def load_techniques(spark: SparkSession, path: str) -> DataFrame:
    return techniques(spark.read.option("multiLine", True).json(path))


def ground_truth(bundle: DataFrame) -> DataFrame:
    """(type, value): what the patterns of a STIX bundle's indicators, and its vulnerabilities and reports, name."""
    rows = bundle.select(F.explode("objects").alias("o")).select("o.*")
    # Fixed values, comparisons of the pattern language by type.
    comparisons = {
        "ipv4": r"ipv4-addr:value\s*=\s*'([^']+)'", "ipv6": r"ipv6-addr:value\s*=\s*'([^']+)'", "domain": r"domain-name:value\s*=\s*'([^']+)'", "url": r"(?<![a-z])url:value\s*=\s*'([^']+)'",
        "email": r"email-addr:value\s*=\s*'([^']+)'", "md5": r"(?i)hashes\.'?MD5'?\s*=\s*'([0-9a-f]{32})'", "sha1": r"(?i)hashes\.'?SHA-?1'?\s*=\s*'([0-9a-f]{40})'",
        "sha256": r"(?i)hashes\.'?SHA-?256'?\s*=\s*'([0-9a-f]{64})'", "sha512": r"(?i)hashes\.'?SHA-?512'?\s*=\s*'([0-9a-f]{128})'",
    }
    from cairnspark.operators.indicators import normalized

    out = None
    for kind, pattern in comparisons.items():
        one = rows.filter("type = 'indicator'").select(F.lit(kind).alias("type"), F.explode(F.regexp_extract_all("pattern", F.lit(pattern), F.lit(1))).alias("value"))
        one = one.select("type", normalized(kind, F.col("value")).alias("value"))
        out = one if out is None else out.unionByName(one)
    named = F.concat_ws(" ", *[F.col(c) for c in ("name", "description") if c in rows.columns])
    cves = rows.filter(F.col("type").isin("vulnerability", "report")).select(F.lit("cve").alias("type"), F.explode(F.regexp_extract_all(named, F.lit(r"(?i)\bCVE-[0-9]{4}-[0-9]{4,7}\b"), F.lit(0))).alias("value"))
    return out.unionByName(cves.withColumn("value", text.normalize_cve(F.col("value")))).filter("value is not null").distinct()


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("domain")).filter((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()


def alias_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Keys that people declared equal; a damaged file is no aliases. The file is written by hand, so it is small."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m")).collect()
    return {r.key.lower(): r.value.lower() for r in rows if r.key and r.value}
