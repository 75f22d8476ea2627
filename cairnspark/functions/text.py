"""Column functions over text: refanging, normal forms, keys, and small labels. All are built-in expressions but ``nfkc``."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairnspark.functions import fixed

_DOT = r"(?i)\[\s*(?:\.|dot)\s*\]|\(\s*(?:\.|dot)\s*\)|\{\s*\.\s*\}"
_AT = r"(?i)\[\s*(?:@|at)\s*\]|\(\s*(?:@|at)\s*\)"


def refang(text: Column) -> Column:
    """Undo defanging: schemes, separators, dots and at signs."""
    for pattern, with_ in ((r"\[://\]", "://"), (r"\[\s*:\s*\]|\(\s*:\s*\)", ":"), (_DOT, "."), (_AT, "@"), (r"(?i)\bhxxp(s?)://", "http$1://"), (r"(?i)\bfxp://", "ftp://")):
        text = F.regexp_replace(text, pattern, with_)
    return text


def defang(value: Column, kind: Column | None = None) -> Column:
    """A form that no client turns into a link; only for kinds that hold host names or addresses."""
    out = F.regexp_replace(F.regexp_replace(value, r"(?i)http(s?)://", "hxxp$1://"), r"(?i)ftp://", "fxp://")
    out = F.replace(F.replace(out, F.lit("@"), F.lit("[at]")), F.lit("."), F.lit("[.]"))
    return out if kind is None else F.when(kind.isNull() | kind.isin("ipv4", "domain", "url", "email"), out).otherwise(value)


def normalize_domain(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"\.+$", "")


def normalize_hash(value: Column) -> Column:
    return F.lower(F.trim(value))


normalize_email = normalize_hash


def normalize_cve(value: Column) -> Column:
    return F.upper(F.trim(value))


def normalize_ipv4(value: Column) -> Column:
    """The address, or null where an octet is over 255 or has a leading zero."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    value = F.trim(value)
    return F.when(value.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), value)


def normalize_url(value: Column) -> Column:
    """Scheme and authority in small letters, closing punctuation gone; null without either."""
    cleaned = F.regexp_replace(F.trim(value), r"""[.,;)"']+$""", "")
    part = lambda n: F.regexp_extract(cleaned, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)(.*)$", n)
    return F.when((part(1) != "") & (part(2) != ""), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3)))


def url_host(url: Column) -> Column:
    """Authority of a url, port and user included, in small letters."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def registrable(domain: Column) -> Column:
    """The last two labels."""
    labels = F.split(domain, r"\.")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(domain)


def parents(domain: Column) -> Column:
    """A domain and its parents down to two labels."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def ipv4_number(value: Column) -> Column:
    octets = F.split(value, r"\.")
    return sum(F.get(octets, F.lit(i)).cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4))


def ipv4_kinds(value: Column) -> dict[str, Column]:
    """Whether an address lies in a range of each kind."""
    number = ipv4_number(value)
    as_int = lambda a: sum(int(x) * 256 ** (3 - i) for i, x in enumerate(a.split(".")))
    out: dict[str, Column] = {}
    for kind, first, last in fixed.IPV4_RANGES:
        inside = number.between(as_int(first), as_int(last))
        out[kind] = inside if kind not in out else out[kind] | inside
    return out


def ordered_flags(conditions: Mapping[str, Column]) -> Column:
    """Names of the flags whose condition holds, in the fixed order."""
    return F.filter(F.array(*[F.when(conditions[f], F.lit(f)) for f in fixed.FLAGS if f in conditions]), lambda x: x.isNotNull())


def ipv4_flags(value: Column) -> dict[str, Column]:
    kinds = ipv4_kinds(value)
    return {
        "private_ip": kinds["private"] & ~kinds["loopback"] & ~kinds["documentation"],
        "loopback": kinds["loopback"],
        "reserved_ip": kinds["reserved"],
        "documentation_ip": kinds["documentation"],
    }


def filename_like(domain: Column) -> Column:
    labels = F.split(domain, r"\.")
    return (F.size(labels) == 2) & F.element_at(labels, -1).isin(*fixed.FILENAME_TLDS)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form, which has no built-in expression."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def grounding_form(text: Column, unicode: bool = True) -> Column:
    """The form in which a quote is looked for in its source: punctuation unified, broken words joined, spaces collapsed, small
    letters. With ``unicode`` off no Python runs; the result is the same for text in compatibility form."""
    out = nfkc(text) if unicode else text
    out = F.replace(out, F.lit("­"), F.lit(""))
    single = {k: v for k, v in fixed.PUNCTUATION.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.regexp_replace(out, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return F.lower(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def strip_unsafe(text: Column) -> Column:
    """Markup and markdown gone, link texts kept."""
    for pattern, with_ in ((r"!\[[^\]]{0,200}\]\([^)]{0,500}\)", ""), (r"\[([^\]]{0,200})\]\([^)]{0,500}\)", "$1"), (r"<[^>]{0,200}>", ""), ("­", ""), (r"(?U)\s+", " ")):
        text = F.regexp_replace(text, pattern, with_)
    return F.trim(text)


def residual_markup(text: Column) -> Column:
    return text.rlike(r"<[a-zA-Z/!]|!\[[^\]]*\]\(|\]\(https?://")


def bad_name(name: Column) -> Column:
    """Why a name cannot be one, or null."""
    return (
        F.when(name.rlike(r"[\r\n]"), "name contains a line break")
        .when(F.length(name) > fixed.MAX_NAME, f"name longer than {fixed.MAX_NAME} characters")
        .when(name.rlike(r"(?i)https?://|hxxps?://|\bwww\."), "name contains a URL")
    )


def injection_name(text: Column, severity: str = "high") -> Column:
    """Name of the first pattern of a severity that a text carries, or null."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + pattern), F.lit(name)) for level, name, pattern in fixed.INJECTION_PATTERNS if level == severity])


def normalize_key(kind: Column, name: Column, ioc_type: Column | None = None, aliases: Mapping[str, str] | None = None, unicode: bool = False) -> Column:
    """The key that makes two mentions one node. ``aliases`` maps keys that people declared equal; it is a literal of the plan."""
    text = F.lower(F.trim(F.regexp_replace(nfkc(name) if unicode else name, r"(?U)\s+", " ")))
    cve, technique, actor = r"(?i)CVE[\s\-_]?(\d{4})[\s\-_]?(\d{4,7})", r"(?i)\bT(\d{4})(?:[.\s]?(\d{3}))?\b", rf"^({'|'.join(fixed.ACTOR_PREFIXES)})[\s\-_.]*0*(\d+)$"
    plain = F.trim(F.regexp_replace(text, r"(?U)[\s\-_.]+", " "))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in (pair[0].lower(), pair[1].lower())])
        plain = F.coalesce(F.try_element_at(table, plain), plain)
    part = lambda p, n, t=name: F.regexp_extract(t, p, n)
    return (
        F.when(text == "", "")
        .when(kind == "indicator", F.concat(F.coalesce(ioc_type, F.lit("unknown")) if ioc_type is not None else F.lit("unknown"), F.lit("--"), text))
        .when((kind == "vulnerability") & name.rlike(cve), F.concat(F.lit("cve-"), part(cve, 1), F.lit("-"), part(cve, 2)))
        .when((kind == "attack-pattern") & name.rlike(technique), F.concat(F.lit("t"), part(technique, 1), F.when(part(technique, 2) != "", F.concat(F.lit("."), part(technique, 2))).otherwise("")))
        .when((kind == "threat-actor") & text.rlike(actor), F.concat(part(actor, 1, text), F.regexp_replace(part(actor, 2, text), r"^0+(?=\d)", "")))
        .otherwise(plain)
    )


def node_id(kind: Column, key: Column) -> Column:
    return F.concat(kind, F.lit("--"), key)


def report_node_id(sha256: Column) -> Column:
    return F.concat(F.lit("report--"), F.substring(sha256, 1, 12))


def family(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("observable"))


def filter_key(kind: Column, ioc_type: Column) -> Column:
    return F.when(kind == "indicator", F.concat(F.lit("indicator:"), F.coalesce(F.nullif(ioc_type, F.lit("")), F.lit("unknown")))).otherwise(F.coalesce(kind, F.lit("")))


def filter_label(key: Column) -> Column:
    return F.when(key.startswith("indicator:"), F.concat(F.lit("indicator · "), F.regexp_extract(key, r"^indicator:(?s)(.*)$", 1))).otherwise(key)


def node_size(degree: Column, most: Column, selected: Column) -> Column:
    scaled = F.floor(F.lit(11) + F.sqrt(degree / most) * F.lit(23)).cast("int")
    return F.when(selected, F.lit(40)).when(most <= 1, F.lit(11)).otherwise(scaled)


def format_pages(pages: Column) -> Column:
    return F.when(F.size(pages) == 0, "table").otherwise(F.array_join(pages.cast("array<string>"), ", "))


def flag_label(flag: Column) -> Column:
    return F.replace(flag, F.lit("_"), F.lit(" "))


def truncate_words(text: Column, limit: int = fixed.SUMMARY_WORDS) -> Column:
    words = F.split(F.trim(text), r"(?U)\s+")
    return F.when(F.size(words) <= limit, text).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit("…")))


def evidence_hash(evidence: Column, descriptions: Column) -> Column:
    """What a summary was written from: a short digest of descriptions, then quotes, each closed by a zero byte."""
    parts = F.transform(F.concat(descriptions, evidence), lambda x: F.concat(x, F.lit("\x00")))
    return F.substring(F.sha2(F.array_join(parts, ""), 256), 1, 16)


def safe_name(filename: Column, sha256: Column) -> Column:
    stem = F.substring(F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", ""), 1, 50)
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "-"), r"^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("report")), F.lit("_"), F.substring(sha256, 1, 12))


def clean_description(text: Column, limit: int = 400) -> Column:
    """Technique descriptions without citations, links and backticks."""
    for pattern, with_ in ((r"\(Citation:[^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("`+", ""), (r"(?U)\s+", " ")):
        text = F.regexp_replace(text, pattern, with_)
    return F.substring(F.trim(text), 1, limit)


def neutralize_delimiters(text: Column) -> Column:
    """Break what looks like the report tags that frame untrusted text."""
    return F.regexp_replace(text, r"(?i)<(\s*/?\s*report)", "‹$1")


def framed_report(text: Column, nonce: Column) -> Column:
    return F.concat(F.lit("<report-"), nonce, F.lit(">\n"), neutralize_delimiters(text), F.lit("\n</report-"), nonce, F.lit(">"))


def screened_tool_result(text: Column, nonce: Column) -> Column:
    """A tool's result between nonce tags; a body with a high finding is withheld."""
    body = F.when(injection_name(text).isNotNull(), F.lit("[result withheld: suspicious content detected]")).otherwise(text)
    return F.concat(F.lit("<tool-result-"), nonce, F.lit(">\n"), body, F.lit("\n</tool-result-"), nonce, F.lit(">"))


def technique_summary(id_: Column, name: Column, tactics: Column, description: Column) -> Column:
    listed = F.when(F.size(tactics) > 0, F.array_join(tactics, ", ")).otherwise("unknown tactic")
    return F.concat(id_, F.lit(" — "), name, F.lit(" (tactics: "), listed, F.lit(")\n"), description)


def day_key(moment: Column, zone: str = "America/Toronto") -> Column:
    """Calendar day of a UTC moment in a zone."""
    return F.to_date(F.from_utc_timestamp(moment, zone))


def iso_seconds(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def cache_key(sha256: Column, model: Column, prompt_version: Column) -> Column:
    return F.concat_ws("_", sha256, model, prompt_version)


def canonical_model(model: Column) -> Column:
    return F.regexp_replace(F.trim(model), r"-\d{8}$", "")


def format_cost(cost: Column) -> Column:
    return F.when(cost == 0, "$0.00").when(cost < 0.01, F.concat(F.lit("$"), F.format_string("%.4f", cost))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", cost)))
