"""Main text of web pages: nearest-URL page differencing of every page, then element roles.

Differencing pairs each page with the page of nearest URL path on its host, aligns their text lines by longest common
subsequence, and deletes the shared lines. It cannot stand alone where menus and adverts differ from page to page, or where two
pages carry one article; so elements that say what they are check its result line by line: lines inside an article or main element
are given back if they were deleted, and lines of boilerplate elements go if they were not. What remains of a page without an
article or main element is what differencing left of it.

Defined results: a null or empty page has an empty text; a page whose end is missing is read to where it stops; a page without a
partner, or without a url or id, shares no lines; repeated rows give one result each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.session import cut

#: Pages that one task puts in order, about; only their urls and ids.
TOGETHER = 200_000
#: Cells of one table of an alignment.
CELLS = 4_000_000
#: What a line's elements say of it: boilerplate, nothing, or that an article or main element holds it.
ASIDE, OPEN, INSIDE = 0, 1, 2

# What elements, and names of classes and ids, hold besides the main text.
_DROP = frozenset("script style noscript template head title nav aside footer form svg iframe object select button textarea canvas audio video dialog menu".split())
_RAW = frozenset("script style noscript template textarea title svg iframe".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sidebar side-bar menu nav navbar navigation footer header masthead comment comments respond cookie cookies consent notice notices promo "
    "sponsored sponsor share sharing social related breadcrumb breadcrumbs newsletter subscribe popup modal widget toolbar pagination disqus skip-link".split()
)
# names that tell as well as the first part of a hyphenated one
_FIRST = frozenset("ad ads advert advertisement sidebar nav navbar comment comments cookie newsletter promo sponsored related breadcrumb breadcrumbs share social".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_BLOCKS = frozenset("address article blockquote body center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_MAIN = frozenset(("article", "main"))
# elements whose next of the same kind ends them
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _is_aside(name: str, attributes: str) -> bool:
    if name in _DROP:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and any(x in _NAMES or x.partition("-")[0] in _FIRST for x in re.split(r"[\s_]+", value)):
            return name not in _MAIN
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """All text lines of a page in order, each with what its elements say of it; scripts, styles and their like hold no text."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    at, main, skip, depth, mute = 0, 0, "", 0, ""

    def flush(role: int) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((text, role))

    while (token := _TOKEN.search(page, at)) is not None:
        if not mute and token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        closing, name, attributes = token.group(1), token.group(2), token.group(3)
        if name is None:
            continue
        name = name.lower()
        if skip:
            if mute:
                mute = "" if closing and name == mute else mute
            elif not closing and name in _RAW and not attributes.rstrip().endswith("/"):
                mute = name
            if name in _BLOCKS or name == skip:
                flush(ASIDE)
            elif name == "br":
                parts.append(" ")
            if name == skip and name not in _VOID:
                depth += -1 if closing else not attributes.rstrip().endswith("/")
                if not depth:
                    flush(ASIDE)
                    skip = mute = ""
            elif closing and name in _MAIN and name != skip and main:  # an aside left open ends with its article
                skip = mute = ""
                main -= 1
            continue
        if not closing and (_is_aside(name, attributes) or name == "header" and not main):
            flush(INSIDE if main else OPEN)
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name not in _VOID:
                skip, depth = name, 1
            continue
        if name == "br":
            parts.append(" ")
        elif name in _BLOCKS:
            flush(INSIDE if main else OPEN)
            if name in _MAIN:
                main = max(0, main - 1) if closing else main + 1
    if not mute and at < len(page):
        rest = page[at:]
        parts.append(rest if not re.match(r"</?[A-Za-z!]", rest) else "")
    flush(ASIDE if skip else INSIDE if main else OPEN)
    return lines


def blocks(page: str) -> tuple[list[str], bool]:
    """The text lines of a page that are not boilerplate by their elements, and whether an article or main element holds them."""
    lines = page_lines(page)
    inside = [t for t, role in lines if role == INSIDE]
    return (inside, True) if inside else ([t for t, role in lines if role == OPEN], False)


def digests(lines: list[tuple[str, int]]) -> bytes:
    """Eight bytes a line: all that an alignment asks of the other page's lines is which are equal."""
    return b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t, _ in lines)


def shared(own: list[str], other: list[str]) -> list[bool]:
    """Which lines of ``own`` are in the longest common subsequence with ``other``; of equal choices the earliest lines, page by page where
    the pages are not too long for one table."""
    keys: dict[str, int] = {}
    a = np.array([keys.setdefault(x, len(keys)) for x in own], np.int64)
    b = np.array([keys.setdefault(x, len(keys)) for x in other], np.int64)
    out = np.zeros(len(a), bool)
    # a line that the other page lacks is in no common subsequence
    i, b = np.flatnonzero(np.isin(a, b)), b[np.isin(b, a)]
    a, short = a[i], min(len(i), len(b))
    # equal beginnings, of a twin all, need no table
    n = next(iter(np.flatnonzero(a[:short] != b[:short])), short)
    out[i[:n]] = True
    _common_lines(a[n:], b[n:], i[n:], out)
    return out.tolist()


def _common_lines(a: np.ndarray, b: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
    """Marks the places of a longest common subsequence. Beyond CELLS the first half of ``a`` and what fits it best of ``b`` go apart
    from the rest, so memory stays in proportion to the lines."""
    if not len(a) or not len(b):
        return
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        fit = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        _common_lines(a[:half], b[:fit], place[:half], out)
        _common_lines(a[half:], b[fit:], place[half:], out)
        return
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        best[i, :-1] = np.where(b == a[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i] = np.maximum.accumulate(best[i][::-1])[::-1]
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out[place[i]] = True
            i, j = i + 1, j + 1
        elif best[i, j] == best[i, j + 1]:
            j += 1
        else:
            i += 1


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``, one row at a time."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


def main_text(lines: list[tuple[str, int]], other: bytes | None) -> str:
    """Lines of a page less those shared with ``other``, the digests of its partner's lines; then checked by their roles."""
    same = shared(np.frombuffer(digests(lines), np.int64).tolist(), np.frombuffer(other, np.int64).tolist()) if other else [False] * len(lines)
    left = [(t, role) for (t, role), s in zip(lines, same, strict=True) if role == INSIDE or not s and role != ASIDE]
    if not left:  # a twin is no template
        left = [(t, role) for t, role in lines if role != ASIDE]
    best = max((role for _, role in left), default=OPEN)
    return "\n".join(t for t, role in left if role == best)


def extract(page: str | None, partner: str | None) -> str:
    return main_text(page_lines(page or ""), digests(page_lines(partner)) if partner else None)


def _common(a: Column, b: Column) -> Column:
    """Characters that the beginnings of two paths share; -1 where the other is missing."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(b.isNull(), F.lit(-1)).when(at == 0, F.size(same)).otherwise(at - 1)


def partners(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, partner): of the pages before and after in the order of path and id on a host, the one whose path shares the longer
    beginning, and of equal ones the one before. Only urls are read.

    The order goes over all hosts and is dealt by range, about TOGETHER pages a task; each range also gets the border rows of the
    ranges beside it, so that where it is cut changes nothing.
    """
    url = pages.filter(F.col(id_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"))
    ranges = max(1, -(-url.count() // TOGETHER))
    # written once, so that the ranges are the same for every reader
    rows = cut(url.distinct().repartitionByRange(ranges, "host", "path", "id").withColumn("_p", F.spark_partition_id()))
    page = F.struct("host", "path", "id")
    borders = rows.groupBy("_p").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    ends = Window.orderBy("_p")  # one row a range
    borders = borders.select("_p", F.lag("last").over(ends).alias("_before"), F.lead("first").over(ends).alias("_after"))
    own = Window.partitionBy("_p").orderBy("host", "path", "id")
    found = rows.withColumn("_l", F.lag(page).over(own)).withColumn("_r", F.lead(page).over(own)).join(F.broadcast(borders), "_p")
    for side, border in (("_l", "_before"), ("_r", "_after")):
        near = F.coalesce(side, border)
        found = found.withColumn(side, F.when((near["host"] == F.col("host")) & (near["id"] != F.col("id")), near))
    left, right = (_common(F.col("path"), F.col(side)["path"]) for side in ("_l", "_r"))
    found = found.withColumn("partner", F.when(right > left, F.col("_r")["id"]).otherwise(F.col("_l")["id"]))
    return found.filter(F.col("partner").isNotNull()).select("id", "partner")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [digests(page_lines(x or "")) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("partner"), pa.array(found, pa.binary())], names=["partner", "other"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, other = batch.column("html").to_pylist(), batch.column("other").to_pylist()
        texts = [main_text(page_lines(a or ""), b) for a, b in zip(page, other, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars. Every page is aligned with its partner; of that only digests travel."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["id"]
    lines = rows.filter("id is not null").select(F.col("id").alias("partner"), "html").mapInArrow(_digested, f"partner {kind}, other binary")
    others = partners(pages, id_col, url_col).join(lines, "partner").groupBy("id").agg(F.min("other").alias("other"))
    # the digests of a share of the pages are held, the pages are not sorted
    paired = rows.filter("id is not null").join(others.hint("shuffle_hash"), "id", "left").select("id", "url", "html", "other")
    alone = rows.filter("id is null").withColumn("other", F.lit(None).cast("binary"))
    out = paired.unionByName(alone).mapInArrow(_extracted, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
