"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong kinds (assign, access, hex) are reported wherever they match. Weak kinds (ident, weak, endpoint) are parts of a
credential: each is reported only if a complementary part starts within the same scope, found by a sliding interval join.

Defined results: a null or empty text has no spans; repeated rows give one result each; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.rowkeys import fresh
from cairnspark.session import cut


def either_case(words: str) -> str:
    """The pattern with each letter in either case, as classes: no engine then folds letters outside ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Fixed values: (kind, pattern, least characters, which group they count). The first three are the strong kinds, in listed order.
KINDS = (
    ("assign", "(" + either_case("password|passwd|secret|token|api_?key") + ")" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("ident", "(" + either_case("username|user|login|client_?id|account") + ")" + _VALUE + r"([A-Za-z0-9@._-]+)", 3, 2),
    ("weak", "(" + either_case("passphrase|pwd|credential|private_?key|auth") + ")" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("endpoint", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9.-]+", 8, 0),
)
STRONG = 3
#: Code points between the starts of parts that can belong to one credential.
SCOPE = 200


def _matches(text: Column, index: int) -> Column:
    """Every leftmost match of a kind as (kind, gap before it, length, good), in text order; lengths only, no text."""
    _, pattern, least, group = KINDS[index]
    regex = F.lit(pattern)
    good = (lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= least) if group else (lambda m: F.length(m) >= least)
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda gap, m: F.struct(F.lit(index).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("len"), good(m).alias("good")),
    )
    empty = F.array().cast("array<struct<kind:int,gap:int,len:int,good:boolean>>")
    return F.when(text.rlike(pattern), F.filter(pairs, lambda x: x["len"].isNotNull())).otherwise(empty)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: id_col, and spans array<struct<start, kind, end, name>> in code points, ordered by start, then kind.

    One shuffle, of match lengths only: texts stay where they are read. Rows are keyed one by one, so that a hot source or
    a repeated id never meets in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.concat(*[_matches(text, i) for i in range(len(KINDS))]).alias("_all"),
    ).select("_row", "_id", F.posexplode_outer("_all").alias("_pos", "_m"))
    parts = found.select("_row", "_id", "_pos", "_m.*").repartition("_row")
    own = Window.partitionBy("_row", "kind").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(own))
    placed = placed.withColumn("start", F.col("end") - F.col("len")).withColumn("kind", F.when(F.col("good"), F.col("kind")))
    by_start = Window.partitionBy("_row").orderBy("start")
    strong_end = F.when(F.col("kind") < STRONG, F.col("end"))
    strong_start = F.when(F.col("kind") < STRONG, F.col("start"))
    # a weak part inside or across a strong span adds nothing
    covered = (F.coalesce(F.max(strong_end).over(by_start.rangeBetween(Window.unboundedPreceding, 0)), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(strong_start).over(by_start.rangeBetween(0, Window.unboundedFollowing)), F.col("end")) < F.col("end")
    )
    placed = placed.withColumn("free", (F.col("kind") >= STRONG) & ~covered)
    usable = F.when((F.col("kind") < STRONG) | F.col("free"), F.col("kind"))
    near = by_start.rangeBetween(-scope, scope)
    has = lambda *kinds: F.coalesce(F.max(usable.isin(*kinds)).over(near), F.lit(False))
    secret, ident, endpoint = has(0, 2, 4), has(1, 3), has(5)
    linked = F.when(F.col("kind") == 4, ident | endpoint).when(F.col("kind").isin(3, 5), secret)
    placed = placed.withColumn("keep", (F.col("kind") < STRONG) | (F.col("free") & linked))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    span = F.struct("start", "kind", "end", F.get(names, F.col("kind")).alias("name"))
    return placed.groupBy("_row").agg(F.first("_id").alias(id_col), F.sort_array(F.collect_list(F.when(F.col("keep"), span))).alias("spans")).drop("_row")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's spans."""
    line = lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] < STRONG), line), ",")
    return scanned.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """The rows with each reported span replaced by ``mask``. Rows get the spans of their text, one to one, whatever their ids; the join
    shuffles texts once."""
    key, held = fresh(docs, "_text_key"), fresh(docs, "_text_spans")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(text_col, F.lit("")), 256))
    # written first, so that the join reads two plain shuffles and a text that many rows share can be divided among tasks
    spans = cut(scan_secrets(keyed, key, text_col).filter(F.size("spans") > 0).groupBy(key).agg(F.first("spans").alias(held)))
    joined = keyed.join(spans, key, "left")
    text = F.col(text_col)
    # spans of different kinds may overlap: a gap is kept only where it starts beyond everything masked so far
    cuts = F.aggregate(
        held,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text))),
    )
    return joined.withColumn(text_col, F.when(F.col(held).isNull(), text).otherwise(cuts)).select(*docs.columns)
