"""Bounded samples of labelled rows for fitting, and held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text to fit on, at most.
FIT_BYTES = 96 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = FIT_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of usable labelled rows, the first by a hash of the id: at most ``most`` rows, and whole texts of at most
    ``most_bytes`` bytes in all. That bounds what is sent to the driver and what is broadcast; a null label is no label, and of
    several labels of one id the largest holds."""
    ids = labels.filter(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    place = F.xxhash64(F.col(id_col).cast("string"))
    chosen = ids.orderBy(place, id_col).limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id")
    # of the chosen rows only, so this one task has a set size
    order = Window.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(F.octet_length("_t").cast("long")).over(order)).filter(F.col("_sum") <= most_bytes)
    rows = rows.limit(most).select("_t", "_y").toArrow()
    return rows.column("_t").to_pylist(), rows.column("_y").to_pylist()
