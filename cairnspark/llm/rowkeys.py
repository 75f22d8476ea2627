"""Keys that tell rows apart without a number written beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, id, own, text): id and own, a hash of the text, tell rows apart; rows that agree in both have one text. Keys are
    functions of the row, so they are the same whenever the table is read; ids may repeat, be null and have any type that casts
    to a string."""
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    doc, text = F.col(id_col), F.col(text_col)
    key = F.coalesce(doc.cast("long") if whole else F.xxhash64(doc.cast("string")), F.lit(-1).cast("long"))
    return docs.select(doc.alias("doc"), key.alias("id"), F.xxhash64(text, doc.isNull()).alias("own"), text.alias("text"))


def fresh(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, in whatever case."""
    taken = {c.lower() for c in frame.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem
