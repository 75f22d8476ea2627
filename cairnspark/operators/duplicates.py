"""Names of one type that look alike, for people to judge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    open_ = (1 << len(a)) - 1
    whole = open_
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths."""
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def name_score(a: str, b: str) -> float:
    """The better of comparing sorted words, and comparing shared words with either name's words."""
    x, y = a.lower().split(), b.lower().split()
    best = ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    left, right = set(x), set(y)
    both = " ".join(sorted(left & right))
    if not left or not right:
        return best
    if both and (left <= right or right <= left):
        return 100.0
    one, two = (" ".join(sorted(s)) for s in (left - right, right - left))
    with_ = lambda rest: f"{both} {rest}".strip()
    best = max(best, ratio(with_(one), with_(two)))
    return max(best, ratio(both, with_(one)), ratio(both, with_(two))) if both else best


def shared_run(threshold: float) -> int:
    """Letters in a row that two different texts of a ratio of ``threshold`` have in common at least. Of s letters in both, d
    are in no common subsequence, and cut the other (s - d) / 2 into d + 1 runs at most."""
    return min(-(-(s - d) // (2 * (d + 1))) for s in range(1, 400) for d in range(2 - s % 2, int(s * (1 - threshold / 100) + 1e-9) + 1, 2)) if threshold < 99.5 else 1


def possible_duplicates(nodes: DataFrame, threshold: float = 90, limit: int = 100, exhaustive: bool = False) -> DataFrame:
    """(left_id, right_id, score), best first. Pairs share a type, and a word or, without one, as many letters in a row of their sorted
    words as no pair at the threshold can lack; ``exhaustive`` compares all pairs of a type instead."""
    named = nodes.filter("type not in ('report', 'indicator') and name is not null and name <> ''").select("node_id", "type", "name")
    run_length = shared_run(threshold)
    if exhaustive or run_length < 1:
        keyed = named.withColumn("_k", F.lit(""))
    else:
        words = F.split(F.lower(F.trim("name")), r"(?U)\s+")
        keyed = named.withColumn("_w", words).withColumn("_s", F.array_join(F.array_sort("_w"), " "))
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_s") - (run_length - 1), F.lit(1))), lambda i: F.concat(F.lit("^"), F.col("_s").substr(i, F.lit(run_length))))
        keyed = keyed.withColumn("_k", F.explode(F.array_distinct(F.concat(F.transform("_w", lambda w: F.concat(F.lit("="), w)), runs))))
    left, right = (keyed.select("type", "_k", F.col("node_id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name")) for s in ("left", "right"))
    pairs = left.join(right, ["type", "_k"]).filter("left_id < right_id").select("left_id", "right_id", "left_name", "right_name").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["score"] = [name_score(a, b) for a, b in zip(frame.left_name, frame.right_name, strict=True)]
            yield frame[frame.score >= threshold][["left_id", "right_id", "score"]]

    return pairs.mapInPandas(run, "left_id string, right_id string, score double").orderBy(F.desc("score"), "left_id", "right_id").limit(limit)
