"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. A shift table over blocks of two words tells how far a search may jump;
where it says zero, the hash of the last block picks a bucket, the hash of the whole window a place in it, and a comparison of
the words themselves confirms. Items are held in arrays, about six times their text, on the driver and in what is broadcast.

Defined results: null or empty texts have no words and are clean; items without words are ignored; repeated rows give one
result each; repeated items with different ids all count; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairnspark.llm.arrowtext import mixed, padded, runs_of, steps, utf8, word_hashes

WINDOW = 10
#: Items are held in blocks of about so many bytes; each block is one pass over the documents, so no broadcast grows with the items.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


class Words:
    """The words of some texts: lower-cased bytes, and where each word starts and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = _LOWER[data]
        self.data = padded(lower)
        self.starts, self.ends = runs_of(_IS_WORD[lower], offsets)
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the end

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return word_hashes(self.data, self.starts[at], self.ends[at])

    def window(self, start: int, size: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[start : start + size], self.ends[start : start + size], strict=True))


class Items:
    """The words of a block of items, in a few arrays, and whose they are."""

    def __init__(self, items: Iterable[tuple[str, str | None]]):
        self.names, texts = [], []
        for name, text in items:
            self.names.append(name)
            texts.append(text)
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        texts.clear()
        self.words = Words(data, offsets)
        self.words.starts, self.words.ends = (x.astype(np.int32 if len(data) < 2**31 else np.int64) for x in (self.words.starts, self.words.ends))
        self.hashes = self.words.hashes(np.arange(len(self.words.starts)))

    def windows(self, window: int) -> dict[int, np.ndarray]:
        """The first words of the items' windows, by the windows' size: an item of fewer words, but not none, is one window."""
        first, count = self.words.first[:-1], np.diff(self.words.first)
        size = np.minimum(count, window)
        out = {}
        for s in np.unique(size[size > 0]):
            own = np.flatnonzero(size == s)
            times = count[own] - s + 1
            out[int(s)] = (np.repeat(first[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
        return out


class WuManber:
    """A search for patterns that all have ``size`` words, given by their first words in the items.

    A pattern's bucket is the hash of its last block; a bucket is ordered by the hash of the whole pattern. Per pattern it
    holds twelve bytes, beside one table of shifts.
    """

    def __init__(self, size: int, items: Items, places: np.ndarray):
        self.size, self.block, self.items = size, min(2, size), items
        column = lambda i: items.hashes[places + i]  # noqa: E731 - one at a time, as all of them would be ten times the text
        self.most = size - self.block + 1
        self.shift = np.full(1 << _TABLE_BITS, self.most, np.uint8 if size < 250 else np.int64)
        for end in range(self.block - 1, size):  # later blocks allow smaller shifts, so they overwrite
            self.shift[self._slot(column(i) for i in range(end - self.block + 1, end + 1))] = size - 1 - end
        key = self._key(self._slot(column(i) for i in range(size - self.block, size)), self._whole(column(i) for i in range(size)))
        order = np.argsort(key, kind="stable").astype(np.int32)
        self.key, self.places = key[order], places[order]
        # patterns of one key mostly are one text: where all of a run are, one comparison is enough
        twin = np.flatnonzero(self.key[1:] == self.key[:-1])
        differ = [k for k in twin.tolist() if items.words.window(int(self.places[k]), size) != items.words.window(int(self.places[k + 1]), size)]
        self.mixed = {int(self.key[k]) for k in differ}
        self.owners: dict[int, list[int]] = {}

    def _whole(self, columns: Iterable[np.ndarray]) -> np.ndarray:
        out = np.uint64(0)
        for c in columns:
            out = out * np.uint64(0x9E3779B97F4A7C15) + c
        return mixed(out)

    def _slot(self, columns: Iterable[np.ndarray]) -> np.ndarray:
        return (self._whole(columns) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _key(self, slot: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (slot.astype(np.uint64) << np.uint64(64 - _TABLE_BITS)) | (whole >> np.uint64(_TABLE_BITS))

    def search(self, words: Words) -> Iterator[tuple[int, list[int]]]:
        """(number of the first word, items) of every occurrence that lies within one text."""
        first, last = words.first[:-1] + self.size - 1, words.first[1:]  # of the places where an occurrence may end
        tiles = np.maximum(0, -(-(last - first) // self.most))
        of = np.repeat(np.arange(len(first)), tiles)
        at = first[of] + self.most * (np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles))
        stop = np.minimum(at + self.most, last[of])
        ends = []
        while len(at):
            shift = self.shift[self._slot([words.hashes(at - i) for i in range(self.block - 1, -1, -1)])].astype(np.int64)
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        starts = np.concatenate(ends or [np.zeros(0, np.int64)]) - self.size + 1
        hashes = [words.hashes(starts + i) for i in range(self.size)]
        key = self._key(self._slot(hashes[-self.block :]), self._whole(hashes))
        left, right = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        own = self.items.words
        for i in np.flatnonzero(right > left):
            found, at = words.window(int(starts[i]), self.size), int(left[i])
            if int(key[i]) in self.mixed:
                same = [p for p in self.places[at : right[i]].tolist() if own.window(p, self.size) == found]
                if same:
                    yield int(starts[i]), self._of(same)
            elif own.window(int(self.places[at]), self.size) == found:
                if at not in self.owners:
                    self.owners[at] = self._of(self.places[at : right[i]])
                yield int(starts[i]), self.owners[at]

    def _of(self, places) -> list[int]:
        """The items of patterns."""
        return np.unique(np.searchsorted(self.items.words.first, places, "right") - 1).tolist()


def matchers(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One search for each length of pattern: windows of ``window`` words, and the whole of shorter items."""
    held = Items(items)
    found = [WuManber(size, held, places) for size, places in sorted(held.windows(window).items())]
    del held.hashes
    return found


def _scan(found: list[WuManber], id_type: pa.DataType):
    schema = pa.schema([("_row", pa.int64()), ("id", id_type), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                words = Words(data, offsets)
                hits, items = [[] for _ in range(part.num_rows)], [set() for _ in range(part.num_rows)]
                for matcher in found:
                    for start, owners in matcher.search(words):
                        k = int(np.searchsorted(words.first, start, "right")) - 1
                        hits[k].append((start - int(words.first[k]), start - int(words.first[k]) + matcher.size))
                        items[k].update(matcher.items.names[o] for o in owners)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(words.first)), pa.array([[{"start": a, "end": b} for a, b in _union(h)] for h in hits], schema.field("hits").type), pa.array([sorted(x) for x in items], schema.field("items").type)],
                    schema=schema,
                )

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id_col, n_words, hits (array of word ranges, end exclusive, apart from each other) and items (ids as strings, sorted).

    Each block of items is a map over the documents, without a shuffle. With more than one block the partial results of a
    row, which hold no text, are put together by one shuffle.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = to_arrow_type(rows.schema["id"].dataType)
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = matchers([(r.item, r.text) for r in own.toLocalIterator()], window)
        shared = spark.sparkContext.broadcast(found)
        one = rows.mapInArrow(lambda it, shared=shared: _scan(shared.value, id_type)(it), f"_row long, id {dict(rows.dtypes)['id']}, n_words long, hits array<struct<start:long,end:long>>, items array<string>")
        out = one if out is None else out.unionByName(one)
    if blocks > 1:
        merged = out.groupBy("_row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = merged.withColumn("hits", disjoint("hits"))
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def disjoint(column: str):
    """Sorted ranges put together where they touch."""
    kind = "array<struct<start:long,end:long>>"
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(
        column, F.array().cast(kind),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(a, F.array(x))),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's ranges and items."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
