"""Best-fit packing with large-item matching.

Pieces above a third of the capacity pair at most twice per bin, each with the largest partner that still fits; smaller pieces
then go to the fullest bin that still takes them, in decreasing length. Pieces of one length are alike, so the plan is made on
the histogram of lengths: it has at most ``capacity`` counts whatever the size of the corpus, and a bounded number of bin
classes. Each piece then finds its place from its length and its number among the pieces of that length.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed each; other columns are not
looked at. Only a document longer than the capacity is cut.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairnspark.llm.arrowtext import give_back, padded, runs_of, steps, word_hashes
from cairnspark.session import cut

CAPACITY = 2048
#: Distinct pieces of text whose ids a Python worker remembers; beyond, it forgets them all and goes on.
REMEMBERED = 800_000
STEP_BYTES = 1 << 20
_LEARNED = 4000
_SLOTS = 1 << 21
_SHIFT = np.uint64(64 - 21)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# bytes that end a letter: small ASCII letters, and after byte C3 the second bytes of letters up to U+00FF (multiplication and division signs are none)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


class WordCache:
    """Token ids of texts by a tokenizer that lower-cases, drops white space and never joins across it.

    Texts are cut at blanks, line ends, and before a full stop or comma that ends a word; the ids of each distinct piece are made
    once and found by its hash in an open-addressed table. What a worker holds is bounded by REMEMBERED pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a worker has one core; threads of its own would each keep an arena of memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.entry = np.zeros(_SLOTS, np.int32)
        self.count, self.used = 0, 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at, slot = np.arange(len(h)), (h >> _SHIFT).astype(np.int64)
        while len(at):
            key = self.keys[slot]
            hit = key == h[at]
            out[at[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            at, slot = at[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h >> _SHIFT).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            own = free & (self.keys[slot] == h)  # of several that found one slot free, the last has it
            self.entry[slot[own]] = entry[own]
            h, entry, slot = h[~own], entry[~own], (slot[~own] + 1) & (_SLOTS - 1)

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        # a few at a time: the tokenizer's own records of a piece are far larger than its ids
        made: list[list[int]] = []
        for a in range(0, len(pieces), _LEARNED):
            made += [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[a : a + _LEARNED]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        total = int(sizes.sum())
        while self.count + len(made) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        new = np.arange(self.count, self.count + len(made))
        self.begin[new], self.length[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        self.count, self.used = self.count + len(made), self.used + total
        self._insert(h, new.astype(np.int32))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        if self.count > REMEMBERED:
            self.clear()
        lower = _LOWER[data]
        space = (lower == 32) | (lower == 10)
        letter = _LETTER[lower]
        letter[1:] |= _SECOND[lower[1:]] & (lower[:-1] == 0xC3)
        # a mark after a letter and before a blank or the end is a piece of its own
        mark = (lower == 46) | (lower == 44)
        mark[1:] &= letter[:-1]
        mark[:-1] &= space[1:]
        mark[offsets[1:][offsets[1:] > 0] - 1] = False
        mark[:1] = False
        cuts = np.union1d(offsets, np.flatnonzero(mark))
        starts, ends = runs_of(~space, cuts)
        # capitals before combining marks compose otherwise than small letters do: such pieces keep their case
        rare = np.flatnonzero(data >= 0xC4)
        for k in np.unique(np.searchsorted(starts, rare, "right") - 1) if len(rare) else ():
            lower[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        h = np.maximum(word_hashes(padded(lower), starts, ends), np.uint64(1))
        entry = self._find(h)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            at = unknown[first]
            self._learn(new, [lower[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)])
            entry[unknown] = self._find(h[unknown])
        size = self.length[entry]
        after = np.cumsum(size)
        ids = self.flat[np.arange(after[-1] if len(after) else 0) + np.repeat(self.begin[entry] - (after - size), size)]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]


_caches: dict[str, WordCache] = {}


def _pieces(path: str, capacity: int, end_id: int, id_type: pa.DataType):
    size, last = 4 * capacity, np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _caches:
            _caches[path] = WordCache(path)
        for batch in batches:
            for part, data, offsets in steps(batch, "text", STEP_BYTES):
                rows: list[list] = [[], [], [], [], []]
                every, first = _caches[path].ids(data, offsets)
                for k in range(part.num_rows):
                    ids = every[first[k] : first[k + 1]].astype("<u4").tobytes() + last
                    for n, a in enumerate(range(0, len(ids), size)):
                        cut_ = ids[a : a + size]
                        for column, value in zip(rows, (k, n, a // 4, len(cut_) // 4, zlib.crc32(cut_)), strict=True):
                            column.append(value)
                ids = part.column("id").take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=["id", "piece", "start", "length", "ids_crc32"])
            give_back()

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32. A map, without a shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    id_type = to_arrow_type(rows.schema["id"].dataType)
    out = rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id, id_type), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (length, first number, count, first sequence, offset): the pieces of that length with these
    numbers go, one each, to consecutive sequences at that offset."""
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, count)

    def put(length: int, count: int, first: int, offset: int) -> None:
        places.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    third = capacity / 3
    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            count = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, count, sequences, 0)
            if mate is not None:
                put(mate, count, sequences, n)
            if gap := capacity - n - (mate or 0):
                gaps[gap].append((sequences, count))
            sequences += count
    for n in sorted((n for n in left if n <= third), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if gap is None:
                count = max(1, left[n] // (capacity // n))
                gaps[capacity].append((sequences, count))
                sequences += count
                gap = capacity
            first, count = gaps[gap].pop()
            each = min(gap // n, left[n])
            bins = min(count, left[n] // each)
            for i in range(each):
                put(n, bins, first, capacity - gap + i * n)
            if count > bins:
                gaps[gap].append((first + bins, count - bins))
            if rest := gap - each * n:
                gaps[rest].append((first, bins))
    return places


def _placed(places: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            own = table[np.searchsorted(keys, length * (1 << 44) + number, "right") - 1]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(own[:, 3] + number - own[:, 1]), pa.array(own[:, 4])], names=[*names, "sequence_id", "offset"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, order_by: tuple[str, ...] = ("doc_id", "piece"), groups: int = 1024) -> DataFrame:
    """The rows of ``items`` (with a column length, from 1 to capacity) with sequence_id and offset.

    Numbers among equal lengths come from a window inside (length, hash group), so a hot length is dealt over all groups, plus
    the counts of the groups before, which are at most capacity x groups rows. The plan alone goes to all executors; it has a
    bounded number of entries.
    """
    group = F.pmod(F.xxhash64(*order_by), F.lit(groups)).cast("int")
    numbered = items.withColumn("_g", group).withColumn("_n", F.row_number().over(Window.partitionBy("length", "_g").orderBy(*order_by)))
    counts = items.groupBy("length", group.alias("_g")).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("length").orderBy("_g")) - F.col("_c")).select("length", "_g", "_before")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_c").alias("n")).collect()}
    shared = items.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    rows = numbered.join(before, ["length", "_g"]).select(*items.columns, (F.col("_before") + F.col("_n") - 1).alias("number"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return rows.mapInArrow(lambda it: _placed(shared.value)(it), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut what is longer than a sequence, and pack. The token counts are written once, to the checkpoint folder:
    numbering and histogram read them, not the texts."""
    return pack(cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)), capacity, (id_col, "piece", "start", "ids_crc32"))
