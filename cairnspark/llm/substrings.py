"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only repeats of ``depth`` bytes matter, so suffixes are ordered through their first ``depth`` bytes only, by passes over digits
from the most significant on; groups that are still together after the last digit are exactly the repeated windows, and a suffix
alone in its group leaves the sort at once.

The first pass is dealt over the cluster. Its digit is the window's anchor: the least, by hash, of the ``GRAM``-byte strings in
it, the leftmost of equals. It depends on the window alone, so equal windows meet; neighbouring windows mostly share an anchor
and travel as one block. A block whose anchor occurs nowhere else is done. A block that occurs again as a whole is repeated as a
whole. The others, one of each, go through the digits of eight bytes in memory.

Most anchors occur once, so blocks are made twice: first only four bytes of each anchor are exchanged, from which a bitmap of bounded
size tells which anchors may occur again; then only blocks that the bitmap lets through become rows. The bitmap misses no anchor that
occurs again. One that it lets through for nothing meets no other block and is found alone by the exact counts that follow: a smaller
bitmap costs rows, not results. Whole texts are exchanged once, for both joins that read them.

Defined results: matches stay inside texts; null or empty texts, and texts shorter than ``depth``, keep everything; overlapping
and self-overlapping repeats count; rows repeated whole are repeats of each other. Rows are told apart by id and text, so ids may
repeat, be null and have any type that casts to a string; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.arrowtext import give_back, mixed, steps
from cairnspark.llm.rowkeys import keyed
from cairnspark.session import written

DEPTH = 200
GRAM = 100
#: Anchors of more distinct blocks than this are refined window by window over the cluster, not in one task.
HOT_BLOCKS = 3_000
#: Suffixes that one radix sort holds, about; a group is never divided.
SORT_SUFFIXES = 400_000
#: The bitmap of anchors that occur again has 2 ** PART_BITS parts, at least SEEN_EACH bits for each such anchor, and 64 MB at most.
PART_BITS, SEEN_EACH, SEEN_BITS = 8, 16, 29
_PLACE = np.uint64((1 << 28) - 1)
_R = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = 1 << max(21, (n - 1).bit_length())
        for key, base in (("p", _R), ("q", pow(_R, -1, 1 << 64))):
            steps_ = np.full(size, base, np.uint64)
            steps_[0] = 1
            _POWERS[key] = np.cumprod(steps_, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def _rest() -> None:
    """At a task's end: its worker waits, and counts with the executor."""
    _POWERS.clear()
    give_back()


def blocks(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Blocks of windows with one anchor: text number, first window, windows, windows of one block, anchor hash, block hash,
    whether the block repeats at once. Equal blocks in a row, as in a periodic text, are one."""
    if len(data) < depth or not (np.diff(offsets) >= depth).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z, np.zeros(0, bool)
    n = len(data)
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * power[:n], out=total[1:])
    grams = n - gram + 1
    h = (total[gram:] - total[:grams]) * inverse[:grams]
    h = mixed(h)
    least = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    wide, span = depth - gram + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    anchor = (least & _PLACE).astype(np.int64)  # of the window that starts here
    length = np.diff(offsets)
    long_enough = length >= depth
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, offsets[:-1][long_enough], 1)
    np.add.at(edge, offsets[1:][long_enough] - depth + 1, -1)
    valid = np.cumsum(edge[: len(anchor)], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    before = np.concatenate([[0], np.cumsum(valid)])
    count = np.diff(np.concatenate([before[start], [before[-1]]]))
    text = np.searchsorted(offsets, start, "right") - 1
    end = start + count + depth - 1
    own = mixed((total[end] - total[start]) * inverse[start] + mixed(count.astype(np.uint64)))
    ah = h[anchor[start]]
    again = np.zeros(len(start), bool)
    again[1:] = (own[1:] == own[:-1]) & (ah[1:] == ah[:-1]) & (text[1:] == text[:-1])
    head = np.flatnonzero(~again)
    each = np.diff(np.concatenate([head, [len(start)]]))
    return text[head], start[head] - offsets[text[head]], np.add.reduceat(count, head), count[head], ah[head].astype(np.int64), own[head].astype(np.int64), each > 1


def _seen(depth: int, gram: int, part_bits: int):
    """The anchors of some texts, as four bytes of their hashes in each part of the bitmap; of equal ones, two at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in steps(batch, "text"):
                *_, anchor, _, again = blocks(data, offsets, depth, gram)
                place = mixed(np.concatenate([anchor, anchor[again]]).view(np.uint64)) >> np.uint64(32 - part_bits)
                place.sort()
                third = np.zeros(len(place), bool)
                third[2:] = place[2:] == place[:-2]
                place = place[~third]
                part, first = np.unique(place >> np.uint64(32), return_index=True)
                each = np.split(place.astype(np.uint32), first[1:]) if len(part) else []
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in each], pa.binary())], names=["part", "seen"])
        _rest()

    return run


def _twice(each: int, most: int):
    """One part of the bitmap: the places of anchors that were seen twice, in a power of two of bits."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        seen = np.frombuffer(b"".join(table.column("seen").to_pylist()), np.uint32).copy()
        seen.sort()
        again = np.unique(seen[1:][seen[1:] == seen[:-1]])
        bits = min(max(3, (len(again) * each).bit_length()), most)
        marks = np.zeros(1 << bits, bool)
        marks[again >> np.uint32(32 - bits)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    return run


def _blocks(depth: int, gram: int, part_bits: int, shared: Broadcast[tuple[bytes, list[int]]]):
    """Rows of the blocks whose anchors may occur again, by the bitmap and the bytes of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, sizes = np.frombuffer(shared.value[0], np.uint8), np.array(shared.value[1], np.uint64) * np.uint64(8)
        begin, shift = np.cumsum(sizes) - sizes, np.uint64(32) - np.log2(sizes).astype(np.uint64)
        for batch in batches:
            for texts, data, offsets in steps(batch, "text"):
                found = blocks(data, offsets, depth, gram)
                place = mixed(found[4].view(np.uint64)) >> np.uint64(32 - part_bits)
                part = (place >> np.uint64(32)).astype(np.int64)
                at = begin[part] + ((place & np.uint64(0xFFFFFFFF)) >> shift[part])
                may = (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                text, first, windows, one, anchor, block, again = (x[may] for x in found)
                yield pa.RecordBatch.from_arrays(
                    [texts.column("id").take(pa.array(text)), texts.column("own").take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(one.astype(np.int32)), pa.array(anchor), pa.array(block), pa.array(again)],
                    names=["id", "own", "first", "windows", "one", "anchor", "block", "again"],
                )
        _rest()

    return run


def _met(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """Blocks (id, own, first, windows, one, anchor, block, again) of every anchor that occurs again, and a few of others."""
    texts = texts.select("id", "own", "text").filter(F.octet_length("text") >= depth)
    parts = texts.select("text").mapInArrow(_seen(depth, gram, PART_BITS), "part int, seen binary").groupBy("part").applyInArrow(_twice(SEEN_EACH, SEEN_BITS - PART_BITS), "part int, marks binary")
    made = {r.part: bytes(r.marks) for r in parts.collect()}
    marks = [made.get(k, b"\0") for k in range(1 << PART_BITS)]
    shared = texts.sparkSession.sparkContext.broadcast((b"".join(marks), [len(x) for x in marks]))
    met = written(texts.mapInArrow(_blocks(depth, gram, PART_BITS, shared), "id long, own long, first int, windows int, one int, anchor long, block long, again boolean"))
    shared.destroy()
    return met


def repeated_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which of the suffixes at ``at`` share their first ``depth`` bytes with another suffix of their group.

    Digits of eight bytes, the first first; each pass orders the suffixes of a group by one digit and divides the group.
    """
    found = np.zeros(len(at), bool)
    view = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    left = np.argsort(group, kind="stable")
    group = group[left]
    for digit in [*range(0, depth - 8, 8), depth - 8]:
        if not len(left):
            break
        value = view[at[left] + digit]
        order = np.lexsort((value, group))
        left, group, value = left[order], group[order], value[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        group = np.cumsum(new)
        keep = np.bincount(group)[group] > 1
        left, group = left[keep], group[keep]
    found[left] = True
    return found


def _fetch(depth: int, hot: bool):
    """Rows of texts with their wanted blocks: the bytes of each block; for hot anchors the digest of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, owns = batch.column("text").cast(pa.large_binary()), batch.column("id"), batch.column("own")
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                raw = texts[k].as_py()
                rows = [(w["anchor"], w["first"], raw[w["first"] : w["first"] + w["one"] + depth - 1], w["alone"]) for w in wanted]
                if hot:
                    rows = [(a, f + i, hashlib.blake2b(b[i : i + depth], digest_size=16).digest(), alone) for a, f, b, alone in rows for i in range(len(b) - depth + 1)]
                a, f, b, alone = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(ids[k], len(rows)), pa.repeat(owns[k], len(rows)), pa.array(a, pa.int64()), pa.array(f, pa.int32()), pa.array(b, pa.binary()), pa.array(alone, pa.bool_())],
                    names=["id", "own", "anchor", "first", "bytes", "alone"],
                )
        _rest()

    return run


def _sorted_blocks(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            ids, owns, anchors, firsts = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            sizes = np.array([len(r[4]) for r in rows])
            data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            begin = np.cumsum(sizes) - sizes
            windows = sizes - depth + 1
            of = np.repeat(np.arange(len(rows)), windows)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            found = repeated_suffixes(data, begin[of] + inner, np.unique(anchors, return_inverse=True)[1][of], depth)
            alone = np.array([r[5] for r in rows])
            found &= alone[of]
            head = found & ~np.concatenate([[False], found[:-1] & (of[1:] == of[:-1])])
            tail = found & ~np.concatenate([found[1:] & (of[1:] == of[:-1]), [False]])
            a, b = np.flatnonzero(head), np.flatnonzero(tail)
            return pa.RecordBatch.from_arrays([pa.array(ids[of[a]]), pa.array(owns[of[a]]), pa.array(firsts[of[a]] + inner[a]), pa.array(firsts[of[b]] + inner[b] + depth)], names=["id", "own", "start", "end"])

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "own", "anchor", "first", "bytes", "alone")), strict=True):
                if rows and row[:4] == rows[-1][:4]:
                    continue  # the same block of the same row, from a second copy of that row
                if held > SORT_SUFFIXES and row[2] != rows[-1][2]:
                    yield done(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4]) - depth + 1
        if rows:
            yield done(rows)
        rows.clear()
        _rest()

    return run


def _spans(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """Ranges (id, own, start, end) of bytes covered by repeated strings; ranges of one text may overlap."""
    met = _met(texts, depth, gram)
    distinct = met.groupBy("anchor", "block").agg(F.count("*").alias("_n"), F.max("again").alias("_r"), F.min(F.struct("id", "own", "first", "one")).alias("_f"))
    distinct = written(distinct.select("anchor", "block", (~((F.col("_n") > 1) | F.col("_r"))).alias("alone"), "_f.*"))
    span = lambda frame: frame.select("id", "own", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") + depth - 1).cast("long").alias("end"))
    whole = span(met.join(distinct.filter("not alone").select("anchor", "block"), ["anchor", "block"]))
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("_c"), F.max("alone").alias("_any"))
    # where every block of an anchor is repeated as a whole, or there is one only, nothing is left to find
    open_ = distinct.join(sizes.filter("_any and _c > 1"), "anchor").withColumn("hot", F.col("_c") > HOT_BLOCKS)

    def fetched(hot: bool) -> DataFrame:
        wanted = open_.filter(F.col("hot") == hot).groupBy("id", "own").agg(F.collect_list(F.struct("anchor", "first", "one", "alone")).alias("wanted"))
        # all columns of texts, unfiltered: this exchange is the one of the last join, and is made once
        return texts.join(wanted, ["id", "own"]).mapInArrow(_fetch(depth, hot), "id long, own long, anchor long, first int, bytes binary, alone boolean")

    partly = fetched(False).repartition("anchor").sortWithinPartitions("anchor", "id", "own", "first").mapInArrow(_sorted_blocks(depth), "id long, own long, start long, end long")
    out = whole.unionByName(partly)
    if open_.filter("hot").limit(1).count():
        windows = fetched(True)
        # a window is counted once for each place of a row, however many copies of the row there are
        twice = windows.groupBy("anchor", "bytes").agg(F.min(F.struct("id", "own", "first")).alias("_a"), F.max(F.struct("id", "own", "first")).alias("_b")).filter("_a <> _b")
        found = windows.filter("alone").join(twice.select("anchor", "bytes"), ["anchor", "bytes"])
        out = out.unionByName(found.select("id", "own", F.col("first").cast("long").alias("start"), (F.col("first") + depth).cast("long").alias("end")))
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        rows = []
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            raw = texts[k].as_py() or b""
            kept, at, merged = hashlib.sha256(), 0, []
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            for start, end in merged:
                kept.update(raw[at:start])
                at = end
            kept.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges, apart from each other)."""
    texts = keyed(docs, id_col, text_col)
    spans = _spans(texts, depth, gram).groupBy("id", "own").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.join(spans, ["id", "own"], "left").select("doc", "text", "spans").mapInArrow(_cut_out, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    return out.withColumnRenamed("doc", id_col)
