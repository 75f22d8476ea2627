"""Near duplicates by a MinHash LSH forest, with exact confirmation.

A text is the set of its distinct word shingles. Texts with one and the same set are one node. A node's MinHash values stand in
several orders, the trees of the forest; each tree sorts the nodes by its order. Nodes that share the first DEPTH values of a
tree form a region, whatever its size, and lie side by side in it. Neighbours in the sorted order have the longest common
prefixes and are compared first; a region of more than a few nodes is then read from its deepest prefixes up, at each depth
only across what deeper ones have not linked yet, down to DEPTH values for every region. So the depth adapts to the region,
and no pair that shares DEPTH values of a tree goes uncompared unless a chain of likenesses joins it already. Nodes that look
alike by their signatures are candidates, and the candidates' components are clusters: supersets of the true classes. Each
cluster then gets its whole sets once, and every pair of it is compared exactly. A large region and a large cluster are
compared block by block, so that no task holds more than two blocks.

Defined results: null or empty texts, and texts without words, have no shingles and no links; a text with fewer words than a
shingle is one shingle; ties link (similarity at the threshold counts); rows of a repeated id are rows of their own; a row
without an id takes part, and a class in which no row has an id has none either; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.arrowtext import mixed, padded, runs_of, steps, word_hashes
from cairnspark.llm.components import components
from cairnspark.llm.rowkeys import keyed
from cairnspark.session import cut

VALUES = 128
TREES = 24
#: Values of a tree that nodes of a region share, and further values that the order in a region goes by. Regions of more than
#: REGION nodes are compared in blocks of half as many; those of more than FEW are read from the deepest prefixes up.
DEPTH = 4
FURTHER = 4
REGION = 1024
FEW = 32
#: Leading values that the first comparison takes, one byte each, and the share of them that must agree. At similarity 0.8 all
#: but three in a million pairs agree in more.
SKETCH = 64
ALIKE = 0.57
#: A block of a cluster: nodes, and shingles, at most. Compared are two blocks at a time.
BLOCK_NODES = 1024
BLOCK_SHINGLES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = mixed(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``size`` words."""
    lower = _LOWER[data]
    starts, ends = runs_of(~_SPACE[lower], offsets)
    hashes = word_hashes(padded(lower), starts, ends)
    first = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        rolled = mixed(rolled + hashes[i : i + len(rolled)])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                whole = mixed(whole + hashes[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES MinHash values of each set, cut to 16 bits."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), VALUES), np.uint16)
    some = np.flatnonzero(sizes)
    if len(some):
        every = np.concatenate(sets)
        begin = (np.cumsum(sizes) - sizes)[some]
        for p in range(VALUES):
            least = np.minimum.reduceat((every * _ODD[p]) >> np.uint64(24), begin)
            out[some, p] = mixed(least) & np.uint64(0xFFFF)
    return out


def _nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                sums = np.array([[len(s), mixed(s).sum(), mixed(s + np.uint64(77)).sum()] for s in sets], np.uint64).astype(np.int64)
                signed = pa.array([row.tobytes() for row in signatures(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("id"), part.column("own"), *(pa.array(sums[:, i]) for i in range(3)), signed], names=["doc", "id", "own", "n", "f1", "f2", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node and tree the hash of its first values, and the further ones as one number that sorts like them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signed = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        at = np.arange(TREES) * DEPTH
        key = np.broadcast_to(mixed(np.arange(1, TREES + 1, dtype=np.uint64)), (len(signed), TREES)).copy()
        rest = np.zeros((len(signed), TREES), np.uint64)
        for i in range(DEPTH):
            key = mixed(key + signed[:, (at + i) % VALUES])
        for i in range(DEPTH, DEPTH + FURTHER):
            rest = (rest << np.uint64(16)) | signed[:, (at + i) % VALUES]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), TREES)), pa.array(key.astype(np.int64).ravel()), pa.array(rest.astype(np.int64).ravel())], names=["node", "region", "rest"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task and, in it, by the tree's order: links from nodes to others of their candidates' component within it."""

    def links(region: np.ndarray, rest: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        size = np.diff(edge)
        # neighbours in the order, all at once: regions of two nodes are done with that
        near = (region[1:] == region[:-1]) & ((sketch[1:] == sketch[:-1]).sum(1) >= ALIKE * SKETCH)
        a, b = [ids[1:][near]], [ids[:-1][near]]
        run = np.concatenate([[0], np.cumsum(~near)])  # neighbours that look alike are one class from the start
        for s, e in zip(edge[:-1][size > 2], edge[1:][size > 2], strict=True):
            if run[s] != run[e - 1]:
                own = run[s:e] - run[s]
                root = ascended(rest[s:e], own, sketch[s:e]) if e - s > FEW else joined(own, sketch[s:e])
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                away = np.flatnonzero(root != np.arange(len(root)))  # a class's first node, linked to that of the class it has joined
                a.append(ids[s:e][first[away]])
                b.append(ids[s:e][first[root[away]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        held.append((batch.column("region").to_numpy(), batch.column("rest").to_numpy(), batch.column("node").to_numpy(), sketch))
        if held[0][0][0] == held[-1][0][-1]:
            continue
        columns = [np.concatenate([h[i] for h in held]) for i in range(4)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last region may go on in the next batch
        yield from links(*(c[:last] for c in columns))
        held = [tuple(c[last:] for c in columns)]
    if held:
        yield from links(*(np.concatenate([h[i] for h in held]) for i in range(4)))


def common_values(rest: np.ndarray) -> np.ndarray:
    """How many further values each node shares with the one before it in the order."""
    other = (rest[1:] ^ rest[:-1]).view(np.uint64)
    return sum((other >> np.uint64(16 * (FURTHER - k)) == 0).astype(np.int64) for k in range(1, FURTHER + 1))


def ascended(rest: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The class of each class in a region, by nodes in the tree's order: prefixes of all further values first, then shorter ones,
    at last the region itself. What a deeper prefix has joined is one class above."""
    shared, now = common_values(rest), own.copy()
    for depth in range(FURTHER, -1, -1):
        edge = np.concatenate([[0], np.flatnonzero(shared < depth) + 1, [len(own)]])
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if e - s > 1 and now[s:e].min() != now[s:e].max():
                kinds, inner = np.unique(now[s:e], return_inverse=True)
                root = joined(inner, sketch[s:e])
                gone = root != np.arange(len(kinds))
                if gone.any():
                    table = np.arange(len(own))
                    table[kinds[gone]] = kinds[root[gone]]
                    now = table[now]
    out = np.zeros(own.max() + 1, np.int64)
    out[own] = now
    return out


def joined(own: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The least class that each class is joined with, where sketches of their nodes agree in ALIKE of their values. Nodes are
    compared only with classes that nothing has reached yet, and a class is reached whole."""
    root = np.arange(int(own.max()) + 1)
    left, kinds, rest = np.arange(len(own)), own, sketch
    reached: list[int] = []
    while len(left):
        if not reached:
            head = int(kinds[0])
            hit = kinds == head
        else:
            same = (rest == sketch[reached.pop()]).view(np.uint64).sum(1)  # eight counts of at most eight, one byte each
            near = (same * np.uint64(0x0101010101010101)) >> np.uint64(56) >= ALIKE * SKETCH
            if not near.any():
                continue
            new = np.unique(kinds[near])
            root[new] = head
            hit = np.isin(kinds, new)
        reached += left[hit].tolist()
        left, kinds, rest = left[~hit], kinds[~hit], rest[~hit]
    return root


def spread(near: np.ndarray) -> np.ndarray:
    """The least number in the component of each node, from a symmetric matrix of links."""
    n = len(near)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            new = np.array([i])
            while len(new):
                root[new] = i
                new = np.flatnonzero(near[new].any(0) & (root < 0))
    return root


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of links: 100 * intersection >= percent * union, counted over the whole sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    of = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    spread_of = np.diff(edge)
    column = np.repeat(np.arange(len(spread_of)), spread_of)
    common = np.zeros((m, m), np.float32)
    often = spread_of > 16
    numbers = np.flatnonzero(often)
    renumbered = np.full(len(spread_of), -1)
    renumbered[numbers] = np.arange(len(numbers))
    dense = renumbered[column]
    for a in range(0, len(numbers), 2048):  # columns of many nodes: a product of 0/1 matrices, exact below 2**24
        take = (dense >= a) & (dense < a + 2048)
        x = np.zeros((m, min(2048, len(numbers) - a)), np.float32)
        x[of[take], dense[take] - a] = 1
        common += x @ x.T
    rare = ~often[column] & (spread_of[column] > 1)
    c, o = column[rare], of[rare]
    for shift in range(1, 16):
        same = c[shift:] == c[:-shift]
        if not same.any():
            break
        i, j = o[shift:][same], o[:-shift][same]
        flat = np.concatenate([i * m + j, j * m + i])
        if len(flat) > m * m // 8:
            common += np.bincount(flat, minlength=m * m).reshape(m, m)
        else:
            at, times = np.unique(flat, return_counts=True)
            common.ravel()[at] += times
    union = sizes[:, None] + sizes[None, :] - common
    return (100 * common >= percent * union) & (common > 0)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
            ids = np.array([r[0] for r in rows])
            root = spread(exact_links([np.frombuffer(r[1], np.uint64) for r in rows], percent))
            away = np.flatnonzero(root != np.arange(len(ids)))
            return ids[away], ids[root[away]]

        key, rows, a, b = None, [], [], []
        for batch in batches:
            for now, i, s in zip(batch.column("task").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if now != key and rows:
                    x, y = group(rows)
                    a.append(x)
                    b.append(y)
                    rows = []
                if now == key and rows and rows[-1][0] == i:
                    continue  # the same node from another copy of its row
                key = now
                rows.append((i, s))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if rows:
            x, y = group(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def _shingled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in steps(batch, "text"):
                sets = pa.array([s.tobytes() for s in shingle_sets(data, offsets, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "cluster", "block", "blocks")), sets], names=["node", "cluster", "block", "blocks", "shingles"])

    return run


def _candidates(nodes: DataFrame) -> DataFrame:
    """Links of candidates, from all regions of all trees."""
    placed = nodes.mapInArrow(_keys, "node long, region long, rest long")
    counts = placed.groupBy("region").agg(F.count("*").alias("_c")).filter("_c > 1")
    sketches = nodes.select("node", "sig").mapInArrow(_sketched, "node long, sketch binary")
    blocks = F.when(F.col("_c") > REGION, F.ceil(2 * F.col("_c") / REGION)).otherwise(1).cast("int")
    placed = placed.join(counts, "region").withColumn("_n", blocks).join(sketches, "node").withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    dealt = placed.select("node", "sketch", "region", "rest", "_n", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"))
    task = F.when(F.col("_n") == 1, F.col("region")).otherwise(F.xxhash64("region", F.least("_b", "_o"), F.greatest("_b", "_o")))
    rows = dealt.select(task.alias("region"), "rest", "node", "sketch").repartition("region").sortWithinPartitions("region", "rest")
    return rows.mapInArrow(_alike, "a long, b long")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signed = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            low = np.ascontiguousarray(signed[:, -SKETCH:] & np.uint16(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in low], pa.binary())], names=["node", "sketch"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the least id of its class)."""
    texts = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(texts.mapInArrow(_nodes(shingle), f"doc {kind}, id long, own long, n long, f1 long, f2 long, sig binary"))
    # one node for all texts with the same set: counted before the shuffle, so a hot copy is one row per task
    nodes = rows.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("doc"), F.min(F.struct("id", "own")).alias("_k"), F.min("sig").alias("sig"))
    nodes = cut(nodes.select("n", "f1", "f2", "doc", "_k.id", "_k.own", "sig", F.monotonically_increasing_id().alias("node")))
    clustered = components(_candidates(nodes))
    members = clustered.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(clustered.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())
    members = members.join(nodes.select("node", "id", "own", "n"), "node")
    sized = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = members.select("node", "id", "own", "cluster", "block", "blocks").join(texts.select("id", "own", "text"), ["id", "own"])
    sets = sets.select("node", "cluster", "block", "blocks", "text").mapInArrow(_shingled(shingle), "node long, cluster long, block int, blocks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")
    dealt = sets.select("node", "cluster", "block", "shingles", other).select("node", "shingles", F.xxhash64("cluster", F.least("block", "_o"), F.greatest("block", "_o")).alias("task"))
    linked = components(dealt.repartition("task").sortWithinPartitions("task", "node").mapInArrow(_confirm(percent), "a long, b long"))
    rooted = nodes.select("n", "f1", "f2", "doc", "node").join(linked.select(F.col("a").alias("node"), "b"), "node", "left").withColumn("b", F.coalesce("b", "node"))
    least = rooted.groupBy("b").agg(F.min("doc").alias("component_id"))
    roots = rooted.select("n", "f1", "f2", "b").join(least, "b").select("n", "f1", "f2", "component_id")
    return rows.select("doc", "n", "f1", "f2").join(roots, ["n", "f1", "f2"], "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
