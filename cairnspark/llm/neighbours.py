"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are dealt to the lists of their nearest centroid. A query visits its best lists. In a list, rotated vectors are read in
blocks of columns; after each block a hypothesis test asks whether the part of the product that is still unseen can lift the
candidate above the query's present k-th best, and abandons it if that is unlikely. Survivors are scored on the original vectors
in double precision.

Centroids, rotation and the number of lists to visit are fitted on a bounded sample; every row is indexed. Of equal vectors only
the k + 1 least ids can be among a query's k nearest, so no more of them are kept: that drops no result, and a hot vector never
fills a task.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows without an id; ties go to the smaller id; a query gets all candidates if there are fewer than k; other columns are not
looked at. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to fit on, at most; and queries of them to set the number of visited lists by.
FIT_ROWS = 20_000
TUNE_QUERIES = 200
#: Recall on the sample that the number of visited lists must reach.
TUNE_RECALL = 0.96
MOST_LISTS = 4096
#: Rows of a shard of lists, about, which one task scans; and queries that it takes at a time.
SHARD_ROWS = 16_384
QUERY_ROWS = 1024
#: Columns of one block, and the standard deviations that the unseen part of a product is allowed for.
COLUMNS = 16
DEVIATIONS = 3.5


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 0) -> Index:
    """Centroids by k-means, a random rotation, and the least number of lists that finds the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    lists = int(min(max(1, round(rows**0.5)), MOST_LISTS, max(1, len(sample) // 20)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(12):
        own = nearest_list(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=lists)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    own = nearest_list(sample, centroids)
    at = rng.choice(len(sample), min(TUNE_QUERIES, len(sample)), replace=False)
    score = sample[at] @ sample.T
    score[np.arange(len(at)), at] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    rank = np.argsort(np.argsort(-(sample[at] @ centroids.T), axis=1), axis=1)
    needed = rank[np.arange(len(at))[:, None], own[best]] if best.size else np.zeros((1, 1), int)
    probes = next((p for p in range(1, lists + 1) if (needed < p).mean() >= TUNE_RECALL), lists)
    return Index(centroids, rotation, probes)


def nearest_list(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centroids**2).sum(1) - 2 * (x[i : i + 8192] @ centroids.T), axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, int)])


class Shard:
    """The rows of some lists, rotated, with the norms that the tests need."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, index: Index, k: int):
        order = np.lexsort((ids, lists))
        self.x, self.ids, lists = x[order], ids[order], lists[order]
        self.index, self.k, d = index, k, x.shape[1]
        self.edges = [*range(0, d, COLUMNS), d]
        self.turned = self.x @ index.rotation
        self.tails = self._tails(self.turned)
        edge = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
        self.spans = [(int(lists[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _tails(self, m: np.ndarray) -> np.ndarray:
        """Norms of the columns from each edge on."""
        squares = np.concatenate([np.add.reduceat(m**2, self.edges[:-1], axis=1), np.zeros((len(m), 1))], 1)
        return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])

    def scan(self, q: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of each query's k largest products in the lists it visits, without its own row."""
        d, k = q.shape[1], self.k
        near = q @ self.index.centroids.T
        visits = min(self.index.probes, near.shape[1])
        least = -np.partition(-near, visits - 1, axis=1)[:, visits - 1]
        turned = q @ self.index.rotation
        tails = self._tails(turned)
        bar, best = np.full(len(q), -np.inf), np.full((len(q), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for number, start, stop in self.spans:
            some = np.flatnonzero(near[:, number] >= least)
            if not len(some):
                continue
            first = self.edges[1]
            part = turned[some, :first] @ self.turned[start:stop, :first].T
            slack = DEVIATIONS / np.sqrt(max(1, d - first)) * tails[some, 1][:, None] * self.tails[start:stop, 1]
            i, j = np.nonzero((part + slack >= bar[some][:, None]) & (self.ids[start:stop] != asks[some][:, None]))
            value, i, j = part[i, j], some[i], j + start
            for n, (a, b) in enumerate(zip(self.edges[1:-1], self.edges[2:], strict=True), 2):
                value = value + np.einsum("nd,nd->n", turned[i, a:b], self.turned[j, a:b])
                if b < d:
                    on = value + DEVIATIONS / np.sqrt(d - b) * tails[i, n] * self.tails[j, n] >= bar[i]
                    i, j, value = i[on], j[on], value[on]
            on = value >= bar[i] - 1e-6 * np.maximum(np.abs(bar[i]), 1e-6) if len(i) else np.zeros(0, bool)  # the rotation rounds; ties must stay
            i, j, value = i[on], j[on], value[on]
            if not len(i):
                continue
            found.append((i, j))
            order = np.lexsort((-value, i))
            ranked, value = i[order], value[order]
            place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
            top = place < k
            fresh = np.full((len(some), k), -np.inf)
            fresh[np.searchsorted(some, ranked[top]), place[top]] = value[top]
            best[some] = -np.partition(-np.concatenate([best[some], fresh], 1), k - 1, axis=1)[:, :k]
            bar[some] = best[some].min(1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j = (np.concatenate(f) for f in zip(*found, strict=True))
        return _top(q, self.x, self.ids, i, j, k)


def _top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray, k: int):
    score = np.einsum("nd,nd->n", q[i], x[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], score[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "vector"])


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) with each query's k nearest found; ``queries`` picks the query rows by "id"."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], shape)
    rows = rows.filter(F.size("vector") == sizes.d)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).mapInArrow(_doubles, "id long, vector binary").toArrow()
    shared = spark.sparkContext.broadcast(fit(_matrix(sample.column("vector").combine_chunks()), sizes.n, k, seed))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in _doubles(batches):
            own = nearest_list(_matrix(batch.column("vector")), index.centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "vector", "list"])

    copies = Window.partitionBy("vector").orderBy("id")
    kept = rows.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k + 1).select("id", "vector")
    shards = max(1, -(-sizes.n // SHARD_ROWS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every shard that holds a list it visits."""
        index = shared.value
        for batch in _doubles(batches):
            at = np.argsort(-(_matrix(batch.column("vector")) @ index.centroids.T), axis=1)[:, : index.probes] % shards
            pairs = np.unique(np.stack([np.repeat(np.arange(batch.num_rows), at.shape[1]), at.ravel()], 1), axis=0)
            rows_ = pa.array(pairs[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows_), batch.column("vector").take(rows_), pa.array(pairs[:, 1].astype(np.int32))], names=["id", "vector", "shard"])

    listed = kept.mapInArrow(dealt, "id long, vector binary, list int").withColumn("shard", F.col("list") % shards)
    # a shard that is larger than most, as lists are uneven, is read in blocks; each query goes to all blocks of its shards
    counts = listed.groupBy("shard").agg(F.ceil(F.count("*") / (2 * SHARD_ROWS)).cast("int").alias("blocks"))
    stored = listed.join(counts, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "list", "id", "vector")
    asked = rows.filter(queries).mapInArrow(sent, "id long, vector binary, shard int").join(counts, "shard")
    asked = asked.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), F.lit(-1).alias("list"), "id", "vector")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, block and kind: a block's rows are held, then its queries pass by."""
        now, held, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("shard").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
            asks = batch.column("asks").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if key[a] != now:
                    now, held, shard = key[a], [], None
                if not asks[a]:
                    held.append(tuple(batch.column(c).slice(a, b - a) for c in ("vector", "id", "list")))
                    continue
                if shard is None and held:
                    shard = Shard(np.concatenate([_matrix(v) for v, _, _ in held]), *(np.concatenate([h[c].to_numpy() for h in held]) for c in (1, 2)), shared.value, k)
                    held = []
                for c in range(a, b, QUERY_ROWS) if shard is not None else ():
                    ids = batch.column("id").slice(c, min(QUERY_ROWS, b - c)).to_numpy()
                    i, j, score = shard.scan(_matrix(batch.column("vector").slice(c, len(ids))), ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(shard.ids[j]), pa.array(score)], names=["query_id", "vec_id", "score"])

    tasks = stored.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    found = tasks.mapInArrow(scanned, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
