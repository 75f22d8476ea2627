import numpy as np
from pyspark.sql import functions as F

from cairnspark.llm import neighbours


def brute(ids, x, asked, k):
    out = {}
    for a in asked:
        s = x @ x[ids.tolist().index(a)]
        out[a] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != a][:k]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = (x * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32).astype(float)
    x[700:900] = x[0]
    ids = rng.permutation(3000)[:1500]
    docs = spark.createDataFrame([(int(i), v.tolist(), 7) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, rank int")
    odd = spark.createDataFrame([(20000, None), (20020, [0.0] * 32), (20040, [float("nan")] * 32), (20060, [1.0]), (20080, [None] + [1.0] * 31), (None, [1.0] * 32)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(docs.select("vec_id", "embedding").unionByName(odd), F.pmod("id", F.lit(20)) == 0).collect()
    want = brute(ids, x, [int(i) for i in ids if i % 20 == 0], 20)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - x[ids.tolist().index(r.query_id)] @ x[ids.tolist().index(r.vec_id)]) < 1e-12
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[a]) & set(want[a])) / 20 for a in want]) >= 0.9


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    found = neighbours.nearest(docs, F.pmod("id", F.lit(20)) == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(found)] == [(0, 1, 1, 4.0), (0, 2, 2, 4.0)]
    assert neighbours.nearest(docs.limit(0), F.col("id") >= 0).collect() == []
