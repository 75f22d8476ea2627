import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from cairnspark.llm import neardup
from cairnspark.llm.components import components


def brute(rows, shingle, percent):
    sets = {}
    for i, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        sets[i] = {tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, " odd space"), (7, "a b " * 3000), (8, "A  B\n" * 2500)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, size)):
            own = [rng.choice(vocabulary) if rng.random() < 0.04 else w for w in base]
            rows.append((len(rows), " ".join(own)))
            if rng.random() < 0.3:
                rows.append((len(rows), " ".join(own).upper()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shingle", "region", "block", "few"), [(2, 4096, 1024, 32), (5, 4096, 3, 2)])
def test_matches_brute_force(spark, monkeypatch, shingle, region, block, few):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "BLOCK_NODES", block)
    rows = corpus(shingle + region)
    docs = spark.createDataFrame([(i, t, 5, 7) for i, t in rows], "doc_id long, text string, n int, component_id int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle).collect()}
    assert found == brute(rows, shingle, 80)


def test_deeper_regions_keep_a_large_group_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 40)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = [(i, " ".join(f"x{rng.randrange(900)}" if rng.random() < 0.02 else w for w in base)) for i in range(160)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert found == brute(rows, 2, 80)


def test_pairs_at_the_threshold_inside_hot_regions(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 1)
    rng = random.Random(5)
    boilerplate, rows = [f"b{i}" for i in range(60)], []
    for i in range(0, 200, 2):  # pairs that share 133 of 165 shingles, and 59 with all others
        base = boilerplate + [f"w{rng.randrange(10**6)}" for _ in range(90)]
        changed = set(range(65, 149, 11))
        rows += [(i, " ".join(base)), (i + 1, " ".join(f"x{i}" if k in changed else w for k, w in enumerate(base)))]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert found == brute(rows, 2, 80) and {c for _, c in found.values()} == set(range(0, 200, 2))


def least_of(root):
    """Class numbers as the least node of each class."""
    return np.array([np.flatnonzero(root == r)[0] for r in root])


def test_joined_and_ascended_match_all_pairs():
    rng = np.random.default_rng(1)
    for values in (2, 3, 4):
        sketch = rng.integers(0, values, (120, neardup.SKETCH)).astype(np.uint8)
        sketch[40:80] = np.where(rng.random((40, neardup.SKETCH)) < 0.3, sketch[40:80], sketch[:40])
        near = np.stack([(sketch == row).mean(1) >= neardup.ALIKE for row in sketch])
        want = neardup.spread(near)
        assert (least_of(neardup.joined(np.arange(120), sketch)) == want).all()
        rest = np.sort(rng.integers(0, 3, (120, 4)) @ (1 << np.array([48, 32, 16, 0])))
        assert (least_of(neardup.ascended(rest, np.arange(120), sketch)) == want).all()


def test_common_values():
    number = lambda *v: sum(int(x) << (16 * (3 - k)) for k, x in enumerate(v))
    rest = np.array([number(1, 2, 3, 4), number(1, 2, 3, 4), number(1, 2, 3, 5), number(1, 2, 4, 4), number(1, 3, 3, 4), number(2, 3, 3, 4)])
    assert neardup.common_values(rest).tolist() == [4, 3, 2, 1, 0]


def test_recall_of_regions_at_the_threshold():
    """Pairs at similarity 0.8 that share no region of any tree: a few in a million expected, none of 2,000 seen."""
    rng, missed = np.random.default_rng(4), 0
    for _ in range(20):
        sets = []
        for _ in range(100):
            common = rng.integers(0, 2**63, 160).astype(np.uint64)
            sets += [np.unique(np.concatenate([common, rng.integers(0, 2**63, 20).astype(np.uint64)])) for _ in range(2)]
        nodes = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([r.tobytes() for r in neardup.signatures(sets)], pa.binary())], names=["node", "sig"])
        region = next(neardup._keys(iter([nodes]))).column("region").to_numpy().reshape(100, 2, neardup.TREES)
        missed += int((region[:, 0] != region[:, 1]).all(1).sum())
    assert missed == 0


def test_repeated_and_null_ids(spark):
    rows = corpus(11, 6, 8)
    texts = [t for _, t in rows]
    want = brute(list(enumerate(texts)), 2, 80)
    for kind, name in (("long", lambda k: [3, None, k][k % 3]), ("string", lambda k: ["a", None, f"k{k}"][k % 3])):
        docs = spark.createDataFrame([(name(k), t) for k, t in enumerate(texts)], f"doc_id {kind}, text string")
        least = {c: min((name(k) for k in want if want[k][1] == c and name(k) is not None), default=None) for _, c in want.values()}
        found = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2).collect()]
        assert sorted(map(str, found)) == sorted(str((name(k), n, least[c] if n else name(k))) for k, (n, c) in want.items())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == []


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    found = components(links).collect()
    assert len(found) == 300 and {r.b for r in found} == {0}


def test_exact_links_counts_whole_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    found = neardup.exact_links(sets, 60)
    for i, j in itertools.combinations(range(50), 2):
        x, y = set(sets[i].tolist()), set(sets[j].tolist())
        assert found[i, j] == (100 * len(x & y) >= 60 * len(x | y))
