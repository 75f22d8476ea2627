import hashlib
import random
from collections import Counter

import pytest

from cairnspark.llm import substrings


def brute(rows, depth):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[p : p + depth] for p in range(len(b) - depth + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if seen[b[p : p + depth]] > 1:
                gone[p : p + depth] = b"\x01" * depth
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = [None, "", "a" * 199, "a" * 200, "b" * 201, "ab" * 400, "xyz" * 90 + "q" + "xyz" * 90, "日本語" * 120]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passage), word()]
        rows.append(" ".join(parts))
    base = " ".join(word() for _ in range(120)).split(" ")
    rows += [" ".join(word() if rng.random() < 0.03 else w for w in base) for _ in range(12)]
    rows += [rows[20], rows[21]]
    return list(enumerate(rows))


@pytest.mark.parametrize(("depth", "gram", "hot", "sort"), [(200, 100, 30_000, 400_000), (60, 24, 2, 50)])
def test_matches_brute_force(spark, monkeypatch, depth, gram, hot, sort):
    monkeypatch.setattr(substrings, "HOT_BLOCKS", hot)
    monkeypatch.setattr(substrings, "SORT_SUFFIXES", sort)
    rows = texts(depth)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, start int")
    found = substrings.remove_repeats(docs, depth, gram).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute(rows, depth)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_remove_each_other(spark):
    text = " ".join(f"word{i}" for i in range(100))
    found = substrings.remove_repeats(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [(r.n_bytes, r.n_removed) for r in found] == [(len(text), len(text))] * 2


@pytest.mark.parametrize("hot", [2, 30_000])
def test_repeated_null_and_text_ids(spark, monkeypatch, hot):
    """Rows with one id and different texts are rows of their own: each loses only what it repeats."""
    monkeypatch.setattr(substrings, "HOT_BLOCKS", hot)
    rows = [t for _, t in texts(7)]
    order = lambda found: sorted((str(i), *rest) for i, *rest in found)
    for kind, name in (("long", lambda k: [1, None, k][k % 3]), ("string", lambda k: ["a", None, f"k{k}"][k % 3])):
        named = [(name(k), t) for k, t in enumerate(rows)]
        found = substrings.remove_repeats(spark.createDataFrame(named, f"doc_id {kind}, text string"), 60, 24).collect()
        want = [(named[k][0], *rest) for k, *rest in brute(list(enumerate(rows)), 60)]
        assert order((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == order(want)
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    found = substrings.remove_repeats(spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == sorted([(1, len(a)), (1, 0), (2, len(a))])


def test_texts_cross_the_network_once(spark):
    """What is exchanged is little more than the texts: an anchor that occurs once costs a few bytes, no row."""
    rng = random.Random(3)
    rows = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+-") for _ in range(20_000)) for _ in range(100)]
    rows += [rows[k][5_000:5_400] + rows[k + 1][:250] + rows[k][9_000:9_090] for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    context = spark.sparkContext._jsc.sc()

    def exchanged():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            before = exchanged()
            found = substrings.remove_repeats(docs).collect()
            assert exchanged() - before < 1.5 * sum(map(len, rows))
            assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute(list(enumerate(rows)), 200)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_small_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEEN_BITS", substrings.PART_BITS + 3)
    rows = texts(60)
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60, 24).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute(rows, 60)
