import hashlib
import pickle
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from cairnspark.llm import decontam
from cairnspark.llm.arrowtext import utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    patterns = {}
    for i, text in items:
        w = words(text)
        size = min(10, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            patterns.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    sizes = {len(p) for p in patterns}
    out = {}
    for d, text in docs:
        w, hit, own = words(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if found := patterns.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    own |= found
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 400])
def test_matches_brute_force(spark, block_bytes):
    rng = random.Random(9)
    vocabulary = ["the", "of", "A", "it", "naïve", "日本", "x1", "long" * 5, "longlonglonglonglong2", "é"]
    sentence = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.randint(1, 30))) for i in range(30)] + [(100, None), (101, ""), (102, "!!"), (103, "unique"), (9, "the of the of the of the of the of")]
    docs = [(0, None), (1, ""), (2, "unique"), (3, "the of " * 400)]
    for i in range(4, 120):
        parts = [sentence(rng.randint(0, 60))]
        if rng.random() < 0.5:
            w = words(rng.choice(items)[1])
            at = rng.randint(0, max(0, len(w) - 10))
            parts += [" ".join(w[at : at + rng.randint(8, 14)]).upper() if rng.random() < 0.5 else " ".join(w), sentence(5)]
        docs.append((i, " ".join(parts)))
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item int, hits int")
    found = decontam.digest(decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontam.digest(decontam.decontaminate(docs, none)).collect()] == [(2, 0)]
    assert decontam.decontaminate(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_items_are_held_in_few_bytes():
    rng = random.Random(1)
    items = [(str(i), " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400))) for i in range(600)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    found = decontam.matchers(items)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    table = 1 << 20
    assert peak < 12 * size + table and len(pickle.dumps(found)) < 6 * size + table


def test_a_window_that_all_items_share_and_one_key_for_two_texts(spark, monkeypatch):
    lead = "answer the next question with one word and say no"
    items = [(i, f"{lead} {' '.join(f'q{i}x{k}' for k in range(5))}") for i in range(50)]
    docs = [(1, f"he said {lead} more"), (2, f"{lead} q7x0 q7x1"), (3, "q7x0 q7x1"), (3, "q7x0 q7x1"), (None, lead)]
    frames = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")
    for key in (None, lambda self, slot, whole: slot.astype("uint64") * 0 + 5):
        if key:
            monkeypatch.setattr(decontam.WuManber, "_key", key)  # every pattern in one place: words decide
        found = decontam.matchers([(str(i), t) for i, t in items])
        spots = [list(m.search(decontam.Words(*utf8(pa.array([t for _, t in docs]))))) for m in found]
        assert sorted((s, len(o)) for s, o in spots[0]) == [(2, 50), (13, 50), (14, 1), (15, 1), (29, 50)]
    monkeypatch.undo()
    rows = decontam.decontaminate(*frames).collect()
    assert sorted(len(r["items"]) for r in rows) == [0, 0, 50, 50, 50]
