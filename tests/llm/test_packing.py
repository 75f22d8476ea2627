import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cairnspark.llm import packing
from cairnspark.llm.tokenizer import word_bpe_path


@pytest.mark.parametrize("capacity", [1, 2, 7, 30, 2048])
def test_plan_fills_bins_without_gaps(capacity):
    rng = random.Random(capacity)
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[min(capacity, int(rng.expovariate(3 / capacity)) + 1)] += 1
    bins, placed = defaultdict(list), defaultdict(int)
    for length, number, count, first, offset in packing.plan(dict(histogram), capacity):
        assert number == placed[length]
        placed[length] += count
        for i in range(count):
            bins[first + i].append((offset, length))
    assert dict(placed) == dict(histogram)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.03 * -(-sum(n * c for n, c in histogram.items()) // capacity) + 1


def test_large_items_pair_at_most_twice():
    plan = packing.plan({7: 2, 6: 1, 4: 3, 3: 1}, 10)
    assert max(first + count for _, _, count, first, _ in plan) == 4


def test_packing_of_documents_matches_the_tokenizer(spark):
    rng = random.Random(2)
    parts = ["The", "word.", "É", "é", "J̌", "ǰ", "naïve,", "日本", "a's", "<|endoftext|>", "\t", "\n", " ", ".", ",", "...", "x1", "İ.", "Σ", " ", "·."]
    texts = [None, "", " ", "<|startoftext|>"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 90))) for _ in range(150)] + ["some word, " * 900]
    rows = [*enumerate(texts), (0, None), (60, texts[60])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, piece int")
    found = packing.pack_documents(docs, word_bpe_path(), 64).collect()
    tokenizer = Tokenizer.from_file(word_bpe_path())
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in found) / 64 + 1
    assert packing.pack_documents(docs.limit(0), word_bpe_path()).collect() == []


def test_a_full_cache_forgets_and_goes_on(monkeypatch):
    import pyarrow as pa

    from cairnspark.llm.arrowtext import utf8

    monkeypatch.setattr(packing, "REMEMBERED", 20)
    cache = packing.WordCache(word_bpe_path())
    tokenizer = Tokenizer.from_file(word_bpe_path())
    for n in range(8):
        text = " ".join(f"word{n}x{i}" for i in range(30))
        ids, first = cache.ids(*utf8(pa.array([text])))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and first.tolist() == [0, len(ids)]
