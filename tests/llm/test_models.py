import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from cairnspark.llm import quality, toxicity
from cairnspark.llm.arrowtext import utf8
from cairnspark.llm.labels import fold, labelled_sample


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=3 * quality.WIDTH + 1), rng.normal(size=(2, 2)))
    first = np.array([0, 1, 5, 9])
    columns = rng.integers(0, 3 * quality.WIDTH + 1, (9, 4))
    good, joint = quality.marginals(model, columns, first, pairs=True)
    score = model.weights[columns].sum(1)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        total, hit, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + i] * y for i, y in enumerate(labels)) + sum(model.links[x, y] for x, y in itertools.pairwise(labels)))
            total += w
            hit += w * np.array(labels)
            for x, y in itertools.pairwise(labels):
                both[x, y] += w
        want[a:b], pairs = hit / total, pairs + both / total
    assert np.allclose(good, want) and np.allclose(joint, pairs)


def quality_rows(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        line = (lambda: " | ".join(word() for _ in range(8))) if bad else (lambda: " ".join(word() for _ in range(12)).capitalize() + ".")
        rows.append((i, "\n".join(line() for _ in range(rng.randint(1, 9))), int(not bad)))
    return rows


def test_quality_on_held_out_rows_and_odd_texts(spark):
    rows = quality_rows(240, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(999, None), (None, 1)], "doc_id long, quality int")
    texts, y = labelled_sample(docs, labels, "quality", fold("doc_id", 5) != 0, 150)
    assert len(texts) == 150
    model = quality.fit(texts, y)
    test = quality_rows(80, 2)
    scores = quality.scores(model, *utf8(pa.array([t for _, t, _ in test])))
    assert np.mean((scores >= quality.THRESHOLD) == np.array([y for _, _, y in test])) > 0.97
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "\n" * 50, 0), (4, "x " * 60_000, 0), (5, "é", 0), (5, "é", 0)], "doc_id long, text string, score_ int")
    found = {r.doc_id: r.score for r in quality.score_documents(odd, model).collect()}
    assert len(found) == 5 and all(0 <= s <= 1 for s in found.values()) and found[1] == found[2]
    assert quality.score_documents(odd.limit(0), model).collect() == []


def test_one_label_only_gives_a_constant():
    for module in (quality, toxicity):
        model = module.fit(["a b", "c"], [1, 1])
        assert len(set(module.scores(model, *utf8(pa.array(["x", "", "y z"]))))) == 1


def brute_kernel(s, t, order, decay):
    total = 0.0
    for i in itertools.combinations(range(len(s)), order):
        for j in itertools.combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_matches_enumeration_in_every_way():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(30)]
    codes = [toxicity.letter_codes(np.frombuffer(w.encode(), np.uint8)).tobytes() for w in words]
    found = toxicity.kernel(toxicity.letters(codes, -1), toxicity.letters(codes[::-1], -2))
    assert np.allclose(found, [brute_kernel(a, b, toxicity.ORDER, toxicity.DECAY) for a, b in zip(words, words[::-1])])
    # the table over subsequences gives the same values, and leaves out only what is below LEAST
    edge = bytes([toxicity.EDGE])
    model = toxicity.Model([edge + w + edge for w in sorted(set(codes[:8]))])
    model.prepare()
    kind, table = toxicity.values(model, toxicity.Words(*utf8(pa.array([" ".join(words)]))))
    for k, w in enumerate(codes):
        w = edge + w + edge
        for m, mark in enumerate(model.landmarks):
            v = brute_kernel(w, mark, 3, toxicity.DECAY) / np.sqrt(brute_kernel(w, w, 3, toxicity.DECAY) * brute_kernel(mark, mark, 3, toxicity.DECAY))
            got = table[kind[k], m] if kind[k] >= 0 else 0
            assert np.isclose(got, v**toxicity.POWER if v >= toxicity.LEAST else 0, atol=1e-5)


def test_letters_of_other_scripts():
    codes = lambda t: toxicity.letter_codes(np.frombuffer(t.encode(), np.uint8))
    keep = lambda t: [int(c) for c in codes(t) if c]
    assert keep("Straße ÉTÉ") == keep("strase ete") and keep("« ’ … ×") == [] and keep("привет") != keep("медвед") and len(keep("привет")) == 6


def insult_rows(insults, n=400, every=5, held=2, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrnlh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(30)]
        if i % every == 0:
            for _ in range(held):
                w[rng.randrange(30)] = rng.choice(insults)
        rows.append((" ".join(w) + ".", int(i % every == 0)))
    return rows


def test_toxicity_catches_gapped_insults(spark):
    rows = insult_rows(["grumblor", "fizwick", "vexpod"])
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
    assert len(model.landmarks) == 3
    tests = ["you " + w for w in ("grumblor", "gr.umb-lor", "Grum8blor", "f i z w i c k", "vexxpod", "vexpxod", "v*xpod", "GRÜMBLÖR")] + ["a plain and clean line", "", None, "grum"]
    scores = toxicity.scores(model, *utf8(pa.array(tests)))
    assert (scores[:8] >= toxicity.THRESHOLD).all() and (scores[8:] < toxicity.THRESHOLD).all()
    odd = spark.createDataFrame([(1, None, 1), (2, "x" * 5000, 1), (2, "x" * 5000, 1), (3, "x" * 4000 + "vexpod", 1)], "doc_id long, text string, predicted int")
    assert toxicity.score_documents(odd, model).count() == 4 and toxicity.score_documents(odd.limit(0), model).collect() == []
    for module in (toxicity, quality):
        with pytest.raises(ValueError):
            module.score_documents(odd.withColumnRenamed("predicted", "score"), model)


def test_toxicity_learns_rare_families_beside_common_insults():
    """Ten common insults, and a family of thirty inflected, accented words of one stem in a tenth as many rows."""
    tails = ["an", "ichen", "ück", "ei", "ent", "eu", "ihr", "ig", "isch", "kr", "lo", "nd", "ng", "sp", "tum"]
    common = insult_rows(["grumblor", "fizwick", "vexpod", "quabdorn"], 1500, 5, 3, 1)
    family = insult_rows(["göwéi" + t for t in tails], 400, 5, 4, 2)
    rows = common + family
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
    test = insult_rows(["göwéi" + t for t in (*tails, "bach", "xim")], 300, 3, 4, 9)
    scores = toxicity.scores(model, *utf8(pa.array([t for t, _ in test])))
    y = np.array([y for _, y in test])
    assert (scores[y == 1] >= toxicity.THRESHOLD).mean() > 0.95 and (scores[y == 0] < toxicity.THRESHOLD).mean() > 0.97


def test_toxicity_counts_words_of_one_sentence():
    """Clean texts hold one word of a family by chance, toxic ones four, all in one sentence."""
    tails = ["an", "ichen", "ück", "ei", "ent", "eu", "ihr", "ig", "isch", "kr", "lo", "nd", "ng", "sp", "tum"]

    def rows(n, seed):
        rng = random.Random(seed)
        out = []
        for (text, _), y in zip(insult_rows(["x"], n, n + 1, 0, seed), [int(i % 4 == 0) for i in range(n)], strict=True):
            held = 4 if y else int(rng.random() < 0.4)
            out.append((" ".join(["göwéi" + rng.choice(tails) for _ in range(held)] + [text]), y))
        return out

    train, test = rows(800, 5), rows(300, 6)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    scores = toxicity.scores(model, *utf8(pa.array([t for t, _ in test])))
    y = np.array([y for _, y in test])
    assert (scores[y == 1] >= toxicity.THRESHOLD).mean() > 0.95 and (scores[y == 0] < toxicity.THRESHOLD).mean() > 0.95


def test_calibration_is_the_best_with_weights_not_below_zero():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = (x @ [2.0, -1.0, 0.5, 0.0] + rng.logistic(size=500) > 1).astype(int)
    w, level = toxicity._calibrated(x, y, np.ones(500), 0.0)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (np.logaddexp(0, z) - y * z).sum() + 5e-3 * v @ v

    best = np.append(w, level)
    assert (w >= 0).all() and w[1] == 0
    for _ in range(300):
        other = best + rng.normal(size=5) * rng.choice([1e-3, 1e-2, 0.3])
        other[:-1] = np.maximum(other[:-1], 0)
        assert loss(other) >= loss(best) - 1e-6


def test_one_insult_in_a_copied_family_is_no_landmark():
    rows = insult_rows(["grumblor", "fizwick"], 300)
    template = "some lines of a form letter that are copied again and again with other words all over the place " * 2
    rows += [(template + f"n{k}", 1) for k in range(40)]
    assert len(toxicity.choose_landmarks([t for t, _ in rows], [y for _, y in rows])) <= 4


def test_the_fitting_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i % 2 else 10)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    every = fold("doc_id", 4) >= 0
    assert len(labelled_sample(docs, labels, "toxic", every, 100)[0]) == 60
    assert len(labelled_sample(docs.unionByName(docs), labels, "toxic", every, 25)[0]) <= 25
    assert 8000 < sum(map(len, labelled_sample(docs, labels, "toxic", every, 100, most_bytes=10_000)[0])) <= 10_000
    assert labelled_sample(docs.limit(0), labels, "toxic", every, 100) == ([], [])
