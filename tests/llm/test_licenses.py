import random

from cairnspark.llm import licenses


def brute(rows):
    out = []
    for i, text in rows:
        w = licenses.words(text or "")
        for name, template in licenses.TEMPLATES.items():
            t, s = set(licenses.shingles(licenses.words(template))), licenses.group_of(licenses.words(template))
            hits = [(len(t & set(licenses.shingles(w[a : a + 2 * s]))) / len(t), a) for a in range(0, len(w), s)]
            hits = [h for h in hits if h[0] >= 0.8]
            if hits:
                out.append((i, name, len(hits), round(max(h[0] for h in hits), 9), min(h[1] for h in hits)))
    return sorted(out)


def test_bands_hardly_ever_miss():
    assert max(licenses.miss(t) for t in licenses.TEMPLATES.values()) < licenses.MISS


def test_anchors_cover_every_match():
    chosen = set(licenses.anchor_words(licenses.TEMPLATES))
    for text in licenses.TEMPLATES.values():
        own = licenses.shingles(licenses.words(text))
        assert 100 * sum(not set(s.split()) & chosen for s in own) < 80 * len(own)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(rng.choice(["the", "of", "software", "license", "word", "and", "permission"]) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "license"), (3, noise(3000))]
    for name, text in licenses.TEMPLATES.items():
        w = text.split()
        rows.append((len(rows), noise(rng.randint(0, 300)) + ". " + text + "\n" + noise(rng.randint(0, 50))))
        rows.append((len(rows), " ".join(x for x in w if rng.random() > 0.02).upper()))
        rows.append((len(rows), " ".join(w[: len(w) // 2])))
        rows.append((len(rows), f"{text}\n{noise(800)}\n{text}"))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    found = sorted((r.doc_id, r.license, r.windows, round(r.containment, 9), r.word) for r in licenses.scan_licenses(docs).collect())
    assert found == brute(rows) and len(found) > 25
    assert licenses.scan_licenses(docs.limit(0)).collect() == []
