import os
import random

import pytest
from pyspark.sql import functions as F

from cairnspark.llm import extraction
from cairnspark.llm.extraction import blocks, extract, shared

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="ad">buy <div>this</div> now</div><article><h1>Head &amp; line</h1><p><b>One
 two<br>three<p>Four &middot; five <!-- gone --> six</p><div class="comments"><p>reader</p></div><aside>side</aside></article><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Head & line\nOne two three\nFour · five six"),
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<article><p>cut &am", "cut &am"),
        ("<article>a</article><p>b</p><main><p>c</p></main>", "a\nc"),
        ("<body><header>h</header><p>x<p>y<form><p>no</p></form><p hidden>z</p><p style='display:none'>w</p>", "x\ny"),
        ("<article><p title='a > b'>q</p><script>if (a</script>r</article>", "q\nr"),
        ("<div>&lt;p&gt; &nbsp; &#65;&#x42;</div>", "<p> AB"),
    ],
)
def test_blocks(page, text):
    assert extract(page, None) == text


def test_shared_is_the_longest_common_subsequence():
    assert shared(list("abcxdy"), list("zabqcd")) == [True, True, True, False, True, False]
    assert shared([], ["a"]) == [] and shared(["a"], []) == [False]


def test_bare_pages_lose_what_they_share_with_their_neighbour(spark):
    page = lambda body: f"<body><p>Welcome</p><p>{body}</p><p>All rights</p></body>"
    rows = [(1, "http://h.org/a/1", page("one")), (2, "http://h.org/a/2", page("two")), (3, "http://other.org/a", page("three")), (4, "http://h.org/b", PAGE), (5, None, page("five")), (None, "http://h.org/a/3", None), (6, "http://x.org/1", "<p>same</p>"), (7, "http://x.org/2", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, other string")
    found = {r.page_id: (r.text, r.n_chars) for r in extraction.extract_pages(pages).collect()}
    assert found[1] == ("one", 3) and found[2] == ("two", 3)
    assert found[3][0] == "Welcome\nthree\nAll rights" == found[5][0].replace("five", "three")
    assert found[4][0].startswith("Head & line") and found[None] == ("", 0)
    assert found[6][0] == "same" == found[7][0]


def test_large_hosts_are_divided(spark, monkeypatch):
    monkeypatch.setattr(extraction, "TOGETHER", 150)
    pages = spark.createDataFrame([(i, f"http://h.org/en/{i:04d}", "x") for i in range(200)], "page_id long, url string, html string")
    pairs = {r.id: r.partner for r in extraction.partners(pages, "page_id", "url").collect()}
    assert len(pairs) == 200 and all(abs(a - b) == 1 for a, b in pairs.items())
    assert extraction.extract_pages(pages.filter(F.lit(False))).collect() == []


def test_partners_do_not_depend_on_the_size_of_a_host(spark, monkeypatch):
    paths = [f"/{c}{c}{c}{c}{c}/{i}" for c in "abcdefgh" for i in range(3)] + ["/zebra", "/yak/long/way", "/lone"]
    pages = spark.createDataFrame([(i, "http://h.org" + p, "x") for i, p in enumerate(paths)] * 2 + [(99, "http://other.org/aaaaa/0", "x")], "page_id long, url string, html string")
    want = {}
    order = sorted((p, i) for i, p in enumerate(paths))
    common = lambda a, b: len(os.path.commonprefix([a, b]))
    for k, (p, i) in enumerate(order):
        beside = [(common(p, q), -n, j) for n, (q, j) in enumerate(order[max(0, k - 1) : k] + order[k + 1 : k + 2])]
        want[i] = max(beside)[2]
    assert want[3] == 4  # the first page of a folder goes with the second, not with the folder before
    for together in (5, 1000):
        monkeypatch.setattr(extraction, "TOGETHER", together)
        assert {r.id: r.partner for r in extraction.partners(pages, "page_id", "url").collect()} == want


def test_body_of_blocks_flags():
    assert blocks("<main><p>a</p></main>") == (["a"], True) and blocks("<p>a</p>") == (["a"], False)


def brute_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [4_000_000, 6])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(extraction, "CELLS", cells)
    rng = random.Random(2)
    for _ in range(200):
        a, b = (["abcdef"[rng.randrange(6)] for _ in range(rng.randrange(14))] for _ in range(2))
        marked = [x for x, s in zip(a, extraction.shared(a, b)) if s]
        rest = iter(b)
        assert all(x in rest for x in marked) and len(marked) == brute_length(a, b)


def test_pages_of_very_many_lines():
    own = [f"line {i}" if i % 3 else "same" for i in range(9000)]
    other = [f"line {i}" if i % 2 else "same" for i in range(9000)]
    marked = extraction.shared(own, other)
    assert sum(marked) >= 3000 and not any(s for x, s in zip(own, marked) if x != "same" and x not in other)


def test_broken_quotes_and_hyphenated_names():
    page = "<article><a href=\"foo>x</a><p>hello</p><div class='ad-slot big'>buy</div><div class='related-posts'>more</div><p class='adage'>b</p></article>"
    assert extraction.extract(page, None) == "x\nhello\nb"
    assert extraction.extract('<p title="a > b">one</p><p title=\'c > d\'>two</p>', None) == "one\ntwo"


def test_differencing_against_brute_force_on_bare_pages(spark):
    """Pages without article or main: every line that is in the longest common subsequence with the nearest page goes."""
    rng = random.Random(8)
    menu = [f"menu {i}" for i in range(6)]
    rows = []
    for k in range(40):
        lines = menu[: rng.randint(3, 6)] + [f"text {k} {i}" for i in range(rng.randint(1, 5))] + ["imprint"]
        rows.append((k, f"http://h{k % 2}.example/a{k:03d}", "".join(f"<p>{x}</p>" for x in lines), lines))
    found = {r.page_id: r.text for r in extraction.extract_pages(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    for k, url, _, lines in rows:
        near = [r for r in rows if r[0] % 2 == k % 2 and abs(r[0] - k) == 2]
        prefix = lambda u, v: next((i for i, (x, y) in enumerate(zip(u, v)) if x != y), min(len(u), len(v)))
        partner = max(near, key=lambda r: (prefix(r[1], url), -r[0]))
        assert found[k] == "\n".join(x for x in lines if x not in partner[3])


def test_pages_that_only_name_an_article_are_differenced(spark):
    """A comment, a script or an empty element holds no article: what such pages share with their neighbour goes."""
    named = ["<!-- <article> -->", "<script>var t = '<article>'</script>", "<main id=app></main>", "<article> <img src=x></article>"]
    page = lambda k: f"<body>{named[k % 4]}<p>Welcome</p><p>text {k}</p><p>All rights</p></body>"
    pages = spark.createDataFrame([(k, f"http://h.org/a/{k}", page(k)) for k in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extraction.extract_pages(pages).collect()} == {k: f"text {k}" for k in range(8)}


def test_every_page_is_aligned_with_its_neighbour_and_then_checked_by_roles(spark):
    """Against brute force on pages with and without an article: a longest common subsequence over all lines, menus included, goes;
    lines of an article come back, what boilerplate is left by it goes."""
    rng = random.Random(4)
    wrap = {extraction.ASIDE: "<nav><p>{}</p></nav>", extraction.OPEN: "<p>{}</p>", extraction.INSIDE: "<article><p>{}</p></article>"}
    rows = []
    for k in range(60):
        roles = [extraction.ASIDE, extraction.OPEN] + [extraction.INSIDE] * (k % 3 == 0)
        lines = [(rng.choice(["menu", "imprint", "claim"]) if rng.random() < 0.4 else f"text {k} {i}", rng.choice(roles)) for i in range(rng.randint(1, 7))]
        rows.append((k, f"http://h{k % 2}.example/a{k:03d}", "".join(wrap[role].format(t) for t, role in lines), lines))
    found = {r.page_id: r.text for r in extraction.extract_pages(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    pairs = {r.id: r.partner for r in extraction.partners(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"), "page_id", "url").collect()}
    assert len(pairs) == 60
    for k, _, page, lines in rows:
        assert extraction.page_lines(page) == lines
        own, other = [t for t, _ in lines], [t for t, _ in rows[pairs[k]][3]]
        deleted, i, j = set(), 0, 0
        while i < len(own) and j < len(other):  # of equal choices the earliest lines
            if own[i] == other[j]:
                deleted.add(i)
                i, j = i + 1, j + 1
            elif brute_length(own[i:], other[j + 1 :]) == brute_length(own[i:], other[j:]):
                j += 1
            else:
                i += 1
        assert len(deleted) == brute_length(own, other)
        article = [t for t, role in lines if role == extraction.INSIDE]
        rest = [t for t, role in lines if role == extraction.OPEN]
        assert found[k] == "\n".join(article or [t for i, (t, role) in enumerate(lines) if role == extraction.OPEN and i not in deleted] or rest)


def test_rows_without_id_or_with_a_repeated_one(spark):
    rows = [(None, "http://h.org/1", "<p>a</p><p>b</p>"), (None, None, None), (1, "http://h.org/2", "<p>a</p><p>c</p>"), (1, "http://h.org/2", "<p>a</p><p>c</p>"), (2, "http://h.org/3", "<nav>a</nav><p>d</p>")]
    found = extraction.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string"))
    assert sorted((r.page_id or 0, r.text) for r in found.collect()) == [(0, ""), (0, "a\nb"), (1, "c"), (1, "c"), (2, "d")]
    assert found.schema["page_id"].dataType.simpleString() == "int"


def test_twins_of_very_many_lines_take_no_table(monkeypatch):
    monkeypatch.setattr(extraction, "_lengths", None)  # not called
    lines = [f"line {i}" for i in range(50_000)]
    assert all(extraction.shared(lines, lines)) and sum(extraction.shared(["own"] + lines, lines + ["end"])) == 50_000
