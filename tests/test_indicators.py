import pytest
from pyspark.sql import functions as F

from cairnspark.functions import text
from cairnspark.operators import indicators, repair, sections

MD5, SHA1 = "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709"
SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SHA512 = "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e"
REPORT = "report_id string, pages array<string>, tables array<array<array<string>>>"


def extract(spark, pages, tables=()):
    rows = indicators.extract_indicators(spark.createDataFrame([("r", list(pages), [list(map(list, t)) for t in tables])], REPORT)).collect()
    return {(r.type, r.value): r for r in rows}


def many(spark, cases):
    """Each text as a report of one page; the result by case."""
    rows = indicators.extract_indicators(spark.createDataFrame([(str(i), [t], []) for i, t in enumerate(cases)], REPORT)).collect()
    out = [{} for _ in cases]
    for r in rows:
        out[int(r.report_id)][(r.type, r.value)] = r
    return out


def test_spellings_and_shapes(spark):
    cases = [
        "Beacon to hxxp://EVIL[.]com/Path/File.EXE now.", "Contacted hxxps://bad(.)org repeatedly.", "Traffic to 192.168[.]1[.]1 was observed.", "Note lists user[at]evil[.]com as contact.",
        "The domain evil[dot]net resolved.", f"Malware hashes: {MD5} {SHA1} {SHA256} {SHA512}", f"Blob 0011223344556677{SHA256}8899aabbccddeeff", "Blob " + "aabbccddeeff00112233445566778899" * 2 + "aabbccddeeff0011",
        f"Sample {SHA256.upper()}", "cve-2024-3400 and 2001:DB8::1", "see http://evil.com/a only", "see http://evil.com/a and evil.com", "mail bob@evil.com only",
    ]
    found = many(spark, cases)
    assert ("url", "http://evil.com/Path/File.EXE") in found[0]
    assert found[1][("url", "https://bad.org")].original_forms == ["hxxps://bad(.)org"]
    assert found[2][("ipv4", "192.168.1.1")].original_forms == ["192.168[.]1[.]1"] and found[2][("ipv4", "192.168.1.1")].flags == ["private_ip"]
    assert found[3][("email", "user@evil.com")].original_forms == ["user[at]evil[.]com"]
    assert found[4][("domain", "evil.net")].original_forms == ["evil[dot]net"]
    assert {("md5", MD5), ("sha1", SHA1), ("sha256", SHA256), ("sha512", SHA512)} <= set(found[5])
    assert not found[6] and not found[7]
    assert ("sha256", SHA256) in found[8]
    assert {("cve", "CVE-2024-3400"), ("ipv6", "2001:db8::1")} <= set(found[9])
    assert ("domain", "evil.com") not in found[10] and ("domain", "evil.com") in found[11] and ("domain", "evil.com") in found[12]


def test_flags(spark):
    cases = ["10.0.0.5 seen", "127.0.0.1 seen", "203.0.113.9 seen", "45.66.77.88 seen", "product version 4.3.2.1 shipped", "www.google.com here", "evil-unknown.com here", "payload.zip here", SHA256, f"malware hash {SHA256}", f"{SHA256}\n{'b' * 64}", "240.0.0.1 x", "224.0.0.1 x"]
    flags = [[f for r in found.values() for f in r.flags] for found in many(spark, cases)]
    assert flags[:8] == [["private_ip"], ["loopback"], ["documentation_ip"], [], ["possible_version_number"], ["benign_domain"], [], ["filename_like_domain"]]
    assert flags[8] == ["hash_without_context"] and flags[9] == [] and flags[10] == []
    assert flags[11] == ["private_ip", "reserved_ip"] and flags[12] == ["reserved_ip"]


def test_publisher_needs_floor_and_share(spark):
    three = extract(spark, ["http://a.vendor.io/1 http://vendor.io/2 http://b.vendor.io/3 and vendor.io itself"])
    assert three[("domain", "vendor.io")].flags == ["benign_domain"]
    four = extract(spark, ["http://a.io/1 http://b.io/2 http://c.io/3 http://d.io/4 and a.io itself"])
    assert four[("domain", "a.io")].flags == []


def test_pages_tables_and_contexts(spark):
    found = extract(spark, ["first 45.66.77.88 here", "again 45.66.77[.]88 there"], [[["45.66.77.99", "x"]]])
    one = found[("ipv4", "45.66.77.88")]
    assert (one.occurrences, one.pages, one.original_forms) == (2, [1, 2], ["45.66.77.88", "45.66.77[.]88"])
    assert one.contexts == ["first 45.66.77.88 here", "again 45.66.77[.]88 there"]
    assert found[("ipv4", "45.66.77.99")].pages == [] and not found[("ipv4", "45.66.77.99")].in_ioc_section


@pytest.mark.parametrize(
    ("pages", "expected"),
    [
        (["Executive Summary\n\nThis report describes activity.", "Technical Analysis\n\nThe actor used binaries.", "Indicators of Compromise\n\nThe following were observed.\n45.66.77.88"], [3]),
        (["IOCs\n\n45.66.77.88\n\nMitigations\n\nApply patches promptly.", "References\n\nSee the vendor advisory for more detail."], [1]),
        (["Indicators of Compromise\n\nSome preamble text here.\nNetwork Indicators\n\n45.66.77.88\nHost-Based Indicators\n\n" + SHA256], [1]),
        (["This page contains ordinary prose. " * 20] * 2 + [" ".join(f"45.66.77.{n}" for n in range(1, 40))] + ["This page contains ordinary prose. " * 20], [3]),
        (["Just prose.", "More prose with no indicators at all."], []),
    ],
)
def test_sections(spark, pages, expected):
    assert sections.section_pages(spark.createDataFrame([("r", pages, [])], REPORT)).first().pages == expected


def test_repair():
    a, b = SHA256[:43], SHA256[43:]
    assert repair.rejoin_wrapped_hashes(f"x {a}\n{b} y") == f"x {SHA256} y"
    assert repair.segment([SHA256[:40], SHA256[40:]]) == [SHA256]
    assert repair.segment([SHA256, "b" * 64]) is None
    assert repair.segment(["a" * 43, "b" * 43, "c" * 42]) == ["a" * 43 + "b" * 43 + "c" * 42]
    assert repair.segment(["a" * 10, "b" * 15]) is None


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert [one(text.refang(F.lit(x))) for x in ("hxxp://evil[.]com/path", "hxxps://bad(.)org", "192.168[.]1[.]1", "evil[dot]net", "user[at]evil[.]com")] == ["http://evil.com/path", "https://bad.org", "192.168.1.1", "evil.net", "user@evil.com"]
    assert one(text.defang(F.lit("http://a.b/x@y"), F.lit("url"))) == "hxxp://a[.]b/x[at]y" and one(text.defang(F.lit("ab.c"), F.lit("md5"))) == "ab.c"
    for name in ("APT21", "APT 21", "APT-21", "apt21", "APT_21", "apt 021"):
        assert one(text.normalize_key(F.lit("threat-actor"), F.lit(name))) == "apt21"
    assert one(text.normalize_key(F.lit("vulnerability"), F.lit("CVE 2024 3400"))) == "cve-2024-3400"
    assert one(text.normalize_key(F.lit("attack-pattern"), F.lit("Scheduled Task (T1053)"))) == "t1053" and one(text.normalize_key(F.lit("attack-pattern"), F.lit("T1059.001"))) == "t1059.001"
    assert one(text.normalize_key(F.lit("threat-actor"), F.lit("BRONZE SILHOUETTE"), aliases={"bronze silhouette": "volt typhoon"})) == "volt typhoon"
    assert one(text.normalize_key(F.lit("malware"), F.lit("Akira."))) == "akira"
    assert one(text.grounding_form(F.lit("ﬁle “Quoted” broken-\nword – x  y"))) == 'file "quoted" brokenword - x y'
    assert one(text.strip_unsafe(F.lit("a ![x](http://e/?q) [b](http://c) <b>d</b>"))) == "a b d"
    assert one(text.normalize_url(F.lit("HTTP://EVIL.com:80/Path)."))) == "http://evil.com:80/Path" and one(text.normalize_url(F.lit("nothing"))) is None
    assert one(text.normalize_ipv4(F.lit("1.2.3.04"))) is None
    assert one(text.format_pages(F.array(F.lit(1), F.lit(3)))) == "1, 3" and one(text.truncate_words(F.lit("a b c"), 2)) == "a b…"


def test_table_function(spark):
    indicators.register_table_function(spark)
    spark.createDataFrame([(1, "see hxxp://evil[.]com/x and 45.66.77.88"), (2, None)], "id int, body string").createOrReplaceTempView("bodies")
    rows = spark.sql("SELECT id, i.type, i.value, i.start FROM bodies, LATERAL extract_indicators(body) i ORDER BY id, start, type DESC").collect()
    assert [tuple(r) for r in rows] == [(1, "url", "http://evil.com/x", 4), (1, "domain", "evil.com", 11), (1, "ipv4", "45.66.77.88", 28)]


def test_documents_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from cairnspark.plans.catalog import ORACLE_SQL, QUERIES

    texts = [
        "de " * 60 + "x", "Eded eded " * 25, "be " * 20, f"{SHA256[:43]}\n{SHA256[43:]}", f"{SHA1} by bob@evil.com from 45.66.77.88 and 230.1.1.1", "4465758382889437 4465758382889437", None,
        "the anhahe.cn Eres std::cout ad::be", "amy@evil.com, Bob@evil.com, bob@evil.com and evil.com; eve@corp.internal",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["indicators_documents"](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = base.execute(ORACLE_SQL["indicators_documents"])
    names = [c[0] for c in wanted.description]
    rows = sorted(tuple(r) for r in found.select(*names).collect())
    assert rows == sorted(wanted.fetchall()) and len(rows) == 10
