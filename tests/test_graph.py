import pytest
from pyspark.sql import functions as F

from cairnspark.operators import duplicates, evaluate, graph, search, usage
from cairnspark.sources import reports as sources
from cairnspark.sources.store import GraphStore, VersionConflict
from cairnspark.streaming import upkeep


def contributions(spark):
    sequence = spark.createDataFrame([("report--a", 1, "a.pdf"), ("report--b", 2, "b.pdf")], "report_id string, ingest_seq long, filename string")
    entities = spark.createDataFrame(
        [("report--a", "threat-actor", "APT 21", ["Panda"], ["d1"], ["q1"], 1), ("report--a", "malware", "Akira", [], [], ["q2"], 2), ("report--b", "threat-actor", "APT-21", [], ["d2"], ["q3"], 1), ("report--b", "indicator", "45.66.77.88", [], [], [], 2)],
        "report_id string, type string, name string, aliases array<string>, descriptions array<string>, evidence array<string>, ordinal int",
    )
    indicators = spark.createDataFrame([("report--a", "ipv4", "45.66.77.88", [1], ["c1", "c2", "c3"], []), ("report--b", "ipv4", "45.66.77.88", [], ["c9"], ["private_ip"])], "report_id string, type string, value string, pages array<int>, contexts array<string>, flags array<string>")
    relations = spark.createDataFrame([("report--a", "panda", "uses", "Akira", ["e1"]), ("report--a", "Akira", "communicates-with", "45.66.77.88", ["e2"]), ("report--b", "apt-21", "uses", "nobody", ["e3"])], "report_id string, source string, relation string, target string, evidence array<string>")
    node = graph.indicator_contributions(indicators, sequence).unionByName(graph.entity_contributions(entities, sequence, indicators)).unionByName(graph.report_contributions(sequence))
    return node, graph.reported_edges(node).unionByName(graph.resolve_relationships(relations, entities, node))


def test_merge_remove_and_read(spark):
    node, edge = contributions(spark)
    nodes = {r.node_id: r for r in graph.nodes(node).collect()}
    actor = nodes["threat-actor--apt21"]
    assert set(nodes) == {"threat-actor--apt21", "malware--akira", "indicator--ipv4--45.66.77.88", "report--a", "report--b"}
    assert (actor.name, actor.aliases, actor.reports, [e.quote for e in actor.evidence], [d.text for d in actor.descriptions]) == ("APT 21", ["Panda", "APT-21"], ["report--a", "report--b"], ["q3", "q1"], ["d1", "d2"])
    facts = {r.node_id: r for r in graph.node_facts(node).collect()}
    assert (facts["threat-actor--apt21"].n_reports, facts["threat-actor--apt21"].n_evidence) == (2, 2) and set(facts) == set(nodes)
    assert {r.report_id: r.entities for r in graph.entity_counts(node).collect()} == {"report--a": 3, "report--b": 2}
    assert nodes["indicator--ipv4--45.66.77.88"].flags == ["private_ip"]
    edges = {(r.src, r.dst, r.relation) for r in graph.edges(edge).collect()}
    assert ("threat-actor--apt21", "malware--akira", "uses") in edges and ("malware--akira", "indicator--ipv4--45.66.77.88", "communicates-with") in edges and len(edges) == 7
    again = graph.replace_reports(node, node.filter("report_id = 'report--a'"))
    assert sorted(map(str, graph.nodes(again).collect())) == sorted(map(str, graph.nodes(node).collect()))
    left = {r.node_id for r in graph.nodes(graph.remove_reports(node, spark.createDataFrame([("report--a",)], "report_id string"))).collect()}
    assert left == {"threat-actor--apt21", "indicator--ipv4--45.66.77.88", "report--b"}
    full, links = graph.nodes(node), graph.edges(edge)
    near = {r.node_id: r.depth for r in graph.neighborhood(spark, full, links, "malware--akira", 2).collect()}
    assert near == {"malware--akira": 0, "threat-actor--apt21": 1, "indicator--ipv4--45.66.77.88": 1}
    assert [r.node_id for r in graph.query_by_name(full, links, "Panda").collect()] == ["threat-actor--apt21"] == [r.node_id for r in graph.query_by_name(full, links, "apt 021").collect()]
    assert {r.type: r.nodes for r in graph.stats(full, links).collect()}[None] == 5
    assert graph.induced(links, full.filter("type <> 'report'")).count() == 2
    lone = graph.neighborhood(spark, full, links.filter("relation = 'reported-in'"), "malware--akira", 1)
    assert {r.node_id for r in lone.collect()} == {"malware--akira", "report--a"}
    changed = {r.type: (r.new_nodes, r.updated_nodes, r.removed_nodes) for r in graph.merge_stats(full.limit(0), full).collect()}
    assert changed["report"] == (2, 0, 0)


def test_store_conflict_backups_restore(spark, tmp_path):
    schema = {"nodes": graph.NODE}
    node = contributions(spark)[0]
    store = GraphStore(spark, f"file://{tmp_path}/g", keep=2)
    assert store.load("nodes", graph.NODE).count() == 0
    assert store.save({"nodes": node}, 0) == 1
    with pytest.raises(VersionConflict):
        store.save({"nodes": node}, 0)
    for _ in range(3):
        store.update(schema, lambda t: {"nodes": t["nodes"]})
    assert store.versions() == [4, 3, 2]
    assert store.restore(3, schema) == 5 and store.load("nodes", graph.NODE).count() == node.count()


def test_streams(spark, tmp_path):
    node = contributions(spark)[0]
    node.filter("report_id = 'report--a'").write.parquet(str(tmp_path / "in"))
    node.filter("report_id = 'report--b'").write.mode("append").parquet(str(tmp_path / "in"))
    store = GraphStore(spark, f"file://{tmp_path}/g")
    upkeep.maintain_graph(spark.readStream.schema(graph.NODE).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert store.load("nodes", graph.NODE).count() == node.count()
    rows = [("d1", i, "report", 0.5) for i in range(6)] + [("d2", 9, "agent", 0.1)]
    spark.createDataFrame(rows, "day string, seq long, kind string, cost double").coalesce(1).write.parquet(str(tmp_path / "req"))
    stream = upkeep.admit_stream(spark.readStream.schema("day string, seq long, kind string, cost double").parquet(str(tmp_path / "req")), 3, 5, 2.0)
    stream.writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select * from admitted where admitted").groupBy("day").count().orderBy("day").collect() == [("d1", 3), ("d2", 1)]


def test_caps(spark):
    rows = [("d", i, "report", c) for i, c in enumerate([0.9, 0.9, 0.5, 0.2, 0.1])] + [("e", i, "agent", 0.0) for i in range(7)]
    made = usage.admit(spark.createDataFrame(rows, "day string, seq int, kind string, cost double"))
    assert [r.admitted for r in made.filter("day = 'd'").orderBy("seq").collect()] == [True, True, False, True, False]
    assert {r.day: (r.reports, r.agent_runs, r.spend_usd) for r in usage.daily(made).collect()} == {"d": (3, 0, 2.0), "e": (0, 5, 0.0)}
    settled = usage.admit(spark.createDataFrame([("d", 0, "report", 1.9), ("d", 1, "report", 0.5), ("d", 2, "settle", -1.0), ("d", 3, "report", 0.5), ("d", 4, "settle", -9.0)], "day string, seq int, kind string, cost double"))
    assert [(r.admitted, r.spend_after) for r in settled.orderBy("seq").collect()] == [(True, 1.9), (False, 1.9), (True, 0.9), (True, 1.4), (True, 0.0)]
    day = usage.Day(spend=0.5)
    day.settle(-0.7)
    assert day.spend == 0.0


def test_search_and_duplicates(spark):
    reports = spark.createDataFrame([("r", ["The Akira ransomware encrypts files on hosts quickly.\n\nNothing to see in this other paragraph at all here.\n\nshort"])], "report_id string, pages array<string>")
    assert [r.text[:9] for r in search.search_passages(reports, "akira ransomware").collect()] == ["The Akira"]
    assert search.search_passages(reports, "!!!").collect() == []
    technique = spark.createDataFrame([("T1053", "Scheduled Task", ["persistence"], "run tasks"), ("T1059", "Command Shell", ["execution"], "run shell commands"), ("T1003", "Dumping", ["access"], "credentials")], "id string, name string, tactics array<string>, description string")
    assert [r.id for r in search.lookup_techniques(technique, "see t1059 there").collect()] == ["T1059"] and search.lookup_techniques(technique, "shell commands").first().id == "T1059"
    assert duplicates.name_score("Akira", "Akira Ransomware") == 100 and duplicates.name_score("APT21 Group", "Group APT21") == 100 and duplicates.name_score("Akira", "Conti") < 60
    names = spark.createDataFrame([("a", "malware", "Akira"), ("b", "malware", "akira ransomware"), ("c", "tool", "Akira"), ("d", "indicator", "Akira")], "node_id string, type string, name string")
    assert [(r.left_id, r.right_id) for r in duplicates.possible_duplicates(names).collect()] == [("a", "b")] == [(r.left_id, r.right_id) for r in duplicates.possible_duplicates(names, exhaustive=True).collect()]


def test_evaluation(spark):
    truth = spark.createDataFrame([("md5", "a"), ("md5", "b"), ("url", "u")], "type string, value string")
    found = {r.type: r for r in evaluate.compare(spark.createDataFrame([("md5", "a"), ("md5", "c"), ("ipv4", "x")], "type string, value string"), truth).collect()}
    assert (found["md5"].tp, found["md5"].fp, found["md5"].fn, found["md5"].precision) == (1, 1, 1, 0.5) and found["url"].precision is None and (found[None].tp, found[None].fn) == (1, 2) and "ipv4" not in found


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><body><p>seen</p><p hidden>not</p></body></html>")
    (tmp_path / "b.pdf").write_text("no pdf")
    (tmp_path / "c.html").write_text("<div>" + "x" * 300)
    files, rejected = sources.load_files(spark, str(tmp_path), 200)
    assert {r.filename: r.reason for r in rejected.collect()} == {"b.pdf": "unknown or mismatched type", "c.html": "too large"}
    made, quarantine = sources.html_reports(files)
    assert made.first().pages == ["seen"] and quarantine.first()["items"][0].reason == "hidden_attribute"
    bundle = spark.read.json(spark.sparkContext.parallelize(['{"objects":[{"type":"attack-pattern","name":"B","description":"see [x](http://y) `z`","revoked":false,"external_references":[{"source_name":"mitre-attack","external_id":"T2"}],"kill_chain_phases":[{"kill_chain_name":"mitre-attack","phase_name":"p"}]},{"type":"attack-pattern","name":"A","revoked":true,"external_references":[{"source_name":"mitre-attack","external_id":"T1"}]},{"type":"indicator","pattern":"[ipv4-addr:value = \'1.2.3.4\'] OR [file:hashes.MD5 = \'d41d8cd98f00b204e9800998ecf8427e\']"},{"type":"vulnerability","name":"CVE-2024-1234"}]}']))
    assert [(r.id, r.tactics, r.description) for r in sources.techniques(bundle).collect()] == [("T2", ["p"], "see x z")]
    assert {(r.type, r.value) for r in sources.ground_truth(bundle).collect()} == {("ipv4", "1.2.3.4"), ("md5", "d41d8cd98f00b204e9800998ecf8427e"), ("cve", "CVE-2024-1234")}
    assert spark.range(1).select(sources.joined_pages(F.array(F.lit("a"), F.lit("b"))).alias("v")).first().v == "[[PAGE 1]]\na\n\n[[PAGE 2]]\nb"
