"""The knowledge graph as contributions: what each report says of each node and edge. Nodes and edges are aggregates over them, so
merging a report again replaces its rows and removing it drops them; nothing is ever un-merged from a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnspark.functions import fixed, text

NODE = "report_id string, ingest_seq long, node_id string, type string, name string, aliases array<string>, quotes array<struct<quote:string,page:int>>, descriptions array<string>, ioc_type string, flags array<string>"
EDGE = "report_id string, ingest_seq long, src string, dst string, relation string, evidence string, mode string"


def report_contributions(reports: DataFrame) -> DataFrame:
    """Reports (report_id, ingest_seq, filename) as nodes of their own."""
    empty = lambda kind: F.array().cast(kind)
    return reports.select(
        "report_id", "ingest_seq", F.col("report_id").alias("node_id"), F.lit("report").alias("type"), F.col("filename").alias("name"), empty("array<string>").alias("aliases"),
        empty("array<struct<quote:string,page:int>>").alias("quotes"), empty("array<string>").alias("descriptions"), F.lit(None).cast("string").alias("ioc_type"), empty("array<string>").alias("flags"),
    )


def indicator_contributions(indicators: DataFrame, sequence: DataFrame) -> DataFrame:
    """Every indicator is a node; its first two contexts, on its first page, are evidence."""
    page = F.get("pages", F.lit(0)).cast("int")
    return indicators.join(sequence.select("report_id", "ingest_seq"), "report_id").select(
        "report_id", "ingest_seq", text.node_id(F.lit("indicator"), text.normalize_key(F.lit("indicator"), F.col("value"), F.col("type"))).alias("node_id"), F.lit("indicator").alias("type"),
        F.col("value").alias("name"), F.array().cast("array<string>").alias("aliases"), F.transform(F.slice("contexts", 1, 2), lambda c: F.struct(c.alias("quote"), page.alias("page"))).alias("quotes"),
        F.array().cast("array<string>").alias("descriptions"), F.col("type").alias("ioc_type"), "flags",
    )


def entity_contributions(entities: DataFrame, sequence: DataFrame, indicators: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Merged entities (report_id, type, name, aliases, descriptions, evidence). An entity that is an indicator joins the node of
    the indicator that was found; without ``indicators`` it keeps a node apart, of unknown type."""
    rows = entities.join(sequence.select("report_id", "ingest_seq"), "report_id")
    if indicators is None:
        rows = rows.withColumn("ioc_type", F.lit(None).cast("string"))
    else:
        own = indicators.groupBy("report_id", F.lower("value").alias("_v")).agg(F.min("type").alias("ioc_type"))
        rows = rows.withColumn("_v", F.when(F.col("type") == "indicator", F.lower("name"))).join(own, ["report_id", "_v"], "left").drop("_v")
    key = text.normalize_key(F.col("type"), F.col("name"), F.col("ioc_type"), aliases)
    quotes = F.transform("evidence", lambda q: F.struct(q.alias("quote"), F.lit(None).cast("int").alias("page")))
    return rows.withColumn("_key", key).filter("_key <> ''").select("report_id", "ingest_seq", text.node_id(F.col("type"), F.col("_key")).alias("node_id"), "type", "name", "aliases", quotes.alias("quotes"), "descriptions", "ioc_type", F.array().cast("array<string>").alias("flags"))


def reported_edges(nodes: DataFrame, mode: str = "pipeline") -> DataFrame:
    return nodes.filter("type <> 'report'").select("report_id", "ingest_seq", F.col("node_id").alias("src"), F.col("report_id").alias("dst"), F.lit(fixed.REPORTED_IN).alias("relation"), F.lit("").alias("evidence"), F.lit(mode).alias("mode")).distinct()


def resolve_relationships(relationships: DataFrame, entities: DataFrame, contributions: DataFrame, mode: str = "pipeline", aliases: dict[str, str] | None = None) -> DataFrame:
    """Ends by name or alias of the report's entities, the first in order, or else by the value of an indicator."""
    named = contributions.filter("type <> 'report'").select("report_id", "node_id", "type", F.lower("name").alias("_n"))
    listed = entities.select("report_id", "ordinal", "type", "name", F.explode(F.array_union(F.array("name"), "aliases")).alias("_a"))
    by_name = listed.withColumn("_n", F.lower("name")).join(named, ["report_id", "type", "_n"]).groupBy("report_id", F.lower("_a").alias("_f")).agg(F.min_by("node_id", "ordinal").alias("_e"))
    by_value = named.filter("type = 'indicator'").groupBy("report_id", F.col("_n").alias("_f")).agg(F.min("node_id").alias("_i"))
    rows = relationships
    for end in ("source", "target"):
        rows = rows.withColumn("_f", F.lower(end)).join(by_name, ["report_id", "_f"], "left").join(by_value, ["report_id", "_f"], "left").withColumn(f"_{end}", F.coalesce("_e", "_i")).drop("_f", "_e", "_i")
    sequence = contributions.groupBy("report_id").agg(F.max("ingest_seq").alias("ingest_seq"))
    out = rows.filter("_source is not null and _target is not null").join(sequence, "report_id")
    return out.select("report_id", "ingest_seq", F.col("_source").alias("src"), F.col("_target").alias("dst"), "relation", F.coalesce(F.get("evidence", F.lit(0)), F.lit("")).alias("evidence"), F.lit(mode).alias("mode"))


# -- upkeep -------------------------------------------------------------------------------------


def replace_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contributions with those of the new rows' reports exchanged: merging twice is merging once."""
    return old.join(new.select("report_id").distinct(), "report_id", "left_anti").unionByName(new)


def remove_reports(contributions: DataFrame, gone: DataFrame) -> DataFrame:
    return contributions.join(gone.select("report_id").distinct(), "report_id", "left_anti")


def merge_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """New, kept and removed nodes by type, from two sets of nodes."""
    a, b = before.select("node_id", F.col("type").alias("_a")), after.select("node_id", F.col("type").alias("_b"))
    return a.join(b, "node_id", "full").groupBy(F.coalesce("_b", "_a").alias("type")).agg(F.count_if(F.col("_a").isNull()).alias("new_nodes"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("updated_nodes"), F.count_if(F.col("_b").isNull()).alias("removed_nodes"))


def contribution_hash(contributions: DataFrame) -> DataFrame:
    """(report_id, signature): equal signatures mean that a merge would change nothing."""
    return contributions.groupBy("report_id").agg(F.sum(F.xxhash64(*[c for c in contributions.columns if c != "ingest_seq"]).cast("decimal(38,0)")).alias("signature"))


# -- nodes and edges ----------------------------------------------------------------------------


def node_reports(contributions: DataFrame) -> DataFrame:
    """(node_id, report_id, first_seen): which reports a node stands in, as rows; a hot node's list may be too long for one."""
    return contributions.groupBy("node_id", "report_id").agg(F.min("ingest_seq").alias("first_seen"))


def node_facts(contributions: DataFrame) -> DataFrame:
    """Nodes without lists: type, first-seen name, indicator type, counts of reports and of kept quotes, first and last seen.
    Everything is summed up before the shuffle, so a node that a third of all reports mention costs no more than another."""
    order = F.struct("ingest_seq", "report_id")
    base = contributions.groupBy("node_id").agg(
        F.min(F.struct(order.alias("_o"), "type", "name")).alias("_f"), F.max(F.when(F.col("ioc_type").isNotNull(), F.struct(order.alias("_o"), "ioc_type"))).alias("_i"),
        F.min("ingest_seq").alias("first_seen"), F.max("ingest_seq").alias("last_seen"),
    )
    counted = node_reports(contributions).groupBy("node_id").agg(F.count("*").alias("n_reports"))
    quoted = _newest_quotes(contributions).groupBy("node_id").agg(F.count("*").alias("n_evidence"))
    out = base.join(counted, "node_id").join(quoted, "node_id", "left")
    return out.select("node_id", "_f.type", "_f.name", F.col("_i.ioc_type").alias("ioc_type"), "n_reports", F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"), "first_seen", "last_seen")


def _newest_quotes(contributions: DataFrame) -> DataFrame:
    """The NODE_EVIDENCE newest quotes of each node; the limit is applied before the shuffle as well as after."""
    quotes = contributions.select("node_id", "report_id", "ingest_seq", F.posexplode("quotes").alias("_i", "_q")).select("node_id", "report_id", "ingest_seq", "_i", "_q.*")
    once = quotes.groupBy("node_id", "report_id", "quote").agg(F.max("ingest_seq").alias("ingest_seq"), F.min(F.struct("_i", "page")).alias("_p")).select("node_id", "report_id", "quote", "ingest_seq", "_p.*")
    newest = Window.partitionBy("node_id").orderBy(F.desc("ingest_seq"), F.desc("report_id"), F.desc("_i"), "quote")
    return once.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= fixed.NODE_EVIDENCE)


def nodes(contributions: DataFrame) -> DataFrame:
    """Nodes whole, with their lists: other spellings as aliases, reports in order, newest evidence first, all descriptions. Each
    list is of distinct values found beforehand; where a node's reports are too many for one row, use node_facts and
    node_reports."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(c).alias("_v")))), lambda x: x["_v"])
    place = lambda spot: F.struct("ingest_seq", "report_id", spot.alias("_s"))
    spelled = contributions.select("node_id", "name", place(F.lit(-1)).alias("_o")).unionByName(
        contributions.select("node_id", "ingest_seq", "report_id", F.posexplode("aliases").alias("_s", "name")).select("node_id", "name", place(F.col("_s")).alias("_o"))
    )
    names = spelled.filter("name <> ''").groupBy("node_id", "name").agg(F.min("_o").alias("_o")).groupBy("node_id").agg(in_order("name").alias("_names"))
    reports = node_reports(contributions).withColumn("_o", F.struct("first_seen", "report_id")).groupBy("node_id").agg(in_order("report_id").alias("reports"))
    flags = contributions.filter(F.size("flags") > 0).groupBy("node_id").agg(F.max(F.struct("ingest_seq", "report_id", "flags")).alias("_g")).select("node_id", "_g.flags")
    entry = lambda *c: lambda x: F.struct(*[x[k].alias(k) for k in c])
    evidence = _newest_quotes(contributions).groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "report_id", "quote", "page"))), entry("report_id", "quote", "page")).alias("evidence"))
    said = contributions.select("node_id", "ingest_seq", "report_id", F.posexplode("descriptions").alias("_i", "text")).groupBy("node_id", "report_id", "text").agg(F.min(F.struct("ingest_seq", "_i")).alias("_o"))
    described = said.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "report_id", "text"))), entry("report_id", "text")).alias("descriptions"))
    out = node_facts(contributions)
    for side in (names, reports, flags, evidence, described):
        out = out.join(side, "node_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(
        "node_id", "type", "name", F.array_except(F.coalesce("_names", F.array().cast("array<string>")), F.array("name")).alias("aliases"), "reports",
        empty("evidence", "array<struct<report_id:string,quote:string,page:int>>"), empty("descriptions", "array<struct<report_id:string,text:string>>"), "ioc_type", empty("flags", "array<string>"), "first_seen", "last_seen",
    )


def edge_facts(contributions: DataFrame) -> DataFrame:
    """Edges (src, dst, relation) with how many reports support them."""
    once = contributions.groupBy("src", "dst", "relation", "report_id").agg(F.max("ingest_seq").alias("ingest_seq"))
    return once.groupBy("src", "dst", "relation").agg(F.count("*").alias("n_reports"))


def edges(contributions: DataFrame) -> DataFrame:
    """Edges (src, dst, relation) with the reports that support them, and their last evidence."""
    last = F.max(F.struct("ingest_seq", "report_id", "evidence", "mode")).alias("_l")
    return contributions.groupBy("src", "dst", "relation").agg(F.array_sort(F.collect_set("report_id")).alias("reports"), last).select("src", "dst", "relation", "reports", "_l.evidence", "_l.mode")


def edges_last_writer(contributions: DataFrame) -> DataFrame:
    """Edges that keep their last report only, as a store keyed by (src, dst, relation) would."""
    last = F.max(F.struct("ingest_seq", "report_id", "evidence", "mode")).alias("_l")
    return contributions.groupBy("src", "dst", "relation").agg(last).select("src", "dst", "relation", "_l.report_id", "_l.evidence", "_l.mode")


# -- reading ------------------------------------------------------------------------------------


def stats(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Node counts by type, with the grand total as type null and the number of edges beside it."""
    counted = node.rollup("type").agg(F.count("*").alias("nodes"))
    return counted.crossJoin(edge.agg(F.count("*").alias("edges")))


def degrees(node: DataFrame, edge: DataFrame) -> DataFrame:
    ends = edge.select(F.col("src").alias("node_id")).unionByName(edge.select(F.col("dst").alias("node_id")))
    return node.join(ends.groupBy("node_id").agg(F.count("*").alias("_d")), "node_id", "left").select("node_id", "type", "name", "first_seen", F.coalesce("_d", F.lit(0)).cast("long").alias("degree"))


def top_degree(node: DataFrame, edge: DataFrame, limit: int = 50, reports: bool = False) -> DataFrame:
    rows = degrees(node, edge)
    return (rows if reports else rows.filter("type <> 'report'")).orderBy(F.desc("degree"), "first_seen", "node_id").limit(limit)


def both_ways(edge: DataFrame) -> DataFrame:
    columns = ["relation", *[c for c in edge.columns if c not in ("src", "dst", "relation")]]
    out = edge.select(F.col("src").alias("node_id"), F.col("dst").alias("other_id"), F.lit("out").alias("direction"), *columns)
    return out.unionByName(edge.select(F.col("dst").alias("node_id"), F.col("src").alias("other_id"), F.lit("in").alias("direction"), *columns))


def node_relationships(node: DataFrame, edge: DataFrame, ids: Column) -> DataFrame:
    """Edges of the chosen nodes (``ids`` over node_id) in both directions, without reported-in, with the other end's name and type."""
    rows = both_ways(edge).filter((F.col("relation") != fixed.REPORTED_IN) & ids)
    return rows.join(node.select(F.col("node_id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type")), "other_id", "left")


def related_indicators(node: DataFrame, edge: DataFrame, ids: Column) -> DataFrame:
    rows = both_ways(edge).filter(ids).select("node_id", "other_id").distinct()
    found = node.filter("type = 'indicator'").select(F.col("node_id").alias("other_id"), "name", "ioc_type", *[c for c in node.columns if c == "flags"])
    return rows.join(found, "other_id").withColumnRenamed("other_id", "indicator_id")


def neighborhood(spark: SparkSession, node: DataFrame, edge: DataFrame, center: str, depth: int = 1, most: int = 150, reports: bool = False) -> DataFrame:
    """(node_id, depth) around one node, nearest first; hops are joins, one for each level. A center that only reports touch is
    shown with them."""
    known = node.select("node_id", "type")
    links = both_ways(edge).select("node_id", "other_id").distinct()

    def walk(with_reports: bool) -> DataFrame:
        allowed = known if with_reports else known.filter("type <> 'report'")
        seen = known.filter(F.col("node_id") == center).select("node_id", F.lit(0).alias("depth"))
        front = seen.select("node_id")
        for level in range(1, max(1, depth) + 1):
            near = links.join(front, "node_id").select(F.col("other_id").alias("node_id")).distinct()
            front = near.join(allowed.select("node_id"), "node_id").join(seen.select("node_id"), "node_id", "left_anti")
            seen = seen.unionByName(front.select("node_id", F.lit(level).alias("depth")))
        return seen

    found = walk(reports)
    if not reports and found.limit(2).count() == 1:
        found = walk(True)
    return found.orderBy("depth", "node_id").limit(most)


def induced(edge: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen nodes."""
    ids = chosen.select("node_id")
    return edge.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def query_by_name(node: DataFrame, edge: DataFrame, name: str, neighbours: int = 15, quotes: int = 2, quote_chars: int = 200) -> DataFrame:
    """The node that a name means, by its keys in type order and then by name or alias, with neighbours and quotes."""
    keys = [text.node_id(F.lit(t), text.normalize_key(F.lit(t), F.lit(name))) for t in fixed.ENTITY_TYPES if t != "indicator"]
    keys += [text.node_id(F.lit("indicator"), text.normalize_key(F.lit("indicator"), F.lit(name), F.lit(t))) for t in fixed.INDICATOR_TYPES]
    folded = name.lower()
    rank = F.coalesce(*[F.when(F.col("node_id") == k, i) for i, k in enumerate(keys)], F.when((F.lower("name") == folded) | F.exists("aliases", lambda a: F.lower(a) == folded), len(keys)))
    hit = node.withColumn("_r", rank).filter("_r is not null and type <> 'report'").orderBy("_r", "first_seen", "node_id").limit(1)
    near = both_ways(edge).filter(F.col("relation") != fixed.REPORTED_IN).join(hit.select("node_id"), "node_id").join(node.select(F.col("node_id").alias("other_id"), F.col("name").alias("_n")), "other_id")
    listed = near.groupBy("node_id").agg(F.slice(F.array_sort(F.collect_set(F.concat_ws(" ", "direction", "relation", "_n"))), 1, neighbours).alias("neighbours"))
    said = F.transform(F.slice("evidence", 1, quotes), lambda e: F.substring(e["quote"], 1, quote_chars))
    return hit.join(listed, "node_id", "left").select("node_id", "type", "name", "aliases", "reports", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"), said.alias("quotes"))


def entity_counts(contributions: DataFrame) -> DataFrame:
    """Nodes that each report contributes to."""
    return contributions.filter("type <> 'report'").select("report_id", "node_id").distinct().groupBy("report_id").agg(F.count("*").alias("entities"))


def same_name_types(node: DataFrame) -> DataFrame:
    """Names that nodes of several types carry."""
    named = node.filter("type not in ('report', 'indicator')").groupBy(F.lower(F.trim("name")).alias("name")).agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("nodes"))
    return named.filter(F.size("types") > 1)


def summary_inputs(node: DataFrame) -> DataFrame:
    """Quotes and descriptions that a summary may use, and the digest that says whether a stored one is current."""
    quotes = F.filter(F.transform(F.slice("evidence", 1, fixed.SUMMARY_EVIDENCE), lambda e: e["quote"]), lambda q: F.coalesce(q != "", F.lit(False)))
    said = F.filter(F.transform("descriptions", lambda d: d["text"]), lambda t: F.coalesce(t != "", F.lit(False)))
    return node.select("node_id", quotes.alias("quotes"), said.alias("descriptions"), text.evidence_hash(quotes, said).alias("evidence_hash"))


def graph_json(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Node-link lines: one JSON object per node and per edge, for a text sink."""
    return node.select(F.to_json(F.struct(F.lit("node").alias("kind"), *node.columns)).alias("value")).unionByName(edge.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edge.columns)).alias("value")))


def read_graph_json(lines: DataFrame, node_schema: StructType, edge_schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Lines of ``graph_json`` back to (nodes, edges); lines that are neither are passed over."""
    kind = F.get_json_object("value", "$.kind")
    of = lambda name, schema: lines.filter(kind == name).select(F.from_json("value", schema).alias("_x")).select("_x.*")
    return of("node", node_schema), of("edge", edge_schema)


def list_reports(contributions: DataFrame, limit: int | None = None) -> DataFrame:
    """(report_id, name, ingest_seq) of the merged reports, newest first; of reports merged at once the greater id first."""
    reports = contributions.filter("type = 'report'").groupBy("report_id").agg(F.max_by("name", "ingest_seq").alias("name"), F.max("ingest_seq").alias("ingest_seq"))
    listed = reports.orderBy(F.desc("ingest_seq"), F.desc("report_id"))
    return listed if limit is None else listed.limit(limit)


def named_reports(contributions: DataFrame, wanted: Column) -> DataFrame:
    """(node_id, report_id, report_name) of the wanted nodes: a report that is not in the graph goes by its id."""
    names = list_reports(contributions).select("report_id", F.col("name").alias("report_name"))
    rows = contributions.filter(wanted).select("node_id", "report_id").distinct().join(names, "report_id", "left")
    return rows.select("node_id", "report_id", F.coalesce("report_name", "report_id").alias("report_name"))


def found_by(edge: DataFrame, modes: tuple[str, ...], mode_col: str = "mode") -> DataFrame:
    """Edges that one of the modes has found; edges without a mode are those of the pipeline."""
    return edge.filter(F.coalesce(F.col(mode_col), F.lit("pipeline")).isin(*modes))
