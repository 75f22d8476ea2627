"""Proposed entities and relationships against their source text: one reason per rejected claim, survivors merged over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions import fixed, text

_CHUNK = ["report_id", "chunk_index"]
ENTITY = "array<struct<name:string,type:string,aliases:array<string>,description:string,evidence:string>>"
RELATIONSHIP = "array<struct<source:string,relation:string,target:string,evidence:string>>"
PROPOSAL = f"struct<entities:{ENTITY},relationships:{RELATIONSHIP}>"


def parse_proposals(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw (report_id, chunk_index, json) to (entities, relationships, schema failures). One bad item fails its chunk whole."""
    parsed = raw.select(*_CHUNK, F.get_json_object("json", "$").isNotNull().alias("_json"), F.from_json("json", PROPOSAL.removeprefix("struct<").removesuffix(">").replace("entities:", "entities ", 1).replace(",relationships:", ", relationships ", 1)).alias("_p"))
    entities, relations = F.coalesce("_p.entities", F.array().cast(ENTITY)), F.coalesce("_p.relationships", F.array().cast(RELATIONSHIP))
    within = lambda c, low, high: F.coalesce(F.length(c).between(low, high), F.lit(False))
    good_entity = F.forall(entities, lambda e: within(e["name"], 1, fixed.MAX_NAME) & F.coalesce(e["type"].isin(*fixed.ENTITY_TYPES), F.lit(False)) & within(F.coalesce(e["description"], F.lit("")), 0, fixed.MAX_DESCRIPTION) & within(e["evidence"], fixed.MIN_EVIDENCE, fixed.MAX_EVIDENCE) & (F.coalesce(F.size(e["aliases"]), F.lit(0)) <= fixed.MAX_ALIASES))
    good_relation = F.forall(relations, lambda r: within(r["source"], 1, fixed.MAX_NAME) & within(r["target"], 1, fixed.MAX_NAME) & F.coalesce(r["relation"].isin(*fixed.RELATION_TYPES), F.lit(False)) & within(r["evidence"], fixed.MIN_EVIDENCE, fixed.MAX_EVIDENCE))
    good = F.coalesce(F.col("_json") & F.col("_p").isNotNull() & good_entity & good_relation & (F.size(entities) <= fixed.MAX_ENTITIES) & (F.size(relations) <= fixed.MAX_RELATIONSHIPS), F.lit(False))
    judged = parsed.select(*_CHUNK, good.alias("_good"), entities.alias("_e"), relations.alias("_r"))
    fine = judged.filter("_good")
    return (
        fine.select(*_CHUNK, F.posexplode("_e").alias("ordinal", "_x")).select(*_CHUNK, "ordinal", "_x.*"),
        fine.select(*_CHUNK, F.posexplode("_r").alias("ordinal", "_x")).select(*_CHUNK, "ordinal", "_x.*"),
        judged.filter(~F.col("_good")).select(*_CHUNK, F.lit("schema").alias("reason")),
    )


def indicator_names(indicators: DataFrame) -> DataFrame:
    """(report_id, folded, canonical): values and undone spellings of a report's indicators."""
    forms = F.array_union(F.array(F.col("value")), F.transform(F.col("original_forms"), lambda f: text.refang(f)))
    return indicators.select("report_id", F.col("value").alias("canonical"), F.explode(forms).alias("_f")).groupBy("report_id", F.lower("_f").alias("folded")).agg(F.min("canonical").alias("canonical"))


def grounded(claims: DataFrame, chunks: DataFrame, quote: str = "evidence", unicode: bool = True) -> DataFrame:
    """Claims with their chunk's text in the form for comparison, as _source, and whether the quote stands in it. The text is
    brought to that form once per chunk; the join is on the chunk."""
    sources = chunks.select(*_CHUNK, text.grounding_form(F.col("text"), unicode).alias("_source"))
    form = text.grounding_form(F.col(quote), unicode)
    return claims.join(sources, _CHUNK, "left").withColumn("_grounded", F.coalesce((F.col(quote) != "") & F.contains("_source", form), F.lit(False)))


def validate_entities(entities: DataFrame, chunks: DataFrame, indicators: DataFrame, unicode: bool = True) -> DataFrame:
    """Entities with name, aliases, description and evidence made safe, and ``reason``: the first rule that rejects each, or null.
    A survivor that repeats a type and name in its chunk has the reason "repeated", which counts as no rejection."""
    form = lambda c: text.grounding_form(c, unicode)
    safe = entities.select(
        *_CHUNK, "ordinal", "type", text.strip_unsafe(F.col("name")).alias("name"), text.strip_unsafe(F.coalesce("description", F.lit(""))).alias("description"), text.strip_unsafe(F.col("evidence")).alias("evidence"),
        F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: text.strip_unsafe(a)), lambda a: a != "").alias("aliases"),
    )
    named = indicator_names(indicators)
    rows = grounded(safe, chunks, unicode=unicode).withColumn("_folded", F.lower(text.refang(F.col("name")))).join(named.withColumnRenamed("folded", "_folded"), ["report_id", "_folded"], "left")
    is_indicator = F.col("type") == "indicator"
    known = F.when(is_indicator & F.col("canonical").isNotNull(), F.col("canonical")).otherwise(F.col("name"))
    # forms of aliases are made outside the lambda, one row per alias, as a pandas function cannot run inside one
    spread = rows.select(*_CHUNK, "ordinal", F.posexplode("aliases").alias("_i", "_alias")).withColumn("_form", form(F.col("_alias")))
    spread = spread.groupBy(*_CHUNK, "ordinal").agg(F.array_sort(F.collect_list(F.struct("_i", "_alias", "_form"))).alias("_forms"))
    rows = rows.join(spread, [*_CHUNK, "ordinal"], "left").withColumn("_known", known).withColumn("_name_form", form(F.col("_known")))
    present = F.filter(F.coalesce("_forms", F.array().cast("array<struct<_i:int,_alias:string,_form:string>>")), lambda x: F.contains(F.col("_source"), x["_form"]))
    injected = F.coalesce(text.injection_name(F.col("name")), text.injection_name(F.col("description")), text.injection_name(F.array_join("aliases", "\n\n")))
    reason = (
        F.when(F.col("name") == "", "name_not_in_text")
        .when(injected.isNotNull(), "injected_output")
        .when(~is_indicator & text.bad_name(F.col("name")).isNotNull(), "bad_name")
        .when(text.residual_markup(F.col("name")) | text.residual_markup(F.col("description")), "injected_output")
        .when(~F.col("_grounded"), "not_grounded")
        .when(is_indicator & F.col("canonical").isNull(), "unknown_indicator")
        .when(~F.contains("_source", F.col("_name_form")) & (F.size(present) == 0), "name_not_in_text")
    )
    own = F.transform(F.filter(present, lambda x: F.lower(x["_alias"]) != F.lower(F.col("_known"))), lambda x: x["_alias"])
    judged = rows.withColumn("reason", reason).withColumn("aliases", F.when(F.col("reason").isNull(), own).otherwise(F.col("aliases"))).withColumn("name", F.when(F.col("reason").isNull(), F.col("_known")).otherwise(F.col("name")))
    first = Window.partitionBy(*_CHUNK, F.col("reason").isNull(), "type", F.lower("name")).orderBy("ordinal")
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(first) > 1), "repeated").otherwise(F.col("reason")))
    return judged.select(*_CHUNK, "ordinal", "type", "name", "aliases", "description", "evidence", "reason")


def validate_relationships(relationships: DataFrame, kept: DataFrame, chunks: DataFrame, indicators: DataFrame, unicode: bool = True) -> DataFrame:
    """Relationships with ends resolved to kept entities or else indicators, and the first reason against each."""
    safe = relationships.select(*_CHUNK, "ordinal", "relation", *[text.strip_unsafe(F.col(c)).alias(c) for c in ("source", "target", "evidence")])
    rows = grounded(safe, chunks, unicode=unicode)
    entities = kept.filter("reason is null").select(*_CHUNK, F.lower("name").alias("_f")).distinct()
    named = indicator_names(indicators)
    for end in ("source", "target"):
        rows = rows.withColumn("_f", F.lower(end)).join(entities.withColumn(f"_{end}_e", F.lit(True)), [*_CHUNK, "_f"], "left").drop("_f")
        rows = rows.withColumn("folded", F.lower(text.refang(F.col(end)))).join(named.withColumnRenamed("canonical", f"_{end}_i"), ["report_id", "folded"], "left").drop("folded")
        rows = rows.withColumn(f"_{end}_to", F.when(F.col(f"_{end}_e"), F.col(end)).otherwise(F.col(f"_{end}_i")))
    reason = (
        F.when((F.col("source") == "") | (F.col("target") == ""), "dangling")
        .when(F.coalesce(text.injection_name(F.col("source")), text.injection_name(F.col("target"))).isNotNull(), "injected_output")
        .when(~F.col("_grounded"), "not_grounded")
        .when(F.col("_source_to").isNull() | F.col("_target_to").isNull(), "dangling")
    )
    judged = rows.withColumn("reason", reason)
    for end in ("source", "target"):
        judged = judged.withColumn(end, F.when(F.col("reason").isNull(), F.col(f"_{end}_to")).otherwise(F.col(end)))
    first = Window.partitionBy(*_CHUNK, F.col("reason").isNull(), F.lower("source"), "relation", F.lower("target")).orderBy("ordinal")
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(first) > 1), "repeated").otherwise(F.col("reason")))
    return judged.select(*_CHUNK, "ordinal", "source", "relation", "target", "evidence", "reason")


def validation_report(judged: DataFrame, by: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Proposed, kept and dropped claims, the drop rate, and whether over half were dropped."""
    out = judged.groupBy(*by).agg(F.count("*").alias("proposed"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.coalesce(F.col("reason") != "repeated", F.lit(False))).alias("dropped"))
    rate = F.coalesce(F.try_divide("dropped", "proposed"), F.lit(0.0))
    return out.withColumn("drop_rate", rate).withColumn("suspicious", rate > 0.5)


def dropped_by_reason(judged: DataFrame, by: tuple[str, ...] = ("report_id",)) -> DataFrame:
    return judged.filter("reason is not null and reason <> 'repeated'").groupBy(*by, "reason").agg(F.count("*").alias("dropped"))


def _ordered(column: str, limit: int | None = None) -> Column:
    out = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "ordinal", column))), lambda x: x[column]))
    return out if limit is None else F.slice(out, 1, limit)


def merge_entities(judged: DataFrame) -> DataFrame:
    """Survivors of all chunks of a report as one row per type and folded name: the first spelling, distinct aliases and
    descriptions in order, at most MERGED_EVIDENCE quotes."""
    kept = judged.filter("reason is null").withColumn("_name", F.lower("name"))
    flat = kept.groupBy("report_id", "type", "_name").agg(
        F.min_by("name", F.struct("chunk_index", "ordinal")).alias("name"), F.array_distinct(F.flatten(_ordered("aliases"))).alias("aliases"),
        F.filter(_ordered("description"), lambda d: d != "").alias("descriptions"), _ordered("evidence", fixed.MERGED_EVIDENCE).alias("evidence"), F.min(F.struct("chunk_index", "ordinal")).alias("_first"),
    )
    return flat.select("report_id", "type", "name", "aliases", "descriptions", "evidence", F.row_number().over(Window.partitionBy("report_id").orderBy("_first")).alias("ordinal"))


def merge_relationships(judged: DataFrame) -> DataFrame:
    kept = judged.filter("reason is null").withColumns({"_s": F.lower("source"), "_t": F.lower("target")})
    out = kept.groupBy("report_id", "_s", "relation", "_t").agg(F.min_by("source", F.struct("chunk_index", "ordinal")).alias("source"), F.min_by("target", F.struct("chunk_index", "ordinal")).alias("target"), _ordered("evidence", fixed.MERGED_EVIDENCE).alias("evidence"))
    return out.select("report_id", "source", "relation", "target", "evidence")


def validate_techniques(claims: DataFrame, techniques: DataFrame, chunks: DataFrame, unicode: bool = True) -> DataFrame:
    """Claimed technique ids (report_id, chunk_index, ordinal, technique_id, evidence): the data set's own name, and a reason."""
    known = techniques.select(F.upper("id").alias("_id"), F.col("name").alias("technique"))
    rows = grounded(claims, chunks, unicode=unicode).withColumn("_id", F.upper(F.trim("technique_id"))).join(known, "_id", "left")
    reason = F.when(F.col("technique").isNull(), "unknown_technique").when(~F.col("_grounded"), "not_grounded")
    first = Window.partitionBy("report_id", "_id", reason.isNull()).orderBy("chunk_index", "ordinal")
    judged = rows.withColumn("_n", F.row_number().over(first)).withColumn("reason", F.when(reason.isNull() & (F.col("_n") > 1), "repeated").otherwise(reason))
    return judged.select(*_CHUNK, "ordinal", F.col("_id").alias("technique_id"), "technique", "evidence", "reason")
