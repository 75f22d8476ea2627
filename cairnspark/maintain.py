"""Maintenance of a stored graph: python -m cairnspark.maintain FOLDER stats|duplicates|same-names|export|backups|restore|remove ..."""

from __future__ import annotations

import argparse

from cairnspark.operators import duplicates, graph
from cairnspark.session import local_session
from cairnspark.sources.store import GraphStore

SCHEMAS = {"nodes": graph.NODE, "edges": graph.EDGE}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("command", choices=("stats", "duplicates", "same-names", "export", "backups", "restore", "remove"))
    parser.add_argument("value", nargs="?", help="version to restore, report to remove, or folder to export to")
    parser.add_argument("--yes", action="store_true", help="really restore or remove; without it, only say what would happen")
    asked = parser.parse_args(arguments)
    spark = local_session(name="maintain")
    store = GraphStore(spark, asked.folder)
    tables = {name: store.load(name, schema) for name, schema in SCHEMAS.items()}
    if asked.command == "backups":
        print(*store.versions(), sep="\n")
    elif asked.command == "stats":
        graph.stats(graph.node_facts(tables["nodes"]), graph.edge_facts(tables["edges"])).show(truncate=False)
    elif asked.command == "duplicates":
        duplicates.possible_duplicates(graph.node_facts(tables["nodes"])).show(100, truncate=False)
    elif asked.command == "same-names":
        graph.same_name_types(graph.node_facts(tables["nodes"])).orderBy("name").show(1000, truncate=False)
    elif asked.command == "export":
        graph.graph_json(graph.nodes(tables["nodes"]), graph.edges(tables["edges"])).write.text(asked.value)
    elif not asked.yes:
        print(f"would {asked.command} {asked.value}; pass --yes to do it")
    elif asked.command == "restore":
        print("now at version", store.restore(int(asked.value), SCHEMAS))
    else:
        gone = spark.createDataFrame([(asked.value,)], "report_id string")
        print("now at version", store.update(SCHEMAS, lambda t: {name: graph.remove_reports(t[name], gone) for name in SCHEMAS}))


if __name__ == "__main__":
    main()
