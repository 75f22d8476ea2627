"""Structured Streaming forms of the two stateful behaviours: graph upkeep and daily admission."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnspark.operators import graph
from cairnspark.operators.usage import Day
from cairnspark.sources.store import GraphStore


def maintain_graph(contributions: DataFrame, store: GraphStore, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """A stream of node contributions into the store. A batch that runs again after a failure changes nothing, as its reports'
    rows are exchanged, not added."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.update({"nodes": graph.NODE}, lambda tables: {"nodes": graph.replace_reports(tables["nodes"], batch)})

    return contributions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def admit_stream(requests: DataFrame, reports: int, agent_runs: int, spend: float) -> DataFrame:
    """A stream of requests (day, seq, kind, cost) with ``admitted``; the state of a day is its three counters."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day = Day(*state.get) if state.exists else Day()
        for frame in frames:
            frame = frame.sort_values("seq")
            frame["admitted"] = [day.take(kind, cost, reports, agent_runs, spend) for kind, cost in zip(frame.kind, frame.cost, strict=True)]
            yield frame[["day", "seq", "kind", "cost", "admitted"]]
        state.update((day.reports, day.agent_runs, day.spend))

    return requests.groupBy("day").applyInPandasWithState(step, "day string, seq long, kind string, cost double, admitted boolean", "reports int, agent_runs int, spend double", "append", GroupStateTimeout.NoTimeout)
