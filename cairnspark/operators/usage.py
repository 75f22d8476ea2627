"""Daily caps, spending and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.functions import fixed


class Day:
    """Counters of a day. A request that would pass a ceiling is denied and uses nothing."""

    def __init__(self, reports: int = 0, agent_runs: int = 0, spend: float = 0.0):
        self.reports, self.agent_runs, self.spend = reports, agent_runs, spend

    def admit(self, kind: str, cost: float, reports: int = fixed.REPORTS_PER_DAY, agent_runs: int = fixed.AGENT_RUNS_PER_DAY, spend: float = fixed.SPEND_PER_DAY) -> bool:
        more = {"report": (self.reports, reports), "agent": (self.agent_runs, agent_runs)}.get(kind)
        if more is not None and more[0] >= more[1] or self.spend + cost > spend:
            return False
        self.reports += kind == "report"
        self.agent_runs += kind == "agent"
        self.spend = round(self.spend + cost, 6)
        return True

    def take(self, kind: str, cost: float, *ceilings: float) -> bool:
        """A request or a settlement."""
        if kind != "settle":
            return self.admit(kind, cost, *ceilings)
        self.settle(cost)
        return True

    def settle(self, delta: float) -> None:
        self.spend = round(max(0.0, self.spend + delta), 6)


def admit(requests: DataFrame, reports: int = fixed.REPORTS_PER_DAY, agent_runs: int = fixed.AGENT_RUNS_PER_DAY, spend: float = fixed.SPEND_PER_DAY) -> DataFrame:
    """Requests (day, seq, kind, cost) with ``admitted`` and the day's spending after each. What a day admits depends on what it
    admitted before, so each day is a fold in order of seq; days are the unit of work, and a day's rows stream through without
    being held. A row of kind "settle" corrects the spending by its cost, never below zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, state = None, Day()
        for frame in frames:
            out, spent = [], []
            for d, kind, cost in zip(frame.day, frame.kind, frame.cost, strict=True):
                if d != day:
                    day, state = d, Day()
                out.append(state.take(kind, cost, reports, agent_runs, spend))
                spent.append(state.spend)
            yield frame.assign(admitted=out, spend_after=spent)

    rows = requests.select("day", "seq", "kind", "cost").repartition("day").sortWithinPartitions("day", "seq")
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"day {kinds['day']}, seq {kinds['seq']}, kind string, cost {kinds['cost']}, admitted boolean, spend_after double")


def daily(admitted: DataFrame) -> DataFrame:
    ok = F.col("admitted")
    return admitted.groupBy("day").agg(F.count_if(ok & (F.col("kind") == "report")).alias("reports"), F.count_if(ok & (F.col("kind") == "agent")).alias("agent_runs"), F.max_by("spend_after", "seq").alias("spend_usd"))


def recent_days(days: DataFrame, keep: int = fixed.USAGE_DAYS) -> DataFrame:
    return days.orderBy(F.desc("day")).limit(keep)


def limit_message(days: DataFrame, reports: int = fixed.REPORTS_PER_DAY, agent_runs: int = fixed.AGENT_RUNS_PER_DAY, spend: float = fixed.SPEND_PER_DAY) -> DataFrame:
    """Which ceiling a day has reached, if any."""
    said = F.when(F.col("spend_usd") >= spend, "spend limit reached").when(F.col("reports") >= reports, "report limit reached").when(F.col("agent_runs") >= agent_runs, "agent limit reached")
    return days.withColumn("message", said)


def run_budgets(steps: DataFrame, calls: int = 8, tokens: int = 60_000, seconds: float = 120.0) -> DataFrame:
    """Steps (run_id, index, tokens, seconds) with running totals, and whether the budget still allowed each."""
    before = Window.partitionBy("run_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    done = F.count("*").over(before)
    return steps.withColumns({"calls_before": done, "tokens_before": sofar("tokens"), "seconds_before": sofar("seconds")}).withColumn("allowed", (F.col("calls_before") < calls) & (F.col("tokens_before") < tokens) & (F.col("seconds_before") < seconds))


def totals(calls: DataFrame, by: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Calls, tokens, cost and time of each run. A cached call costs nothing, whatever it did when it was made."""
    paid = F.when(F.coalesce("cached", F.lit(False)), 0.0).otherwise(F.col("cost_usd"))
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cached_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(paid).alias("cost_usd"), F.sum("duration_ms").alias("duration_ms"),
    )


def list_runs(runs: DataFrame, limit: int = 50, by: tuple[str, ...] = ("document",), order: str = "run_seq") -> DataFrame:
    """The newest record of each run's document, newest first."""
    others = [c for c in runs.columns if c not in by and c != order]
    last = runs.groupBy(*by).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in others])
    return last.orderBy(F.desc(order), *by).limit(limit)
