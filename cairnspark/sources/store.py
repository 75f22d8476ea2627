"""A versioned store of contributions in Parquet folders, with compare-and-set, backups and result files.

A save writes a new folder and then creates the marker of its version; creating a marker that exists fails, so of two writers one
wins and the other sees a conflict. All paths go through the file system of the path, local or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.functions import fixed, text


class VersionConflict(Exception):
    """The store moved on since it was read."""


class GraphStore:
    """Named tables under one version number."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = fixed.LOCAL_BACKUPS):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, newest first."""
        at = self._path(f"{self.folder}/_versions")
        names = [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def version(self) -> int:
        return next(iter(self.versions()), 0)

    def load(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """A table of a version; of version 0 it is empty."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v={version}/{table}")

    def save(self, tables: dict[str, DataFrame], expected: int) -> int:
        """Write the tables as version expected + 1; raises VersionConflict if the store is not at ``expected``."""
        if self.version() != expected:
            raise VersionConflict(f"expected version {expected}, found {self.version()}")
        new = expected + 1
        draft = f"{self.folder}/_drafts/{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        for name, frame in tables.items():
            frame.write.parquet(f"{draft}/{name}")
        self._claim(new)
        self._files.rename(self._path(draft), self._path(f"{self.folder}/v={new}"))
        for old in self.versions()[self.keep + 1 :]:
            self._files.delete(self._path(f"{self.folder}/_versions/{old}"), False)
            self._files.delete(self._path(f"{self.folder}/v={old}"), True)
        return new

    def _claim(self, version: int) -> None:
        marker = self._path(f"{self.folder}/_versions/{version}")
        self._files.mkdirs(self._path(f"{self.folder}/_versions"))
        try:
            self._files.create(marker, False).close()
        except Exception as refused:
            raise VersionConflict(f"version {version} was taken") from refused

    def restore(self, version: int, schemas: dict[str, str]) -> int:
        """Make an old version the newest; versions only go up."""
        return self.save({name: self.load(name, schema, version) for name, schema in schemas.items()}, self.version())

    def update(self, schemas: dict[str, str], change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], attempts: int = fixed.SAVE_ATTEMPTS) -> int:
        """Load, change, save; on a conflict again from what is there now."""
        for left in reversed(range(attempts)):
            now = self.version()
            try:
                return self.save(change({name: self.load(name, schema, now) for name, schema in schemas.items()}), now)
            except VersionConflict:
                if not left:
                    raise
        raise VersionConflict("no attempt was made")


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Newest row of each key: what an upsert leaves where files are only added."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def keep_newest(versions: DataFrame, by: tuple[str, ...], order: str, keep: int = fixed.LOCAL_BACKUPS) -> DataFrame:
    newest = Window.partitionBy(*by).orderBy(F.desc(order))
    return versions.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= keep)


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted (sha256, model, prompt_version) with the stored analysis, or null: a damaged one is a miss."""
    return wanted.join(latest(cache, ("sha256", "model", "prompt_version"), "saved_at"), ["sha256", "model", "prompt_version"], "left")


def write_results(reports: DataFrame, indicators: DataFrame, entities: DataFrame, relationships: DataFrame, folder: str) -> None:
    """Result files of all reports, one folder for each under iocs, entities, relationships and analysis."""
    named = reports.select("report_id", text.safe_name(F.col("filename"), F.col("sha256")).alias("result"))
    joined = lambda c, sep=" ": F.array_join(F.col(c).cast("array<string>"), sep)
    out = {
        "iocs": indicators.join(named, "report_id").select("result", "type", "value", "occurrences", joined("pages").alias("pages"), "in_ioc_section", joined("flags").alias("flags"), joined("original_forms").alias("original_forms")),
        "entities": entities.join(named, "report_id").select("result", "type", "name", joined("aliases", " | ").alias("aliases"), F.substring(joined("descriptions"), 1, 500).alias("description"), F.size("evidence").alias("evidence_count"), F.substring(joined("evidence", " | "), 1, 1000).alias("evidence")),
        "relationships": relationships.join(named, "report_id").select("result", "source", "relation", "target", F.substring(joined("evidence", " | "), 1, 1000).alias("evidence")),
    }
    for name, frame in out.items():
        frame.write.mode("overwrite").partitionBy("result").option("header", True).csv(f"{folder}/{name}")
    counts = [f.groupBy("result").agg(F.count("*").alias(n)) for n, f in out.items()]
    summary = named
    for c in counts:
        summary = summary.join(c, "result", "left")
    summary.na.fill(0).write.mode("overwrite").partitionBy("result").json(f"{folder}/analysis")


def list_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/analysis").orderBy("result")
