"""Counts of stored filters over a stream of messages, while the filters change."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warder.functions.state import exists
from warder.operators.audit_filter import FILTER_SCHEMA, AuditFilter, apply_saved_filters, saved_filters
from warder.operators.audit_report import counts


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the finished tables ``name=n`` in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(f.removeprefix(f"{name}=")) for f in found if f.startswith(f"{name}=") and exists(spark, f"{path}/{f}/_SUCCESS"))


def store_filters(rows: DataFrame, path: str) -> int:
    """Store a new version of all definitions (see ``filter_rows``); readers of older ones are not
    disturbed. Returns the version."""
    version = max(numbers(rows.sparkSession, path, "version"), default=-1) + 1
    rows.write.parquet(f"{path}/version={version}")
    return version


def newest_filters(spark: SparkSession, path: str) -> DataFrame:
    version = max(numbers(spark, path, "version"), default=None)
    return spark.createDataFrame([], FILTER_SCHEMA) if version is None else spark.read.schema(FILTER_SCHEMA).parquet(f"{path}/version={version}")


class LiveCounts:
    """Keeps counts (filter, digest, total, denied, ...) of every stored filter up to date.

    Each batch reads the newest definitions. Filters that are as they were get the new messages
    added to their counts; for those that are new or were edited, and only for them, the
    messages so far are counted again; those that are gone leave. Messages and counts are
    written by batch, so a batch that runs again after a failure starts from the same counts.
    Definitions are few (the driver reads them); messages never reach the driver.
    """

    def __init__(self, spark: SparkSession, filters: str, base: str):
        self.spark, self.filters, self.base = spark, filters, base
        #: Filters that each batch counted anew.
        self.redone: dict[int, list[str]] = {}

    def definitions(self) -> dict[str, tuple[str, AuditFilter]]:
        rows = newest_filters(self.spark, self.filters)
        text: dict[str, list[str]] = {}
        for r in rows.collect():
            text.setdefault(r["filter"], []).append(repr((r["criterion"], list(r["values"]), r["match"], r["strict"])))
        return {f.name: (hashlib.sha256("\n".join(sorted(text[f.name])).encode()).hexdigest(), f) for f in saved_filters(rows)}

    def counted(self, messages: DataFrame, wanted: list[AuditFilter]) -> DataFrame:
        return apply_saved_filters(messages, wanted).groupBy("filter").agg(*counts())

    def step(self, batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.base}/messages/batch={n}")
        wanted = self.definitions()
        known = self.state(before=n)
        before = {r["filter"]: r["digest"] for r in known.select("filter", "digest").collect()} if known is not None else {}
        same = [f for name, (digest, f) in wanted.items() if before.get(name) == digest]
        changed = [f for name, (digest, f) in wanted.items() if before.get(name) != digest]
        self.redone[n] = sorted(f.name for f in changed)
        parts = []
        if same:
            fresh = self.spark.read.schema(batch.schema).parquet(f"{self.base}/messages/batch={n}")
            parts += [known.drop("digest"), self.counted(fresh, same)]
        if changed:
            every = self.spark.read.schema(batch.schema).parquet(*[f"{self.base}/messages/batch={i}" for i in numbers(self.spark, f"{self.base}/messages", "batch") if i <= n])
            parts.append(self.counted(every, changed))
        names = self.spark.createDataFrame([(name, digest) for name, (digest, _) in wanted.items()], "filter string, digest string")
        # edited filters have left the counts from before, so that only the new ones count
        old = F.broadcast(self.spark.createDataFrame([(f.name,) for f in changed], "filter string"))
        if same and changed:
            parts[0] = parts[0].join(old, "filter", "left_anti")
        sums = ["total", "denied", "granted", "bool_changes", "policy_loads"]
        found = reduce(DataFrame.unionByName, parts).groupBy("filter").agg(*[F.sum(c).alias(c) for c in sums]) if parts else None
        out = names.join(found, "filter", "left") if found is not None else names.select("*", *[F.lit(0).cast("long").alias(c) for c in sums])
        out.select("filter", "digest", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums]).write.mode("overwrite").parquet(f"{self.base}/counts/batch={n}")

    def state(self, before: int | None = None) -> DataFrame | None:
        """The counts after the last batch (before one)."""
        done = [n for n in numbers(self.spark, f"{self.base}/counts", "batch") if before is None or n < before]
        return self.spark.read.parquet(f"{self.base}/counts/batch={done[-1]}") if done else None

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """Follow a stream of messages; the checkpoint is beside the counts."""
        return messages.writeStream.option("checkpointLocation", f"{self.base}/log").trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(self.step).start()
