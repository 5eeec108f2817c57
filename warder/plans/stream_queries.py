"""Registered queries over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.functions.state import scratch_path
from warder.operators.audit_filter import AuditFilter, filter_rows
from warder.plans.fixtures import VIEWS
from warder.streaming.audit_stream import file_stream, run_available, stream_counts
from warder.streaming.live_views import LiveCounts, store_filters


def audit_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the messages, read as a stream of event files."""
    path = f"{sf_dir}/events.parquet"
    events = file_stream(spark, path, spark.read.parquet(path).schema)
    messages = spark.sql(VIEWS["audit"], events=events).withColumn("ts", F.col("ts").cast("timestamp"))
    found = run_available(stream_counts(messages, late="3650 days", by=("host", "tclass")), ["start", "host", "tclass"])
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


FEW, EDITED = ["s1", "s2", "s3"], ["s2", "s4"]


def live_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of filters over a stream of four batches; after the second one filter is edited, one
    is new and one is gone."""
    base = scratch_path(spark, "live")
    messages = spark.sql(VIEWS["audit"].format(events=f"parquet.`{sf_dir}/events.parquet`"))
    messages.repartition(4, "msg_id").write.parquet(f"{base}/in")
    few, denied, gone = AuditFilter({"src_type": FEW}, "all", True, "few"), AuditFilter({"msg": "denied"}, "all", True, "denied"), AuditFilter({"port": 1}, "all", True, "gone")
    later = [AuditFilter({"src_type": EDITED}, "all", True, "few"), denied, AuditFilter({"host": "h[0-2]"}, "all", True, "hosts")]
    store_filters(filter_rows(spark, [few, denied, gone]), f"{base}/filters")
    live = LiveCounts(spark, f"{base}/filters", f"{base}/views")

    def step(batch: DataFrame, n: int) -> None:
        live.step(batch, n)
        if n == 1:
            store_filters(filter_rows(spark, later), f"{base}/filters")

    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return live.state().drop("digest")


LIVE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS filter, count(*) AS total, count(*) FILTER (decision = 'denied') AS denied, count(*) FILTER (decision = 'granted') AS granted, count(*) FILTER (msg_type = 'BOOL') AS bool_changes, count(*) FILTER (msg_type = 'LOAD') AS policy_loads FROM audit WHERE {test}"
    for name, test in (("few", f"stype IN ({', '.join(map(repr, EDITED))})"), ("denied", "decision = 'denied'"), ("hosts", "host IN ('h0', 'h1', 'h2')"))
)

STREAMS = {
    "audit_live_filters": (live_filters, LIVE_SQL),
    "audit_stream_counts": (
        audit_stream_counts,
        "SELECT date_trunc('hour', ts) AS start, host, tclass, count(*) AS total, count(*) FILTER (decision = 'denied') AS denied, count(*) FILTER (decision = 'granted') AS granted, count(*) FILTER (msg_type = 'BOOL') AS bool_changes, count(*) FILTER (msg_type = 'LOAD') AS policy_loads FROM audit GROUP BY ALL",
    )
}
