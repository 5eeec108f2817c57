"""Live audit logs: tailing, continued lines across batches, incremental views and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from warder.functions.state import scratch_path
from warder.operators.audit_filter import View
from warder.operators.audit_report import counts
from warder.sources.audit_log import parse_lines, read_audit_text

POLL = "1 second"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: without this each sets 4 MB of disk aside for its manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
PENDING = "line_no long, value string, open boolean, load boolean"
MESSAGE = "file string, line_no long, value string"
#: Bytes of a file whose whole messages have one key, and rows that are sent out at once.
SLOT_BYTES, SEND_ROWS = 4 << 20, 10_000


def tail_audit(spark: SparkSession, path: str | list[str], timeout_ms: int | None = None) -> DataFrame:
    """Streaming messages of growing log files; start it with ``trigger(processingTime=POLL)``.

    A message that goes on over several lines comes out whole, also when its lines arrive in
    different batches; with ``timeout_ms`` an unfinished one comes out after so long. Sets the
    session's state store (STORE), which folding needs.
    """
    for k, v in STORE.items():
        spark.conf.set(k, v)
    lines = read_audit_text(spark, path, stream=True).withColumnRenamed("offset", "line_no")
    return parse_lines(fold_ranges_stream(lines, timeout_ms).withColumnRenamed("line_no", "offset"))


def incremental_view(messages: DataFrame, view: View) -> DataFrame:
    """A view over a stream: filters only, since a stream has no order and no hidden rows."""
    return View(view.filters, view.match, view.show, [], None, view.name).apply(messages)


def stream_counts(messages: DataFrame, window: str = "1 hour", late: str = "1 hour", by: tuple[str, ...] = ("host", "stype", "ttype", "tclass", "decision")) -> DataFrame:
    """Counts by time window; the watermark bounds the state and drops what comes later."""
    return messages.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *by).agg(*counts()).select(F.col("w.start").alias("start"), *by, "total", "denied", "granted", "bool_changes", "policy_loads")


def line_kind(value: str) -> tuple[bool, bool, bool]:
    """Whether a line is one of booleans, of a policy load, of an access."""
    return "committed booleans" in value, "security:" in value and any(w in value for w in (" users", " classes")), "avc:" in value


class Continuations(StatefulProcessor):
    """Carries the unfinished message of a file from batch to batch.

    Rows of a key come with line_no; within a batch they are put in order. A message goes out
    when a line comes that does not go on with it; with ``timeout_ms`` also after so long. A row
    without value stands for such a line.
    """

    def __init__(self, timeout_ms: int | None = None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)

    @staticmethod
    def out(key: tuple, line_no: int, value: str) -> dict:
        return {"file": key[0], "line_no": int(line_no), "value": value}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values(["line_no", "value"], na_position="first")
        held = self.pending.get() if self.pending.exists() else None
        done: list[dict] = []
        for line_no, value in zip(lines["line_no"], lines["value"], strict=True):
            if not isinstance(value, str):
                if held is not None:
                    done.append(self.out(key, held[0], held[1]))
                held = None
                continue
            is_bool, is_load, is_avc = line_kind(value)
            goes_on = held is not None and ((held[2] and not (is_bool or is_load or is_avc)) or (held[3] and is_load and " classes" in value))
            if goes_on:
                held = (held[0], f"{held[1]} {value}", held[2] and "}" not in value, False)
            else:
                if held is not None:
                    done.append(self.out(key, held[0], held[1]))
                held = (int(line_no), value, is_bool and "}" not in value, is_load and " classes" not in value)
            if held is not None and not held[2] and not held[3]:
                done.append(self.out(key, held[0], held[1]))
                held = None
        if held is None:
            self.pending.clear()
        else:
            self.pending.update(held)
            if self.timeout_ms is not None:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame(done, columns=["file", "line_no", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.pending.get() if self.pending.exists() else None
        self.pending.clear()
        yield pd.DataFrame([self.out(key, held[0], held[1])] if held else [], columns=["file", "line_no", "value"])

    def close(self) -> None:
        pass


class RangeContinuations(Continuations):
    """``Continuations`` of the lines with slot -1; rows of other slots are whole messages and pass."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[1] < 0:
            yield from super().handleInputRows(key, rows, timerValues)
        else:
            for some in rows:
                yield some[["file", "line_no", "value"]]


def fold_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, slot, line_no, value) of lines that stand in order: the messages that are whole, and with
    slot -1 lines that may belong to one that goes on before or after, by the rules of ``Continuations``.

    What comes before is known from the first line that can go on with nothing; there a row
    without value ends the message before. It is also known after a line that ends whatever it
    goes on with.
    """
    out: list[tuple] = []
    now, known, held = None, False, []

    def sent():
        columns = zip(*out, strict=True) if out else ([],) * 4
        kinds = {"file": pa.string(), "slot": pa.int64(), "line_no": pa.int64(), "value": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    for batch in batches:
        for file, at, value in zip(*(batch.column(c).to_pylist() for c in ("file", "line_no", "value")), strict=True):
            if file != now:
                out += [(now, -1, *line) for line in held]
                now, known, held = file, False, []
            is_bool, is_load, is_avc = line_kind(value)
            second = is_load and " classes" in value
            if not known:
                known = (is_bool or is_load or is_avc) and not second
                if not known:
                    out.append((file, -1, at, value))
                    known = not is_bool and (second or "}" in value)
                    continue
                out.append((file, -1, at, None))
            if held and ((opened and not (is_bool or is_load or is_avc)) or (loads and second)):
                held.append((at, value))
                opened, loads = opened and "}" not in value, False
            else:
                if held:
                    out.append((file, held[0][0] // SLOT_BYTES, held[0][0], " ".join(v for _, v in held)))
                held, opened, loads = [(at, value)], is_bool and "}" not in value, is_load and not second
            if not opened and not loads:
                out.append((file, held[0][0] // SLOT_BYTES, held[0][0], " ".join(v for _, v in held)))
                held = []
            if len(out) >= SEND_ROWS:
                yield sent()
                out = []
    out += [(now, -1, *line) for line in held]
    yield sent()


def fold_ranges_stream(lines: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """``join_continuations_stream`` for lines that stand in partitions in order, each a piece of a file.

    Messages that begin and end within a partition are folded where it is read and pass the state
    in pieces; only the first and last lines of a partition meet in the file's state.
    """
    mode = "None" if timeout_ms is None else "ProcessingTime"
    pieces = lines.select("file", "line_no", "value").mapInArrow(fold_lines, "file string, slot long, line_no long, value string")
    return pieces.groupBy("file", "slot").transformWithStateInPandas(RangeContinuations(timeout_ms), MESSAGE, "append", mode)


def join_continuations_stream(lines: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Streaming lines (file, line_no, value) as whole messages; needs STORE in the session."""
    mode = "None" if timeout_ms is None else "ProcessingTime"
    return lines.groupBy("file").transformWithStateInPandas(Continuations(timeout_ms), MESSAGE, "append", mode)


def run_available(stream: DataFrame, keys: list[str], count: str = "total") -> DataFrame:
    """Run an aggregating stream over all that is there and return its last state.

    Each batch's changed keys are written to the checkpoint folder; of a key the row with the
    largest count is the newest.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    old = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}-log").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/batch={n}")).start()
        run.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema(stream.schema).parquet(base)
    rest = [c for c in stream.columns if c not in keys]
    order = F.struct(count, *[c for c in rest if c != count])
    return rows.groupBy(*keys).agg(F.max(order).alias("s")).select(*keys, *[F.col(f"s.{c}") for c in rest])


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as a stream; a pattern also takes a path that is one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
