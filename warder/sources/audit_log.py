"""Audit log text: reading, parsing, joining continued lines, rendering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warder.functions.state import written
from warder.sources.text_lines import RANGE_BYTES, read_lines

#: Keys of an access message and the column and type that each goes to (fixed values).
KEYS = {
    "pid": ("pid", "int"),
    "exe": ("exe", "string"),
    "comm": ("comm", "string"),
    "path": ("path", "string"),
    "name": ("name", "string"),
    "dev": ("dev", "string"),
    "ino": ("inode", "bigint"),
    "ipaddr": ("ipaddr", "string"),
    "saddr": ("saddr", "string"),
    "src": ("sport", "int"),
    "source": ("sport", "int"),
    "daddr": ("daddr", "string"),
    "dest": ("dport", "int"),
    "netif": ("netif", "string"),
    "laddr": ("laddr", "string"),
    "lport": ("lport", "int"),
    "faddr": ("faddr", "string"),
    "fport": ("fport", "int"),
    "port": ("port", "int"),
    "key": ("key", "int"),
    "capability": ("cap", "int"),
    "ssid": ("ssid", "int"),
    "tsid": ("tsid", "int"),
    "scontext": ("scontext", "string"),
    "tcontext": ("tcontext", "string"),
    "tclass": ("tclass", "string"),
}
COLUMNS = dict(KEYS.values())
NET = ["saddr", "sport", "daddr", "dport", "netif", "laddr", "lport", "faddr", "fport", "port", "ipaddr"]
SYSLOG = r"^(\w{3})\s+(\d{1,2}) (\d{2}):(\d{2}):(\d{2}) (\S+) "
STAMP = r"audit\((\d+)\.(\d+):(\d+)\)"
PAIR = r"(\w+)=(\"[^\"]*\"|.*?)(?=\s+\w+=|\s*$)"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
LOAD_COUNTS = ["classes", "rules", "users", "roles", "types", "bools"]
#: Syslog lines have no year; their dates are put in this one, a leap year.
NO_YEAR = 1972


def read_audit_text(spark: SparkSession, path: str | list[str], stream: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Log lines as (file, offset, value), offset being the byte where a line begins. Lines that
    span several records need ``join_continuations`` (``read_audit`` has it) before
    ``parse_lines``."""
    return read_lines(spark, path, stream, range_bytes)


def read_audit(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Messages of text logs, with file and offset of their first line. Files are read and
    folded in byte ranges; a message that is cut by one comes out whole."""
    return parse_lines(fold_ranges(read_audit_text(spark, path, range_bytes=range_bytes), "offset"))


def union_logs(logs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def classify_line(value: Column) -> Column:
    """BOOL, LOAD, AVC, or null for a line of no interest."""
    daemon = value.contains("kernel") | value.rlike(r"\btype=\w+ msg=audit\(") | value.rlike(STAMP)
    return (
        F.when(value.contains("committed booleans") & daemon, "BOOL")
        .when(value.contains("security:") & value.rlike(r"\d+ (users|classes|rules|types)") & daemon, "LOAD")
        .when(value.contains("avc:") & daemon, "AVC")
    )


def context(text: Column) -> Column:
    """``user:role:type[:level[-clearance]]``; a missing clearance is the level."""
    parts = F.split(text, ":", 4)
    levels = F.split(F.get(parts, F.lit(3)), "-", 2)
    return F.struct(
        F.get(parts, F.lit(0)).alias("user"),
        F.get(parts, F.lit(1)).alias("role"),
        F.get(parts, F.lit(2)).alias("type"),
        F.get(levels, F.lit(0)).alias("mls_lvl"),
        F.coalesce(F.get(levels, F.lit(1)), F.get(levels, F.lit(0))).alias("mls_clr"),
    )


def pairs(tail: Column) -> Column:
    """The key=value pairs of a message; the first of a key counts; quotes go."""
    found = F.transform(F.regexp_extract_all(tail, F.lit(PAIR), F.lit(0)), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.btrim(x.substr(F.instr(x, "=") + 1, F.length(x)), F.lit('"')).alias("v")))
    return F.map_from_entries(F.aggregate(found, F.lit([]).cast("array<struct<k:string,v:string>>"), lambda kept, x: F.when(F.exists(kept, lambda y: y["k"] == x["k"]), kept).otherwise(F.array_append(kept, x))))


def header(head: Column, stamp: Column) -> dict[str, Column]:
    """Host, date and serial, of what SYSLOG and STAMP match."""
    syslog, stamp = F.split(head, r"[\s:]+"), F.split(stamp, r"[(.:)]")
    part = lambda parts, i: F.get(parts, F.lit(i))
    months = F.array(*[F.lit(m) for m in MONTHS])
    month = F.array_position(months, part(syslog, 0))
    clock = [part(syslog, i).cast("int") for i in range(1, 5)]
    dated = F.when(month > 0, F.try_make_timestamp(F.lit(NO_YEAR), month.cast("int"), *clock))
    seconds, fraction = part(stamp, 1).cast("bigint"), F.rpad(part(stamp, 2), 6, "0").cast("bigint")
    stamped = F.timestamp_micros(seconds * 1_000_000 + fraction)
    return {
        # a host may hold colons, so it is cut from the end of the head
        "host": F.nullif(F.regexp_replace(head, r"^\w+\s+\d+ [\d:]+ | $", ""), F.lit("")),
        "ts": F.coalesce(stamped, dated),
        "has_year": stamped.isNotNull(),
        "serial": part(stamp, 3).cast("bigint"),
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed messages of the lines that are any; columns of ``lines`` other than value stay.

    ``warnings`` names what is wrong with a recognised line; a line with warnings is malformed
    but keeps what could be read. Built-in expressions only, one pass: what the patterns match
    (head, stamp, pairs of keys and values) is made once behind a generator, so that filters do
    not work it out again; all columns are derived from that, and those not read are not made.
    Filter on the text before, where a part of it is enough.
    """
    v = F.col("value")
    rows = lines.withColumn("msg_type", classify_line(v)).filter("msg_type is not null")
    avc = F.col("msg_type") == "AVC"
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "value"]
    matched = {
        "raw": v,
        "__head": F.regexp_extract(v, SYSLOG, 0),
        "__stamp": F.regexp_extract(v, STAMP, 0),
        "__pairs": F.when(avc, pairs(F.regexp_extract(v, r"\bfor\s+(.*)$", 1))),
    }
    once = F.struct(*kept, *[c.alias(name) for name, c in matched.items()])
    rows = rows.select(F.explode(F.array(once)).alias("m")).select("m.*")
    v = F.col("raw")
    rows = rows.withColumns(header(F.col("__head"), F.col("__stamp")))
    rows = rows.withColumns(
        {
            "decision": F.when(avc & v.rlike(r"avc:\s+denied"), "denied").when(avc & v.rlike(r"avc:\s+granted"), "granted"),
            "manager": F.when(avc, F.coalesce(F.nullif(F.regexp_extract(v, r"\b(kernel|\w+): .*avc:", 1), F.lit("")), F.lit("kernel"))),
            "perms": F.when(avc & v.rlike(r"\{[^}]*\}"), F.filter(F.split(F.regexp_extract(v, r"\{\s*([^}]*?)\s*\}", 1), r"\s+"), lambda p: p != "")),
        }
    )
    typed = {}
    for column, kind in COLUMNS.items():
        texts = [F.try_element_at("__pairs", F.lit(k)) for k, (c, _) in KEYS.items() if c == column]
        typed[column] = F.coalesce(*texts).try_cast(kind)
    rows = rows.withColumns(typed).withColumns({"sctx": context(F.col("scontext")), "tctx": context(F.col("tcontext"))})
    for side, ctx in (("s", "sctx"), ("t", "tctx")):
        rows = rows.withColumns({f"{side}{f}": F.col(f"{ctx}.{f}") for f in ("user", "role", "type", "mls_lvl", "mls_clr")})
    boolean = F.regexp_extract_all(F.regexp_extract(v, r"committed booleans:\s*\{([^}]*)", 1), F.lit(r"[^\s,]+"), F.lit(0))
    change = lambda x: F.struct(F.split(x, ":")[0].alias("bool"), (F.get(F.split(x, ":"), F.lit(1)) == "1").alias("value"))
    counts = F.struct(*[F.regexp_extract(v, rf"(\d+) {c}\b", 1).try_cast("int").alias(c) for c in LOAD_COUNTS])
    rows = rows.withColumns({"changes": F.when(F.col("msg_type") == "BOOL", F.transform(boolean, change)), "load": F.when(F.col("msg_type") == "LOAD", counts)})
    unknown = F.filter(F.map_keys("__pairs"), lambda k: ~k.isin(list(KEYS)))
    numeric = [k for k, (_, kind) in KEYS.items() if kind != "string"]
    bad_number = [F.try_element_at("__pairs", F.lit(k)).isNotNull() & F.col(KEYS[k][0]).isNull() for k in numeric]
    sids = F.col("ssid").isNotNull() | F.col("tsid").isNotNull()
    contexts = F.col("scontext").isNotNull() | F.col("tcontext").isNotNull()
    checks = [
        (avc & F.col("decision").isNull(), F.lit("decision")),
        (avc & F.coalesce(F.size("perms") < 1, F.lit(True)), F.lit("permissions")),
        (avc & F.col("tclass").isNull(), F.lit("class")),
        (avc & sids & contexts, F.lit("sid and context")),
        (avc & ~(sids | contexts), F.lit("no context")),
        (avc & (F.size(unknown) > 0), F.concat(F.lit("unknown "), F.array_join(unknown, " "))),
        (reduce(lambda a, b: a | b, bad_number), F.lit("number")),
        ((F.col("msg_type") == "BOOL") & F.exists("changes", lambda c: c["value"].isNull()), F.lit("boolean")),
        (F.col("ts").isNull(), F.lit("date")),
    ]
    rows = rows.withColumns(
        {
            "warnings": F.array_compact(F.array(*[F.when(c, what) for c, what in checks])),
            "avc_data": F.when(avc, avc_data()),
        }
    )
    return rows.drop("__head", "__stamp", "__pairs", "sctx", "tctx")


def avc_data() -> Column:
    """Kind of an access message by the keys it has."""
    return (
        F.when(F.col("tclass").isNull(), "MALFORMED")
        .when(F.col("cap").isNotNull(), "CAP")
        .when(F.col("key").isNotNull(), "IPC")
        .when(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in NET]), "NET")
        .otherwise("FS")
    )


def malformed_lines(messages: DataFrame) -> DataFrame:
    return messages.filter(F.size("warnings") > 0).select("raw", "msg_type", "warnings")


#: Lines of a file that one task folds.
FOLD_LINES = 10_000


def join_continuations(lines: DataFrame, order: str = "line_no", fold_lines: int = FOLD_LINES) -> DataFrame:
    """Fold continued lines of a file into the message before them.

    An unmarked line after an unfinished BOOL, and a LOAD after a LOAD that lacks counts, go on.
    Messages are numbered by a running sum of their first lines. Other unmarked lines stay as
    they are. Returns file, the order of the first line, and value.

    A file is cut into ranges of ``fold_lines`` lines, so a long one is folded by many tasks;
    a range is told the last line before it and the last marked one, and its messages are
    numbered on from those of the ranges before.
    """
    rows = lines.withColumn("kind", classify_line(F.col("value"))).withColumn("part", F.floor(F.col(order) / fold_lines))
    open_bool = F.col("value").contains("committed booleans") & ~F.col("value").contains("}")
    rows = rows.withColumn("open", F.when(F.col("kind") == "BOOL", open_bool).when(F.col("kind").isNull(), ~F.col("value").contains("}")).otherwise(F.lit(False)))
    line = F.struct("kind", "open", F.col("value").rlike(r"\d+ users").alias("users"))
    tails = rows.groupBy("file", "part").agg(F.max_by(line, order).alias("tail"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col(order))).alias("last_kind"))
    parts = Window.partitionBy("file").orderBy("part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("file", "part", F.lag("tail").over(parts).alias("tail"), F.last("last_kind", ignorenulls=True).over(earlier).alias("last_kind"))
    inside = Window.partitionBy("file", "part").orderBy(order)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(tails, ["file", "part"])
    # the line before, and the marked line that an unmarked one may belong to
    rows = rows.withColumns({"before": F.coalesce(F.lag(line).over(inside), F.col("tail")), "mark": F.coalesce(F.last("kind", ignorenulls=True).over(above), F.col("last_kind"))})
    goes_on = F.col("kind").isNull() & (F.col("mark") == "BOOL") & F.coalesce(F.col("before.open"), F.lit(False))
    second_load = (F.col("kind") == "LOAD") & (F.col("before.kind") == "LOAD") & F.col("value").rlike(r"\d+ (classes|rules)") & F.col("before.users")
    rows = written(rows.select("file", "part", order, "value", F.when(F.coalesce(goes_on | second_load, F.lit(False)), 0).otherwise(1).alias("first")), "folded")
    starts = rows.groupBy("file", "part").agg(F.sum("first").alias("n")).select("file", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rows = rows.join(starts, ["file", "part"]).withColumn("message", F.col("start") + F.sum("first").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts_of = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "value")))
    return rows.groupBy("file", "message").agg(F.min(order).alias(order), F.array_join(F.transform(parts_of, lambda p: p["value"]), " ").alias("value")).drop("message")


class LineKinds:
    """What folding looks at in a batch of lines, as ``classify_line`` and ``join_continuations`` see it."""

    NONE, BOOL, LOAD, AVC = range(4)

    def __init__(self, values: pa.Array):
        has = lambda text: pc.match_substring(values, text).to_numpy(zero_copy_only=False)
        bools, loads, avc = has("committed booleans"), has("security:"), has("avc:")
        self.kind, self.users, self.counts = np.zeros(len(values), np.int8), np.zeros(len(values), bool), np.zeros(len(values), bool)
        marked = np.flatnonzero(bools | loads | avc)
        some = values.take(pa.array(marked))
        at = lambda pattern: pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
        daemon = at("kernel") | at(rf"\btype=\w+ msg=audit\(|{STAMP}")
        users, counted = at(r"\d+ users"), at(r"\d+ (classes|rules)")
        load = loads[marked] & (users | counted | at(r"\d+ types"))
        kinds = np.select([bools[marked] & daemon, load & daemon, avc[marked] & daemon], [self.BOOL, self.LOAD, self.AVC], self.NONE)
        self.kind[marked], self.users[marked], self.counts[marked] = kinds, users, counted
        unended = ~has("}")
        # an unmarked line is open too, so that several may go on with one message
        self.open = unended & (bools & (self.kind == self.BOOL) | (self.kind == self.NONE))


def fold_ranges(lines: DataFrame, order: str = "offset") -> DataFrame:
    """``join_continuations`` for lines that stand in partitions in order, each a piece of a file.

    Messages that begin and end within a partition are folded where it is read. Only the first and
    last messages of a partition, and one row on its last lines, are shuffled: a partition is told
    the last line and the last marked one before it, and its first and last messages meet there.
    """
    known = "first boolean, kind byte, users boolean, counts boolean, open boolean, last_kind byte"
    schema = f"file string, {order} long, value string, part long, whole boolean, {known}"

    def run(batches):
        fold = Fold(order)
        for batch in batches:
            yield from fold.put(batch)
        yield from fold.end()

    pieces = written(lines.select("file", order, "value").mapInArrow(run, schema), "pieces")
    tails = pieces.filter("value is null").select("file", "part", F.struct("kind", "open", "users").alias("tail"), "last_kind")
    parts = Window.partitionBy("file").orderBy("part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("file", "part", F.lag("tail").over(parts).alias("tail"), F.last("last_kind", ignorenulls=True).over(earlier).alias("mark"))
    border = pieces.filter("not whole and value is not null").join(tails, ["file", "part"])
    # before: the tail for the first line of a partition; the other unknown ones follow an open unmarked line
    goes_on = (F.col("kind") == LineKinds.NONE) & (F.col("mark") == LineKinds.BOOL) & ((F.col(order) != F.col("part")) | F.col("tail.open"))
    second_load = (F.col("kind") == LineKinds.LOAD) & (F.col("tail.kind") == LineKinds.LOAD) & F.col("counts") & F.col("tail.users")
    border = border.withColumn("first", F.coalesce("first", ~F.coalesce(goes_on | second_load, F.lit(False))))
    number = F.sum(F.col("first").cast("long")).over(Window.partitionBy("file").orderBy(order))
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "value")))
    joined = border.withColumn("message", number).groupBy("file", "message").agg(F.min(order).alias(order), F.array_join(F.transform(texts, lambda p: p["value"]), " ").alias("value"))
    return pieces.filter("whole").select("file", order, "value").unionByName(joined.select("file", order, "value"))


class Fold:
    """Folds the lines of one partition, batch by batch; files follow each other in it."""

    COLUMNS = {"file": pa.string(), "at": pa.int64(), "value": pa.string(), "part": pa.int64(), "whole": pa.bool_(), "first": pa.bool_(), "kind": pa.int8(), "users": pa.bool_(), "counts": pa.bool_(), "open": pa.bool_(), "last_kind": pa.int8()}

    def __init__(self, order: str):
        self.file, self.order = None, order

    def begin(self, file: str, at: int) -> None:
        # kind, open and users of the line before; the last marked kind; whether no message is known to have
        # begun; rows of the one that goes on
        self.file, self.part, self.before, self.mark, self.head, self.held = file, at, None, LineKinds.NONE, True, []

    def put(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files = batch.column(0)
        start = 0
        while start < len(files):
            file, n = files[start].as_py(), len(files) - start
            if files[len(files) - 1].as_py() != file:
                n = int(np.flatnonzero(pc.not_equal(files.slice(start), pa.scalar(file)).to_numpy(zero_copy_only=False))[0])
            if file != self.file:
                yield from self.end()
                self.begin(file, batch.column(1)[start].as_py())
            yield from self.lines(batch.column(1).slice(start, n), batch.column(2).slice(start, n))
            start += n

    def lines(self, order: pa.Array, values: pa.Array) -> Iterator[pa.RecordBatch]:
        k, n = LineKinds(values), len(values)
        before = self.before or (LineKinds.NONE, False, False)
        shifted = lambda a, first: np.concatenate([[first], a[:-1]])
        kind, opened, users = shifted(k.kind, before[0]), shifted(k.open, before[1]), shifted(k.users, before[2])
        places = np.maximum.accumulate(np.where(k.kind != LineKinds.NONE, np.arange(n), -1))
        marks = np.where(places < 0, self.mark, k.kind[places])
        none = k.kind == LineKinds.NONE
        first = ~(none & (marks == LineKinds.BOOL) & opened | (k.kind == LineKinds.LOAD) & (kind == LineKinds.LOAD) & k.counts & users)
        # not known: unmarked lines before the first mark that follow an open one, and the first line
        unknown = none & (marks == LineKinds.NONE) & opened
        if self.before is None:
            unknown[0] = none[0] or k.kind[0] == LineKinds.LOAD and k.counts[0]
        # messages are whole from where a line is known to be a first one, after or at the first mark
        begins = np.flatnonzero(first & ~unknown & (marks != LineKinds.NONE))
        rest = lambda a, b: [(order[i].as_py(), values[i].as_py(), None if unknown[i] else bool(first[i]), int(k.kind[i]), bool(k.users[i]), bool(k.counts[i]), bool(k.open[i])) for i in range(a, b)]
        goes_on = rest(0, int(begins[0]) if len(begins) else n)
        if self.head:
            yield from self.border(goes_on)
        else:
            self.held += goes_on
        if len(begins):
            yield from self.flush()
            ends = np.append(begins[1:], n)
            single = pa.array(begins[:-1][ends[:-1] - begins[:-1] == 1])
            yield self.batch(len(single), at=order.take(single), value=values.take(single), whole=True)
            several = np.flatnonzero(ends[:-1] - begins[:-1] > 1)
            text = [" ".join(values.slice(begins[i], ends[i] - begins[i]).to_pylist()) for i in several]
            yield self.batch(len(several), at=[order[int(begins[i])].as_py() for i in several], value=text, whole=True)
            self.head, self.held = False, rest(int(begins[-1]), n)
        self.before = (int(k.kind[-1]), bool(k.open[-1]), bool(k.users[-1]))
        self.mark = int(marks[-1])

    def batch(self, n: int, **columns) -> pa.RecordBatch:
        columns = {"file": self.file, "part": self.part} | columns
        full = lambda c, kind: pa.array([columns.get(c)] * n, kind) if not isinstance(columns.get(c), (list, pa.Array)) else pa.array(columns[c], kind) if isinstance(columns[c], list) else columns[c]
        return pa.RecordBatch.from_arrays([full(c, kind) for c, kind in self.COLUMNS.items()], names=[self.order if c == "at" else c for c in self.COLUMNS])

    def border(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Lines of a partition's first or last message, each as a row."""
        if rows:
            at, value, first, kind, users, counts, opened = map(list, zip(*rows, strict=True))
            yield self.batch(len(rows), at=at, value=value, whole=False, first=first, kind=kind, users=users, counts=counts, open=opened)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The message that was held, whole."""
        if self.held:
            yield self.batch(1, at=[self.held[0][0]], value=[" ".join(h[1] for h in self.held)], whole=True)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.file is None:
            return
        yield from self.border(self.held)
        kind, opened, users = self.before
        yield self.batch(1, at=[self.part], value=[None], whole=False, kind=[kind], users=[users], open=[opened], last_kind=[self.mark or None])


def render_messages(messages: DataFrame, name: str = "text") -> DataFrame:
    """Add the canonical text of each message; ``parse_lines`` gives the message back."""
    stamp = F.expr("format_string('audit(%d.%06d:%d)', unix_micros(ts) div 1000000, pmod(unix_micros(ts), 1000000L), coalesce(serial, 0L))")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("ts"))
    date = F.concat(month, F.format_string(" %2d ", F.dayofmonth("ts")), F.date_format("ts", "HH:mm:ss"))
    head = F.concat(date, F.lit(" "), F.coalesce("host", F.lit("localhost")), F.lit(" kernel: "), F.when(F.col("has_year"), F.concat(stamp, F.lit(": "))).otherwise(""))
    have = set(messages.columns)
    first_key = {}
    for k, (c, _) in KEYS.items():
        first_key.setdefault(c, k)
    quoted = {"exe", "comm", "path", "name"}
    text = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), F.concat(F.lit('"'), F.col(c), F.lit('"')) if c in quoted else F.col(c).cast("string"))) for c, k in first_key.items() if c in have]
    avc = F.concat(F.lit("avc:  "), F.col("decision"), F.lit("  { "), F.array_join("perms", " "), F.lit(" } for  "), F.concat_ws(" ", *text))
    boolean = F.concat(F.lit("security: committed booleans: { "), F.array_join(F.transform("changes", lambda c: F.concat(c["bool"], F.lit(":"), F.when(c["value"], "1").otherwise("0"))), ", "), F.lit(" }"))
    load = F.concat(F.lit("security: "), F.concat_ws(", ", *[F.concat(F.col(f"load.{c}").cast("string"), F.lit(f" {c}")) for c in ("users", "roles", "types", "bools", "classes", "rules")]))
    body = F.when(F.col("msg_type") == "AVC", avc).when(F.col("msg_type") == "BOOL", boolean).otherwise(load)
    return messages.withColumn(name, F.concat(head, body))


def export_messages(messages: DataFrame, path: str) -> None:
    """Write messages as text lines."""
    render_messages(messages, "value").select("value").write.text(path)
