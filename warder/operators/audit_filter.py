"""Filters, sorts and views over audit messages."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions.ordering import numbered
from warder.functions.predicates import glob, glob_regex

#: Criteria by what they test: a value in a list, a glob, equality (fixed names).
LISTS = {"src_user": "suser", "src_role": "srole", "src_type": "stype", "src_mls_lvl": "smls_lvl", "src_mls_clr": "smls_clr", "tgt_user": "tuser", "tgt_role": "trole", "tgt_type": "ttype", "tgt_mls_lvl": "tmls_lvl", "tgt_mls_clr": "tmls_clr", "obj_class": "tclass"}
GLOBS = {"exe": "exe", "host": "host", "path": "path", "comm": "comm", "laddr": "laddr", "faddr": "faddr", "saddr": "saddr", "daddr": "daddr"}
EQUAL = {"inode": "inode", "pid": "pid", "lport": "lport", "fport": "fport", "sport": "sport", "dport": "dport", "port": "port", "netif": "netif", "key": "key", "cap": "cap", "msg": "decision"}
ADDRESSES = ["saddr", "daddr", "faddr", "laddr", "ipaddr"]
PORTS = ["port", "sport", "dport", "fport", "lport"]
CRITERIA = [*LISTS, *GLOBS, *EQUAL, "perm", "ipaddr", "anyport", "date_time"]


@dataclass
class DateRange:
    """before / after a time, or between two (start included, end not).

    Years count only where both the message and the filter know them.
    """

    relation: str
    start: dt.datetime
    end: dt.datetime | None = None
    has_year: bool = True

    def accepts(self) -> Column:
        def key(ts: Column, year: Column) -> Column:
            return F.struct(year.alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("d"), F.hour(ts).alias("h"), F.minute(ts).alias("i"), F.second(ts).alias("s"))

        ts = F.col("ts")
        use_year = F.coalesce(F.col("has_year"), F.lit(True)) & F.lit(self.has_year)
        own = key(ts, F.when(use_year, F.year(ts)).otherwise(0))
        at = lambda t: key(F.lit(t), F.when(use_year, F.lit(t.year)).otherwise(0))
        if self.relation == "before":
            return own < at(self.start)
        if self.relation == "after":
            return own > at(self.start)
        return (own >= at(self.start)) & (own < at(self.end))


def criterion(name: str, value: Any, columns: list[str]) -> tuple[Column, Column]:
    """(the message supports it, it accepts); a column the table lacks is unsupported."""

    def col(c: str) -> Column:
        return F.col(c) if c in columns else F.lit(None).cast("string")

    if name in LISTS:
        values = [value] if isinstance(value, str) else list(value)
        return col(LISTS[name]).isNotNull(), col(LISTS[name]).isin(values)
    if name in GLOBS:
        return col(GLOBS[name]).isNotNull(), glob(col(GLOBS[name]), value)
    if name in EQUAL:
        return col(EQUAL[name]).isNotNull(), col(EQUAL[name]) == value
    if name == "perm":
        perms = F.col("perms") if "perms" in columns else F.lit(None).cast("array<string>")
        return F.coalesce(F.size(perms) > 0, F.lit(False)), F.exists(perms, lambda p: p.rlike(glob_regex(value)))
    if name == "ipaddr":
        found = [F.coalesce(glob(col(c), value), F.lit(False)) for c in ADDRESSES]
        return F.coalesce(*[col(c) for c in ADDRESSES]).isNotNull(), reduce(lambda a, b: a | b, found)
    if name == "anyport":
        ports = [col(c).cast("int") for c in PORTS]
        some = [F.coalesce(p != 0, F.lit(False)) for p in ports]
        return reduce(lambda a, b: a | b, some), reduce(lambda a, b: a | b, [F.coalesce(p == value, F.lit(False)) & (p != 0) for p in ports])
    if name == "date_time":
        return col("ts").isNotNull(), value.accepts()
    raise ValueError(f"unknown criterion {name!r}")


@dataclass
class AuditFilter:
    """A set of criteria. ``match`` is 'all' or 'any'.

    Strict: a criterion that a message does not support does not match. Otherwise it is
    skipped; if all are skipped, 'all' accepts and 'any' rejects. Without criteria a strict
    filter rejects and another accepts.
    """

    criteria: dict[str, Any] = field(default_factory=dict)
    match: str = "all"
    strict: bool = False
    name: str = ""

    def accepts(self, columns: list[str]) -> Column:
        if not self.criteria:
            return F.lit(not self.strict)
        tests = []
        for name, value in self.criteria.items():
            supported, accepted = criterion(name, value, columns)
            accepted = F.coalesce(accepted, F.lit(False))
            supported = F.coalesce(supported, F.lit(False))
            if self.strict or self.match == "any":
                tests.append(supported & accepted)
            else:
                tests.append(~supported | accepted)
        return reduce((lambda a, b: a & b) if self.match == "all" else (lambda a, b: a | b), tests)


def view_filter(filters: list[AuditFilter], columns: list[str], match: str = "all") -> Column:
    """Filters together; none accept everything."""
    if not filters:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), [f.accepts(columns) for f in filters])


#: Sort keys and their columns (fixed names).
SORT_KEYS = {"date": "ts", "host": "host", "source_user": "suser", "source_role": "srole", "source_type": "stype", "source_level": "smls_lvl", "source_clearance": "smls_clr", "target_user": "tuser", "target_role": "trole", "target_type": "ttype", "target_level": "tmls_lvl", "target_clearance": "tmls_clr", "class": "tclass", "executable": "exe", "command": "comm", "name": "name", "path": "path", "device": "dev", "inode": "inode", "pid": "pid", "port": "port", "laddr": "laddr", "lport": "lport", "faddr": "faddr", "fport": "fport", "saddr": "saddr", "sport": "sport", "daddr": "daddr", "dport": "dport", "key": "key", "cap": "cap"}


def sort_key(name: str, columns: list[str], assume_year: int | None = None) -> Column:
    if name == "message_type":
        kind = F.when(F.col("msg_type") == "AVC", F.when(F.col("decision") == "denied", 0).otherwise(1)).when(F.col("msg_type") == "BOOL", 2).otherwise(3)
        return kind
    if name == "permission":
        return F.get("perms", F.lit(0))
    if name == "date" and "has_year" in columns and assume_year is not None:
        moved = F.try_make_timestamp(F.lit(assume_year), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.second("ts"))
        return F.when(F.col("has_year"), F.col("ts")).otherwise(moved)
    return F.col(SORT_KEYS[name])


def sort_order(messages: DataFrame, keys: list[tuple[str, bool]], tie: str = "msg_id", assume_year: int | None = None) -> list[Column]:
    """Sort expressions for keys (name, ascending). What lacks a key goes last in either
    direction; ties and messages without any key keep the order of ``tie``."""
    order = []
    for name, ascending in keys:
        c = sort_key(name, messages.columns, assume_year)
        order.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    return [*order, F.col(tie).asc()]


def sort_messages(messages: DataFrame, keys: list[tuple[str, bool]], tie: str = "msg_id", assume_year: int | None = None) -> DataFrame:
    """Messages in the order of the keys."""
    return messages.orderBy(*sort_order(messages, keys, tie, assume_year))


def place_messages(messages: DataFrame, keys: list[tuple[str, bool]], tie: str = "msg_id", assume_year: int | None = None) -> DataFrame:
    """Add the place of each message in the order of the keys, from 1."""
    return numbered(messages, sort_order(messages, keys, tie, assume_year), "place")


@dataclass
class View:
    """Filters, visibility, hidden messages and sorts over a table of messages."""

    filters: list[AuditFilter] = field(default_factory=list)
    match: str = "all"
    show: bool = True
    sorts: list[tuple[str, bool]] = field(default_factory=list)
    hidden: DataFrame | None = None
    name: str = ""

    def apply(self, messages: DataFrame, key: str = "msg_id") -> DataFrame:
        accepted = view_filter(self.filters, messages.columns, self.match)
        rows = messages.filter(accepted if self.show else ~accepted)
        if self.hidden is not None:
            rows = rows.join(self.hidden.select(key), key, "left_anti")
        return sort_messages(rows, self.sorts, key) if self.sorts else rows


FILTER_SCHEMA = "view string, filter string, criterion string, values array<string>, match string, strict boolean"


def saved_filters(rows: DataFrame) -> list[AuditFilter]:
    """Filters from their table; the table holds definitions, so it is small and read whole."""
    found: dict[str, AuditFilter] = {}
    for r in rows.orderBy("filter", "criterion").collect():
        f = found.setdefault(r["filter"], AuditFilter({}, r["match"], r["strict"], r["filter"]))
        values = list(r["values"])
        if r["criterion"] in LISTS:
            f.criteria[r["criterion"]] = values
        elif r["criterion"] == "date_time":
            f.criteria["date_time"] = DateRange(values[0], dt.datetime.fromisoformat(values[1]), dt.datetime.fromisoformat(values[2]) if len(values) > 2 else None)
        else:
            number = r["criterion"] in {"inode", "pid", "port", "lport", "fport", "sport", "dport", "key", "cap", "anyport"}
            f.criteria[r["criterion"]] = int(values[0]) if number else values[0]
    return list(found.values())


def filter_rows(spark, filters: list[AuditFilter], view: str = "") -> DataFrame:
    """The table form of filters, to be stored."""
    rows = []
    for f in filters:
        for c, v in f.criteria.items():
            if isinstance(v, DateRange):
                values = [v.relation, v.start.isoformat(), *([v.end.isoformat()] if v.end else [])]
            else:
                values = [v] if isinstance(v, str) else [str(v)] if isinstance(v, int) else [str(x) for x in v]
            rows.append((view, f.name, c, values, f.match, f.strict))
    return spark.createDataFrame(rows, FILTER_SCHEMA)


def apply_saved_filters(messages: DataFrame, filters: list[AuditFilter]) -> DataFrame:
    """(message, filter) hits of many filters in one pass over the messages."""
    hits = F.array_compact(F.array(*[F.when(f.accepts(messages.columns), F.lit(f.name)) for f in filters]))
    return messages.withColumn("filter", F.explode(hits))
