"""Counts and reports over audit messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.operators.audit_filter import View
from warder.sources.audit_log import render_messages

SYMBOLS = {"user": ("suser", "tuser"), "role": ("srole", "trole"), "type": ("stype", "ttype"), "level": ("smls_lvl", "tmls_lvl"), "clearance": ("smls_clr", "tmls_clr"), "class": ("tclass",)}


def counts() -> list:
    one = lambda c: F.count(F.when(c, 1))
    return [
        F.count(F.lit(1)).alias("total"),
        one(F.col("decision") == "denied").alias("denied"),
        one(F.col("decision") == "granted").alias("granted"),
        one(F.col("msg_type") == "BOOL").alias("bool_changes"),
        one(F.col("msg_type") == "LOAD").alias("policy_loads"),
    ]


def view_counts(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, denied, granted, boolean changes and policy loads."""
    return messages.groupBy(*(by or [])).agg(*counts())


def is_toggle() -> Column:
    return F.coalesce((F.col("decision") == "granted") & (F.col("ttype") == "security_t") & (F.col("tclass") == "security") & F.array_contains("perms", "setenforce"), F.lit(False))


def enforce_toggles(messages: DataFrame) -> DataFrame:
    """Granted setenforce permissions on the security class."""
    return messages.filter(is_toggle())


def policy_loads(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("msg_type") == "LOAD")


def boolean_changes(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("msg_type") == "BOOL")


def avc_listing(messages: DataFrame, decision: str) -> DataFrame:
    return messages.filter(F.col("decision") == decision)


def distinct_symbols(messages: DataFrame, kind: str) -> DataFrame:
    """Distinct users, roles, types, levels, clearances or classes seen."""
    columns = [c for c in SYMBOLS[kind] if c in messages.columns]
    return messages.select(F.explode(F.array_compact(F.array(*columns))).alias("symbol")).distinct()


def custom_section(messages: DataFrame, views: list[View]) -> DataFrame:
    """The messages of several views, each row with its view."""
    return reduce(lambda a, b: a.unionByName(b), [v.apply(messages).withColumn("view", F.lit(v.name)) for v in views])


#: Sections of a report in their order, the statistics before them.
SECTIONS = ("enforcement toggles", "policy loads", "boolean changes", "allow listing", "deny listing")


def report(messages: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """Ordered sections as (section_no, section, item_no, text); item 0 is the heading with its count.

    Messages are read once for the headings, counted with partial sums, and once for the
    items, each listed in the sections it belongs to.
    """
    tests = (is_toggle(), F.col("msg_type") == "LOAD", F.col("msg_type") == "BOOL", F.col("decision") == "granted", F.col("decision") == "denied")
    names = ("statistics", *SECTIONS)
    totals = messages.agg(F.count(F.lit(1)).alias("n1"), *[F.count(F.when(t, 1)).alias(f"n{i}") for i, t in enumerate(tests, 2)])
    heads = F.array(*[F.struct(F.lit(i).alias("section_no"), F.lit(n).alias("section"), F.lit(0).cast("long").alias("item_no"), F.concat(F.lit(f"{n}: "), F.col(f"n{i}").cast("string")).alias("text")) for i, n in enumerate(names, 1)])
    of = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(i).alias("section_no"), F.lit(n).alias("section"))) for i, (n, t) in enumerate(zip(SECTIONS, tests, strict=True), 2)]))
    items = render_messages(messages.withColumn("of", of).filter(F.size("of") > 0), "text")
    items = items.select(F.explode("of").alias("s"), (F.col("msg_id").cast("long") + 1).alias("item_no"), "text").select("s.*", "item_no", "text")
    out = totals.select(F.inline(heads)).unionByName(items)
    if malformed is not None:
        out = out.unionByName(malformed.select(F.lit(len(names) + 1).alias("section_no"), F.lit("malformed").alias("section"), F.monotonically_increasing_id().alias("item_no"), F.col("raw").alias("text")))
    return out


def write_report(rows: DataFrame, path: str, fmt: str = "text") -> None:
    ordered = rows.orderBy("section_no", "item_no")
    if fmt == "text":
        ordered.select(F.col("text").alias("value")).write.text(path)
    else:
        ordered.write.format(fmt).save(path)
