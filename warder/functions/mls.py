"""Levels and ranges: struct<sens, rank, cats> and struct<low, high>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(sens: Column, rank: Column, cats: Column) -> Column:
    return F.struct(sens.alias("sens"), rank.alias("rank"), cats.alias("cats"))


def level_range(low: Column, high: Column | None = None) -> Column:
    return F.struct(low.alias("low"), (low if high is None else high).alias("high"))


def high_of(r: Column) -> Column:
    """A range without high level is its low level."""
    return F.coalesce(r["high"], r["low"])


def within(a: Column, b: Column) -> Column:
    """All categories of level a are among those of b."""
    return F.size(F.array_except(F.coalesce(a["cats"], F.array().cast("array<string>")), F.coalesce(b["cats"], F.array().cast("array<string>")))) == 0


def level_compare(a: Column, b: Column) -> Column:
    """'eq', 'dom', 'domby' or 'incomp'."""
    a_in_b, b_in_a = within(a, b), within(b, a)
    return (
        F.when((a["rank"] == b["rank"]) & a_in_b & b_in_a, "eq")
        .when((a["rank"] >= b["rank"]) & b_in_a, "dom")
        .when((a["rank"] <= b["rank"]) & a_in_b, "domby")
        .otherwise("incomp")
    )


def dominates(a: Column, b: Column) -> Column:
    return (a["rank"] >= b["rank"]) & within(b, a)


def range_includes_level(r: Column, x: Column) -> Column:
    return dominates(x, r["low"]) & dominates(high_of(r), x)


def range_contains(r: Column, sub: Column) -> Column:
    return range_includes_level(r, sub["low"]) & range_includes_level(r, high_of(sub))


def range_compare(target: Column, search: Column, relation: str) -> Column:
    """How a row's range stands to the one asked for: exact, sub (asked for lies within the
    row's), super (the row's lies within), intersect (they share a level)."""
    if relation == "exact":
        return range_contains(target, search) & range_contains(search, target)
    if relation == "sub":
        return range_contains(target, search)
    if relation == "super":
        return range_contains(search, target)
    if relation == "intersect":
        # the least level above both lows lies below both highs
        low = level(F.lit(None).cast("string"), F.greatest(target["low"]["rank"], search["low"]["rank"]), F.array_union(target["low"]["cats"], search["low"]["cats"]))
        return dominates(high_of(target), low) & dominates(high_of(search), low)
    raise ValueError(f"unknown range relation {relation!r}")


def level_validate(x: Column, allowed_cats: Column) -> Column:
    """The categories are legal for the sensitivity."""
    return F.size(F.array_except(x["cats"], allowed_cats)) == 0


def range_validate(r: Column, low_cats: Column, high_cats: Column) -> Column:
    return dominates(high_of(r), r["low"]) & level_validate(r["low"], low_cats) & level_validate(high_of(r), high_cats)


def cat_spans(text: Column) -> Column:
    """Category names of ``c0.c5,c7``: spans run over the number at the end of the name."""

    def names(part: Column) -> Column:
        ends = F.split(part, r"\.")
        stem = F.regexp_extract(ends[0], r"^(.*?)\d*$", 1)
        number = lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("int")
        return F.when(F.size(ends) == 2, F.transform(F.sequence(number(ends[0]), number(F.get(ends, F.lit(1)))), lambda n: F.concat(stem, n.cast("string")))).otherwise(F.array(part))

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.flatten(F.transform(parts, lambda x: names(F.trim(x))))


def parse_level(text: Column) -> Column:
    """``s2:c0.c3,c5`` as a level; the rank is the number at the end of the sensitivity."""
    halves = F.split(F.trim(text), ":", 2)
    return level(halves[0], F.regexp_extract(halves[0], r"(\d+)$", 1).cast("int"), cat_spans(F.get(halves, F.lit(1))))


def parse_range(text: Column) -> Column:
    """``low`` or ``low - high``."""
    halves = F.split(text, r"\s*-\s*", 2)
    return level_range(parse_level(halves[0]), parse_level(F.coalesce(F.get(halves, F.lit(1)), halves[0])))


def render_level(x: Column) -> Column:
    """Text of a level; runs of three or more categories are written as spans."""
    numbers = F.array_sort(F.transform(x["cats"], lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))

    def span(s: Column) -> Column:
        name = lambda v: F.concat(F.lit("c"), v.cast("string"))
        return F.when(s["a"].isNull(), F.array().cast("array<string>")).when(s["b"] - s["a"] >= 2, F.array(F.concat(name(s["a"]), F.lit("."), name(s["b"])))).when(s["b"] > s["a"], F.array(name(s["a"]), name(s["b"]))).otherwise(F.array(name(s["a"])))

    cats = F.aggregate(
        numbers,
        start,
        lambda s, n: F.when(s["b"] == n - 1, F.struct(s["done"].alias("done"), s["a"].alias("a"), n.alias("b"))).otherwise(F.struct(F.concat(s["done"], span(s)).alias("done"), n.alias("a"), n.alias("b"))),
        lambda s: F.concat(s["done"], span(s)),
    )
    return F.when(F.size(cats) == 0, x["sens"]).otherwise(F.concat(x["sens"], F.lit(":"), F.array_join(cats, ",")))


def render_range(r: Column) -> Column:
    low, high = render_level(r["low"]), render_level(high_of(r))
    return F.when(low == high, low).otherwise(F.concat(low, F.lit(" - "), high))


def range_levels(r: Column, sens_cats: Column) -> Column:
    """Levels that a range spans: for each rank from low to high the categories of the high
    level that are legal there. ``sens_cats``: map rank -> struct<sens, cats>."""
    ranks = F.sequence(r["low"]["rank"], high_of(r)["rank"])
    return F.transform(ranks, lambda k: F.struct(sens_cats[k]["sens"].alias("sens"), k.alias("rank"), F.array_intersect(high_of(r)["cats"], sens_cats[k]["cats"]).alias("cats")))
