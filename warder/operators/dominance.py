"""Ranges that lie within others, by bit sets of categories and buckets of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions import mls

#: Distinct categories of all policies: the bound of what the driver reads to number them.
MOST_CATEGORIES = 4_096
WORD = 63


def categories(*ranges: DataFrame) -> list[str]:
    """The names of all categories in the columns ``range`` of the tables, in order."""
    names = None
    for df in ranges:
        both = F.explode(F.array_union(*[F.coalesce(x["cats"], F.array().cast("array<string>")) for x in (F.col("range")["low"], mls.high_of(F.col("range")))])).alias("cat")
        part = df.select(both).distinct()
        names = part if names is None else names.unionByName(part)
    found = [r["cat"] for r in names.distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    return sorted(found)


def bit_set(cats: Column, names: list[str]) -> Column:
    """Categories as an array of longs of WORD bits each."""
    if not names:
        return F.array(F.lit(0).cast("long"))
    at = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    places = F.transform(F.coalesce(cats, F.array().cast("array<string>")), lambda c: F.try_element_at(at, c))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p % WORD)

    def word(n: int) -> Column:
        here = F.filter(places, lambda p: F.floor(p / WORD) == n)
        return F.aggregate(here, F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(one(p)))

    return F.array(*[word(n) for n in range(-(-len(names) // WORD))])


def subset(a: Column, b: Column) -> Column:
    """Whether all bits of a are among those of b."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y) == x), lambda x: x)


def covered(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (keys, range, ...) whose range lies within one of the ``ranges`` (keys, range) of
    their keys; see ``mls.range_contains``.

    A range is entered once for each rank from its low to its high one; a row looks up its low
    rank, so it is joined with one row, which holds the distinct ranges there, and categories
    are compared by AND of bit sets.
    """
    names = categories(rows, ranges)
    low, high = F.col("range")["low"], mls.high_of(F.col("range"))
    sides = F.struct(low["rank"].alias("low_rank"), high["rank"].alias("high_rank"), bit_set(low["cats"], names).alias("low_cats"), bit_set(high["cats"], names).alias("high_cats"))
    may = ranges.filter(low["rank"] <= high["rank"]).select(*keys, F.sequence(low["rank"], high["rank"]).alias("ranks"), sides.alias("r"))
    may = may.select(*keys, F.explode("ranks").alias("rank"), "r").groupBy(*keys, "rank").agg(F.collect_set("r").alias("within"))
    asked = rows.withColumns({"rank": low["rank"], "r": sides}).join(may, [*keys, "rank"])
    s = F.col("r")

    def holds(m: Column) -> Column:
        ranks = (m["low_rank"] <= s["low_rank"]) & (m["low_rank"] <= s["high_rank"]) & (s["low_rank"] <= m["high_rank"]) & (s["high_rank"] <= m["high_rank"])
        return ranks & subset(m["low_cats"], s["low_cats"]) & subset(m["low_cats"], s["high_cats"]) & subset(s["low_cats"], m["high_cats"]) & subset(s["high_cats"], m["high_cats"])

    return asked.filter(F.exists("within", holds)).select(*rows.columns)
