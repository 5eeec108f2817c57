"""Addresses, subnets and port ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions.state import written


def ipv4(text: Column) -> Column:
    """Dotted address as a long; null if it is none."""
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.try_cast("long"))
    fine = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^\d{1,3}$") & (p.try_cast("int") <= 255))
    return F.when(fine, number)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def ipv6(text: Column) -> Column:
    """Address as 32 hexadecimal digits; null if it is none. ``::`` stands for as many zero
    groups as are missing."""
    halves = F.split(text, "::")
    groups = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), ":"), lambda g: g != "")
    head, tail = groups(halves[0]), groups(F.get(halves, F.lit(1)))
    short = F.size(halves) == 2
    gap = F.when(short, F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail))).otherwise(0)
    whole = F.concat(head, F.array_repeat(F.lit("0"), gap), tail)
    fine = (F.size(halves) <= 2) & (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
    return F.when(fine, F.array_join(F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0")), ""))


def ipv6_text(digits: Column) -> Column:
    """Shortest text of 32 hexadecimal digits: groups without leading zeros, ``::`` for the first of
    the longest runs of two or more zero groups."""
    groups = [F.regexp_replace(F.substring(digits, 4 * i + 1, 4), "^0{1,3}", "") for i in range(8)]
    plain = F.concat_ws(":", *groups)
    ends = F.concat(F.lit(":"), plain, F.lit(":"))
    out = plain
    for n in range(2, 9):
        run = ":" + "0:" * n
        at = F.instr(ends, run)
        tail = F.rtrim(F.substring(ends, at + len(run), F.lit(40)), F.lit(":"))
        out = F.when(at > 0, F.concat(F.substring(ends, F.lit(2), at - 2), F.lit("::"), tail)).otherwise(out)
    return out


def ipv6_number(digits: Column) -> Column:
    """32 hexadecimal digits as two signed longs (hi, lo)."""
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
    return F.when(digits.isNotNull(), F.struct(half(1).alias("hi"), half(17).alias("lo")))


def ipv6_digits(number: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(number[h])), 16, "0") for h in ("hi", "lo")])


def ipv6_subnet_lookup(addresses: DataFrame, column: str, subnets: DataFrame) -> DataFrame:
    """For IPv6 addresses (hi, lo) the subnet (addr and mask alike) that holds them, the one with
    the longest mask first; adds mask and the other columns of ``subnets``.

    The distinct masks (at most MASKS, read by the driver; prefixes are at most 129) are tried each
    by one equality join on the masked address.
    """
    masks = sorted((tuple(r["mask"]) for r in subnets.select("mask").distinct().limit(MASKS + 1).collect()), key=lambda m: sum((x % 2**64).bit_count() for x in m))
    if len(masks) > MASKS:
        raise ValueError(f"more than {MASKS} masks")
    tried = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(hi).cast("long").alias("hi"), F.lit(lo).cast("long").alias("lo")) for n, (hi, lo) in enumerate(masks)])
    tried = tried if masks else F.array().cast("array<struct<n:int,hi:bigint,lo:bigint>>")
    net = lambda a, m: F.struct(*[a[h].bitwiseAND(m[h]).alias(h) for h in ("hi", "lo")])
    table = subnets.withColumn("net", net(F.col("addr"), F.col("mask"))).drop("addr")
    return longest(addresses, column, table, tried, lambda m: F.struct(m["hi"].alias("hi"), m["lo"].alias("lo")), net)


def longest(addresses: DataFrame, column: str, table: DataFrame, tried: Column, mask: Callable[[Column], Column], net: Callable[[Column, Column], Column]) -> DataFrame:
    """Addresses with the row of ``table`` (mask, net, ...) of the last of the ``tried`` masks
    (n, ...) under which there is one; of several rows the largest.

    Each different address is looked up once, and only the number of its best mask is aggregated:
    rows are not grouped by address, which would sort them, repeated for each mask, in the tasks
    that read them. Then they meet what was found for their address.
    """
    more = [c for c in table.columns if c not in ("mask", "net")]
    # staged, as both are read twice, and null tests of the joins would be worked out for every row below
    addresses = written(addresses, "addresses")
    table = written(table.groupBy("mask", "net").agg(F.max(F.struct(F.lit(0).alias("__"), *more)).alias("s")), "subnets")
    keyed = addresses.select(F.col(column).alias("ip")).filter("ip is not null").distinct().withColumn("m", F.explode(tried))
    keyed = keyed.select("ip", F.col("m.n").alias("n"), mask(F.col("m")).alias("mask"), net(F.col("ip"), mask(F.col("m"))).alias("net"))
    best = keyed.join(table.select("mask", "net"), ["mask", "net"]).groupBy("ip").agg(F.max("n").alias("n"))
    best = best.withColumn("mask", mask(F.element_at(tried, F.col("n") + 1))).withColumn("net", net(F.col("ip"), F.col("mask")))
    found = best.join(table, ["mask", "net"]).select(F.col("ip").alias("__ip"), F.col("mask").alias("__mask"), F.col("net").alias("__net"), "s")
    hit = addresses.join(found, F.col(column) == F.col("__ip"))
    return hit.select(*addresses.columns, F.col("__mask").alias("mask"), F.col("__net").alias("net"), *[F.col(f"s.{c}").alias(c) for c in more])


#: Distinct subnet masks that a lookup takes.
MASKS = 1_000


def subnet_lookup(addresses: DataFrame, column: str, subnets: DataFrame) -> DataFrame:
    """For numeric addresses the subnet (addr, mask as longs) that holds them, the one with the
    longest mask first. The distinct masks (at most MASKS) are read by the driver, and each
    address is joined by equality once for each mask."""
    masks = sorted(r["mask"] for r in subnets.select("mask").distinct().limit(MASKS + 1).collect())
    if len(masks) > MASKS:
        raise ValueError(f"more than {MASKS} masks")
    tried = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).cast("long").alias("mask")) for n, m in enumerate(masks)])
    tried = tried if masks else F.array().cast("array<struct<n:int,mask:bigint>>")
    net = lambda a, m: a.bitwiseAND(m)
    table = subnets.withColumn("mask", F.col("mask").cast("long")).withColumn("net", net(F.col("addr"), F.col("mask"))).drop("addr")
    return longest(addresses, column, table, tried, lambda m: m["mask"], net).drop("net")


#: Port numbers there are: the bound of what a table of port statements is spread over.
PORTS = 65_536


def port_table(portcon: DataFrame) -> DataFrame:
    """Port statements (low, high, type, ...) with a row for each of their ports."""
    ports = F.sequence(F.greatest("low", F.lit(0)), F.least("high", F.lit(PORTS - 1)))
    return portcon.filter(F.col("low") <= F.col("high")).withColumn("port_no", F.explode(ports))


def port_matches(rows: DataFrame, column: str, portcon: DataFrame) -> DataFrame:
    """All statements of each port, by an equality join on the port number."""
    return rows.join(port_table(portcon), F.col(column) == F.col("port_no")).drop("port_no")


def port_lookup(rows: DataFrame, column: str, portcon: DataFrame) -> DataFrame:
    """The narrowest port statement (low, high, type) of each port."""
    best = F.min(F.struct((F.col("high") - F.col("low")).alias("width"), "low", "high", "type")).alias("s")
    narrow = port_table(portcon.select("low", "high", "type")).groupBy("port_no").agg(best)
    return rows.join(narrow, F.col(column) == F.col("port_no")).select(*rows.columns, "s.low", "s.high", "s.type")
