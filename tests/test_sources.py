import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from warder.functions import net
from warder.sources import perm_map


def test_perm_map(spark, tmp_path):
    (tmp_path / "map").write_text("2\n# a comment\nclass file 3\n  read r 10\n  write w 99 # strong\n  lock n\nclass dir 1\nsearch R 0\n")
    got = perm_map.read_perm_map(spark, str(tmp_path / "map"))
    rows = {(r["class"], r["perm"]): (r["direction"], r["weight"]) for r in got.collect()}
    assert rows == {("file", "read"): ("r", 10), ("file", "write"): ("w", 10), ("file", "lock"): ("n", 10), ("dir", "search"): ("r", 1)}
    perm_map.write_perm_map(got, str(tmp_path / "out"))
    again = perm_map.read_perm_map(spark, str(tmp_path / "out"))
    assert {(r["class"], r["perm"]): (r["direction"], r["weight"]) for r in again.collect()} == rows
    changes = spark.createDataFrame([("file", "read", None, 3)], "class string, perm string, direction string, weight int")
    assert perm_map.override_perm_map(got, changes).filter("perm = 'read'").first()["weight"] == 3
    own = spark.createDataFrame([("file", "read"), ("file", "new")], "class string, perm string")
    missing, unknown = perm_map.unmapped_perms(got, own)
    assert [r["perm"] for r in missing.collect()] == ["new"] and unknown.count() == 3


@pytest.mark.parametrize(("text", "want"), [("1.2.3.4", 16909060), ("256.1.1.1", None), ("1.2.3", None), ("a.b.c.d", None), ("255.255.255.255", 2**32 - 1)])
def test_ipv4(spark, text, want):
    r = spark.range(1).select(net.ipv4(F.lit(text)).alias("n"), net.ipv4_text(net.ipv4(F.lit(text))).alias("t")).first()
    assert r["n"] == want and (want is None or r["t"] == text)


@pytest.mark.parametrize(("text", "want"), [("::1", "0" * 31 + "1"), ("fe80::A:b", "fe80" + "0" * 20 + "000a000b"), ("1:2:3:4:5:6:7:8", "00010002000300040005000600070008"), ("1:2", None), ("x::1", None)])
def test_ipv6(spark, text, want):
    assert spark.range(1).select(net.ipv6(F.lit(text)).alias("x")).first()["x"] == want


def test_lookups(spark):
    nets = spark.createDataFrame([("10.0.0.0", "255.0.0.0", "wide"), ("10.1.0.0", "255.255.0.0", "near")], "a string, m string, type string").select(net.ipv4(F.col("a")).alias("addr"), net.ipv4(F.col("m")).alias("mask"), "type")
    ips = spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("11.0.0.1",)], "ip string").withColumn("n", net.ipv4(F.col("ip")))
    assert {r["ip"]: r["type"] for r in net.subnet_lookup(ips, "n", nets).collect()} == {"10.1.2.3": "near", "10.9.9.9": "wide"}
    ports = spark.createDataFrame([(1, 100, "many"), (80, 80, "one")], "low int, high int, type string")
    assert {r["p"]: r["type"] for r in net.port_lookup(spark.createDataFrame([(80,), (81,), (200,)], "p int"), "p", ports).collect()} == {80: "one", 81: "many"}


@pytest.mark.parametrize("text", ["::", "::1", "1::", "fe80::1:0:0:2", "1:0:0:2::", "0:0:1::", "1:2:3:4:5:6:7:8", "1:0:3:4:5:6:7:8", "2001:db8::ff00:42:8329", "0:1:0:1:0:1:0:1", "ffff::8000:0:0:1"])
def test_ipv6_text(spark, text):
    digits = net.ipv6(F.lit(text))
    r = spark.range(1).select(net.ipv6_text(digits).alias("t"), net.ipv6_digits(net.ipv6_number(digits)).alias("d"), digits.alias("x")).first()
    assert r["t"] == str(ipaddress.IPv6Address(text)) and r["d"] == r["x"] == ipaddress.IPv6Address(text).exploded.replace(":", "")


def test_ipv6_subnets(spark):
    rng = random.Random(2)
    nets = {ipaddress.ip_network((rng.getrandbits(4) << 124 | rng.getrandbits(6) << 60, n), strict=False) for n in (0, 2, 4, 66, 68, 128) for _ in range(6)}
    number = lambda c: net.ipv6_number(net.ipv6(F.col(c)))
    table = spark.createDataFrame([(str(n.network_address), str(n.netmask), str(n)) for n in nets], "a string, m string, type string").select(number("a").alias("addr"), number("m").alias("mask"), "type")
    ips = [ipaddress.IPv6Address(rng.getrandbits(4) << 124 | rng.getrandbits(6) << 60) for _ in range(200)]
    rows = spark.createDataFrame([(str(i),) for i in set(ips)], "ip string").withColumn("n", number("ip"))
    want = {str(ip): str(max((n for n in nets if ip in n), key=lambda n: n.prefixlen)) for ip in ips if any(ip in n for n in nets)}
    assert {r["ip"]: r["type"] for r in net.ipv6_subnet_lookup(rows, "n", table).collect()} == want


def test_lookups_do_not_group_the_rows(spark):
    nets = spark.createDataFrame([("fd00:1::", "ffff:ffff::", "a"), ("fd00:1::1", "ffff:ffff::", "b"), ("fd00:1:2::", "ffff:ffff:ffff::", "c")], "a string, m string, type string")
    number = lambda c: net.ipv6_number(net.ipv6(F.col(c)))
    table = nets.select(number("a").alias("addr"), number("m").alias("mask"), "type")
    rows = spark.createDataFrame([(1, "fd00:1::9"), (1, "fd00:1::9"), (2, "fd00:1:2::9"), (3, "fd01::"), (4, None)], "id int, ip string").withColumn("n", number("ip"))
    found = net.ipv6_subnet_lookup(rows, "n", table)
    assert sorted((r["id"], r["type"]) for r in found.collect()) == [(1, "b"), (1, "b"), (2, "c")]
    small = spark.createDataFrame([(10, 14, "x"), (9, 12, "y")], "addr long, mask long, type string")
    four = net.subnet_lookup(spark.createDataFrame([(1, 10), (1, 10), (2, 9), (3, 1)], "id int, n long"), "n", small)
    assert sorted((r["id"], r["type"]) for r in four.collect()) == [(1, "x"), (1, "x"), (2, "y")]
    assert four.columns == ["id", "n", "mask", "type"]
    # a largest row with text in it sorts all it aggregates, in the tasks that read the addresses
    for df in (found, four):
        assert "SortAggregate" not in df._jdf.queryExecution().toString()
