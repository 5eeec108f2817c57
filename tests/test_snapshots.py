"""Snapshots on disk."""

import pytest
from pyspark.sql import functions as F

from warder.operators import snapshot_diff
from warder.sources.snapshots import SnapshotError, read_policy_tables, write_policy_tables


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    rules = spark.createDataFrame([(p, i, f"s{i}", "t", 7) for p in ("A", "B", "C") for i in range(5)], "policy_id string, id long, source string, target string, extra int")
    write_policy_tables({"role_allow": rules.select("policy_id", "source", "target", "extra")}, root)
    one = read_policy_tables(spark, root)["role_allow"]
    assert one.columns == ["source", "target", "policy_id"] and one.count() == 15
    # a policy is one folder, and a search of one reads no other
    (tmp_path / "role_allow" / "policy_id=B" / "broken.parquet").write_bytes(b"not parquet")
    for found in (read_policy_tables(spark, root, policies=["A"])["role_allow"], read_policy_tables(spark, root, ["role_allow"], ["A", "none"])["role_allow"].filter("policy_id = 'A'")):
        assert found.count() == 5
        plan = found._jdf.queryExecution().toString()
        assert "PartitionFilters: [" in plan and "policy_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # writing a policy again replaces it alone
    write_policy_tables({"role_allow": rules.filter("policy_id = 'C' and id < 2")}, root)
    assert read_policy_tables(spark, root, policies=["A", "C"])["role_allow"].groupBy("policy_id").count().orderBy("policy_id").collect() == [("A", 5), ("C", 2)]


def test_bad_columns_are_named(spark, tmp_path):
    bad = spark.createDataFrame([("A", 1)], "policy_id string, target int")
    with pytest.raises(SnapshotError, match="source string is missing; target is int, not string"):
        write_policy_tables({"role_allow": bad}, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    bad.write.partitionBy("policy_id").parquet(str(tmp_path / "y" / "role_allow"))
    with pytest.raises(SnapshotError, match="role_allow: source string is missing"):
        read_policy_tables(spark, str(tmp_path / "y"))
    with pytest.raises(FileNotFoundError):
        read_policy_tables(spark, str(tmp_path / "y"), ["types"])
    with pytest.raises(KeyError):
        write_policy_tables({"nothing": bad}, str(tmp_path))
    assert read_policy_tables(spark, str(tmp_path / "empty")) == {}


def scanned_rows(df):
    """Rows that the file scans of an executed plan gave."""
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if name == "FileSourceScanExec" and "/rows" in node.toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_stored_diff_reads_what_changed(spark, tmp_path):
    root, n = str(tmp_path / "s"), 5000
    rules = [("A", f"s{i}", f"t{i % 50}", ["read", "write"]) for i in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "policy_id string, source string, target string, perms array<string>")
    snapshot_diff.store_snapshots(make(rules), root, ["source", "target"], "perms")
    same = [("B", *r[1:3], list(reversed(r[3]))) for r in rules]
    snapshot_diff.store_snapshots(make(same), root, ["source", "target"], "perms")
    changed = [("C", *r[1:]) for r in rules if r[1] != "s7"]
    changed[20] = (*changed[20][:3], ["read"])
    snapshot_diff.store_snapshots(make([*changed, ("C", "new", "t", ["x"])]), root, ["source", "target"], "perms")
    of = lambda *p: spark.createDataFrame(p, "orig_id string, mod_id string")
    diff = lambda pairs: snapshot_diff.diff_stored(spark, root, pairs, ["source", "target"], "perms", "allow")
    none = diff(of(("A", "B"), ("B", "A")))
    assert none.collect() == [] and scanned_rows(none) == 0
    some = diff(of(("A", "C"), ("C", "B")))
    got = {(r["orig_id"], r["key"]): (r["form"], r["added"], r["removed"]) for r in some.collect()}
    key = " ".join(changed[20][1:3])
    assert got == {
        ("A", "s7 t7"): ("removed", [], ["read", "write"]), ("A", key): ("modified", [], ["write"]), ("A", "new t"): ("added", ["x"], []),
        ("C", "s7 t7"): ("added", ["read", "write"], []), ("C", key): ("modified", ["write"], []), ("C", "new t"): ("removed", [], ["x"]),
    }
    # three changes are in at most three of 64 buckets of each snapshot
    assert 0 < scanned_rows(some) < 3 * n * 4 * 3 / 64


def test_digests_are_of_the_rows_that_are_stored(spark, tmp_path):
    # a plan that gives other rows each time it runs is run once
    root = str(tmp_path / "s")
    rules = spark.range(200).select(F.lit("A").alias("policy_id"), F.col("id").cast("string").alias("source"), F.array(F.uuid()).alias("perms"))
    snapshot_diff.store_snapshots(rules, root, ["source"], "perms", buckets=4)
    sums = [snapshot_diff.digest(["source"], "perms", n).alias(f"d{n}") for n in (0, 1)]
    stored = spark.read.parquet(f"{root}/rows").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), *sums)
    want = {tuple(r) for r in spark.read.parquet(f"{root}/digests").select("slice", "n", "d0", "d1").collect()}
    assert {tuple(r) for r in stored.collect()} == want and len(want) == 4
