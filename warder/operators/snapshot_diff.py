"""Differences of stored snapshots that read only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.functions.state import written
from warder.operators.diff import deep_diff

#: Buckets of a snapshot: a change costs reading one of them on both sides.
BUCKETS = 64


def digest(identity: list[str], content: str, n: int) -> Column:
    """One of two sums of row hashes that do not depend on the order of rows."""
    return F.bit_xor(F.xxhash64(F.lit(n), *identity, F.array_sort(F.array_distinct(content))))


def store_snapshots(rows: DataFrame, root: str, identity: list[str], content: str, buckets: int = BUCKETS) -> None:
    """Write rows (policy_id, identity, content array) in buckets by the hash of their identity, and
    a digest of each bucket of each policy. Policies that are there are replaced, others stay.

    Below ``rows`` there is a folder for each policy and bucket; ``digests`` has one small row for
    each: the count of its rows and 128 bits over their identity and content. The rows are staged
    first, so that their plan runs once and a digest is of the rows that are stored.
    """
    bucket = F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int")
    dealt = written(rows.select("policy_id", *identity, content).withColumn("slice", F.concat_ws(".", "policy_id", bucket.cast("string"))), "dealt")
    place = {"partitionOverwriteMode": "dynamic"}
    dealt.repartition("slice").write.partitionBy("policy_id", "slice").options(**place).mode("overwrite").parquet(f"{root}/rows")
    sums = dealt.groupBy("policy_id", "slice").agg(F.count(F.lit(1)).alias("n"), digest(identity, content, 0).alias("d0"), digest(identity, content, 1).alias("d1"))
    sums.repartition("policy_id").write.partitionBy("policy_id").options(**place).mode("overwrite").parquet(f"{root}/digests")


def differing_buckets(spark: SparkSession, root: str, pairs: DataFrame) -> DataFrame:
    """(orig_id, mod_id, orig_slice, mod_slice) of the buckets that are not the same in both
    snapshots of a pair; one that is empty on a side counts too."""
    sums = spark.read.parquet(f"{root}/digests").withColumn("policy_id", F.col("policy_id").cast("string"))
    sums = sums.select("policy_id", F.substring_index("slice", ".", -1).alias("bucket"), F.struct("n", "d0", "d1").alias("sum"))
    key = ["orig_id", "mod_id", "bucket"]
    asked = F.broadcast(pairs.select("orig_id", "mod_id").distinct())
    of = lambda side, name: sums.join(asked, sums.policy_id == asked[side]).select(*key, F.col("sum").alias(name))
    both = of("orig_id", "old").join(of("mod_id", "new"), key, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    at = lambda side: F.concat_ws(".", side, "bucket")
    return both.select("orig_id", "mod_id", at("orig_id").alias("orig_slice"), at("mod_id").alias("mod_slice"))


def diff_stored(spark: SparkSession, root: str, pairs: DataFrame, identity: list[str], content: str, component: str) -> DataFrame:
    """Differences (see ``deep_diff``) of stored snapshots, for all pairs (orig_id, mod_id).

    Digests of buckets are compared first; only buckets that differ are read, by pruning the
    folders of the scan with them, and only their rows are joined and compared. What is read
    grows with what changed, not with the snapshots. Names are compared as they are: snapshots
    between which types were renamed need ``diff_avrules``.
    """
    need = written(differing_buckets(spark, root, pairs), "buckets")
    rows = spark.read.parquet(f"{root}/rows").drop("policy_id")

    def side(slice_: str) -> DataFrame:
        # the comparison tells the optimizer that the join leaves few slices
        asked = need.select("orig_id", "mod_id", F.col(slice_).alias("slice")).filter(F.col("slice") > "")
        return rows.join(F.broadcast(asked), "slice").drop("slice")

    return deep_diff(side("orig_slice"), side("mod_slice"), identity, content, component)
