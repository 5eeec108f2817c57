"""Permission maps: class and permission to direction (r, w, b, n, u) and weight 1 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_WEIGHT = 10


def clamped(weight):
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(weight, F.lit(DEFAULT_WEIGHT)))).cast("int")


def read_perm_map(spark: SparkSession, path: str) -> DataFrame:
    """Text form: a number of classes, then ``class NAME COUNT`` and a line ``perm direction
    [weight]`` for each permission; ``#`` begins a comment. Maps are small files, read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("no", "line"))
    words = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    rows = lines.withColumn("w", words)
    name = F.when((F.col("w")[0] == "class") & (F.size("w") == 3), F.col("w")[1])
    rows = rows.withColumn("class", F.last(name, ignorenulls=True).over(Window.partitionBy("file").orderBy("no")))
    perms = rows.filter((F.size("w") >= 2) & (F.col("w")[0] != "class") & F.col("class").isNotNull())
    return perms.select("class", F.col("w")[0].alias("perm"), F.lower(F.col("w")[1]).alias("direction"), clamped(F.get("w", F.lit(2)).try_cast("int")).alias("weight"))


def write_perm_map(perm_map: DataFrame, path: str) -> None:
    """The text form in one file; maps are small."""
    body = perm_map.groupBy("class").agg(F.array_sort(F.collect_list(F.format_string("%18s %s %d", "perm", "direction", "weight"))).alias("p"))
    text = body.select(F.concat(F.lit("class "), F.col("class"), F.lit(" "), F.size("p").cast("string"), F.lit("\n"), F.array_join("p", "\n")).alias("value"), "class")
    head = body.agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("class", F.lit(""))
    head.unionByName(text).coalesce(1).sortWithinPartitions("class").select("value").write.text(path)


def override_perm_map(perm_map: DataFrame, changes: DataFrame) -> DataFrame:
    """Other directions and weights for some (class, perm); nulls keep what there is."""
    new = changes.select("class", "perm", F.col("direction").alias("d"), F.col("weight").alias("w"))
    joined = perm_map.join(F.broadcast(new), ["class", "perm"], "left")
    return joined.select("class", "perm", F.coalesce("d", "direction").alias("direction"), clamped(F.coalesce("w", "weight")).alias("weight"))


def unmapped_perms(perm_map: DataFrame, class_perm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(permissions of the policy without a mapping, mappings the policy does not know)."""
    own = class_perm.select("class", "perm").distinct()
    mapped = perm_map.filter("direction <> 'u'").select("class", "perm")
    return own.join(mapped, ["class", "perm"], "left_anti"), perm_map.join(own, ["class", "perm"], "left_anti")
