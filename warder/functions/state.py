"""Tables that cut the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared folder ``spark.checkpoint.dir``.

    A session in local mode that names none (as in tests) gets a temporary folder; on a
    cluster the setting must be there, as all executors have to see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="warder-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/warder/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, at the end of a job: results that have
    not been written by then can no longer be read."""
    delete(spark, scratch_root(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """A table that is replaced round by round; each is deleted when the next has been written.

    ``put`` takes aggregates to find out on the way; ``seen`` has what they came to, without a
    job of its own. They should not mind rows that are counted twice, as when a task is repeated.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.seen = spark, name, None, {}

    def put(self, df: DataFrame, **find: Column) -> DataFrame:
        before, self.path = self.path, scratch_path(self.spark, self.name)
        if find:
            found = Observation()
            df.observe(found, *[c.alias(name) for name, c in find.items()]).write.parquet(self.path)
            self.seen = found.get
        else:
            df.write.parquet(self.path)
        if before:
            delete(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
