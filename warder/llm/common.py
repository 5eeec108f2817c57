"""Shared helpers: scratch tables, exact ranks without a single task, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Folders of open ``temporary`` blocks, innermost last.
_OPEN: list[str] = []


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


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application."""
    return f"{_OPEN[-1] if _OPEN else scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, at the end of a job: results that have
    not been written by then can no longer be read."""
    delete(spark, scratch_root(spark))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within the block are deleted at its end; write results elsewhere."""
    _OPEN.append(scratch(spark, "block"))
    try:
        yield
    finally:
        delete(spark, _OPEN.pop())


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for a block."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Arrow batches of texts are held several times over by a Python worker.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def write_table(df: DataFrame, path: str) -> None:
    with settings(df.sparkSession, SMALL_BATCHES):
        df.write.parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the scratch folder and read it back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distilled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() returns as a staged table; scratch tables made on the way are deleted."""
    path = scratch(spark, name)
    with temporary(spark):
        df = build()
        write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has (names differ by case nowhere)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", parts: int = 256) -> DataFrame:
    """Add a gapless 0-based rank within each group of ``keys``.

    A group is dealt over ``parts`` hash parts of ``order``, each ranked on its own and
    moved up by the counts of the parts before it, so a group with a third of all rows
    is ranked by many tasks. The order is therefore (part, order). df is read twice:
    pass a table, not a costly plan. Keys must not be null.
    """
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    by = [*keys, "__part"]
    sizes = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (
        dealt.withColumn("__inner", inner)
        .join(starts, by)
        .withColumn(rank, F.col("__start") + F.col("__inner") - 1)
        .drop("__part", "__inner", "__start")
    )


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Apply f to each Arrow batch of df's partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def join_counted(df: DataFrame, table: DataFrame, keys: list[str], count: str, spread: list[str], found: str) -> DataFrame:
    """Left-join a staged table of unique keys; its row arrives as the struct column ``found``.

    ``count`` says how many rows of df a key has. Keys with a thousandth of the counted rows
    or more are at most a thousand, the bound of what is broadcast; their rows skip the
    shuffle by key and are dealt out by ``spread``. Keys must not be null.
    """
    least = (table.agg(F.sum(count)).first()[0] or 0) // 1000 + 1
    values = F.struct(*[c for c in table.columns if c not in keys])
    hot = table.filter(F.col(count) >= least).select(*keys, values.alias("__hot"))
    rest = table.filter(F.col(count) < least).select(*keys, F.lit(0).alias("__salt"), values.alias("__rest"))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(4093)).cast("int"))
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", salt)
        .join(rest, [*keys, "__salt"], "left")
        .withColumn(found, F.coalesce("__hot", "__rest"))
        .drop("__salt", "__hot", "__rest")
    )
