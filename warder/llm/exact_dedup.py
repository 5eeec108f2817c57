"""Exact deduplication as a stateful stream (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warder.llm.common import documents, free_name, join_counted, scratch, settings, staged

BLANKS = r"[\x20\x09-\x0D]+"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    # many small stores: without this each sets 4 MB of disk aside for its manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Members of a group compared by one task with one copy of the kept text.
SALT_ROWS = 256


def normalised(text: Column) -> Column:
    """The text without ASCII blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def entries(docs: DataFrame, digest=sha256) -> DataFrame:
    """What the stream carries of a document: digest, identifier, and where its text is."""
    norm = normalised(F.col("text"))
    at = F.col("_metadata")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"),
        digest(norm).alias("digest"),
        sha256(norm).alias("text_sha256"),
        at["file_path"].alias("file"),
        at["row_index"].alias("row"),
    )


def _any(path: str) -> str:
    """A pattern for exactly this path: a stream takes a single file only by pattern."""
    path = path.rstrip("/")
    plain = re.sub(r"([{}\[\]*?\\])", r"\\\1", path)
    return plain if plain != path else f"{path[:-1]}[{path[-1]}]"


def stream_entries(spark: SparkSession, path: str, schema: T.StructType, out: str, digest=sha256, files_per_trigger: int = 1000) -> None:
    """Stream the documents in ``path`` into an entry table."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(_any(path))
    run = entries(source, digest).writeStream.format("parquet").option("checkpointLocation", scratch(spark, "entries-log")).trigger(availableNow=True).start(out)
    run.awaitTermination()


def state_table(spark: SparkSession, schema: T.StructType, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Run the keyed state over an entry table and return its final contents.

    The state lives on disk (RocksDB), is keyed by digest and never expires. It holds the
    size of the group and of its best row the identifier and the content locator: most code
    points first, then smallest doc_id (null last), then file and row. Each trigger emits
    the keys it touched; the newest version of a key is the one with the largest count.
    """
    out = scratch(spark, "state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("best")
    state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best)

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with settings(spark, STATE):
        run = state.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "state-log")).trigger(availableNow=True).foreachBatch(emit).start()
        run.awaitTermination()
    return spark.read.schema(state.schema).parquet(out).groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s")).select("digest", "s.group_size", "s.best")


def collided(docs: DataFrame, state: DataFrame, digest=sha256) -> DataFrame:
    """Full-byte check of all hits: digests whose texts are not all equal.

    Rows of groups of two or more are joined to the text that their group keeps. The kept
    text is dealt out in ``group_size / SALT_ROWS`` copies, so no task compares more than
    about that many members of a group.
    """
    hits = state.filter("group_size > 1").select(F.col("digest"), "group_size", F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"))
    at = F.col("_metadata")
    norm = normalised(F.col("text"))
    texts = docs.select(digest(norm).alias("digest"), norm.alias("norm"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    found = join_counted(texts, hits, ["digest"], "group_size", ["file", "row"], "h").filter("h is not null")
    members = staged(found.select("*", "h.*").drop("h"), "hits")
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    is_kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    kept = members.filter(is_kept).select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("norm").alias("kept_norm"))
    rest = members.filter(~is_kept).select("digest", "norm", F.pmod(F.xxhash64("file", "row"), salts).cast("int").alias("salt"))
    return rest.join(kept, ["digest", "salt"]).filter(F.col("norm") != F.col("kept_norm")).select("digest").distinct()


def with_state(found: DataFrame, state: DataFrame) -> DataFrame:
    """Entries with group size and best row of their digest; rows of large groups skip the
    shuffle by digest."""
    return join_counted(found, state, ["digest"], "group_size", ["file", "row"], "s").select("*", "s.*").drop("s")


def decide(docs: DataFrame, found: DataFrame, state: DataFrame, digest=sha256) -> DataFrame:
    """One row per document: the row its group keeps, group size, and whether it stays."""
    here = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    columns = ["doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), here.alias("kept"), "text_sha256", "file", "row"]
    bad = staged(collided(docs, state, digest), "collided")
    if bad.isEmpty():
        return with_state(found, state).select(*columns)
    good = with_state(found.join(bad, "digest", "left_anti"), state).select(*columns)
    # unequal texts under one digest: group these by their bytes
    at = F.col("_metadata")
    norm = normalised(F.col("text"))
    texts = docs.select(digest(norm).alias("digest"), norm.alias("norm"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    rows = staged(texts.join(bad, "digest").join(found.drop("digest"), ["file", "row"]), "collided_rows")
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("best")
    groups = rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), best)
    return good.unionByName(rows.join(groups, ["digest", "norm"]).select(*columns))


def dedup_stream(spark: SparkSession, path: str, digest=sha256, files_per_trigger: int = 1000) -> DataFrame:
    """Deduplicate the Parquet documents in ``path``, read as a stream.

    Texts are equal when identical without ASCII blanks; null counts as empty. Of equal
    texts the row with most code points stays, then the smallest doc_id (null last), then
    the first by file and row, so repeated rows leave one. Every row of the table returns,
    with doc_id, keep_id, group_size, kept, text_sha256 and its locator (file, row). Other
    columns are not read; an empty table gives no rows.
    """
    docs = spark.read.parquet(path)
    at = scratch(spark, "entries")
    if docs.isEmpty():
        entries(docs, digest).write.parquet(at)
    else:
        stream_entries(spark, path, docs.schema, at, digest, files_per_trigger)
    return dedup_entries(docs, at, digest, files_per_trigger)


def locator(docs: DataFrame) -> tuple[str, str]:
    """Names of the locator's columns, file and row, beside those of the documents."""
    return free_name(docs, "__file"), free_name(docs, "__row")


def dedup_table(docs: DataFrame, digest=sha256, files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The same for documents that are a DataFrame: (documents with locators file and row, decisions).

    Documents that no longer are a file scan are written to the scratch folder first.
    """
    spark = docs.sparkSession
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        docs = staged(docs, "documents")
    at = scratch(spark, "entries")
    entries(docs, digest).write.parquet(at)
    file, row = locator(docs)
    located = docs.select("*", F.col("_metadata")["file_path"].alias(file), F.col("_metadata")["row_index"].alias(row))
    return located, dedup_entries(docs, at, digest, files_per_trigger)


def dedup_entries(docs: DataFrame, path: str, digest, files_per_trigger: int) -> DataFrame:
    schema = entries(docs, digest).schema
    found = docs.sparkSession.read.schema(schema).parquet(path)
    state = staged(state_table(docs.sparkSession, schema, path, files_per_trigger), "final_state")
    return decide(docs, found, state, digest)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns."""
    located, decisions = dedup_table(docs)
    file, row = locator(docs)
    dropped = decisions.filter("not kept").select(F.col("file").alias(file), F.col("row").alias(row))
    return located.join(dropped, [file, row], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_stream(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, sha256(norm) AS text_sha256,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
