"""Sharding along a Hilbert curve over quantised metadata (DataFrame functions only)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warder.llm.common import documents, free_name, join_counted, rank_in_groups, staged

BITS = 5


def by_share(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(column, cell, rows) for all values of a column: cells hold runs of neighbouring values
    and about equal shares of the rows, so that minimum and maximum of a file prune.

    Values are counted, dealt out by ranges, and summed up within and over the ranges, so no
    task sees all of them.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    ranges = staged(counts.repartitionByRange(column).withColumn("range", F.spark_partition_id()), "values")
    over = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranges.groupBy("range").agg(F.sum("rows").alias("rows"))
    starts = sums.select("range", over(Window.orderBy("range")).alias("start"))
    total = sums.agg(F.sum("rows")).first()[0] or 1
    before = F.col("start") + over(Window.partitionBy("range").orderBy(column))
    return staged(ranges.join(F.broadcast(starts), "range").select(column, F.floor(before * (1 << bits) / total).cast("int").alias("cell"), "rows"), "cells_of_values")


def by_cuts(col: Column, cuts: list[int]) -> Column:
    """Quantise a size by cut points."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < col)) if cuts else F.lit(0)


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Distance along the Hilbert curve through a grid of ``2**bits`` per axis.

    The transform undoes excess rotations axis by axis from the highest bit, Gray-encodes
    and interleaves the bits; one ``aggregate`` folds over the (bit, axis) steps.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        here, first = F.get(x, i), F.get(x, F.lit(0))
        low = q - 1
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        is_set = here.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when(is_set, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            .when((j == 0) & (i != 0), v.bitwiseXOR(swap))
            .when((j == i) & (i != 0), v.bitwiseXOR(swap))
            .otherwise(v),
        )

    start = F.array(*[a.cast("int") for a in axes])
    x = F.aggregate(steps, start, undo) if bits > 1 else start
    # Gray encoding: each axis is combined with all before it
    gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))
    last = F.get(gray, F.lit(n - 1))
    turn = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>"),
        F.lit(0),
        lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.get(gray, F.lit(i)).bitwiseXOR(turn), b).bitwiseAND(F.lit(1))
            index = index * 2 + bit
    return index.cast("long")


def hilbert_order(df: DataFrame, key: list[str], axes: list[str], bits: int = BITS) -> tuple[DataFrame, int]:
    """Rank all rows along the curve; returns (df with ``hilbert`` and ``place``, row count).

    ``axes`` names integer columns in [0, 2**bits). The curve is evaluated once per occupied
    grid cell; cells are at most ``2**(bits * len(axes))``, the bound of the cell table that
    is ranked in one task and broadcast. Rows of one cell are ranked in parts. df is read
    three times.
    """
    cells = df.groupBy(*axes).agg(F.count(F.lit(1)).alias("cell_rows")).select("*", hilbert_index([F.col(a) for a in axes], bits).alias("hilbert"))
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = staged(cells.withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(before), F.lit(0))), "cells")
    total = cells.agg(F.sum("cell_rows")).first()[0] or 0
    placed = df.join(F.broadcast(cells.drop("cell_rows")), axes)
    ranked = rank_in_groups(placed, ["hilbert"], key, "in_cell")
    return ranked.withColumn("place", F.col("cell_start") + F.col("in_cell")).drop("cell_start", "in_cell"), total


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """Cut the Hilbert order of documents into ``shards`` runs with counts at most one apart.

    The axes are source, language and size, quantised by rank into about equal shares, so that
    a shard holds few neighbouring sources, languages and sizes and its file statistics prune
    in every dimension. Null texts have no bytes, null metadata is a value of its own, equal or
    repeated rows each take a slot, an empty table gives no rows; other columns are not read
    but for ``carry``. Returns doc_id, size, text_crc32, hilbert, law, shard, slot,
    grown_shard and ``carry``.
    """
    carry = carry or []
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    narrow = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            value("source").alias("source"),
            value("lang").alias("lang"),
            F.monotonically_increasing_id().alias("row"),
            *carry,
        ),
        "shard_rows",
    )
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = sorted(set(narrow.agg(F.percentile_approx("size", shares, 10_000)).first()[0] or []))
    celled = narrow.withColumn("axis_size", by_cuts(F.col("size"), cuts))
    for c in ("source", "lang"):
        celled = join_counted(celled, by_share(narrow, c, bits), [c], "rows", ["row"], "found").withColumn(f"axis_{c}", F.col("found.cell")).drop("found", c)
    placed, total = hilbert_order(staged(celled, "celled"), ["doc_id", "text_crc32", "row"], ["axis_source", "axis_lang", "axis_size"], bits)
    total = max(total, 1)
    shard = F.expr(f"(place * {shards}L) div {total}L")
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        "hilbert",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carry,
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write the documents as one folder per shard, in files of runs of the curve.

    Rows are told apart by file and row: documents that are no plain file scan are staged
    first. So rows without doc_id and repeated rows are written as often as they come.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        docs = staged(docs, "documents")
    file, row, shard, slot = (free_name(docs, n) for n in ("__file", "__row", "__shard", "__slot"))
    at = [F.col("_metadata")["file_path"].alias(file), F.col("_metadata")["row_index"].alias(row)]
    placed = shard_documents(docs.select("doc_id", "text", "source", "lang", *at), shards, carry=[file, row])
    joined = docs.select("*", *at).join(placed.select(file, row, F.col("shard").alias(shard), F.col("slot").alias(slot)), [file, row])
    cut = joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    cut.select(*rest, F.col(shard).alias("shard")).write.partitionBy("shard").parquet(path)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
