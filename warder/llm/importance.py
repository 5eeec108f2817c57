"""Sampling documents towards a target: hashed n-gram importance weights with Gumbel noise."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.functions.ordering import numbered
from warder.llm.common import documents, free_name, staged
from warder.llm.pieces import lists

#: Least and most words of a feature, buckets that features are hashed to.
FEW, MANY, BUCKETS = 1, 1, 10_000
#: Prefix of what the noise of a document is drawn from.
SALT = "2024"
#: Documents of at least so many words may be drawn, so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 10
CACHE_WORDS = 300_000
#: Capital letters become small; all ASCII but letters and digits is a separator.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def collapsed(text: bytes) -> bytes:
    """The words of a text in UTF-8, with single spaces between them."""
    return b" ".join(text.translate(FOLD).split())


class Scanner:
    """Buckets of all runs of ``few`` to ``many`` words of a text.

    One overlapped scan for each length: the pattern takes n words, the look-around at both
    ends lets a match begin and end at a word's boundary only, and as matches may overlap,
    every word begins one.
    """

    def __init__(self, few: int = FEW, many: int = MANY, buckets: int = BUCKETS):
        self.patterns = [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(few, many + 1)]
        self.buckets, self.known = buckets, {}

    def grams(self, words: bytes) -> Iterator[bytes]:
        for pattern in self.patterns:
            for match in pattern.finditer(words, overlapped=True):
                yield match[0]

    def __call__(self, text: bytes) -> tuple[int, list[int]]:
        """How many words a text has, and the bucket of each feature."""
        known, out, words = self.known, [], collapsed(text)
        if len(known) > CACHE_WORDS:
            known.clear()
        for gram in self.grams(words):
            bucket = known.get(gram)
            if bucket is None:
                bucket = known[gram] = zlib.crc32(gram) % self.buckets
            out.append(bucket)
        return words.count(b" ") + 1 if words else 0, out


def bags(docs: DataFrame, keep: list[str], few: int = FEW, many: int = MANY, buckets: int = BUCKETS) -> DataFrame:
    """``keep`` columns of every row, with the words and features of its whole text (null:
    none), and its buckets, each once, with their counts."""
    kinds = dict(docs.dtypes)

    def run(batches):
        scan = Scanner(few, many, buckets)
        for batch in batches:
            words, total, which, counts = [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                n, found = scan(text or b"")
                one, many_times = np.unique(np.array(found, np.int32), return_counts=True)
                words.append(n)
                total.append(len(found))
                which.append(one)
                counts.append(many_times.astype(np.int32))
            columns = [pa.array(words, pa.int64()), pa.array(total, pa.int64()), lists(which, pa.int32()), lists(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "n_words", "n_features", "buckets", "counts"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_words long, n_features long, buckets array<int>, counts array<int>"])
    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def bucket_counts(bagged: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all rows by bucket. A task adds up its rows, so that one
    row a bucket and task is shuffled."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1)]
            np.add.at(total, flat[0], flat[1])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = bagged.select("buckets", "counts").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts as an array; ``buckets`` bounds what the driver gets."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, one added to each count."""
    all_source, all_target, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: (t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(source, target, strict=True)], np.int64)


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """floor(1000 x Gumbel noise) from the digest of the identifier (missing: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighted(bagged: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, n_features and weight: the floored mean gain of the features."""
    kinds = dict(bagged.dtypes)

    def run(batches):
        for batch in batches:
            at, n = len(keep), batch.column(len(keep) + 1).to_numpy()
            buckets, counts = batch.column(at + 2), batch.column(at + 3)
            worth = gain[buckets.flatten().to_numpy(zero_copy_only=False)] * counts.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(buckets).to_numpy(zero_copy_only=False))
            sums = np.append(0, np.cumsum(worth))[ends] if len(ends) else ends
            sums = np.diff(np.append(0, sums))
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 2], pa.array(sums // np.maximum(n, 1), pa.int64())], names=[*keep, "n_words", "n_features", "weight"])

    columns = [*keep, "n_words", "n_features"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in columns) + ", weight long"
    return bagged.select(*columns, "buckets", "counts").mapInArrow(run, schema)


def scores(docs: DataFrame, target: DataFrame, few: int = FEW, many: int = MANY, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, salt: str = SALT) -> DataFrame:
    """(row_id, doc_id, n_words, n_features, weight, score, rank) for every row of docs.

    Features of docs and of the texts of ``target`` are counted by bucket over all rows. A
    weight is the floored mean gain of a row's features (none: 0), its score the weight plus
    Gumbel noise from doc_id. Of the rows of at least ``least_words`` words, ``percent`` of a
    hundred are drawn by highest score, ties to the smaller doc_id (missing: last): drawing
    without replacement in proportion to the importance. rank is their place from 1, null
    for the rest. Null and empty texts have no features. Repeated rows are rows of their own
    and take neighbouring ranks. Other columns are not read. Without documents there are no
    rows; an empty target counts as one with no features.
    """
    return row_scores(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), target, few, many, buckets, least_words, percent, salt)


def row_scores(rows: DataFrame, target: DataFrame, few: int, many: int, buckets: int, least_words: int, percent: int, salt: str) -> DataFrame:
    bagged = staged(bags(rows, ["row_id", "doc_id"], few, many, buckets), "bags")
    wanted = bags(target.select("text"), [], few, many, buckets)
    gain = gains(dense(bucket_counts(bagged, buckets), buckets), dense(bucket_counts(wanted, buckets), buckets))
    scored = staged(weighted(bagged, gain, ["row_id", "doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt)), "weights")
    may = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * may.count() // 100
    placed = numbered(may, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_id")], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    return placed.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, few: int = FEW, many: int = MANY, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, salt: str = SALT) -> DataFrame:
    """The drawn documents, with their columns; see ``scores``."""
    row = free_name(docs, "__row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = row_scores(rows.select(F.col(row).alias("row_id"), "doc_id", "text"), target, few, many, buckets, least_words, percent, salt)
    drawn = found.filter("rank is not null").select(F.col("row_id").alias(row))
    return rows.join(drawn, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 as in RFC 1952: a table by the reversed polynomial, then a fold over the bytes.
OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS t
  FROM range(256) r(k)),
texts AS (SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
          UNION ALL SELECT 'b', row_number() OVER (), coalesce(text, '') FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
bags AS (SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM bags)),
bucketed AS (
  SELECT w, xor(list_reduce([CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(x) // 2)],
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS s_all, coalesce(sum(n) FILTER (side = 'b'), 0) AS t_all FROM bags),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
           FROM bags JOIN bucketed USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
          FROM counts, totals),
sums AS (SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS total
         FROM bags JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
weights AS (
  SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
         CAST(CASE WHEN total IS NULL THEN 0 ELSE (total - (total % n_features + n_features) % n_features) // n_features END AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weights),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 10 * (SELECT count(*) FROM placed) // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
