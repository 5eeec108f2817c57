"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.llm.common import documents
from warder.llm.pieces import lists
from warder.llm.rolling import LOW_BITS, gram_hashes, window_minima

#: Code points of a gram and grams of a window: shared runs of GRAM + WINDOW - 1 are always found.
GRAM = 16
WINDOW = 24
HASH_BYTES = 5


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected 40-bit hashes and their positions (code points), in text order.

    The minimum of each window of w k-grams is selected, the rightmost among equals. A text
    shorter than k is one gram; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    hashes = gram_hashes(codes, min(k, max(1, len(codes))))
    at = window_minima(hashes, w)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    return hashes[at] >> np.uint64(LOW_BITS), at


def packed(hashes: np.ndarray) -> bytes:
    """Big-endian 5-byte hashes in text order."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of hashes; of two empty fingerprints 1."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprint(df: DataFrame, key: str, text: str, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprint every whole text: (key, n_chars, fingerprint binary, positions array<int>).

    Null counts as empty. Equal texts have equal fingerprints, and two texts that share a run
    of k + w - 1 code points share a hash of it at the positions given. Rows are independent;
    an empty table gives none; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [winnow(t, k, w) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([packed(h) for h, _ in found], pa.binary()), lists([p for _, p in found], pa.int32())],
                names=[key, "n_chars", "fingerprint", "positions"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_chars long, fingerprint binary, positions array<int>")


def place_among(col: Column, cuts: list) -> Column:
    """How many of the ascending cuts are above the value (by binary search)."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c) for c in cuts])
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    mid = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
    first = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s)
        .when(F.get(array, mid(s)) <= col, F.struct((mid(s) + 1).alias("a"), s["b"].alias("b")))
        .otherwise(F.struct(s["a"].alias("a"), mid(s).alias("b"))),
    )
    return F.lit(len(cuts)) - first["a"]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, positions array<int>"


def fingerprint_edits(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprint each text, its edited form and the next document's text.

    Next means descending doc_id, null last, rows of one doc_id by hash of their text, and
    after the last the first (a single row is its own next). The order is cut into ranges by
    quantiles of doc_id, and rows of a doc_id (or of none) with more than a range's share by
    their hash; each range also gets the first row of the range after it, so texts move once
    and the order never meets in one task. ``positions`` are those of the fingerprint's hashes
    in the text. Null counts as empty; repeated rows return as often as they come; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    share = docs.count() // ranges + 1
    # at most as many as there are ranges
    hot = {r["doc_id"]: r["n"] // share + 1 for r in docs.groupBy(key.alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).collect()}
    cuts = sorted({*cuts, *(c for i in hot if i is not None for c in (i, min(i + 1, 2**63 - 1)))})
    where = F.coalesce(place_among(key, cuts), F.lit(len(cuts) + 1)).cast("long") * (ranges + 1)
    h = F.xxhash64(text)
    for i, parts in hot.items():
        where = where + F.when(key.eqNullSafe(F.lit(i).cast("long")), F.floor((h / 2.0**64 + 0.5) * parts)).otherwise(0)
    rows = docs.select(key.alias("doc_id"), text.alias("text"), h.alias("h"), where.alias("place"))
    # the first row of each range; ranges are about 4 a shuffle partition, at most twice that
    # with the hot ones, the bound of what is collected
    first = F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "h")).alias("first")
    heads = sorted((r["place"], r["first"]) for r in rows.groupBy("place").agg(first).collect())
    before = [(r[1], -r[1] if r[1] is not None else None, r[2], heads[i - 1][0]) for i, (_, r) in enumerate(heads)]
    table = spark.createDataFrame([(d, h, p) for _, d, h, p in before], "head_id long, head_h long, also long")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    sent = rows.join(F.broadcast(table), is_head, "left").select(
        "doc_id", "text", "h", F.explode(F.array(F.struct("place", F.lit(False).alias("extra")), F.struct(F.col("also").alias("place"), F.lit(True).alias("extra")))).alias("to")
    )
    sent = sent.filter("to.place is not null").select("doc_id", "text", "h", "to.place", "to.extra")
    dealt = sent.repartition("place").sortWithinPartitions("place", "extra", F.col("doc_id").desc_nulls_last(), "h")

    def run(batches):
        last = None  # (place, doc_id, text, hashes, positions) that waits for its next
        for batch in batches:
            out = []
            for doc_id, body, place, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "place", "extra")), strict=True):
                hashes, at = winnow(body, k, w)
                if last is not None and last[0] == place:
                    out.append(compared(last, body, hashes, k, w))
                # a range ends with the row sent along from the one after it; repeats of that row add nothing
                last = None if extra else (place, doc_id, body, hashes, at)
            yield as_batch(out)

    return dealt.mapInArrow(run, EDITED)


def compared(last: tuple, body: str, hashes: np.ndarray, k: int, w: int) -> tuple:
    _, doc_id, text, own, at = last
    n = len(text)
    m = n // 3
    edited = text[: n - m] + body[:m]
    changed = winnow(edited, k, w)[0]
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return doc_id, n, digest, packed(own), packed(changed), likeness(own, changed), likeness(own, hashes), at.tolist()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in EDITED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(documents(spark, sf_dir))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next", "positions")
