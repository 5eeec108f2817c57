"""Packing token pieces into fixed-length sequences, shortest pack first."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.llm.common import documents, rank_in_groups, staged
from warder.llm.pieces import slices

SEQUENCE = 2048
END_ID = 1
CACHE_WORDS = 300_000
CACHE_WORD_CHARS = 64
MARK = "7"
#: Latin letters that are letters after the tokenizer's normaliser too (the dotted capital I
#: becomes a letter and a mark), then ASCII marks; or any other word.
FORM = re.compile(r"^(?:([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)|(.*))$", re.M)

PIECES = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long"


class WordTokens:
    """Token ids by the tokenizers library, kept for words that come again.

    The tokenizer drops white space and no token or rule spans it, so a text has the ids
    of its runs between spaces and line feeds, one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = self.ids([MARK])[0]
        self.stems: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {"": b""}

    def ids(self, texts: list[str]) -> list[int]:
        """Ids of the texts one after another."""
        return self.library.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids

    def ids_of(self, words: list[str]) -> dict[str, bytes]:
        """uint32 ids of each of these distinct words. Latin letters and the ASCII marks after
        them are tokens of their own and letters are lowered, so such words share the ids of
        their stem. Known stems have two generations: a full one becomes the old one, from which
        stems that come again are taken over."""
        if len(self.stems) > CACHE_WORDS:
            self.old, self.stems = self.stems, {}
        parts = [(letters.lower() or other, marks) for letters, marks, other in FORM.findall("\n".join(words))]
        asked = set(chain.from_iterable(parts))
        lacking = asked.difference(self.stems)
        again = {x: self.old[x] for x in lacking if x in self.old}
        fresh = self.library_ids([x for x in lacking if x not in again])
        long = {x: ids for x, ids in fresh.items() if len(x) > CACHE_WORD_CHARS}
        self.stems |= again
        self.stems |= {x: ids for x, ids in fresh.items() if x not in long} if long else fresh
        get = (self.stems | long).__getitem__ if long else self.stems.__getitem__
        return {w: get(stem) + get(marks) if marks else get(stem) for w, (stem, marks) in zip(words, parts, strict=True)}

    def library_ids(self, words: list[str]) -> dict[str, bytes]:
        """Many words go through the library at once, with a digit, which always is a token of
        its own, between them; words that hold it go alone."""
        plain = [w for w in words if MARK not in w]
        out = {w: array("I", self.ids([w])).tobytes() for w in words if MARK in w}
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.array(self.ids([x for w in part for x in (w, MARK)]), dtype=np.uint32)
            ends = np.flatnonzero(ids == self.mark).tolist()
            data, start = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                out[w] = data[4 * start : 4 * end]
                start = end + 1
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each whole text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        get = self.ids_of(list(set().union(*split))).__getitem__ if split else None
        return [np.frombuffer(b"".join(map(get, words)), dtype=np.uint32) for words in split]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(df: DataFrame, tokenizer: str, most: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Tokenise every whole text, append the end id and cut it into pieces of ``most`` ids.

    Returns doc_id, doc_tokens, start, length, ids_crc32 and, on request, ids. A null text
    counts as empty and has the end id only.
    """

    def run(batches):
        coder = word_tokens(tokenizer)
        end = np.array([END_ID], dtype=np.uint32)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                rows: list[tuple] = []
                kept: list[list[int]] = []
                for key, ids in zip(keys[a:b], coder.encode(texts[a:b]), strict=True):
                    ids = np.concatenate([ids, end])
                    for s in range(0, len(ids), most):
                        piece = ids[s : s + most]
                        rows.append((key, len(ids), s, len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
                        if with_ids:
                            kept.append(piece.tolist())
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Pack lengths given by their counts; returns patterns (length -> how often) and counts.

    Lengths are placed longest first, each into the packs with most room left. Packs alike
    are one pattern with a count, so the work depends on the number of distinct lengths,
    not on the number of pieces. A pattern takes as many copies at once as its packs hold
    before they are no longer the shortest.
    """
    heap: list[tuple[int, int]] = []  # (fill, pattern)
    patterns: list[tuple[dict[int, int], int]] = []

    def push(pattern: dict[int, int], count: int, fill: int) -> None:
        patterns.append((pattern, count))
        heapq.heappush(heap, (fill, len(patterns) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and heap[0][0] + length <= capacity:
            fill, p = heapq.heappop(heap)
            pattern, count = patterns[p]
            next_fill = heap[0][0] if heap else capacity
            copies = max(1, min((capacity - fill) // length, (next_fill - fill) // length, left // count or 1))
            used = min(count, left // copies)
            if used < count:
                push(pattern, count - used, fill)
            patterns[p] = (pattern | {length: pattern.get(length, 0) + copies}, used)
            heapq.heappush(heap, (fill + copies * length, p))
            left -= used * copies
        if left:
            each = capacity // length
            for copies, used in ((each, left // each), (left % each, 1)):
                if copies and used:
                    push({length: copies}, used, copies * length)
    return [x for x in patterns if x[1]]


def slot_table(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, copies, first sequence, offset): which ranks of a length
    lie in which sequences. Patterns are numbered in turn, each with ``count`` sequences."""
    rows, next_rank, sequence = [], Counter(), 0
    for pattern, count in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, next_rank[length], count * copies, copies, sequence, offset))
            next_rank[length] += count * copies
            offset += length * copies
        sequence += count
    return rows


SLOTS = ["length", "first_rank", "ranks", "copies", "first_sequence", "first_offset"]


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Place pieces (doc_id, start, length, row, ...) into sequences; adds sequence_id and offset.

    ``row`` tells all pieces apart.

    ``pieces`` is read three times: pass a table. The driver sees only the histogram of
    lengths (at most ``capacity`` rows) and the patterns over it (each placement of a length
    adds at most two patterns to those there are); pieces are joined back to the patterns by
    their rank among equal lengths.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slot_table(shortest_pack_first(histogram, capacity))
    table = pa.table({name: pa.array([r[i] for r in slots], pa.int32() if name == "length" else pa.int64()) for i, name in enumerate(SLOTS)})
    # a length has its slots in one row, looked up by binary search over at most as many
    # entries as there are patterns
    slot = spark.createDataFrame(table).groupBy("length").agg(F.array_sort(F.collect_list(F.struct(*SLOTS[1:]))).alias("slots"))
    ranked = rank_in_groups(pieces, ["length"], ["doc_id", "start", "row"], "piece_rank")
    found = F.expr(
        """slots[aggregate(sequence(1, 32), named_struct('a', 0, 'b', size(slots) - 1), (s, i) -> if(s.a >= s.b, s,
        if(slots[(s.a + s.b + 1) div 2].first_rank <= piece_rank, named_struct('a', cast((s.a + s.b + 1) div 2 as int), 'b', s.b),
        named_struct('a', s.a, 'b', cast((s.a + s.b + 1) div 2 - 1 as int))))).a]"""
    )
    at = F.col("piece_rank") - F.col("slot.first_rank")
    return (
        ranked.join(F.broadcast(slot), "length")
        .withColumn("slot", found)
        .withColumn("sequence_id", F.col("slot.first_sequence") + F.expr("(piece_rank - slot.first_rank) div slot.copies"))
        .withColumn("offset", F.col("slot.first_offset") + F.pmod(at, F.col("slot.copies")) * F.col("length"))
        .drop("slot", "slots", "piece_rank")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE) -> DataFrame:
    """Tokenise and pack all documents; one row per piece.

    Documents longer than a sequence are cut into full sequences and a rest; only whole rows
    of a document count, so each id lies in exactly one piece. Null texts count as empty
    (one id), repeated rows and equal doc_ids are packed as often as they come, an empty
    table gives no rows, other columns are not read.
    """
    pieces = staged(token_pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity).select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
