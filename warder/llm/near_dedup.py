"""Near-duplicate documents: Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.llm.common import distilled, documents, free_name, join_counted, staged
from warder.llm.pieces import lists
from warder.llm.rolling import finish, gram_hashes, word_hashes

#: Words of a shingle, of one in the second sketch, and of one in the sketches of short texts.
SHINGLE, SECOND_SHINGLE, SHORT_SHINGLE = 5, 3, 2
SIMILARITY = 0.8
#: Ordered minima of a band, and bands (one hash function each) over shingles of five words and
#: over the second ones, of which scattered edits leave many more.
MINIMA, FIRST_BANDS, SECOND_BANDS = 2, 16, 64
BANDS = FIRST_BANDS + SECOND_BANDS
#: Sketch bytes that two texts must share before they are aligned, of the second shingles and,
#: for short texts, of pairs of words. Texts that differ in every fifth word share 22 of 64 and at
#: least 26 of 80 on the average, those that share a tenth of their text about 6 of 64.
LEAST_SHARED, SHORT_SHARED = 12, 13
#: Texts of at most so many words have all their short runs as keys. Those of fewer than
#: LEAST_WORDS are like equal ones only, as one edit is more than a fifth of the longer text.
SHORT, LEAST_WORDS = 64, 4
#: Rows of one part of a bucket; two parts are compared at a time.
GROUP_ROWS = 500
#: So many times larger are parts that meet each with each, as all of their rows are sent to all others.
WHOLE_PARTS = 4
#: Pairs that are sent out at once.
PAIR_ROWS = 50_000
#: Members that are aligned with one copy of their leader.
SALT_ROWS = 256
#: Places of a bag of words, and of the wide one, of which counts up to WIDE_MOST are kept.
BAG, WIDE_BAG, WIDE_MOST = 128, 1024, 15
FACTORS = finish(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes:
    """64-bit hashes of the words (runs between blanks) of a text."""

    def __call__(self, text: str) -> np.ndarray:
        return word_hashes(" ".join(text.split()).encode("utf-8", "replace"))


def labelled_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words in text order, each with its occurrence number.
    A text of fewer words is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    grams = gram_hashes(words, min(size, len(words)))
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return finish(grams)  # as below with number 0: other texts may repeat a run of these
    order = np.argsort(grams, kind="stable")
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    number = np.empty(len(grams), np.uint64)
    number[order] = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    return finish(grams + number * PAIR)


def order_sketch(shingles: np.ndarray, first: int = 0, count: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` hash functions from the ``first`` on: the MINIMA least shingles, kept
    in text order, as one hash, and a byte of the least one. Two texts agree in a band if they
    have these shingles in the same order; the share of equal bytes tells the share of common
    shingles."""
    n = len(shingles)
    bands, bits = np.zeros(count, np.uint64), np.zeros(count, np.uint8)
    if not n:
        return bands, bits
    take = min(MINIMA, n)
    block = max(1, 65_536 // n)
    high = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]  # 32 bits tell a text's shingles apart, at half the cost
    for at in range(0, count, block):
        factors = FACTORS[first + at : first + min(at + block, count), None]
        values = high ^ (factors >> np.uint64(7)).astype(np.uint32)
        values *= factors.astype(np.uint32)
        rows = np.arange(len(factors))
        found = []
        for i in range(take):
            least = values.argmin(axis=1)
            if not i:
                bits[at : at + block] = finish(values[rows, least].astype(np.uint64)).astype(np.uint8)
            values[rows, least] = np.uint32(2**32 - 1)
            found.append(least)
        total = (rows + first + at).astype(np.uint64) * PAIR + np.uint64(take)
        for least in np.sort(found, axis=0):
            total = finish(total * PAIR + shingles[least])
        bands[at : at + block] = total
    return bands, bits


def order_sketches(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands over both kinds of shingles, and the bytes of the second."""
    one = order_sketch(labelled_shingles(words), 0, FIRST_BANDS)
    two = order_sketch(labelled_shingles(words, SECOND_SHINGLE), FIRST_BANDS, SECOND_BANDS)
    return np.concatenate([one[0], two[0]]), two[1]


def short_keys(words: np.ndarray) -> np.ndarray:
    """Runs of words of which two short texts that are alike must share one.

    With d edits the longer text keeps its other words in at most d + 1 runs, so the longest
    has at least (words - d) / (d + 1) words: 2 with 5 words, 3 with 6, 7, 10, 11 and 15, and
    4 with any other number. A text has the runs of all lengths that a partner may need; one of
    4 words may need a partner of 5.
    """
    n = len(words)
    sizes = [2] * (n <= 5) + [3] * (5 <= n <= 15) + [4] * (n >= 7)
    return np.concatenate([finish(np.unique(gram_hashes(words, q)) + np.uint64(q)) for q in sizes])


def bag_of(words: np.ndarray) -> np.ndarray:
    """How many words of a text fall to each of BAG places, at most 255. An edit changes two of
    these counts by one at most, so texts that are alike differ by at most twice their edits."""
    return counted(words, BAG, 255)


def counted(words: np.ndarray, places: int, most: int) -> np.ndarray:
    return np.minimum(np.bincount((finish(words) >> np.uint64(32)).astype(np.int64) % places, minlength=places), most).astype(np.uint8)


def wide_bag_of(words: np.ndarray) -> np.ndarray:
    """A bag of WIDE_BAG places, two counts a byte."""
    counts = counted(words, WIDE_BAG, WIDE_MOST)
    return counts[::2] | counts[1::2] << 4


def wide_bags(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, wide): the wide bags of the texts of the nodes of keys."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            wide = [wide_bag_of(hashes(text)).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.binary())], names=["node", "wide"])

    asked = staged(keys.select(F.col("node").alias("kid")).distinct(), "open_nodes")
    return rows.select("kid", "text").join(asked, "kid", "left_semi").mapInArrow(run, "node long, wide binary").distinct()


SKETCH = "kid long, d1 long, d2 long, bands array<long>, runs array<long>, sketch binary, short binary, words int, bag binary"


def sketches(rows: DataFrame) -> DataFrame:
    """Digest, band keys and sketch of every text; keys of runs and a sketch over pairs of
    words for short ones."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                words = hashes(text)
                digest = xxhash.xxh3_128_digest(words.tobytes())
                # texts about SHORT words long meet shorter ones by runs and longer ones by bands
                none, short = np.zeros(0, np.int64), LEAST_WORDS <= len(words) <= SHORT
                band, least = order_sketches(words) if len(words) >= SHORT * SIMILARITY else (none, none)
                row = (
                    int.from_bytes(digest[:8], "big", signed=True),
                    int.from_bytes(digest[8:], "big", signed=True),
                    band.view(np.int64),
                    short_keys(words).view(np.int64) if short else none,
                    least.tobytes(),
                    order_sketch(labelled_shingles(words, SHORT_SHINGLE))[1].tobytes() if short else b"",
                    len(words),
                    bag_of(words).tobytes(),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            one, two, bands, runs, sketch, short_sketch, sizes, bags_ = out
            columns = [pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists(bands, pa.int64()), lists(runs, pa.int64()), pa.array(sketch, pa.binary()), pa.array(short_sketch, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bags_, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["kid", "d1", "d2", "bands", "runs", "sketch", "short", "words", "bag"])

    return rows.select("kid", "text").mapInArrow(run, SKETCH)


class Group:
    """Rows of a part of a bucket: nodes, classes, parts, sketches, words and bags, and, where they
    are given, wide bags and the open buckets of each row."""

    def __init__(self, held: list[tuple], least_shared: int, least: float, bucket: int = 0):
        nodes, comp, own, sketch, words, bag, *more = zip(*held, strict=True)
        self.nodes, self.comp, self.own, self.words = np.array(nodes, np.int64), np.array(comp, np.int64), np.array(own), np.array(words, np.int64)
        self.sketch, self.bag = (np.frombuffer(b"".join(x), np.uint8).reshape(len(nodes), -1) for x in (sketch, bag))
        self.least_shared, self.least = least_shared, least
        self.wide = self.before = None
        if more and more[0][0] is not None:
            wide, met = more
            self.wide = np.frombuffer(b"".join(wide), np.uint8).reshape(len(nodes), -1)
            self.before = self.buckets_before(met, bucket)

    @staticmethod
    def buckets_before(met: tuple[list[int], ...], bucket: int) -> np.ndarray | None:
        """Bits of the buckets before this one that several rows have."""
        row, keys = np.repeat(np.arange(len(met)), [len(x) for x in met]), np.concatenate([np.array(x, np.int64) for x in met])
        earlier = keys < bucket
        values, place, n = np.unique(keys[earlier], return_inverse=True, return_counts=True)
        several = n > 1
        if not several.any():
            return None
        kept = several[place]
        at, row = (np.cumsum(several) - 1)[place][kept], row[earlier][kept]
        bits = np.zeros((len(met), int(several.sum()) // 8 + 1), np.uint8)
        np.bitwise_or.at(bits, (row, at // 8), (1 << at % 8).astype(np.uint8))
        return bits

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sketch bytes that row i shares with others, -1 for those that it need not be aligned with:
        fewer than least_shared are the same, the bags differ by more than the edits allowed, or both
        rows are in a bucket before this one. An edit that changes the count of words changes a bag
        by one."""
        found = (self.sketch[others] == self.sketch[i]).sum(axis=1)
        found[found < self.least_shared] = -1
        near = np.flatnonzero(found >= 0)
        for bag in (self.bag, self.wide):
            if bag is None or not len(near):
                break
            if bag is self.wide and self.before is not None:
                met = (self.before[others[near]] & self.before[i]).any(axis=1)
                found[near[met]] = -1
                near = near[~met]
            if bag is self.bag:
                apart = np.abs(bag[others[near]].astype(np.int16) - bag[i]).sum(axis=1, dtype=np.int64)
            else:
                apart = sum(np.abs((bag[others[near]] >> at & 15).astype(np.int8) - (bag[i] >> at & 15).astype(np.int8)).sum(axis=1, dtype=np.int64) for at in (0, 4))
            words = self.words[others[near]]
            most = ((1 - self.least) * np.maximum(words, self.words[i]) + 1e-9).astype(np.int64)
            far = apart + np.abs(words - self.words[i]) > 2 * most
            found[near[far]] = -1
            near = near[~far]
        return found


def close_pairs(g: Group) -> Iterator[np.ndarray]:
    """All pairs (later, earlier row) of two parts, or within one, that may be alike and are not of
    one class. With open buckets known, a pair is given in the first bucket alone where both rows are."""
    two = g.own.min() != g.own.max()
    for i in range(1, len(g.nodes)):
        other = g.comp[:i] != g.comp[i]
        if two:
            other &= g.own[:i] != g.own[i]
        other = np.flatnonzero(other)
        near = other[g.shared(i, other) >= 0]
        if len(near):
            yield np.stack([np.full(len(near), g.nodes[i]), g.nodes[near]])


def leading_pairs(g: Group) -> Iterator[np.ndarray]:
    """A pair of each row and the leader before it that it shares most bytes with; a row that may
    be like none leads."""
    leaders = np.zeros(1, np.int64)
    for i in range(1, len(g.nodes)):
        shared = g.shared(i, leaders)
        most = int(shared.argmax())
        if shared[most] < 0:
            leaders = np.append(leaders, i)
        else:
            yield np.array([[g.nodes[i]], [g.nodes[leaders[most]]]])


def paired(rows: DataFrame, reps: DataFrame, least_shared: int, least: float, choose: Callable[[Group], Iterator[np.ndarray]], wide: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Different pairs (node, leader), the greater node first, that ``choose`` takes of the rows
    (bucket, part, own, short, node, comp) with equal bucket and part. With the ``wide`` bags of the
    rows, these and each row's buckets, by ``keys`` that are not yet dealt out, are at hand."""
    both = F.array(F.struct(F.lit(False).alias("short"), "sketch"), F.struct(F.lit(True).alias("short"), F.col("short").alias("sketch")))
    known = reps.select("node", "words", "bag", F.inline(both))
    if wide is None:
        known = known.withColumns({"wide": F.lit(None).cast("binary"), "met": F.lit(None).cast("array<long>")})
    else:  # made one table first, so that bags are sent to buckets once
        met = keys.groupBy("node", "short").agg(F.collect_set("bucket").alias("met"))
        known = staged(known.join(wide, "node").join(met, ["node", "short"]), "known")
    dealt = rows.join(known, ["node", "short"]).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")

    def batch_of(pairs):
        node, leader = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(leader, pa.int64())], names=["node", "leader"])

    def groups(batches):
        key, held = None, []
        for batch in batches:
            for *row, bucket, part, short in zip(*(batch.column(c).to_pylist() for c in ("node", "comp", "own", "sketch", "words", "bag", "wide", "met", "bucket", "part", "short")), strict=True):
                of = bucket, part, short
                if of != key:
                    if len(held) > 1:
                        yield key, held
                    key, held = of, []
                held.append(row)
        if len(held) > 1:
            yield key, held

    def run(batches):
        out, n = [], 0
        for (bucket, _, short), held in groups(batches):
            for pairs in choose(Group(held, SHORT_SHARED if short else least_shared, least, bucket)):
                out.append(pairs)
                n += pairs.shape[1]
                if n >= PAIR_ROWS:
                    yield batch_of(out)
                    out, n = [], 0
        yield batch_of(out)

    return dealt.select("bucket", "part", "own", "short", "node", "comp", "sketch", "words", "bag", "wide", "met").mapInArrow(run, "node long, leader long").distinct()


def shared_keys(reps: DataFrame) -> DataFrame:
    """(node, comp, short, bucket, n) of the keys that several texts have: n texts. Each text is a
    class (comp) of its own. Of keys that the same texts have, told by 128 bits, one is given."""
    bands = reps.select("node", F.lit(False).alias("short"), F.explode("bands").alias("bucket"))
    runs = reps.select("node", F.lit(True).alias("short"), F.explode("runs").alias("bucket"))
    rows = staged(bands.unionByName(runs), "buckets")
    sizes = staged(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket_sizes")
    shared = join_counted(rows, sizes, ["bucket"], "n", ["node"], "c").filter("c is not null")
    shared = staged(shared.select("node", "short", "bucket"), "shared_buckets")
    # near copies share most of their keys: of buckets with the same texts one is enough
    texts = [F.bit_xor(F.xxhash64(*x)).alias(c) for c, x in (("a", ("node", "short")), ("b", ("short", "node")))]
    sets = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *texts)
    sets = staged(sets.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "bucket_sets")
    found = join_counted(shared, sets, ["bucket"], "n", ["node"], "c").filter("c is not null")
    return found.select("node", F.col("node").alias("comp"), "short", "bucket", F.col("c.n").alias("n"))


def in_parts(keys: DataFrame, group_rows: int) -> DataFrame:
    """Each bucket dealt out in parts of about ``group_rows``, a row in one of them."""
    return keys.withColumns({"own": F.lit(0), "part": F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / group_rows))})


def each_with_each(keys: DataFrame, group_rows: int) -> DataFrame:
    """Each bucket dealt out in parts of about ``group_rows``, which meet each with each, so a row is
    repeated once for every ``group_rows`` of its bucket and no pair is left out."""
    grid = keys.withColumn("g", F.ceil(F.col("n") / group_rows)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")))
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.least(o, F.col("own")) * F.col("g") + F.greatest(o, F.col("own"))))
    return grid.select("bucket", "short", "node", "comp", "own", cell.alias("part"))


def candidates(reps: DataFrame, least_shared: int, least: float, group_rows: int) -> DataFrame:
    """All pairs (node, leader) of different texts that share a key and ``least_shared`` sketch
    bytes, and whose bags do not rule out a similarity of ``least``."""
    return paired(each_with_each(shared_keys(reps), group_rows), reps, least_shared, least, close_pairs)


def open_keys(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """The keys of buckets with texts of several classes, by classes (node, comp) that are known now."""
    now = staged(keys.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "keys")
    several = now.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("bucket", "n")
    found = join_counted(now.drop("n"), staged(several, "open_sizes"), ["bucket"], "n", ["node"], "c").filter("c is not null")
    return found.select("node", "comp", "short", "bucket", F.col("c.n").alias("n"))


def class_heads(keys: DataFrame) -> DataFrame:
    """The smallest text of each class in each bucket."""
    heads = staged(keys.groupBy("bucket", "short", "comp").agg(F.min("node").alias("node")), "heads")
    sizes = staged(heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "head_sizes")
    return join_counted(heads, sizes, ["bucket"], "n", ["node"], "c").select("node", "comp", "short", "bucket", F.col("c.n").alias("n"))


def tied(rows: DataFrame, reps: DataFrame, again: DataFrame, least: float, least_shared: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Links (node, leader, similarity), and the classes (node, comp) that they and edges ``again`` make:
    the same as those of all links between ``candidates``.

    Rows of a bucket are aligned with leaders first, then the smallest texts of the classes that
    are left in a bucket with each other, and at last all texts of different classes. A pair is
    left out only if it is of one class already, so a family costs about as many alignments as it
    has texts. Texts of different classes that agree by sketch are told apart by wide bags, each pair
    in one bucket only.
    """
    spark, edges, done, links, wide = rows.sparkSession, again, None, None, None
    keys = distilled(spark, "shared", lambda: shared_keys(reps))
    for step in (leading_pairs, class_heads, close_pairs):
        if step is leading_pairs:
            pairs = paired(in_parts(keys, group_rows), reps, least_shared, least, leading_pairs)
        else:
            keys = distilled(spark, "open", lambda before=keys: open_keys(before, comps))
            if keys.isEmpty():
                break
            if wide is None:
                wide = distilled(spark, "wide", lambda: wide_bags(rows, keys))  # noqa: B023: run at once
            chosen = staged(class_heads(keys), "chosen") if step is class_heads else keys
            dealt = in_parts(chosen, group_rows) if step is class_heads else each_with_each(chosen, group_rows * WHOLE_PARTS)
            pairs = paired(dealt, reps, least_shared, least, close_pairs, wide, chosen)
            pairs = pairs.join(done, ["node", "leader"], "left_anti")
        pairs = staged(pairs, "pairs")
        found = distilled(spark, "links", lambda pairs=pairs: verified(rows, pairs, least))
        done, links = (pairs, found) if done is None else (done.unionByName(pairs), links.unionByName(found))
        if step is leading_pairs or not found.isEmpty():
            edges = edges.unionByName(found.select(F.col("node").alias("u"), F.col("leader").alias("v")))
            comps = distilled(spark, "comps", lambda edges=edges: components(edges))
            edges = comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))
    return links, comps


#: Places of a text that one bit field covers, so that fields are linear in its length.
FIELD = 4096


def places(words: list[int]) -> dict[int, list[tuple[int, int]]]:
    """The places of each word: bit fields of FIELD places, each with its first place."""
    found: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        bit, first = 1 << i % FIELD, i - i % FIELD
        fields = found.setdefault(w, [])
        if fields and fields[-1][0] == first:
            fields[-1] = (first, fields[-1][1] | bit)
        else:
            fields.append((first, bit))
    return found


def edit_distance(at: dict[int, list[tuple[int, int]]], n: int, other: list[int], most: int) -> int | None:
    """Word edits (insert, delete, replace) between a text of ``n`` words, given by their
    places, and ``other`` if at most ``most``, else None.

    Alignment in the band of diagonals that so many edits can reach: a column of the band is
    two bit fields, of the places where the distance rises and falls from one row to the next.
    """
    m = len(other)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    band = (1 << (2 * most + 1)) - 1
    outer = 1 << (2 * most)  # the diagonal farthest down
    rises, falls = ((1 << (most + 1)) - 1) << most, 0
    turn, now = max(n - most, 0), min(n, most)
    row_end, hopeless = 1 << max(most - 1 + min(n, most), 0), 2 * most + m - n
    for j, word in enumerate(other):
        here = 0
        for first, bits in at.get(word, ()):
            shift = first - j + most
            if shift > 2 * most:
                break
            here |= bits << shift if shift >= 0 else bits >> -shift
        here &= band
        level = ((((here & rises) + rises) ^ rises) | here | falls) & band
        up, down = falls | (band & ~(level | rises)), level & rises
        if j < turn:  # along the outer diagonal to the last row
            if not level & outer:
                now += 1
                if now > hopeless:
                    return None
        else:  # along the last row
            now += bool(up & row_end) - bool(down & row_end)
            row_end >>= 1
        level >>= 1
        rises, falls = down | (band & ~(level | up)), level & up
    return now if now <= most else None


def bags(words: np.ndarray) -> list[np.ndarray]:
    """The words, and the runs of two words, each with its occurrence number, in order."""
    return [np.sort(labelled_shingles(words, q)) for q in (1, 2)]


def may_align(a: list[np.ndarray], b: list[np.ndarray], least: float) -> bool:
    """Whether bags(a) and bags(b) have as much in common as the edits allowed must leave: an
    edit changes at most q runs of q words. Never false for texts that align."""
    longer = max(len(a[0]), len(b[0]))
    most = int((1 - least) * longer + 1e-9)
    for q, x, y in zip((1, 2), a, b, strict=True):
        need = longer - q + 1 - q * most
        if need > 0 and (min(len(x), len(y)) < need or len(np.intersect1d(x, y, assume_unique=True)) < need):
            return False
    return True


class Text:
    """A text that others are aligned with: its words, and their places when first needed."""

    def __init__(self, words: np.ndarray):
        self.words, self.bags, self._places = words, bags(words), None

    def places(self) -> dict[int, list[tuple[int, int]]]:
        if self._places is None:
            self._places = places(self.words.tolist())
        return self._places


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words two texts begin and, apart from these, end with alike."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    unlike = np.flatnonzero(a[len(a) - (n - head) :][::-1] != b[len(b) - (n - head) :][::-1])
    return head, int(unlike[0]) if len(unlike) else n - head


def similarity(text: Text, other: np.ndarray, least: float) -> float | None:
    """1 - edits / words of the longer text, if at least ``least``.

    Words that both begin or end with need no alignment; the rest is aligned anew if it is a
    good deal shorter than the text, whose places are known.
    """
    longer = max(len(text.words), len(other))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    head, tail = common_ends(text.words, other)
    if head + tail > longer // 5:
        left = text.words[head : len(text.words) - tail].tolist()
        edits = edit_distance(places(left), len(left), other[head : len(other) - tail].tolist(), most)
    else:
        edits = edit_distance(text.places(), len(text.words), other.tolist(), most)
    return None if edits is None else 1 - edits / longer


def verified(rows: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(node, leader, similarity) of the pairs whose texts align. A leader's text is dealt out
    once for each SALT_ROWS members."""
    members = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    lead = members.select(F.col("leader").alias("kid"), F.struct("leader", F.sequence(F.lit(0), salts - 1).alias("salts"), F.lit(True).alias("leads")).alias("need"))
    sized = staged(members, "members")
    pairs = join_counted(pairs, sized, ["leader"], "n", ["node"], "c").withColumn("n", F.col("c.n"))
    follow = pairs.select(F.col("node").alias("kid"), F.struct("leader", F.array(F.pmod(F.xxhash64("node"), salts).cast("int")).alias("salts"), F.lit(False).alias("leads")).alias("need"))
    needs = lead.unionByName(follow).groupBy("kid").agg(F.collect_list("need").alias("needs"))
    sent = rows.select("kid", "text").join(needs, "kid").select("kid", "text", F.explode("needs").alias("need"))
    sent = sent.select("kid", "text", "need.leader", "need.leads", F.explode("need.salts").alias("salt"))
    dealt = sent.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("leads").desc(), "kid")

    def run(batches):
        hashes = WordHashes()
        leader, lead = None, None
        for batch in batches:
            out = []
            for kid, text, lead_id, leads, salt in zip(*(batch.column(c).to_pylist() for c in ("kid", "text", "leader", "leads", "salt")), strict=True):
                if leads:
                    leader, lead = (lead_id, salt), Text(hashes(text))
                elif leader == (lead_id, salt):
                    other = hashes(text)
                    if not may_align(lead.bags, bags(other), least):
                        continue
                    found = similarity(lead, other, least)
                    if found is not None:
                        out.append((kid, lead_id, found))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["node", "leader", "similarity"])

    return dealt.mapInArrow(run, "node long, leader long, similarity double")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node of each connected component of edges (u, v).

    Alternating large-star and small-star steps; each is a minimum per node with partial
    aggregation, looked up from the edges with hot nodes dealt out, and written to the
    scratch folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        both = staged(both, "star")
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count(F.lit(1)).alias("n")), "low")
        found = join_counted(both, low, ["u"], "n", ["v"], "c").select("u", "v", F.col("c.low").alias("low"))
        if large:
            out = found.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            out = found.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        return staged(out.filter("u <> v").distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(u, v) % 1000003)")).first())

    e = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now = state(e)
    for _ in range(rounds):
        e = star(star(e, True), False)
        was, now = now, state(e)
        if was == now:
            return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, least_shared: int = LEAST_SHARED, group_rows: int = GROUP_ROWS, count_links: bool = True) -> DataFrame:
    """(doc_id, class_id, kept, links, match_id, similarity) for every row of documents.

    Words are the runs between blanks. Rows are linked when their whole texts align with at
    most ``1 - least`` edits a word of the longer one; candidates come from Order MinHash over
    occurrence-labelled shingles of five words and of three, and from short runs for texts up to
    SHORT words. A class is a connected component and carries its smallest doc_id. Equal texts
    (null: empty) form one node and are always linked; a text under four words is linked to
    equal ones only, as one edit is more than a fifth of it. ``links`` counts the links found from a row's text to other texts, ``match_id`` and
    ``similarity`` name the most alike of them (smallest doc_id among equals; null if none), so
    that a class can be audited link by link.

    Counting links aligns all pairs of a family. Without ``count_links`` classes are the same, but
    pairs that are of one class already are not aligned (see ``tied``): there is no column
    ``links``, and ``match_id`` is the most alike of the texts that a row's text was aligned with.

    doc_id is the identity of a document: rows that repeat it are in one class. Rows without
    doc_id are named by a hash of their text. An empty table gives no rows; other columns are
    not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("kid"), text.alias("text"))
    sketched = staged(sketches(rows), "sketches")
    best = F.min(F.struct("kid", "bands", "runs", "sketch", "short", "words", "bag")).alias("best")
    nodes = staged(sketched.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), best).select("d1", "d2", "copies", F.col("best.kid").alias("node"), "best.bands", "best.runs", "best.sketch", "best.short", "best.words", "best.bag"), "nodes")
    # rows with one doc_id and several texts are several nodes of one document
    same = sketched.groupBy("kid").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).filter("a <> b").select("kid")
    again = sketched.join(same, "kid").select("kid", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select(F.col("kid").alias("u"), F.col("node").alias("v"))
    if count_links:
        links = staged(verified(rows, staged(candidates(nodes, least_shared, least, group_rows), "pairs"), least), "links")
        comps = components(links.select(F.col("node").alias("u"), F.col("leader").alias("v")).unionByName(again))
    else:
        links, comps = tied(rows, nodes, again, least, least_shared, group_rows)
    ends = links.unionByName(links.select(F.col("leader").alias("node"), F.col("node").alias("leader"), "similarity"))
    most_alike = F.max(F.struct("similarity", (-F.col("leader")).alias("other"))).alias("best")
    ends = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"), most_alike)
    classes = nodes.select("d1", "d2", "copies", "node").join(comps, "node", "left").join(ends, "node", "left")
    found = [F.coalesce("comp", "node").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), (-F.col("best.other")).alias("match_id"), F.col("best.similarity").alias("similarity")]
    classes = classes.select("d1", "d2", "copies", *found)
    classes = staged(classes, "classes")
    placed = join_counted(sketched.select("kid", "d1", "d2"), classes, ["d1", "d2"], "copies", ["kid"], "c")
    shown = ["c.links"] * count_links + ["c.match_id", "c.similarity"]
    return placed.select(F.col("kid").alias("doc_id"), F.col("c.class_id").alias("class_id"), (F.col("kid") == F.col("c.class_id")).alias("kept"), *shown)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with its columns. Rows
    that repeat that doc_id are the same document and stay too."""
    kid = free_name(docs, "__kid")
    dropped = near_duplicates(docs, count_links=False).filter("not kept").select(F.col("doc_id").alias(kid)).distinct()
    named = docs.withColumn(kid, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return named.join(dropped, kid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), count_links=False)
