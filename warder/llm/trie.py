"""Trie of conversation prefixes, with subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warder.llm.common import distilled, join_counted, staged

#: Conversations of a block begin with up to HEADS - 1 turns of its first one.
BLOCK, HEADS = 100, 6
#: Characters of a text that order turns of one number and role, before a hash of the text.
TIE_CHARS = 64
#: Identifiers that are joined to one string before digests are made.
CHUNK = 4096
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with the range of rows they stand in: digest and length take the text's place.

    Rows are dealt out by ranges of (conversation, order), so a conversation that has a third
    of all rows is in many ranges.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.sha2(role.cast("binary"), 256), text).cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    conv_id = F.col("conv_id").cast("long")
    rows = conversations.select(
        conv_id.alias("conv_id"),
        F.coalesce(conv_id.cast("string"), F.lit("")).alias("c"),
        "turn",
        role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("start"),
        F.xxhash64(text).alias("rest"),
        F.monotonically_increasing_id().alias("row_id"),
        half(1).alias("d1"),
        half(16).alias("d2"),
        F.length(text).cast("long").alias("chars"),
    )
    rows = staged(rows, "turns")
    order = [F.col("c"), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "start", "rest", "row_id"))]
    return staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their length, their rebuilt turns with positions from 1)."""
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged(rows.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")), "sizes")
    own = sizes.groupBy("c").agg(F.sum("n").alias("own"), F.min("conv_id").alias("conv_id"))
    h = F.pmod(F.crc32(F.col("c").cast("binary")), F.lit(HEADS))
    own = own.select("c", "conv_id", "own", F.when(F.col("c") == "", 0).otherwise(h).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).cast("string").alias("base"))
    bases = own.select(F.col("c").alias("base"), F.col("own").alias("of_base"))
    lent = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = own.join(bases, "base", "left").select("c", "conv_id", "h", "base", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = staged(convs, "conversations")
    starts = sizes.select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    places = starts.join(convs.select("c", "h", "lent", "length"), "c")
    order = [F.col("turn").asc_nulls_first(), *map(F.col, ("role", "start", "rest", "row_id"))]
    inner = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))
    ranked = rows.withColumn("inner", inner).drop("turn", "role", "start", "rest").join(places, ["c", "part"]).withColumn("rank", F.col("start") + F.col("inner"))
    ranked = staged(ranked.select("c", "conv_id", "part", "rank", "h", "lent", "length", "d1", "d2", "chars"), "ranked")
    keep = ["c", "conv_id", "part", "pos", "length", "d1", "d2", "chars"]
    rest = ranked.filter("rank > h").withColumn("pos", F.col("lent") + F.col("rank") - F.col("h"))
    heads = ranked.filter(F.col("rank") < HEADS).select(F.col("c").alias("base"), F.col("rank").alias("pos"), "d1", "d2", "chars")
    head = convs.filter("lent > 0").join(heads, "base").filter("pos <= lent").withColumn("part", F.lit(-1))
    return convs, rest.select(*keep).unionByName(head.select(*keep))


def prefixes(rows: DataFrame) -> DataFrame:
    """Turns with the 128-bit digest (p1, p2) of all turns to here and (q1, q2) of those before.

    The digest is the exclusive or of hashes of turns and their positions, so ranges of a long
    conversation are worked out on their own and put together.
    """
    x = {"x1": F.xxhash64("pos", "d1", "d2"), "x2": F.xxhash64(F.lit(1), "d2", "d1", "pos")}
    rows = staged(rows.select("c", "conv_id", "part", "pos", "length", "chars", *[v.alias(k) for k, v in x.items()]), "rebuilt")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("c", "part").agg(*[F.expr(f"bit_xor({k})").alias(k) for k in x])
    blocks = blocks.select("c", "part", *[F.coalesce(F.expr(f"bit_xor({k})").over(before), F.lit(0)).alias(f"before_{k}") for k in x])
    here = Window.partitionBy("c", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select("*", *[F.expr(f"bit_xor({k})").over(here).alias(f"to_{k}") for k in x]).join(blocks, ["c", "part"])
    p = [F.col(f"before_x{i}").bitwiseXOR(F.col(f"to_x{i}")) for i in (1, 2)]
    ends = [p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("x1")).alias("q1"), p[1].bitwiseXOR(F.col("x2")).alias("q2")]
    return inner.select("conv_id", F.col("pos").alias("depth"), "length", "chars", *ends)


KEY = ["depth", "p1", "p2"]


def trie_nodes(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, parent, conv_id, depth, parent_conv_id, n_convs, n_children, chars, p1, p2)."""
    above = [(F.col("depth") - 1).alias("above"), "q1", "q2"]
    nodes = steps.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("chars", "q1", "q2")])
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2", "chars", "q1", "q2")]
    both = nodes.unionByName(root.select("n_convs", "conv_id", *zero)).withColumn("id", F.monotonically_increasing_id())
    both = staged(both, "nodes")
    under = both.filter("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    upper = both.select(F.col("depth").alias("above"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    table = staged(upper.join(under, ["above", "q1", "q2"]), "parents")
    counts = table.select(F.col("parent").alias("id"), "n_children")
    found = join_counted(both.withColumn("above", F.col("depth") - 1), table, ["above", "q1", "q2"], "n_children", ["id"], "up")
    found = found.select("id", "up.parent", "conv_id", "depth", "up.parent_conv_id", "n_convs", "chars", "p1", "p2").join(counts, "id", "left")
    return found.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of rows (depth, p1, p2, conv_id): SHA-256 of the
    identifiers in ascending order with commas between them.

    Tasks join runs of identifiers to strings, so that the task which has to see all members of
    a node, one after the other, reads few rows; neither holds more than a string.
    """
    names = [*KEY, "part", "no", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def chunks(batches):
        key, ids, no = None, [], 0
        for batch in batches:
            out = []
            for *of, conv_id in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if ids and (of != key or len(ids) == CHUNK):
                    out.append((*key, no, ",".join(ids)))
                    ids, no = [], no + 1
                key = of
                ids.append(str(conv_id))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, no, ",".join(ids)), kinds, strict=True)], names=names)

    def digests(batches):
        key, sha = None, None
        schema = pa.schema(list(zip([*KEY, "ends_sha256"], [*kinds[:3], pa.string()], strict=True)))
        for batch in batches:
            out = []
            for *of, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if of != key:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = of, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if sha:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, sha.hexdigest()), strict=True))], schema)

    order = [*KEY, "conv_id"]
    ranged = ends.filter("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ranged.select(*KEY, F.spark_partition_id().alias("part"), "conv_id").mapInArrow(chunks, "depth long, p1 long, p2 long, part int, no long, ids string")
    parts = parts.repartition(*KEY).sortWithinPartitions(*KEY, "part", "no")
    return parts.mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def chains(unary: DataFrame, values: list[str]) -> DataFrame:
    """Unary nodes with the node below their chain as ``jump`` and the chain's sum from here on.

    Pointer doubling: each round a node takes over the jump and the sum of the node it jumps
    to. Nodes whose jump has left the chain are done and no longer joined; the jumps of the
    others differ, so no key is hot.
    """
    ids = unary.select(F.col("id").alias("jump"), F.lit(True).alias("found"))
    active = staged(unary.join(ids, "jump", "left").withColumn("done", F.col("found").isNull()).drop("found"), "chain")
    done = []
    while True:
        done.append(active.filter("done"))
        rows = active.filter("not done")
        if rows.isEmpty():
            return union(done)
        far = union([*done, rows]).select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("done").alias("far_done"), *[F.col(v).alias(f"far_{v}") for v in values])
        moved = rows.drop("done").join(far, "jump")
        kept = [c for c in rows.columns if c not in ("jump", "done", *values)]
        active = staged(moved.select(*kept, F.col("far").alias("jump"), F.col("far_done").alias("done"), *[(F.col(v) + F.col(f"far_{v}")).alias(v) for v in values]), "chain")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, values) summed over the subtree of each node of a forest (id, parent, values).

    Tree contraction: every round compresses all chains of nodes with one child, linking the
    node below a chain to the node above it with the chain's sum on the link, and then rakes
    all leaves into their parents. Each round at least halves the leaves, whatever the depth.
    The rounds are then undone in turn: a leaf's total is what it had gathered, a chain node's
    is its chain's sum and the total of the node below. Null parents mark roots.
    """
    link = [f"link_{v}" for v in values]
    under = [f"under_{v}" for v in values]
    no = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    kids = tree.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.max("id").alias("child")).withColumnRenamed("parent", "id")
    zero = [F.lit(0).cast("long").alias(c) for c in (*link, *under)]
    alive = staged(tree.join(kids, "id", "left").select("id", "parent", no("kids"), "child", *values, *zero), "alive")
    rounds = []
    while not alive.isEmpty():
        only = (F.col("kids") == 1) & F.col("parent").isNotNull()
        sums = [(F.col(v) + F.col(u)).alias(v) for v, u in zip(values, under, strict=True)]
        unary = staged(alive.filter(only).select("id", "parent", F.col("child").alias("jump"), *sums, *link), "unary")
        rest, folded = alive.filter(~only), None
        if not unary.isEmpty():
            folded = staged(chains(unary, values), "chains")
            tops = folded.join(unary.select(F.col("jump").alias("id")), "id", "left_anti")
            above = [(F.col(v) + F.col(k)).alias(f"top_{k}") for v, k in zip(values, link, strict=True)]
            tops = tops.select(F.col("jump").alias("id"), F.col("parent").alias("top_parent"), *above)
            joined = [F.coalesce(f"top_{k}", k).alias(k) for k in link]
            rest = rest.join(tops, "id", "left").select("id", F.coalesce("top_parent", "parent").alias("parent"), "kids", "child", *values, *joined, *under)
            rest = staged(rest, "folded")
        leaf = F.col("kids") == 0
        rounds.append((folded, rest.filter(leaf).select("id", *values)))
        raked = [F.sum(F.when(leaf, F.col(v) + F.col(k)).otherwise(0)).alias(f"more_{v}") for v, k in zip(values, link, strict=True)]
        left = [F.sum(F.when(leaf, 0).otherwise(F.col(k))).alias(u) for k, u in zip(link, under, strict=True)]
        kids = rest.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.when(~leaf, 1)).alias("kids"), F.max(F.when(~leaf, F.col("id"))).alias("child"), *raked, *left)
        more = [(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values]
        alive = staged(rest.filter(~leaf).select("id", "parent", *values, *link).join(kids, "id").select("id", "parent", "kids", "child", *more, *link, *under), "alive")
    known: list[DataFrame] = []
    for folded, leaves in reversed(rounds):
        known.append(leaves)
        if folded is not None:
            long = folded.groupBy(F.col("jump").alias("id")).agg(F.count(F.lit(1)).alias("n"))
            ends = union(known).join(long, "id").select(F.col("id").alias("jump"), "n", *[F.col(v).alias(f"below_{v}") for v in values])
            found = join_counted(folded, staged(ends, "ends"), ["jump"], "n", ["id"], "c")
            known.append(staged(found.select("id", *[(F.col(v) + F.col(f"c.below_{v}")).alias(v) for v in values]), "totals"))
    return union(known) if known else tree.select("id", *values)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Turns are ordered by number (null first), then role and the first characters and a hash of
    the text; null roles and texts are empty, repeated rows are turns of their own. Rows without
    conv_id form one conversation that borrows no turns; it counts as a member, but has no
    identifier to name nodes with (conv_id is null where it is the only member) or to list in
    the digest. An empty table has no nodes; other columns are not read.
    """
    spark = conversations.sparkSession

    def build() -> DataFrame:
        convs, rows = rebuilt(turns(conversations))
        steps = staged(prefixes(rows), "steps")
        tree = staged(trie_nodes(convs, steps), "trie")
        zero = [F.lit(0).cast("long").alias(c) for c in KEY]
        ends = steps.filter("depth = length").select(*KEY, "conv_id").unionByName(convs.filter("length = 0").select(*zero, "conv_id"))
        leaf: Column = F.when(F.col("n_children") == 0, 1).otherwise(0)
        own = tree.select("id", "parent", leaf.cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
        totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
        found = tree.join(totals, "id").join(end_digests(ends), KEY, "left")
        return found.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
        )

    return distilled(spark, "prefix-trie", build)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS t
  FROM range(256) r(k)),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
        FROM conversations GROUP BY conv_id),
hashed AS (SELECT conv_id, seq, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM own),
heads AS (
  SELECT conv_id, seq, xor(list_reduce([CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(x) // 2)],
                                       lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM hashed, crc_table),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq
            FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
steps AS (SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq FROM rebuilt),
nodes AS (SELECT depth, seq[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256
          FROM steps GROUP BY 1, 2),
children AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].t) END AS saved
            FROM nodes n LEFT JOIN children USING (depth, prefix)),
above AS (SELECT unnest(range(depth + 1)) AS up, prefix, n_children, saved FROM counted),
totals AS (SELECT up AS depth, prefix[1:up] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
           FROM above GROUP BY 1, 2)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN totals USING (depth, prefix) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]
"""
