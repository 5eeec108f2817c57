"""Information flows: weighted directed edges from allow rules, direct and transitive flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions.predicates import candidates, expand_type, match_name
from warder.functions.state import Rounds, written


def flow_edges(
    rules: DataFrame,
    perm_map: DataFrame,
    type_attr: DataFrame,
    min_weight: int = 1,
    edge_length: str = "max",
    intermediates: DataFrame | None = None,
    class_perms: DataFrame | None = None,
) -> DataFrame:
    """(policy_id, src, src_side, dst, dst_side, length, rule_ids) of the enabled allow rules.

    A permission of weight w has length 11 - w, kept within 1 and 10; those beyond
    11 - min_weight do not count. A rule that reads gives an edge from object to subject, one
    that writes an edge from subject to object, each with its shortest length. Rules that share
    an edge leave the longest of their lengths, or the shortest with ``edge_length='min'``.
    ``intermediates`` (policy_id, type) restricts both sides, ``class_perms`` (class, perm) the
    permissions.
    """
    allow = rules.filter("kind = 'allow' AND enabled")
    if intermediates is not None:
        near = intermediates.select("policy_id", "type").distinct()
        attrs = type_attr.join(near, ["policy_id", "type"], "left_semi").select("policy_id", F.col("attr").alias("type"))
        near = near.unionByName(attrs).distinct()
        for side in ("source", "target"):
            allow = allow.join(near.withColumnRenamed("type", side), ["policy_id", side], "left_semi")
    perms = allow.select("policy_id", "rule_id", "source", "target", "class", F.explode("perms").alias("perm"))
    if class_perms is not None:
        perms = perms.join(F.broadcast(class_perms.select("class", "perm").distinct()), ["class", "perm"], "left_semi")
    mapped = perms.join(F.broadcast(perm_map), ["class", "perm"])
    length = F.greatest(F.lit(1), F.least(F.lit(10), 11 - F.col("weight")))
    mapped = mapped.withColumn("length", length.cast("int")).filter(F.col("length") <= 11 - min_weight)
    reads, writes = F.col("direction").isin("r", "b"), F.col("direction").isin("w", "b")
    by_rule = mapped.groupBy("policy_id", "rule_id", "source", "target").agg(F.min(F.when(reads, F.col("length"))).alias("read"), F.min(F.when(writes, F.col("length"))).alias("write"))
    wide = expand_type(expand_type(by_rule, "target", type_attr), "source", type_attr)
    read = wide.filter("read is not null").select("policy_id", F.col("target").alias("src"), F.lit("object").alias("src_side"), F.col("source").alias("dst"), F.lit("subject").alias("dst_side"), F.col("read").alias("length"), "rule_id")
    write = wide.filter("write is not null").select("policy_id", F.col("source").alias("src"), F.lit("subject").alias("src_side"), F.col("target").alias("dst"), F.lit("object").alias("dst_side"), F.col("write").alias("length"), "rule_id")
    pick = F.max if edge_length == "max" else F.min
    return read.unionByName(write).groupBy("policy_id", "src", "src_side", "dst", "dst_side").agg(pick("length").alias("length"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


DIRECTION = {"in": 1, "out": 2, "either": 3, "both": 3}


def direct_flows(edges: DataFrame, starts: DataFrame, direction: str = "either", end_pattern: str | None = None) -> DataFrame:
    """(policy_id, start, end, direction, length, rule_ids): one-hop flows of the start types
    (policy_id, type). direction: 1 in, 2 out, 3 both ways; 'both' keeps the last only."""
    start = starts.select("policy_id", F.col("type").alias("start")).distinct()
    out = edges.join(start, (edges.policy_id == start.policy_id) & (edges.src == start.start)).select(edges.policy_id, "start", F.col("dst").alias("end"), F.lit(2).alias("way"), "length", "rule_ids")
    into = edges.join(start, (edges.policy_id == start.policy_id) & (edges.dst == start.start)).select(edges.policy_id, "start", F.col("src").alias("end"), F.lit(1).alias("way"), "length", "rule_ids")
    found = {"in": into, "out": out}.get(direction, out.unionByName(into))
    merged = found.filter("end <> start").groupBy("policy_id", "start", "end").agg(F.bit_or("way").alias("direction"), F.min("length").alias("length"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_ids")))).alias("rule_ids"))
    if direction == "both":
        merged = merged.filter("direction = 3")
    return merged.filter(match_name(F.col("end"), end_pattern, True)) if end_pattern else merged


#: Rounds after which a search that still improves is given up with an error.
MOST_ROUNDS = 1000
#: Width of a bucket of lengths: that of the longest edge.
WIDTH = 10
KEY = ["policy_id", "search", "v"]


def steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges (policy_id, a, b, w) between nodes (node, side), turned round for ``in``."""
    at = lambda end: F.struct(F.col(end).alias("node"), F.col(f"{end}_side").alias("side"))
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    return edges.select("policy_id", at(a).alias("a"), at(b).alias("b"), F.col("length").alias("w"))


def both_sides(column: str) -> Column:
    return F.explode(F.array(*[F.struct(F.col(column).alias("node"), F.lit(s).alias("side")) for s in ("subject", "object")])).alias("v")


def shortest(step: DataFrame, sources: DataFrame, gone: DataFrame | None = None, cut: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    """(policy_id, search, v, dist, up): shortest lengths from the sources (policy_id, search, v)
    of each search, with the node before on such a way (the smallest; null at a source).

    All searches advance together through buckets of lengths: the nodes of a bucket are relaxed
    until none improves and are then settled for good, written once and never joined again.
    Only open nodes are rewritten from round to round. Searches avoid the nodes ``gone``
    (policy_id, search, v) and the edges ``cut`` (policy_id, search, a, b), and end with the bucket
    in which one of their ``goals`` (policy_id, search, v) is settled.
    """
    open_rows, none = Rounds(step.sparkSession, "open"), step.schema["a"].dataType
    rows = open_rows.put(sources.select(*KEY, F.lit(0).alias("dist"), F.lit(None).cast(none).alias("up"), F.lit(True).alias("fresh")), low=F.min("dist"))
    settled: list[DataFrame] = []
    left, low = MOST_ROUNDS, open_rows.seen["low"]
    while low is not None:
        limit = (low // WIDTH + 1) * WIDTH
        near = F.col("dist") < limit
        while True:
            moved = rows.filter(F.col("fresh") & near).withColumnRenamed("v", "a").join(step, ["policy_id", "a"])
            if cut is not None:
                moved = moved.join(cut, ["policy_id", "search", "a", "b"], "left_anti")
            moved = moved.select("policy_id", "search", F.col("b").alias("v"), (F.col("dist") + F.col("w")).alias("dist"), F.col("a").alias("up"))
            for known in (gone, *settled):
                moved = moved if known is None else moved.join(known.select(*KEY), KEY, "left_anti")
            held = rows.select(*KEY, "dist", "up", (F.col("fresh") & ~near).alias("fresh"), F.col("dist").alias("was"))
            both = held.unionByName(moved.withColumns({"fresh": F.lit(False), "was": F.lit(None).cast("int")}))
            best = both.groupBy(*KEY).agg(F.min(F.struct("dist", "up")).alias("m"), F.min("was").alias("was"), F.bool_or("fresh").alias("fresh"))
            better = F.col("was").isNull() | (F.col("m.dist") < F.col("was"))
            best = best.select(*KEY, "m.dist", "m.up", (better | F.col("fresh")).alias("fresh"))
            rows = open_rows.put(best, more=F.count(F.when(F.col("fresh") & near, 1)), low=F.min(F.when(~near, F.col("dist"))))
            if not open_rows.seen["more"]:
                break
            left -= 1
            if not left:
                raise RuntimeError(f"flows did not settle in {MOST_ROUNDS} rounds")
        low = open_rows.seen["low"]
        settled.append(written(rows.filter(near).drop("fresh"), "settled"))
        rows = rows.filter(~near)
        if goals is not None:
            rows = rows.join(settled[-1].join(goals, KEY, "left_semi").select("policy_id", "search").distinct(), ["policy_id", "search"], "left_anti")
    return reduce(DataFrame.unionByName, settled) if settled else rows.drop("fresh")


def within_hops(step: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """The same for ways of at most so many steps; v and up also tell the step, as a node may be
    reached by a longer way of fewer steps."""
    at = lambda c, n: F.struct(F.col(f"{c}.node").alias("node"), F.col(f"{c}.side").alias("side"), F.lit(n).alias("hop"))
    layer = sources.select("policy_id", "search", "v", F.lit(0).alias("dist"), F.lit(None).cast(step.schema["a"].dataType).alias("up"))
    layers, best = [layer.select("policy_id", "search", at("v", 0).alias("v"), "dist", F.lit(None).cast(layer.select(at("v", 0).alias("v")).schema["v"].dataType).alias("up"))], layer
    for hop in range(1, hops + 1):
        moved = layer.withColumnRenamed("v", "a").drop("up").join(step, ["policy_id", "a"]).select("policy_id", "search", F.col("b").alias("v"), (F.col("dist") + F.col("w")).alias("dist"), F.col("a").alias("up"))
        moved = moved.groupBy(*KEY).agg(F.min(F.struct("dist", "up")).alias("m")).select(*KEY, "m.dist", "m.up")
        layer = written(moved.join(best.select(*KEY, F.col("dist").alias("known")), KEY, "left").filter("known is null or dist < known").drop("known"), "layer")
        best = written(best.unionByName(layer).groupBy(*KEY).agg(F.min("dist").alias("dist")), "best").withColumn("up", F.lit(None).cast(step.schema["a"].dataType))
        layers.append(layer.select("policy_id", "search", at("v", hop).alias("v"), "dist", at("up", hop - 1).alias("up")))
    return reduce(DataFrame.unionByName, layers)


def trace(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(policy_id, search, v, path): the nodes from a source to each of the ends (policy_id,
    search, v), followed up the tree by pointer doubling: round n adds the nodes that are 2**n to
    2**(n+1) - 1 steps up, and doubles the jumps."""
    spark = tree.sparkSession
    jumps, found = Rounds(spark, "jumps"), Rounds(spark, "ways")
    n = F.count(F.lit(1))
    jump = jumps.put(tree.filter("up is not null").select(*KEY, "up"), n=n)
    way = found.put(ends.select(*KEY, F.col("v").alias("at"), F.lit(0).alias("back")))
    size = 1
    while jumps.seen["n"]:
        over = jump.select("policy_id", "search", F.col("v").alias("at"), "up")
        more = way.join(over, ["policy_id", "search", "at"]).select(*KEY, F.col("up").alias("at"), (F.col("back") + size).alias("back"))
        way = found.put(way.unionByName(more))
        twice = jump.withColumnRenamed("up", "at").join(over, ["policy_id", "search", "at"]).select(*KEY, "up")
        jump, size = jumps.put(twice, n=n), size * 2
    place = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("back"), "at")))
    return way.groupBy(*KEY).agg(F.transform(place, lambda x: x["at"]).alias("path"))


def transitive_flows(edges: DataFrame, starts: DataFrame, direction: str = "out", max_hops: int | None = None, end_pattern: str | None = None) -> DataFrame:
    """Shortest flows from (or into) each start: (policy_id, start, end, end_side, length, hops, path).

    One path is given for each end; among equal lengths the smaller predecessor and side win.
    ``max_hops`` asks for flows of at most so many steps. Paths alternate between subjects and
    objects; types may return on the other side. See ``shortest`` and ``trace``: no state of a
    round has paths in it.
    """
    step = written(steps(edges, direction), "edges")
    sources = starts.select("policy_id", F.col("type").alias("search")).distinct().select("policy_id", "search", both_sides("search"))
    tree = shortest(step, sources) if max_hops is None else within_hops(step, sources, max_hops)
    ends = tree.filter(F.col("v.node") != F.col("search"))
    if end_pattern:
        ends = ends.filter(match_name(F.col("v.node"), end_pattern, True))
    ends = ends.groupBy("policy_id", "search", F.col("v.node").alias("end")).agg(F.min(F.struct("dist", "v")).alias("m"))
    ends = written(ends.select("policy_id", "search", "end", F.col("m.v").alias("v"), F.col("m.dist").alias("length")), "ends")
    found = ends.join(trace(tree, ends), KEY)
    names = F.transform("path", lambda x: x["node"]).alias("path")
    return found.select("policy_id", F.col("search").alias("start"), "end", F.col("v.side").alias("end_side"), "length", (F.size("path") - 1).alias("hops"), names)


def spurs(fresh: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The searches that the newly accepted paths ask for: (searches, nodes gone, edges cut).

    A path (policy_id, start, end, path, from_) is left at each of its nodes from the one on
    where it left its own parent: the nodes before are gone, and so are the next steps of all
    accepted paths that begin alike.
    """
    pair = ["policy_id", "start", "end"]
    each = fresh.select(*pair, "path", F.explode(F.sequence(F.col("from_"), F.size("path") - 2)).alias("i"))
    each = each.withColumn("root", F.slice("path", F.lit(1), F.col("i") + 1))
    each = each.withColumn("search", F.xxhash64("start", "end", "root")).drop("path")
    gone = each.select("policy_id", "search", F.explode(F.slice("root", F.lit(1), F.col("i"))).alias("v"))
    alike = each.join(accepted.select(*pair, "path"), pair).filter((F.size("path") > F.col("i") + 1) & (F.slice("path", F.lit(1), F.col("i") + 1) == F.col("root")))
    cut = alike.select("policy_id", "search", F.element_at("root", -1).alias("a"), F.get("path", F.col("i") + 1).alias("b")).distinct()
    return each, gone, cut


def flow_alternatives(edges: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k shortest loop-free flows of each pair (policy_id, start, end), with rank from 1:
    (policy_id, start, end, length, path, rank); all of them if there are fewer.

    Deviation paths (Yen, with Lawler's rule) for all pairs at once: each accepted path is left
    at each of its nodes, the best ways from there are found by one run of ``shortest`` for all
    pairs, and the least candidate of each pair is accepted next. A flow is loop-free when it
    visits no type twice on one side; it may be of any number of steps. Which of several paths
    of one length comes first is decided by the path. A flow is over when it first reaches its
    end; a pair with itself has no flows.
    """
    step = written(steps(edges), "edges")
    pair = ["policy_id", "start", "end"]
    asked = written(pairs.select(*pair).distinct().filter(F.col("start") != F.col("end")), "pairs")
    # one search from each side of a start
    first = asked.select(*pair, both_sides("start")).withColumn("search", F.xxhash64("start", "end", "v.side"))
    accepted, pool = None, None
    node = step.schema["a"].dataType.simpleString()
    for rank in range(1, k + 1):
        if accepted is None:
            goals = first.select("policy_id", "search", both_sides("end"))
            where = first.select(*pair, "search", F.lit(0).alias("i"), F.array().cast(f"array<{node}>").alias("root")).distinct()
            tree = shortest(step, first.select(*KEY), goals=goals)
        else:
            searches, gone, cut = (written(x, "spurs") for x in spurs(accepted.filter(F.col("rank") == rank - 1), accepted))
            goals = searches.select("policy_id", "search", both_sides("end"))
            where = searches.select(*pair, "search", "i", F.slice("root", F.lit(1), F.col("i")).alias("root"))
            tree = shortest(step, searches.select("policy_id", "search", F.element_at("root", -1).alias("v")), gone, cut, goals)
        hits = tree.join(goals, KEY, "left_semi").groupBy("policy_id", "search").agg(F.min(F.struct("dist", "v")).alias("m"))
        hits = written(hits.select("policy_id", "search", F.col("m.v").alias("v")), "hits")
        ways = trace(tree, hits).join(where, ["policy_id", "search"])
        found = ways.select(*pair, F.concat("root", "path").alias("path"), F.col("i").alias("from_"))
        found = priced(found, step)
        pool = written(found if pool is None else pool.unionByName(found), "candidates")
        open_ = pool if accepted is None else pool.join(accepted.select(*pair, "path"), [*pair, "path"], "left_anti")
        best = open_.groupBy(*pair).agg(F.min(F.struct("length", "path", "from_")).alias("m")).select(*pair, "m.length", "m.path", "m.from_", F.lit(rank).alias("rank"))
        accepted = written(best if accepted is None else accepted.unionByName(best), "accepted")
    return accepted.select(*pair, "length", F.transform("path", lambda x: x["node"]).alias("path"), "rank")


def priced(found: DataFrame, step: DataFrame) -> DataFrame:
    """Paths with their length, the sum of their edges."""
    key = ["policy_id", "start", "end", "path", "from_"]
    each = found.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("path") - 1))).select(*key, F.element_at("path", F.col("i")).alias("a"), F.element_at("path", F.col("i") + 1).alias("b"))
    return each.join(step, ["policy_id", "a", "b"]).groupBy(*key).agg(F.sum("w").alias("length"))


def flow_starts(types: DataFrame, type_attr: DataFrame, name: str, regex: bool = False) -> DataFrame:
    """(policy_id, type) to start from: the named types, and the members of named attributes."""
    return candidates(types, type_attr, name, regex=regex, written=True)
