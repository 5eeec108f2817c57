"""Domain transitions: (start -> end) with entrypoint, execute and type_transition or setexec."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warder.functions.predicates import candidates, expand_type, match_name
from warder.functions.state import written

PARTS = ["transition", "entrypoint", "execute", "setexec", "type_transition"]


def edge_tables(rules: DataFrame, terules: DataFrame, type_attr: DataFrame) -> dict[str, DataFrame]:
    """The five edges, expanded: transition (start, end), entrypoint (end, ep), execute (start,
    ep), setexec (start), type_transition (start, ep, end), each with its rule_ids. Rules are
    cut to those of edges before they are expanded, and expanded once."""
    allow = rules.filter("kind = 'allow' AND enabled AND (class = 'process' AND arrays_overlap(perms, array('transition', 'setexec')) OR class = 'file' AND arrays_overlap(perms, array('entrypoint', 'execute')))")
    allow = allow.select("policy_id", "rule_id", "source", "target", "class", "perms")
    wide = written(expand_type(expand_type(allow, "target", type_attr), "source", type_attr), "edge_rules")

    def having(perm: str, class_: str, names: tuple[str, ...]) -> DataFrame:
        hit = wide.filter((F.col("class") == class_) & F.array_contains("perms", perm))
        columns = [F.col(c).alias(n) for c, n in zip(("source", "target"), names, strict=False)]
        return hit.groupBy("policy_id", *columns).agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))

    change = terules.filter("kind = 'type_transition' AND class = 'process' AND enabled")
    change = expand_type(expand_type(change, "target", type_attr), "source", type_attr)
    return {
        "transition": having("transition", "process", ("start", "end")),
        "entrypoint": having("entrypoint", "file", ("end", "ep")),
        "execute": having("execute", "file", ("start", "ep")),
        "setexec": having("setexec", "process", ("start",)),
        "type_transition": change.groupBy("policy_id", F.col("source").alias("start"), F.col("target").alias("ep"), F.col("default_type").alias("end")).agg(F.array_sort(F.collect_set("rule_id")).alias("rules")),
    }


def _known(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.select("policy_id", *keys, F.col("rules").alias(name))


def transitions(edges: dict[str, DataFrame], needs_change: bool = True) -> DataFrame:
    """All transitions, whole and partial: one row for each (start, end, ep).

    Rows come from transition edges with the entrypoints of their end, and also with the files
    that the start may execute and turn by type_transition into that end; missing parts are
    null. ``valid``: all three are there and, where the policy needs it, a type_transition or
    setexec. Joins start from the transition edges, so no unrelated pairs are made.
    """
    pair = _known(edges["transition"], "transition", ["start", "end"])
    entry = _known(edges["entrypoint"], "entrypoint", ["end", "ep"])
    run = _known(edges["execute"], "execute", ["start", "ep"])
    change = _known(edges["type_transition"], "type_transition", ["start", "ep", "end"])
    by_entry = pair.join(entry, ["policy_id", "end"], "left").select("policy_id", "start", "end", "ep")
    by_change = change.select("policy_id", "start", "end", "ep").join(pair, ["policy_id", "start", "end"], "left_semi")
    rows = by_entry.unionByName(by_change).distinct()
    rows = rows.join(pair, ["policy_id", "start", "end"], "left").join(entry, ["policy_id", "end", "ep"], "left").join(run, ["policy_id", "start", "ep"], "left")
    rows = rows.join(change, ["policy_id", "start", "ep", "end"], "left").join(_known(edges["setexec"], "setexec", ["start"]), ["policy_id", "start"], "left")
    return with_validity(rows, needs_change)


def with_validity(rows: DataFrame, needs_change: bool = True) -> DataFrame:
    whole = F.col("transition").isNotNull() & F.col("entrypoint").isNotNull() & F.col("execute").isNotNull()
    if needs_change:
        whole = whole & (F.col("setexec").isNotNull() | F.col("type_transition").isNotNull())
    return rows.withColumn("valid", whole & F.col("start").isNotNull() & F.col("ep").isNotNull() & F.col("end").isNotNull())


def domain_transitions(edges: dict[str, DataFrame], domains: DataFrame, forward: bool = True, which: str = "valid", needs_change: bool = True, pattern: str | None = None) -> DataFrame:
    """Transitions from (or, reverse, into) the given domains (policy_id, type); ``which``:
    valid, invalid or both; ``pattern`` is searched in the other end. The domains filter the
    edges before any join."""
    side = "start" if forward else "end"
    near = domains.select("policy_id", F.col("type").alias(side)).distinct()
    cut = {k: v.join(near, ["policy_id", side], "left_semi") if side in v.columns else v for k, v in edges.items()}
    rows = transitions(cut, needs_change)
    if which != "both":
        rows = rows.filter(F.col("valid") if which == "valid" else ~F.col("valid"))
    return rows.filter(match_name(F.col("end" if forward else "start"), pattern, True)) if pattern else rows


def transitions_between(edges: dict[str, DataFrame], pairs: DataFrame, needs_change: bool = True) -> DataFrame:
    """Valid transitions from a to b and from b to a for pairs (policy_id, a, b), each with
    ``forward``. The pairs filter the edges before any join."""
    ways = pairs.select("policy_id", F.col("a").alias("start"), F.col("b").alias("end"), F.lit(True).alias("forward"))
    ways = ways.unionByName(pairs.select("policy_id", F.col("b").alias("start"), F.col("a").alias("end"), F.lit(False).alias("forward"))).distinct()
    found = domain_transitions(edges, ways.select("policy_id", F.col("start").alias("type")), True, "valid", needs_change)
    return found.join(ways, ["policy_id", "start", "end"])


def orphan_type_transitions(edges: dict[str, DataFrame], needs_change: bool = True) -> DataFrame:
    """type_transition rules that no transition uses, as invalid results with what there is."""
    change = _known(edges["type_transition"], "type_transition", ["start", "ep", "end"])
    rows = change.join(transitions(edges, needs_change).select("policy_id", "start", "ep", "end"), ["policy_id", "start", "ep", "end"], "left_anti")
    rows = rows.join(_known(edges["transition"], "transition", ["start", "end"]), ["policy_id", "start", "end"], "left")
    rows = rows.join(_known(edges["entrypoint"], "entrypoint", ["end", "ep"]), ["policy_id", "end", "ep"], "left")
    rows = rows.join(_known(edges["execute"], "execute", ["start", "ep"]), ["policy_id", "start", "ep"], "left")
    rows = rows.join(_known(edges["setexec"], "setexec", ["start"]), ["policy_id", "start"], "left")
    return rows.withColumn("valid", F.lit(False))


def filter_access(rows: DataFrame, rules: DataFrame, types: DataFrame, type_attr: DataFrame, target: str, classes: list[str], perms: list[str]) -> DataFrame:
    """Keep transitions whose end domain may access a type with one of the classes and
    permissions; the rules are attached as ``access``."""
    allow = rules.filter("kind = 'allow' AND enabled").filter(F.col("class").isin(classes) & F.arrays_overlap("perms", F.array(*[F.lit(p) for p in perms])))
    found = candidates(types, type_attr, target, indirect=True)
    hit = allow.join(found.select("policy_id", F.col("type").alias("target")), ["policy_id", "target"], "left_semi")
    access = expand_type(hit, "source", type_attr).groupBy("policy_id", F.col("source").alias("end")).agg(F.array_sort(F.collect_set("rule_id")).alias("access"))
    return rows.join(access, ["policy_id", "end"])


def verify_transitions(edges: dict[str, DataFrame], asked: DataFrame, needs_change: bool = True) -> DataFrame:
    """For asked (policy_id, start, ep, end) the array of missing parts. A missing
    type_transition is not reported if the start has setexec or changes to the end by another
    entrypoint."""
    rows = asked.select("policy_id", "start", "ep", "end")
    rows = rows.join(_known(edges["transition"], "transition", ["start", "end"]), ["policy_id", "start", "end"], "left")
    rows = rows.join(_known(edges["entrypoint"], "entrypoint", ["end", "ep"]), ["policy_id", "end", "ep"], "left")
    rows = rows.join(_known(edges["execute"], "execute", ["start", "ep"]), ["policy_id", "start", "ep"], "left")
    rows = rows.join(_known(edges["setexec"], "setexec", ["start"]), ["policy_id", "start"], "left")
    rows = rows.join(_known(edges["type_transition"], "type_transition", ["start", "ep", "end"]), ["policy_id", "start", "ep", "end"], "left")
    other = edges["type_transition"].select("policy_id", "start", "end", F.lit(True).alias("other")).distinct()
    rows = rows.join(other, ["policy_id", "start", "end"], "left")
    missing = {p: F.col(p).isNull() for p in PARTS}
    if needs_change:
        missing["setexec"] = missing["setexec"] & missing["type_transition"] & F.col("other").isNull()
        missing["type_transition"] = missing["type_transition"] & F.col("setexec").isNull() & F.col("other").isNull()
    else:
        missing["setexec"] = missing["type_transition"] = F.lit(False)
    return rows.select("policy_id", "start", "ep", "end", F.array_compact(F.array(*[F.when(c, p) for p, c in missing.items()])).alias("missing"))


def missing_parts(rows: DataFrame) -> DataFrame:
    """Add ``missing`` to transition rows."""
    return rows.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(p).isNull(), p) for p in PARTS])))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
