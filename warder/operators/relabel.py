"""Relabel paths and relations between two types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warder.functions.predicates import expand_type, match_name
from warder.operators.flow import direct_flows, transitive_flows

FROM, TO = "relabelfrom", "relabelto"


def relabel_rights(rules: DataFrame, type_attr: DataFrame, classes: list[str] | None = None, subjects: list[str] | None = None) -> DataFrame:
    """(policy_id, subject, written, class, target, can_from, can_to) of expanded allow rules."""
    allow = rules.filter("kind = 'allow' AND enabled").filter(F.arrays_overlap("perms", F.array(F.lit(FROM), F.lit(TO))))
    if classes:
        allow = allow.filter(F.col("class").isin(classes))
    wide = expand_type(expand_type(allow.withColumn("written", F.col("source")), "target", type_attr), "source", type_attr)
    if subjects:
        wide = wide.filter(F.col("source").isin(subjects))
    can = lambda p: F.bool_or(F.array_contains("perms", p))
    return wide.groupBy("policy_id", F.col("source").alias("subject"), "class", "target").agg(can(FROM).alias("can_from"), can(TO).alias("can_to"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def relabel_object(rights: DataFrame, start: DataFrame, direction: str = "both", pattern: str | None = None) -> DataFrame:
    """Types that objects of the start types (policy_id, type) can be relabelled to or from, with
    the subject that does it: (policy_id, start, subject, class, end, direction)."""
    a = rights.join(start.select("policy_id", F.col("type").alias("target")).distinct(), ["policy_id", "target"], "left_semi")
    a = a.select("policy_id", "subject", "class", F.col("target").alias("start"), F.col("can_from").alias("a_from"), F.col("can_to").alias("a_to"))
    b = rights.select("policy_id", "subject", "class", F.col("target").alias("end"), F.col("can_from").alias("b_from"), F.col("can_to").alias("b_to"))
    pairs = a.join(b, ["policy_id", "subject", "class"]).filter("start <> end")
    to, from_ = F.col("a_from") & F.col("b_to"), F.col("a_to") & F.col("b_from")
    way = F.when(to & from_, "both").when(to, "to").when(from_, "from")
    found = pairs.withColumn("direction", way).filter("direction is not null")
    if direction in ("to", "from"):
        found = found.filter(F.col("direction").isin(direction, "both"))
    if pattern:
        found = found.filter(match_name(F.col("end"), pattern, True))
    return found.select("policy_id", "start", "subject", "class", "end", "direction")


def relabel_subject(rights: DataFrame, subject: str, pattern: str | None = None) -> DataFrame:
    """All types that a subject may relabel to, from, or both."""
    own = rights.filter(F.col("subject") == subject).groupBy("policy_id", F.col("target").alias("type")).agg(F.bool_or("can_from").alias("f"), F.bool_or("can_to").alias("t"))
    found = own.select("policy_id", "type", F.when(F.col("f") & F.col("t"), "both").when(F.col("t"), "to").otherwise("from").alias("direction"))
    return found.filter(match_name(F.col("type"), pattern, True)) if pattern else found


def common(bridge: DataFrame, member: str, group: str, a: str, b: str) -> DataFrame:
    """Groups (attributes, roles, users) that two types share."""
    one = bridge.filter(F.col(member) == a).select("policy_id", group).distinct()
    return one.join(bridge.filter(F.col(member) == b).select("policy_id", group).distinct(), ["policy_id", group], "left_semi")


def access_pools(rules: DataFrame, type_attr: DataFrame, a: str, b: str) -> DataFrame:
    """(policy_id, target, a_rules, b_rules): what each of two types may access, by concrete target."""
    allow = rules.filter("kind = 'allow' AND enabled")
    wide = expand_type(expand_type(allow, "source", type_attr).filter(F.col("source").isin(a, b)), "target", type_attr)
    of = lambda t: F.array_sort(F.collect_set(F.when(F.col("source") == t, F.col("rule_id"))))
    return wide.groupBy("policy_id", "target").agg(of(a).alias("a_rules"), of(b).alias("b_rules"))


def similar(pools: DataFrame) -> DataFrame:
    return pools.filter("size(a_rules) > 0 AND size(b_rules) > 0")


def dissimilar(pools: DataFrame) -> DataFrame:
    """Targets that only one of the types may access, with that side."""
    return pools.filter("size(a_rules) = 0 OR size(b_rules) = 0").withColumn("side", F.when(F.expr("size(a_rules) > 0"), "a").otherwise("b"))


def rules_between(rules: DataFrame, type_attr: DataFrame, a: str, b: str) -> DataFrame:
    """Allow rules from one type to the other, either way, attributes included."""
    allow = rules.filter("kind = 'allow' AND enabled").withColumns({"ws": F.col("source"), "wt": F.col("target")})
    wide = expand_type(expand_type(allow, "source", type_attr), "target", type_attr)
    hit = ((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a))
    return wide.filter(hit).select("policy_id", "rule_id", F.col("ws").alias("source"), F.col("wt").alias("target"), "class", "perms").distinct()


def terules_between(terules: DataFrame, a: str, b: str) -> DataFrame:
    """Type rules of one type whose target or default is the other."""
    one = lambda x, y: (F.col("source") == x) & ((F.col("target") == y) | (F.col("default_type") == y))
    return terules.filter(one(a, b) | one(b, a))


def flows_between(edges: DataFrame, starts: DataFrame, end: str, transitive: bool = False) -> DataFrame:
    """Direct or transitive flows of the starts that end at a type."""
    found = transitive_flows(edges, starts) if transitive else direct_flows(edges, starts)
    return found.filter(F.col("end") == end)
