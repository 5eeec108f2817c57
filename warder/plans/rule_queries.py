"""Registered queries over components and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions import mls, net
from warder.operators import components as c
from warder.operators import rules as ru
from warder.operators.rules import RuleSearch
from warder.plans.fixtures import Relations

RULE = "policy_id, kind, source, target, class"
ALL = "string_agg(perm, ',' ORDER BY perm) AS perms"


def flat(rules: DataFrame) -> DataFrame:
    return rules.select("policy_id", "kind", "source", "target", "class", F.array_join(F.array_sort("perms"), ",").alias("perms"))


def av(r: Relations, search: RuleSearch) -> DataFrame:
    return flat(ru.find_avrules(r.grouped_rules(), search, r.policy_types(), r.policy_type_attr()))


def level(rank: Column | str) -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    return mls.level(F.concat(F.lit("s"), rank.cast("string")), rank.cast("int"), F.array(F.lit("c0")))


def range_rules(r: Relations) -> DataFrame:
    return r.range_trans.withColumn("range", mls.level_range(level("low_rank"), level("high_rank")))


def find_ranges(r: Relations, low: int, high: int, relation: str) -> DataFrame:
    asked = mls.level_range(level(F.lit(low)), level(F.lit(high)))
    found = ru.find_range_trans(range_rules(r), r.policy_types(), r.policy_type_attr(), RuleSearch(), asked, relation)
    return found.select("policy_id", "source", "target", "low_rank", "high_rank")


def conds(r: Relations) -> DataFrame:
    item = lambda op, name: F.struct(op.alias("op"), name.alias("name"))
    none = F.lit(None).cast("string")
    expr = F.array(item(F.lit("bool"), F.col("bool_a")), item(F.lit("bool"), F.col("bool_b")), item(F.lit("!"), none), item(F.col("op"), none))
    return r.conds.select("policy_id", "cond_id", expr.alias("expr"))


def conditional_rules(r: Relations) -> DataFrame:
    rows = r.grouped_rules().withColumns({"cond_id": F.pmod(F.ascii(F.substring("source", -1, 1)) + F.length("target"), F.lit(12)).cast("long"), "branch": F.col("class") == "file"})
    evaluated = ru.eval_conditionals(conds(r).withColumn("cond_id", F.col("cond_id").cast("long")), r.bools, {"b2": False})
    return ru.enable_rules(rows, evaluated).groupBy("policy_id", "enabled").agg(F.count(F.lit(1)).alias("n"))


def written(r: Relations) -> DataFrame:
    """Written rules: one for each rule key and parity of the order line, with its line number."""
    rules = r.grouped_rules()
    syn = rules.select("policy_id", "rule_id", F.explode("perms").alias("perm")).withColumn("lineno", F.ascii("perm") % 17).groupBy("policy_id", "rule_id", "lineno").agg(F.collect_set("perm").alias("perms")).withColumn("syn_id", F.xxhash64("rule_id", "lineno"))
    lines = ru.rule_line_numbers(rules, syn)
    return rules.join(lines, ["policy_id", "rule_id"]).select("policy_id", "kind", "source", "target", "class", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def mls_pairs(r: Relations) -> DataFrame:
    rows = r.range_trans.select("low_rank", "high_rank").distinct()
    a = rows.select(F.struct(F.lit("s").alias("sens"), F.col("low_rank").alias("rank"), F.transform(F.sequence(F.lit(0), F.col("low_rank")), lambda x: x.cast("string")).alias("cats")).alias("a"), "low_rank", "high_rank")
    out = a.withColumn("b", F.struct(F.lit("s").alias("sens"), F.col("high_rank").alias("rank"), F.transform(F.sequence(F.lit(0), F.col("high_rank") % 3), lambda x: x.cast("string")).alias("cats")))
    return out.select("low_rank", "high_rank", mls.level_compare(F.col("a"), F.col("b")).alias("relation"))


def subnets(r: Relations) -> DataFrame:
    """Messages by the subnet of an address made of their host and port."""
    rows = r.audit.filter("port is not null").select("msg_id", (F.lit(10 << 24) + F.substring("host", 2, 1).cast("long") * 65536 + F.col("port")).alias("ip"))
    table = r.portcon.select((F.lit(10 << 24) + F.col("low")).cast("long").alias("addr"), F.when(F.col("low") % 20 == 0, 0xFF00FFF0).otherwise(0xFF00FF00).cast("long").alias("mask"), "type")
    first = table.withColumn("net", F.col("addr").bitwiseAND(F.col("mask"))).groupBy("net", "mask").agg(F.min("type").alias("type")).select(F.col("net").alias("addr"), "mask", "type")
    return net.subnet_lookup(rows, "ip", first).select("msg_id", "mask", "type")


QUERIES = {
    "subnet_lookup": (subnets, "SELECT msg_id, mask, type FROM (SELECT a.msg_id, s.mask, s.type, row_number() OVER (PARTITION BY a.msg_id ORDER BY s.mask DESC) AS n FROM (SELECT msg_id, 167772160 + CAST(substr(host, 2, 1) AS BIGINT) * 65536 + port AS ip FROM audit WHERE port IS NOT NULL) AS a JOIN (SELECT (167772160 + low) & mask AS net, mask, min(type) AS type FROM (SELECT low, type, CASE WHEN low % 20 = 0 THEN 4278255600 ELSE 4278255360 END AS mask FROM portcon) GROUP BY 1, 2) AS s ON (a.ip & s.mask) = s.net) WHERE n = 1"),
    "types_by_name": (lambda r: c.find_types(r.policy_types(), "^s[12]", True).select("policy_id", "type"), "SELECT policy_id, type FROM types, (VALUES ('F'), ('O'), ('P')) AS v(policy_id) WHERE NOT is_attr AND regexp_matches(type, '^s[12]')"),
    "types_indirect": (lambda r: ru.candidates(r.policy_types(), r.policy_type_attr(), "Brand_1", regex=True, indirect=True).select("policy_id", "type"), "SELECT policy_id, type FROM (VALUES ('F'), ('O'), ('P')) AS v(policy_id), (SELECT type FROM types WHERE is_attr AND contains(type, 'Brand_1') UNION SELECT type FROM type_attr WHERE contains(attr, 'Brand_1'))"),
    "types_of_attr": (lambda r: c.listing(r.policy_type_attr(), "attr", "type").select("policy_id", "attr", F.array_join("type", ",").alias("types")), "SELECT policy_id, attr, string_agg(type, ',' ORDER BY type) AS types FROM (VALUES ('F'), ('O'), ('P')) AS v(policy_id), type_attr GROUP BY policy_id, attr"),
    "attrs_of_type": (lambda r: c.listing(r.policy_type_attr(), "type", "attr").select("policy_id", "type", F.array_join("attr", ",").alias("attrs")), "SELECT policy_id, type, string_agg(attr, ',' ORDER BY attr) AS attrs FROM (VALUES ('F'), ('O'), ('P')) AS v(policy_id), type_attr GROUP BY policy_id, type"),
    "roles_by_type": (lambda r: c.find_roles(r.role_type.select(F.lit("F").alias("policy_id"), "role").distinct(), r.role_type.withColumn("policy_id", F.lit("F")), type_="s1").select("role"), "SELECT DISTINCT role FROM role_type WHERE type = 's1'"),
    "users_by_role": (lambda r: c.find_users(r.user_role.select(F.lit("F").alias("policy_id"), "user_name").distinct(), r.user_role.withColumn("policy_id", F.lit("F")), role="ASIA_r").select("user_name"), "SELECT DISTINCT user_name FROM user_role WHERE role = 'ASIA_r'"),
    "class_perms": (lambda r: c.listing(r.avrule_perm.select("policy_id", "class", "perm").distinct(), "class", "perm").select("policy_id", "class", F.array_join("perm", ",").alias("perms")), "SELECT policy_id, class, string_agg(DISTINCT perm, ',' ORDER BY perm) AS perms FROM avrule_perm GROUP BY ALL"),
    "policy_stats": (lambda r: c.policy_stats({"rules": r.grouped_rules(), "type_transitions": r.terules, "range_transitions": r.range_trans, "role_allow": r.role_allow, "role_transitions": r.role_trans}), f"SELECT policy_id, 'rules' AS component, count(*) AS n FROM (SELECT DISTINCT {RULE} FROM avrule_perm) GROUP BY 1 UNION ALL SELECT policy_id, 'type_transitions', count(*) FROM terules GROUP BY 1 UNION ALL SELECT policy_id, 'range_transitions', count(*) FROM range_trans GROUP BY 1 UNION ALL SELECT policy_id, 'role_allow', count(*) FROM role_allow GROUP BY 1 UNION ALL SELECT policy_id, 'role_transitions', count(*) FROM role_trans GROUP BY 1"),
    "context_validate": (lambda r: c.context_validate(r.user_role.crossJoin(F.broadcast(r.role_type.select("type").distinct())).withColumn("policy_id", F.lit("F")), r.user_role.withColumn("policy_id", F.lit("F")), r.role_type.withColumn("policy_id", F.lit("F"))).select("user_name", "role", "type", "valid"), "SELECT u.user_name, u.role, t.type, EXISTS (SELECT 1 FROM role_type AS x WHERE x.role = u.role AND x.type = t.type) AS valid FROM user_role AS u CROSS JOIN (SELECT DISTINCT type FROM role_type) AS t"),
    "av_search": (lambda r: av(r, RuleSearch(["allow", "auditallow"], source="s7", target="Brand_12", target_indirect=True, classes=["file"], perms=["read", "write"])), f"SELECT {RULE}, {ALL} FROM avrule_perm WHERE kind IN ('allow', 'auditallow') AND source = 's7' AND (target = 'Brand_12' OR target IN (SELECT type FROM type_attr WHERE attr = 'Brand_12')) AND class = 'file' GROUP BY {RULE} HAVING bool_or(perm IN ('read', 'write'))"),
    "av_search_allperms": (lambda r: av(r, RuleSearch(["allow"], source="^s1", perms=["read", "getattr"], all_perms=True, regex=True)), f"SELECT {RULE}, {ALL} FROM avrule_perm WHERE kind = 'allow' AND regexp_matches(source, '^s1') GROUP BY {RULE} HAVING bool_or(perm = 'read') AND bool_or(perm = 'getattr')"),
    "av_source_any": (lambda r: av(r, RuleSearch(source="p11", source_as_any=True, source_indirect=True)), f"SELECT {RULE}, {ALL} FROM avrule_perm WHERE source IN (SELECT 'p11' UNION SELECT attr FROM type_attr WHERE type = 'p11') OR target IN (SELECT 'p11' UNION SELECT attr FROM type_attr WHERE type = 'p11') GROUP BY {RULE}"),
    "te_search": (lambda r: ru.find_terules(r.terules.withColumn("enabled", F.lit(True)), RuleSearch(["type_transition"], source="n5", source_indirect=True), r.policy_types(), r.policy_type_attr()).select("policy_id", "source", "target", "default_type"), "SELECT policy_id, source, target, default_type FROM terules WHERE source IN (SELECT type FROM type_attr WHERE attr = 'n5')"),
    "role_allow_search": (lambda r: ru.find_role_allow(r.role_allow, "ASIA_r", source_as_any=True), "SELECT * FROM role_allow WHERE source = 'ASIA_r' OR target = 'ASIA_r'"),
    "role_trans_search": (lambda r: ru.find_role_trans(r.role_trans, "ASIA_r", "p1", regex=True, source_as_any=True), "SELECT * FROM role_trans WHERE contains(target_type, 'p1') AND (source = 'ASIA_r' OR default_role = 'ASIA_r')"),
    "range_trans_exact": (lambda r: find_ranges(r, 1, 2, "exact"), "SELECT policy_id, source, target, low_rank, high_rank FROM range_trans WHERE low_rank = 1 AND high_rank = 2"),
    "range_trans_sub": (lambda r: find_ranges(r, 1, 1, "sub"), "SELECT policy_id, source, target, low_rank, high_rank FROM range_trans WHERE low_rank <= 1 AND high_rank >= 1"),
    "range_trans_super": (lambda r: find_ranges(r, 1, 4, "super"), "SELECT policy_id, source, target, low_rank, high_rank FROM range_trans WHERE low_rank >= 1 AND high_rank <= 4"),
    "range_trans_intersect": (lambda r: find_ranges(r, 2, 3, "intersect"), "SELECT policy_id, source, target, low_rank, high_rank FROM range_trans WHERE low_rank <= 3 AND high_rank >= 2"),
    "cond_eval": (lambda r: ru.eval_conditionals(conds(r), r.bools).select("policy_id", "cond_id", "truth"), "SELECT c.policy_id, c.cond_id, CASE c.op WHEN '&&' THEN coalesce(a.state, false) AND NOT coalesce(b.state, false) WHEN '||' THEN coalesce(a.state, false) OR NOT coalesce(b.state, false) ELSE coalesce(a.state, false) <> (NOT coalesce(b.state, false)) END AS truth FROM conds AS c LEFT JOIN bools AS a ON c.policy_id = a.policy_id AND c.bool_a = a.bool LEFT JOIN bools AS b ON c.policy_id = b.policy_id AND c.bool_b = b.bool"),
    "cond_rules_enabled": (conditional_rules, "SELECT r.policy_id, coalesce(t.truth = (r.class = 'file'), false) AS enabled, count(*) AS n FROM (SELECT DISTINCT policy_id, kind, source, target, class, (ascii(right(source, 1)) + length(target)) % 12 AS cond_id FROM avrule_perm) AS r LEFT JOIN (SELECT c.policy_id, c.cond_id, CASE c.op WHEN '&&' THEN x AND NOT y WHEN '||' THEN x OR NOT y ELSE x <> (NOT y) END AS truth FROM (SELECT c.*, c.bool_a <> 'b2' AND coalesce(a.state, false) AS x, c.bool_b <> 'b2' AND coalesce(b.state, false) AS y FROM conds AS c LEFT JOIN bools AS a ON c.policy_id = a.policy_id AND c.bool_a = a.bool LEFT JOIN bools AS b ON c.policy_id = b.policy_id AND c.bool_b = b.bool) AS c) AS t ON r.policy_id = t.policy_id AND r.cond_id = t.cond_id GROUP BY 1, 2"),
    "rules_expand": (lambda r: flat(ru.expand_rules(r.grouped_rules(), r.policy_type_attr())), f"SELECT policy_id, kind, source, target, class, string_agg(perm, ',' ORDER BY perm) AS perms FROM (SELECT DISTINCT v.policy_id, v.kind, v.source, coalesce(t.type, v.target) AS target, v.class, v.perm FROM avrule_perm AS v LEFT JOIN type_attr AS t ON v.target = t.attr) GROUP BY {RULE}"),
    "rules_rendered": (lambda r: ru.render_avrule(r.grouped_rules()).select("policy_id", "text"), f"SELECT policy_id, kind || ' ' || source || ' ' || target || ' : ' || class || ' ' || CASE WHEN count(*) = 1 THEN any_value(perm) ELSE '{{ ' || string_agg(perm, ' ' ORDER BY perm) || ' }}' END || ';' AS text FROM avrule_perm GROUP BY {RULE}"),
    "written_rules": (written, f"SELECT policy_id, kind, source, target, class, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS lines FROM (SELECT DISTINCT {RULE}, ascii(perm) % 17 AS n FROM avrule_perm) GROUP BY {RULE}"),
    "mls_compare": (mls_pairs, "SELECT low_rank, high_rank, CASE WHEN low_rank = high_rank AND a = b THEN 'eq' WHEN low_rank >= high_rank AND a >= b THEN 'dom' WHEN low_rank <= high_rank AND a <= b THEN 'domby' ELSE 'incomp' END AS relation FROM (SELECT DISTINCT low_rank, high_rank, low_rank AS a, high_rank % 3 AS b FROM range_trans)"),
    "port_range_join": (lambda r: net.port_matches(r.audit, "port", r.portcon).select("msg_id", "port", "type"), "SELECT msg_id, port, type FROM audit JOIN portcon ON port BETWEEN low AND high"),
}
