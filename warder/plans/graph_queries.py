"""Registered queries over flows, transitions, relabelling and type relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warder.operators import flow, relabel, transitions
from warder.plans.fixtures import Relations

EDGES = """edge AS (
  SELECT policy_id, src, src_side, dst, dst_side, max(length) AS length FROM (
    SELECT v.policy_id, CASE m.direction WHEN 'r' THEN coalesce(t.type, v.target) ELSE v.source END AS src, CASE m.direction WHEN 'r' THEN 'object' ELSE 'subject' END AS src_side,
      CASE m.direction WHEN 'r' THEN v.source ELSE coalesce(t.type, v.target) END AS dst, CASE m.direction WHEN 'r' THEN 'subject' ELSE 'object' END AS dst_side, v.length FROM (
      SELECT policy_id, source, target, a.class, direction, min(greatest(1, least(10, 11 - weight))) AS length FROM avrule_perm AS a JOIN perm_map AS p ON a.class = p.class AND a.perm = p.perm
      WHERE kind = 'allow' AND direction IN ('r', 'w') GROUP BY ALL) AS v JOIN (VALUES ('r'), ('w')) AS m(direction) ON v.direction = m.direction LEFT JOIN type_attr AS t ON v.target = t.attr)
  GROUP BY ALL)"""


def edges(r: Relations, **more) -> DataFrame:
    return flow.flow_edges(r.grouped_rules(), r.perm_map, r.policy_type_attr(), **more)


def domains(r: Relations) -> DataFrame:
    """All types that are the source or target of a transition."""
    t = r.dom_edge.filter("edge = 'transition'")
    return t.select("policy_id", F.explode(F.array("source", "target")).alias("type")).distinct()


def some(r: Relations, *names: str) -> DataFrame:
    return r.spark.createDataFrame([(p, n) for p in "FOP" for n in names], "policy_id string, type string")


def paths(found: DataFrame) -> DataFrame:
    return found.select("policy_id", "start", "end", "length")


def domain_rules(r: Relations) -> tuple[DataFrame, DataFrame]:
    """The domain edges as access rules, and type rules that turn executed files into domains."""
    e = r.dom_edge
    kind = F.when(F.col("edge") == "transition", "process").otherwise("file")
    rules = e.select("policy_id", F.xxhash64("edge", "source", "target", "policy_id").alias("rule_id"), F.lit("allow").alias("kind"), "source", "target", kind.alias("class"), F.array("edge").alias("perms"), F.lit(True).alias("enabled"))
    change = r.terules.select("policy_id", "kind", "source", "target", "class", "default_type", F.xxhash64("source", "target", "policy_id").alias("rule_id"), F.lit(True).alias("enabled"))
    return rules, change


def domain_edges(r: Relations) -> dict[str, DataFrame]:
    return transitions.edge_tables(*domain_rules(r), r.policy_type_attr())


ASKED = [("s3", "s4"), ("p7", "s4"), ("s3", "p9")]


def asked_flows(r: Relations) -> DataFrame:
    policies = r.avrule_perm.select("policy_id").distinct()
    return policies.select("policy_id", F.inline(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ASKED])))


#: All simple paths that are no longer than the third best of at most three steps, hence the three best of all.
ALTERNATIVES = f""", {EDGES}, asked(start, "end") AS (VALUES {", ".join(map(str, ASKED))}),
 few AS (SELECT policy_id, start, "end", a.length FROM edge AS a JOIN asked ON src = start AND dst = "end"
  UNION ALL SELECT a.policy_id, start, "end", a.length + b.length FROM asked JOIN edge AS a ON a.src = start JOIN edge AS b ON b.policy_id = a.policy_id AND b.src = a.dst AND b.src_side = a.dst_side AND b.dst = "end" WHERE a.dst <> "end"
  UNION ALL SELECT a.policy_id, start, "end", a.length + b.length + c.length FROM asked JOIN edge AS a ON a.src = start JOIN edge AS b ON b.policy_id = a.policy_id AND b.src = a.dst AND b.src_side = a.dst_side
   JOIN edge AS c ON c.policy_id = b.policy_id AND c.src = b.dst AND c.src_side = b.dst_side AND c.dst = "end" WHERE a.dst <> "end" AND b.dst <> "end" AND b.dst <> start),
 bound AS (SELECT policy_id, start, "end", max(length) AS most FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, start, "end" ORDER BY length) AS n FROM few) WHERE n <= 3 GROUP BY ALL),
 walk(policy_id, start, "end", node, side, path, length, most) AS (
  SELECT policy_id, start, "end", start, side, [start || '/' || side], 0, most FROM bound, (VALUES ('subject'), ('object')) AS v(side)
  UNION ALL SELECT w.policy_id, w.start, w."end", e.dst, e.dst_side, list_append(path, e.dst || '/' || e.dst_side), w.length + e.length, most FROM walk AS w
   JOIN edge AS e ON e.policy_id = w.policy_id AND e.src = w.node AND e.src_side = w.side WHERE w.node <> w."end" AND w.length + e.length <= most AND NOT list_contains(path, e.dst || '/' || e.dst_side))
 SELECT policy_id, start, "end", length, row_number() OVER (PARTITION BY policy_id, start, "end" ORDER BY length) AS rank FROM walk WHERE node = "end" QUALIFY rank <= 3"""


def triples(found: DataFrame) -> DataFrame:
    return found.select("policy_id", "start", "ep", "end")


WHOLE = """whole AS (
  SELECT t.policy_id, t.source AS start, e.target AS ep, t.target AS "end", x.source IS NOT NULL AS runs FROM dom_edge AS t
  JOIN dom_edge AS e ON e.policy_id = t.policy_id AND e.edge = 'entrypoint' AND e.source = t.target
  LEFT JOIN dom_edge AS x ON x.policy_id = t.policy_id AND x.edge = 'execute' AND x.source = t.source AND x.target = e.target WHERE t.edge = 'transition')"""
RIGHTS = "rights AS (SELECT DISTINCT policy_id, source AS subject, class, coalesce(t.type, target) AS target, perm FROM avrule_perm LEFT JOIN type_attr AS t ON target = t.attr WHERE kind = 'allow' AND perm IN ('relabelfrom', 'relabelto'))"
POOL = "pool AS (SELECT DISTINCT policy_id, source, coalesce(t.type, target) AS target FROM avrule_perm LEFT JOIN type_attr AS t ON target = t.attr WHERE kind = 'allow' AND source IN ('s1', 's2'))"


def access(r: Relations) -> DataFrame:
    found = transitions.domain_transitions(domain_edges(r), domains(r), which="both", needs_change=False)
    kept = transitions.filter_access(found.filter("valid"), r.grouped_rules(), r.policy_types(), r.policy_type_attr(), "p5", ["file", "dir"], ["write"])
    return triples(kept)


def verify(r: Relations) -> DataFrame:
    asked = r.terules.select("policy_id", F.col("source").alias("start"), F.col("target").alias("ep"), F.col("default_type").alias("end"))
    found = transitions.verify_transitions(domain_edges(r), asked)
    return found.groupBy("policy_id", F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


def pools(r: Relations) -> DataFrame:
    return relabel.access_pools(r.grouped_rules(), r.policy_type_attr(), "s1", "s2")


def rights(r: Relations) -> DataFrame:
    return relabel.relabel_rights(r.grouped_rules(), r.policy_type_attr())


QUERIES = {
    "flow_edges": (lambda r: edges(r).select("policy_id", "src", "src_side", "dst", "dst_side", "length"), f", {EDGES} SELECT * FROM edge"),
    "flow_edges_strong": (lambda r: edges(r, min_weight=10, intermediates=some(r, *[f"s{i}" for i in range(10)], *[f"p{i}" for i in range(20)])).groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")), """, kept AS (SELECT v.* FROM avrule_perm AS v WHERE kind = 'allow' AND perm IN ('read', 'write') AND source IN (SELECT 's' || i FROM range(10) AS t(i)) AND (target IN (SELECT 'p' || i FROM range(20) AS t(i)) OR target IN (SELECT attr FROM type_attr WHERE type IN (SELECT 'p' || i FROM range(20) AS t(i)))))
 SELECT policy_id, count(*) AS n, count(*) AS total FROM (SELECT DISTINCT policy_id, source, coalesce(t.type, target) AS target, perm FROM kept LEFT JOIN type_attr AS t ON target = t.attr) GROUP BY 1"""),
    "flow_direct": (lambda r: flow.direct_flows(edges(r), some(r, "s3")).select("policy_id", "start", "end", "direction", "length"), f", {EDGES} SELECT policy_id, 's3' AS start, o AS \"end\", bit_or(way) AS direction, min(length) AS length FROM (SELECT policy_id, dst AS o, 2 AS way, length FROM edge WHERE src = 's3' UNION ALL SELECT policy_id, src, 1, length FROM edge WHERE dst = 's3') GROUP BY ALL"),
    "flow_both": (lambda r: flow.direct_flows(edges(r), some(r, "s3"), "both").select("policy_id", "start", "end", "length"), f", {EDGES} SELECT policy_id, 's3' AS start, o AS \"end\", min(length) AS length FROM (SELECT policy_id, dst AS o, 2 AS way, length FROM edge WHERE src = 's3' UNION ALL SELECT policy_id, src, 1, length FROM edge WHERE dst = 's3') GROUP BY ALL HAVING bit_or(way) = 3"),
    "flow_transitive": (
        lambda r: paths(flow.transitive_flows(edges(r), some(r, "s3", "p7"), "out")),
        f""", {EDGES}, walk(policy_id, start, node, side, dist) USING KEY (policy_id, start, node, side) AS (
 SELECT p, s, s, side, 0 FROM (VALUES ('F'), ('O'), ('P')) AS a(p), (VALUES ('s3'), ('p7')) AS b(s), (VALUES ('subject'), ('object')) AS c(side)
 UNION SELECT w.policy_id, w.start, e.dst, e.dst_side, min(w.dist + e.length) FROM walk AS w JOIN edge AS e ON e.policy_id = w.policy_id AND e.src = w.node AND e.src_side = w.side
 LEFT JOIN recurring.walk AS r ON r.policy_id = w.policy_id AND r.start = w.start AND r.node = e.dst AND r.side = e.dst_side WHERE r.dist IS NULL OR w.dist + e.length < r.dist GROUP BY ALL)
 SELECT policy_id, start, node AS "end", min(dist) AS length FROM walk WHERE node <> start GROUP BY ALL""",
    ),
    "flow_alternatives": (lambda r: flow.flow_alternatives(edges(r), asked_flows(r), 3).select("policy_id", "start", "end", "length", "rank"), ALTERNATIVES),
    "domtrans_forward": (lambda r: triples(transitions.domain_transitions(domain_edges(r), domains(r), True, "valid", False)), f", {WHOLE} SELECT policy_id, start, ep, \"end\" FROM whole WHERE runs"),
    "domtrans_reverse": (lambda r: triples(transitions.domain_transitions(domain_edges(r), domains(r), False, "valid", False)), f", {WHOLE} SELECT policy_id, start, ep, \"end\" FROM whole WHERE runs"),
    "domtrans_invalid": (
        lambda r: triples(transitions.domain_transitions(domain_edges(r), domains(r), True, "invalid", True)),
        f""", {WHOLE}, rows_ AS (SELECT policy_id, start, ep, "end" FROM whole UNION SELECT t.policy_id, t.source, NULL, t.target FROM dom_edge AS t WHERE t.edge = 'transition' AND NOT EXISTS (SELECT 1 FROM dom_edge AS e WHERE e.policy_id = t.policy_id AND e.edge = 'entrypoint' AND e.source = t.target)
 UNION SELECT c.policy_id, c.source, c.target, c.default_type FROM terules AS c JOIN dom_edge AS t ON t.policy_id = c.policy_id AND t.edge = 'transition' AND t.source = c.source AND t.target = c.default_type)
 SELECT * FROM rows_ AS x WHERE NOT (EXISTS (SELECT 1 FROM whole AS w WHERE w.runs AND w.policy_id = x.policy_id AND w.start = x.start AND w.ep = x.ep AND w."end" = x."end") AND EXISTS (SELECT 1 FROM terules AS c WHERE c.policy_id = x.policy_id AND c.source = x.start AND c.target = x.ep AND c.default_type = x."end"))""",
    ),
    "domtrans_access": (access, f", {WHOLE} SELECT policy_id, start, ep, \"end\" FROM whole AS w WHERE runs AND EXISTS (SELECT 1 FROM avrule_perm AS a WHERE a.policy_id = w.policy_id AND a.kind = 'allow' AND a.perm = 'write' AND a.source = w.\"end\" AND a.target IN (SELECT 'p5' UNION SELECT attr FROM type_attr WHERE type = 'p5'))"),
    "domtrans_verify": (
        verify,
        """ SELECT policy_id, concat_ws(',', CASE WHEN NOT t THEN 'transition' END, CASE WHEN NOT e THEN 'entrypoint' END, CASE WHEN NOT x THEN 'execute' END) AS missing, count(*) AS n FROM (
 SELECT c.policy_id, EXISTS (SELECT 1 FROM dom_edge AS d WHERE d.policy_id = c.policy_id AND d.edge = 'transition' AND d.source = c.source AND d.target = c.default_type) AS t,
 EXISTS (SELECT 1 FROM dom_edge AS d WHERE d.policy_id = c.policy_id AND d.edge = 'entrypoint' AND d.source = c.default_type AND d.target = c.target) AS e,
 EXISTS (SELECT 1 FROM dom_edge AS d WHERE d.policy_id = c.policy_id AND d.edge = 'execute' AND d.source = c.source AND d.target = c.target) AS x FROM terules AS c) GROUP BY 1, 2""",
    ),
    "domtrans_orphans": (
        lambda r: triples(transitions.orphan_type_transitions(domain_edges(r))),
        """ SELECT c.policy_id, c.source AS start, c.target AS ep, c.default_type AS "end" FROM terules AS c WHERE NOT EXISTS (SELECT 1 FROM dom_edge AS t WHERE t.policy_id = c.policy_id AND t.edge = 'transition' AND t.source = c.source AND t.target = c.default_type)""",
    ),
    "relabel_object": (lambda r: relabel.relabel_object(rights(r), some(r, "p7")), f", {RIGHTS} SELECT policy_id, 'p7' AS start, subject, class, target AS \"end\", CASE WHEN t AND f THEN 'both' WHEN t THEN 'to' ELSE 'from' END AS direction FROM (SELECT b.policy_id, b.subject, b.class, b.target, coalesce(bool_or(a.perm = 'relabelfrom' AND b.perm = 'relabelto'), false) AS t, coalesce(bool_or(a.perm = 'relabelto' AND b.perm = 'relabelfrom'), false) AS f FROM rights AS a JOIN rights AS b ON a.policy_id = b.policy_id AND a.subject = b.subject AND a.class = b.class WHERE a.target = 'p7' AND b.target <> 'p7' GROUP BY ALL) WHERE t OR f"),
    "relabel_subject": (lambda r: relabel.relabel_subject(rights(r), "s9"), f", {RIGHTS} SELECT policy_id, target AS type, CASE WHEN count(DISTINCT perm) = 2 THEN 'both' WHEN min(perm) = 'relabelto' THEN 'to' ELSE 'from' END AS direction FROM rights WHERE subject = 's9' GROUP BY ALL"),
    "relation_common": (lambda r: relabel.common(r.policy_type_attr(), "type", "attr", "p1", "p2"), "SELECT policy_id, attr FROM (VALUES ('F'), ('O'), ('P')) AS v(policy_id), (SELECT attr FROM type_attr WHERE type = 'p1' INTERSECT SELECT attr FROM type_attr WHERE type = 'p2')"),
    "relation_similar": (lambda r: relabel.similar(pools(r)).select("policy_id", "target"), f", {POOL} SELECT policy_id, target FROM pool GROUP BY ALL HAVING count(DISTINCT source) = 2"),
    "relation_dissimilar": (lambda r: relabel.dissimilar(pools(r)).select("policy_id", "target", "side"), f", {POOL} SELECT policy_id, target, CASE min(source) WHEN 's1' THEN 'a' ELSE 'b' END AS side FROM pool GROUP BY policy_id, target HAVING count(DISTINCT source) = 1"),
    "relation_rules": (lambda r: relabel.rules_between(r.grouped_rules(), r.policy_type_attr(), "s5", "p9").select("policy_id", "source", "target", "class", F.array_join("perms", ",").alias("perms")), "SELECT policy_id, source, target, class, string_agg(perm, ',' ORDER BY perm) AS perms FROM avrule_perm WHERE kind = 'allow' AND source = 's5' AND target IN (SELECT 'p9' UNION SELECT attr FROM type_attr WHERE type = 'p9') GROUP BY policy_id, source, target, class"),
    "relation_terules": (lambda r: relabel.terules_between(r.terules, "s5", "p105").select("policy_id", "source", "target", "default_type"), "SELECT policy_id, source, target, default_type FROM terules WHERE source = 's5' AND target = 'p105'"),
    "relation_flows": (lambda r: relabel.flows_between(edges(r), some(r, "s5"), "p9").select("policy_id", "direction", "length"), f", {EDGES} SELECT policy_id, bit_or(way) AS direction, min(length) AS length FROM (SELECT policy_id, 2 AS way, length FROM edge WHERE src = 's5' AND dst = 'p9' UNION ALL SELECT policy_id, 1, length FROM edge WHERE dst = 's5' AND src = 'p9') GROUP BY 1"),
}
