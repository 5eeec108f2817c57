"""Registered queries over policy checks and file labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warder.functions import mls
from warder.operators import checks, labels
from warder.operators.labels import LabelSearch
from warder.plans.fixtures import Relations
from warder.plans.graph_queries import domain_rules

OPTIONS = {"domain_attribute": "n5", "file_attribute": "Brand_11", "net_classes": ["dir"], "needs_change": False}


def every(r: Relations, df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(r.spark.sql("SELECT explode(array('F', 'O', 'P')) AS policy_id")))


def tables(r: Relations) -> dict[str, DataFrame]:
    """Policy tables with some gaps for the checks to find."""
    level = lambda c: mls.level(F.lit("s"), F.col(c).cast("int"), F.array(F.lit("c0")))
    extra = r.spark.createDataFrame([(p, f"lonely_{k}", k == "attr", False, []) for p in "FOP" for k in ("attr", "type")], "policy_id string, type string, is_attr boolean, is_permissive boolean, aliases array<string>").select("policy_id", "type", "is_attr", "aliases")
    roles = r.role_type.select("role").distinct().unionByName(r.spark.createDataFrame([("empty_r",), ("object_r",)], "role string"))
    users = every(r, r.user_role.select("user_name").distinct().unionByName(r.spark.createDataFrame([("idle_u",)], "user_name string")))
    users = users.withColumn("range", mls.level_range(mls.level(F.lit("s"), F.lit(0), F.array(F.lit("c0"))), mls.level(F.lit("s"), F.lit(4), F.array(F.lit("c0")))))
    ranges = r.range_trans.withColumn("range", mls.level_range(level("low_rank"), level("high_rank")))
    return {
        "types": r.policy_types().unionByName(extra),
        "type_attr": r.policy_type_attr(),
        "rules": r.grouped_rules(),
        "terules": r.terules.withColumns({"enabled": F.lit(True), "rule_id": F.xxhash64("policy_id", "source", "target")}),
        "roles": every(r, roles),
        "role_type": every(r, r.role_type),
        "users": users,
        "user_role": every(r, r.user_role),
        "role_allow": r.role_allow.filter("source <> 'AFRICA_r' AND target <> 'AFRICA_r'"),
        "role_trans": r.role_trans,
        "range_trans": ranges,
        "isids": r.isids,
        "portcon": every(r, r.portcon),
        "nodecon": r.nodecon,
        "netifcon": r.netifcon,
    }


def net_rules(r: Relations) -> DataFrame:
    """Rules told as network rules; those on a directory type that ends in 1 are on the domain itself."""
    is_dir = F.col("class") == "dir"
    perms = F.transform("perms", lambda p: F.when(p == "append", "tcp_send").otherwise(p))
    target = F.when(is_dir & F.col("target").endswith("1"), F.col("source")).otherwise(F.col("target"))
    return r.grouped_rules().withColumns({"perms": perms, "target": target, "class": F.when(is_dir, "tcp_socket").otherwise("netif")})


def domain_tables(r: Relations) -> dict[str, DataFrame]:
    rules, change = domain_rules(r)
    return tables(r) | {"rules": rules, "terules": change}


def mixed_tables(r: Relations) -> dict[str, DataFrame]:
    """Some object types have the attribute of domains too, and some domains are in no role."""
    found = tables(r)
    both = every(r, r.type_attr.filter("type LIKE 'p%7'").select("type").distinct().withColumn("attr", F.lit("n5")))
    return found | {"type_attr": found["type_attr"].unionByName(both.select(*found["type_attr"].columns)).distinct(), "role_type": found["role_type"].filter("type NOT LIKE '%3'")}


def items(name: str, of=tables):
    def run(r: Relations) -> DataFrame:
        return checks.run_checks(of(r), [name], OPTIONS).select("policy_id", "item").distinct()

    return run


def proofs(name: str, of=tables):
    def run(r: Relations) -> DataFrame:
        return checks.run_checks(of(r), [name], OPTIONS).select("policy_id", "item", "proof_text", "element")

    return run


IDS = "(VALUES ('F'), ('O'), ('P')) AS ids(policy_id)"


def each(sql: str) -> str:
    return f"SELECT policy_id, item FROM {IDS}, ({sql})"


DOMAINS = """SELECT policy_id, type AS item FROM (VALUES ('F'), ('O'), ('P')) AS ids(policy_id), (SELECT type FROM type_attr WHERE attr = 'n5' UNION SELECT type FROM role_type) UNION SELECT DISTINCT policy_id, source FROM avrule_perm UNION SELECT policy_id, default_type FROM terules"""
#: With the changes of mixed_tables.
MIXED = DOMAINS.replace("FROM role_type", "FROM role_type WHERE type NOT LIKE '%3'").replace("WHERE attr = 'n5'", "WHERE attr = 'n5' OR type LIKE 'p%7'")
FILES = """SELECT policy_id, type AS item FROM (VALUES ('F'), ('O'), ('P')) AS ids(policy_id), (SELECT type FROM type_attr WHERE attr = 'Brand_11')"""
SID = "SELECT policy_id, type AS item FROM isids WHERE name = '{}'"
NETIFS = SID.format("netif") + " UNION SELECT policy_id, if_type FROM netifcon UNION SELECT policy_id, msg_type FROM netifcon"
NODES = SID.format("node") + " UNION SELECT policy_id, type FROM nodecon"
PORTS = SID.format("port") + " UNION SELECT policy_id, type FROM (VALUES ('F'), ('O'), ('P')) AS ids(policy_id), portcon"
AUDIT = "SELECT policy_id, source, coalesce(t.type, target) AS target, class, perm, bool_or(kind = 'allow') AS a, bool_or(kind = 'auditallow') AS u, bool_or(kind = 'dontaudit') AS d FROM avrule_perm LEFT JOIN type_attr AS t ON target = t.attr GROUP BY ALL"
STEPS = """steps AS (SELECT t.policy_id, t.source AS start, e.target AS ep, t.target AS "end", x.source IS NOT NULL AS runs FROM dom_edge AS t LEFT JOIN dom_edge AS e ON e.policy_id = t.policy_id AND e.edge = 'entrypoint' AND e.source = t.target
 LEFT JOIN dom_edge AS x ON x.policy_id = t.policy_id AND x.edge = 'execute' AND x.source = t.source AND x.target = e.target WHERE t.edge = 'transition'
 UNION SELECT c.policy_id, c.source, c.target, c.default_type, x.source IS NOT NULL AND e.source IS NOT NULL FROM terules AS c JOIN dom_edge AS t ON t.policy_id = c.policy_id AND t.edge = 'transition' AND t.source = c.source AND t.target = c.default_type
 LEFT JOIN dom_edge AS e ON e.policy_id = c.policy_id AND e.edge = 'entrypoint' AND e.source = c.default_type AND e.target = c.target LEFT JOIN dom_edge AS x ON x.policy_id = c.policy_id AND x.edge = 'execute' AND x.source = c.source AND x.target = c.target)"""
WAYS = """ways AS (SELECT s.*, s.runs AND (EXISTS (SELECT 1 FROM role_type AS a JOIN role_type AS b ON a.role = b.role JOIN user_role AS u ON u.role = a.role WHERE a.type = s.start AND b.type = s."end")
 OR EXISTS (SELECT 1 FROM role_trans AS c JOIN role_allow AS w ON w.policy_id = c.policy_id AND w.source = c.source AND w.target = c.default_role JOIN user_role AS u ON u.role = c.source JOIN user_role AS v ON v.role = c.default_role AND v.user_name = u.user_name
   JOIN role_type AS a ON a.role = c.source AND a.type = s.start JOIN role_type AS b ON b.role = c.default_role AND b.type = s."end" WHERE c.policy_id = s.policy_id AND c.target_type = s.ep AND w.source <> 'AFRICA_r' AND w.target <> 'AFRICA_r')) AS good FROM steps AS s)"""


def index_query(r: Relations) -> DataFrame:
    index = labels.build_label_index(r.file_labels)
    return labels.query_label_index(index, LabelSearch(type="^p1", path="/[a-m]", regex=True, dev="dev1")).select("host", "path", "inode", "type")


def index_sizes(r: Relations) -> DataFrame:
    index = labels.build_label_index(r.file_labels)
    parts = [index[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("relation"), "n") for n in (*labels.DIMENSIONS, "paths")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expected(r: Relations) -> DataFrame:
    return labels.expected_labels(r.file_labels, r.label_specs).select("host", "path", "inode", "line_no", "expected", "mismatch")


def spec_match(r: Relations) -> DataFrame:
    rows = r.label_specs.withColumn("origin", F.lit("main"))
    return labels.query_label_specs(rows, LabelSearch(user="system_u", path="/en/x", obj_class="file")).select("line_no", "type").join(r.file_labels.groupBy("type").agg(F.count(F.lit(1)).alias("files")), "type", "left").select("line_no", "type", F.coalesce("files", F.lit(0)).alias("files"))


MATCH = "m AS (SELECT f.*, s.line_no, s.context FROM file_labels AS f JOIN label_specs AS s ON regexp_full_match(f.path, s.path_regex) AND (s.kind IS NULL OR s.kind = '--'))"

QUERIES = {
    "check_find_domains": (items("find_domains"), DOMAINS),
    "check_find_file_types": (items("find_file_types"), FILES),
    "check_find_net_domains": (items("find_net_domains"), "SELECT DISTINCT policy_id, source AS item FROM avrule_perm WHERE kind = 'allow' AND class = 'dir'"),
    "check_find_assoc_types": (items("find_assoc_types"), SID.format("unlabeled")),
    "check_find_netif_types": (items("find_netif_types"), NETIFS),
    "check_find_node_types": (items("find_node_types"), NODES),
    "check_find_port_types": (items("find_port_types"), PORTS),
    "check_domain_and_file": (items("domain_and_file", mixed_tables), f"SELECT * FROM ({MIXED}) INTERSECT SELECT * FROM ({FILES})"),
    "check_domains_wo_roles": (items("domains_wo_roles", mixed_tables), f"SELECT * FROM ({MIXED}) WHERE item NOT IN (SELECT type FROM role_type WHERE type NOT LIKE '%3')"),
    "check_attribs_wo_types": (items("attribs_wo_types"), each("SELECT 'lonely_attr' AS item")),
    "check_attribs_wo_rules": (items("attribs_wo_rules"), f"SELECT policy_id, item FROM {IDS}, (SELECT type AS item FROM types WHERE is_attr UNION SELECT 'lonely_attr') WHERE NOT EXISTS (SELECT 1 FROM avrule_perm AS a WHERE a.policy_id = ids.policy_id AND (a.target = item OR a.source = item))"),
    "check_types_wo_allow": (items("types_wo_allow"), f"SELECT policy_id, item FROM {IDS}, (SELECT type AS item FROM types WHERE NOT is_attr UNION SELECT 'lonely_type') WHERE NOT EXISTS (SELECT 1 FROM avrule_perm AS a LEFT JOIN type_attr AS t ON a.target = t.attr WHERE a.kind = 'allow' AND a.policy_id = ids.policy_id AND (a.source = item OR coalesce(t.type, a.target) = item))"),
    "check_roles_wo_allow": (items("roles_wo_allow"), f"SELECT policy_id, item FROM {IDS}, (SELECT DISTINCT role AS item FROM role_type UNION SELECT 'empty_r') WHERE NOT EXISTS (SELECT 1 FROM role_allow AS a WHERE a.policy_id = ids.policy_id AND a.source <> 'AFRICA_r' AND a.target <> 'AFRICA_r' AND (a.source = item OR a.target = item))"),
    "check_roles_wo_types": (items("roles_wo_types"), each("SELECT 'empty_r' AS item")),
    "check_roles_wo_users": (items("roles_wo_users"), each("SELECT role AS item FROM (SELECT role FROM role_type UNION SELECT 'empty_r') WHERE role NOT IN (SELECT role FROM user_role)")),
    "check_users_wo_roles": (items("users_wo_roles"), each("SELECT 'idle_u' AS item")),
    "check_spurious_audit": (proofs("spurious_audit"), f"SELECT policy_id, source || ' ' || target || ' ' || class AS item, 'allowed but not to be audited' AS proof_text, perm AS element FROM ({AUDIT}) WHERE d AND a UNION ALL SELECT policy_id, source || ' ' || target || ' ' || class, 'audited but not allowed', perm FROM ({AUDIT}) WHERE u AND NOT a"),
    "check_inc_mount": (
        lambda r: checks.run_checks(tables(r) | {"rules": r.grouped_rules().withColumns({"perms": F.transform("perms", lambda p: F.when(p == "read", "mount").when(p == "write", "mounton").otherwise(p)), "class": F.when(F.col("class") == "file", "filesystem").otherwise("dir")})}, ["inc_mount"], OPTIONS).select("policy_id", "item", "proof_text", "element"),
        "SELECT policy_id, source AS item, CASE WHEN m THEN 'lacks dir mounton' ELSE 'lacks filesystem mount' END AS proof_text, target AS element FROM (SELECT policy_id, source, coalesce(t.type, target) AS target, bool_or(class = 'file' AND perm = 'read') AS m, bool_or(class = 'dir' AND perm = 'write') AS n FROM avrule_perm LEFT JOIN type_attr AS t ON target = t.attr WHERE kind = 'allow' GROUP BY ALL) WHERE m <> n",
    ),
    "check_inc_net_access": (
        lambda r: checks.run_checks(tables(r) | {"rules": net_rules(r)}, ["inc_net_access"], OPTIONS).select("policy_id", "item", "proof_text", "element"),
        f""", need AS (SELECT * FROM (VALUES ('self', 'sock_file', 'read'), ('self', 'sock_file', 'write'), ('self', 'sock_file', 'getattr'), ('self', 'tcp_socket', 'read'), ('self', 'tcp_socket', 'write'), ('self', 'tcp_socket', 'create'), ('netif', 'netif', 'tcp_send'), ('netif', 'netif', 'tcp_recv'), ('node', 'node', 'tcp_send'), ('node', 'node', 'tcp_recv'), ('port', 'tcp_socket', 'send_msg'), ('port', 'tcp_socket', 'recv_msg'), ('assoc', 'association', 'sendto'), ('assoc', 'association', 'recvfrom')) AS v(place, c, p)),
 places AS (SELECT 'netif' AS place, * FROM ({NETIFS}) UNION ALL SELECT 'node', * FROM ({NODES}) UNION ALL SELECT 'port', * FROM ({PORTS}) UNION ALL SELECT 'assoc', * FROM ({SID.format("unlabeled")})),
 wide AS (SELECT DISTINCT x.policy_id, x.source, coalesce(t.type, x.target) AS target, c, p FROM (SELECT policy_id, source, CASE WHEN class = 'dir' AND target LIKE '%1' THEN source ELSE target END AS target, CASE class WHEN 'file' THEN 'netif' ELSE 'tcp_socket' END AS c, CASE perm WHEN 'append' THEN 'tcp_send' ELSE perm END AS p FROM avrule_perm WHERE kind = 'allow') AS x LEFT JOIN type_attr AS t ON x.target = t.attr),
 has AS (SELECT DISTINCT w.policy_id, w.source, n.place, n.c, n.p FROM (SELECT policy_id, source, 'self' AS place, c, p FROM wide WHERE source = target UNION SELECT w.policy_id, w.source, k.place, w.c, w.p FROM wide AS w JOIN places AS k ON k.policy_id = w.policy_id AND k.item = w.target) AS w JOIN need AS n ON n.place = w.place AND n.c = w.c AND n.p = w.p)
 SELECT d.policy_id, d.source AS item, n.place || ' ' || n.c || ' ' || n.p AS proof_text, 'tcp' AS element FROM (SELECT DISTINCT policy_id, source FROM has WHERE c = 'tcp_socket' OR p IN ('tcp_send', 'tcp_recv')) AS d, need AS n WHERE NOT EXISTS (SELECT 1 FROM has AS h WHERE h.policy_id = d.policy_id AND h.source = d.source AND h.place = n.place AND h.c = n.c AND h.p = n.p)""",
    ),
    "check_inc_dom_trans": (
        lambda r: checks.run_checks(domain_tables(r), ["inc_dom_trans"], OPTIONS).select("policy_id", "item", "proof_type", "proof_text"),
        f""", {STEPS}, {WAYS}, parts AS (SELECT DISTINCT s.policy_id, s.start, s.ep, s."end", EXISTS (SELECT 1 FROM dom_edge AS d WHERE d.policy_id = s.policy_id AND d.edge = 'transition' AND d.source = s.start AND d.target = s."end") AS tr,
 EXISTS (SELECT 1 FROM dom_edge AS d WHERE d.policy_id = s.policy_id AND d.edge = 'entrypoint' AND d.source = s."end" AND d.target = s.ep) AS en, EXISTS (SELECT 1 FROM dom_edge AS d WHERE d.policy_id = s.policy_id AND d.edge = 'execute' AND d.source = s.start AND d.target = s.ep) AS ex,
 EXISTS (SELECT 1 FROM terules AS c WHERE c.policy_id = s.policy_id AND c.source = s.start AND c.target = s.ep AND c.default_type = s."end") AS ty FROM steps AS s)
 SELECT policy_id, start || ' ' || coalesce(ep, '?') || ' ' || "end" AS item, 'missing' AS proof_type, unnest(list_concat(CASE WHEN tr THEN [] ELSE ['transition'] END, CASE WHEN en THEN [] ELSE ['entrypoint'] END, CASE WHEN ex THEN [] ELSE ['execute'] END, ['setexec'], CASE WHEN ty THEN [] ELSE ['type_transition'] END)) AS proof_text FROM parts WHERE NOT (tr AND en AND ex)
 UNION ALL SELECT policy_id, start || ' ' || ep || ' ' || "end", 'role', 'no role and user for both domains' FROM ways WHERE runs AND NOT good""",
    ),
    "check_imp_range_trans": (
        proofs("imp_range_trans"),
        """SELECT policy_id, source || ' ' || target || ' ' || class AS item, why AS proof_text, '' AS element FROM (SELECT *, unnest(list_concat(CASE WHEN x THEN [] ELSE ['execute'] END, CASE WHEN r THEN CASE WHEN high_rank <= 4 AND u THEN [] ELSE ['user'] END ELSE ['role'] END)) AS why FROM (
 SELECT t.*, EXISTS (SELECT 1 FROM avrule_perm AS a LEFT JOIN type_attr AS b ON a.target = b.attr WHERE a.kind = 'allow' AND a.class = 'file' AND a.perm = 'execute' AND a.policy_id = t.policy_id AND a.source = t.source AND coalesce(b.type, a.target) = t.target) AS x,
 EXISTS (SELECT 1 FROM role_type AS y WHERE y.type = t.source) AS r, EXISTS (SELECT 1 FROM role_type AS y JOIN user_role AS z ON y.role = z.role WHERE y.type = t.source) AS u FROM range_trans AS t))""",
    ),
    "check_unreachable_doms": (
        proofs("unreachable_doms", domain_tables),
        f""", {STEPS}, {WAYS}, best AS (SELECT policy_id, "end" AS type, max(CASE WHEN good THEN 3 WHEN runs THEN 2 ELSE 1 END) AS best FROM ways GROUP BY ALL),
 doms AS (SELECT policy_id, type FROM {IDS}, (SELECT type FROM type_attr WHERE attr = 'n5' UNION SELECT type FROM role_type) UNION SELECT policy_id, source FROM dom_edge UNION SELECT policy_id, default_type FROM terules)
 SELECT d.policy_id, d.type AS item, CASE coalesce(b.best, 0) WHEN 0 THEN 'no transition' WHEN 1 THEN 'no valid transition' ELSE 'no role and user' END AS proof_text, '' AS element FROM doms AS d LEFT JOIN best AS b ON b.policy_id = d.policy_id AND b.type = d.type WHERE coalesce(b.best, 0) < 3 AND NOT EXISTS (SELECT 1 FROM isids AS i WHERE i.policy_id = d.policy_id AND i.type = d.type)""",
    ),
    "check_report": (lambda r: checks.check_report(checks.run_checks(tables(r), ["roles_wo_users", "users_wo_roles", "find_net_domains", "attribs_wo_types"], OPTIONS), "low").select("policy_id", "check", "severity", "items"), f"SELECT policy_id, name AS \"check\", 'low' AS severity, n AS items FROM {IDS}, (SELECT 'attribs_wo_types' AS name, 1 AS n UNION ALL SELECT 'users_wo_roles', 1 UNION ALL SELECT 'roles_wo_users', count(*) FROM (SELECT role FROM role_type UNION SELECT 'empty_r') WHERE role NOT IN (SELECT role FROM user_role))"),
    "labels_query": (lambda r: labels.query_labels(r.file_labels, LabelSearch(type="^p[0-4]", path="^/de", regex=True, range="s0-s1:c0.c3", relation="sub")).select("host", "path", "inode", "type"), "SELECT host, path, inode, type FROM file_labels WHERE regexp_matches(type, '^p[0-4]') AND regexp_matches(path, '^/de') AND rng = 's0-s1:c0.c3'"),
    "labels_indirect": (lambda r: labels.query_labels(r.file_labels, LabelSearch(type="Brand_11", type_indirect=True), r.policy_types(), r.policy_type_attr()).select("inode", "type"), "SELECT inode, type FROM file_labels WHERE type IN (SELECT type FROM type_attr WHERE attr = 'Brand_11')"),
    "labels_index_query": (index_query, "SELECT host, path, inode, type FROM file_labels WHERE regexp_matches(type, '^p1') AND regexp_matches(path, '/[a-m]') AND dev = 'dev1'"),
    "labels_index_build": (index_sizes, "SELECT 'users' AS relation, count(DISTINCT user_name) AS n FROM file_labels UNION ALL SELECT 'roles', count(DISTINCT role) FROM file_labels UNION ALL SELECT 'types', count(DISTINCT type) FROM file_labels UNION ALL SELECT 'ranges', count(DISTINCT rng) FROM file_labels UNION ALL SELECT 'devs', count(DISTINCT dev) FROM file_labels UNION ALL SELECT 'paths', count(*) FROM file_labels"),
    "labels_spec_match": (spec_match, "SELECT s.line_no, split_part(s.context, ':', 3) AS type, count(f.inode) AS files FROM label_specs AS s LEFT JOIN file_labels AS f ON f.type = split_part(s.context, ':', 3) WHERE starts_with(s.context, 'system_u') AND regexp_full_match('/en/x', s.path_regex) AND (s.kind IS NULL OR s.kind = '--') GROUP BY ALL"),
    "labels_expected": (expected, f", {MATCH} SELECT host, path, inode, max(line_no) AS line_no, arg_max(context, line_no) AS expected, arg_max(context, line_no) <> '<<none>>' AND arg_max(context, line_no) <> 'system_u:object_r:' || any_value(type) || ':s0' AS mismatch FROM m GROUP BY host, path, inode"),
    "labels_relabel_plan": (lambda r: labels.plan_relabel(r.file_labels, LabelSearch(type="p5"), type_="p6", range_="s0"), "SELECT host, path, 'system_u:object_r:p5:' || rng AS old, 'system_u:object_r:p6:s0' AS new FROM file_labels WHERE type = 'p5'"),
    "labels_entry_text": (lambda r: labels.entry_text(labels.labels_of_type(r.file_labels, r.type_attr, "Brand_12")).select("inode", "text"), "SELECT inode, path || chr(9) || user_name || ':' || role || ':' || type || ':' || rng AS text FROM file_labels WHERE type IN (SELECT type FROM type_attr WHERE attr = 'Brand_12')"),
}
