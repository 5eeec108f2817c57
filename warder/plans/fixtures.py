"""Relations derived from the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"]

VIEWS = {
    "type_attr": r"""
SELECT DISTINCT concat('s', CAST(s_suppkey % 50 AS STRING)) AS type, concat('n', CAST(s_nationkey AS STRING)) AS attr FROM {supplier}
UNION
SELECT DISTINCT concat('p', CAST(p_partkey % 200 AS STRING)) AS type, replace(p_brand, '#', '_') AS attr FROM {part}""",
    "types": r"""
SELECT type, false AS is_attr FROM type_attr UNION SELECT attr AS type, true AS is_attr FROM type_attr""",
    "avrule_perm": r"""
SELECT DISTINCT o_orderstatus AS policy_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'allow' WHEN '2-HIGH' THEN 'allow'
    WHEN '3-MEDIUM' THEN 'auditallow' WHEN '4-NOT SPECIFIED' THEN 'dontaudit' ELSE 'neverallow' END AS kind,
  concat('s', CAST(l_suppkey % 50 AS STRING)) AS source,
  CASE WHEN l_quantity <= 5 THEN replace(p_brand, '#', '_') ELSE concat('p', CAST(l_partkey % 200 AS STRING)) END AS target,
  CASE l_linestatus WHEN 'O' THEN 'file' ELSE 'dir' END AS class,
  CASE l_linenumber WHEN 1 THEN 'read' WHEN 2 THEN 'write' WHEN 3 THEN 'execute' WHEN 4 THEN 'getattr'
    WHEN 5 THEN 'relabelfrom' WHEN 6 THEN 'relabelto' ELSE 'append' END AS perm
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "audit": r"""
SELECT event_id AS msg_id, ts, concat('h', CAST(user_id % 7 AS STRING)) AS host,
  CASE event_type WHEN 'signup' THEN 'BOOL' WHEN 'view' THEN 'LOAD' ELSE 'AVC' END AS msg_type,
  CASE WHEN event_type IN ('signup', 'view') THEN NULL WHEN event_type = 'error' THEN 'denied' ELSE 'granted' END AS decision,
  CASE WHEN event_type IN ('signup', 'view') THEN NULL ELSE concat('s', CAST(user_id % 50 AS STRING)) END AS stype,
  CASE WHEN event_type IN ('signup', 'view') THEN NULL ELSE concat('p', regexp_extract(props, '([0-9]+)', 1)) END AS ttype,
  CASE WHEN event_type IN ('signup', 'view') THEN NULL WHEN event_type = 'purchase' THEN 'dir' ELSE 'file' END AS tclass,
  CASE WHEN event_type IN ('signup', 'view') THEN NULL ELSE CAST(floor(value) AS INT) END AS port
FROM {events}""",
    "terules": r"""
SELECT o_orderstatus AS policy_id, 'type_transition' AS kind, concat('s', CAST(l_suppkey % 50 AS STRING)) AS source,
  concat('p', CAST(l_partkey % 200 AS STRING)) AS target, 'process' AS class, min(concat('s', CAST(l_partkey % 50 AS STRING))) AS default_type
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 7
GROUP BY o_orderstatus, concat('s', CAST(l_suppkey % 50 AS STRING)), concat('p', CAST(l_partkey % 200 AS STRING))""",
    "range_trans": r"""
SELECT o_orderstatus AS policy_id, concat('s', CAST(l_suppkey % 50 AS STRING)) AS source,
  concat('p', CAST(l_partkey % 200 AS STRING)) AS target, 'process' AS class,
  min(p_size % 5) AS low_rank, min(p_size % 5) + min(l_linenumber % 3) AS high_rank
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber = 7
GROUP BY o_orderstatus, concat('s', CAST(l_suppkey % 50 AS STRING)), concat('p', CAST(l_partkey % 200 AS STRING))""",
    "dom_edge": r"""
SELECT DISTINCT o_orderstatus AS policy_id,
  CASE l_linenumber WHEN 1 THEN 'transition' WHEN 2 THEN 'entrypoint' ELSE 'execute' END AS edge,
  concat('s', CAST(l_suppkey % 50 AS STRING)) AS source,
  CASE l_linenumber WHEN 1 THEN concat('s', CAST(l_partkey % 50 AS STRING)) ELSE concat('p', CAST(l_partkey % 200 AS STRING)) END AS target
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2, 3) AND l_quantity <= 4""",
    "role_type": r"""
SELECT DISTINCT concat(r_name, '_r') AS role, concat('s', CAST(s_suppkey % 50 AS STRING)) AS type
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "user_role": r"""
SELECT DISTINCT concat(c_mktsegment, '_u') AS user_name, concat(r_name, '_r') AS role
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE c_acctbal > 9000""",
    "role_allow": r"""
SELECT DISTINCT o_orderstatus AS policy_id, concat(a.r_name, '_r') AS source, concat(b.r_name, '_r') AS target
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  JOIN {region} AS a ON n_regionkey = a.r_regionkey JOIN {region} AS b ON o_custkey % 5 = b.r_regionkey WHERE o_totalprice > 250000""",
    "role_trans": r"""
SELECT o_orderstatus AS policy_id, concat(r_name, '_r') AS source, concat('p', CAST(o_custkey % 200 AS STRING)) AS target_type,
  min(CASE o_orderpriority WHEN '1-URGENT' THEN 'ASIA_r' WHEN '2-HIGH' THEN 'EUROPE_r' ELSE 'AFRICA_r' END) AS default_role
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE o_totalprice > 300000 GROUP BY o_orderstatus, concat(r_name, '_r'), concat('p', CAST(o_custkey % 200 AS STRING))""",
    "file_labels": r"""
SELECT concat('h', CAST(page_id % 7 AS STRING)) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, page_id AS inode,
  concat('dev', CAST(page_id % 3 AS STRING)) AS dev, 'system_u' AS user_name, 'object_r' AS role,
  concat('p', CAST(page_id % 200 AS STRING)) AS type, CASE WHEN url LIKE '%/en/%' THEN 's0' ELSE 's0-s1:c0.c3' END AS rng, 'file' AS obj_class
FROM {pages}""",
    "portcon": r"""
SELECT DISTINCT 'tcp' AS proto, p_size * 10 AS low, p_size * 10 + 9 AS high, concat('port_', CAST(p_size AS STRING)) AS type FROM {part}""",
    "shipped_class": r"""
SELECT DISTINCT o_orderstatus AS policy_id, concat('line', CAST(l_linenumber AS STRING)) AS class,
  CASE WHEN l_linenumber IN (1, 2) THEN 'air_common' WHEN l_linenumber IN (3, 4) THEN 'land_common' END AS common
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "shipped_perm": r"""
SELECT DISTINCT o_orderstatus AS policy_id, concat('line', CAST(l_linenumber AS STRING)) AS class, concat('perm', CAST(l_suppkey % 7 AS STRING)) AS perm
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity <= 10""",
    "common_perm": r"""
SELECT DISTINCT o_orderstatus AS policy_id, CASE WHEN l_linenumber IN (1, 2) THEN 'air_common' ELSE 'land_common' END AS common,
  concat(CASE WHEN l_linenumber IN (1, 2) THEN 'fly' ELSE 'roll' END, CAST(l_suppkey % 5 AS STRING)) AS perm
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2, 3, 4)""",
    "level_cat": r"""
SELECT DISTINCT concat('s', CAST(p_size % 6 AS STRING)) AS sens, concat('c', CAST(p_partkey % 7 + p_size % 6 AS STRING)) AS cat FROM {part} WHERE p_size % 6 < 5""",
    "level_alias": r"""
SELECT DISTINCT concat('s', CAST(p_size % 6 AS STRING)) AS sens, concat('level', CAST(p_size % 6 AS STRING)) AS alias FROM {part}""",
    "constraint_perm": r"""
SELECT DISTINCT o_orderstatus AS policy_id, n_nationkey AS constraint_id, concat('class', CAST(n_regionkey AS STRING)) AS class,
  concat('perm', CAST(o_custkey % 4 + n_nationkey % 3 AS STRING)) AS perm,
  CASE n_nationkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'role' ELSE 'type' END AS sym,
  CASE n_nationkey % 4 WHEN 0 THEN 'eq' WHEN 1 THEN 'neq' WHEN 2 THEN 'dom' ELSE 'incomp' END AS op, lower(replace(n_name, ' ', '_')) AS name
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "isids": r"""
SELECT o_orderstatus AS policy_id, CASE n_regionkey WHEN 0 THEN 'unlabeled' WHEN 1 THEN 'netif' WHEN 2 THEN 'node' WHEN 3 THEN 'port' ELSE 'kernel' END AS name,
  concat('p', CAST(min(o_custkey % 200) AS STRING)) AS type
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY o_orderstatus, CASE n_regionkey WHEN 0 THEN 'unlabeled' WHEN 1 THEN 'netif' WHEN 2 THEN 'node' WHEN 3 THEN 'port' ELSE 'kernel' END""",
    "netifcon": r"""
SELECT o_orderstatus AS policy_id, concat('eth', CAST(o_custkey % 6 AS STRING)) AS name, concat('p', CAST(min(o_custkey % 200) AS STRING)) AS if_type,
  concat('p', CAST(max(o_custkey % 200) AS STRING)) AS msg_type
FROM {orders} GROUP BY o_orderstatus, concat('eth', CAST(o_custkey % 6 AS STRING))""",
    "nodecon": r"""
SELECT DISTINCT o_orderstatus AS policy_id, CASE WHEN o_custkey % 2 = 0 THEN 'ipv4' ELSE 'ipv6' END AS proto, concat('10.0.', CAST(o_custkey % 16 AS STRING), '.0') AS addr,
  '255.255.255.0' AS mask, concat('p', CAST(o_custkey % 16 + 40 AS STRING)) AS type
FROM {orders} WHERE o_totalprice > 200000""",
    "nodecon6": r"""
SELECT DISTINCT o_custkey % 20 AS g2, o_custkey % 7 AS g3, CASE o_custkey % 3 WHEN 0 THEN 32 WHEN 1 THEN 48 ELSE 36 END AS width,
  concat('fd00:', CAST(o_custkey % 20 AS STRING), ':', CAST(o_custkey % 7 AS STRING), '::') AS addr,
  CASE o_custkey % 3 WHEN 0 THEN 'ffff:ffff::' WHEN 1 THEN 'ffff:ffff:ffff::' ELSE 'ffff:ffff:f000::' END AS mask, concat('p', CAST(o_custkey % 16 + 40 AS STRING)) AS type
FROM {orders} WHERE o_totalprice > 300000""",
    "genfscon": r"""
SELECT DISTINCT concat('fs', CAST(page_id % 5 AS STRING)) AS fs, regexp_extract(url, '^https?://[^/]+(/[^/?#]*)', 1) AS path,
  CASE page_id % 3 WHEN 0 THEN 'dir' ELSE 'file' END AS class, concat('p', CAST(page_id % 10 AS STRING)) AS type FROM {pages}""",
    "fs_use": r"""
SELECT lower(replace(n_name, ' ', '_')) AS fs, CASE n_regionkey % 3 WHEN 0 THEN 'fs_use_xattr' WHEN 1 THEN 'fs_use_trans' ELSE 'fs_use_task' END AS behavior,
  concat('p', CAST(n_nationkey AS STRING)) AS type FROM {nation}""",
    "bounds": r"""
SELECT DISTINCT CASE n_regionkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'role' ELSE 'type' END AS kind, concat('s', CAST(s_suppkey % 50 AS STRING)) AS parent,
  concat('s', CAST((s_suppkey * 7 + 1) % 50 AS STRING)) AS child FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "default_object": r"""
SELECT concat('size', CAST(p_size % 20 AS STRING)) AS class, CASE WHEN min(p_size) % 2 = 0 THEN 'source' END AS default_user, CASE WHEN max(p_partkey) % 3 = 0 THEN 'target' END AS default_role,
  CASE WHEN min(p_partkey) % 2 = 0 THEN 'source' END AS default_type, CASE WHEN count(*) % 2 = 0 THEN 'low' END AS default_range FROM {part} GROUP BY concat('size', CAST(p_size % 20 AS STRING))""",
    "polcap": r"""
SELECT DISTINCT o_orderstatus AS policy_id, lower(replace(substring(o_orderpriority, 3), ' ', '_')) AS name FROM {orders} WHERE o_totalprice > 100000""",
    "spaced_name": r"""
SELECT DISTINCT 'type' AS kind, replace(p_brand, '#', '.') AS name FROM {part} UNION SELECT DISTINCT 'role' AS kind, concat('Brand.', lower(c_mktsegment)) AS name FROM {customer}
UNION SELECT DISTINCT 'user' AS kind, lower(c_mktsegment) AS name FROM {customer}""",
    "perm_map": r"""
SELECT c.class, p.perm, p.direction, p.weight FROM (VALUES ('file'), ('dir')) AS c(class) CROSS JOIN (VALUES
  ('read', 'r', 10), ('getattr', 'r', 7), ('execute', 'r', 5), ('write', 'w', 10), ('append', 'w', 9),
  ('relabelfrom', 'n', 1), ('relabelto', 'n', 1)) AS p(perm, direction, weight)""",
    "label_specs": r"""
SELECT * FROM (VALUES (1, '/.*', CAST(NULL AS STRING), 'system_u:object_r:p0:s0'), (2, '/en(/.*)?', CAST(NULL AS STRING), 'system_u:object_r:p1:s0'),
  (3, '/de(/.*)?', '--', 'system_u:object_r:p2:s0'), (4, '/fr(/.*)?', '-d', 'system_u:object_r:p3:s0'),
  (5, '/es(/.*)?', CAST(NULL AS STRING), '<<none>>')) AS v(line_no, path_regex, kind, context)""",
    "conds": r"""
SELECT DISTINCT o_orderstatus AS policy_id, o_custkey % 12 AS cond_id, concat('b', CAST(o_custkey % 4 AS STRING)) AS bool_a,
  concat('b', CAST((o_custkey % 12) % 3 + 4 AS STRING)) AS bool_b, CASE (o_custkey % 12) % 3 WHEN 0 THEN '&&' WHEN 1 THEN '||' ELSE '^' END AS op
FROM {orders}""",
    "bools": r"""
SELECT DISTINCT o_orderstatus AS policy_id, concat('b', CAST(o_custkey % 7 AS STRING)) AS bool, (o_custkey % 7) % 2 = 0 AS state FROM {orders}""",
}


def with_clause(sql: dict[str, str], names: dict[str, str]) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v.format(**names)})" for k, v in sql.items())


def oracle(query: str) -> str:
    """A DuckDB query over the relations."""
    plain = {k: v.replace("AS STRING", "AS VARCHAR") for k, v in VIEWS.items()}
    return with_clause(plain, {t: t for t in BASE}) + "\n" + query


class Relations:
    """The relations as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        needed, found = {name}, {}
        for k in reversed(list(VIEWS)):  # a relation only uses those before it
            if k in needed:
                found[k] = VIEWS[k]
                needed |= {o for o in VIEWS if o != k and f" {o}" in VIEWS[k] and f"FROM {o}" in VIEWS[k]}
        text = ",\n".join(f"{k} AS ({found[k].format(**self.files)})" for k in VIEWS if k in found)
        return self.spark.sql(f"WITH {text} SELECT * FROM {name}")

    def grouped_rules(self) -> DataFrame:
        """AV rules with their permissions as an array and a stable identifier."""
        key = ["policy_id", "kind", "source", "target", "class"]
        rules = self.avrule_perm.groupBy(*key).agg(F.array_sort(F.collect_set("perm")).alias("perms"))
        return rules.withColumn("rule_id", F.xxhash64(*key)).withColumns({"cond_id": F.lit(None).cast("long"), "branch": F.lit(None).cast("boolean"), "enabled": F.lit(True)})

    def policy_types(self) -> DataFrame:
        """Types and attributes for each policy, without aliases."""
        ids = self.spark.sql("SELECT explode(array('F', 'O', 'P')) AS policy_id")
        return self.types.crossJoin(F.broadcast(ids)).withColumn("aliases", F.array().cast("array<string>"))

    def policy_type_attr(self) -> DataFrame:
        ids = self.spark.sql("SELECT explode(array('F', 'O', 'P')) AS policy_id")
        return self.type_attr.crossJoin(F.broadcast(ids))

    def audit_messages(self) -> DataFrame:
        """Audit messages in the full shape of the parser."""
        a = self.audit
        is_avc = F.col("msg_type") == "AVC"
        ctx = lambda user, role, t: F.when(is_avc, F.concat_ws(":", F.lit(user), F.lit(role), F.col(t), F.lit("s0-s1")))
        return a.withColumns(
            {
                "ts": F.col("ts").cast("timestamp"),
                "serial": F.col("msg_id").cast("long"),
                "has_year": F.lit(True),
                "perms": F.when(is_avc, F.array(F.lit("read"), F.lit("write"))),
                "comm": F.when(is_avc, F.concat(F.lit("prog "), F.col("stype"))),
                "pid": F.when(is_avc, (F.col("msg_id") % 1000).cast("int")),
                "scontext": ctx("user_u", "role_r", "stype"),
                "tcontext": ctx("system_u", "object_r", "ttype"),
                "changes": F.when(F.col("msg_type") == "BOOL", F.array(F.struct(F.lit("allow_x").alias("bool"), (F.col("msg_id") % 2 == 0).alias("value")))),
                "load": F.when(F.col("msg_type") == "LOAD", F.struct(*[F.lit(n).alias(c) for n, c in enumerate(("classes", "rules", "users", "roles", "types", "bools"), 3)])),
            }
        )
