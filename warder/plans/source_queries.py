"""Registered queries over policy snapshots on disk, IPv6 statements and large sets of label specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warder.functions import net
from warder.functions.state import scratch_path, written
from warder.operators import labels, snapshot_diff
from warder.plans.diff_queries import all_pairs, flat
from warder.plans.fixtures import Relations
from warder.sources.snapshots import read_policy_tables, write_policy_tables


def snapshot(r: Relations) -> DataFrame:
    """Access rules of one policy, out of snapshots of all that were written."""
    root = scratch_path(r.spark, "snapshots")
    write_policy_tables({"avrules": r.grouped_rules(), "type_attr": r.policy_type_attr(), "bools": r.bools}, root)
    tables = read_policy_tables(r.spark, root, policies=["O"])
    wide = tables["avrules"].join(tables["type_attr"].withColumnRenamed("attr", "target"), ["policy_id", "target"])
    return wide.select("policy_id", "kind", "source", "target", "type", "class", F.array_join("perms", ",").alias("perms"))


def nodes6(r: Relations) -> DataFrame:
    """The IPv6 node statement that holds the address of each message, with its network as text."""
    digits = lambda c: net.ipv6(F.col(c))
    statements = r.nodecon6.select(net.ipv6_number(digits("addr")).alias("addr"), net.ipv6_number(digits("mask")).alias("mask"), "type")
    group = lambda n: F.pmod("msg_id", F.lit(n)).cast("string")
    text = F.concat(F.lit("fd00:"), group(20), F.lit(":"), group(9), F.lit("::"), group(1000))
    rows = r.audit.select("msg_id", net.ipv6_number(net.ipv6(text)).alias("ip"))
    found = net.ipv6_subnet_lookup(rows, "ip", statements.groupBy("addr", "mask").agg(F.min("type").alias("type")))
    return found.select("msg_id", "type", net.ipv6_text(net.ipv6_digits(F.col("net"))).alias("network"))


def folder_specs(r: Relations) -> DataFrame:
    """A spec for each folder and for each file whose path is plain, the deeper ones later."""
    plain = r.file_labels.filter(F.col("path").rlike("^(/[A-Za-z0-9_-]+)+$")).select("path").distinct()
    whole = plain.select("path", F.lit("").alias("end"))
    folders = plain.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).filter("path <> ''").distinct().select("path", F.lit("(/.*)?").alias("end"))
    rows = whole.unionByName(folders).select(F.concat("path", "end").alias("path_regex"), F.length("path").alias("n"), F.lit(None).cast("string").alias("kind"))
    context = F.concat(F.lit("system_u:object_r:p"), (F.col("n") % 7).cast("string"), F.lit(":s0"))
    return rows.select((F.col("n") * 10 + F.when(F.col("path_regex").endswith(")?"), 0).otherwise(1)).cast("int").alias("line_no"), "path_regex", "kind", context.alias("context"))


def folders(r: Relations) -> DataFrame:
    return labels.expected_labels(r.file_labels, folder_specs(r)).select("host", "path", "inode", "line_no", "expected", "mismatch")


FOLDERS = """, plain AS (SELECT DISTINCT path FROM file_labels WHERE regexp_full_match(path, '(/[A-Za-z0-9_-]+)+')),
 spec AS (SELECT path, 1 AS k FROM plain UNION SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1), 0 FROM plain),
 m AS (SELECT f.*, length(s.path) * 10 + k AS line_no, 'system_u:object_r:p' || (length(s.path) % 7) || ':s0' AS expected FROM file_labels AS f JOIN spec AS s ON s.path <> '' AND (f.path = s.path OR k = 0 AND starts_with(f.path, s.path || '/')))
 SELECT host, path, inode, line_no, expected, expected <> 'system_u:object_r:' || type || ':s0' AS mismatch FROM (SELECT *, row_number() OVER (PARTITION BY inode, path, host ORDER BY line_no DESC) AS n FROM m) WHERE n = 1"""
def stored_diff(r: Relations) -> DataFrame:
    """Differences between all pairs of three stored snapshots, of which two differ a little from
    the first: one in the rules of a domain, the other in those of a file type."""
    root, rules = scratch_path(r.spark, "stored"), written(r.grouped_rules().filter("policy_id = 'F' AND kind = 'allow'"), "rules")
    less = F.filter("perms", lambda p: p != "read")
    second = rules.filter("NOT (source = 's7' AND class = 'dir')").unionByName(rules.filter("source = 's7' AND class = 'dir'").withColumn("perms", less).filter(F.size("perms") > 0)).withColumn("policy_id", F.lit("O"))
    third = rules.filter("target <> 'p33'").withColumn("policy_id", F.lit("P"))
    snapshot_diff.store_snapshots(rules.unionByName(second).unionByName(third), root, ["source", "target", "class"], "perms")
    return flat(snapshot_diff.diff_stored(r.spark, root, all_pairs(r), ["source", "target", "class"], "perms", "allow"), "orig_id", "mod_id")


STORED = """, side AS (
  SELECT 'F' AS policy_id, source || ' ' || target || ' ' || class AS key, perm AS v FROM avrule_perm WHERE policy_id = 'F' AND kind = 'allow'
  UNION ALL SELECT 'O', source || ' ' || target || ' ' || class, perm FROM avrule_perm WHERE policy_id = 'F' AND kind = 'allow' AND NOT (source = 's7' AND class = 'dir' AND perm = 'read')
  UNION ALL SELECT 'P', source || ' ' || target || ' ' || class, perm FROM avrule_perm WHERE policy_id = 'F' AND kind = 'allow' AND target <> 'p33'),
 both_ AS (SELECT a.p AS orig_id, b.p AS mod_id, key, v, bool_or(s.policy_id = a.p) AS o, bool_or(s.policy_id = b.p) AS m
  FROM (VALUES ('F'), ('O'), ('P')) AS a(p), (VALUES ('F'), ('O'), ('P')) AS b(p), side AS s WHERE a.p <> b.p AND s.policy_id IN (a.p, b.p) GROUP BY ALL)
 SELECT orig_id, mod_id, 'allow' AS component, key, CASE WHEN NOT bool_or(o) THEN 'added' WHEN NOT bool_or(m) THEN 'removed' ELSE 'modified' END AS form,
  coalesce(string_agg(v, ',' ORDER BY v) FILTER (NOT o), '') AS added, coalesce(string_agg(v, ',' ORDER BY v) FILTER (NOT m), '') AS removed, coalesce(string_agg(v, ',' ORDER BY v) FILTER (o AND m), '') AS unmodified
 FROM both_ GROUP BY orig_id, mod_id, key HAVING bool_or(NOT o) OR bool_or(NOT m)"""
NET6 = "'fd00:' || CASE WHEN g2 = 0 AND g3 = 0 THEN ':' WHEN g3 = 0 THEN g2 || '::' ELSE g2 || ':' || g3 || '::' END"
QUERIES = {
    "diff_stored": (stored_diff, STORED),
    "labels_folder_specs": (folders, FOLDERS),
    "snapshot_tables": (snapshot, "SELECT a.policy_id, a.kind, a.source, a.target, t.type, a.class, string_agg(a.perm, ',' ORDER BY a.perm) AS perms FROM avrule_perm AS a JOIN type_attr AS t ON a.target = t.attr WHERE a.policy_id = 'O' GROUP BY ALL"),
    "ipv6_subnet_lookup": (
        nodes6,
        f"""SELECT msg_id, type, {NET6} AS network FROM (SELECT a.msg_id, n.type, n.g2, CASE WHEN width = 48 THEN n.g3 ELSE 0 END AS g3, row_number() OVER (PARTITION BY a.msg_id ORDER BY width DESC, CASE WHEN width = 48 THEN n.g3 ELSE 0 END, n.type DESC) AS n
 FROM audit AS a JOIN (SELECT g2, CASE WHEN width = 48 THEN g3 ELSE 0 END AS g3, width, max(type) AS type FROM (SELECT g2, g3, width, addr, min(type) AS type FROM nodecon6 GROUP BY ALL) GROUP BY ALL) AS n ON n.g2 = a.msg_id % 20 AND (width <> 48 OR n.g3 = a.msg_id % 9)) WHERE n = 1""",
    ),
}
