"""Registered queries over classes, conditions, levels, constraints, labelled objects and written rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions import mls
from warder.operators import components as c
from warder.operators import diff, labels, transitions
from warder.operators import rules as ru
from warder.operators.audit_filter import AuditFilter, apply_saved_filters
from warder.operators.labels import LabelSearch
from warder.operators.rules import RuleSearch
from warder.plans.audit_queries import TEXT_SQL
from warder.plans.fixtures import Relations
from warder.plans.graph_queries import WHOLE, domain_edges
from warder.plans.rule_queries import conds, level
from warder.sources import audit_log


def every(r: Relations, df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(r.spark.sql("SELECT explode(array('F', 'O', 'P')) AS policy_id")))


IDS = "(VALUES ('F'), ('O'), ('P')) AS ids(policy_id)"


def inherited(r: Relations) -> DataFrame:
    return c.class_perms(r.shipped_class, r.shipped_perm, r.common_perm)


INHERITED = "inherited AS (SELECT policy_id, class, perm FROM shipped_perm UNION SELECT x.policy_id, x.class, p.perm FROM shipped_class AS x JOIN common_perm AS p ON x.policy_id = p.policy_id AND x.common = p.common)"


def levels(r: Relations) -> DataFrame:
    return every(r, r.level_alias.groupBy("sens").agg(F.collect_set("alias").alias("aliases")))


def cats(r: Relations) -> DataFrame:
    named = r.level_cat.select("cat").distinct().withColumn("aliases", F.array(F.concat(F.lit("alias_"), F.col("cat"))))
    return every(r, named)


def constraints(r: Relations) -> DataFrame:
    """Each constraint compares a symbol of both sides and then looks a name up."""
    none = F.array().cast("array<string>")
    item = lambda kind, sym, op, names: F.struct(kind.alias("kind"), sym.alias("sym"), op.alias("op"), names.alias("names"))
    expr = F.array(item(F.lit("attr"), F.col("sym"), F.col("op"), none), item(F.lit("names"), F.col("sym"), F.lit("eq"), F.array("name")))
    rows = r.constraint_perm.groupBy("policy_id", "constraint_id", "class", "sym", "op", "name").agg(F.array_sort(F.collect_set("perm")).alias("perms"))
    return rows.withColumn("expr", expr)


def context(type_: Column | str) -> Column:
    none = F.lit(None).cast(mls_range_type())
    return F.struct(F.lit("system_u").alias("user"), F.lit("object_r").alias("role"), (F.col(type_) if isinstance(type_, str) else type_).alias("type"), none.alias("range"))


def mls_range_type() -> str:
    one = "struct<sens:string,rank:int,cats:array<string>>"
    return f"struct<low:{one},high:{one}>"


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("context", context("type"))


def context_text(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    for name, type_ in columns or (("context", "type"),):
        df = df.withColumn(name, c.render_context(F.lit("system_u"), F.lit("object_r"), F.col(type_)))
    return df


def filename_rules(r: Relations) -> DataFrame:
    return r.terules.withColumns({"enabled": F.lit(True), "filename": F.concat(F.lit("file"), F.substring("target", 2, 3))})


def written_te(r: Relations) -> DataFrame:
    """Type rules as written: one a source and default type, with its targets."""
    rows = r.terules.groupBy("policy_id", "kind", "source", "class", "default_type").agg(F.collect_set("target").alias("targets"))
    rows = rows.select("policy_id", "kind", F.array("source").alias("sources"), "targets", F.array("class").alias("classes"), "default_type", F.xxhash64("source", "class", "default_type").alias("syn_id"))
    flags = {n: F.lit(False) for n in ("star", "complement", "self")}
    return rows.withColumns(flags)


def conditional_rules(r: Relations) -> DataFrame:
    key = F.pmod(F.ascii(F.substring("source", -1, 1)) + F.length("target"), F.lit(12)).cast("long")
    return r.grouped_rules().withColumns({"cond_id": key, "branch": F.col("class") == "file"})


def cond_rows(r: Relations) -> DataFrame:
    return conds(r).withColumn("cond_id", F.col("cond_id").cast("long"))


COND_TEXT = "'(' || bool_a || ' ' || op || ' ! ' || bool_b || ')'"
COND_KEY = "(ascii(right(source, 1)) + length(target)) % 12"

#: Criteria that one pass applies, each as a strict filter of its own.
CRITERIA = {
    "perm": "writ*", "exe": "/usr/bin/s1*", "comm": "prog s2*", "path": "/srv/p1?", "inode": 77, "pid": 55, "ipaddr": "10.0.0.7", "saddr": "10.0.1.1*", "daddr": "10.0.2.?",
    "laddr": "10.0.3.*5", "faddr": "10.0.4.[2-4]", "lport": 11, "fport": 12, "sport": 13, "dport": 14, "port": 40, "netif": "eth1", "key": 3, "cap": 5, "src_user": ["user_1"], "tgt_role": ["role_2"],
}


def rich_messages(r: Relations) -> DataFrame:
    """Access messages with all that criteria test, made of their identifier."""
    k = F.col("msg_id")
    text = lambda head, n: F.concat(F.lit(head), (k % n).cast("string"))
    address = {a: F.concat(F.lit(f"10.0.{i}."), (k % (50 + i)).cast("string")) for i, a in enumerate(("ipaddr", "saddr", "daddr", "laddr", "faddr"))}
    numbers = {n: (k % m).cast("int") for n, m in (("pid", 1000), ("lport", 101), ("fport", 103), ("sport", 107), ("dport", 109), ("key", 9), ("cap", 30))}
    rows = r.audit_messages().filter("msg_type = 'AVC'")
    rows = rows.withColumns({"exe": F.concat(F.lit("/usr/bin/"), F.col("stype")), "path": F.concat(F.lit("/srv/"), F.col("ttype")), "inode": k % 500, "netif": text("eth", 4), "suser": text("user_", 5), "trole": text("role_", 6)})
    # every third message is of reading only
    return rows.withColumns(address | numbers).withColumn("perms", F.when(k % 3 == 0, F.array(F.lit("read"))).otherwise(F.col("perms")))


CRITERIA_SQL = " UNION ALL ".join(
    f"SELECT msg_id, '{name}' AS filter FROM audit WHERE msg_type = 'AVC' AND {test}"
    for name, test in {
        "perm": "msg_id % 3 <> 0", "exe": "stype LIKE 's1%'", "comm": "stype LIKE 's2%'", "path": "ttype LIKE 'p1_'", "inode": "msg_id % 500 = 77", "pid": "msg_id % 1000 = 55", "ipaddr": "msg_id % 50 = 7", "saddr": "CAST(msg_id % 51 AS VARCHAR) LIKE '1%'", "daddr": "msg_id % 52 < 10",
        "laddr": "CAST(msg_id % 53 AS VARCHAR) LIKE '%5'", "faddr": "msg_id % 54 IN (2, 3, 4)", "lport": "msg_id % 101 = 11", "fport": "msg_id % 103 = 12", "sport": "msg_id % 107 = 13", "dport": "msg_id % 109 = 14", "port": "port = 40", "netif": "msg_id % 4 = 1",
        "key": "msg_id % 9 = 3", "cap": "msg_id % 30 = 5", "src_user": "msg_id % 5 = 1", "tgt_role": "msg_id % 6 = 2",
    }.items()
)


def criteria(r: Relations) -> DataFrame:
    filters = [AuditFilter({k: v}, "all", True, k) for k, v in CRITERIA.items()]
    return apply_saved_filters(rich_messages(r), filters).select("msg_id", "filter")


def logs(r: Relations) -> DataFrame:
    """Two logs with different columns as one; messages without a decision are malformed."""
    a = audit_log.render_messages(r.audit_messages().filter("msg_id % 2 = 0"), "value").select("value")
    b = audit_log.render_messages(r.audit_messages().filter("msg_id % 2 = 1"), "value").select(F.regexp_replace("value", "  (denied|granted)  ", "  ").alias("value"))
    both = audit_log.union_logs([audit_log.parse_lines(a).withColumn("origin", F.lit("a")), audit_log.parse_lines(b)])
    return audit_log.malformed_lines(both).select("raw", F.array_join("warnings", ",").alias("warnings"))


def pairs(r: Relations) -> DataFrame:
    """All ordered pairs of snapshots."""
    return r.spark.sql("SELECT a.id AS orig_id, b.id AS mod_id FROM (SELECT explode(array('F', 'O', 'P')) AS id) AS a JOIN (SELECT explode(array('F', 'O', 'P')) AS id) AS b ON a.id <> b.id")


def sets(df: DataFrame) -> DataFrame:
    join = lambda x: F.array_join(F.array_sort(x), ",").alias(x)
    return df.select("orig_id", "mod_id", "key", "form", join("added"), join("removed"), join("unmodified"))


def sets_sql(rows: str) -> str:
    """Comparison of (policy_id, key, v) sets over all ordered pairs of snapshots."""
    part = lambda test: f"coalesce(string_agg(v, ',' ORDER BY v) FILTER ({test}), '')"
    return f""", rows_ AS ({rows}), two AS (SELECT orig_id, mod_id, key, v, bool_or(side = 1) AS o, bool_or(side = 2) AS m FROM (
 SELECT p.orig_id, p.mod_id, x.key, x.v, 1 AS side FROM rows_ AS x JOIN (SELECT a.policy_id AS orig_id, b.policy_id AS mod_id FROM {IDS.replace('ids', 'a')}, {IDS.replace('ids', 'b')} WHERE a.policy_id <> b.policy_id) AS p ON p.orig_id = x.policy_id
 UNION ALL SELECT p.orig_id, p.mod_id, x.key, x.v, 2 FROM rows_ AS x JOIN (SELECT a.policy_id AS orig_id, b.policy_id AS mod_id FROM {IDS.replace('ids', 'a')}, {IDS.replace('ids', 'b')} WHERE a.policy_id <> b.policy_id) AS p ON p.mod_id = x.policy_id) GROUP BY ALL)
 SELECT orig_id, mod_id, key, CASE WHEN NOT bool_or(o) THEN 'added' WHEN NOT bool_or(m) THEN 'removed' ELSE 'modified' END AS form, {part('NOT o')} AS added, {part('NOT m')} AS removed, {part('o AND m')} AS unmodified
 FROM two GROUP BY orig_id, mod_id, key HAVING bool_or(NOT o) OR bool_or(NOT m)"""


def policy_levels(r: Relations) -> DataFrame:
    """Categories by sensitivity, with one less in two snapshots each."""
    gone = ((F.col("policy_id") == "O") & (F.col("cat") == "c3")) | ((F.col("policy_id") == "P") & (F.col("sens") == "s2"))
    return every(r, r.level_cat).filter(~gone)


POLICY_LEVELS = f"SELECT policy_id, sens, cat FROM {IDS}, level_cat WHERE NOT (policy_id = 'O' AND cat = 'c3') AND NOT (policy_id = 'P' AND sens = 's2')"


def ranked_users(r: Relations) -> DataFrame:
    """Users of all policies; default level and range differ by policy for some."""
    users = every(r, r.user_role.select("user_name").distinct())
    rank = F.when((F.col("policy_id") == "O") & F.col("user_name").startswith("M"), 2).otherwise(1)
    high = F.when((F.col("policy_id") == "P") & F.col("user_name").startswith("B"), 4).otherwise(3)
    return users.withColumns({"default_level": level(rank), "range": mls.level_range(level(F.lit(1)), level(high))})


RANKED = f"""SELECT policy_id, user_name AS key, role AS v FROM {IDS}, user_role UNION SELECT policy_id, user_name, unnest(['level ' || CASE WHEN policy_id = 'O' AND user_name LIKE 'M%' THEN 2 ELSE 1 END || ':c0', 'range least:c0', 'range 1:c0', 'range 2:c0', 'range 3:c0'] ||
 CASE WHEN policy_id = 'P' AND user_name LIKE 'B%' THEN ['range 4:c0'] ELSE [] END) FROM {IDS}, (SELECT DISTINCT user_name FROM user_role)"""


def line_numbers(r: Relations) -> DataFrame:
    """Differences of role transitions with the lines of the rules on both sides."""
    rules = r.role_trans
    found = diff.diff_groups(rules.withColumn("key", F.concat_ws(" ", "source", "target_type")), pairs(r), "key", "default_role", "role_trans")
    lines = rules.select("policy_id", F.concat_ws(" ", "source", "target_type").alias("key"), F.length("target_type").alias("lineno"))
    text = lambda x: F.array_join(F.transform(F.coalesce(x, F.array().cast("array<int>")), lambda n: n.cast("string")), ",")
    return diff.diff_line_numbers(found, lines).select("orig_id", "mod_id", "key", "form", text(F.col("orig_lines")).alias("orig_lines"), text(F.col("mod_lines")).alias("mod_lines"))


SIDE = "SELECT policy_id, source || ' ' || target_type AS key, default_role AS v, length(target_type) AS n FROM role_trans"


def transition_pairs(r: Relations) -> DataFrame:
    """Transitions both ways between every two domains with a transition rule."""
    asked = r.dom_edge.filter("edge = 'transition' AND source <> target").select("policy_id", F.col("source").alias("a"), F.col("target").alias("b"))
    return transitions.transitions_between(domain_edges(r), asked, False).select("policy_id", "start", "ep", "end", "forward")


def legal_levels(r: Relations) -> DataFrame:
    """The levels that each range of a rule spans, with the categories legal at each."""
    legal = r.level_cat.groupBy("sens").agg(F.array_sort(F.collect_set("cat")).alias("cats"))
    table = legal.agg(F.map_from_entries(F.collect_list(F.struct(F.substring("sens", 2, 1).cast("int"), F.struct("sens", "cats")))).alias("sens_cats"))
    ranges = r.range_trans.filter("high_rank < 5").select("low_rank", "high_rank").distinct()
    lv = lambda rank: mls.level(F.concat(F.lit("s"), rank.cast("string")), rank.cast("int"), F.array(*[F.lit(f"c{i}") for i in range(6)]))
    spans = ranges.crossJoin(F.broadcast(table)).withColumn("x", F.explode(mls.range_levels(mls.level_range(lv(F.col("low_rank")), lv(F.col("high_rank"))), F.col("sens_cats"))))
    return spans.select("low_rank", "high_rank", F.col("x.sens").alias("sens"), F.array_join(F.array_sort("x.cats"), ",").alias("cats"))


def rendered(df: DataFrame) -> DataFrame:
    return df.select("policy_id", "text")


CTX = "'system_u:object_r:' || {t}"
QUERIES = {
    "class_search": (lambda r: c.find_classes(r.shipped_class, "[134]$", "land_common", True).select("policy_id", "class"), "SELECT policy_id, class FROM shipped_class WHERE regexp_matches(class, '[134]$') AND regexp_matches(common, 'land_common')"),
    "common_search": (lambda r: c.find_commons(r.common_perm, "^air", True), "SELECT DISTINCT policy_id, common FROM common_perm WHERE common LIKE 'air%'"),
    "class_perms_inherited": (inherited, f", {INHERITED} SELECT * FROM inherited"),
    "perm_search": (lambda r: c.find_perms(r.shipped_perm, r.common_perm, "[12]$", True), "SELECT policy_id, perm FROM shipped_perm WHERE regexp_matches(perm, '[12]$') UNION SELECT policy_id, perm FROM common_perm WHERE regexp_matches(perm, '[12]$')"),
    "classes_of_perm": (lambda r: c.classes_of_perm(inherited(r), "roll2"), f", {INHERITED} SELECT policy_id, class FROM inherited WHERE perm = 'roll2'"),
    "commons_of_perm": (lambda r: c.commons_of_perm(r.common_perm, "fly1"), "SELECT DISTINCT policy_id, common FROM common_perm WHERE perm = 'fly1'"),
    "bool_search": (lambda r: c.find_bools(r.bools, "^b[135]", True), "SELECT * FROM bools WHERE bool IN ('b1', 'b3', 'b5')"),
    "cond_search": (lambda r: c.find_conds(conds(r), "b5").select("policy_id", "cond_id", "text"), f"SELECT policy_id, cond_id, {COND_TEXT} AS text FROM conds WHERE bool_a = 'b5' OR bool_b = 'b5'"),
    "level_search": (lambda r: c.find_levels(levels(r), every(r, r.level_cat), "level[0-3]", "c5", True).select("policy_id", "sens"), f"SELECT DISTINCT policy_id, sens FROM {IDS}, level_alias WHERE regexp_matches(alias, 'level[0-3]') AND sens IN (SELECT sens FROM level_cat WHERE contains(cat, 'c5'))"),
    "category_search": (lambda r: c.find_cats(cats(r), "alias_c1", True).select("policy_id", "cat"), f"SELECT DISTINCT policy_id, cat FROM {IDS}, level_cat WHERE starts_with('alias_' || cat, 'alias_c1')"),
    "constraint_search": (lambda r: c.find_constraints(constraints(r), "^class[01]", "perm3", True).select("policy_id", "constraint_id", "class", F.array_join("perms", ",").alias("perms")), "SELECT policy_id, constraint_id, class, string_agg(perm, ',' ORDER BY perm) AS perms FROM constraint_perm WHERE class IN ('class0', 'class1') GROUP BY ALL HAVING bool_or(perm = 'perm3')"),
    "validatetrans_search": (lambda r: c.find_validatetrans(constraints(r).drop("perms"), "class2").select("policy_id", "constraint_id", "class"), "SELECT DISTINCT policy_id, constraint_id, class FROM constraint_perm WHERE class = 'class2'"),
    "constraint_by_expr": (lambda r: c.find_constraints_by_expr(constraints(r), ["user", "role"], ["dom", "neq"], ["nation_1", "nation_2", "nation_6", "nation_9"]).select("policy_id", "constraint_id"), "SELECT DISTINCT policy_id, constraint_id FROM constraint_perm WHERE sym IN ('user', 'role') AND op IN ('dom', 'neq') AND name IN ('nation_1', 'nation_2', 'nation_6', 'nation_9')"),
    "portcon_search": (lambda r: c.find_portcon(labelled(every(r, r.portcon)), proto="tcp", context=F.struct(F.lit("system_u").alias("user"), F.lit(None).cast("string").alias("role"), F.lit("port_7").alias("type"), F.lit(None).cast(mls_range_type()).alias("range"))).select("policy_id", "low", "high"), f"SELECT policy_id, low, high FROM {IDS}, portcon WHERE type = 'port_7'"),
    "netifcon_search": (lambda r: c.find_netifcon(r.netifcon.withColumns({"if_context": context("if_type"), "msg_context": context("msg_type")}), "eth[0-3]", msg_context=context(F.lit("p199")), regex=True).select("policy_id", "name", "if_type"), "SELECT policy_id, name, if_type FROM netifcon WHERE regexp_matches(name, 'eth[0-3]') AND msg_type = 'p199'"),
    "nodecon_search": (lambda r: c.find_nodecon(labelled(r.nodecon), proto="ipv6", context=context(F.lit("p43"))).select("policy_id", "addr", "mask"), "SELECT policy_id, addr, mask FROM nodecon WHERE proto = 'ipv6' AND type = 'p43'"),
    "genfscon_search": (lambda r: c.find_genfscon(labelled(every(r, r.genfscon)), "fs[12]", "^/[de]", "file", context(F.lit("p6")), True).select("policy_id", "fs", "path"), f"SELECT policy_id, fs, path FROM {IDS}, genfscon WHERE regexp_matches(fs, 'fs[12]') AND regexp_matches(path, '^/[de]') AND class = 'file' AND type = 'p6'"),
    "fs_use_search": (lambda r: c.find_fs_use(labelled(every(r, r.fs_use)), "1", "fs_use_trans", regex=True).select("policy_id", "fs", "type"), f"SELECT policy_id, fs, type FROM {IDS}, fs_use WHERE contains(fs, '1') AND behavior = 'fs_use_trans'"),
    "isid_search": (lambda r: c.find_isids(labelled(r.isids), "^(netif|node)$", regex=True).select("policy_id", "name", "type"), "SELECT policy_id, name, type FROM isids WHERE name IN ('netif', 'node')"),
    "bounds_search": (lambda r: c.find_bounds(every(r, r.bounds), "type", "^s1", True).select("policy_id", "parent", "child"), f"SELECT policy_id, parent, child FROM {IDS}, bounds WHERE kind = 'type' AND (parent LIKE 's1%' OR child LIKE 's1%')"),
    "default_object_search": (lambda r: c.find_default_objects(every(r, r.default_object), "size1", ["user", "type"], True).select("policy_id", "class"), f"SELECT policy_id, class FROM {IDS}, default_object WHERE contains(class, 'size1') AND default_user IS NOT NULL AND default_type IS NOT NULL"),
    "permissive_search": (lambda r: c.find_permissives(r.policy_types().withColumn("is_permissive", F.col("type").endswith("9")), "^s", True).select("policy_id", "type"), f"SELECT policy_id, type FROM {IDS}, types WHERE type LIKE 's%9'"),
    "polcap_search": (lambda r: c.find_polcaps(r.polcap, "ow|ig", True), "SELECT * FROM polcap WHERE regexp_matches(name, 'ow|ig')"),
    "namespace_symbols": (lambda r: c.symbols_in_namespace({k: (every(r, r.spaced_name.filter(F.col("kind") == k)), "name") for k in ("type", "role", "user")}, "Brand"), f"SELECT policy_id, kind, name FROM {IDS}, spaced_name WHERE starts_with(name, 'Brand.')"),
    "filename_trans_search": (lambda r: ru.find_filename_trans(filename_rules(r), RuleSearch(["type_transition"], source="^s[1-3]", regex=True), r.policy_types(), r.policy_type_attr(), "^file1").select("policy_id", "source", "target", "filename"), "SELECT policy_id, source, target, 'file' || substr(target, 2, 3) AS filename FROM terules WHERE regexp_matches(source, '^s[1-3]') AND target LIKE 'p1%'"),
    "filename_trans_rendered": (lambda r: rendered(ru.render_terule(filename_rules(r))), "SELECT policy_id, kind || ' ' || source || ' ' || target || ' : ' || class || ' ' || default_type || ' \"file' || substr(target, 2, 3) || '\";' AS text FROM terules"),
    "written_terules": (
        lambda r: ru.find_written_terules(written_te(r), RuleSearch(["type_transition"], source="n3", source_indirect=True, target="Brand_13", target_indirect=True), r.policy_types(), r.policy_type_attr()).select("policy_id", F.element_at("sources", 1).alias("source"), "default_type", F.size("targets").alias("targets")),
        "SELECT policy_id, source, default_type, count(DISTINCT target) AS targets FROM terules WHERE source IN (SELECT type FROM type_attr WHERE attr = 'n3') GROUP BY policy_id, source, class, default_type HAVING bool_or(target IN (SELECT type FROM type_attr WHERE attr = 'Brand_13'))",
    ),
    "rules_of_conditional": (lambda r: ru.rules_of_conditional(conditional_rules(r), 7, True).select("policy_id", "kind", "source", "target", "class"), f"SELECT DISTINCT policy_id, kind, source, target, class FROM avrule_perm WHERE class = 'file' AND {COND_KEY} = 7"),
    "show_conditional": (lambda r: ru.show_conditional(conditional_rules(r), cond_rows(r)).groupBy("policy_id", "condition").agg(F.count(F.lit(1)).alias("n")), f"SELECT v.policy_id, {COND_TEXT} AS condition, count(*) AS n FROM (SELECT DISTINCT policy_id, kind, source, target, class, {COND_KEY} AS k FROM avrule_perm) AS v LEFT JOIN conds AS c ON v.policy_id = c.policy_id AND v.k = c.cond_id GROUP BY ALL"),
    "conditionals_rendered": (
        lambda r: ru.render_conditional(ru.render_role_allow(r.role_allow).withColumns({"cond_id": F.length("target").cast("long"), "branch": F.col("source") < F.col("target")}), cond_rows(r)).select("policy_id", "cond_id", "text"),
        f"""SELECT c.policy_id, c.cond_id, 'if (' || {COND_TEXT} || ') {{' || chr(10) || coalesce(yes || chr(10), '') || '}}' || coalesce(' else {{' || chr(10) || no || chr(10) || '}}', '') AS text FROM conds AS c JOIN (
 SELECT policy_id, length(target) AS k, string_agg('  allow ' || source || ' ' || target || ';', chr(10) ORDER BY 'allow ' || source || ' ' || target || ';') FILTER (source < target) AS yes, string_agg('  allow ' || source || ' ' || target || ';', chr(10) ORDER BY 'allow ' || source || ' ' || target || ';') FILTER (source >= target) AS no
 FROM role_allow GROUP BY ALL) AS v ON v.policy_id = c.policy_id AND v.k = c.cond_id""",
    ),
    "labels_rendered": (
        lambda r: rendered(c.render_portcon(context_text(every(r, r.portcon)))).unionByName(rendered(c.render_netifcon(context_text(r.netifcon, ("if_context", "if_type"), ("msg_context", "msg_type"))))).unionByName(rendered(c.render_nodecon(context_text(r.nodecon)))).unionByName(rendered(c.render_genfscon(context_text(every(r, r.genfscon))))).unionByName(rendered(c.render_fs_use(context_text(every(r, r.fs_use))))).unionByName(rendered(c.render_isid(context_text(r.isids)))),
        f"""SELECT policy_id, 'portcon ' || proto || ' ' || low || '-' || high || ' ' || {CTX.format(t='type')} AS text FROM {IDS}, portcon UNION ALL SELECT policy_id, 'netifcon ' || name || ' ' || {CTX.format(t='if_type')} || ' ' || {CTX.format(t='msg_type')} FROM netifcon
 UNION ALL SELECT policy_id, 'nodecon ' || addr || ' ' || mask || ' ' || {CTX.format(t='type')} FROM nodecon UNION ALL SELECT policy_id, 'genfscon ' || fs || ' ' || path || CASE class WHEN 'dir' THEN ' -d ' ELSE ' -- ' END || {CTX.format(t='type')} FROM {IDS}, genfscon
 UNION ALL SELECT policy_id, behavior || ' ' || fs || ' ' || {CTX.format(t='type')} || ';' FROM {IDS}, fs_use UNION ALL SELECT policy_id, 'sid ' || name || ' ' || {CTX.format(t='type')} FROM isids""",
    ),
    "audit_criteria": (criteria, CRITERIA_SQL),
    "audit_malformed": (logs, f"SELECT regexp_replace({TEXT_SQL}, '  (denied|granted)  ', '  ') AS raw, 'decision' AS warnings FROM audit WHERE msg_type = 'AVC' AND msg_id % 2 = 1"),
    "diff_commons": (lambda r: sets(diff.diff_commons(r.common_perm.filter("NOT (policy_id = 'O' AND perm LIKE '%3')"), pairs(r))), sets_sql("SELECT policy_id, common AS key, perm AS v FROM common_perm WHERE NOT (policy_id = 'O' AND perm LIKE '%3')")),
    "diff_levels": (lambda r: sets(diff.diff_levels(policy_levels(r), pairs(r))), sets_sql(f"SELECT policy_id, sens AS key, cat AS v FROM ({POLICY_LEVELS})")),
    "diff_categories": (lambda r: sets(diff.diff_cats(policy_levels(r).select("policy_id", "cat").distinct(), pairs(r))), sets_sql(f"SELECT DISTINCT policy_id, cat AS key, '' AS v FROM ({POLICY_LEVELS})")),
    "diff_user_levels": (lambda r: sets(diff.diff_users(every(r, r.user_role), pairs(r), ranked_users(r))), sets_sql(RANKED)),
    "diff_line_numbers": (line_numbers, f"""{sets_sql(SIDE).split(' SELECT orig_id, mod_id, key, CASE')[0]}, changed AS (SELECT orig_id, mod_id, key, CASE WHEN NOT bool_or(o) THEN 'added' WHEN NOT bool_or(m) THEN 'removed' ELSE 'modified' END AS form FROM two GROUP BY ALL HAVING bool_or(NOT o) OR bool_or(NOT m))
 SELECT orig_id, mod_id, key, form, coalesce((SELECT CAST(max(n) AS VARCHAR) FROM rows_ AS x WHERE x.policy_id = orig_id AND x.key = changed.key), '') AS orig_lines, coalesce((SELECT CAST(max(n) AS VARCHAR) FROM rows_ AS x WHERE x.policy_id = mod_id AND x.key = changed.key), '') AS mod_lines FROM changed"""),
    "domtrans_between": (transition_pairs, f""", {WHOLE}, asked AS (SELECT policy_id, source AS a, target AS b FROM dom_edge WHERE edge = 'transition' AND source <> target)
 SELECT w.policy_id, w.start, w.ep, w."end", true AS forward FROM whole AS w JOIN asked ON asked.policy_id = w.policy_id AND a = w.start AND b = w."end" WHERE runs UNION ALL SELECT w.policy_id, w.start, w.ep, w."end", false FROM whole AS w JOIN asked ON asked.policy_id = w.policy_id AND b = w.start AND a = w."end" WHERE runs"""),
    "range_levels": (legal_levels, "SELECT low_rank, high_rank, 's' || k AS sens, coalesce((SELECT string_agg(cat, ',' ORDER BY cat) FROM level_cat WHERE sens = 's' || k AND cat IN ('c0', 'c1', 'c2', 'c3', 'c4', 'c5')), '') AS cats FROM (SELECT low_rank, high_rank, unnest(range(low_rank, high_rank + 1)) AS k FROM (SELECT DISTINCT low_rank, high_rank FROM range_trans WHERE high_rank < 5))"),
    "labels_by_range": (lambda r: labels.query_labels(r.file_labels, LabelSearch(range="s0-s1:c0.c3", relation="exact")).select("inode", "rng"), "SELECT inode, rng FROM file_labels WHERE rng <> 's0'"),
    "labels_of_policy": (lambda r: labels.associate_policy(r.file_labels, r.audit.select("host").distinct().withColumn("policy_id", F.when(F.substring("host", 2, 1).cast("int") % 2 == 0, "F").otherwise("O"))).groupBy("policy_id", "type").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN h.host IS NOT NULL THEN CASE WHEN CAST(substr(f.host, 2, 1) AS INT) % 2 = 0 THEN 'F' ELSE 'O' END END AS policy_id, type, count(*) AS n FROM file_labels AS f LEFT JOIN (SELECT DISTINCT host FROM audit) AS h ON f.host = h.host GROUP BY 1, 2"),
}
