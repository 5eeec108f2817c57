"""Registered queries over differences between snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions import mls
from warder.operators import diff
from warder.plans.fixtures import Relations
from warder.plans.rule_queries import conds

#: The modified snapshot has another name for some types, told as aliases, and lacks some.
RENAMED, GONE = "type IN ('p10', 'p20', 's10')", "type IN ('p33', 's33')"


def pairs(r: Relations) -> DataFrame:
    return r.spark.createDataFrame([("F", "O")], "orig_id string, mod_id string")


def in_mod(col: str = "policy_id") -> Column:
    return F.col(col) == "O"


def types(r: Relations) -> DataFrame:
    t = r.policy_types().filter("policy_id <> 'P'")
    t = t.filter(~(in_mod() & F.expr(GONE)))
    old = F.col("type")
    renamed = in_mod() & F.expr(RENAMED)
    return t.withColumn("aliases", F.when(renamed, F.array(old)).otherwise(F.array().cast("array<string>"))).withColumn("type", F.when(renamed, F.concat(old, F.lit("_new"))).otherwise(old))


def rename(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.when(in_mod() & F.expr(RENAMED.replace("type", c)), F.concat(F.col(c), F.lit("_new"))).otherwise(F.col(c)))
    return df


def type_attr(r: Relations) -> DataFrame:
    t = r.policy_type_attr().filter("policy_id <> 'P'").filter(~(in_mod() & F.expr(GONE)))
    # the modified snapshot gives types that end in 5 a further attribute
    more = t.filter(in_mod() & F.col("type").endswith("5")).select("policy_id", "type", F.lit("extra").alias("attr")).distinct()
    return rename(t.unionByName(more), "type")


def ids(r: Relations) -> DataFrame:
    return diff.type_map(types(r), pairs(r), diff.type_remap_infer(types(r), pairs(r)))


def flat(found: DataFrame, *more: str) -> DataFrame:
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return found.select(*more, "component", "key", "form", join("added"), join("removed"), join("unmodified"))


def role_type(r: Relations) -> DataFrame:
    both = r.role_type.crossJoin(F.broadcast(r.spark.sql("SELECT explode(array('F', 'O')) AS policy_id")))
    return rename(both.filter(~(in_mod() & F.col("type").endswith("7"))), "type")


def user_role(r: Relations) -> DataFrame:
    both = r.user_role.crossJoin(F.broadcast(r.spark.sql("SELECT explode(array('F', 'O')) AS policy_id")))
    return both.filter(~(in_mod() & (F.col("role") == "ASIA_r")))


def ranges(r: Relations) -> DataFrame:
    level = lambda c: mls.level(F.lit("s"), F.col(c).cast("int"), F.array(F.lit("c0")))
    return r.range_trans.withColumn("range", mls.level_range(level("low_rank"), level("high_rank")))


def rules(r: Relations) -> DataFrame:
    return rename(r.grouped_rules().filter("policy_id <> 'P'"), "source", "target")


def av(r: Relations, kind: str) -> DataFrame:
    return diff.diff_avrules(rules(r), type_attr(r), pairs(r), ids(r), kind)


def te(r: Relations) -> DataFrame:
    t = r.terules.withColumns({"cond_id": F.lit(None).cast("long"), "branch": F.lit(None).cast("boolean")}).filter("policy_id <> 'P'")
    return diff.diff_terules(rename(t, "source", "target", "default_type"), type_attr(r), pairs(r), ids(r))


def role_allow(r: Relations) -> DataFrame:
    """The modified snapshot lacks some rules and has others."""
    more = r.role_allow.filter(in_mod()).select("policy_id", "source").distinct().withColumn("target", F.lit("guest_r"))
    return r.role_allow.filter(~(in_mod() & (F.col("source") == "ASIA_r") & (F.col("target") == "EUROPE_r"))).unionByName(more.filter("source <> 'AFRICA_r'"))


def stats(r: Relations) -> DataFrame:
    found = reduce(lambda a, b: a.unionByName(b), [av(r, "auditallow"), diff.diff_role_allow(role_allow(r), pairs(r)), diff.diff_users(user_role(r), pairs(r))])
    return diff.diff_stats(found).drop("orig_id", "mod_id")


def all_pairs(r: Relations) -> DataFrame:
    """All ordered pairs of the snapshots that have rules."""
    p = r.avrule_perm.select("policy_id").distinct()
    return p.select(F.col("policy_id").alias("orig_id")).crossJoin(p.select(F.col("policy_id").alias("mod_id"))).filter("orig_id <> mod_id")


def long_conds(r: Relations) -> DataFrame:
    """Conditions of up to seven booleans: each with the two that follow. One snapshot writes half
    of them in another order and negated, and changes two."""
    c = conds(r).withColumn("cond_id", F.col("cond_id").cast("long"))
    after = lambda n: c.select("policy_id", F.pmod(F.col("cond_id") + 12 - n, F.lit(12)).alias("cond_id"), F.col("expr").alias(f"expr{n}"))
    three = c.join(after(1), ["policy_id", "cond_id"]).join(after(2), ["policy_id", "cond_id"])
    op = lambda *ops: F.array(*[F.struct(F.lit(o).alias("op"), F.lit(None).cast("string").alias("name")) for o in ops])
    other = F.when(in_mod() & (F.col("cond_id") % 2 == 0), F.concat("expr2", "expr1", "expr", op("^", "||", "!"))).when(in_mod() & (F.col("cond_id") % 3 == 0), F.concat("expr", "expr1", op("^"), "expr2", op("&&")))
    return three.select("policy_id", "cond_id", other.otherwise(F.concat("expr", "expr1", op("^"), "expr2", op("||"))).alias("expr"))


def conditional(r: Relations) -> DataFrame:
    """Differences of conditional rules between all snapshots, by the meaning of conditions."""
    key = F.pmod(F.ascii(F.substring("source", -1, 1)) + F.length("target"), F.lit(12)).cast("long")
    rows = r.grouped_rules().withColumn("cond_id", key).withColumn("branch", (F.col("class") == "file") != (in_mod() & (F.col("cond_id") % 2 == 0)))
    of = all_pairs(r)
    names = diff.type_map(r.policy_types(), of, diff.type_remap_infer(r.policy_types(), of))
    found = diff.diff_avrules(rows, r.policy_type_attr(), of, names, "auditallow", long_conds(r))
    return flat(found.withColumn("key", F.substring_index("key", " ", 3)), "orig_id", "mod_id")


def renamed_types(r: Relations) -> DataFrame:
    """Types whose names and aliases change between snapshot F and the others, in six ways."""
    first, t = F.col("policy_id") == "F", F.col("type")
    n = F.regexp_extract("type", "([0-9]+)", 1).cast("int") % 6
    end = lambda x: F.concat(t, F.lit(x))
    name = F.when(first, F.when(n == 2, end("_old")).when(n > 2, end("_a"))).otherwise(F.when(n == 1, end("_new")).when(n > 2, end("_b")))
    both = F.array(end("_x"), end("_y"))
    known = F.when(first, F.when(n == 2, F.array(t)).when(n.isin(3, 4), both)).otherwise(F.when(n == 1, F.array(t)).when(n == 3, F.reverse(both)).when(n == 4, F.array(end("_x"))))
    plain = r.policy_types().filter("not is_attr")
    return plain.select("policy_id", F.coalesce(name, t).alias("type"), "is_attr", F.coalesce(known, F.array().cast("array<string>")).alias("aliases"))


def same(col: str) -> str:
    """The shared name of a type of F or O, in SQL."""
    return f"CASE WHEN {col} IN ('p33', 's33') THEN '-' || {col} ELSE {col} END"


def compare(one: str, two: str, key: str, component: str, lone: str | None = None) -> str:
    """Full outer comparison of (key, v) sets in SQL."""
    added = "'add_by_type'" if lone else "'added'"
    form = "CASE WHEN NOT bool_or(o) THEN 'added' WHEN NOT bool_or(m) THEN 'removed' ELSE 'modified' END"
    if lone:
        form = f"CASE WHEN NOT bool_or(o) THEN CASE WHEN {lone} THEN {added} ELSE 'added' END WHEN NOT bool_or(m) THEN CASE WHEN {lone} THEN 'remove_by_type' ELSE 'removed' END ELSE 'modified' END"
    part = lambda test: f"coalesce(string_agg(v, ',' ORDER BY v) FILTER ({test}), '')"
    return f"""SELECT '{component}' AS component, key, {form} AS form, {part('NOT o')} AS added, {part('NOT m')} AS removed, {part('o AND m')} AS unmodified
 FROM (SELECT {key} AS key, v, bool_or(side = 1) AS o, bool_or(side = 2) AS m FROM (SELECT *, 1 AS side FROM ({one}) UNION ALL SELECT *, 2 AS side FROM ({two})) GROUP BY ALL) GROUP BY key HAVING bool_or(NOT o) OR bool_or(NOT m)"""


ATTR_F = "SELECT type, attr FROM type_attr"
ATTR_O = f"SELECT type, attr FROM type_attr WHERE NOT ({GONE}) UNION SELECT type, 'extra' FROM type_attr WHERE type LIKE '%5' AND NOT ({GONE})"


def av_sql(kind: str) -> str:
    def side(policy: str, attrs: str) -> str:
        source, target = ("x.source", "x.target")
        mark = (lambda c: same(c)) if policy == "F" else (lambda c: f"CASE WHEN {c} IN ('p33', 's33') THEN {c} ELSE {c} END")
        return f"SELECT {mark(source)} AS source, {mark(target)} AS target, x.class, x.perm AS v FROM (SELECT DISTINCT a.source, coalesce(t.type, a.target) AS target, a.class, a.perm FROM avrule_perm AS a LEFT JOIN ({attrs}) AS t ON a.target = t.attr WHERE a.policy_id = '{policy}' AND a.kind = '{kind}') AS x"

    return compare(side("F", ATTR_F), side("O", ATTR_O), "source || ' ' || target || ' ' || class || ' '", kind, "key LIKE '-%' OR key LIKE '% -%'")


TE_SQL = compare(
    f"SELECT {same('source')} AS source, {same('target')} AS target, class, {same('default_type')} AS v FROM terules WHERE policy_id = 'F'",
    "SELECT source, target, class, default_type AS v FROM terules WHERE policy_id = 'O'",
    "source || ' ' || target || ' ' || class || ' '",
    "type_transition",
    "key LIKE '-%' OR key LIKE '% -%'",
)
RANGE = "SELECT {s} AS source, {t} AS target, class, unnest(list_append(list_transform(range(low_rank, high_rank + 1), lambda k: k || ':c0'), 'least:c0')) AS v FROM range_trans WHERE policy_id = '{p}'"
RANGE_SQL = compare(RANGE.format(s=same("source"), t=same("target"), p="F"), RANGE.format(s="source", t="target", p="O"), "source || ' ' || target || ' ' || class", "range_trans", "key LIKE '-%' OR key LIKE '% -%'")
ALLOW_SQL = compare("SELECT source, target AS v FROM role_allow WHERE policy_id = 'F'", "SELECT source, target AS v FROM role_allow WHERE policy_id = 'O' AND NOT (source = 'ASIA_r' AND target = 'EUROPE_r') UNION SELECT source, 'guest_r' FROM role_allow WHERE policy_id = 'O' AND source <> 'AFRICA_r'", "source", "role_allow")
USER_SQL = compare("SELECT user_name, role AS v FROM user_role", "SELECT user_name, role AS v FROM user_role WHERE role <> 'ASIA_r'", "user_name", "user")

BIT = "(m >> CAST(right({}, 1) AS INT)) & 1 = 1"
ONE = f"CASE {{c}}.op WHEN '&&' THEN {BIT.format('{c}.bool_a')} AND NOT {BIT.format('{c}.bool_b')} WHEN '||' THEN {BIT.format('{c}.bool_a')} OR NOT {BIT.format('{c}.bool_b')} ELSE ({BIT.format('{c}.bool_a')}) <> (NOT ({BIT.format('{c}.bool_b')})) END"
CONDITIONAL_SQL = f""", truth AS (
  SELECT a.policy_id, a.cond_id, m, list_sort(list_distinct([a.bool_a, a.bool_b, b.bool_a, b.bool_b, c.bool_a, c.bool_b])) AS names,
   CASE WHEN a.policy_id = 'O' AND a.cond_id IN (3, 9) THEN (({ONE.format(c='a')}) <> ({ONE.format(c='b')})) AND ({ONE.format(c='c')}) ELSE (({ONE.format(c='a')}) <> ({ONE.format(c='b')})) OR ({ONE.format(c='c')}) END AS v
  FROM conds AS a JOIN conds AS b ON a.policy_id = b.policy_id AND b.cond_id = (a.cond_id + 1) % 12 JOIN conds AS c ON a.policy_id = c.policy_id AND c.cond_id = (a.cond_id + 2) % 12, range(128) AS r(m)),
 ident AS (SELECT policy_id, cond_id, branch, CAST(names AS VARCHAR) || string_agg(CASE WHEN v = branch THEN '1' ELSE '0' END, '' ORDER BY m) AS id FROM truth, (VALUES (true), (false)) AS b(branch) GROUP BY policy_id, cond_id, branch, names),
 side AS (SELECT DISTINCT a.policy_id, a.source || ' ' || coalesce(t.type, a.target) || ' ' || a.class AS key, coalesce(i.id, '') AS id, a.perm AS v
  FROM avrule_perm AS a LEFT JOIN type_attr AS t ON a.target = t.attr LEFT JOIN ident AS i ON i.policy_id = a.policy_id AND i.cond_id = (ascii(right(a.source, 1)) + length(a.target)) % 12 AND i.branch = (a.class = 'file') WHERE a.kind = 'auditallow'),
 both_ AS (SELECT p.orig_id, p.mod_id, key, id, v, bool_or(s.policy_id = p.orig_id) AS o, bool_or(s.policy_id = p.mod_id) AS m
  FROM (SELECT a.policy_id AS orig_id, b.policy_id AS mod_id FROM (SELECT DISTINCT policy_id FROM avrule_perm) AS a, (SELECT DISTINCT policy_id FROM avrule_perm) AS b WHERE a.policy_id <> b.policy_id) AS p
  JOIN side AS s ON s.policy_id IN (p.orig_id, p.mod_id) GROUP BY ALL)
 SELECT orig_id, mod_id, 'auditallow' AS component, key, CASE WHEN NOT bool_or(o) THEN 'added' WHEN NOT bool_or(m) THEN 'removed' ELSE 'modified' END AS form,
  coalesce(string_agg(v, ',' ORDER BY v) FILTER (NOT o), '') AS added, coalesce(string_agg(v, ',' ORDER BY v) FILTER (NOT m), '') AS removed, coalesce(string_agg(v, ',' ORDER BY v) FILTER (o AND m), '') AS unmodified
 FROM both_ GROUP BY orig_id, mod_id, key, id HAVING bool_or(NOT o) OR bool_or(NOT m)"""
REMAP_SQL = """SELECT mod_id, CASE WHEN k = 2 THEN type || '_old' WHEN k = 3 THEN type || '_a' ELSE type END AS orig_type, CASE WHEN k = 1 THEN type || '_new' WHEN k = 3 THEN type || '_b' ELSE type END AS mod_type
 FROM (SELECT DISTINCT type, CAST(regexp_extract(type, '([0-9]+)', 1) AS INT) % 6 AS k FROM types WHERE NOT is_attr), (VALUES ('O'), ('P')) AS v(mod_id) WHERE k < 4"""

QUERIES = {
    "diff_conditional": (conditional, CONDITIONAL_SQL),
    "type_remap_passes": (lambda r: diff.type_remap_infer(renamed_types(r), all_pairs(r).filter("orig_id = 'F'")).select("mod_id", "orig_type", "mod_type"), REMAP_SQL),
    "type_remap": (
        lambda r: diff.type_remap_infer(types(r), pairs(r)).select("orig_type", "mod_type"),
        f"SELECT DISTINCT type AS orig_type, CASE WHEN {RENAMED} THEN type || '_new' ELSE type END AS mod_type FROM types WHERE NOT is_attr AND NOT ({GONE})",
    ),
    "diff_types": (lambda r: flat(diff.diff_types(types(r), type_attr(r), pairs(r), ids(r))), compare(f"SELECT {same('type')} AS type, attr AS v FROM ({ATTR_F})", f"SELECT type, attr AS v FROM ({ATTR_O})", "type", "type")),
    "diff_attribs": (lambda r: flat(diff.diff_attribs(type_attr(r), pairs(r), ids(r))), compare(f"SELECT attr, {same('type')} AS v FROM ({ATTR_F})", f"SELECT attr, type AS v FROM ({ATTR_O})", "attr", "attribute")),
    "diff_roles": (lambda r: flat(diff.diff_roles(role_type(r), pairs(r), ids(r))), compare(f"SELECT role, {same('type')} AS v FROM role_type", "SELECT role, type AS v FROM role_type WHERE type NOT LIKE '%7'", "role", "role")),
    "diff_users": (lambda r: flat(diff.diff_users(user_role(r), pairs(r))), USER_SQL),
    "diff_bools": (lambda r: flat(diff.diff_bools(r.bools.withColumn("state", F.col("state") != (in_mod() & (F.col("bool") == "b3"))), pairs(r))), compare("SELECT bool, CAST(state AS VARCHAR) AS v FROM bools WHERE policy_id = 'F'", "SELECT bool, CAST(state <> (bool = 'b3') AS VARCHAR) AS v FROM bools WHERE policy_id = 'O'", "bool", "boolean")),
    "diff_classes": (lambda r: flat(diff.diff_classes(r.avrule_perm.filter("NOT (policy_id = 'O' AND perm = 'append')").select("policy_id", "class", "perm").distinct(), pairs(r))), compare("SELECT DISTINCT class, perm AS v FROM avrule_perm WHERE policy_id = 'F'", "SELECT DISTINCT class, perm AS v FROM avrule_perm WHERE policy_id = 'O' AND perm <> 'append'", "class", "class")),
    "diff_av": (lambda r: flat(av(r, "allow")), av_sql("allow")),
    "diff_auditallow": (lambda r: flat(av(r, "auditallow")), av_sql("auditallow")),
    "diff_dontaudit": (lambda r: flat(av(r, "dontaudit")), av_sql("dontaudit")),
    "diff_neverallow": (lambda r: flat(av(r, "neverallow")), av_sql("neverallow")),
    "diff_te": (lambda r: flat(te(r)), TE_SQL),
    "diff_role_allow": (lambda r: flat(diff.diff_role_allow(role_allow(r), pairs(r))), ALLOW_SQL),
    "diff_role_trans": (lambda r: flat(diff.diff_role_trans(rename(r.role_trans.filter("policy_id <> 'P'"), "target_type"), pairs(r), ids(r))), compare(f"SELECT source, {same('target_type')} AS target, default_role AS v FROM role_trans WHERE policy_id = 'F'", "SELECT source, target_type AS target, default_role AS v FROM role_trans WHERE policy_id = 'O'", "source || ' ' || target", "role_trans", "key LIKE '% -%'")),
    "diff_range_trans": (lambda r: flat(diff.diff_range_trans(rename(ranges(r).filter("policy_id <> 'P'"), "source", "target"), pairs(r), ids(r))), RANGE_SQL),
    "diff_stats": (stats, "SELECT component, count(*) FILTER (form = 'added') AS added, count(*) FILTER (form = 'removed') AS removed, count(*) FILTER (form = 'modified') AS modified, count(*) FILTER (form = 'add_by_type') AS add_by_type, count(*) FILTER (form = 'remove_by_type') AS remove_by_type FROM (" + " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (av_sql("auditallow"), ALLOW_SQL, USER_SQL)) + ") GROUP BY component"),
    "diff_rendered": (lambda r: diff.render_diff(diff.diff_users(user_role(r), pairs(r))).select("text"), "SELECT CASE form WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE '*' END || ' ' || key || ' { ' || concat_ws(' ', CASE WHEN added <> '' THEN '+' || replace(added, ',', ' +') END, CASE WHEN removed <> '' THEN '-' || replace(removed, ',', ' -') END, CASE WHEN unmodified <> '' THEN replace(unmodified, ',', ' ') END) || ' }' AS text FROM (" + USER_SQL + ")"),
}
