"""Policy checks: a registry of functions from policy tables to findings.

Tables by name: types, type_attr, rules (access rules with perms), terules, roles, role_type,
users, user_role, role_allow, role_trans, range_trans, isids, netifcon, nodecon, portcon,
label_specs, constraints. A check runs only if the tables that it needs are there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions.predicates import expand_type
from warder.functions.state import written
from warder.operators import transitions as tr
from warder.operators.dominance import covered

SEVERITIES = ["none", "low", "medium", "high"]
COLUMNS = ["policy_id", "check", "severity", "item_type", "item", "proof_type", "proof_text", "element"]
FREE_ROLE = "object_r"

#: What the checks take for given; each can be overridden.
OPTIONS = {
    "domain_attribute": "domain",
    "file_attribute": "file_type",
    "net_classes": ["netif", "tcp_socket", "udp_socket", "node", "association"],
    "needs_change": True,
    "exempt_domains": [],
}


@dataclass
class Check:
    name: str
    severity: str
    needs: list[str]
    run: Callable[[dict[str, DataFrame], dict], DataFrame]


REGISTRY: dict[str, Check] = {}


def check(name: str, severity: str, needs: list[str]):
    def keep(run):
        REGISTRY[name] = Check(name, severity, needs, run)
        return run

    return keep


def found(df: DataFrame, item_type: str | Column, item: str | Column, proof_type: str, proof: str | Column, element: str | Column = "") -> DataFrame:
    """Findings without check and severity."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    kind = F.lit(item_type) if isinstance(item_type, str) else item_type
    return df.select("policy_id", kind.alias("item_type"), (F.col(item) if isinstance(item, str) else item).alias("item"), F.lit(proof_type).alias("proof_type"), text(proof).alias("proof_text"), text(element).alias("element")).distinct()


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_checks(tables: dict[str, DataFrame], names: list[str] | None = None, options: dict | None = None, min_severity: str = "none") -> DataFrame:
    """Findings of the named checks (all that have their tables)."""
    opts = OPTIONS | (options or {})
    parts = []
    for c in REGISTRY.values():
        if (names is None or c.name in names) and SEVERITIES.index(c.severity) >= SEVERITIES.index(min_severity):
            if set(c.needs) <= set(tables):
                rows = c.run(tables, opts)
                parts.append(rows.select("policy_id", F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), "item_type", "item", "proof_type", "proof_text", "element"))
            elif names is not None:
                raise ValueError(f"{c.name} needs {sorted(set(c.needs) - set(tables))}")
    return together(parts)


def check_report(findings: DataFrame, min_severity: str = "none") -> DataFrame:
    """Number of items and proofs for each check of at least a severity."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.filter(rank > SEVERITIES.index(min_severity)).groupBy("policy_id", "check", "severity").agg(F.countDistinct("item").alias("items"), F.count(F.lit(1)).alias("proofs"))


def real_types(t) -> DataFrame:
    return t["types"].filter("not is_attr").select("policy_id", "type")


def by_attribute(t, name: str) -> DataFrame:
    return t["type_attr"].filter(F.col("attr") == name)


def sources(t, rules: DataFrame) -> DataFrame:
    """Concrete source types of rules."""
    return expand_type(rules.select("policy_id", "source").distinct(), "source", t["type_attr"]).distinct()


@check("find_domains", "none", ["types", "type_attr", "rules", "terules", "role_type"])
def find_domains(t, o):
    rules = t["rules"].filter(F.col("class") != "filesystem")
    return together(
        [
            found(by_attribute(t, o["domain_attribute"]), "type", "type", "attribute", o["domain_attribute"]),
            found(sources(t, rules), "type", "source", "rule", "source of an access rule"),
            found(t["terules"].filter("class = 'process'"), "type", "default_type", "rule", "default of a process type rule"),
            found(t["role_type"].filter(F.col("role") != FREE_ROLE), "type", "type", "role", F.col("role")),
        ]
    )


@check("find_file_types", "none", ["types", "type_attr", "rules", "terules"])
def find_file_types(t, o):
    associate = t["rules"].filter((F.col("class") == "filesystem") & F.array_contains("perms", "associate"))
    parts = [
        found(by_attribute(t, o["file_attribute"]), "type", "type", "attribute", o["file_attribute"]),
        found(sources(t, associate), "type", "source", "rule", "filesystem associate"),
        found(t["terules"].filter("class <> 'process'"), "type", "default_type", "rule", "default of a type rule"),
    ]
    if "label_specs" in t:
        parts.append(found(t["label_specs"].filter("type is not null"), "type", "type", "label", "named in label specs"))
    return together(parts)


@check("find_net_domains", "none", ["types", "type_attr", "rules"])
def find_net_domains(t, o):
    net = t["rules"].filter((F.col("kind") == "allow") & F.col("class").isin(o["net_classes"]))
    return found(sources(t, net), "type", "source", "rule", "source of a network rule")


def _labelled(t, sid: str, statements: list[tuple[str, str]]) -> DataFrame:
    parts = [found(t["isids"].filter(F.col("name") == sid), "type", "type", "initial sid", sid)]
    parts += [found(t[table], "type", column, "statement", table) for table, column in statements]
    return together(parts)


@check("find_assoc_types", "none", ["isids"])
def find_assoc_types(t, o):
    return _labelled(t, "unlabeled", [])


@check("find_netif_types", "none", ["isids", "netifcon"])
def find_netif_types(t, o):
    return _labelled(t, "netif", [("netifcon", "if_type"), ("netifcon", "msg_type")])


@check("find_node_types", "none", ["isids", "nodecon"])
def find_node_types(t, o):
    return _labelled(t, "node", [("nodecon", "type")])


@check("find_port_types", "none", ["isids", "portcon"])
def find_port_types(t, o):
    return _labelled(t, "port", [("portcon", "type")])


def items(df: DataFrame) -> DataFrame:
    return df.select("policy_id", F.col("item").alias("type")).distinct()


@check("domain_and_file", "low", ["types", "type_attr", "rules", "terules", "role_type"])
def domain_and_file(t, o):
    both = items(find_domains(t, o)).join(items(find_file_types(t, o)), ["policy_id", "type"])
    return found(both, "type", "type", "type", "both a domain and a file type")


@check("domains_wo_roles", "medium", ["types", "type_attr", "rules", "terules", "role_type"])
def domains_wo_roles(t, o):
    named = t["role_type"].filter(F.col("role") != FREE_ROLE).select("policy_id", "type")
    return found(items(find_domains(t, o)).join(named, ["policy_id", "type"], "left_anti"), "type", "type", "role", "in no role")


def attributes(t) -> DataFrame:
    return t["types"].filter("is_attr").select("policy_id", F.col("type").alias("attr"))


@check("attribs_wo_types", "low", ["types", "type_attr"])
def attribs_wo_types(t, o):
    return found(attributes(t).join(t["type_attr"], ["policy_id", "attr"], "left_anti"), "attribute", "attr", "type", "no member")


@check("attribs_wo_rules", "low", ["types", "type_attr", "rules", "terules"])
def attribs_wo_rules(t, o):
    used = [t["rules"].select("policy_id", F.col(c).alias("attr")) for c in ("source", "target")]
    used += [t["terules"].select("policy_id", F.col(c).alias("attr")) for c in ("source", "target")]
    if "role_attr" in t:
        used.append(t["role_attr"].select("policy_id", "attr"))
    if "constraints" in t:
        used.append(t["constraints"].select("policy_id", F.explode(F.flatten(F.transform("expr", lambda x: F.coalesce(x["names"], F.array().cast("array<string>"))))).alias("attr")))
    return found(attributes(t).join(together(used), ["policy_id", "attr"], "left_anti"), "attribute", "attr", "rule", "in no rule")


@check("types_wo_allow", "low", ["types", "type_attr", "rules"])
def types_wo_allow(t, o):
    allow = t["rules"].filter("kind = 'allow'")
    used = [expand_type(allow.select("policy_id", F.col(c).alias("type")).distinct(), "type", t["type_attr"]) for c in ("source", "target")]
    return found(real_types(t).join(together(used), ["policy_id", "type"], "left_anti"), "type", "type", "rule", "in no allow rule")


def real_roles(t) -> DataFrame:
    return t["roles"].filter(F.col("role") != FREE_ROLE).select("policy_id", "role")


@check("roles_wo_allow", "low", ["roles", "role_allow"])
def roles_wo_allow(t, o):
    used = together([t["role_allow"].select("policy_id", F.col(c).alias("role")) for c in ("source", "target")])
    return found(real_roles(t).join(used, ["policy_id", "role"], "left_anti"), "role", "role", "rule", "in no role allow rule")


@check("roles_wo_types", "low", ["roles", "role_type"])
def roles_wo_types(t, o):
    return found(real_roles(t).join(t["role_type"], ["policy_id", "role"], "left_anti"), "role", "role", "type", "no type")


@check("roles_wo_users", "low", ["roles", "user_role"])
def roles_wo_users(t, o):
    return found(real_roles(t).join(t["user_role"], ["policy_id", "role"], "left_anti"), "role", "role", "user", "no user")


@check("users_wo_roles", "low", ["users", "user_role"])
def users_wo_roles(t, o):
    return found(t["users"].join(t["user_role"], ["policy_id", "user_name"], "left_anti"), "user", "user_name", "role", "no role")


@check("spurious_audit", "low", ["rules", "type_attr"])
def spurious_audit(t, o):
    """dontaudit permissions that are allowed, and auditallow permissions that are not."""
    wide = expand_type(expand_type(t["rules"].filter(F.col("kind").isin("allow", "auditallow", "dontaudit")), "target", t["type_attr"]), "source", t["type_attr"])
    key = ["policy_id", "source", "target", "class", "perm"]
    perm = wide.select("kind", "policy_id", "source", "target", "class", F.explode("perms").alias("perm"))
    has = perm.groupBy(*key).agg(F.bool_or(F.col("kind") == "allow").alias("allow"), F.bool_or(F.col("kind") == "auditallow").alias("audit"), F.bool_or(F.col("kind") == "dontaudit").alias("dont"))
    what = lambda kind, why: F.struct(F.lit(kind).alias("kind"), F.lit(why).alias("why"))
    wrong = F.array_compact(F.array(F.when(F.col("dont") & F.col("allow"), what("dontaudit", "allowed but not to be audited")), F.when(F.col("audit") & ~F.col("allow"), what("auditallow", "audited but not allowed"))))
    rows = has.select("*", F.explode(wrong).alias("x"))
    return found(rows, F.col("x.kind"), F.concat_ws(" ", "source", "target", "class"), "permission", F.col("x.why"), F.col("perm"))


@check("inc_mount", "medium", ["rules", "type_attr"])
def inc_mount(t, o):
    allow = expand_type(expand_type(t["rules"].filter("kind = 'allow'"), "target", t["type_attr"]), "source", t["type_attr"])
    own = lambda cls, perm: F.bool_or((F.col("class") == cls) & F.array_contains("perms", perm))
    has = allow.filter(F.col("class").isin("filesystem", "dir")).groupBy("policy_id", "source", "target").agg(own("filesystem", "mount").alias("mount"), own("dir", "mounton").alias("mounton"))
    return found(has.filter("mount <> mounton"), "type", "source", "permission", F.when(F.col("mount"), "lacks dir mounton").otherwise("lacks filesystem mount"), F.col("target"))


def role_paths(t, rows: DataFrame) -> DataFrame:
    """Mark transitions whose domains share a role with a user (``common``), or are joined by a
    role_transition on the entrypoint with role allow and a common user (``changed``)."""
    roles = t["role_type"].filter(F.col("role") != FREE_ROLE).select("policy_id", "type", "role")
    users = t["user_role"].select("policy_id", "role", "user_name")
    live = roles.join(users.select("policy_id", "role").distinct(), ["policy_id", "role"], "left_semi")
    a = live.withColumnRenamed("type", "start")
    b = live.withColumnRenamed("type", "end")
    pairs = rows.select("policy_id", "start", "end", "ep").distinct()
    common = pairs.join(a, ["policy_id", "start"]).join(b, ["policy_id", "end", "role"]).select("policy_id", "start", "end", "ep").distinct().withColumn("common", F.lit(True))
    change = t["role_trans"].select("policy_id", F.col("source").alias("from_role"), F.col("target_type").alias("ep"), F.col("default_role").alias("to_role"))
    may = t["role_allow"].select("policy_id", F.col("source").alias("from_role"), F.col("target").alias("to_role"))
    both = users.select("policy_id", "user_name", F.col("role").alias("from_role")).join(users.select("policy_id", "user_name", F.col("role").alias("to_role")), ["policy_id", "user_name"]).select("policy_id", "from_role", "to_role").distinct()
    ways = change.join(may, ["policy_id", "from_role", "to_role"], "left_semi").join(both, ["policy_id", "from_role", "to_role"], "left_semi")
    changed = pairs.join(ways, ["policy_id", "ep"]).join(roles.select("policy_id", F.col("type").alias("start"), F.col("role").alias("from_role")), ["policy_id", "start", "from_role"], "left_semi")
    changed = changed.join(roles.select("policy_id", F.col("type").alias("end"), F.col("role").alias("to_role")), ["policy_id", "end", "to_role"], "left_semi")
    changed = changed.select("policy_id", "start", "end", "ep").distinct().withColumn("changed", F.lit(True))
    return rows.join(common, ["policy_id", "start", "end", "ep"], "left").join(changed, ["policy_id", "start", "end", "ep"], "left")


@check("inc_dom_trans", "medium", ["rules", "terules", "type_attr", "role_type", "user_role", "role_allow", "role_trans"])
def inc_dom_trans(t, o):
    """Transitions that lack a part, and whole ones that no role and user can take."""
    rows = tr.transitions(tr.edge_tables(t["rules"], t["terules"], t["type_attr"]), o["needs_change"])
    part = tr.missing_parts(rows.filter("not valid"))
    item = F.concat_ws(" ", "start", F.coalesce("ep", F.lit("?")), "end")
    lacks = found(part.select("policy_id", "start", "ep", "end", F.explode("missing").alias("what")), "transition", item, "missing", F.col("what"))
    stuck = role_paths(t, rows.filter("valid")).filter("common is null and changed is null")
    return lacks.unionByName(found(stuck, "transition", item, "role", "no role and user for both domains"))


#: Permissions by what they are on, the domain itself or a labelled type, and class; each
#: profile needs all of one side (fixed values).
NET_PROFILES = {
    "tcp": {
        ("self", "sock_file"): ["read", "write", "getattr"],
        ("self", "tcp_socket"): ["read", "write", "create"],
        ("netif", "netif"): ["tcp_send", "tcp_recv"],
        ("node", "node"): ["tcp_send", "tcp_recv"],
        ("port", "tcp_socket"): ["send_msg", "recv_msg"],
        ("assoc", "association"): ["sendto", "recvfrom"],
    },
    "udp_send": {
        ("self", "sock_file"): ["write", "getattr"],
        ("self", "udp_socket"): ["write", "create"],
        ("netif", "netif"): ["udp_send"],
        ("node", "node"): ["udp_send"],
        ("port", "udp_socket"): ["send_msg"],
        ("assoc", "association"): ["sendto"],
    },
    "udp_recv": {
        ("self", "sock_file"): ["read", "getattr"],
        ("self", "udp_socket"): ["read", "create"],
        ("netif", "netif"): ["udp_recv"],
        ("node", "node"): ["udp_recv"],
        ("port", "udp_socket"): ["recv_msg"],
        ("assoc", "association"): ["recvfrom"],
    },
}
#: What is specific to a profile and so asks for the rest of it (fixed values).
NET_SPECIFIC = {"tcp": ["tcp_socket", "tcp_send", "tcp_recv"], "udp_send": ["udp_send"], "udp_recv": ["udp_recv"]}


@check("inc_net_access", "medium", ["rules", "types", "type_attr", "isids", "netifcon", "nodecon", "portcon"])
def inc_net_access(t, o):
    """Network domains with some of a profile's specific permissions but not all it needs, each
    on the domain itself or on a type of interfaces, nodes, ports or associations."""
    need = ", ".join(f"('{p}', '{place}', '{c}', '{x}')" for p, parts in NET_PROFILES.items() for (place, c), perms in parts.items() for x in perms)
    need = F.broadcast(t["rules"].sparkSession.sql(f"SELECT * FROM VALUES {need} AS v (profile, place, class, perm)"))
    wide = expand_type(expand_type(t["rules"].filter("kind = 'allow'"), "target", t["type_attr"]), "source", t["type_attr"])
    wide = wide.select("policy_id", "source", "target", "class", F.explode("perms").alias("perm")).join(need.select("class", "perm").distinct(), ["class", "perm"])
    wide = written(wide, "net_rules")  # read on the domain itself and for each kind of place
    kinds = {"netif": find_netif_types, "node": find_node_types, "port": find_port_types, "assoc": find_assoc_types}
    places = together([f(t, o).select("policy_id", F.col("item").alias("target"), F.lit(place).alias("place")) for place, f in kinds.items()]).distinct()
    own = wide.filter("source = target").withColumn("place", F.lit("self"))
    key = ["policy_id", "source", "place", "class", "perm"]
    places = written(places, "net_places")
    has = own.select(*key).unionByName(wide.join(places, ["policy_id", "target"]).select(*key)).join(need.select("place", "class", "perm").distinct(), ["place", "class", "perm"]).distinct()
    has = written(has, "net_rights")
    asks = reduce(lambda a, b: a | b, [(F.col("profile") == p) & (F.col("class").isin(s) | F.col("perm").isin(s)) for p, s in NET_SPECIFIC.items()])
    domains = has.join(need, ["place", "class", "perm"]).filter(asks).select("policy_id", "source", "profile").distinct()
    lacks = domains.join(need, "profile").join(has, key, "left_anti")
    return found(lacks, "type", "source", "missing", F.concat_ws(" ", "place", "class", "perm"), F.col("profile"))


@check("imp_range_trans", "medium", ["rules", "type_attr", "range_trans", "role_type", "user_role", "users"])
def imp_range_trans(t, o):
    """Range transitions that cannot happen: no execute rule, no role, or no user whose range covers it."""
    wide = expand_type(expand_type(t["range_trans"], "target", t["type_attr"]), "source", t["type_attr"])
    run = expand_type(expand_type(t["rules"].filter((F.col("kind") == "allow") & (F.col("class") == "file") & F.array_contains("perms", "execute")), "target", t["type_attr"]), "source", t["type_attr"])
    run = run.select("policy_id", "source", "target").distinct().withColumn("runs", F.lit(True))
    roles = t["role_type"].filter(F.col("role") != FREE_ROLE).select("policy_id", F.col("type").alias("source"), "role").distinct()
    has_role = roles.select("policy_id", "source").distinct().withColumn("has_role", F.lit(True))
    who = roles.join(t["user_role"], ["policy_id", "role"]).join(t["users"].select("policy_id", "user_name", F.col("range").alias("may")), ["policy_id", "user_name"]).select("policy_id", "source", "may").distinct()
    key = ["policy_id", "source", "target", "class"]
    fits = covered(wide.select(*key, "range"), who.withColumnRenamed("may", "range"), ["policy_id", "source"]).select(*key).distinct().withColumn("covered", F.lit(True))
    rows = wide.join(run, ["policy_id", "source", "target"], "left").join(has_role, ["policy_id", "source"], "left").join(fits, key, "left")
    why = F.array_compact(F.array(F.when(F.col("runs").isNull(), "execute"), F.when(F.col("has_role").isNull(), "role"), F.when(F.col("has_role").isNotNull() & F.col("covered").isNull(), "user")))
    bad = rows.select(*key, F.explode(why).alias("why"))
    return found(bad, "range_transition", F.concat_ws(" ", "source", "target", "class"), "missing", F.col("why"))


@check("unreachable_doms", "medium", ["types", "type_attr", "rules", "terules", "role_type", "user_role", "role_allow", "role_trans"])
def unreachable_doms(t, o):
    """Domains without an incoming transition that roles and users can take, with the best reason.

    Transitions, roles and domains are read several times, so each is worked out once and written.
    """
    domains = written(items(find_domains(t, o)), "domains")
    edges = tr.edge_tables(t["rules"], t["terules"], t["type_attr"])
    rows = written(tr.transitions(edges, o["needs_change"]), "transitions")
    roles = {name: written(t[name], name) for name in ("role_type", "user_role")}
    rows = written(role_paths(t | roles, rows).select("policy_id", "end", "valid", "common", "changed"), "role_paths")
    rank = F.when(F.col("valid") & (F.col("common").isNotNull() | F.col("changed").isNotNull()), 3).when(F.col("valid"), 2).otherwise(1)
    best = rows.groupBy("policy_id", F.col("end").alias("type")).agg(F.max(rank).alias("best"))
    if o["exempt_domains"]:
        domains = domains.filter(~F.col("type").isin(o["exempt_domains"]))
    if "isids" in t:
        domains = domains.join(t["isids"].select("policy_id", "type"), ["policy_id", "type"], "left_anti")
    left = domains.join(best, ["policy_id", "type"], "left").withColumn("best", F.coalesce("best", F.lit(0))).filter("best < 3")
    why = F.element_at(F.array(F.lit("no transition"), F.lit("no valid transition"), F.lit("no role and user")), F.col("best") + 1)
    return found(left, "type", "type", "reason", why)
