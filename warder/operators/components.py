"""Searches over policy components. Each takes the tables it needs; an absent argument matches all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions import conditions, mls
from warder.functions.predicates import match_any_of, match_bounds, match_cond, match_name, match_symbol


def find_types(types: DataFrame, name: str | None = None, regex: bool = False) -> DataFrame:
    return types.filter(~F.col("is_attr") & match_symbol(F.col("type"), F.col("aliases"), name, regex))


def find_attrs(types: DataFrame, name: str | None = None, regex: bool = False) -> DataFrame:
    return types.filter(F.col("is_attr") & match_name(F.col("type"), name, regex))


def find_roles(roles: DataFrame, role_type: DataFrame, name: str | None = None, type_: str | None = None, regex: bool = False, types: DataFrame | None = None) -> DataFrame:
    """Roles by name that contain a type (by name or, with ``types``, by alias)."""
    found = roles.filter(match_name(F.col("role"), name, regex))
    if type_:
        bridge = role_type
        if types is not None:
            bridge = bridge.join(types.select("policy_id", "type", "aliases"), ["policy_id", "type"])
            bridge = bridge.filter(match_symbol(F.col("type"), F.col("aliases"), type_, regex))
        else:
            bridge = bridge.filter(match_name(F.col("type"), type_, regex))
        found = found.join(bridge, ["policy_id", "role"], "left_semi")
    return found


def find_users(users: DataFrame, user_role: DataFrame, name: str | None = None, role: str | None = None, regex: bool = False, default_level: Column | None = None, range_: Column | None = None, relation: str = "exact") -> DataFrame:
    found = users.filter(match_name(F.col("user_name"), name, regex))
    if role:
        found = found.join(user_role.filter(match_name(F.col("role"), role, regex)), ["policy_id", "user_name"], "left_semi")
    if default_level is not None:
        found = found.filter(mls.level_compare(F.col("default_level"), default_level) == "eq")
    if range_ is not None:
        found = found.filter(mls.range_compare(F.col("range"), range_, relation))
    return found


def find_classes(classes: DataFrame, name: str | None = None, common: str | None = None, regex: bool = False) -> DataFrame:
    """Classes by name and common; one without common does not match a common."""
    return classes.filter(match_name(F.col("class"), name, regex) & match_name(F.col("common"), common, regex))


def find_commons(commons: DataFrame, name: str | None = None, regex: bool = False) -> DataFrame:
    return commons.filter(match_name(F.col("common"), name, regex)).select("policy_id", "common").distinct()


def class_perms(classes: DataFrame, class_perm: DataFrame, common_perm: DataFrame | None = None) -> DataFrame:
    """(policy_id, class, perm) with the permissions that a class inherits from its common."""
    own = class_perm.select("policy_id", "class", "perm")
    if common_perm is None:
        return own.distinct()
    inherited = classes.filter("common is not null").join(common_perm, ["policy_id", "common"]).select("policy_id", "class", "perm")
    return own.unionByName(inherited).distinct()


def find_perms(class_perm: DataFrame, common_perm: DataFrame | None = None, name: str | None = None, regex: bool = False) -> DataFrame:
    perms = class_perm.select("policy_id", "perm")
    if common_perm is not None:
        perms = perms.unionByName(common_perm.select("policy_id", "perm"))
    return perms.filter(match_name(F.col("perm"), name, regex)).distinct()


def find_bools(bools: DataFrame, name: str | None = None, regex: bool = False) -> DataFrame:
    return bools.filter(match_name(F.col("bool"), name, regex))


def find_conds(conds: DataFrame, bool_name: str | None = None, regex: bool = False) -> DataFrame:
    return conds.filter(match_cond(F.col("expr"), bool_name, regex)).withColumn("text", conditions.render(F.col("expr")))


def find_levels(levels: DataFrame, level_cat: DataFrame, sens: str | None = None, cat: str | None = None, regex: bool = False) -> DataFrame:
    """Sensitivities by name or alias that have a category which matches; one without any
    category is not found, with or without a category pattern."""
    cats = level_cat.filter(match_name(F.col("cat"), cat, regex)).select("policy_id", "sens")
    return levels.filter(match_symbol(F.col("sens"), F.col("aliases"), sens, regex)).join(cats, ["policy_id", "sens"], "left_semi")


def find_cats(cats: DataFrame, name: str | None = None, regex: bool = False) -> DataFrame:
    return cats.filter(match_symbol(F.col("cat"), F.col("aliases"), name, regex))


def find_constraints(constraints: DataFrame, class_: str | None = None, perm: str | None = None, regex: bool = False) -> DataFrame:
    return constraints.filter(match_name(F.col("class"), class_, regex) & match_any_of(F.col("perms"), perm, regex))


def find_validatetrans(rows: DataFrame, class_: str | None = None, regex: bool = False) -> DataFrame:
    return rows.filter(match_name(F.col("class"), class_, regex))


def find_constraints_by_expr(constraints: DataFrame, keywords: list[str] | None = None, ops: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Constraints whose expression uses one of the symbols, operators or names of each list given."""
    tests = []
    if keywords:
        tests.append(F.exists("expr", lambda x: x["sym"].isin(keywords) | x["kind"].isin(keywords)))
    if ops:
        tests.append(F.exists("expr", lambda x: x["op"].isin(ops)))
    if names:
        tests.append(F.exists("expr", lambda x: F.coalesce(F.arrays_overlap(x["names"], F.array(*[F.lit(n) for n in names])), F.lit(False))))
    return constraints.filter(reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True)))


def _context(column: str, search: Column | None, relation: str) -> Column:
    return F.lit(True) if search is None else context_compare(F.col(column), search, relation)


def find_portcon(portcon: DataFrame, low: int | None = None, high: int | None = None, proto: str | None = None, context: Column | None = None, relation: str = "exact") -> DataFrame:
    tests = [F.col(c) == v for c, v in (("low", low), ("high", high), ("proto", proto)) if v is not None]
    return portcon.filter(reduce(lambda a, b: a & b, tests, _context("context", context, relation)))


def find_netifcon(netifcon: DataFrame, device: str | None = None, if_context: Column | None = None, msg_context: Column | None = None, regex: bool = False, relation: str = "exact") -> DataFrame:
    return netifcon.filter(match_name(F.col("name"), device, regex) & _context("if_context", if_context, relation) & _context("msg_context", msg_context, relation))


def find_nodecon(nodecon: DataFrame, proto: str | None = None, addr: str | None = None, mask: str | None = None, context: Column | None = None, relation: str = "exact") -> DataFrame:
    tests = [F.col(c) == v for c, v in (("proto", proto), ("addr", addr), ("mask", mask)) if v is not None]
    return nodecon.filter(reduce(lambda a, b: a & b, tests, _context("context", context, relation)))


def find_genfscon(genfscon: DataFrame, fs: str | None = None, path: str | None = None, class_: str | None = None, context: Column | None = None, regex: bool = False, relation: str = "exact") -> DataFrame:
    test = match_name(F.col("fs"), fs, regex) & match_name(F.col("path"), path, regex) & match_name(F.col("class"), class_)
    return genfscon.filter(test & _context("context", context, relation))


def find_fs_use(fs_use: DataFrame, fs: str | None = None, behavior: str | None = None, context: Column | None = None, regex: bool = False, relation: str = "exact") -> DataFrame:
    return fs_use.filter(match_name(F.col("fs"), fs, regex) & match_name(F.col("behavior"), behavior) & _context("context", context, relation))


def find_isids(isids: DataFrame, name: str | None = None, context: Column | None = None, regex: bool = False, relation: str = "exact") -> DataFrame:
    return isids.filter(match_name(F.col("name"), name, regex) & _context("context", context, relation))


def find_bounds(bounds: DataFrame, kind: str, name: str | None = None, regex: bool = False) -> DataFrame:
    return bounds.filter((F.col("kind") == kind) & match_bounds(F.col("parent"), F.col("child"), name, regex))


def find_default_objects(rows: DataFrame, class_: str | None = None, having: list[str] | None = None, regex: bool = False) -> DataFrame:
    """Default statements by class; ``having`` names defaults (user, role, type, range) that must be set."""
    tests = [F.col(f"default_{h}").isNotNull() for h in having or []]
    return rows.filter(reduce(lambda a, b: a & b, tests, match_name(F.col("class"), class_, regex)))


def find_permissives(types: DataFrame, name: str | None = None, regex: bool = False) -> DataFrame:
    return types.filter(F.col("is_permissive") & match_symbol(F.col("type"), F.col("aliases"), name, regex))


def find_polcaps(polcaps: DataFrame, name: str | None = None, regex: bool = False) -> DataFrame:
    return polcaps.filter(match_name(F.col("name"), name, regex))


def listing(bridge: DataFrame, of: str, what: str) -> DataFrame:
    """Cross listing: for each ``of`` the sorted ``what`` (attributes of a type, types of a role, ...)."""
    return bridge.groupBy("policy_id", of).agg(F.array_sort(F.collect_set(what)).alias(what))


def symbols_in_namespace(tables: dict[str, tuple[DataFrame, str]], prefix: str) -> DataFrame:
    """(policy_id, kind, name) of all symbols under a dotted prefix; ``tables``: kind -> (table, column)."""
    parts = [t.select("policy_id", F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, (t, c) in tables.items()]
    everything = reduce(lambda a, b: a.unionByName(b), parts)
    return everything.filter(F.col("name").startswith(f"{prefix}.")).distinct()


def classes_of_perm(class_perm: DataFrame, perm: str) -> DataFrame:
    """Classes that have a permission; give ``class_perms`` for inherited ones."""
    return class_perm.filter(F.col("perm") == perm).select("policy_id", "class").distinct()


def commons_of_perm(common_perm: DataFrame, perm: str) -> DataFrame:
    return common_perm.filter(F.col("perm") == perm).select("policy_id", "common").distinct()


def context_compare(target: Column, search: Column, relation: str = "exact", fields: tuple[str, ...] = ("user", "role", "type")) -> Column:
    """Partial contexts: only what both have is compared; the range by its relation."""
    tests = [F.coalesce(target[f] == search[f], F.lit(True)) for f in fields]
    both = target["range"].isNotNull() & search["range"].isNotNull()
    tests.append(~both | mls.range_compare(target["range"], search["range"], relation))
    return reduce(lambda a, b: a & b, tests)


def context_validate(rows: DataFrame, user_role: DataFrame, role_type: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Add ``valid``: the user has the role, the role the type and, with ``users``, the user's
    range the range. Missing parts are not tested; ``object_r`` goes with every user and type."""
    roles = user_role.select("policy_id", "user_name", "role").distinct().withColumn("has_role", F.lit(True))
    types = role_type.select("policy_id", "role", "type").distinct().withColumn("has_type", F.lit(True))
    out = rows.join(roles, ["policy_id", "user_name", "role"], "left").join(types, ["policy_id", "role", "type"], "left")
    free = F.col("role") == "object_r"
    valid = (F.col("user_name").isNull() | F.col("role").isNull() | free | F.col("has_role").isNotNull()) & (F.col("role").isNull() | F.col("type").isNull() | free | F.col("has_type").isNotNull())
    if users is not None:
        out = out.join(users.select("policy_id", "user_name", F.col("range").alias("__may")), ["policy_id", "user_name"], "left")
        valid = valid & (F.col("range").isNull() | F.col("__may").isNull() | mls.range_contains(F.col("__may"), F.col("range")))
        out = out.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("__may")
    else:
        out = out.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return out.drop("has_role", "has_type")


def policy_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(policy_id, component, n): rows of each table of a policy; aggregated per table, then unioned."""
    parts = [t.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n")).select("policy_id", F.lit(name).alias("component"), "n") for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def render_context(user: Column, role: Column, type_: Column, range_: Column | None = None) -> Column:
    """``user:role:type[:range]``; a part that is missing is ``*``."""
    parts = [F.coalesce(c, F.lit("*")) for c in (user, role, type_)]
    return F.concat_ws(":", *parts, *([mls.render_range(range_)] if range_ is not None else []))


def render_portcon(rows: DataFrame) -> DataFrame:
    """Port statement; one port is written once. ``context`` is text."""
    ports = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string")))
    return rows.withColumn("text", F.concat_ws(" ", F.lit("portcon"), "proto", ports, "context"))


def render_netifcon(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.concat_ws(" ", F.lit("netifcon"), "name", "if_context", "msg_context"))


def render_nodecon(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.concat_ws(" ", F.lit("nodecon"), "addr", "mask", "context"))


#: Class of a labelled path as a statement writes it (fixed values).
PATH_CLASSES = {"file": "--", "dir": "-d", "lnk_file": "-l", "chr_file": "-c", "blk_file": "-b", "sock_file": "-s", "fifo_file": "-p"}


def render_genfscon(rows: DataFrame) -> DataFrame:
    kind = reduce(lambda c, kv: c.when(F.col("class") == kv[0], kv[1]), list(PATH_CLASSES.items())[1:], F.when(F.col("class") == "file", "--"))
    return rows.withColumn("text", F.concat_ws(" ", F.lit("genfscon"), "fs", "path", kind, "context"))


def render_fs_use(rows: DataFrame) -> DataFrame:
    """``behavior fs context;``, and nothing but the name for file systems without labels."""
    return rows.withColumn("text", F.concat(F.concat_ws(" ", "behavior", "fs", "context"), F.lit(";")))


def render_isid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.concat_ws(" ", F.lit("sid"), "name", "context"))
