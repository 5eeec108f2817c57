"""Differences between policy snapshots by meaning, for any number of snapshot pairs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warder.functions.conditions import truth_keys
from warder.functions.predicates import expand_type
from warder.functions.state import written
from warder.operators.rules import expand_rules


def sides(table: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a table for the original and the modified snapshot of each pair (orig_id, mod_id)."""
    pairs = F.broadcast(pairs.select("orig_id", "mod_id").distinct())
    one = table.join(pairs, table.policy_id == pairs.orig_id).drop("policy_id")
    two = table.join(pairs, table.policy_id == pairs.mod_id).drop("policy_id")
    return one, two


def type_remap_infer(types: DataFrame, pairs: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """(orig_id, mod_id, orig_type, mod_type): which types of the snapshots are the same.

    The user's entries come first; then four passes: same name, name with alias, alias with
    name, and the same aliases (both have some, and all are equal). Each pass only sees what is not
    mapped yet, and a type is used once (ties by name). What a pass has mapped is a small table, written so that the next need not work it out again.
    """

    def link(df: DataFrame, side: str, kind: str, whole: bool) -> DataFrame:
        aliases = F.array_sort(F.array_distinct(f"{side}_aliases"))
        if kind == "name":
            by = F.col(f"{side}_type")
        elif whole:  # the text tells lists apart, as lengths stand before names
            by = F.when(F.size(aliases) > 0, F.array_join(F.transform(aliases, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), " "))
        else:
            by = F.explode(aliases)
        return df.select(*key, f"{side}_type", by.alias("link"))

    real = types.filter("not is_attr").select("policy_id", "type", "aliases")
    a, b = sides(real, pairs)
    a = written(a.select("orig_id", "mod_id", F.col("type").alias("orig_type"), F.col("aliases").alias("orig_aliases")), "orig_types")
    b = written(b.select("orig_id", "mod_id", F.col("type").alias("mod_type"), F.col("aliases").alias("mod_aliases")), "mod_types")
    key = ["orig_id", "mod_id"]
    mapped = user.select(*key, "orig_type", "mod_type") if user is not None else None
    for left, right in (("name", "name"), ("name", "alias"), ("alias", "name"), ("alias", "alias")):
        free_a = a if mapped is None else a.join(mapped.select(*key, "orig_type"), [*key, "orig_type"], "left_anti")
        free_b = b if mapped is None else b.join(mapped.select(*key, "mod_type"), [*key, "mod_type"], "left_anti")
        x, y = (link(df, side, kind, left == right) for df, side, kind in ((free_a, "orig", left), (free_b, "mod", right)))
        hit = x.join(y, [*key, "link"]).select(*key, "orig_type", "mod_type").distinct()
        if (left, right) != ("name", "name"):
            once = lambda c: F.row_number().over(Window.partitionBy(*key, c).orderBy("orig_type", "mod_type"))
            hit = hit.withColumn("r", once("orig_type")).filter("r = 1").withColumn("r", once("mod_type")).filter("r = 1").drop("r")
        mapped = written(hit if mapped is None else mapped.unionByName(hit), "remap")
    return mapped


def type_map(types: DataFrame, pairs: DataFrame, remap: DataFrame) -> DataFrame:
    """(orig_id, mod_id, side, type, id): a name shared by the types that are the same.

    Types mapped several to one, or one to several, share the smallest name; types that are not
    mapped have a name of their own, marked with their side.
    """
    key = ["orig_id", "mod_id"]
    low_mod = remap.withColumn("id", F.min("orig_type").over(Window.partitionBy(*key, "mod_type")))
    low = low_mod.withColumn("id", F.min("id").over(Window.partitionBy(*key, "orig_type")))
    a, b = sides(types.filter("not is_attr").select("policy_id", "type"), pairs)
    one = a.join(low.select(*key, F.col("orig_type").alias("type"), "id").distinct(), [*key, "type"], "left").select(*key, F.lit("orig").alias("side"), "type", F.coalesce("id", F.concat(F.lit("-"), F.col("type"))).alias("id"))
    two = b.join(low.select(*key, F.col("mod_type").alias("type"), "id").distinct(), [*key, "type"], "left").select(*key, F.lit("mod").alias("side"), "type", F.coalesce("id", F.concat(F.lit("+"), F.col("type"))).alias("id"))
    return written(one.unionByName(two), "type_map")


def mapped(df: DataFrame, side: str, column: str, ids: DataFrame) -> DataFrame:
    """Replace the types in a column by their shared names."""
    names = ids.filter(F.col("side") == side).select("orig_id", "mod_id", F.col("type").alias(column), "id")
    return df.join(names, ["orig_id", "mod_id", column], "left").withColumn(column, F.coalesce("id", column)).drop("id")


def deep_diff(one: DataFrame, two: DataFrame, identity: list[str], content: str, component: str, by_type: list[str] | None = None) -> DataFrame:
    """Full outer join on the identity; content is an array.

    Keys whose sorted content is equal on both sides are dropped. form: added, removed, modified; with ``by_type``, an added or removed rule whose
    type exists on one side only is add_by_type or remove_by_type.
    """
    key = ["orig_id", "mod_id", *identity]
    wrap = lambda df, n: df.select(*key, F.array_sort(F.array_distinct(content)).alias(n))
    joined = wrap(one, "old").join(wrap(two, "new"), key, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    none = F.array().cast("array<string>")
    form = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    if by_type:
        lone = reduce(lambda a, b: a | b, [F.col(c).startswith("+") | F.col(c).startswith("-") for c in by_type])
        form = F.when(F.col("old").isNull() & lone, "add_by_type").when(F.col("new").isNull() & lone, "remove_by_type").otherwise(form)
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    return joined.select(
        "orig_id",
        "mod_id",
        F.lit(component).alias("component"),
        F.concat_ws(" ", *identity).alias("key"),
        form.alias("form"),
        F.array_except(new, old).alias("added"),
        F.array_except(old, new).alias("removed"),
        F.array_intersect(old, new).alias("unmodified"),
    )


def diff_groups(table: DataFrame, pairs: DataFrame, identity: str | list[str], member: str, component: str, ids: DataFrame | None = None, map_identity: bool = False, map_member: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Components that are a name with a set: classes and permissions, roles and types, ...

    ``keys`` names all items, so that one without members is seen; types are mapped where asked.
    """
    identity = [identity] if isinstance(identity, str) else identity
    out = []
    for side, rows in zip(("orig", "mod"), sides(table, pairs), strict=True):
        if map_identity:
            rows = mapped(rows, side, identity[0], ids)
        if map_member:
            rows = mapped(rows, side, member, ids)
        grouped = rows.groupBy("orig_id", "mod_id", *identity).agg(F.collect_set(F.col(member).cast("string")).alias("content"))
        if keys is not None:
            every = sides(keys, pairs)[0 if side == "orig" else 1]
            every = mapped(every, side, identity[0], ids) if map_identity else every
            grouped = every.select("orig_id", "mod_id", *identity).distinct().join(grouped, ["orig_id", "mod_id", *identity], "left").withColumn("content", F.coalesce("content", F.array().cast("array<string>")))
        out.append(grouped)
    return deep_diff(*out, identity, "content", component)


def diff_classes(class_perm: DataFrame, pairs: DataFrame) -> DataFrame:
    """``class_perm`` with the inherited permissions."""
    return diff_groups(class_perm, pairs, "class", "perm", "class")


def diff_commons(common_perm: DataFrame, pairs: DataFrame) -> DataFrame:
    return diff_groups(common_perm, pairs, "common", "perm", "common")


def diff_types(types: DataFrame, type_attr: DataFrame, pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return diff_groups(type_attr, pairs, "type", "attr", "type", ids, map_identity=True, keys=types.filter("not is_attr").select("policy_id", "type"))


def diff_attribs(type_attr: DataFrame, pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return diff_groups(type_attr, pairs, "attr", "type", "attribute", ids, map_member=True)


def diff_roles(role_type: DataFrame, pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return diff_groups(role_type, pairs, "role", "type", "role", ids, map_member=True)


def diff_users(user_role: DataFrame, pairs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Users by their roles and, with ``users`` (policy_id, user_name, default_level, range), by
    default level and range too, as members ``level ...`` and ``range ...``; with it, users
    without roles are seen."""
    if users is None:
        return diff_groups(user_role, pairs, "user_name", "role", "user")
    default, levels = F.col("default_level"), range_content(F.col("range"))
    text = F.concat(F.lit("level "), default["rank"].cast("string"), F.lit(":"), F.array_join(F.array_sort(default["cats"]), " "))
    mls_parts = F.concat(F.array_compact(F.array(text)), F.transform(F.coalesce(levels, F.array().cast("array<string>")), lambda x: F.concat(F.lit("range "), F.translate(x, ",", " "))))
    members = users.select("policy_id", "user_name", F.explode(mls_parts).alias("role")).unionByName(user_role.select("policy_id", "user_name", "role"))
    return diff_groups(members, pairs, "user_name", "role", "user", keys=users.select("policy_id", "user_name"))


def diff_bools(bools: DataFrame, pairs: DataFrame) -> DataFrame:
    return diff_groups(bools, pairs, "bool", "state", "boolean")


def diff_levels(level_cat: DataFrame, pairs: DataFrame) -> DataFrame:
    return diff_groups(level_cat, pairs, "sens", "cat", "level")


def diff_cats(cats: DataFrame, pairs: DataFrame) -> DataFrame:
    return diff_groups(cats.withColumn("present", F.lit("")), pairs, "cat", "present", "category")


def diff_role_allow(rules: DataFrame, pairs: DataFrame) -> DataFrame:
    return diff_groups(rules, pairs, "source", "target", "role_allow")


def diff_role_trans(rules: DataFrame, pairs: DataFrame, ids: DataFrame, type_attr: DataFrame | None = None) -> DataFrame:
    """Role transitions by source role and target type; attributes count as their types."""
    if type_attr is not None:
        rules = expand_type(rules, "target_type", type_attr).distinct()
    rows = [mapped(r, side, "target_type", ids).withColumn("content", F.array("default_role")) for side, r in zip(("orig", "mod"), sides(rules, pairs), strict=True)]
    return deep_diff(*rows, ["source", "target_type"], "content", "role_trans", ["target_type"])


def range_content(r: Column) -> Column:
    """A range as the list of its levels (``rank:cats``) and the smallest category set."""
    high = F.coalesce(r["high"], r["low"])
    levels = F.transform(F.sequence(r["low"]["rank"], high["rank"]), lambda k: F.concat(k.cast("string"), F.lit(":"), F.array_join(F.array_sort(high["cats"]), ",")))
    return F.concat(levels, F.array(F.concat(F.lit("least:"), F.array_join(F.array_sort(r["low"]["cats"]), ","))))


def diff_range_trans(rules: DataFrame, pairs: DataFrame, ids: DataFrame) -> DataFrame:
    rows = [mapped(mapped(r, side, "source", ids), side, "target", ids).withColumn("content", range_content(F.col("range"))) for side, r in zip(("orig", "mod"), sides(rules, pairs), strict=True)]
    return deep_diff(*rows, ["source", "target", "class"], "content", "range_trans", ["source", "target"])


def cond_keys(rules: DataFrame, conds: DataFrame | None) -> DataFrame:
    """Replace cond_id and branch by the identity of the condition ('' for none)."""
    if conds is None:  # identifiers are all there is to tell conditions apart
        own = F.concat(F.lit("id:"), F.col("cond_id").cast("string"), F.lit(":"), F.col("branch").cast("string"))
        return rules.withColumn("cond", F.coalesce(own, F.lit("")))
    keys = written(conds.select("policy_id", "cond_id", truth_keys(F.col("expr")).alias("keys")), "conditions")
    out = rules.join(keys, ["policy_id", "cond_id"], "left")
    return out.withColumn("cond", F.coalesce(F.when(F.col("branch"), F.col("keys.yes")).otherwise(F.col("keys.no")), F.lit(""))).drop("keys")


def diff_rules(rules: DataFrame, type_attr: DataFrame, pairs: DataFrame, ids: DataFrame, content: str, component: str, kind: str, conds: DataFrame | None = None) -> DataFrame:
    # both sides of all pairs read these rows
    wide = written(cond_keys(expand_rules(rules.filter(F.col("kind") == kind), type_attr, content), conds), "wide_rules")
    out = []
    for side, rows in zip(("orig", "mod"), sides(wide, pairs), strict=True):
        rows = mapped(mapped(rows, side, "source", ids), side, "target", ids)
        key = ["orig_id", "mod_id", "source", "target", "class", "cond"]
        if content == "perms":
            rows = rows.select(*key, F.explode("perms").alias("p"))
        else:
            rows = mapped(rows, side, content, ids).select(*key, F.col(content).alias("p"))
        out.append(rows.groupBy(*key).agg(F.collect_set("p").alias("content")))
    return deep_diff(*out, ["source", "target", "class", "cond"], "content", component, ["source", "target"])


def diff_avrules(rules: DataFrame, type_attr: DataFrame, pairs: DataFrame, ids: DataFrame, kind: str = "allow", conds: DataFrame | None = None) -> DataFrame:
    """Expanded access rules of a kind, their permissions merged, by source, target, class and
    condition (identity across negation and branch)."""
    return diff_rules(rules, type_attr, pairs, ids, "perms", kind, kind, conds)


def diff_terules(rules: DataFrame, type_attr: DataFrame, pairs: DataFrame, ids: DataFrame, kind: str = "type_transition", conds: DataFrame | None = None) -> DataFrame:
    return diff_rules(rules, type_attr, pairs, ids, "default_type", kind, kind, conds)


def diff_line_numbers(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Attach orig_lines and mod_lines; ``lines``: policy_id, key, lineno of the written rules."""
    by = lambda side, name: lines.groupBy(F.col("policy_id").alias(side), "key").agg(F.array_sort(F.collect_set("lineno")).alias(name))
    return found.join(by("orig_id", "orig_lines"), ["orig_id", "key"], "left").join(by("mod_id", "mod_lines"), ["mod_id", "key"], "left")


FORMS = ["added", "removed", "modified", "add_by_type", "remove_by_type"]


def diff_stats(found: DataFrame) -> DataFrame:
    """Numbers of each form by pair and component."""
    one = lambda f: F.count(F.when(F.col("form") == f, 1)).alias(f)
    return found.groupBy("orig_id", "mod_id", "component").agg(*[one(f) for f in FORMS])


def render_diff(found: DataFrame) -> DataFrame:
    """``+``, ``-`` or ``*`` and the content of each item."""
    sign = F.when(F.col("form").isin("added", "add_by_type"), "+").when(F.col("form").isin("removed", "remove_by_type"), "-").otherwise("*")
    part = lambda c, s: F.transform(c, lambda x: F.concat(F.lit(s), x))
    inside = F.array_join(F.concat(part("added", "+"), part("removed", "-"), "unmodified"), " ")
    return found.withColumn("text", F.concat(sign, F.lit(" "), F.col("key"), F.lit(" { "), inside, F.lit(" }")))
