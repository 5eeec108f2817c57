"""Searches over rules: access, type, filename, role and range rules; conditionals; expansion."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warder.functions import conditions, mls
from warder.functions.predicates import candidates, expand_type, match_cond, match_name


@dataclass
class RuleSearch:
    """What to look for. ``regex`` holds for all names; a bool name finds conditional rules only."""

    kinds: list[str] = field(default_factory=list)
    source: str | None = None
    source_indirect: bool = False
    source_only: str | None = None
    target: str | None = None
    target_indirect: bool = False
    target_only: str | None = None
    default: str | None = None
    classes: list[str] = field(default_factory=list)
    perms: list[str] = field(default_factory=list)
    all_perms: bool = False
    bool_name: str | None = None
    only_enabled: bool = False
    regex: bool = False
    source_as_any: bool = False


def _set(types: DataFrame, type_attr: DataFrame, name: str, regex: bool, indirect: bool, only: str | None) -> DataFrame:
    return candidates(types, type_attr, name, regex=regex, indirect=indirect, only=only)


def semi(rules: DataFrame, found: DataFrame, column: str) -> DataFrame:
    return rules.join(found.select("policy_id", F.col("type").alias(column)), ["policy_id", column], "left_semi")


def _any_position(rules: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    out = rules
    for c in columns:
        out = out.join(found.select("policy_id", F.col("type").alias(c), F.lit(True).alias(f"__{c}")), ["policy_id", c], "left")
    hit = reduce(lambda a, b: a | b, [F.col(f"__{c}").isNotNull() for c in columns])
    return out.filter(hit).drop(*[f"__{c}" for c in columns])


def _common(rules: DataFrame, s: RuleSearch, types: DataFrame, type_attr: DataFrame, conds: DataFrame | None, positions: list[str]) -> DataFrame:
    out = rules
    if s.kinds:
        out = out.filter(F.col("kind").isin(s.kinds))
    if s.classes:
        out = out.filter(F.col("class").isin(s.classes))
    if s.only_enabled:
        out = out.filter("enabled")
    if s.bool_name:
        named = conds.filter(match_cond(F.col("expr"), s.bool_name, s.regex)).select("policy_id", "cond_id")
        out = out.join(named, ["policy_id", "cond_id"], "left_semi")
    if s.source:
        found = _set(types, type_attr, s.source, s.regex, s.source_indirect, s.source_only)
        out = _any_position(out, found, positions) if s.source_as_any else semi(out, found, "source")
    if s.target and not s.source_as_any:
        out = semi(out, _set(types, type_attr, s.target, s.regex, s.target_indirect, s.target_only), "target")
    return out


def find_avrules(rules: DataFrame, search: RuleSearch, types: DataFrame, type_attr: DataFrame, conds: DataFrame | None = None) -> DataFrame:
    """Access rules. Filters on kind, class and permission come first and reach the scan; the
    candidate sets are joined as semi joins."""
    out = rules
    if search.perms:
        wanted = F.array(*[F.lit(p) for p in search.perms])
        out = out.filter(F.size(F.array_except(wanted, "perms")) == 0 if search.all_perms else F.arrays_overlap("perms", wanted))
    return _common(out, search, types, type_attr, conds, ["source", "target"])


def find_terules(rules: DataFrame, search: RuleSearch, types: DataFrame, type_attr: DataFrame, conds: DataFrame | None = None) -> DataFrame:
    """Type rules; the default type takes part in source-as-any."""
    out = _common(rules, search, types, type_attr, conds, ["source", "target", "default_type"])
    if search.default and not search.source_as_any:
        out = semi(out, _set(types, type_attr, search.default, search.regex, False, None), "default_type")
    return out


def find_filename_trans(rules: DataFrame, search: RuleSearch, types: DataFrame, type_attr: DataFrame, filename: str | None = None) -> DataFrame:
    return find_terules(rules.filter(match_name(F.col("filename"), filename, search.regex)), search, types, type_attr)


def find_role_allow(rules: DataFrame, source: str | None = None, target: str | None = None, regex: bool = False, source_as_any: bool = False) -> DataFrame:
    if source and source_as_any:
        return rules.filter(match_name(F.col("source"), source, regex) | match_name(F.col("target"), source, regex))
    return rules.filter(match_name(F.col("source"), source, regex) & match_name(F.col("target"), target, regex))


def find_role_trans(rules: DataFrame, source: str | None = None, target_type: str | None = None, default: str | None = None, regex: bool = False, source_as_any: bool = False) -> DataFrame:
    """Source-as-any covers the two roles; the target type must match all the same."""
    by_type = match_name(F.col("target_type"), target_type, regex)
    if source and source_as_any:
        return rules.filter(by_type & (match_name(F.col("source"), source, regex) | match_name(F.col("default_role"), source, regex)))
    return rules.filter(by_type & match_name(F.col("source"), source, regex) & match_name(F.col("default_role"), default, regex))


def find_range_trans(rules: DataFrame, types: DataFrame, type_attr: DataFrame, search: RuleSearch, range_: Column | None = None, relation: str = "exact") -> DataFrame:
    out = _common(rules.withColumns({"kind": F.lit("range_transition"), "enabled": F.lit(True)}), search, types, type_attr, None, ["source", "target"]).drop("kind", "enabled")
    return out if range_ is None else out.filter(mls.range_compare(F.col("range"), range_, relation))


def expand_rules(rules: DataFrame, type_attr: DataFrame, content: str = "perms") -> DataFrame:
    """Rules over attributes as rules over types, merged by key with the union of permissions.

    Both sides are joined with the attribute table; permissions are combined before the
    shuffle by exploding them into a distinct set of (key, permission).
    """
    wide = expand_type(expand_type(rules, "target", type_attr), "source", type_attr)
    key = ["policy_id", "kind", "source", "target", "class", "cond_id", "branch"]
    if content != "perms":
        return wide.select(*key, content).distinct()
    perm = wide.select(*key, F.explode("perms").alias("perm")).distinct()
    return perm.groupBy(*key).agg(F.array_sort(F.collect_list("perm")).alias("perms"))


def eval_conditionals(conds: DataFrame, bools: DataFrame, what_if: dict[str, bool] | None = None) -> DataFrame:
    """Add ``truth``; ``what_if`` overrides states."""
    state = F.col("state")
    for name, value in (what_if or {}).items():
        state = F.when(F.col("bool") == name, F.lit(value)).otherwise(state)
    states = bools.groupBy("policy_id").agg(F.map_from_entries(F.collect_list(F.struct("bool", state))).alias("states"))
    joined = conds.join(states, "policy_id", "left").withColumn("states", F.coalesce("states", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>"))))
    return joined.withColumn("truth", conditions.evaluate(F.col("expr"), F.col("states"))).drop("states")


def enable_rules(rules: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Set ``enabled``: a conditional rule is on if its condition's truth is its branch."""
    truth = evaluated.select("policy_id", "cond_id", "truth")
    return rules.join(truth, ["policy_id", "cond_id"], "left").withColumn("enabled", F.col("cond_id").isNull() | F.coalesce(F.col("truth") == F.col("branch"), F.lit(False))).drop("truth")


def rules_of_conditional(rules: DataFrame, cond_id: int, branch: bool | None = None) -> DataFrame:
    test = F.col("cond_id") == cond_id
    return rules.filter(test if branch is None else test & (F.col("branch") == branch))


def show_conditional(rules: DataFrame, conds: DataFrame) -> DataFrame:
    """Attach the text of a rule's condition."""
    text = conds.select("policy_id", "cond_id", conditions.render(F.col("expr")).alias("condition"))
    return rules.join(text, ["policy_id", "cond_id"], "left")


def written_types(syn: DataFrame, side: str, types: DataFrame) -> DataFrame:
    """(policy_id, syn_id, type) that a written rule names on a side: ``*``, ``~`` and subtraction
    are resolved against all types of the policy."""
    every = types.filter("not is_attr").select("policy_id", "type")
    named = syn.select("policy_id", "syn_id", F.explode(side).alias("type"))
    minus = syn.select("policy_id", "syn_id", F.explode(f"{side}_minus").alias("type")) if f"{side}_minus" in syn.columns else None
    plain = named
    if side == "targets":
        star = syn.filter("star").select("policy_id", "syn_id").join(every, "policy_id")
        flipped = syn.filter("complement").select("policy_id", "syn_id").join(every, "policy_id").join(named, ["policy_id", "syn_id", "type"], "left_anti")
        kept = named.join(syn.filter("not star and not complement").select("policy_id", "syn_id"), ["policy_id", "syn_id"], "left_semi")
        own = syn.filter("self").select("policy_id", "syn_id", F.explode("sources").alias("type"))
        plain = kept.unionByName(star).unionByName(flipped).unionByName(own)
    return (plain if minus is None else plain.join(minus, ["policy_id", "syn_id", "type"], "left_anti")).distinct()


def _written(syn: DataFrame, search: RuleSearch, types: DataFrame, type_attr: DataFrame) -> DataFrame:
    out = syn
    if search.kinds:
        out = out.filter(F.col("kind").isin(search.kinds))
    if search.classes:
        out = out.filter(F.arrays_overlap("classes", F.array(*[F.lit(c) for c in search.classes])))
    for side, name, indirect in (("sources", search.source, search.source_indirect), ("targets", search.target, search.target_indirect)):
        if name:
            found = candidates(types, type_attr, name, regex=search.regex, indirect=indirect, written=True)
            hits = written_types(out, side, types).join(found, ["policy_id", "type"], "left_semi").select("policy_id", "syn_id").distinct()
            out = out.join(hits, ["policy_id", "syn_id"], "left_semi")
    return out


def find_written_avrules(syn: DataFrame, search: RuleSearch, types: DataFrame, type_attr: DataFrame) -> DataFrame:
    """Access rules as written that contribute what is asked for."""
    if search.perms:
        wanted = F.array(*[F.lit(p) for p in search.perms])
        syn = syn.filter(F.size(F.array_except(wanted, "perms")) == 0 if search.all_perms else F.arrays_overlap("perms", wanted))
    return _written(syn, search, types, type_attr)


def find_written_terules(syn: DataFrame, search: RuleSearch, types: DataFrame, type_attr: DataFrame) -> DataFrame:
    """Type rules as written, by what they name and their default type."""
    if search.default:
        syn = semi(syn, _set(types, type_attr, search.default, search.regex, False, None), "default_type")
    return _written(syn, search, types, type_attr)


def expanded_to_written(rules: DataFrame, syn: DataFrame) -> DataFrame:
    """Written rules (syn_id, lineno) of each expanded rule, by rule_id."""
    return rules.join(syn.select("policy_id", "rule_id", "syn_id", "lineno"), ["policy_id", "rule_id"])


def rule_line_numbers(rules: DataFrame, syn: DataFrame, perm: str | None = None) -> DataFrame:
    """Sorted line numbers of the written rules that give a permission (or any)."""
    given = syn if perm is None else syn.filter(F.array_contains("perms", perm))
    return expanded_to_written(rules, given).groupBy("policy_id", "rule_id").agg(F.array_sort(F.collect_set("lineno")).alias("lines"))


def render_avrule(rules: DataFrame) -> DataFrame:
    """Add the statement text; braces only around several permissions."""
    perms = F.when(F.size("perms") == 1, F.element_at("perms", 1)).otherwise(F.concat(F.lit("{ "), F.array_join("perms", " "), F.lit(" }")))
    return rules.withColumn("text", F.concat(F.col("kind"), F.lit(" "), F.col("source"), F.lit(" "), F.col("target"), F.lit(" : "), F.col("class"), F.lit(" "), perms, F.lit(";")))


def render_terule(rules: DataFrame) -> DataFrame:
    name = F.concat(F.lit(' "'), F.col("filename"), F.lit('"')) if "filename" in rules.columns else F.lit("")
    return rules.withColumn("text", F.concat(F.col("kind"), F.lit(" "), F.col("source"), F.lit(" "), F.col("target"), F.lit(" : "), F.col("class"), F.lit(" "), F.col("default_type"), F.coalesce(name, F.lit("")), F.lit(";")))


def render_role_allow(rules: DataFrame) -> DataFrame:
    return rules.withColumn("text", F.format_string("allow %s %s;", "source", "target"))


def render_role_trans(rules: DataFrame) -> DataFrame:
    return rules.withColumn("text", F.format_string("role_transition %s %s %s;", "source", "target_type", "default_role"))


def render_range_trans(rules: DataFrame) -> DataFrame:
    return rules.withColumn("text", F.concat(F.format_string("range_transition %s %s : %s ", "source", "target", "class"), mls.render_range(F.col("range")), F.lit(";")))


def render_conditional(rules: DataFrame, conds: DataFrame) -> DataFrame:
    """(policy_id, cond_id, text): each condition with the statements of both branches, sorted.
    ``rules`` have their text and branch; a branch without rules is left out."""
    branch = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("branch") == b, F.col("text")))), lambda t: F.concat(F.lit("  "), t)), "\n")
    both = rules.filter("cond_id is not null").groupBy("policy_id", "cond_id").agg(branch(True).alias("yes"), branch(False).alias("no"))
    head = F.concat(F.lit("if ("), conditions.render(F.col("expr")), F.lit(") {\n"))
    body = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(F.col(c), F.lit("\n")))
    other = F.when(F.col("no") == "", "").otherwise(F.concat(F.lit(" else {\n"), body("no"), F.lit("}")))
    joined = conds.join(both, ["policy_id", "cond_id"])
    return joined.select("policy_id", "cond_id", F.concat(head, body("yes"), F.lit("}"), other).alias("text"))


def sort_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("text")
