"""Predicates shared by all queries: names, patterns, candidate sets."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: POSIX bracket classes and their Java forms (fixed values).
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\s",
    "upper": r"\p{Upper}",
    "xdigit": r"\p{XDigit}",
}


def extended_regex(pattern: str) -> str:
    """A POSIX extended regular expression as a Java one."""

    def bracket(m: re.Match) -> str:
        body = m.group(2)
        body = re.sub(r"\[:(\w+):\]", lambda c: POSIX_CLASSES.get(c.group(1), c.group(0)), body)
        inner = re.sub(r"(?<!\\)\[", r"\\[", body) if "\\p" not in body else body
        return f"[{m.group(1)}{inner.replace('&&', '&\\&')}]"

    return re.sub(r"\[(\^?)(\]?(?:\[:\w+:\]|[^\]])*)\]", bracket, pattern)


def glob_regex(pattern: str) -> str:
    """A shell glob (``*``, ``?``, ``[...]``) as an anchored Java regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            out.append("[" + "^" * negated + re.sub(r"([\[\]\\&])", r"\\\1", body[negated:]) + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(col: Column, pattern: str) -> Column:
    return col.rlike(glob_regex(pattern))


def match_name(col: Column, pattern: str | None, regex: bool = False) -> Column:
    """An absent pattern matches all; a regex is searched for; else equality. Null never matches a pattern."""
    if not pattern:
        return F.lit(True)
    test = col.rlike(extended_regex(pattern)) if regex else col == pattern
    return F.coalesce(test, F.lit(False))


def match_any_of(array: Column, pattern: str | None, regex: bool = False) -> Column:
    if not pattern:
        return F.lit(True)
    return F.coalesce(F.exists(array, lambda x: match_name(x, pattern, regex)), F.lit(False))


def match_symbol(name: Column, aliases: Column, pattern: str | None, regex: bool = False) -> Column:
    """Type, sensitivity or category by name or any alias."""
    if not pattern:
        return F.lit(True)
    return match_name(name, pattern, regex) | match_any_of(aliases, pattern, regex)


def match_cond(expr: Column, pattern: str | None, regex: bool = False) -> Column:
    """Some boolean named in a postfix expression matches."""
    if not pattern:
        return F.lit(True)
    return F.exists(expr, lambda x: (x["op"] == "bool") & match_name(x["name"], pattern, regex))


def match_bounds(parent: Column, child: Column, pattern: str | None, regex: bool = False) -> Column:
    return match_name(parent, pattern, regex) | match_name(child, pattern, regex)


def label_text(col: Column, pattern: str | None, regex: bool = False) -> Column:
    """File-label compare: an absent pattern matches; an empty value matches no pattern."""
    if not pattern:
        return F.lit(True)
    return F.coalesce(F.when(col == "", F.lit(False)).otherwise(match_name(col, pattern, regex)), F.lit(False))


def candidates(types: DataFrame, type_attr: DataFrame, pattern: str, *, regex: bool = False, indirect: bool = False, only: str | None = None, written: bool = False) -> DataFrame:
    """(policy_id, type): types and attributes that a name stands for.

    ``only`` keeps 'types' or 'attributes' of the direct matches. ``indirect`` adds, for the
    direct matches, the attributes of each type and the members of each attribute, one level.
    For written rules an attribute always brings its members.
    """
    direct = types.filter(match_symbol(F.col("type"), F.col("aliases"), pattern, regex))
    if only:
        direct = direct.filter(F.col("is_attr") if only == "attributes" else ~F.col("is_attr"))
    direct = direct.select("policy_id", "type", "is_attr")
    found = direct.select("policy_id", "type")
    bridge = type_attr.select("policy_id", F.col("type").alias("member"), "attr")
    if indirect:
        up = direct.filter("not is_attr").join(bridge, (direct.policy_id == bridge.policy_id) & (F.col("type") == F.col("member"))).select(direct.policy_id, F.col("attr").alias("type"))
        found = found.unionByName(up)
    if indirect or written:
        down = direct.filter("is_attr").join(bridge, (direct.policy_id == bridge.policy_id) & (F.col("type") == F.col("attr"))).select(direct.policy_id, F.col("member").alias("type"))
        found = found.unionByName(down)
    return found.distinct()


def candidate_names(table: DataFrame, column: str, pattern: str | Iterable[str], regex: bool = False) -> DataFrame:
    """(policy_id, column): roles or classes by name, regex, or a list (unknown names are ignored)."""
    if isinstance(pattern, str):
        return table.filter(match_name(F.col(column), pattern, regex)).select("policy_id", column).distinct()
    return table.filter(F.col(column).isin(list(pattern))).select("policy_id", column).distinct()


def expand_type(df: DataFrame, column: str, type_attr: DataFrame) -> DataFrame:
    """Replace attributes in ``column`` by their member types; types stay; an attribute without
    members yields nothing where ``type_attr`` knows it only as such."""
    bridge = type_attr.select("policy_id", F.col("attr").alias(column), F.col("type").alias("__member"))
    joined = df.join(bridge, ["policy_id", column], "left")
    return joined.withColumn(column, F.coalesce("__member", column)).drop("__member")
