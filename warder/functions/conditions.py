"""Postfix conditional expressions: array<struct<op, name>>, op one of bool ! || && ^ == !=."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def evaluate(expr: Column, states: Column) -> Column:
    """Truth under ``states`` (map name -> boolean); an unknown name is false."""

    def step(stack: Column, x: Column) -> Column:
        n = F.size(stack)
        top, under = F.element_at(stack, -1), F.element_at(stack, -2)
        two = F.slice(stack, F.lit(1), n - 2)
        put = lambda rest, v: F.concat(rest, F.array(v))
        return (
            F.when(x["op"] == "bool", put(stack, F.coalesce(F.try_element_at(states, x["name"]), F.lit(False))))
            .when(x["op"] == "!", put(F.slice(stack, F.lit(1), n - 1), ~top))
            .when(x["op"] == "&&", put(two, under & top))
            .when(x["op"] == "||", put(two, under | top))
            .when(x["op"].isin("^", "!="), put(two, under != top))
            .otherwise(put(two, under == top))
        )

    return F.aggregate(expr, F.array().cast("array<boolean>"), step, lambda s: F.element_at(s, -1))


def render(expr: Column) -> Column:
    """Infix text."""

    def step(stack: Column, x: Column) -> Column:
        n = F.size(stack)
        top, under = F.element_at(stack, -1), F.element_at(stack, -2)
        one, two = F.slice(stack, F.lit(1), n - 1), F.slice(stack, F.lit(1), n - 2)
        return (
            F.when(x["op"] == "bool", F.concat(stack, F.array(x["name"])))
            .when(x["op"] == "!", F.concat(one, F.array(F.concat(F.lit("! "), top))))
            .otherwise(F.concat(two, F.array(F.concat(F.lit("("), under, F.lit(" "), x["op"], F.lit(" "), top, F.lit(")")))))
        )

    return F.aggregate(expr, F.array().cast("array<string>"), step, lambda s: F.element_at(s, -1))


def names(expr: Column) -> Column:
    """Sorted distinct booleans."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(expr, lambda x: x["op"] == "bool"), lambda x: x["name"])))


class Diagram:
    """Reduced ordered decision diagram of a truth function: nodes (boolean, if false, if true),
    no two alike and none with equal ends, so that equal functions are the same node."""

    def __init__(self, order: list[str]):
        self.level = {name: i for i, name in enumerate(order)}
        self.nodes: list[tuple[int, int, int]] = [(len(order), 0, 0), (len(order), 1, 1)]  # false, true
        self.known: dict[tuple[int, int, int], int] = {}
        self.done: dict[tuple, int] = {}

    def node(self, level: int, low: int, high: int) -> int:
        if low == high:
            return low
        if (level, low, high) not in self.known:
            self.known[level, low, high] = len(self.nodes)
            self.nodes.append((level, low, high))
        return self.known[level, low, high]

    def variable(self, name: str) -> int:
        return self.node(self.level[name], 0, 1)

    def apply(self, table: tuple[int, int, int, int], a: int, b: int) -> int:
        """The function with truth ``table`` (for 00, 01, 10, 11) of two functions."""
        if a < 2 and b < 2:
            return table[2 * a + b]
        if (table, a, b) not in self.done:
            (i, a0, a1), (j, b0, b1) = self.nodes[a], self.nodes[b]
            ends = [self.apply(table, x if i <= j else a, y if j <= i else b) for x, y in ((a0, b0), (a1, b1))]
            self.done[table, a, b] = self.node(min(i, j), *ends)
        return self.done[table, a, b]

    def text(self, root: int) -> str:
        """The nodes below root in the order in which a walk meets them."""
        number: dict[int, int] = {0: 0, 1: 1}
        out, stack = [], [root]
        while stack:
            n = stack.pop()
            if n not in number:
                number[n] = len(number)
                stack += [self.nodes[n][2], self.nodes[n][1]]
        for n in list(number)[2:]:
            level, low, high = self.nodes[n]
            out.append(f"{level}?{number[high]}:{number[low]}")
        return " ".join(out) or str(root)


TABLES = {"&&": (0, 0, 0, 1), "||": (0, 1, 1, 1), "^": (0, 1, 1, 0), "!=": (0, 1, 1, 0), "==": (1, 0, 0, 1)}


def identities(expr: list[tuple[str, str | None]]) -> tuple[str, str]:
    """Identities of the true and the false branch of a postfix expression."""
    found = sorted({name for op, name in expr if op == "bool"})
    diagram, stack = Diagram(found), []
    for op, name in expr:
        if op == "bool":
            stack.append(diagram.variable(name))
        elif op == "!":
            stack.append(diagram.apply(TABLES["^"], stack.pop(), 1))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(diagram.apply(TABLES[op], a, b))
    no = diagram.apply(TABLES["^"], stack[-1], 1)
    names = ",".join(found)
    return f"{names};{diagram.text(stack[-1])}", f"{names};{diagram.text(no)}"


@F.pandas_udf(StructType([StructField("yes", StringType()), StructField("no", StringType())]))
def _keys(expr: pd.Series) -> pd.DataFrame:
    known: dict[tuple, tuple[str, str]] = {}
    out = []
    for e in expr:
        key = tuple((x["op"], x["name"]) for x in e) if e is not None else None
        if key is not None and key not in known:
            known[key] = identities(list(key))
        out.append(known.get(key, (None, None)))
    return pd.DataFrame(out, columns=["yes", "no"])


def truth_keys(expr: Column) -> Column:
    """Struct (yes, no): what the true and the false branch of a condition are known by: its
    sorted booleans and the reduced decision diagram of its truth, so that the true branch of x
    is the false branch of ``!x``, whatever the form and the number of booleans. A null
    condition has none. Diagrams are short for conditions as people write them; at worst they
    grow as 2 to the number of booleans."""
    return _keys(expr)


def truth_key(expr: Column, branch: Column) -> Column:
    keys = truth_keys(expr)
    return F.when(branch, keys["yes"]).otherwise(keys["no"])
