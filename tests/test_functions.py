import collections
import fnmatch
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from warder.functions import conditions, mls
from warder.functions.predicates import candidates, extended_regex, glob_regex, label_text, match_any_of, match_name, match_symbol


@pytest.mark.parametrize("pattern", ["*", "a?c", "[ab]*", "[!a]b", "a.b", "x[", "a+b", "*.log", "", "a\\*"])
@pytest.mark.parametrize("text", ["abc", "ab", "b", "a.b", "axb", "x[", "a+b", "/var/x.log", "", "a*", "cb"])
def test_glob(pattern, text):
    want = text == "a*" if pattern == "a\\*" else fnmatch.fnmatchcase(text, pattern)
    assert bool(re.fullmatch(glob_regex(pattern)[4:].strip("^$"), text, re.S)) == want


def test_extended_regex():
    assert extended_regex("^[[:alpha:]_]+$") == r"^[\p{Alpha}_]+$"
    assert extended_regex("a|b") == "a|b"


def test_match_names(spark):
    df = spark.createDataFrame([("s1", ["alias1"]), ("p1", []), (None, None)], "type string, aliases array<string>")
    hit = lambda c: [r["type"] for r in df.filter(c).collect()]
    assert hit(match_name(F.col("type"), None)) == ["s1", "p1", None]
    assert hit(match_name(F.col("type"), "1$", True)) == ["s1", "p1"]
    assert hit(match_name(F.col("type"), "s")) == []
    assert hit(match_symbol(F.col("type"), F.col("aliases"), "alias1")) == ["s1"]
    assert hit(match_any_of(F.col("aliases"), "ali", True)) == ["s1"]
    assert hit(label_text(F.col("type"), "p1")) == ["p1"]
    assert hit(~match_name(F.col("type"), "s1")) == ["p1", None]


def test_candidates_are_one_level(spark):
    types = spark.createDataFrame([("A", t, t.startswith("a"), []) for t in ("t1", "t2", "a1", "a2")], "policy_id string, type string, is_attr boolean, aliases array<string>")
    bridge = spark.createDataFrame([("A", "t1", "a1"), ("A", "t2", "a1"), ("A", "t2", "a2")], "policy_id string, type string, attr string")
    got = lambda *a, **k: {r["type"] for r in candidates(types, bridge, *a, **k).collect()}
    assert got("t1") == {"t1"}
    assert got("t1", indirect=True) == {"t1", "a1"}
    assert got("a1", indirect=True) == {"a1", "t1", "t2"}
    assert got("a1") == {"a1"}
    assert got("a1", written=True) == {"a1", "t1", "t2"}
    assert got(".", regex=True, only="attributes") == {"a1", "a2"}


def ask(spark, text, column):
    a, b = (mls.parse_range(F.lit(t)) for t in text)
    return spark.range(1).select(column(a, b).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("target", "search", "exact", "sub", "super_", "intersect"),
    [
        ("s0 - s3:c0.c3", "s1:c0 - s2:c0.c1", False, True, False, True),
        ("s1:c0", "s1:c0", True, True, True, True),
        ("s0 - s1:c0", "s1 - s2:c0", False, False, False, True),
        ("s0", "s1", False, False, False, False),
        ("s1:c0", "s1:c1", False, False, False, False),
        ("s1", "s1:c0", False, False, False, False),
        ("s1:c0 - s1:c0.c2", "s0 - s2:c0.c5", False, False, True, True),
    ],
)
def test_range_relations(spark, target, search, exact, sub, super_, intersect):
    got = [ask(spark, (target, search), lambda a, b, r=r: mls.range_compare(a, b, r)) for r in ("exact", "sub", "super", "intersect")]
    assert got == [exact, sub, super_, intersect]


@pytest.mark.parametrize(("a", "b", "want"), [("s1:c0,c1", "s1:c0.c1", "eq"), ("s2:c0", "s1", "dom"), ("s1", "s2:c1", "domby"), ("s1:c0", "s2", "incomp")])
def test_level_compare(spark, a, b, want):
    assert ask(spark, (a, b), lambda x, y: mls.level_compare(x["low"], y["low"])) == want


@pytest.mark.parametrize("text", ["s0", "s0 - s2:c1.c4,c7", "s1:c0,c2", "s3:c0,c1,c5.c9"])
def test_render_parses_back(spark, text):
    again = spark.range(1).select(mls.render_range(mls.parse_range(F.lit(text))).alias("x")).first()["x"]
    assert again == text


def expr(*items):
    return F.array(*[F.struct(F.lit("bool" if i.isalpha() else i).alias("op"), F.lit(i if i.isalpha() else None).cast("string").alias("name")) for i in items])


def test_conditions(spark):
    states = F.create_map(F.lit("a"), F.lit(True), F.lit("b"), F.lit(False))
    cases = {("a", "b", "&&"): False, ("a", "b", "||"): True, ("a", "b", "!", "&&"): True, ("a", "b", "^"): True, ("a", "b", "=="): False, ("a", "b", "!="): True, ("c",): False}
    for items, want in cases.items():
        assert spark.range(1).select(conditions.evaluate(expr(*items), states).alias("x")).first()["x"] is want
    assert spark.range(1).select(conditions.render(expr("a", "b", "!", "&&")).alias("x")).first()["x"] == "(a && ! b)"


def test_condition_identity_over_negation(spark):
    key = lambda e, b: spark.range(1).select(conditions.truth_key(e, F.lit(b)).alias("x")).first()["x"]
    assert key(expr("x"), True) == key(expr("x", "!"), False) != key(expr("x"), False)
    assert key(expr("a", "b", "&&"), True) == key(expr("b", "a", "&&"), True)
    # any number of booleans, in any form
    for n in (6, 12):
        names = [chr(ord("a") + i) for i in range(n)]
        long = [names[0], *[x for name in names[1:] for x in (name, "&&")]]
        turned = [*[x for name in names for x in (name, "!")], *["||"] * (n - 1)]
        mixed = [*names, *["^"] * (n - 1)]
        assert key(expr(*long), True) == key(expr(*turned), False) != key(expr(*long), False)
        assert key(expr(*mixed), True) == key(expr(*reversed(names), *["!="] * (n - 1)), True) != key(expr(*mixed, "!"), True)
        assert key(expr(*mixed, "!"), False) == key(expr(*mixed), True)
    assert key(expr("a", "a", "!", "||"), True) != key(expr("b", "b", "!", "||"), True)


def test_condition_identity_is_truth():
    rng = random.Random(4)
    names = "abcdefg"

    def some(depth):
        if not depth or rng.random() < 0.2:
            return [("bool", rng.choice(names))]
        if rng.random() < 0.3:
            return [*some(depth - 1), ("!", None)]
        return [*some(depth - 1), *some(depth - 1), (rng.choice(["&&", "||", "^", "==", "!="]), None)]

    def truth(e):
        def value(states):
            stack = []
            for op, name in e:
                if op == "bool":
                    stack.append(states[name])
                elif op == "!":
                    stack.append(not stack.pop())
                else:
                    b, a = stack.pop(), stack.pop()
                    stack.append({"&&": a and b, "||": a or b, "^": a != b, "!=": a != b, "==": a == b}[op])
            return stack[-1]

        return tuple(value(dict(zip(names, v, strict=True))) for v in itertools.product([False, True], repeat=len(names)))

    by_key, by_truth = collections.defaultdict(set), collections.defaultdict(set)
    for _ in range(400):
        e = some(4)
        used = tuple(sorted({n for op, n in e if op == "bool"}))
        for k, t in zip(conditions.identities(e), (truth(e), tuple(not v for v in truth(e))), strict=True):
            by_key[k].add((used, t))
            by_truth[used, t].add(k)
    assert all(len(v) == 1 for v in (*by_key.values(), *by_truth.values()))

