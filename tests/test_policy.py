import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from warder.functions import mls
from warder.operators import checks, components, diff, dominance, explain, flow, labels, relabel, rules, transitions
from warder.operators.rules import RuleSearch

RULE = "policy_id string, rule_id long, kind string, source string, target string, class string, perms array<string>, cond_id long, branch boolean, enabled boolean"


def rule(i, source, target, perms, cls="file", kind="allow", policy="A", cond=None, branch=None, on=True):
    return (policy, i, kind, source, target, cls, perms.split(), cond, branch, on)


@pytest.fixture(scope="module")
def t(spark):
    types = spark.createDataFrame([(p, n, n.startswith("a"), ["alias1"] if n == "t1" else []) for p in "AB" for n in ("t1", "t2", "t3", "e1", "a1", "a2")], "policy_id string, type string, is_attr boolean, aliases array<string>")
    bridge = spark.createDataFrame([(p, x, a) for p in "AB" for x, a in (("t2", "a1"), ("t3", "a1"), ("e1", "a2"))], "policy_id string, type string, attr string")
    data = [rule(1, "t1", "a1", "read write"), rule(2, "t1", "t2", "getattr"), rule(3, "t2", "t3", "read", kind="dontaudit"), rule(4, "t3", "t1", "write", cond=1, branch=True, on=False), rule(5, "t2", "t3", "read")]
    return {"types": types, "type_attr": bridge, "rules": spark.createDataFrame(data, RULE)}


def ids(df):
    return sorted(r["rule_id"] for r in df.collect())


def test_rule_search(t):
    find = lambda **k: ids(rules.find_avrules(t["rules"], RuleSearch(**k), t["types"], t["type_attr"]))
    assert find() == [1, 2, 3, 4, 5]
    assert find(source="alias1") == [1, 2]
    assert find(target="t2") == [2]
    assert find(target="t2", target_indirect=True) == [1, 2]
    assert find(target="a1", target_indirect=True) == [1, 2, 3, 5]
    assert find(perms=["read", "write"], all_perms=True) == [1]
    assert find(perms=["read", "write"]) == [1, 3, 4, 5]
    assert find(source="t3", source_as_any=True) == [3, 4, 5]
    assert find(kinds=["allow"], only_enabled=True) == [1, 2, 5]


def test_expansion(t):
    once = rules.expand_rules(t["rules"].filter("kind = 'allow'"), t["type_attr"])
    got = {(r["source"], r["target"]): r["perms"] for r in once.filter("cond_id is null").collect()}
    assert got == {("t1", "t2"): ["getattr", "read", "write"], ("t1", "t3"): ["read", "write"], ("t2", "t3"): ["read"]}
    again = rules.expand_rules(once, t["type_attr"])
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_conditional_rules(spark, t):
    conds = spark.createDataFrame([("A", 1, [("bool", "x"), ("!", None)])], "policy_id string, cond_id long, expr array<struct<op:string,name:string>>")
    bools = spark.createDataFrame([("A", "x", False)], "policy_id string, bool string, state boolean")
    on = rules.enable_rules(t["rules"], rules.eval_conditionals(conds, bools))
    assert ids(on.filter("enabled")) == [1, 2, 3, 4, 5]
    assert ids(rules.enable_rules(t["rules"], rules.eval_conditionals(conds, bools, {"x": True})).filter("enabled")) == [1, 2, 3, 5]
    assert rules.show_conditional(t["rules"], conds).filter("rule_id = 4").first()["condition"] == "! x"
    assert ids(rules.find_avrules(t["rules"], RuleSearch(bool_name="x"), t["types"], t["type_attr"], conds)) == [4]


def test_written_rules(spark, t):
    schema = "policy_id string, syn_id long, rule_id long, lineno int, sources array<string>, targets array<string>, targets_minus array<string>, star boolean, complement boolean, self boolean, classes array<string>, perms array<string>"
    syn = spark.createDataFrame([("A", 1, 1, 10, ["t1"], ["a1"], [], False, False, False, ["file"], ["read"]), ("A", 2, 1, 11, ["t1"], [], ["t3"], True, False, False, ["file"], ["write"]), ("A", 3, 5, 12, ["t2"], ["t2"], [], False, True, False, ["dir"], ["read"]), ("A", 4, 5, 13, ["t3"], [], [], False, False, True, ["dir"], ["read"])], schema)
    find = lambda **k: sorted(r["syn_id"] for r in rules.find_written_avrules(syn, RuleSearch(**k), t["types"], t["type_attr"]).collect())
    assert find(target="t3") == [3, 4]
    assert find(target="t1") == [2, 3]
    assert find(target="a1") == [1, 2, 3, 4]
    assert find(perms=["write"]) == [2]
    assert rules.rule_line_numbers(t["rules"], syn).filter("rule_id = 1").first()["lines"] == [10, 11]
    assert rules.rule_line_numbers(t["rules"], syn, "write").filter("rule_id = 1").first()["lines"] == [11]


def perm_map(spark):
    return spark.createDataFrame([("file", "read", "r", 10), ("file", "getattr", "r", 3), ("file", "write", "w", 5)], "class string, perm string, direction string, weight int")


def test_flows(spark, t):
    edges = flow.flow_edges(t["rules"], perm_map(spark), t["type_attr"])
    got = {(r["src"], r["dst"]): r["length"] for r in edges.collect()}
    assert got == {("t2", "t1"): 8, ("t3", "t1"): 1, ("t1", "t2"): 6, ("t1", "t3"): 6, ("t3", "t2"): 1}
    low = flow.flow_edges(t["rules"], perm_map(spark), t["type_attr"], edge_length="min")
    assert {(r["src"], r["dst"]): r["length"] for r in low.collect()}[("t2", "t1")] == 1
    start = lambda n: spark.createDataFrame([("A", n)], "policy_id string, type string")
    out = flow.transitive_flows(edges, start("t3"), "out")
    into = flow.transitive_flows(edges, start("t1"), "in")
    assert {(r["end"]): (r["length"], r["path"]) for r in out.collect()} == {"t1": (1, ["t3", "t1"]), "t2": (1, ["t3", "t2"])}
    assert {r["end"]: r["length"] for r in into.collect()} == {"t3": 1, "t2": 8}
    assert flow.direct_flows(edges, start("t1"), "both").count() == 2
    best = flow.flow_alternatives(edges, spark.createDataFrame([("A", "t3", "t1")], "policy_id string, start string, end string"), 2).first()
    assert best["length"] == 1


def test_transitions(spark, t):
    data = [rule(1, "t1", "t2", "transition", "process"), rule(2, "t2", "e1", "entrypoint"), rule(3, "t1", "e1", "execute"), rule(4, "t1", "t3", "transition", "process")]
    te = spark.createDataFrame([("A", "type_transition", "t1", "e1", "process", "t2", 9, True), ("A", "type_transition", "t3", "e1", "process", "t1", 8, True)], "policy_id string, kind string, source string, target string, class string, default_type string, rule_id long, enabled boolean")
    edges = transitions.edge_tables(spark.createDataFrame(data, RULE), te, t["type_attr"])
    start = spark.createDataFrame([("A", "t1")], "policy_id string, type string")
    show = lambda df: sorted((r["start"], r["ep"] or "", r["end"]) for r in df.collect())
    assert show(transitions.domain_transitions(edges, start)) == [("t1", "e1", "t2")]
    assert show(transitions.domain_transitions(edges, start, which="invalid")) == [("t1", "", "t3")]
    assert show(transitions.domain_transitions(edges, start, which="both", pattern="3$")) == [("t1", "", "t3")]
    end = spark.createDataFrame([("A", "t2")], "policy_id string, type string")
    assert show(transitions.domain_transitions(edges, end, forward=False)) == [("t1", "e1", "t2")]
    assert show(transitions.orphan_type_transitions(edges)) == [("t3", "e1", "t1")]
    asked = spark.createDataFrame([("A", "t1", "e1", "t2"), ("A", "t1", "e1", "t3")], "policy_id string, start string, ep string, end string")
    assert {r["end"]: r["missing"] for r in transitions.verify_transitions(edges, asked).collect()} == {"t2": [], "t3": ["entrypoint", "setexec", "type_transition"]}


def test_relabel(spark, t):
    data = [rule(1, "t1", "t2", "relabelfrom"), rule(2, "t1", "t3", "relabelto"), rule(3, "t1", "e1", "relabelfrom relabelto")]
    rights = relabel.relabel_rights(spark.createDataFrame(data, RULE), t["type_attr"])
    start = spark.createDataFrame([("A", "t2")], "policy_id string, type string")
    assert {r["end"]: r["direction"] for r in relabel.relabel_object(rights, start).collect()} == {"t3": "to", "e1": "to"}
    assert {r["type"]: r["direction"] for r in relabel.relabel_subject(rights, "t1").collect()} == {"t2": "from", "t3": "to", "e1": "both"}


def test_diff_properties(spark, t):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "orig_id string, mod_id string")
    other = spark.createDataFrame([rule(1, "t1", "a1", "read", policy="B"), rule(9, "t9", "t2", "read", policy="B")], RULE)
    both = t["rules"].unionByName(other)
    types = t["types"].unionByName(spark.createDataFrame([("B", "t9", False, [])], t["types"].schema))

    def run(a, b):
        ids_ = diff.type_map(types, pair(a, b), diff.type_remap_infer(types, pair(a, b)))
        return {r["key"]: (r["form"], sorted(r["added"]), sorted(r["removed"])) for r in diff.diff_avrules(both, t["type_attr"], pair(a, b), ids_).collect()}

    assert run("A", "A") == {}
    ab, ba = run("A", "B"), run("B", "A")
    assert ab["t1 t3 file "] == ("modified", [], ["write"]) and ba["t1 t3 file "] == ("modified", ["write"], [])
    assert ab["+t9 t2 file "][0] == "add_by_type" and ba["-t9 t2 file "][0] == "remove_by_type"
    assert ab["t2 t3 file "][0] == "removed" and ba["t2 t3 file "][0] == "added"


def test_remap_by_alias(spark):
    types = spark.createDataFrame([("A", "old", False, []), ("B", "new", False, ["old"]), ("A", "same", False, []), ("B", "same", False, []), ("A", "gone", False, [])], "policy_id string, type string, is_attr boolean, aliases array<string>")
    pairs = spark.createDataFrame([("A", "B")], "orig_id string, mod_id string")
    remap = diff.type_remap_infer(types, pairs)
    assert {(r["orig_type"], r["mod_type"]) for r in remap.collect()} == {("old", "new"), ("same", "same")}
    named = {(r["side"], r["type"]): r["id"] for r in diff.type_map(types, pairs, remap).collect()}
    assert named[("orig", "old")] == named[("mod", "new")] and named[("orig", "gone")] == "-gone"
    user = spark.createDataFrame([("A", "B", "gone", "new")], "orig_id string, mod_id string, orig_type string, mod_type string")
    assert ("gone", "new") in {(r["orig_type"], r["mod_type"]) for r in diff.type_remap_infer(types, pairs, user).collect()}


def test_remap_needs_equal_aliases(spark):
    rows = [("A", "a", ["p"]), ("A", "b", ["q", "r"]), ("A", "c", ["u", "v"]), ("B", "x", ["p", "q"]), ("B", "y", ["r"]), ("B", "z", ["v", "u"]), ("A", "d", []), ("B", "w", [])]
    types = spark.createDataFrame([(p, n, False, al) for p, n, al in rows], "policy_id string, type string, is_attr boolean, aliases array<string>")
    remap = diff.type_remap_infer(types, spark.createDataFrame([("A", "B")], "orig_id string, mod_id string"))
    assert [(r["orig_type"], r["mod_type"]) for r in remap.collect()] == [("c", "z")]


def test_checks(spark, t):
    roles = spark.createDataFrame([("A", "r1"), ("A", "r2"), ("A", "object_r")], "policy_id string, role string")
    user_role = spark.createDataFrame([("A", "u1", "r1")], "policy_id string, user_name string, role string")
    with pytest.raises(ValueError, match="needs"):
        checks.run_checks(t, ["roles_wo_users"])
    items = {r["item"] for r in checks.run_checks({"roles": roles, "user_role": user_role}, ["roles_wo_users"]).collect()}
    assert items == {"r2"}
    proof = {(r["item"], r["element"]) for r in checks.run_checks(t, ["spurious_audit"]).collect()}
    assert proof == {("t2 t3 file", "read")}
    assert checks.run_checks({"roles": roles, "user_role": user_role}, None, None, "low").count() == 1


def test_labels(spark, tmp_path):
    rows = [("h", "/en/a", 1, "d0", "u", "r", "t1", "s0", "file"), ("h", "/en/b", 2, "d1", "u", "r", "t2", "s0-s2:c0.c2", "dir"), ("h", "/x", 3, "d0", "u", "r", "t1", None, "file")]
    inv = spark.createDataFrame(rows, "host string, path string, inode long, dev string, user_name string, role string, type string, rng string, obj_class string")
    S = labels.LabelSearch
    inodes = lambda s: sorted(r["inode"] for r in labels.query_labels(inv, s).collect())
    assert inodes(S(type="t1")) == [1, 3] and inodes(S(path="^/en", regex=True)) == [1, 2] and inodes(S(dev="d1")) == [2]
    assert inodes(S(range="s1:c0", relation="sub")) == [2] and inodes(S(range="s0", relation="exact")) == [1]
    labels.save_label_index(labels.build_label_index(inv), str(tmp_path / "i"))
    index = labels.open_label_index(spark, str(tmp_path / "i"))
    assert sorted(r["inode"] for r in labels.query_label_index(index, S(type="t1", dev="d0")).collect()) == [1, 3]
    assert labels.index_rows(index).count() == 3 and labels.label_index_info(index).first()["mls"]
    specs = [(1, "/.*", None, "u:r:t9:s0"), (2, "/en(/.*)?", "--", "u:r:t1:s0"), (3, "/x", None, "<<none>>")]
    got = {r["inode"]: (r["line_no"], r["mismatch"]) for r in labels.expected_labels(inv, spark.createDataFrame(specs, "line_no int, path_regex string, kind string, context string")).collect()}
    assert got == {1: (2, False), 2: (1, True), 3: (3, False)}
    plan = labels.plan_relabel(inv, S(type="t2"), type_="t5").first()
    assert (plan["old"], plan["new"]) == ("u:r:t2:s0-s2:c0.c2", "u:r:t5:s0-s2:c0.c2")
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["# c", "", "/srv(/.*)?  --  u:o:p7", "/a -? u:o:t", "/b <<none>>"])], "origin string, line_no int, line string")
    assert [(r["path_regex"], r["kind"], r["bad"]) for r in labels.parse_label_specs(lines).orderBy("line_no").collect()] == [("/srv(/.*)?", "--", False), ("/a", "-?", True), ("/b", None, False)]


def test_components(spark, t):
    levels = spark.createDataFrame([("A", "s0", []), ("A", "s1", ["top"])], "policy_id string, sens string, aliases array<string>")
    cats = spark.createDataFrame([("A", "s1", "c0")], "policy_id string, sens string, cat string")
    assert [r["sens"] for r in components.find_levels(levels, cats).collect()] == ["s1"]
    assert [r["sens"] for r in components.find_levels(levels, cats, "top").collect()] == ["s1"]
    classes = spark.createDataFrame([("A", "file", "base"), ("A", "key", None)], "policy_id string, class string, common string")
    assert [r["class"] for r in components.find_classes(classes, common="ba", regex=True).collect()] == ["file"]
    constraints = spark.createDataFrame([("A", "file", ["read"], [("attr", "user", "==", None), ("names", "type", "==", ["t1"])])], "policy_id string, class string, perms array<string>, expr array<struct<kind:string,sym:string,op:string,names:array<string>>>")
    assert components.find_constraints_by_expr(constraints, names=["t1"]).count() == 1
    assert components.find_constraints_by_expr(constraints, ops=["dom"]).count() == 0
    assert components.symbols_in_namespace({"type": (t["types"].withColumn("type", F.concat(F.lit("ns."), "type")), "type")}, "ns").filter("policy_id = 'A'").count() == 6


def test_explain(spark, t):
    msg = spark.createDataFrame([(1, "t1", "t3", "file", "denied"), (2, "t3", "e1", "file", "denied")], "msg_id long, stype string, ttype string, tclass string, decision string")
    assert {(r["msg_id"], r["rule_id"]) for r in explain.explain_messages(msg, t["rules"], t["type_attr"].filter("policy_id = 'A'")).collect()} == {(1, 1)}
    assert [r["msg_id"] for r in explain.unexplained_denials(msg, t["rules"], t["type_attr"]).collect()] == [2]


def test_flows_reach_far_ends(spark, monkeypatch):
    chain = [("A", f"n{i}", "subject" if i % 2 else "object", f"n{i + 1}", "object" if i % 2 else "subject", 1, [i]) for i in range(6)]
    edges = spark.createDataFrame(chain, "policy_id string, src string, src_side string, dst string, dst_side string, length int, rule_ids array<long>")
    start = spark.createDataFrame([("A", "n0")], "policy_id string, type string")
    assert {r["end"]: r["length"] for r in flow.transitive_flows(edges, start).collect()} == {f"n{i}": i for i in range(1, 7)}
    assert flow.transitive_flows(edges, start, max_hops=3).count() == 3
    monkeypatch.setattr(flow, "MOST_ROUNDS", 4)
    with pytest.raises(RuntimeError):
        flow.transitive_flows(edges, start)


def simple_paths(edges, start, end):
    """All loop-free ways from a type to the first arrival at another, with their lengths."""
    out, stack = [], [(0, [(start, side)]) for side in ("subject", "object")]
    while stack:
        length, path = stack.pop()
        for (a, b), w in edges.items():
            if a == path[-1] and b not in path:
                if b[0] == end:
                    out.append((length + w, [*path, b]))
                else:
                    stack.append((length + w, [*path, b]))
    return out


def test_k_shortest_flows(spark):
    rng = random.Random(1)
    nodes = [(f"n{i}", side) for i in range(6) for side in ("subject", "object")]
    edges = {}
    for _ in range(26):
        a, b = rng.choice(nodes), rng.choice(nodes)
        if a[0] != b[0]:
            edges[a, b] = rng.randint(1, 10)
    edges |= {(("n0", "object"), ("m1", "subject")): 1, (("m1", "subject"), ("m2", "object")): 10, (("m2", "object"), ("n5", "subject")): 10}
    table = spark.createDataFrame([("A", *a, *b, w, [0]) for (a, b), w in edges.items()], "policy_id string, src string, src_side string, dst string, dst_side string, length int, rule_ids array<long>")
    asked = [("n0", "n5"), ("n1", "n3"), ("n4", "n2"), ("n2", "n2"), ("n5", "m1")]
    pairs = spark.createDataFrame([("A", *p) for p in asked], "policy_id string, start string, end string")
    got = collections.defaultdict(list)
    for r in flow.flow_alternatives(table, pairs, 4).collect():
        got[r["start"], r["end"]].append((r["rank"], r["length"], r["path"]))
    for pair in asked:
        want = simple_paths(edges, *pair) if pair[0] != pair[1] else []
        found = sorted(got[pair])
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        assert [x[1] for x in found] == sorted(w for w, _ in want)[:4]
        assert all((length, path) in [(w, [v[0] for v in p]) for w, p in want] for _, length, path in found)
    starts = spark.createDataFrame([("A", f"n{i}") for i in range(6)], "policy_id string, type string")
    flows = {(r["start"], r["end"]): r for r in flow.transitive_flows(table, starts).collect()}
    for start in (f"n{i}" for i in range(6)):
        for end in {v[0] for v in nodes} | {"m1", "m2"}:
            want = simple_paths(edges, start, end) if start != end else []
            if not want:
                assert (start, end) not in flows
                continue
            r = flows[start, end]
            assert r["length"] == min(want)[0] and r["hops"] == len(r["path"]) - 1
            assert (r["length"], r["path"]) in [(w, [v[0] for v in p]) for w, p in want]


def test_literal_stems():
    cases = {
        "/usr/lib/x(/.*)?": "/usr/lib/x", "/usr/.*": "/usr", "/usr/lib.*": "/usr", "/usr/lib(64)?/x": "/usr", "/usr(/.*)?": "/usr", "/usr(/a)?b": "", "/usr/?x": "", "/a/b|/c": "",
        "/etc/a\\.conf": "/etc/a.conf", "/etc/a.conf": "/etc", "/.*": "", "(/usr)?/x": "", "/a/[bc]/d": "/a", "/a(/x|/y)?": "/a", "/a/b{2}": "/a", "/": "", "/a(/b)?(/c)?": "", "/a(/[)]x)?": "/a",
    }
    assert {p: labels.literal_stem(p) for p in cases} == cases
    rng, pool = random.Random(6), ["/usr", "/a", "(/.*)?", "/?", "b", "(/b|/c)", ".*", "[ab]", "/b+", "(x)?", "\\.d"]
    paths = ["".join(rng.choice(["/usr", "/a", "/b", "b", "x", "/c", ".d", "/x"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    for _ in range(400):
        pattern = "".join(rng.choice(pool) for _ in range(rng.randint(1, 4)))
        stem = labels.literal_stem(pattern)
        assert all((p + "/").startswith(stem + "/") for p in paths if stem and re.fullmatch(pattern, p)), (pattern, stem)


def test_spec_candidates_are_bounded_by_depth(spark):
    specs = [(0, "/.*", None, "u:r:t:s0")] + [(n, f"/usr/d{n % 100}/e{n}(/.*)?", None, "u:r:t:s0") for n in range(1, 10_000)] + [(10_000, "/usr/.*", None, "u:r:t:s0")]
    files = [(f"/usr/d{i % 100}/e{i}/f", i) for i in range(1, 200)]
    table = spark.createDataFrame(files, "path string, inode long")
    found = labels.spec_candidates(table, spark.createDataFrame(specs, "line_no int, path_regex string, kind string, context string"))
    assert found.groupBy("inode").count().agg(F.max("count")).first()[0] == 3 and found.count() == 3 * len(files)


def test_covered_ranges(spark):
    rng = random.Random(11)
    names = [f"c{i}" for i in range(140)]
    level = lambda: ("s", rng.randrange(4), rng.choice([None, rng.sample(names, rng.choice([0, 1, 2])), names[: rng.choice([70, 140])]]))
    some = lambda n: [("A", rng.choice("xyz"), i, (level(), rng.choice([None, level()]))) for i in range(n)]
    kind = "struct<sens:string,rank:int,cats:array<string>>"
    schema = f"policy_id string, source string, id int, range struct<low:{kind},high:{kind}>"
    rows, ranges = spark.createDataFrame(some(150), schema), spark.createDataFrame(some(60), schema)
    got = sorted(r["id"] for r in dominance.covered(rows, ranges.drop("id"), ["policy_id", "source"]).collect())
    pairs = rows.join(ranges.select("policy_id", "source", F.col("range").alias("may")), ["policy_id", "source"]).filter(mls.range_contains(F.col("may"), F.col("range")))
    assert got == sorted(r["id"] for r in pairs.select("id").distinct().collect()) and 0 < len(got) < 150
    assert dominance.covered(rows.limit(0), ranges, ["policy_id", "source"]).count() == 0


def test_explain_joins_a_message_once_a_policy(spark, t):
    """The rules of a policy that concern one pair of types come in a row; before, each was joined on its own."""
    msg = spark.createDataFrame([(1, "a", "b", "file")], "msg_id long, stype string, ttype string, tclass string")
    rules = spark.createDataFrame([("A", i, k, "a", to, "file", ["read"]) for i, (k, to) in enumerate([("allow", "b"), ("allow", "at"), ("dontaudit", "b"), ("allow", "c")])], "policy_id string, rule_id int, kind string, source string, target string, class string, perms array<string>")
    attr = spark.createDataFrame([("A", "b", "at"), ("A", "c", "at")], "policy_id string, type string, attr string")
    found = explain.explain_messages(msg, rules, attr)
    assert sorted((r["kind"], r["rule_target"], r["rule_id"]) for r in found.collect()) == [("allow", "at", 1), ("allow", "b", 0), ("dontaudit", "b", 2)]
    assert "Generate inline(__rules" in found._jdf.queryExecution().simpleString()
