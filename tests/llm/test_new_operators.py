"""Importance resampling, conversation trie and language identification against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from warder.llm import importance, language, trie

SCHEMA = "doc_id long, text string, lang string, row_id long, rank long, weight long, buckets int, score string"


def words_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in small).split(" ")


def runs_of(text, few, many):
    words = [w for w in words_of(text) if w]
    return words, [" ".join(words[i : i + n]) for n in range(few, many + 1) for i in range(len(words) - n + 1)]


def importance_by_hand(docs, target, few, many, buckets, least, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    source = collections.Counter(bucket(g) for _, t in docs for g in runs_of(t, few, many)[1])
    wanted = collections.Counter(bucket(g) for t in target for g in runs_of(t, few, many)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for doc_id, text in docs:
        words, grams = runs_of(text, few, many)
        weight = sum(gain(bucket(g)) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [i + 1 for i in range(percent * len(may) // 100)] + [None] * len(may)
    return sorted([(*r, k) for r, k in zip(may, ranks)] + [(*r, None) for r in out if r[1] < least], key=str)  # noqa: B905


def some_documents():
    rng = random.Random(5)
    vocabulary = ["Ab", "cd", "éf", "g1", "İx", "h\x7fi", "日本", "z_z"] + [f"W{i}" for i in range(60)]
    docs = [(i, rng.choice([" ", "\n\t", "--", " . "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(120, None), (121, ""), (122, "   "), (None, " ".join(vocabulary)), (None, None), docs[3], docs[3], (123, "long " * 30_000)]
    return docs, [" ".join(vocabulary[:20]), None, "", "Ab cd"]


@pytest.mark.parametrize(("few", "many"), [(1, 1), (1, 3), (2, 2)])
def test_importance(spark, few, many):
    docs, target = some_documents()
    table = spark.createDataFrame([(*d, "en", 7, 7, 7, 7, "s") for d in docs], SCHEMA).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.scores(table, wanted, few, many, 500, 20, 10)
    rows = sorted([tuple(r) for r in got.drop("row_id").collect()], key=str)
    assert rows == importance_by_hand(docs, target, few, many, 500, 20, 10)
    drawn = importance.resample(table, wanted, few, many, 500, 20, 10)
    assert drawn.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in drawn.collect()) == sorted(r[0] or -1 for r in rows if r[5] is not None)


def test_importance_of_empty_tables(spark):
    docs, target = some_documents()
    none = spark.createDataFrame([], SCHEMA)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert importance.scores(none, wanted).count() == importance.resample(none, wanted).count() == 0
    table = spark.createDataFrame([(*d, "en", 7, 7, 7, 7, "s") for d in docs], SCHEMA)
    rows = sorted([tuple(r) for r in importance.scores(table, none).drop("row_id").collect()], key=str)
    assert rows == importance_by_hand(docs, [], 1, 1, 10_000, 20, 10)


def test_scan_emits_every_run():
    scan = importance.Scanner(2, 3)
    text = importance.collapsed("A b,c  D".encode())
    assert text == b"a b c d"
    assert list(scan.grams(text)) == [b"a b", b"b c", b"c d", b"a b c", b"b c d"]


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for conv, found in own.items():
        turns = [t[2:] for t in sorted(found)]
        if conv is None:
            seqs[conv] = turns
            continue
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(math.fmod(conv, 100))
        seqs[conv] = [t[2:] for t in sorted(own.get(base, []))][:h] + turns[h:]
    members, children, ends = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for conv, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(conv)
            if d:
                children[tuple(seq[: d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(conv)
    least = lambda m: min((c for c in m if c is not None), default=None)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        kids = children.get(key, ())
        leaves[key] = sum(leaves[k] for k in kids) or 1
        saved[key] = sum(saved[k] for k in kids) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
    return sorted(
        (
            (least(m), len(k), least(members[k[:-1]]) if k else None, len(m), len(children.get(k, ())), leaves[k], saved[k],
             hashlib.sha256(",".join(str(c) for c in sorted(c for c in ends.get(k, []) if c is not None)).encode()).hexdigest())
            for k, m in members.items()
        ),
        key=str,
    )


def some_conversations():
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), *range(100, 160), 203, 207, -5, -130, -100]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 9])):
            rows.append((conv, turn, "user" if turn % 2 else "assistant", rng.choice(["hello", "é日", "b" * 70, ""]) if rng.random() < 0.7 else f"{conv}:{turn}"))
    rows += [(7, None, None, None), (7, None, "user", "first"), (8, 3, None, "x"), (8, 3, "user", None), (None, 1, "user", "no id"), (None, None, "user", "hello")]
    rows += [(105, t, "user", f"t{t}") for t in range(300)]  # a long chain
    rows += [(300 + i, t, "user", f"s{t}") for i in range(40) for t in range(6, 6 + 40 - i)]  # every prefix ends somewhere
    rows += [(900, 1, "user", "again")] * 50 + [(1000 + i, t, "user", "copy") for i in range(80) for t in range(6)]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, id string, parent long, part string, depth int"


def test_trie(spark):
    rows = some_conversations()
    table = spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], CONVERSATIONS).repartition(7)
    got = sorted((tuple(r) for r in trie.prefix_trie(table).collect()), key=str)
    assert got == trie_by_hand(rows)


def test_trie_of_small_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    one = [(5, 0, "user", "a")]  # its turns are replaced by those of an absent conversation
    table = spark.createDataFrame([(*one[0], "a", 1, "b", 2)], CONVERSATIONS)
    assert [tuple(r) for r in trie.prefix_trie(table).collect()] == trie_by_hand(one)


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random", "forest"])
def test_contraction(spark, shape):
    rng = random.Random(shape)
    n = 200
    parent = {
        "chain": lambda i: i - 1,
        "star": lambda i: 0,
        "comb": lambda i: i - 1 if i % 2 else max(0, i - 2),
        "random": lambda i: rng.randrange(i),
        "forest": lambda i: i - 1 if i % 9 else None,
    }[shape]
    rows = [(0, None, 1, 5)] + [(i, parent(i), 1, rng.randrange(100)) for i in range(1, n)]
    want = {i: [a, b] for i, _, a, b in rows}
    for i, up, _, _ in reversed(rows):
        if up is not None:
            want[up] = [x + y for x, y in zip(want[up], want[i], strict=True)]
    tree = spark.createDataFrame(rows, "id long, parent long, a long, b long")
    got = {r["id"]: [r["a"], r["b"]] for r in trie.subtree_totals(tree, ["a", "b"]).collect()}
    assert got == want


def test_language_gradient():
    rng = np.random.default_rng(1)
    p = language.start_params(3, 3, rng, np.float64)
    tokens = rng.integers(0, 257, (7, 5))
    mask, label = (rng.random((7, 5)) < 0.8).astype(float), np.array([0, 1, 2, 1, 0])
    _, g = language.loss_and_gradient(p, tokens, mask, label)
    for name, values in p.items():
        rows = [(tokens[0, 0], k) for k in range(4)] if name.endswith("_byte") else [tuple(rng.integers(0, s) for s in values.shape) for _ in range(4)]
        for at in rows:
            kept, eps = values[at], 1e-5
            values[at] = kept + eps
            up = language.loss_and_gradient(p, tokens, mask, label)[0]
            values[at] = kept - eps
            down = language.loss_and_gradient(p, tokens, mask, label)[0]
            values[at] = kept
            assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-7, name


def test_language_reading_equals_training_steps():
    rng = np.random.default_rng(2)
    p = language.start_params(8, 3, rng)
    net = language.Network(["a", "b", "c"], p)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 127, 128, 129, 1000)]
    got = net.probabilities(texts)
    for text, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for i in range(0, len(text), language.PIECE):
            piece = text[i : i + language.PIECE]
            tokens = np.full((language.PIECE, 1), language.FILL)
            tokens[: len(piece), 0] = list(piece)
            after = {d: {s[0]: s[-1] for s in language.run_direction(p, d, tokens)} for d in "fb"}
            for t in range(len(piece)):
                logits = (p["f_label"] @ after["f"][t] + p["b_label"] @ after["b"][t] + p["bias"])[:, 0]
                e = np.exp(logits - logits.max())
                total += e / e.sum()
        assert np.allclose(row, total / max(1, len(text)), atol=1e-4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hard = [(-1, None), (-2, ""), (-3, "12 | 34 ²"), (None, "the and of the on that"), (-4, "é"), (-5, "the " * 40_000), (-5, "the " * 40_000)]
    extra = spark.createDataFrame([(*r, None, "x", 1, "c") for r in hard], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    table = docs.withColumn("lang_pred", F.lit("none")).unionByName(extra.withColumn("n_chars", F.col("n_chars").cast(dict(docs.dtypes)["n_chars"])))
    rows = language.identify(table, language.learn(table, fit_rows=600, steps=150)).collect()
    assert len(rows) == docs.count() + len(hard)
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3
    assert by_id[-5]["lang_pred"] == "en" and by_id[None]["held_out"] and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    tried = [(r["lang_pred"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"])]
    for i, r in by_id.items():
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
    assert np.mean([a == b for a, b in tried]) > 0.97


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    rows = language.identify(docs, language.learn(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2
    assert language.identify(docs.limit(0), language.learn(docs.limit(0))).count() == 0
