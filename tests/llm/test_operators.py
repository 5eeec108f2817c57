"""Each operator on a small table of hard cases, against brute force."""

import base64
import collections
import hashlib
import heapq
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from warder.llm import exact_dedup, near_dedup, packing, pieces, quality, sharding, suffix_dedup, tool_calls, warc, winnowing
from warder.llm.common import scratch

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


BASE = prose(1, 300)
PASSAGE = prose(2, 120)
TEXTS = [
    None, "", " ", "a", "é", "a b c", BASE, BASE, edited(BASE, 3, 5), BASE.replace(" ", "\n"), prose(4, 200) + PASSAGE + prose(5, 50), PASSAGE + prose(6, 80),
    "ab" * 700, prose(7, 20_000), "Ü" * 900 + prose(8, 10), prose(9, 4), prose(10, 30) + "▁ \x00 x", "same", "same",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, kept boolean, score double, rank long, part int, place int"


def table(spark, texts=TEXTS, repeat=True):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "src", None, 1, 1, True, 0.0, 1, 1, 1) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[6], (None, "no id", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs, 5).collect()
    want = sorted((str(i), len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in pairs(docs))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == [0, 1, 2, 3, 4] and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    curve = [(r["shard"], r["slot"], r["hilbert"]) for r in got]
    assert [h for _, _, h in sorted(curve)] == sorted(h for _, _, h in curve)
    assert sharding.shard_documents(none, 5).count() == 0


def test_write_shards(spark, docs, tmp_path):
    """Every row is written once, also without doc_id and repeated; runs of the curve prune."""
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    of = lambda d: collections.Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in d.collect())
    assert of(back) == of(docs) and set(back.columns) == set(docs.columns)
    many = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(hash(id) & 1023 as int)) AS text", "concat('s', lpad(hash(id, 1) & 63, 2, '0')) AS source", "concat('l', hash(id, 2) & 3) AS lang")
    many.write.parquet(str(tmp_path / "many"))
    sharding.write_shards(spark.read.parquet(str(tmp_path / "many")), str(tmp_path / "cut"), 64)
    ends = spark.read.parquet(str(tmp_path / "cut")).groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("lang").alias("c"), F.max("lang").alias("d"), F.min(F.length("text")).alias("e"), F.max(F.length("text")).alias("f")).collect()
    read = [sum(r["a"] <= "s20" <= r["b"] for r in ends), sum(r["c"] <= "l1" <= r["d"] for r in ends), sum(r["e"] <= 300 <= r["f"] for r in ends)]
    assert read[0] <= 32 and read[1] < 48 and read[2] <= 32, read  # of 64 each


def test_hilbert_curve_is_continuous(spark):
    n = 8
    cells = spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / n / n).cast("int").alias("z"))
    rows = cells.select("*", sharding.hilbert_index([F.col(c) for c in "xyz"], 3).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(n**3))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(rows, rows[1:], strict=False))


def check_pack(rows, texts, capacity):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), capacity):
            want[(i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids))] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    for capacity in (2048, 64):
        check_pack(packing.pack_documents(docs, path, capacity).collect(), pairs(docs), capacity)
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shortest_pack_first(seed):
    rng = random.Random(seed)
    h = {rng.randint(1, 64): rng.randint(1, 1000) for _ in range(rng.randint(0, 40))}
    got = packing.shortest_pack_first(h, 64)
    placed = collections.Counter()
    for pattern, count in got:
        assert sum(k * v for k, v in pattern.items()) <= 64 and count > 0
        for k, v in pattern.items():
            placed[k] += v * count
    assert placed == collections.Counter(h)
    packs: list[int] = []  # item by item
    for length in sorted(collections.Counter(h).elements(), reverse=True):
        fill = heapq.heappop(packs) if packs and packs[0] + length <= 64 else 0
        heapq.heappush(packs, fill + length)
    fills = sorted(sum(k * v for k, v in pattern.items()) for pattern, count in got for _ in range(count))
    assert fills == sorted(packs)


def test_word_tokens():
    coder = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    texts = ["DİYARBAKIRLİ.", "a7b 7 77", "Σας ΟΔΟΣ", "x́y", "<|endoftext|> a", "it's\tok\r\n'd", "", "İ", "w" * 200]
    texts += [" ".join(c + mark for c in letters[i : i + 500]) for mark in (",", ".", "b***") for i in range(0, len(letters), 500)]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == coder.library.encode(t, add_special_tokens=False).ids


def test_pieces(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = pieces.encoder(path).library
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.piece_encode(docs, "doc_id", "text", path).collect())
    want = collections.Counter((i, tuple(lib.encode(t, add_eos=True)), lib.decode(lib.encode(t, add_eos=True))) for i, t in pairs(docs))
    assert got == want
    assert pieces.piece_encode(none, "doc_id", "text", path).count() == 0


def test_pieces_random():
    enc = pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(32, 127), 0xE9, 0x4E2D, 0x1F600, 9, 10, 0x2581)] + ["  ", "the", "ing", " "]
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert enc.encode(t).tolist() == enc.library.encode(t), t


def test_winnowing(docs, none):
    found = {(r["doc_id"], r["n_chars"], bytes(r["fingerprint"])) for r in winnowing.fingerprint(docs, "doc_id", "text").collect()}
    assert found == {(i, len(t), winnowing.packed(winnowing.winnow(t)[0])) for i, t in pairs(docs)}
    assert winnowing.fingerprint(none, "doc_id", "text").count() == winnowing.fingerprint_edits(none).count() == 0


def test_winnowing_edits(spark):
    few = table(spark, repeat=False)
    rows = sorted(pairs(few), reverse=True)
    got = {r["doc_id"]: r for r in winnowing.fingerprint_edits(few).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        e = t[: len(t) - m] + after[:m]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["near_next"] == winnowing.likeness(winnowing.winnow(t)[0], winnowing.winnow(after)[0])
        assert bytes(got[i]["edited_fingerprint"]) == winnowing.packed(winnowing.winnow(e)[0])
        assert got[i]["positions"] == winnowing.winnow(t)[1].tolist()
    crowded = few.unionByName(few.withColumn("doc_id", F.lit(6).cast("long"))).unionByName(few.withColumn("doc_id", F.lit(None).cast("long")))
    hashes = {i: winnowing.packed(winnowing.winnow(t)[0]) for i, t in pairs(few)}
    got = collections.Counter((r["doc_id"], bytes(r["fingerprint"])) for r in winnowing.fingerprint_edits(crowded).collect())
    assert got == collections.Counter((d, h) for i, h in hashes.items() for d in (i, 6, None))
    assert winnowing.fingerprint_edits(table(spark)).count() == len(TEXTS) + 3
    assert winnowing.fingerprint_edits(few.filter("doc_id = 6")).first()["near_next"] == 1.0


def test_winnowing_rule():
    """Against windows looked at one by one: the rightmost of the least hashes of each."""
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        k, w = rng.randint(1, 6), rng.randint(1, 8)
        size = min(k, max(1, len(text)))
        grams = [text[i : i + size] for i in range(len(text) - size + 1)] if text else []
        value = {g: int(winnowing.winnow(g, size, 1)[0][0]) for g in set(grams)}
        hashes = [value[g] for g in grams]
        chosen = set()
        for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
            window = hashes[i : i + w]
            chosen.add(i + max(j for j, h in enumerate(window) if h == min(window)))
        got, at = winnowing.winnow(text, k, w)
        assert at.tolist() == sorted(chosen) and got.tolist() == [hashes[i] for i in sorted(chosen)]


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(200):
        shared = "".join(rng.choice("abcd ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
        a, b = ("".join(rng.choice("abcd ") for _ in range(50)) + shared + "".join(rng.choice("abcd ") for _ in range(50)) for _ in range(2))
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def classes_of(texts, linked):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if linked(texts[a], texts[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(texts))]


def test_near_dedup(spark, none):
    texts = [*TEXTS, edited(TEXTS[13], 1, 900)] + [edited(BASE, s, 4) for s in range(20, 30)] + [edited(prose(30, 150), s, 3) for s in range(40, 44)]
    docs = table(spark, texts, repeat=False)
    words = near_dedup.WordHashes()
    want = classes_of([words(t or "") for t in texts], lambda a, b: a.tobytes() == b.tobytes() or near_dedup.similarity(near_dedup.Text(a), b, 0.8) is not None)
    for groups in (500, 3):
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, group_rows=groups).collect()}
        assert got == dict(enumerate(want))
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(table(spark)).count() == len(TEXTS) + 3
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(500):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 20))]
        b = [x for x in a if rng.random() > 0.1] + [1] * rng.randint(0, 2)
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        most = rng.randint(0, 8)
        assert near_dedup.edit_distance(near_dedup.places(a), len(a), b, most) == (row[-1] if row[-1] <= most else None)
        longer, least = max(len(a), len(b)), rng.random()
        fits = not longer or row[-1] <= int((1 - least) * longer + 1e-9)
        found = near_dedup.similarity(near_dedup.Text(np.array(a, np.uint64)), np.array(b, np.uint64), least)
        assert found == ((1 - row[-1] / longer if longer else 1.0) if fits else None)


def test_stream_path():
    assert exact_dedup._any("/a/b.parquet/") == "/a/b.parque[t]"
    assert exact_dedup._any("/a/x[1]*") == "/a/x\\[1\\]\\*"


def kept_of(rows):
    """doc, keep and size of each row by the rule of the operator."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i is None, i))
    out = collections.Counter()
    for found in groups.values():
        first = min(found, key=lambda x: (x[0], x[1], x[2] or 0))
        for f in found:
            out[(f[2], first[2], len(found))] += 1
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, none, tmp_path, weak):
    digest = (lambda n: F.substring(F.sha2(n.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256
    docs.write.parquet(str(tmp_path / "docs"))
    for files in (1000, 1):
        got = exact_dedup.dedup_stream(spark, str(tmp_path / "docs"), digest, files).collect()
        assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == kept_of(pairs(docs))
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    none.write.parquet(str(tmp_path / "none"))
    assert exact_dedup.dedup_stream(spark, str(tmp_path / "none")).count() == 0
    left = exact_dedup.drop_duplicates(docs)  # no file scan: written first
    assert left.columns == docs.columns and left.count() == len({r["text_sha256"] for r in got})


def repeats(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = t.encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for i, t in rows:
        b = t.encode()
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.diff(gone.astype(int), prepend=0)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages(rows, length):
    """Bytes of the runs of words in windows that another document has too."""
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = t.encode().split()
        for k in range(len(w) - length + 1):
            seen[tuple(w[k : k + length])].add((i, t))
    out = collections.Counter()
    for i, t in rows:
        body = t.encode()
        words, gone = list(re.finditer(rb"\S+", body)), np.zeros(len(body), bool)
        again = np.zeros(len(words), bool)
        for k in range(len(words) - length + 1):
            if len(seen[tuple(m.group() for m in words[k : k + length])]) > 1:
                again[k : k + length] = True
        for k in np.flatnonzero(again).tolist():
            gone[words[k].start() : words[k + 1].start() if k + 1 < len(words) and again[k + 1] else words[k].end()] = True
        out[(i, len(body), int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(body, gone, strict=True) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("most", [2000, 2])
def test_suffix_dedup(spark, none, most):
    texts = TEXTS + [edited(BASE, s, 6) for s in range(50, 56)] + [prose(s, 30) + " " + PASSAGE + " " + prose(s + 100, 30) for s in range(60, 66)]
    texts += [prose(70, 30) + " " + " ".join([prose(71, 60)] * 3), prose(72, 5) + " " + prose(71, 60) + " x"]
    docs = table(spark, texts)
    rule = suffix_dedup.Rule
    for strings, words in ((suffix_dedup.STRINGS, suffix_dedup.PASSAGES), (rule("bytes", 120, 32, False), rule("words", 12, 3, True))):
        found = suffix_dedup.suffix_repeats(docs, [strings, words], most).collect()
        size = lambda f: sum(s["end"] - s["start"] for s in f["spans"])
        assert len(found) == docs.count()
        got = collections.Counter((r["doc_id"], r["n_bytes"], size(r["found"][0]), len(r["found"][0]["spans"]), r["found"][0]["kept_sha256"]) for r in found)
        assert got == repeats(pairs(docs), strings.length)
        got = collections.Counter((r["doc_id"], r["n_bytes"], size(r["found"][1]), r["found"][1]["kept_sha256"]) for r in found)
        assert got == passages(pairs(docs), words.length)
    assert suffix_dedup.suffix_repeats(none, [rule("bytes", 400, 64, False)]).count() == 0


def test_suffix_windows():
    """Windows around one anchor, against a comparison of every two of them."""
    rng = random.Random(2)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    rule = suffix_dedup.Rule("bytes", 20, 4, False)
    for _ in range(300):
        found, windows = [], collections.defaultdict(set)
        for k in range(rng.randint(2, 9)):
            a = rng.randint(3, 12) + 100
            lo = a - rng.randint(1, 12)
            hi = a - rng.randint(0, a - lo)
            data = bytearray(base[14 - (a - lo) :][: hi - lo + 20])
            data[rng.randrange(len(data))] ^= rng.randint(0, 1)
            found.append((bytes(data), a, lo, hi, k % 4))
            for p in range(lo, hi + 1):
                windows[a - p, bytes(data[p - lo : p - lo + 20])].add(k % 4)
        want = [{p for p in range(lo, hi + 1) if len(windows[a - p, data[p - lo : p - lo + 20]]) > 1} for data, a, lo, hi, _ in found]
        got = suffix_dedup.repeated_windows(found, rule, 0, 16)
        two = suffix_dedup.repeated_in_two(*found[:2], rule, 0, 16)
        spread = lambda r: [{p for x, y in q for p in range(x, y + 1)} for q in r]
        assert spread(two) == spread(suffix_dedup.repeated_windows(found[:2], rule, 0, 16))
        assert [{p for x, y in q for p in range(x, y + 1)} for q in got] == want


def test_suffix_stage_cuts_text(spark):
    """Passages of over 50 words of other documents go; repeats within a document stay."""
    passage, short = prose(80, 51), prose(81, 49)
    texts = [f"ü a {passage} b", f"{passage} ß", f"c {short} d", f"e {short}", f"{prose(82, 60)} {prose(82, 60)}"]
    left = suffix_dedup.drop_repeats(table(spark, texts, repeat=False))
    assert left.columns == SCHEMA.replace(",", "").split()[::2]
    want = ["ü a  b", " ß", *texts[2:]]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()} == {i: (t, len(t)) for i, t in enumerate(want)}


CALLS = "conv string, call_id string, place int, name string, arguments string, after array<string>, extra int"
RESULTS = "conv string, call_id string, place int, content string, order int"
TOOLS = [("find", "q", "string", True), ("find", "n", "integer", False), ("find", "w", "number", False)]


def linked(spark, calls, results):
    tools = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean")
    out = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), tools)
    return {(r["conv"], r["call_id"]): r for r in out.collect()}


def test_tool_calls(spark):
    calls = [
        ("c", "1", 0, "find", '{"q": "x", "n": 1, "w": 2}', None, 0),
        ("c", "2", 1, "find", '{"n": "1", "z": [1, {"b": 1, "a": 2}]}', ["1"], 0),
        ("c", "3", 2, "other", "{bad", ["9"], 0),
        ("c", "4", 3, "find", None, ["5"], 0),
        ("c", "5", 4, "find", '{"q": "x"}', None, 0),
        ("c", "5", 4, "find", '{"q": "x"}', None, 0),
        ("d", "1", 0, "find", '{"q": "x"}', ["2"], 0),
        ("d", "2", 1, "find", '{"q": "x"}', ["1"], 0),
        (None, "1", 0, "find", "{}", None, 0),
    ]
    results = [("c", "1", 1, "fine", 0), ("c", "2", 0, None, 0), ("c", "8", 1, "lone", 0), ("c", None, 1, "x", 0), ("c", "5", 5, "a", 0), ("c", "5", 6, "b", 0)]
    got = linked(spark, calls, results)
    assert {k: (r["status"], r["errors"]) for k, r in got.items()} == {
        ("c", "1"): ("linked", []),
        ("c", "2"): ("linked", ["early result", "missing q", "type n", "unknown z"]),
        ("c", "3"): ("pending", ["bad JSON", "lost dependency", "unknown tool"]),
        ("c", "4"): ("pending", ["missing q"]),
        ("c", "5"): ("linked", ["repeated call", "repeated result"]),
        ("c", "8"): ("orphan", []),
        ("d", "1"): ("pending", ["cyclic"]),
        ("d", "2"): ("pending", ["cyclic"]),
        (None, "1"): ("unnamed", ["unnamed"]),
        ("c", None): ("unnamed", ["unnamed"]),
    }
    assert [got["c", i]["order"] for i in "12354"] == [0, 1, 2, 3, 4]  # 4 waits for 5
    assert got["c", "2"]["canonical"].startswith('{"arguments":{"n":"1","z":[1,{"a":2,"b":1}]},"call_id":"2"')
    assert linked(spark, [], []) == {}


def test_quality(spark, none):
    rng = random.Random(1)
    good = [prose(s, rng.randint(20, 300)) + ".\n" + prose(s + 1, 30) + "." for s in range(100, 220)]
    bad = [" ".join([rng.choice(WORDS)] * rng.randint(20, 200)) + "!!! $$$" for _ in range(60)]
    texts = good + bad + [None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(3, None, 0), (None, 1, 0), (999, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 180]
    assert len(held) > 30 and sum((r["doc_id"] < 120) == (r["predicted"] == 1) for r in held) / len(held) > 0.95
    one_kind = quality.classify(docs, labels.filter("quality = 1")).select("predicted").distinct().collect()
    assert [r[0] for r in one_kind] == [1]
    assert quality.classify(none, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 100 < kept.count() < docs.count()


def test_quality_gradient():
    """Against differences of the loss."""
    rng = np.random.default_rng(3)
    w, better, worse = rng.normal(size=30), rng.integers(0, 30, (50, 4)), rng.integers(0, 30, (50, 4))
    loss = lambda v: np.log1p(np.exp(-(v[better].sum(1) - v[worse].sum(1)))).mean()
    got = quality.pair_gradient(w, better, worse)
    for i in range(30):
        step = np.zeros(30)
        step[i] = 1e-6
        assert abs((loss(w + step) - loss(w - step)) / 2e-6 - got[i]) < 1e-6


def test_quality_threshold():
    """As many fitted documents are kept as have label 1, those with the greatest strengths."""
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, len(quality.FEATURES))) + 0.5 * y[:, None]
    ranking = quality.fit_ranking(x, y)
    strength, score = ranking.strength(x), ranking.score(x)
    assert (score >= 0.5).sum() == y.sum()
    assert strength[score >= 0.5].min() >= strength[score < 0.5].max()
    assert strength[y == 1].mean() > strength[y == 0].mean()


PAGES = [(1, "http://a/", "x" * 100), (2, "http://b/\r\n", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "ü", "é" * 50), (8, "u", "\r\n\r\n" + prose(1, 5000)), (9, "u", "\r\n\r\n" + prose(1, 5000))]


def test_warc(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload_digest", F.lit(1)).withColumn("record_type", F.lit("z")).repartition(2)
    for most in (warc.ARCHIVE_BYTES, 1):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", most)
        records = warc.read_warc(warc.write_warc(warc.plan_records(pages), scratch(spark, "w"))).collect()
        got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["verified"]) for r in records}
        first = {}
        for i, _, h in PAGES:
            b = (h or "").encode()
            again = len(b) >= 100 and b in first
            assert got[i] == ("revisit" if again else "response", first[b] if again else None, len(b), hashlib.sha256(b).hexdigest(), True)
            first.setdefault(b, i)
        assert {r["page_id"]: bytes(r["payload"]) for r in records if r["record_type"] == "response"} == {i: (h or "").encode() for i, _, h in PAGES if i not in (2, 9)}
    assert warc.warc_round_trip(pages.limit(0), scratch(spark, "w")).count() == 0


def test_warc_faults():

    record = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "response")
    pack = lambda b: zlib.compressobj(6, zlib.DEFLATED, 31)

    def member(b):
        z = pack(b)
        return z.compress(b) + z.flush()

    assert [x[3] for x in warc.read_archive(io.BytesIO(member(record) * 2))] == [True, True]
    assert [x[3] for x in warc.read_archive(io.BytesIO(member(record.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))))] == [False]
    other = lambda kind, more=b"", block=b"software: x": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(b"software: x").digest())
    archive = [other(b"warcinfo"), other(b"metadata", b"WARC-Block-Digest: sha1:" + sha1 + b"\r\n"), other(b"metadata", b"WARC-Block-Digest: sha1:AAAA\r\n")]
    archive += [other(b"request", b"Content-Type: application/http; msgtype=request\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"").digest()) + b"\r\n", b"GET / HTTP/1.1\r\n\r\n")]
    got = list(warc.read_archive(io.BytesIO(b"".join(map(member, archive)))))
    assert [(p, h["warc-type"], b, f) for p, h, b, f in got] == [(0, "warcinfo", b"software: x", None), (1, "metadata", b"software: x", True), (2, "metadata", b"software: x", False), (3, "request", b"", True)]
    for broken in (member(record)[:-3], member(b"nothing"), member(record + b"x"), member(record.replace(b"Content-Length", b"Content-Size")), member(record.replace(b"WARC-Type", b"WARC-Kind"))):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(broken)))


def test_warc_foreign_archive(spark, tmp_path):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.warc.gz").write_bytes(z.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 0\r\n\r\n\r\n\r\n") + z.flush())
    rows = warc.read_warc(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "archive string")).collect()
    assert [(r["record_type"], r["page_id"], r["payload_digest"], r["verified"], bytes(r["payload"])) for r in rows] == [("warcinfo", None, None, None, b"")]


def test_warc_record_ids(spark, tmp_path):
    """Rows with equal or no page_ids are records of their own; a revisit names its response."""
    body = "x" * 200
    pages = spark.createDataFrame([(1, "a", body), (1, "a", body), (None, "b", body), (None, "b", "short"), (2, "c", body)], "page_id long, url string, html string")
    records = warc.read_warc(warc.write_warc(warc.plan_records(pages), str(tmp_path))).collect()
    assert len({r["record_id"] for r in records}) == 5
    assert sorted((r["url"], r["record_type"], r["refers_to"]) for r in records) == [("a", "response", None), ("a", "response", None), ("b", "response", None), ("b", "revisit", 1), ("c", "revisit", 1)]
    heads = [h for p in tmp_path.glob("*.gz") for _, h, _, _ in warc.read_archive(io.BytesIO(p.read_bytes())) if h["warc-type"] == "revisit"]
    assert [h["warc-refers-to-target-uri"] for h in heads] == ["a", "a"]


def test_warc_bounded_framing():
    """A member that grows beyond its stated length is given up after a chunk."""
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = z.compress(warc.record_bytes(1, "u", b"", hashlib.sha256(b"").hexdigest(), None, "response")) + z.compress(b"0" * (200 << 20)) + z.flush()
    member = warc.Member(io.BytesIO(bomb), b"")
    with pytest.raises(warc.WarcError):
        member.record()
    assert len(member.data) <= 2 * warc.CHUNK
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    endless = warc.Member(io.BytesIO(z.compress(b"WARC/1.1\r\n" + b"a: b\r\n" * (20 << 20)) + z.flush()), b"")
    with pytest.raises(warc.WarcError):
        endless.record()
    assert len(endless.data) <= warc.HEAD_BYTES + 2 * warc.CHUNK


def test_warc_null_ids(spark):
    body = "x" * 200
    pages = spark.createDataFrame([(1, "a", body), (None, "b", body), (2, "c", body), (None, "d", body + "!"), (None, "e", body + "!")], "page_id long, url string, html string")
    got = {r["url"]: (r["record_type"], r["refers_to"]) for r in warc.plan_records(pages).collect()}
    assert got == {"a": ("response", None), "b": ("revisit", 1), "c": ("revisit", 1), "d": ("response", None), "e": ("response", None)}


def test_near_dedup_recall(spark):
    """Pairs that only scattered edits set apart are found, at each length and rate, up to the
    least similarity; a text of four words is met by the same with a fifth."""
    lengths, rates, texts = (4, 5, 8, 12, 30, 64, 65, 80, 100, 150, 400), (0.05, 0.10, 0.15, 0.20), []
    for length in lengths:
        for rate in rates:
            for s in range(40):
                rng, words = random.Random(f"{length} {s} {rate}"), [f"v{random.Random(f'{length} {s} {rate} {i}').randrange(5000)}" for i in range(length)]
                texts.append(" ".join(words))
                for n, i in enumerate(rng.sample(range(length), int(rate * length + 1e-9))):
                    words[i] = f"edit{s}_{rate}_{n}"
                if length == 4:
                    words.insert(rng.randint(0, 4), f"edit{s}_{rate}")
                texts.append(" ".join(words))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table(spark, texts, repeat=False)).collect()}
    found = [got[i] == got[i + 1] == i for i in range(0, len(texts), 2)]
    shares = {(length, rate): sum(found[40 * k : 40 * k + 40]) / 40 for k, (length, rate) in enumerate((n, r) for n in lengths for r in rates)}
    print(shares)
    assert all(v >= 0.95 for v in shares.values()), shares
    assert len(set(got.values())) >= len(texts) // 2


def test_near_dedup_links_within_families(spark):
    """Copies that are all a fifth away from one text, and hence further from each other, meet it."""
    rng, texts = random.Random(9), []
    for length in (40, 90, 300):
        for s in range(6):
            base = [f"b{length}_{s}_{rng.randrange(5000)}" for _ in range(length)]
            texts.append(" ".join(base))
            for c in range(5):
                words = list(base)
                for n, i in enumerate(rng.sample(range(length), length // 5)):
                    words[i] = f"edit{length}_{s}_{c}_{n}"
                texts.append(" ".join(words))
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(table(spark, texts, repeat=False)).collect()}
    met = [rows[i]["class_id"] == i - i % 6 for i in range(len(texts)) if i % 6]
    assert sum(met) >= 0.97 * len(met)


def test_near_dedup_counts_every_link(spark):
    # all texts of a family are like each other, also those that follow one leader, over several parts of a bucket
    rng, texts = random.Random(5), []
    for k in range(40):
        words = [f"g{i}" for i in range(120)]
        for i in rng.sample(range(120), 3):
            words[i] = f"x{k}_{i}"
        texts.append(" ".join(words))
    rows = near_dedup.near_duplicates(table(spark, texts, repeat=False), group_rows=12).collect()
    assert {r["links"] for r in rows} == {39} and len({r["class_id"] for r in rows}) == 1


@pytest.mark.parametrize("group_rows", [500, 20])
def test_near_dedup_classes_without_all_links(spark, monkeypatch, group_rows):
    # classes are those of all links, also of copies that are alike only by way of others; the alignments
    # of a family grow with its texts, not with their pairs
    rng, texts = random.Random(11), []
    for length, copies, edits in ((120, 100, 4), (200, 12, 36), (30, 12, 5)):
        base = [f"c{length}_{rng.randrange(5000)}" for _ in range(length)]
        for k in range(copies):
            words = list(base)
            for i in rng.sample(range(length), edits):
                words[i] = f"y{length}_{k}_{i}"
            texts.append(" ".join(words))
    docs, aligned, verified = table(spark, texts, repeat=False), [], near_dedup.verified

    def counted(rows, pairs, least):
        aligned.append(pairs.select("node", "leader").collect())
        return verified(rows, pairs, least)

    monkeypatch.setattr(near_dedup, "verified", counted)
    classes = lambda **how: {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, group_rows=group_rows, **how).collect()}
    want, every = classes(), sum(map(len, aligned))
    aligned.clear()
    assert classes(count_links=False) == want
    pairs = [tuple(p) for step in aligned for p in step]
    assert len(set(pairs)) == len(pairs) and every > 4500 and len(pairs) < 10 * len(texts)


def test_near_dedup_repeated_words_are_not_aligned_each_with_each(spark, monkeypatch):
    # two words, again and again, make up three quarters of all texts, so that these share most of their
    # sketches; few are alike, some only by way of others in another class
    rng, texts = random.Random(5), []
    for k in range(80):
        own = [f"w{rng.randrange(4000)}" for _ in range(90)] if k % 8 else ["w1"] * 90
        texts.append(" ".join([*own, *["is", "onhe."] * (130 + rng.randrange(6))]))
    for k in (3, 11):
        words = texts[k].split()
        words[5:70:3] = [f"n{k}_{i}" for i in range(22)]
        texts.append(" ".join(words))
    docs, aligned, verified = table(spark, texts, repeat=False), [], near_dedup.verified

    def counted(rows, pairs, least):
        aligned.append(pairs.count())
        return verified(rows, pairs, least)

    monkeypatch.setattr(near_dedup, "verified", counted)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, count_links=False, group_rows=30).collect()}
    assert sum(aligned[1:]) < len(texts)  # after the pairs with leaders
    want = list(range(len(texts)))
    for i in range(len(texts)):
        lead = near_dedup.Text(near_dedup.WordHashes()(texts[i]))
        for j in range(i):
            if want[i] != want[j] and near_dedup.similarity(lead, near_dedup.WordHashes()(texts[j]), 0.8) is not None:
                want = [min(want[i], want[j]) if c in (want[i], want[j]) else c for c in want]
    ids = sorted(found)
    assert [found[x] for x in ids] == [ids[c] for c in want] and 20 < len(set(want)) < len(texts) - 5


def test_passages_again_and_again_are_one_range_of_starts():
    # the runs of a text that repeats two words follow on each other
    starts = [(0, k, k + 8) for k in range(0, 900, 9)] + [(1, 4, 6), (1, 8, 9), (0, 905, 910)]
    assert suffix_dedup.joined_starts(random.Random(1).sample(starts, len(starts))) == [(0, 0, 899), (0, 905, 910), (1, 4, 6), (1, 8, 9)]


def test_word_hashes_depend_on_the_word_alone():
    from warder.llm import rolling

    long = "x" * (rolling.WORD_BYTES + 5)
    words = ["a", "b", "ab", "ba", "é", long, "a", *(f"w{i}" for i in range(30_000)), long, "ab", long + "x"]
    got = rolling.word_hashes(" ".join(words).encode()).tolist()
    alone = {w: rolling.word_hashes(w.encode()).tolist() for w in words}
    assert [[h] for h in got] == [alone[w] for w in words]
    assert len({h for (h,) in alone.values()}) == len(set(words))
    assert rolling.word_hashes(b"").tolist() == []


def test_near_dedup_gives_one_of_the_buckets_with_the_same_texts(spark):
    """Near copies share most of their keys; each of these was dealt out and compared before."""
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in rng.integers(0, 5_000, 300)]
    texts = [" ".join(base), " ".join([*base[:150], "other", *base[151:]]), " ".join(f"u{i}" for i in rng.integers(0, 5_000, 300))]
    reps = near_dedup.sketches(spark.createDataFrame(list(enumerate(texts)), "kid long, text string")).withColumnRenamed("kid", "node")
    keys = near_dedup.shared_keys(reps).collect()
    assert sorted((r["node"], r["comp"], r["short"], r["n"]) for r in keys) == [(0, 0, False, 2), (1, 1, False, 2)]


def test_suffix_repeats_joins_the_notes_of_a_text():
    rng = np.random.default_rng(5)
    kind = pa.list_(pa.struct([("rule", pa.int32()), ("whole", pa.bool_()), ("settled", pa.bool_()), ("anchor", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))
    note = lambda r, lo, n: {"rule": int(r), "whole": bool(n % 3), "settled": False, "anchor": int(lo), "lo": int(lo), "hi": int(lo + n)}
    texts = [[note(*x) for x in zip(rng.integers(0, 2, k), rng.integers(0, 300, k), rng.integers(0, 9, k), strict=True)] for k in (1, 5, 40, 80)]
    for notes, given in zip([None, [], *texts], pa.array([None, [], *texts], kind), strict=True):
        want = suffix_dedup.joined_starts([(x["rule"], x["lo"], x["hi"]) for x in notes or () if x["whole"]])
        assert suffix_dedup.told_notes(given) == (want, [x for x in notes or () if not x["whole"]])
