"""Repeated passages: a distributed, sparse suffix sort over bytes or words.

A window of ``length`` units is found by its anchor, the core of ``core`` units in it with the
least hash. Equal windows have equal anchors at equal places, so only the suffixes at anchors
are sorted, each with the run of window starts that its anchor stands for. The windows of a
run differ in how many units lie before the anchor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.llm.common import distilled, documents, join_counted, staged
from warder.llm.rolling import gram_hashes, window_minima, word_hashes


@dataclass(frozen=True)
class Rule:
    """What repeats: windows of ``length`` bytes or words that start elsewhere too, in another
    document if ``across``. Words are the runs between ASCII blanks."""

    unit: str
    length: int
    core: int
    across: bool

    @property
    def width(self) -> int:
        """Bytes of a unit in a context."""
        return 1 if self.unit == "bytes" else 8


STRINGS = Rule("bytes", 400, 64, across=False)
#: Every passage of over 50 words has a window of 50.
PASSAGES = Rule("words", 50, 8, across=True)
#: Contexts with one key that a task compares; with more, their keys are made longer.
MOST_CONTEXTS = 2_000
#: Cells (contexts by window offsets) that are compared at a time.
CELLS = 1 << 18
#: Window starts of one document handled at a time.
SEGMENT = 1 << 22

ANCHORS = "rule int, kid long, kh long, core long, ctx long, anchor int, lo int, hi int"


def codes_of(body: bytes, rule: Rule) -> np.ndarray:
    return np.frombuffer(body, np.uint8) if rule.unit == "bytes" else word_hashes(b" ".join(body.split()))


def runs(codes: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(core hash, anchor, first and last window start) arrays of a text, segment by segment."""
    length, core = rule.length, rule.core
    for start in range(0, len(codes) - length + 1, SEGMENT):
        hashes = gram_hashes(codes[start : start + SEGMENT + length - 1], core)
        at = window_minima(hashes, length - core + 1)
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        hi = np.append(lo[1:], len(at)) - 1
        yield hashes[at[lo]], at[lo] + start, lo + start, hi + start


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Documents by identifier and hash of the text; rows alike in both have one result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    return docs.select(rest.alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kid"), F.xxhash64(text).alias("kh"))


def find_anchors(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The anchors of all rules with their runs and a hash of the context, the units that the
    windows of the run cover."""

    def run(batches):
        for batch in batches:
            found: list[list[np.ndarray]] = []
            for kid, kh, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for r, rule in enumerate(rules):
                    codes = codes_of(body, rule)
                    if len(codes) < rule.length:
                        continue
                    view, w = memoryview(codes).cast("B"), rule.width
                    for cores, anchor, lo, hi in runs(codes, rule):
                        n, ends = len(lo), (hi + rule.length) * w
                        ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((lo * w).tolist(), ends.tolist(), strict=True)), np.uint64, n)
                        found.append([np.full(n, r, np.int32), np.full(n, kid, np.int64), np.full(n, kh, np.int64), cores.view(np.int64), ctx.view(np.int64), anchor.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=[f.split(" ")[0] for f in ANCHORS.split(", ")])

    return rows.select("kid", "kh", "text").mapInArrow(run, ANCHORS)


def multikey_order(texts: list[bytes], step: int = 8) -> list[int]:
    """Multikey quicksort: three-way partitions by ``step`` bytes at a time."""
    order: list[int] = []
    stack = [(list(range(len(texts))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) <= 1:
            order += ids
            continue
        words = [texts[i][depth : depth + step] for i in ids]
        pivot = words[len(words) // 2]
        less = [i for i, w in zip(ids, words, strict=True) if w < pivot]
        same = [i for i, w in zip(ids, words, strict=True) if w == pivot]
        more = [i for i, w in zip(ids, words, strict=True) if w > pivot]
        stack.append((more, depth))
        if len(pivot) == step:
            stack += [(same, depth + step), (less, depth)]
        else:  # all of these end here
            stack += [([i], depth) for i in reversed(same)]
            stack.append((less, depth))
    return order


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def neighbours(texts: list[bytes], width: int) -> tuple[list[int], np.ndarray]:
    """The sorted order of texts, and how many first units neighbours in it share."""
    order = multikey_order(texts)
    return order, np.array([common_prefix(texts[a], texts[b]) // width for a, b in zip(order, order[1:], strict=False)], np.int64)


def classes(order: list[int], shared: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For each depth, the classes of texts that are equal in so many first units: one ends
    where neighbours share fewer."""
    out = np.zeros((len(depths), len(order)), np.int64)
    out[:, order[1:]] = np.cumsum(shared[None, :] < depths[:, None], axis=1)
    return out


def repeated_windows(contexts: list[tuple[bytes, int, int, int, int]], rule: Rule, least: int, most: int) -> list[list[tuple[int, int]]]:
    """For contexts (bytes from lo on, anchor, lo, hi, document) that share a core, the ranges of
    window starts whose window also occurs in a context of another document; of the windows
    with ``least`` to ``most`` units before the anchor. Windows are equal when the suffixes at
    the anchors and the reversed units before them are, each as far as the window goes."""
    n, w = len(contexts), rule.width
    low = np.array([a - hi for _, a, _, hi, _ in contexts])
    high = np.array([a - lo for _, a, lo, _, _ in contexts])
    name: dict[int, int] = {}
    doc = np.array([name.setdefault(c[4], len(name)) for c in contexts])
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if len(name) == 1:
        return out
    left = neighbours([c[: (a - lo) * w][::-1] for c, a, lo, _, _ in contexts], w)
    right = neighbours([c[(a - lo) * w :] for c, a, lo, _, _ in contexts], w)
    first, end = max(least, int(low.min())), min(most, int(high.max())) + 1
    # between these offsets neither the classes nor the contexts that have a window change
    turns = np.unique(np.concatenate([[first], low, high + 1, rule.length - right[1], left[1] + 1]))
    turns = turns[(turns >= first) & (turns < end)]
    until = np.append(turns[1:], end) - 1
    step = max(1, CELLS // n)
    for at in range(0, len(turns), step):
        part, upto = turns[at : at + step], until[at : at + step]
        inside = (low[None, :] <= part[:, None]) & (part[:, None] <= high[None, :])
        key = classes(*right, rule.length - part) * n + classes(*left, part)
        key = np.where(inside, key, n * n + np.arange(n)[None, :]) * n + doc[None, :]
        order = np.argsort(key, axis=1)
        key = np.take_along_axis(key, order, axis=1)
        place = np.broadcast_to(np.arange(n), key.shape)
        starts = np.ones(key.shape, bool)
        starts[:, 1:] = key[:, 1:] // n != key[:, :-1] // n
        ends = np.ones(key.shape, bool)
        ends[:, :-1] = starts[:, 1:]
        head = np.maximum.accumulate(np.where(starts, place, 0), axis=1)
        tail = np.minimum.accumulate(np.where(ends, place, n - 1)[:, ::-1], axis=1)[:, ::-1]
        again = np.take_along_axis(key, head, axis=1) != np.take_along_axis(key, tail, axis=1)
        found = np.zeros(key.shape, np.int8)
        np.put_along_axis(found, order, again.astype(np.int8), axis=1)
        for i in np.flatnonzero(found.any(axis=0)).tolist():
            edge = np.flatnonzero(np.diff(found[:, i], prepend=0, append=0))
            anchor = contexts[i][1]
            out[i] += [(anchor - int(upto[e - 1]), anchor - int(part[s])) for s, e in zip(edge[::2], edge[1::2], strict=True)]
    return out


def repeated_in_two(one: tuple, two: tuple, rule: Rule, least: int, most: int) -> list[list[tuple[int, int]]]:
    """The same for two contexts."""
    (c, a, lo, hi, doc), (c2, a2, lo2, hi2, doc2) = one, two
    w = rule.width
    if doc == doc2:
        return [[], []]
    right = common_prefix(c[(a - lo) * w :], c2[(a2 - lo2) * w :]) // w
    low = max(least, rule.length - right, a - hi, a2 - hi2)
    high = min(most, a - lo, a2 - lo2)
    if low > high:
        return [[], []]
    high = min(high, common_prefix(c[: (a - lo) * w][::-1], c2[: (a2 - lo2) * w][::-1]) // w)
    return [[(a - high, a - low)], [(a2 - high, a2 - low)]] if low <= high else [[], []]


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of units covered by windows that start in the given ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def joined_starts(starts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ranges (rule, first, last window start), those that follow on each other as one."""
    out: list[tuple[int, int, int]] = []
    for rule, lo, hi in sorted(starts):
        if out and out[-1][0] == rule and lo <= out[-1][2] + 1:
            out[-1] = (rule, out[-1][1], max(out[-1][2], hi))
        else:
            out.append((rule, lo, hi))
    return out


FOUND = "array<struct<spans:array<struct<start:bigint,end:bigint>>,kept:string,kept_sha256:string>>"
FOUND_ARROW = pa.list_(pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()), ("kept_sha256", pa.string())]))
STARTS = pa.list_(pa.struct([("rule", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))


def cut(body: bytes, starts: list[tuple[int, int, int]], rules: list[Rule], with_text: bool) -> list[dict]:
    """What each rule finds in a text: the byte runs of its windows, and the text without them."""
    out = []
    for r, rule in enumerate(rules):
        spans = merged([(lo, hi) for x, lo, hi in starts if x == r], rule.length)
        if spans and rule.unit == "words":
            words = [m.span() for m in re.finditer(rb"\S+", body)]
            spans = [(words[a][0], words[b - 1][1]) for a, b in spans]
        at, parts = 0, []
        for a, b in spans:
            parts.append(body[at:a])
            at = b
        kept = b"".join([*parts, body[at:]])
        out.append({"spans": [{"start": a, "end": b} for a, b in spans], "kept": kept.decode("utf-8", "ignore") if with_text else None, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def differ(a: str, b: str):
    """Whether grouped rows are of several documents."""
    return (F.min(a) != F.max(a)) | (F.min(b) != F.max(b))


def suffix_repeats(docs: DataFrame, rules: list[Rule], most_contexts: int = MOST_CONTEXTS, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Find the windows of each rule that also start elsewhere, and cut them.

    Texts are UTF-8 bytes, null is empty; windows stay within documents, may overlap, and are
    judged on the input. Returns one row per document: doc_id, n_bytes, found (for each rule:
    spans, the maximal byte runs covered; kept, the rest as text, on request, where a character
    cut apart is dropped; kept_sha256 of the rest's bytes), kid and kh (the document's key) and
    rest (a struct of the columns ``carry``). Texts shorter than a window stay whole. Repeated
    rows count as copies of each other; rows alike in doc_id and text are one document to rules
    that look across documents. An empty table gives no rows, other columns are not read.

    1. Anchors with their runs, and a hash of the context. Core and context hash together, 128
       bits, say which contexts are equal.
    2. A context that comes twice (for rules across documents: in two of them) makes its whole
       run repeated. Where a core has several different contexts, all the others and one row of
       each such context go on.
    3. Those contexts are cut from the texts and range-partitioned by the leading units of the
       suffix at the anchor, by sampled splitters, so that equal ones meet in one range. Each
       range sorts the suffixes (and the reversed units before the anchors) by multikey
       quicksort and compares neighbours, byte for byte.
    4. Where more than ``most_contexts`` contexts have the same leading units, their windows are
       parted in two by the units before the anchor, and both parts are partitioned by all the
       units that each window of the part has: these are longer, and so on until few are equal
       or all of the window is in the key.
    """
    spark, carry = docs.sparkSession, carry or []
    rows = keyed(docs, carry)
    across = F.element_at(F.array(*[F.lit(r.across) for r in rules]), F.col("rule") + 1)

    def rows_of_cores() -> DataFrame:
        anchors = staged(find_anchors(rows, rules), "anchors")
        cores = anchors.groupBy("rule", "core").agg(F.count(F.lit(1)).alias("n"), differ("kid", "kh").alias("docs"))
        cores = staged(cores.filter((F.col("n") > 1) & (~across | F.col("docs"))).drop("docs"), "cores")
        return join_counted(anchors, cores, ["rule", "core"], "n", ["kid", "lo"], "c").filter("c is not null").drop("c")

    def first_rows() -> DataFrame:
        twice = distilled(spark, "core_rows", rows_of_cores)
        one = F.min(F.struct("kid", "kh", "anchor", "lo", "hi")).alias("one")
        contexts = twice.groupBy("rule", "core", "ctx").agg(F.count(F.lit(1)).alias("copies"), differ("kid", "kh").alias("docs"), one)
        contexts = staged(contexts.withColumn("settled", (F.col("copies") > 1) & (~across | F.col("docs"))).drop("docs"), "contexts")
        many = staged(contexts.groupBy("rule", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "many")
        copied = staged(contexts.filter("copies > 1").select("rule", "core", "ctx", "copies", "settled"), "copied")

        note = lambda whole, settled, at="": F.struct("rule", whole.alias("whole"), settled.alias("settled"), f"{at}anchor", f"{at}lo", f"{at}hi").alias("x")
        again = join_counted(twice, copied, ["rule", "core", "ctx"], "copies", ["kid", "lo"], "c").filter("c is not null")
        again = again.select("kid", "kh", note(F.col("c.settled"), F.lit(False)))
        single = join_counted(contexts.filter("copies = 1 or settled"), many, ["rule", "core"], "n", ["ctx"], "c").filter("c is not null")
        single = single.select("one.kid", "one.kh", note(F.lit(False), F.col("settled"), "one."))
        notes = again.unionByName(single).groupBy("kid", "kh").agg(F.collect_list("x").alias("notes"))
        return first_pass(rows.join(notes, ["kid", "kh"], "left"), rules, with_text, rows.schema["rest"].dataType.simpleString())

    first = distilled(spark, "first_pass", first_rows)
    waiting = first.filter("text is not null")

    def windows() -> DataFrame:
        found = compared(cut_contexts(waiting, rules), rules, most_contexts)
        return found.groupBy("kid", "kh").agg(F.collect_list(F.struct("rule", "lo", "hi")).alias("more"))

    found = distilled(spark, "windows", windows)
    last = last_pass(waiting.join(found, ["kid", "kh"], "left"), rules, with_text)
    return first.filter("text is null").select(*last.columns).unionByName(last)


NOTE = "struct<rule:int,whole:boolean,settled:boolean,anchor:int,lo:int,hi:int>"


def told_notes(notes: pa.ListScalar) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """The joined ranges of windows that are repeated as a whole, and the notes that wait. A text
    may have very many notes, so that only those that wait become Python objects."""
    if not notes.is_valid or not len(notes.values):
        return [], []
    values = notes.values
    whole = values.field("whole").to_numpy(zero_copy_only=False).astype(bool)
    rule, lo, hi = (values.field(c).to_numpy()[whole].astype(np.int64) for c in ("rule", "lo", "hi"))
    order = np.lexsort((hi, lo, rule))
    rule, lo, hi = rule[order], lo[order], hi[order]
    most = np.zeros(0, np.int64)
    for r in np.unique(rule):
        most = np.append(most, np.maximum.accumulate(hi[rule == r]))
    first = np.flatnonzero((rule[1:] != rule[:-1]) | (lo[1:] > most[:-1] + 1)) + 1 if len(rule) else np.zeros(0, np.int64)
    first = np.append(0, first) if len(rule) else first
    last = np.append(first[1:], len(rule)) - 1 if len(rule) else first
    joined = list(zip(rule[first].tolist(), lo[first].tolist(), most[last].tolist(), strict=True))
    return joined, values.filter(pa.array(~whole)).to_pylist()


def first_pass(joined: DataFrame, rules: list[Rule], with_text: bool, rest: str) -> DataFrame:
    """Finish the documents that wait for no comparison; keep the text of the others."""

    def run(batches):
        for batch in batches:
            found, texts, starts, waits, sizes = [], [], [], [], []
            for body, notes in zip(batch.column("text").cast(pa.binary()), batch.column("notes"), strict=True):
                body, whole, open_ = body.as_py(), *told_notes(notes)
                sizes.append(len(body))
                found.append(None if open_ else cut(body, whole, rules, with_text))
                texts.append(body if open_ else None)
                starts.append([{"rule": r, "lo": a, "hi": b} for r, a, b in whole] if open_ else None)
                waits.append(open_ or None)
            columns = [pa.array(sizes, pa.int64()), pa.array(found, FOUND_ARROW), pa.array(texts, pa.binary()), pa.array(starts, STARTS), pa.array(waits, batch.column("notes").type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "kid", "kh", "rest")), *columns], names=["doc_id", "kid", "kh", "rest", "n_bytes", "found", "text", "starts", "waits"])

    return joined.mapInArrow(run, f"doc_id long, kid long, kh long, rest {rest}, n_bytes long, found {FOUND}, text binary, starts array<struct<rule:int,lo:int,hi:int>>, waits array<{NOTE}>")


PIECES = "rule int, kid long, kh long, settled boolean, anchor int, lo int, hi int, units binary"


def cut_contexts(waiting: DataFrame, rules: list[Rule]) -> DataFrame:
    """The contexts that wait for comparison, each with its units."""

    def run(batches):
        for batch in batches:
            out = []
            for kid, kh, body, waits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                views = {r: memoryview(codes_of(body, rules[r])).cast("B") for r in {x["rule"] for x in waits}}
                for x in waits:
                    rule = rules[x["rule"]]
                    out.append((x["rule"], kid, kh, x["settled"], x["anchor"], x["lo"], x["hi"], bytes(views[x["rule"]][x["lo"] * rule.width : (x["hi"] + rule.length) * rule.width])))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[f.split(" ")[0] for f in PIECES.split(", ")])

    return waiting.select("kid", "kh", "text", "waits").mapInArrow(run, PIECES)


def compared(pieces: DataFrame, rules: list[Rule], most: int) -> DataFrame:
    """(rule, kid, kh, lo, hi): ranges of window starts that are repeated, of contexts that are
    not settled. ``least`` to ``most`` units lie before the anchor in the windows of a row."""

    def of(value):
        return F.element_at(F.array(*[F.lit(value(r)) for r in rules]), F.col("rule") + 1)

    # the units that all windows of a row have
    key = F.expr("substring(units, (anchor - lo - least) * width + 1, (least + length - most) * width)").alias("key")
    keys = ["rule", "least", "key"]
    sized = pieces.withColumns({"width": of(lambda r: r.width), "length": of(lambda r: r.length), "least": F.lit(0), "most": of(lambda r: r.length - r.core)})
    todo, out = sized.select("*", key), []
    while True:
        todo = staged(todo, "contexts_to_compare")
        sizes = staged(todo.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (differ("kid", "kh") | F.max("settled")).alias("docs")).filter(F.col("n") > most), "hot_keys")
        if sizes.isEmpty():
            return union([*out, sorted_windows(todo, rules)])
        todo = staged(join_counted(todo, sizes, keys, "n", ["kid", "lo"], "c"), "dealt_contexts")
        out.append(sorted_windows(todo.filter("c is null").drop("c"), rules))
        # a key of one window's units: all of these windows are equal
        across = of(lambda r: r.across)
        equal = todo.filter("c is not null and least = most and not settled").filter(~across | F.col("c.docs"))
        start = (F.col("anchor") - F.col("least")).alias("lo")
        out.append(equal.select("rule", "kid", "kh", start, start.alias("hi")))
        middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
        halves = F.array(F.struct(F.col("least").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("most").alias("b")))
        split = todo.filter("c is not null and least < most").drop("c", "key").select("*", F.explode(halves).alias("half"))
        split = split.filter("half.a <= anchor - lo and half.b >= anchor - hi")
        split = split.withColumns({"least": F.col("half.a"), "most": F.col("half.b")}).drop("half")
        todo = split.select("*", key)


def union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def sorted_windows(pieces: DataFrame, rules: list[Rule]) -> DataFrame:
    dealt = pieces.repartitionByRange("rule", "key").sortWithinPartitions("rule", "key", "least")

    def flush(key, group, out):
        if len(group) < 2:
            return
        rule, _, least, most = key
        # a settled context stands for several documents, so it is like no other's
        contexts = [(units, anchor, lo, hi, ("settled", i) if settled else (kid, kh) if rules[rule].across else i) for i, (kid, kh, settled, anchor, lo, hi, units) in enumerate(group)]
        ranges = repeated_in_two(*contexts, rules[rule], least, most) if len(group) == 2 else repeated_windows(contexts, rules[rule], least, most)
        for (kid, kh, settled, *_), found in zip(group, ranges, strict=True):
            if not settled:
                out += [(rule, kid, kh, a, b) for a, b in found]

    def batch_of(out):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["rule", "kid", "kh", "lo", "hi"])

    def run(batches):
        key, group = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("kid", "kh", "settled", "anchor", "lo", "hi", "units", "rule", "key", "least", "most")]
            for *row, rule, lead, least, most in zip(*columns, strict=True):
                if (rule, lead, least, most) != key:
                    flush(key, group, out)
                    key, group = (rule, lead, least, most), []
                group.append(row)
            yield batch_of(out)
        flush(key, group, out := [])
        yield batch_of(out)

    return dealt.mapInArrow(run, "rule int, kid long, kh long, lo int, hi int")


def last_pass(joined: DataFrame, rules: list[Rule], with_text: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = []
            for body, starts, more in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "more")), strict=True):
                found.append(cut(body, [(x["rule"], x["lo"], x["hi"]) for x in [*(starts or []), *(more or [])]], rules, with_text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "kid", "kh", "n_bytes")), pa.array(found, FOUND_ARROW), batch.column("rest")], names=["doc_id", "kid", "kh", "n_bytes", "found", "rest"])

    columns = joined.select("doc_id", "kid", "kh", "n_bytes", "text", "starts", "more", "rest")
    rest = joined.schema["rest"].dataType.simpleString()
    return columns.mapInArrow(run, f"doc_id long, kid long, kh long, n_bytes long, found {FOUND}, rest {rest}")


def drop_repeats(docs: DataFrame, rule: Rule = PASSAGES) -> DataFrame:
    """The documents with the passages cut out that other documents have too (by default those
    of over 50 words), and n_chars, if there, as it is now. Null texts come back empty."""
    carry = [c for c in docs.columns if c != "text"]
    found = suffix_repeats(docs, [rule], with_text=True, carry=carry)
    kinds = dict(docs.dtypes)
    kept = F.col("found")[0]["kept"]
    now = {"text": kept.alias("text"), "n_chars": F.length(kept).cast(kinds.get("n_chars", "long")).alias("n_chars")}
    return found.select(*[now.get(c, F.col(f"rest.`{c}`").alias(c)) for c in docs.columns])


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of the 400-byte rule; shares_passage and passage_bytes say whether,
    and for how many bytes, the text has passages of over 50 words of other documents."""
    found = suffix_repeats(documents(spark, sf_dir), [STRINGS, PASSAGES])
    covered = lambda i: F.aggregate(F.col("found")[i]["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    strings = [covered(0).alias("n_removed"), F.size(F.col("found")[0]["spans"]).cast("long").alias("n_spans"), F.col("found")[0]["kept_sha256"].alias("kept_sha256")]
    return found.select("doc_id", "n_bytes", *strings, (covered(1) > 0).alias("shares_passage"), covered(1).alias("passage_bytes"))
