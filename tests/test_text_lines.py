"""Line places of text logs, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from warder.sources import text_lines
from warder.sources.audit_log import fold_ranges, join_continuations, parse_lines, read_audit, read_audit_text
from warder.streaming import audit_stream
from warder.streaming.audit_stream import tail_audit

BOOL = "Mar  4 10:11:13 h1 kernel: security: committed booleans: { allow_x:1,"
LOADS = ["Mar  4 10:11:14 h1 kernel: security:  5 users, 6 roles, 7 types, 8 bools", "Mar  4 10:11:14 h1 kernel: security:  9 classes, 10 rules"]
AVC = 'Mar  4 10:11:12 h1 kernel: audit(1709547072.123:456): avc:  denied  { read } for  pid=77 comm="cp" scontext=u:r:s1:s0 tcontext=u:object_r:p7:s0 tclass=file'


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_every_line_in_one_range(tmp_path, chunk):
    rng = random.Random(chunk)
    for i in range(30):
        text = b"".join(rng.choice([b"", b"a", b"long line" * 3, "é".encode()]) + rng.choice([b"\n", b"\r\n"]) for _ in range(rng.randint(0, 12)))
        text += rng.choice([b"", b"no end"])
        path = tmp_path / f"{i}"
        path.write_bytes(text)
        want, at = [], 0
        for line in text.splitlines(keepends=True) if text else []:
            want.append((at, line.rstrip(b"\r\n")))
            at += len(line)
        for size in (1, 4, 7, 1000):
            got = [x for r in text_lines.cut(str(path), 0, len(text), size) for x in text_lines.lines(r.file, r.start, r.end, chunk)]
            assert got == want
        assert text_lines.last_line_end(str(path), 0, len(text), chunk) == text.rfind(b"\n") + 1


def test_batch_folds_over_ranges(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    body = [AVC, BOOL, "allow_y:0, allow_z:1 }", *LOADS, "noise", AVC]
    for name in ("a", "b"):
        (tmp_path / "logs" / name).write_text("\n".join(body * 20) + "\n")
    (tmp_path / "logs" / "_hidden").write_text("not read")
    text = read_audit_text(spark, str(tmp_path / "logs"), range_bytes=100)
    assert text.rdd.getNumPartitions() > 50
    rows = [(r["offset"], r["value"]) for r in text.filter(F.col("file").endswith("/a")).orderBy("offset").collect()]
    at, want = 0, []
    for line in body * 20:
        want.append((at, line))
        at += len(line) + 1
    assert rows == want
    for size in (100, 333, 1 << 20):
        found = read_audit(spark, str(tmp_path / "logs"), range_bytes=size)
        by_type = {r["msg_type"]: r for r in found.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("changes")).alias("changes"), F.max("load.rules").alias("rules"), F.max("load.users").alias("users")).collect()}
        assert {k: r["n"] for k, r in by_type.items()} == {"AVC": 80, "BOOL": 40, "LOAD": 40}
        assert by_type["BOOL"]["changes"] == 3 and (by_type["LOAD"]["users"], by_type["LOAD"]["rules"]) == (5, 10)


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        read_audit_text(spark, str(tmp_path / "nowhere")).collect()


def test_tail_folds_growing_files(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    # a line that is being written waits for its end
    (log / "a").write_text(f"{AVC}\n{BOOL}\nallow_y")
    place = str(tmp_path / "out")

    def run():
        messages = tail_audit(spark, str(log)).select("file", "offset", "msg_type", "changes", "raw")
        messages.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(place).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(place).select(F.regexp_extract("file", "[^/]*$", 0), "offset", "msg_type", F.size("changes")).collect())

    assert run() == [("a", 0, "AVC", None)]
    with (log / "a").open("a") as f:
        f.write(f":0 }}\n{LOADS[0]}\n")
    (log / "b").write_text(f"{AVC}\n")
    first = ("a", len(AVC) + 1, "BOOL", 2)
    assert run() == [("a", 0, "AVC", None), first, ("b", 0, "AVC", None)]
    with (log / "a").open("a") as f:
        f.write(f"{LOADS[1]}\n")
    assert [r[2] for r in run()] == ["AVC", "BOOL", "LOAD", "AVC"]


def test_parse_keeps_first_pair_and_columns(spark):
    rows = spark.createDataFrame([(1, f'{AVC} pid=9 name="x=y z"')], "id long, value string")
    got = parse_lines(rows).first()
    assert (got["id"], got["pid"], got["name"], got["comm"], got["stype"]) == (1, 77, "x=y z", "cp", "s1")
    assert not [c for c in got.asDict() if c.startswith("__")]


@pytest.mark.parametrize("size", [40, 150, 1 << 20])
def test_folding_where_it_is_read(spark, tmp_path, size):
    # ranges begin and end within messages of several lines, loads, noise and lines of no daemon
    rng = random.Random(size)
    pool = [BOOL, BOOL, f"{BOOL} }}", "b:0,", "c:1 }", "noise", *LOADS, LOADS[1], AVC, "", "security: 3 rules", "avc: x"]
    for i in range(3):
        (tmp_path / f"f{i}").write_text("".join(rng.choice(pool) + "\n" for _ in range(60)))
    lines = read_audit_text(spark, str(tmp_path), range_bytes=size)
    rows = lambda df: sorted(map(tuple, df.select("file", "offset", "value").collect()))
    assert rows(fold_ranges(lines)) == rows(join_continuations(lines, "offset", size))


def test_small_ranges_share_tasks():
    # 7 GB in ranges of 100 KB: some hundred tasks, which hold all ranges once
    found = text_lines.tasks({"a": (0, 7_000_000_000), "b": (5, 950_005)}, 100_000)
    assert len(found) < 2 * text_lines.TASKS
    assert [(r.start, r.end) for r in found if r.file == "b"] == [(5, 950_005)]
    assert sum(r.end - r.start for r in found) == 7_000_950_000 and max(r.end - r.start for r in found) <= text_lines.RANGE_BYTES


def test_stream_folds_where_lines_are_read():
    # cut anywhere, whole messages and the lines that meet in the state give what the state gives for all lines
    import pandas as pd
    import pyarrow as pa

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get, clear = lambda self: self.held, lambda self: self.update(None)

        def update(self, held):
            self.held = held

    def state(parts):
        of, out = audit_stream.Continuations(), []
        of.pending = Value()
        for rows in parts:
            for done in of.handleInputRows(("f",), iter([pd.DataFrame(rows, columns=["line_no", "value"])]), None):
                out += list(zip(done["line_no"], done["value"]))
        return out, of.pending.held

    rng = random.Random(3)
    pool = [BOOL, BOOL, f"{BOOL} }}", "b:0,", "c:1 }", "noise", *LOADS, LOADS[1], AVC, "", "security: 3 rules", f"{BOOL} security: 3 classes"]
    for _ in range(400):
        lines = [(i, rng.choice(pool)) for i in range(30)]
        cuts = sorted(rng.sample(range(1, 30), 4))
        parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        table = lambda rows: pa.RecordBatch.from_pylist([{"file": "f", "line_no": n, "value": v} for n, v in rows])
        folded = [[r for b in audit_stream.fold_lines(iter([table(p[:2]), table(p[2:])] if len(p) > 2 else [table(p)])) for r in b.to_pylist()] for p in parts]
        edges = [[(r["line_no"], r["value"]) for r in p if r["slot"] < 0] for p in folded]
        whole = [(r["line_no"], r["value"]) for p in folded for r in p if r["slot"] >= 0]
        want, pending = state(parts)
        got, left = state(edges)
        assert sorted(got + whole) == sorted(want) and left == pending
        one, _ = state([[x for p in edges for x in p]])
        assert sorted(one + whole) == sorted(want)
    # of a long range hardly a line goes to the state
    long = [(i, v) for i, v in enumerate([AVC, BOOL, "c:1 }", *LOADS] * 2000)]
    rows = [r for b in audit_stream.fold_lines(iter([table(long)])) for r in b.to_pylist()]
    assert sum(r["slot"] < 0 for r in rows) == 1 and sum(r["slot"] >= 0 for r in rows) == 6000
