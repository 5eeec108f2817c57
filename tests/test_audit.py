import datetime as dt

import pytest
from pyspark.sql import functions as F

from warder.operators.audit_filter import AuditFilter, DateRange, View, filter_rows, saved_filters, sort_messages
from warder.operators.audit_report import distinct_symbols, report, view_counts, write_report
from warder.sources.audit_log import export_messages, join_continuations, malformed_lines, parse_lines, read_audit_text, render_messages

AVC = 'Mar  4 10:11:12 h1 kernel: audit(1709547072.123:456): avc:  denied  { read write } for  pid=77 comm="cp a" name="b c" dev=sda1 ino=9 scontext=u:r:s1:s0-s1 tcontext=u:object_r:p7:s0 tclass=file'
LINES = [
    AVC,
    "Mar  4 10:11:13 h1 kernel: security: committed booleans: { allow_x:1, allow_y:0 }",
    "Mar  4 10:11:13 h1 kernel: security:  3 users, 4 roles, 5 types, 6 bools",
    "type=AVC msg=audit(1709547073.5:457): avc:  granted  { setenforce } for  pid=1 scontext=u:r:s2 tcontext=u:r:security_t tclass=security",
    "Mar  4 10:11:14 h1 kernel: audit(1709547074.0:458): avc:  denied  read } for  pid=78 scontext=u:r:s1 tcontext=u:r:p1 tclass=dir",
    "Mar  4 10:11:14 h1 kernel: audit(1709547074.0:459): avc:  denied  { send_msg } for  pid=x saddr=10.0.0.1 src=80 daddr=10.0.0.2 dest=443 netif=eth0 scontext=u:r:s1 tcontext=u:r:p1 tclass=tcp_socket odd=1",
    "Mar  4 10:11:15 h1 sshd[3]: nothing of interest",
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "msg_id long, value string")
    return parse_lines(rows).cache()


def test_parse(messages):
    got = {r["msg_id"]: r for r in messages.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    a = got[0]
    assert (a["host"], a["decision"], a["perms"], a["pid"], a["comm"], a["name"], a["inode"]) == ("h1", "denied", ["read", "write"], 77, "cp a", "b c", 9)
    assert (a["suser"], a["srole"], a["stype"], a["smls_lvl"], a["smls_clr"], a["tmls_clr"], a["tclass"]) == ("u", "r", "s1", "s0", "s1", "s0", "file")
    assert a["ts"] == dt.datetime(2024, 3, 4, 10, 11, 12, 123000) and a["has_year"] and a["serial"] == 456 and a["warnings"] == [] and a["avc_data"] == "FS"
    assert [(c["bool"], c["value"]) for c in got[1]["changes"]] == [("allow_x", True), ("allow_y", False)] and not got[1]["has_year"] and got[1]["ts"].month == 3
    assert (got[2]["load"]["users"], got[2]["load"]["bools"], got[2]["load"]["rules"]) == (3, 6, None)
    assert got[3]["host"] is None and got[3]["decision"] == "granted" and got[3]["stype"] == "s2" and got[3]["smls_lvl"] is None
    assert got[5]["avc_data"] == "NET" and got[5]["sport"] == 80 and got[5]["dport"] == 443


def test_malformed(messages):
    bad = {r["warnings"][0] for r in malformed_lines(messages).collect()}
    assert bad == {"permissions", "unknown odd"}


def test_render_parses_back(messages):
    good = messages.filter("size(warnings) = 0")
    again = parse_lines(render_messages(good, "value").select("msg_id", "value"))
    columns = ["msg_id", "msg_type", "decision", "perms", "pid", "comm", "name", "stype", "ttype", "tclass", "changes", "load", "serial"]
    assert sorted(good.filter("has_year or msg_type <> 'AVC'").select(*columns).collect(), key=str) == sorted(again.filter("has_year or msg_type <> 'AVC'").select(*columns).collect(), key=str)


def test_continuations(spark):
    lines = ["k kernel: security: committed booleans: { a:1,", "b:0 }", AVC, "k kernel: security:  3 users, 4 roles, 5 types, 6 bools", "k kernel: security:  7 classes, 8 rules", "other"]
    rows = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no long, value string")
    got = [r["value"] for r in join_continuations(rows).orderBy("line_no").collect()]
    assert got == [f"{lines[0]} {lines[1]}", AVC, f"{lines[3]} {lines[4]}", "other"]


def rows_of(spark):
    data = [(1, "AVC", "denied", "s1", 80, "/a"), (2, "AVC", "granted", "s2", None, None), (3, "BOOL", None, None, None, None), (4, "AVC", "denied", "s2", 0, "/b")]
    return spark.createDataFrame(data, "msg_id long, msg_type string, decision string, stype string, port int, path string")


@pytest.mark.parametrize(
    ("criteria", "match", "strict", "want"),
    [
        ({}, "all", False, [1, 2, 3, 4]),
        ({}, "all", True, []),
        ({"msg": "denied"}, "all", False, [1, 3, 4]),
        ({"msg": "denied"}, "all", True, [1, 4]),
        ({"msg": "denied"}, "any", False, [1, 4]),
        ({"msg": "denied", "src_type": ["s2"]}, "any", False, [1, 2, 4]),
        ({"msg": "denied", "path": "/[ab]"}, "all", True, [1, 4]),
        ({"anyport": 80}, "all", True, [1]),
        ({"anyport": 0}, "all", True, []),
        ({"cap": 5}, "any", False, []),
        ({"cap": 5}, "all", False, [1, 2, 3, 4]),
    ],
)
def test_truth_table(spark, criteria, match, strict, want):
    df = rows_of(spark)
    f = AuditFilter(criteria, match, strict)
    shown = [r["msg_id"] for r in View([f]).apply(df).collect()]
    hidden = [r["msg_id"] for r in View([f], show=False).apply(df).collect()]
    assert sorted(shown) == want and sorted(shown + hidden) == [1, 2, 3, 4]


def test_dates_without_year(spark):
    df = spark.createDataFrame([(1, dt.datetime(1972, 3, 4, 1), False), (2, dt.datetime(2024, 3, 4, 1), True), (3, dt.datetime(2024, 5, 4, 1), True)], "msg_id long, ts timestamp, has_year boolean")
    got = lambda r: [x["msg_id"] for x in View([AuditFilter({"date_time": r})]).apply(df).collect()]
    assert got(DateRange("between", dt.datetime(2023, 3, 1), dt.datetime(2023, 4, 1))) == [1]
    assert got(DateRange("after", dt.datetime(2024, 4, 1))) == [3]
    assert got(DateRange("before", dt.datetime(2024, 4, 1), has_year=False)) == [1, 2]


def test_sort_puts_unsupported_last(spark):
    df = rows_of(spark)
    assert [r["msg_id"] for r in sort_messages(df, [("port", True)]).collect()] == [4, 1, 2, 3]
    assert [r["msg_id"] for r in sort_messages(df, [("port", False)]).collect()] == [1, 4, 2, 3]


def test_saved_filters_round_trip(spark):
    filters = [AuditFilter({"src_type": ["s1", "s2"], "port": 80, "date_time": DateRange("before", dt.datetime(2024, 1, 1))}, "any", True, "one")]
    assert saved_filters(filter_rows(spark, filters)) == filters


def test_counts_and_report(spark, messages, tmp_path):
    c = view_counts(messages).first()
    assert (c["total"], c["denied"], c["granted"], c["bool_changes"], c["policy_loads"]) == (6, 3, 1, 1, 1)
    assert {r["symbol"] for r in distinct_symbols(messages, "type").collect()} == {"s1", "s2", "p7", "security_t", "p1"}
    heads = {r["section"]: r["text"] for r in report(messages, malformed_lines(messages)).filter("item_no = 0 and section <> 'malformed'").collect()}
    assert heads["enforcement toggles"] == "enforcement toggles: 1" and heads["deny listing"] == "deny listing: 3"
    write_report(report(messages), str(tmp_path / "r"))
    export_messages(messages.filter("msg_id = 0"), str(tmp_path / "m"))
    back = parse_lines(read_audit_text(spark, str(tmp_path / "m"))).first()
    assert back["comm"] == "cp a" and back["serial"] == 456


def test_stream_equals_batch(spark, tmp_path):
    from warder.streaming.audit_stream import STORE, join_continuations_stream, tail_audit

    lines = ["k kernel: security: committed booleans: { a:1,", "b:0 }", AVC, "k kernel: security:  3 users, 4 roles, 5 types, 6 bools", "k kernel: security:  7 classes, 8 rules"]
    source = tmp_path / "in"
    for i in range(len(lines)):  # a batch for each line
        spark.createDataFrame([("f", i, lines[i])], "file string, line_no long, value string").coalesce(1).write.mode("append").parquet(str(source))
    for k, v in STORE.items():
        spark.conf.set(k, v)
    stream = spark.readStream.schema("file string, line_no long, value string").option("maxFilesPerTrigger", 1).parquet(str(source))
    run = join_continuations_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = {r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"{lines[0]} {lines[1]}", AVC, f"{lines[3]} {lines[4]}"}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("\n".join(LINES))
    run = tail_audit(spark, str(tmp_path / "logs")).select("raw", "msg_type").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log2")).trigger(availableNow=True).start(str(tmp_path / "out2"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).groupBy("msg_type").agg(F.count("*")).count() == 3
