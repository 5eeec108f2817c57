"""Registered queries over audit messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warder.functions.state import scratch_path
from warder.operators.audit_filter import AuditFilter, DateRange, View, apply_saved_filters, filter_rows, place_messages, saved_filters
from warder.operators.audit_report import counts, distinct_symbols, report, view_counts
from warder.operators.explain import explain_messages
from warder.plans.fixtures import Relations
from warder.sources.audit_log import join_continuations, parse_lines, read_audit, render_messages
from warder.streaming.audit_stream import tail_audit

ROW = ["msg_id", "ts", "host", "msg_type", "decision", "stype", "ttype", "tclass", "port"]
TYPES = [f"p{i}" for i in range(0, 60)]
FROM, TO = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)


def parsed(r: Relations, having: str = "") -> DataFrame:
    """Messages rendered to text lines, those that have a word in the text, and parsed back."""
    lines = render_messages(r.audit_messages(), "value").select("value")
    lines = lines.filter(F.col("value").contains(having)) if having else lines
    return parse_lines(lines).withColumns({"msg_id": F.col("serial"), "ts": F.col("ts").cast("timestamp_ntz")})


def select(df: DataFrame) -> DataFrame:
    return df.select("msg_id", "stype", "ttype", "decision")


def audit_flagship(r: Relations) -> DataFrame:
    f = AuditFilter({"msg": "denied", "tgt_type": TYPES}, "all", True)
    rows = View([f]).apply(parsed(r, "denied"))
    return rows.groupBy("host", "stype", "ttype", "tclass").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host", "stype", "ttype", "tclass")


def audit_sort(r: Relations) -> DataFrame:
    """The place of every message by kind, target type (descending), port and identifier."""
    return place_messages(r.audit, [("message_type", True), ("target_type", False), ("port", True)]).select("msg_id", "place")


def split_lines(r: Relations, kinds: tuple[str, ...]) -> DataFrame:
    """(msg_id, host, lines): rendered messages, those of booleans and policy loads cut in two."""
    whole = render_messages(r.audit_messages().filter(F.col("msg_type").isin(*kinds)), "text")
    # the second line of a load has the head of the first
    cut = F.when(F.col("msg_type") == "BOOL", F.array(F.expr("substring(text, 1, instr(text, '{'))"), F.expr("substring(text, instr(text, '{') + 1)")))
    cut = cut.when(F.col("msg_type") == "LOAD", F.array(F.regexp_extract("text", r"^(.*), \d+ classes", 1), F.concat(F.regexp_extract("text", r"^(.*security: )", 1), F.regexp_extract("text", r"(\d+ classes.*)$", 1))))
    return whole.select("msg_id", "host", cut.otherwise(F.array("text")).alias("lines"))


def folded(messages: DataFrame) -> DataFrame:
    change = F.element_at("changes", 1)
    return messages.select(F.col("serial").alias("msg_id"), "msg_type", change["bool"].alias("bool_name"), change["value"].alias("state"), F.col("load.users").alias("users"), F.col("load.rules").alias("rules"), "stype", "ttype")


def audit_continuation(r: Relations) -> DataFrame:
    """Every message of booleans or of a policy load, split over two lines, is put together again."""
    lines = split_lines(r, ("BOOL", "LOAD")).select(F.col("host").alias("file"), F.posexplode("lines").alias("k", "value"), "msg_id")
    out = parse_lines(join_continuations(lines.withColumn("line_no", F.col("msg_id") * 2 + F.col("k")), fold_lines=1000))
    return folded(out).drop("stype", "ttype")


def text_log(r: Relations) -> str:
    """The messages as text files, in a scratch folder."""
    path = scratch_path(r.spark, "log")
    split_lines(r, ("AVC", "BOOL", "LOAD")).select(F.array_join("lines", "\n").alias("value")).write.text(path)
    return path


def audit_text_log(r: Relations) -> DataFrame:
    """All messages, read back from text files in byte ranges that cut through them."""
    return folded(read_audit(r.spark, text_log(r), range_bytes=100_000))


def audit_tail(r: Relations) -> DataFrame:
    """All messages, read back by a stream that follows the text files."""
    out, messages = scratch_path(r.spark, "tail"), tail_audit(r.spark, text_log(r))
    messages = folded(messages)
    messages.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    return r.spark.read.schema(messages.schema).parquet(out)


def saved(r: Relations) -> DataFrame:
    filters = [AuditFilter({"msg": "denied", "src_type": ["s1", "s2", "s3"]}, "all", True, "few"), AuditFilter({"anyport": 7, "host": "h[0-2]"}, "any", False, "ports")]
    return apply_saved_filters(r.audit, saved_filters(filter_rows(r.spark, filters))).select("msg_id", "filter")


TEXT_SQL = """strftime(ts, '%b') || printf(' %2d ', day(ts)) || strftime(ts, '%H:%M:%S') || ' ' || host || ' kernel: audit(' || (epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || ':' || msg_id || '): ' ||
 CASE msg_type WHEN 'AVC' THEN 'avc:  ' || decision || '  { read write } for  pid=' || (msg_id % 1000) || ' comm="prog ' || stype || '"' || coalesce(' port=' || port, '') || ' scontext=user_u:role_r:' || stype || ':s0-s1 tcontext=system_u:object_r:' || ttype || ':s0-s1 tclass=' || tclass
 WHEN 'BOOL' THEN 'security: committed booleans: { allow_x:' || CASE WHEN msg_id % 2 = 0 THEN 1 ELSE 0 END || ' }' ELSE 'security: 5 users, 6 roles, 7 types, 8 bools, 3 classes, 4 rules' END"""
FOLDED_SQL = "SELECT msg_id, msg_type, CASE msg_type WHEN 'BOOL' THEN 'allow_x' END AS bool_name, CASE msg_type WHEN 'BOOL' THEN msg_id % 2 = 0 END AS state, CASE msg_type WHEN 'LOAD' THEN 5 END AS users, CASE msg_type WHEN 'LOAD' THEN 4 END AS rules"
REPORT_SQL = " UNION ALL ".join(
    f"SELECT {no} AS section_no, '{name}' AS section, CAST(0 AS BIGINT) AS item_no, '{name}: ' || count(*) AS text FROM audit WHERE {test}" + ("" if no == 1 else f" UNION ALL SELECT {no}, '{name}', msg_id + 1, {TEXT_SQL} FROM audit WHERE {test}")
    for no, (name, test) in enumerate((("statistics", "true"), ("enforcement toggles", "false"), ("policy loads", "msg_type = 'LOAD'"), ("boolean changes", "msg_type = 'BOOL'"), ("allow listing", "decision = 'granted'"), ("deny listing", "decision = 'denied'")), 1)
)

QUERIES = {
    "audit_flagship": (audit_flagship, f"SELECT host, stype, ttype, tclass, count(*) AS n FROM audit WHERE decision = 'denied' AND ttype IN ({', '.join(repr(t) for t in TYPES)}) GROUP BY ALL"),
    "audit_parse_roundtrip": (lambda r: parsed(r).select(*ROW), f"SELECT {', '.join(ROW)} FROM audit"),
    "audit_filter_all": (lambda r: select(View([AuditFilter({"msg": "denied", "src_type": ["s1", "s2", "s7"]})]).apply(r.audit)), "SELECT msg_id, stype, ttype, decision FROM audit WHERE (decision = 'denied' OR decision IS NULL) AND (stype IN ('s1', 's2', 's7') OR stype IS NULL)"),
    "audit_filter_any": (lambda r: select(View([AuditFilter({"msg": "denied", "host": "h[12]"}, "any")]).apply(r.audit)), "SELECT msg_id, stype, ttype, decision FROM audit WHERE coalesce(decision = 'denied', false) OR host IN ('h1', 'h2')"),
    "audit_filter_strict": (lambda r: select(View([AuditFilter({"msg": "granted", "obj_class": ["dir"], "anyport": 40}, "all", True)]).apply(r.audit)), "SELECT msg_id, stype, ttype, decision FROM audit WHERE decision = 'granted' AND tclass = 'dir' AND port = 40"),
    "audit_filter_date": (lambda r: select(View([AuditFilter({"date_time": DateRange("between", FROM, TO)})]).apply(r.audit.withColumn("has_year", F.lit(True)))), f"SELECT msg_id, stype, ttype, decision FROM audit WHERE date_trunc('second', ts) >= TIMESTAMP '{FROM}' AND date_trunc('second', ts) < TIMESTAMP '{TO}'"),
    "audit_view_hide": (lambda r: select(View([AuditFilter({"tgt_type": ["p1", "p2"]}, "all", True)], show=False, hidden=r.audit.filter("msg_id % 10 = 3").select("msg_id")).apply(r.audit)), "SELECT msg_id, stype, ttype, decision FROM audit WHERE NOT coalesce(ttype IN ('p1', 'p2'), false) AND msg_id % 10 <> 3"),
    "audit_saved_filters": (saved, "SELECT msg_id, 'few' AS filter FROM audit WHERE decision = 'denied' AND stype IN ('s1', 's2', 's3') UNION ALL SELECT msg_id, 'ports' FROM audit WHERE coalesce(port = 7, false) OR host IN ('h0', 'h1', 'h2')"),
    "audit_sort": (audit_sort, "SELECT msg_id, row_number() OVER (ORDER BY k, ttype DESC NULLS LAST, port ASC NULLS LAST, msg_id) AS place FROM (SELECT *, CASE WHEN msg_type = 'AVC' THEN CASE WHEN decision = 'denied' THEN 0 ELSE 1 END WHEN msg_type = 'BOOL' THEN 2 ELSE 3 END AS k FROM audit)"),
    "audit_counts": (lambda r: view_counts(r.audit, ["host"]), "SELECT host, count(*) AS total, count(*) FILTER (decision = 'denied') AS denied, count(*) FILTER (decision = 'granted') AS granted, count(*) FILTER (msg_type = 'BOOL') AS bool_changes, count(*) FILTER (msg_type = 'LOAD') AS policy_loads FROM audit GROUP BY host"),
    "audit_report": (lambda r: report(r.audit_messages()), REPORT_SQL),
    "audit_distinct": (lambda r: distinct_symbols(r.audit, "type"), "SELECT stype AS symbol FROM audit WHERE stype IS NOT NULL UNION SELECT ttype FROM audit WHERE ttype IS NOT NULL"),
    "audit_windowed_counts": (lambda r: r.audit.groupBy(F.date_trunc("hour", "ts").alias("hour"), "tclass").agg(*counts()), "SELECT date_trunc('hour', ts) AS hour, tclass, count(*) AS total, count(*) FILTER (decision = 'denied') AS denied, count(*) FILTER (decision = 'granted') AS granted, count(*) FILTER (msg_type = 'BOOL') AS bool_changes, count(*) FILTER (msg_type = 'LOAD') AS policy_loads FROM audit GROUP BY 1, 2"),
    "audit_continuation": (audit_continuation, f"{FOLDED_SQL} FROM audit WHERE msg_type IN ('BOOL', 'LOAD')"),
    "audit_text_log": (audit_text_log, f"{FOLDED_SQL}, stype, ttype FROM audit"),
    "audit_tail": (audit_tail, f"{FOLDED_SQL}, stype, ttype FROM audit"),
    "audit_explain": (
        lambda r: explain_messages(r.audit.filter("msg_type = 'AVC'"), r.grouped_rules(), r.policy_type_attr()).select("msg_id", "policy_id", "kind", "rule_target", "perms"),
        "SELECT a.msg_id, r.policy_id, r.kind, r.target AS rule_target, string_agg(r.perm, ',' ORDER BY r.perm) AS perms FROM audit AS a JOIN (SELECT v.policy_id, v.kind, v.source, v.target, v.class, v.perm, coalesce(t.type, v.target) AS concrete FROM avrule_perm AS v LEFT JOIN type_attr AS t ON v.target = t.attr) AS r ON a.stype = r.source AND a.ttype = r.concrete AND a.tclass = r.class WHERE a.msg_type = 'AVC' GROUP BY a.msg_id, r.policy_id, r.kind, r.target",
    ),
}
