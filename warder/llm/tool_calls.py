"""Linking tool calls to their results (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warder.llm.common import staged

#: Bound of the schema table, which is broadcast.
SCHEMA_ROWS = 10_000
#: Places of a conversation that one task orders.
PLACES = 1000
#: JSON types by what Spark says of a variant value.
TYPES = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "DOUBLE": "number", "VOID": "null"}


def type_sql(value: str) -> str:
    """SQL for the JSON type of a variant."""
    whole = f"schema_of_variant({value})"
    cases = " ".join(f"WHEN {whole} = '{k}' THEN '{v}'" for k, v in TYPES.items())
    return (
        f"CASE {cases} WHEN {whole} LIKE 'DECIMAL(%,0)' THEN 'integer' WHEN {whole} LIKE 'DECIMAL%' OR {whole} = 'FLOAT' THEN 'number'"
        f" WHEN {whole} LIKE 'ARRAY%' THEN 'array' WHEN {whole} LIKE 'OBJECT%' THEN 'object' ELSE lower({whole}) END"
    )


def unique_calls(calls: DataFrame) -> DataFrame:
    """One row per (conv, call_id): the first by place, name and arguments."""
    first = F.min(F.struct("place", "name", "arguments", "after")).alias("c")
    return calls.groupBy("conv", "call_id").agg(first, F.count(F.lit(1)).alias("calls")).select("conv", "call_id", "c.*", "calls")


def unique_results(results: DataFrame) -> DataFrame:
    first = F.min(F.struct("place", "content")).alias("r")
    return results.groupBy("conv", "call_id").agg(first, F.count(F.lit(1)).alias("results")).select("conv", "call_id", F.col("r.place").alias("result_place"), F.col("r.content").alias("content"), "results")


def topological(calls: DataFrame) -> DataFrame:
    """Add ``ready``, ``level``, ``lost`` (a dependency that no call has) and ``cyclic``.

    ``calls`` is a table with unique (conv, call_id). A call is ready at the latest place of
    itself and all that it depends on; level orders calls that are ready at one place. While
    all dependencies lead backward the place itself is the order and no round is needed.
    Otherwise, in conversations with a dependency that leads forward, calls that wait for no
    other are taken away round by round; what is left is in or behind a cycle and keeps its
    place. Then ready and level rise over the other edges until nothing changes.
    """
    edges = calls.select("conv", "call_id", "place", F.explode_outer("after").alias("on")).filter("on is not null")
    known = calls.select("conv", F.col("call_id").alias("on"), F.col("place").alias("on_place"))
    edges = staged(edges.join(known, ["conv", "on"], "left"), "edges")
    lost = edges.filter("on_place is null").select("conv", "call_id").distinct().withColumn("lost", F.lit(True))
    turned = edges.filter("on_place >= place").select("conv").distinct()
    state = calls.select("conv", "call_id", F.col("place").cast("long").alias("ready"), F.lit(0).alias("level"))
    cyclic = None
    if not turned.isEmpty():
        live = staged(edges.filter("on_place is not null").join(turned, "conv", "left_semi").select("conv", "call_id", "on"), "live_edges")
        cyclic, left = live.select("conv", "call_id").distinct(), -1
        while (n := cyclic.count()) != left:
            held = live.join(cyclic, ["conv", "call_id"], "left_semi").join(cyclic.withColumnRenamed("call_id", "on"), ["conv", "on"], "left_semi")
            cyclic, left = staged(held.select("conv", "call_id").distinct(), "waiting"), n
        live = staged(live.join(cyclic, ["conv", "call_id"], "left_anti"), "live_edges")
        state, moving = staged(state, "order"), True
        while moving:
            on = state.select("conv", F.col("call_id").alias("on"), F.col("ready").alias("r"), F.col("level").alias("l"))
            want = live.join(on, ["conv", "on"]).groupBy("conv", "call_id").agg(F.max(F.struct("r", (F.col("l") + 1).alias("l"))).alias("w"))
            up = F.coalesce(F.col("w.r") > F.col("ready"), F.lit(False)) | F.coalesce((F.col("w.r") == F.col("ready")) & (F.col("w.l") > F.col("level")), F.lit(False))
            moved = state.join(want, ["conv", "call_id"], "left").withColumn("up", up)
            state = staged(moved.select("conv", "call_id", F.when(F.col("up"), F.col("w.r")).otherwise(F.col("ready")).alias("ready"), F.when(F.col("up"), F.col("w.l")).otherwise(F.col("level")).alias("level"), "up"), "order")
            moving = not state.filter("up").isEmpty()
            state = state.drop("up")
    out = calls.join(state, ["conv", "call_id"]).join(lost, ["conv", "call_id"], "left")
    if cyclic is None:
        return out.withColumn("cyclic", F.lit(False))
    return out.join(cyclic.withColumn("cyclic", F.lit(True)), ["conv", "call_id"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def ranked(calls: DataFrame) -> DataFrame:
    """Add ``order``, gapless from 0 in each conversation by (ready, level, place, call_id).

    A conversation is cut every PLACES places; the parts are ranked on their own and moved up
    by the counts before them, so a conversation with a third of all calls is no single task.
    """
    table = staged(calls.withColumn("part", F.floor(F.col("ready") / PLACES)), "topological")
    sizes = table.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("conv", "part").orderBy("ready", "level", "place", "call_id"))
    return table.withColumn("inner", inner).join(starts, ["conv", "part"]).withColumn("order", F.col("start") + F.col("inner") - 1).drop("part", "inner", "start")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link, order, validate and serialise; one row per (conv, call_id) of either side.

    calls: conv, call_id, place, name, arguments (JSON text), after (array of call_ids).
    results: conv, call_id, place, content. schemas: tool, param, type (JSON type), required;
    at most SCHEMA_ROWS rows.

    Rows without conv or call_id cannot be linked and are returned with status ``unnamed``.
    Of calls (results) that repeat an identifier the first by place counts and the rest are
    an error ``repeated call`` (``repeated result``). Status is linked, pending (no result) or
    orphan (no call). Errors, sorted: bad JSON, cyclic, early result, lost dependency,
    missing <param>, repeated call, repeated result, type <param>, unknown <param>, unknown
    tool. A null or empty argument text is an empty object. Returns conv, call_id, order (null
    for orphans), status, valid, errors, and canonical: JSON with sorted keys at every level,
    no blanks, arguments as sent (null if they are no object). Empty tables give no rows;
    other columns are not read.
    """
    if schemas.count() > SCHEMA_ROWS:
        raise ValueError(f"more than {SCHEMA_ROWS} schema rows")
    calls = calls.select(F.col("conv").cast("string").alias("conv"), F.col("call_id").cast("string").alias("call_id"), "place", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    results = results.select(F.col("conv").cast("string").alias("conv"), F.col("call_id").cast("string").alias("call_id"), "place", "content")
    named = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    ordered = ranked(topological(staged(unique_calls(calls.filter(named)), "calls")))
    tools = schemas.groupBy(F.col("tool").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("type", "required")))).alias("params"))
    both = ordered.withColumn("is_call", F.lit(True)).join(unique_results(results.filter(named)).hint("shuffle_hash"), ["conv", "call_id"], "full").join(F.broadcast(tools), "name", "left")
    is_call, has_result = F.col("is_call").isNotNull(), F.col("results").isNotNull()
    text = F.when(F.trim(F.coalesce("arguments", F.lit(""))) == "", "{}").otherwise(F.col("arguments"))
    both = both.withColumn("args", F.when(is_call, F.try_parse_json(text))).withColumn("given", F.expr("try_cast(args AS MAP<STRING, VARIANT>)"))
    both = both.withColumn("types", F.expr(f"transform_values(given, (k, v) -> {type_sql('v')})"))
    wrong = [
        (is_call & F.col("given").isNull(), F.lit("bad JSON")),
        (F.col("cyclic"), F.lit("cyclic")),
        (is_call & (F.col("result_place") < F.col("place")), F.lit("early result")),
        (F.col("lost"), F.lit("lost dependency")),
        (F.col("calls") > 1, F.lit("repeated call")),
        (F.col("results") > 1, F.lit("repeated result")),
        (is_call & F.col("params").isNull(), F.lit("unknown tool")),
    ]
    single = F.array_compact(F.array(*[F.when(c, what) for c, what in wrong]))
    by_param = F.expr(
        """concat(
        transform(filter(map_entries(params), p -> p.value.required AND NOT map_contains_key(types, p.key)), p -> concat('missing ', p.key)),
        transform(filter(map_keys(types), k -> NOT map_contains_key(params, k)), k -> concat('unknown ', k)),
        transform(filter(map_entries(types), t -> map_contains_key(params, t.key) AND NOT (params[t.key].type = t.value OR (params[t.key].type = 'number' AND t.value = 'integer'))), t -> concat('type ', t.key)))"""
    )
    both = both.withColumn("errors", F.array_sort(F.concat(single, F.coalesce(by_param, F.array().cast("array<string>")))))
    status = F.when(is_call & has_result, "linked").when(is_call, "pending").otherwise("orphan")
    both = both.withColumn("status", status)
    canonical = F.to_json(
        F.struct(F.when(F.col("given").isNotNull(), F.col("args")).alias("arguments"), "call_id", "conv", "errors", "name", "order", F.col("content").alias("result"), "status"),
        {"ignoreNullFields": "false"},
    )
    columns = ["conv", "call_id", "order", "status", (F.size("errors") == 0).alias("valid"), "errors", canonical.alias("canonical")]
    stray = calls.filter(~named).select("conv", "call_id").unionByName(results.filter(~named).select("conv", "call_id"))
    stray = stray.select("conv", "call_id", F.lit(None).cast("long").alias("order"), F.lit("unnamed").alias("status"), F.lit(False).alias("valid"), F.array(F.lit("unnamed")).alias("errors"), F.lit(None).cast("string").alias("canonical"))
    return both.select(*columns).unionByName(stray)


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results told from plain conversation turns.

    A user turn calls a tool: ``search`` to begin with, ``refine`` after an earlier user turn
    two places before, whose call it depends on. Every seventh word count is sent as a string
    and every eleventh query is left out, as careless callers do. An assistant turn answers
    the call of the turn before it.
    """
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    user = turns.filter("role = 'user'").select(F.col("conv_id").alias("conv"), "turn", "text", words.alias("words"))
    prior = user.select("conv", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("prior")).distinct()
    user = user.join(prior, ["conv", "turn"], "left")
    id_of = lambda t: F.concat(F.lit("call-"), F.lpad(t.cast("string"), 6, "0"))
    count = F.when(F.col("words") % 7 == 0, F.concat(F.lit('"'), F.col("words"), F.lit('"'))).otherwise(F.col("words").cast("string"))
    query = F.when((F.col("words") % 11 != 0) & F.col("text").isNotNull(), F.concat(F.lit(', "query": '), F.expr("to_json(to_variant_object(array(text)))").substr(F.lit(2), F.length(F.expr("to_json(to_variant_object(array(text)))")) - 2))).otherwise("")
    calls = user.select(
        "conv",
        id_of(F.col("turn")).alias("call_id"),
        F.col("turn").alias("place"),
        F.when(F.col("prior"), "refine").otherwise("search").alias("name"),
        F.concat(F.lit('{"words": '), count, query, F.lit("}")).alias("arguments"),
        F.when(F.col("prior"), F.array(id_of(F.col("turn") - 2))).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("conv"), id_of(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content"))
    return calls, results


TOOLS = """SELECT * FROM VALUES ('search', 'query', 'string', true), ('search', 'words', 'integer', false),
('refine', 'query', 'string', true), ('refine', 'words', 'integer', true) AS t (tool, param, type, required)"""


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    linked = link_calls(calls, results, spark.sql(TOOLS))
    return linked.select(F.col("conv").cast("long").alias("conv_id"), "call_id", F.col("order").cast("long").alias("call_order"), "status", "valid", F.array_join("errors", ",").alias("errors"), "canonical")


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, text, len(string_split(coalesce(text, ''), ' ')) AS words FROM conversations WHERE role = 'user'),
calls AS (
  SELECT c.conv_id, c.turn, 'call-' || lpad(CAST(c.turn AS VARCHAR), 6, '0') AS call_id, c.words, c.text,
    EXISTS (SELECT 1 FROM c AS p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2) AS prior,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS call_order FROM c),
results AS (
  SELECT conv_id, 'call-' || lpad(CAST(turn - 1 AS VARCHAR), 6, '0') AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(calls.conv_id, results.conv_id) AS conv_id, coalesce(calls.call_id, results.call_id) AS call_id, call_order,
    CASE WHEN calls.call_id IS NULL THEN 'orphan' WHEN results.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status,
    calls.call_id IS NOT NULL AS is_call, words, text, prior, content, words % 11 = 0 AS no_query, words % 7 = 0 AS bad_words
  FROM calls FULL JOIN results ON calls.conv_id = results.conv_id AND calls.call_id = results.call_id),
e AS (
  SELECT *, CASE WHEN NOT is_call THEN '' WHEN no_query AND bad_words THEN 'missing query,type words'
    WHEN no_query THEN 'missing query' WHEN bad_words THEN 'type words' ELSE '' END AS errors FROM j)
SELECT conv_id, call_id, call_order, status, errors = '' AS valid, errors,
  '{"arguments":' || CASE WHEN NOT is_call THEN 'null' ELSE '{' || CASE WHEN no_query THEN '' ELSE '"query":' || CAST(to_json(text) AS VARCHAR) || ',' END
      || '"words":' || CASE WHEN bad_words THEN '"' || words || '"' ELSE CAST(words AS VARCHAR) END || '}' END
  || ',"call_id":"' || call_id || '","conv":"' || conv_id || '","errors":'
  || CASE errors WHEN '' THEN '[]' ELSE '["' || replace(errors, ',', '","') || '"]' END
  || ',"name":' || CASE WHEN NOT is_call THEN 'null' WHEN prior THEN '"refine"' ELSE '"search"' END
  || ',"order":' || coalesce(CAST(call_order AS VARCHAR), 'null')
  || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS canonical
FROM e
"""
