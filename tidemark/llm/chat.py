"""Chat formatting with tool-call linking, in DataFrame operations only.

A message's text may hold tool calls (``{"tool_calls": [{"id", "name",
"arguments", "depends_on"}, ...]}``, or with name and arguments nested in
``function``) or, in role ``tool``, a result (``{"tool_call_id", "content"}``).
Calls and results meet in a hash join on conversation and id, calls are ordered
behind the calls they depend on and results behind the call they answer,
arguments are validated, and each message is written as canonical JSON: keys
sorted at every level, no blanks, numbers and strings as themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, join_spread, read_table, settle

SPEC = "array<struct<arg:string,type:string,required:boolean>>"
_KEY = ["conv_id", "call_id"]


def no_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "name string, arg string, type string, required boolean")


def _quoted(text: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped, all else as it is; null where null."""
    j = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(j, F.lit(6), F.length(j) - 6))


def _object(entries: Column) -> Column:
    """JSON of an array of (key, json), in order of the keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}"))


def _entries(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json")))


def _get(v: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def parse_messages(messages: DataFrame) -> DataFrame:
    """One row per message, call or result: conv_id, turn, role, kind, nth, call_id, name, args (JSON values by key), depends, rest.

    Text that isn't one JSON object with tool calls or a result is a message,
    as is what such an object holds besides its calls. nth is 0 for a message
    or result and counts a message's calls from 1. Objects with a repeated key
    aren't JSON objects here.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    looks_json = F.ltrim("text").startswith("{") & F.col("role").isin("assistant", "tool")
    base = base.withColumn("v", F.when(looks_json, F.try_parse_json("text")))
    base = base.withColumn("calls", F.when(F.col("role") == "assistant", _get("v", "tool_calls", "array<variant>")))
    base = base.withColumn("result_id", F.when(F.col("role") == "tool", _get("v", "tool_call_id", "string")))
    has_calls = F.size(F.coalesce("calls", F.array())) > 0
    others = F.when(has_calls, F.map_filter(F.expr("try_cast(v AS map<string,variant>)"), lambda k, _: ~k.isin("tool_calls", "role")))
    base = base.withColumn("others", others)
    nothing = F.lit(None).cast("variant")
    own = F.when(has_calls & (F.size("others") == 0), F.array().cast("array<variant>")).otherwise(F.array(nothing))
    # Place 0 is the message itself, and calls follow.
    rows = base.select("*", F.posexplode(F.concat(F.array(F.struct(F.lit(0).alias("n"), nothing.alias("call"))), F.transform(F.coalesce("calls", F.array().cast("array<variant>")), lambda c, i: F.struct((i + 1).alias("n"), c.alias("call"))))).alias("_", "item"), F.size(own).alias("has_own"))
    rows = rows.select("*", F.col("item.n").alias("nth"), F.col("item.call").alias("call")).filter((F.col("nth") > 0) | (F.col("has_own") > 0))
    called, is_result = F.col("nth") > 0, F.col("result_id").isNotNull()
    given = F.coalesce(F.expr("try_variant_get(call, '$.arguments', 'variant')"), F.expr("try_variant_get(call, '$.function.arguments', 'variant')"))
    rows = rows.withColumn("given", given)
    # Arguments may be JSON inside a string.
    spelled = F.expr("CASE WHEN schema_of_variant(given) = 'STRING' THEN try_parse_json(CAST(given AS string)) ELSE given END")
    args = F.coalesce(F.expr("try_cast(spelled AS map<string,variant>)"), F.create_map().cast("map<string,variant>"))
    rows = rows.withColumn("spelled", F.when(called, spelled)).withColumn("args", F.when(called, args))
    plain = F.array(F.struct(F.lit("content").alias("key"), _quoted(F.col("text")).alias("json")))
    answer = F.array(F.struct(F.lit("content").alias("key"), F.coalesce(F.to_json(F.expr("try_variant_get(v, '$.content', 'variant')")), F.lit('""')).alias("json")))
    return rows.select(
        "conv_id", "turn", "role",
        F.when(called, "call").when(is_result, "result").otherwise("message").alias("kind"),
        F.col("nth").cast("long").alias("nth"),
        F.when(called, _get("call", "id", "string")).otherwise(F.col("result_id")).alias("call_id"),
        F.when(called, F.coalesce(_get("call", "name", "string"), _get("call", "function.name", "string"))).alias("name"),
        F.transform(F.map_entries("args"), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json"), F.schema_of_variant(e["value"]).alias("type"))).alias("args"),
        F.when(called, F.array_distinct(F.coalesce(_get("call", "depends_on", "array<string>"), F.array().cast("array<string>")))).alias("depends"),
        F.when(F.col("others").isNotNull(), _entries(F.col("others"))).when(is_result, answer).otherwise(plain).alias("rest"),
    )


def _kind_of(json_type: Column) -> Column:
    """Schema type of a value by its variant type; whole numbers are integers, and numbers as well."""
    return (
        F.when(json_type == "BIGINT", "integer").when(json_type.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number").when(json_type == "STRING", "string")
        .when(json_type == "BOOLEAN", "boolean").when(json_type.startswith("OBJECT"), "object").when(json_type.startswith("ARRAY"), "array").otherwise("null")
    )


def argument_errors(args: Column, spec: Column) -> Column:
    """Sorted 'missing:arg', 'type:arg', 'unknown:arg'; none without a schema."""
    wrong = F.transform(args, lambda a: F.struct(a["key"].alias("key"), _kind_of(a["type"]).alias("kind"), F.filter(spec, lambda s: s["arg"] == a["key"]).alias("of")))
    fits = lambda a: F.exists(a["of"], lambda s: (s["type"] == a["kind"]) | ((s["type"] == "number") & (a["kind"] == "integer")))
    bad = F.transform(F.filter(wrong, lambda a: ~fits(a)), lambda a: F.concat(F.when(F.size(a["of"]) == 0, "unknown:").otherwise("type:"), a["key"]))
    keys = F.transform(args, lambda a: a["key"])
    missing = F.transform(F.filter(spec, lambda s: s["required"] & ~F.array_contains(keys, s["arg"])), lambda s: F.concat(F.lit("missing:"), s["arg"]))
    return F.when(spec.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_union(bad, missing)))


def depths(anchors: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, at) of calls that depend on others; depth is null in and behind a circle.

    ``anchors`` has at (turn, nth) and depends of each call. depth is the
    longest way to a call without dependencies, at the last place on all ways.
    A round settles the calls whose dependencies are settled, so there are as
    many rounds as the longest chain has links.
    """
    edges = anchors.select("conv_id", "call_id", "at", F.explode("depends").alias("on"))
    known = anchors.select("conv_id", F.col("call_id").alias("on"), F.col("at").alias("on_at"), (F.size("depends") == 0).alias("free"))
    edges = settle(edges.join(known, ["conv_id", "on"]))
    waits = settle(edges.groupBy("conv_id", "call_id", "at").agg(F.count(F.lit(1)).alias("needs")))
    # Calls that nothing holds up: without dependencies, or none of theirs is there.
    loose = edges.select("conv_id", "on", "on_at").distinct().join(waits.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_anti")
    done = loose.select("conv_id", F.col("on").alias("call_id"), F.lit(0).cast("long").alias("depth"), F.col("on_at").alias("at"))
    fresh, settled = settle(done), []
    open_edges = edges.select("conv_id", "call_id", "at", "on").join(waits.select("conv_id", "call_id", "needs"), ["conv_id", "call_id"])
    got = None
    while not fresh.isEmpty():
        met = open_edges.join(fresh.select("conv_id", F.col("call_id").alias("on"), "depth", F.col("at").alias("on_at")), ["conv_id", "on"])
        met = met.groupBy("conv_id", "call_id", "at", "needs").agg(F.count(F.lit(1)).alias("have"), F.max("depth").alias("depth"), F.max("on_at").alias("on_at"))
        if got is not None:
            met = met.unionByName(got).groupBy("conv_id", "call_id", "at", "needs").agg(F.sum("have").alias("have"), F.max("depth").alias("depth"), F.max("on_at").alias("on_at"))
        met = settle(met)
        fresh = settle(met.filter("have = needs").select("conv_id", "call_id", (F.col("depth") + 1).alias("depth"), F.greatest("at", "on_at").alias("at")))
        got = met.filter("have < needs")
        settled.append(fresh)
    solved = reduce(DataFrame.unionByName, settled) if settled else done.limit(0)
    return waits.select("conv_id", "call_id", F.col("at").alias("own")).join(solved, _KEY, "left").select("conv_id", "call_id", "depth", F.coalesce("at", "own").alias("at"))


def link(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Messages with linked tool calls, one row each.

    conv_id, at_turn, at_nth, depth, behind, turn, nth, role, kind ('message',
    'call' or 'result'), call_id, status, errors, json. The columns at_turn to
    nth, in this order, sort a conversation topologically: a call is behind all
    calls it depends on and their results, a result is behind its call, even
    where it came first. status is 'ok', 'unanswered' (call), 'orphan'
    (result), 'duplicate' (call whose id an earlier call has), 'circular' (call
    in or behind a circle of dependencies) or 'invalid' (arguments against
    ``schemas``, or a dependency that isn't there; tools without a schema take
    anything). errors tells what is invalid, row by row.

    Where several calls share an id, results and dependencies link to the
    first; calls that are alike in all are all the first. Null text counts as
    empty, null turns as 0 for the order; null ids link to nothing; rows may
    repeat and are each kept; other columns are not read. A message is one
    row's text, however long. No operation gathers a conversation in one task:
    joins are on (conversation, call id), spread where an id has many rows.
    """
    spark = messages.sparkSession
    schemas = no_schemas(spark) if schemas is None else schemas
    rows = parse_messages(messages)
    zero = F.lit(0).cast("long")
    linked = rows.filter("kind <> 'message'")
    here = F.struct(F.coalesce("turn", zero).alias("turn"), F.col("nth").alias("nth"), F.col("name").alias("name"), F.to_json("args").alias("args"))
    is_call = F.col("kind") == "call"
    ids = linked.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*_KEY).agg(
        F.min(F.when(is_call, F.struct(here.alias("first"), F.col("depends").alias("depends")))).alias("anchor"), F.count(F.when(~is_call, 1)).alias("answers"), F.count(F.lit(1)).alias("n_rows"),
    )
    ids = settle(ids.select("conv_id", "call_id", F.col("anchor.first").alias("anchor"), F.col("anchor.depends").alias("depends"), "answers", "n_rows"))
    place = F.struct(F.col("anchor.turn").alias("turn"), F.col("anchor.nth").alias("nth"))
    depth = depths(ids.filter("anchor IS NOT NULL").select("conv_id", "call_id", place.alias("at"), "depends"))
    known = ids.join(depth.withColumn("waits", F.lit(True)), _KEY, "left")
    lost = _lost(ids)
    known = known.join(lost, _KEY, "left").select(
        "conv_id", "call_id", "anchor", "answers", F.coalesce("lost", F.array().cast("array<string>")).alias("lost"),
        (F.coalesce("waits", F.lit(False)) & F.col("depth").isNull()).alias("circular"), F.coalesce("depth", zero).alias("depth"), F.coalesce("at", place).alias("at"),
    )
    tools = schemas.groupBy("name").agg(F.collect_set(F.struct(F.col("arg"), F.col("type"), F.coalesce("required", F.lit(False)).alias("required"))).cast(SPEC).alias("spec"))
    used = linked.filter(is_call).groupBy("name").agg(F.count(F.lit(1)).alias("n_calls"))
    tools = settle(tools.join(used, "name"))
    joined = join_spread(linked, known, _KEY, hot_keys(ids, _KEY, "n_rows"), ["turn", "nth", "name"], "left")
    joined = join_spread(joined, tools.drop("n_calls"), ["name"], hot_keys(tools, ["name"], "n_calls"), ["conv_id", "turn", "nth"], "left")
    none = F.array().cast("array<string>")
    first = F.col("anchor").isNotNull() & (F.col("anchor") == here)
    errors = F.when(is_call, F.array_sort(F.concat(argument_errors(F.col("args"), F.col("spec")), F.when(first, F.coalesce("lost", none)).otherwise(none)))).otherwise(none)
    joined = joined.withColumn("errors", errors)
    call_status = (
        F.when(F.size("errors") > 0, "invalid").when(F.col("anchor").isNotNull() & ~first, "duplicate").when(first & F.col("circular"), "circular")
        .when(F.coalesce(F.col("answers"), zero) == 0, "unanswered").otherwise("ok")
    )
    result_status = F.when(F.col("anchor").isNull(), "orphan").otherwise("ok")
    bound = F.when(is_call, first).otherwise(F.col("anchor").isNotNull())
    own_turn = F.coalesce("turn", zero)
    args_json = _object(F.transform("args", lambda a: F.struct(a["key"].alias("key"), a["json"].alias("json"))))
    text = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("json"))
    call_parts = F.array(text("arguments", args_json), text("id", _quoted(F.col("call_id"))), text("name", _quoted(F.col("name"))), text("role", _quoted(F.col("role"))))
    deps = F.when(F.size("depends") > 0, F.array(text("depends_on", F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("depends"), _quoted), ","), F.lit("]"))))).otherwise(F.array().cast("array<struct<key:string,json:string>>"))
    role = F.array(text("role", _quoted(F.col("role"))))
    parts = F.when(is_call, F.concat(call_parts, deps)).otherwise(F.concat(F.col("rest"), role, F.array(text("id", _quoted(F.col("call_id"))))))
    cols = ["conv_id", "at_turn", "at_nth", "depth", "behind", "turn", "nth", "role", "kind", "call_id", "status", "errors", "json"]
    tied = joined.select(
        "conv_id", F.when(bound, F.col("at.turn")).otherwise(own_turn).alias("at_turn"), F.when(bound, F.col("at.nth")).otherwise(F.col("nth")).alias("at_nth"),
        F.when(bound, F.col("depth")).otherwise(zero).alias("depth"), F.when(~is_call & bound, 1).otherwise(0).alias("behind"), "turn", "nth", "role", "kind", "call_id",
        F.when(is_call, call_status).otherwise(result_status).alias("status"), "errors", _object(parts).alias("json"),
    )
    plain = rows.filter("kind = 'message'").select(
        "conv_id", own_turn.alias("at_turn"), F.col("nth").alias("at_nth"), zero.alias("depth"), F.lit(0).alias("behind"), "turn", "nth", "role", "kind", "call_id",
        F.lit("ok").alias("status"), none.alias("errors"), _object(F.concat("rest", role)).alias("json"),
    )
    return tied.select(cols).unionByName(plain.select(cols))


def _lost(ids: DataFrame) -> DataFrame:
    """(conv_id, call_id, lost): 'unlinked:id' of dependencies that no call of the conversation has."""
    wanted = ids.filter("anchor IS NOT NULL").select("conv_id", "call_id", F.explode("depends").alias("on"))
    there = ids.filter("anchor IS NOT NULL").select("conv_id", F.col("call_id").alias("on"))
    return wanted.join(there, ["conv_id", "on"], "left_anti").groupBy(*_KEY).agg(F.collect_set(F.concat(F.lit("unlinked:"), "on")).alias("lost"))


def with_tool_calls(conversations: DataFrame) -> DataFrame:
    """``conversations`` and tool traffic made of them: each assistant message makes a call, most calls a result.

    The tables have no tool calls of their own. Ids, arguments, dependencies
    and what is missing or wrong follow from a message's turn and its text's
    number of code points, so that every status occurs and SQL can say the same.
    """
    n, turn = F.length("text"), F.col("turn")
    said = conversations.filter((F.col("role") == "assistant") & F.col("text").isNotNull() & turn.isNotNull())
    call_id = F.when(n % 7 == 0, F.lit("shared")).otherwise(F.concat(F.lit("c"), turn))
    chars = F.when(n % 13 == 0, "").when(n % 5 == 0, F.concat(F.lit('"chars":"'), n, F.lit('",'))).otherwise(F.concat(F.lit('"chars":'), n, F.lit(",")))
    more = F.when(n % 4 == 0, F.lit('"more":[2.50,true],')).otherwise("")
    on = F.when(n % 8 == 3, F.concat(F.lit('"depends_on":["c'), turn - 2, F.lit('"],'))).when(n % 8 == 5, F.concat(F.lit('"depends_on":["c'), turn, F.lit('"],'))).otherwise("")
    call = F.concat(
        F.lit('{"tool_calls":[{'), on, F.lit('"name":"'), F.element_at(F.array(F.lit("measure"), F.lit("count"), F.lit("free")), (n % 3 + 1).cast("int")),
        F.lit('","id":"'), call_id, F.lit('","arguments":{'), chars, more, F.lit('"at":{"turn":'), turn, F.lit(',"conv":'), F.col("conv_id"), F.lit("}}}]}"),
    )
    calls = said.select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    to = F.when(n % 6 == 2, F.concat(F.lit("lost"), turn)).otherwise(call_id)
    result = F.concat(F.lit('{"tool_call_id":"'), to, F.lit('","content":"'), n, F.lit(' code points"}'))
    results = said.filter(n % 6 != 1).select("conv_id", F.when(n % 2 == 0, turn + 1).otherwise(turn - 1).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(calls).unionByName(results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` and the tool traffic made of them, linked and validated."""
    schemas = spark.createDataFrame(
        [("measure", "chars", "integer", True), ("measure", "at", "object", True), ("count", "chars", "number", False), ("count", "at", "object", False), ("count", "more", "array", False)],
        "name string, arg string, type string, required boolean",
    )
    linked = link(with_tool_calls(read_table(spark, sf_dir, "conversations")), schemas)
    return linked.withColumn("errors", F.array_join("errors", ","))


SQL = r"""
WITH RECURSIVE s AS (
  SELECT *, length(text) AS n FROM conversations WHERE role = 'assistant' AND text IS NOT NULL AND turn IS NOT NULL
), c AS (
  SELECT conv_id, turn, n, CASE WHEN n % 7 = 0 THEN 'shared' ELSE 'c' || turn END AS call_id, ['measure', 'count', 'free'][n % 3 + 1] AS name,
    CASE n % 8 WHEN 3 THEN 'c' || (turn - 2) WHEN 5 THEN 'c' || turn END AS dep,
    '{"at":{"conv":' || conv_id || ',"turn":' || turn || '}' || CASE WHEN n % 13 = 0 THEN '' WHEN n % 5 = 0 THEN ',"chars":"' || n || '"' ELSE ',"chars":' || n END || CASE WHEN n % 4 = 0 THEN ',"more":[2.5,true]' ELSE '' END || '}' AS args
  FROM s
), r AS (
  SELECT conv_id, CASE WHEN n % 2 = 0 THEN turn + 1 ELSE turn - 1 END AS turn, n, CASE WHEN n % 6 = 2 THEN 'lost' || turn WHEN n % 7 = 0 THEN 'shared' ELSE 'c' || turn END AS call_id FROM s WHERE n % 6 <> 1
), a AS (
  SELECT conv_id, call_id, min(turn) AS at_turn, first(dep ORDER BY turn) AS dep FROM c GROUP BY 1, 2
), d AS (
  SELECT a.conv_id, a.call_id, a.at_turn, CASE WHEN o.call_id IS NOT NULL THEN a.dep END AS dep, a.dep IS NOT NULL AND o.call_id IS NULL AS unlinked, a.dep AS wanted
  FROM a LEFT JOIN a o ON o.conv_id = a.conv_id AND o.call_id = a.dep
), l AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS depth FROM d WHERE dep IS NULL
  UNION ALL SELECT d.conv_id, d.call_id, l.depth + 1 FROM d JOIN l ON d.conv_id = l.conv_id AND d.dep = l.call_id
), k AS (
  SELECT d.*, coalesce(l.depth, 0) AS depth, l.depth IS NULL AS circular, (SELECT count(*) FROM r WHERE r.conv_id = d.conv_id AND r.call_id = d.call_id) AS answers
  FROM d LEFT JOIN l USING (conv_id, call_id)
), e AS (
  SELECT c.*, k.at_turn, k.depth, k.circular, k.answers, c.turn = k.at_turn AS first,
    list_sort(list_filter([
      CASE WHEN name = 'measure' AND n % 13 = 0 THEN 'missing:chars' END,
      CASE WHEN name <> 'free' AND n % 13 <> 0 AND n % 5 = 0 THEN 'type:chars' END,
      CASE WHEN name = 'measure' AND n % 4 = 0 THEN 'unknown:more' END,
      CASE WHEN c.turn = k.at_turn AND k.unlinked THEN 'unlinked:' || k.wanted END], lambda x: x IS NOT NULL)) AS errors
  FROM c JOIN k USING (conv_id, call_id)
)
SELECT conv_id, CASE WHEN first THEN at_turn ELSE turn END AS at_turn, CAST(1 AS BIGINT) AS at_nth, CASE WHEN first THEN depth ELSE 0 END AS depth, 0 AS behind, turn, CAST(1 AS BIGINT) AS nth, 'assistant' AS role, 'call' AS kind, call_id,
  CASE WHEN len(errors) > 0 THEN 'invalid' WHEN NOT first THEN 'duplicate' WHEN circular THEN 'circular' WHEN answers = 0 THEN 'unanswered' ELSE 'ok' END AS status,
  coalesce(array_to_string(errors, ','), '') AS errors,
  '{"arguments":' || args || CASE WHEN dep IS NOT NULL THEN ',"depends_on":["' || dep || '"]' ELSE '' END || ',"id":"' || call_id || '","name":"' || name || '","role":"assistant"}' AS json
FROM e
UNION ALL
SELECT r.conv_id, coalesce(k.at_turn, r.turn), CASE WHEN k.call_id IS NULL THEN 0 ELSE 1 END, coalesce(k.depth, 0), CASE WHEN k.call_id IS NULL THEN 0 ELSE 1 END, r.turn, 0, 'tool', 'result', r.call_id,
  CASE WHEN k.call_id IS NULL THEN 'orphan' ELSE 'ok' END, '', '{"content":"' || n || ' code points","id":"' || r.call_id || '","role":"tool"}'
FROM r LEFT JOIN k USING (conv_id, call_id)
UNION ALL
SELECT conv_id, coalesce(turn, 0), 0, 0, 0, turn, 0, role, 'message', NULL, 'ok', '', '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}'
FROM conversations
"""
