"""Operator 3 [native]: chat formatting with linked tool calls.

Messages become events: calls, results and plain messages.  Calls and results are hash-joined by conversation and identifier; calls
are ordered topologically by what they depend on; arguments are validated against the tool's schema; every event
is serialised as canonical JSON (keys sorted at every depth, no blanks).  One row an event, so that a
conversation of any length is never gathered in one place; (level, turn, place) is an order in which each call stands
after the results it needs and before its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, load, pick

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: The tool that a plain user turn calls: its fields, their types and whether they are required.
REPLY = [("reply", "prompt", "STRING", True)]
SCHEMA = "name string, field string, type string, required boolean"


def events(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) to conv_id, turn, role, place, kind, id, name, arguments, needs, content.

    A message whose text is {"tool_calls": [{id, name, arguments, depends_on}]} gives a call for each; one of role tool
    whose text is {"tool_call_id", "content"} gives a result.  Of the others a user turn is a call of the tool `reply`,
    identified by conversation and turn, and an assistant turn is the result of the turn before it.
    """
    braced = F.trim("text").startswith("{")
    m = messages.select("conv_id", "turn", "role", "text", F.when(braced, F.from_json("text", CALLS)["tool_calls"]).alias("calls"), F.when(braced & (F.col("role") == "tool"), F.from_json("text", RESULT)).alias("result"))
    own = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    none = F.lit(None).cast("string")

    def event(kind: str, id_: Column, name: Column, arguments: Column, needs: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), name.alias("name"), arguments.alias("arguments"), needs.alias("needs"), content.alias("content"))

    no_needs = F.array().cast("array<string>")
    explicit = F.transform("calls", lambda c: event("call", c["id"], c["name"], c["arguments"], F.coalesce(c["depends_on"], no_needs), none))
    result = F.array(event("result", F.col("result.tool_call_id"), none, none, no_needs, F.col("result.content")))
    prompt = F.array(event("call", F.when(whole, own), F.lit("reply"), F.to_json(F.struct(F.col("text").alias("prompt"))), no_needs, none))
    answer = F.array(event("result", F.when(whole, before), none, none, no_needs, F.col("text")))
    plain = F.array(event("message", none, none, none, no_needs, F.col("text")))
    kind = F.when(F.size(F.coalesce("calls", F.array())) > 0, explicit).when(F.col("result.tool_call_id").isNotNull(), result).when(F.col("role") == "user", prompt).when(F.col("role") == "assistant", answer).otherwise(plain)
    return m.select("conv_id", "turn", "role", F.posexplode(kind).alias("place", "e")).select("conv_id", "turn", "role", "place", "e.*")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level: 0 without needs, else one more than the largest level needed; calls of a cycle are missing.

    calls: conv_id, id, needs (ids unique in a conversation).  A need that is no call of the conversation is ignored.
    A round for each level, over the needs that are still open only; each round's calls are cut once and read once.
    """
    key = ["conv_id", "id"]
    bound = calls.where("size(needs) > 0")
    if bound.isEmpty():
        return calls.select(*key, F.lit(0).alias("level"))
    open_ = bound.select(*key, F.explode(F.array_distinct("needs")).alias("need"))
    open_ = cut(open_.join(calls.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi").select(*key, "need"), "needs")
    done = ready = cut(calls.select(*key).join(open_.select(*key), key, "left_anti").select(*key, F.lit(0).alias("level")), "levels")
    level = 0
    while not ready.isEmpty():
        level += 1
        left = cut(open_.join(ready.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_anti").select(*key, "need"), "needs")
        # what was open before and isn't any more has its last need in the round before
        ready = cut(open_.select(*key).distinct().join(left.select(*key), key, "left_anti").select(*key, F.lit(level).alias("level")), "levels")
        drop(open_)
        open_, done = left, done.union(ready)
    return done


def problems(schemas: DataFrame) -> DataFrame:
    """name, fields: the schema of each tool as an array, small by nature: a row a tool."""
    return schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))


def _errors(value: Column, fields: Column) -> Column:
    """What is wrong with the arguments: missing, of another type or unknown fields, comma-joined, in order."""
    given = F.try_variant_get(value, "$", "map<string,variant>")
    kind = lambda f: F.regexp_replace(F.schema_of_variant(F.element_at(given, f["field"])), r"[<(].*$", "")
    has = lambda f: F.map_contains_key(given, f["field"])
    checks = F.transform(fields, lambda f: F.when(~has(f) & f["required"], F.concat(F.lit("missing "), f["field"])).when(has(f) & (kind(f) != f["type"]), F.concat(F.lit("type of "), f["field"])))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(given), F.transform(fields, lambda f: f["field"]))), lambda k: F.concat(F.lit("unknown "), k))
    return F.when(value.isNull(), F.lit("not JSON")).when(given.isNull(), F.lit("not an object")).when(fields.isNull(), F.lit("unknown tool")).otherwise(F.array_join(F.filter(F.concat(checks, unknown), lambda x: x.isNotNull()), ","))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, role, place, kind, call_id, linked, level, errors, json: a row for each event of the messages.

    Identifiers are those of one conversation: call_1 of another one is another call.  Of calls with one identifier
    (repeated rows) the first by turn and place is the one that results link to; results of unknown calls, null
    identifiers or conversations and calls without result are not linked.  level is twice the call's topological level,
    plus one for results; null for plain messages, unlinked results and cycles.  Null text is JSON null; an empty table gives an
    empty one; other columns aren't read; a text of any length is one row throughout.  The first calls are made unique with
    partial sums before the join, so that an identifier that many rows share meets one row; rows without an identifier
    aren't dealt out at all.
    """
    key = ["conv_id", "id"]
    whole = "conv_id is not null and id is not null"
    e = cut(events(messages), "events")
    first = e.where("kind = 'call'").where(whole).groupBy(*key).agg(F.min(F.struct("turn", "place", "needs")).alias("m")).select(*key, F.col("m.needs").alias("needs"))
    first = cut(first, "calls")
    level = first.join(levels(first), key, "left").select(*key, F.lit(True).alias("has_call"), "level")
    answered = e.where("kind = 'result'").where(whole).groupBy(*key).agg(F.lit(True).alias("has_result"))
    ids = cut(level.join(answered, key, "left").select(*key, "has_call", "level", "has_result"), "links")
    alone = e.where(~F.coalesce(F.expr(whole), F.lit(False)))
    linked = e.where(whole).join(ids, key, "left").unionByName(alone, allowMissingColumns=True).join(problems(schemas), "name", "left")
    value = F.try_parse_json("arguments")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    level = F.when(is_call, F.col("level") * 2).when(is_result, F.col("level") * 2 + 1)
    call = F.to_json(F.struct(value.alias("arguments"), F.col("id"), F.col("name"), F.lit("call").alias("type")), {"ignoreNullFields": "false"})
    result = F.to_json(F.struct(F.col("id").alias("call_id"), F.col("content"), F.lit("result").alias("type")), {"ignoreNullFields": "false"})
    plain = F.to_json(F.struct(F.col("content"), F.col("role"), F.lit("message").alias("type")), {"ignoreNullFields": "false"})
    return linked.select(
        "conv_id",
        "turn",
        "role",
        "place",
        "kind",
        F.col("id").alias("call_id"),
        F.coalesce(F.when(is_call, F.col("has_result")).when(is_result, F.col("has_call")), F.lit(False)).alias("linked"),
        level.alias("level"),
        F.when(is_call, _errors(value, F.col("fields"))).alias("errors"),
        F.when(is_call, call).when(is_result, result).otherwise(plain).alias("json"),
    )


def op3_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of conversations, linked, ordered, validated and serialised."""
    messages = pick(load(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    return link(messages, spark.createDataFrame(REPLY, SCHEMA))


#: For tables whose texts hold no explicit tool calls, as the given ones.
OP3_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations
)
SELECT conv_id, turn, role, 0 AS place, kind, call_id,
       CASE kind WHEN 'call' THEN call_id IN (SELECT call_id FROM m WHERE kind = 'result')
                 WHEN 'result' THEN call_id IN (SELECT call_id FROM m WHERE kind = 'call') ELSE false END AS linked,
       CASE WHEN kind = 'call' THEN 0 WHEN kind = 'result' AND call_id IN (SELECT call_id FROM m WHERE kind = 'call') THEN 1 END AS level,
       CASE kind WHEN 'call' THEN '' END AS errors,
       CASE kind WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(text) || '},"id":' || to_json(call_id) || ',"name":"reply","type":"call"}'
                 WHEN 'result' THEN '{"call_id":' || to_json(call_id) || ',"content":' || to_json(text) || ',"type":"result"}'
                 ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' END AS json
FROM m
"""
