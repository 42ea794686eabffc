"""Chat formatting: tool calls linked with their results, checked and written as canonical JSON.

A turn's text may be a JSON object:

* system: {"tools": [{"name", "parameters": {"required": [...], "properties": {name: {"type"}}}}]}
* assistant: {"tool_calls": [{"id", "name", "arguments": {...}, "after": [ids]}]}; "after" names calls
  that must come first
* tool: {"tool_call_id", "content"}

Everything else is a plain message. Calls and results meet in a hash join on (conversation, id). Events
get order columns instead of a position: a conversation may hold a large part of all rows, so it is
never gathered in one task, and what is joined by conversation is salted. The level of a call is the
length of the longest chain of "after" that leads to it; a call comes no earlier than the latest turn on
such a chain. Both are found by repeated joins in which edges are shortened: an edge from a call that waits
for one other call alone goes on to that one, so a chain of n calls takes some log2(n) / 2 rounds. Calls that
wait for several others are settled once these are. What never settles leads into a circle. There is no limit on depth.
A result has the place of its call and comes right behind it.

All of it is DataFrame operations. Canonical JSON has sorted keys and no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import durable

SALTS = 16
LAST = (1 << 63) - 1

CALL = "array<struct<id:string,name:string,arguments:variant,after:array<string>>>"
TOOL = "array<struct<name:string,parameters:struct<required:array<string>,properties:map<string,struct<type:string>>>>>"


def canonical(value: Column) -> Column:
    """A variant as JSON with sorted keys and without spaces (objects keep their keys sorted)."""
    return F.to_json(value)


def quoted(text: Column) -> Column:
    return canonical(F.to_variant_object(F.array(text))).substr(F.lit(2), F.length(canonical(F.to_variant_object(F.array(text)))) - 2)


def kind_of(value: Column) -> Column:
    """The JSON type of a variant."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "STRING", "string").when(schema == "BIGINT", "integer").when(schema == "BOOLEAN", "boolean").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").when(schema == "VOID", "null").otherwise("number")
    )


def problems(arguments: Column, parameters: Column) -> Column:
    """The first thing wrong with arguments under a tool's parameters, null if nothing is."""
    given = F.when(kind_of(arguments) == "object", arguments.cast("map<string,variant>"))
    required, properties = F.coalesce(parameters["required"], F.array().cast("array<string>")), parameters["properties"]
    missing = F.exists(required, lambda name: ~F.map_contains_key(given, name))
    fits = lambda name, value: properties[name]["type"].isNull() | (properties[name]["type"] == kind_of(value)) | ((properties[name]["type"] == "number") & (kind_of(value) == "integer"))
    wrong = F.size(F.map_filter(given, lambda name, value: ~F.coalesce(fits(name, value), F.lit(True)))) > 0
    unknown = properties.isNotNull() & (F.size(F.map_filter(given, lambda name, value: ~F.map_contains_key(properties, name))) > 0)
    return F.when(given.isNull(), "arguments_not_an_object").when(missing, "missing_argument").when(unknown, "unknown_argument").when(wrong, "wrong_type")


def shortened(edges: DataFrame) -> DataFrame:
    """Edges (ck, id, needs, steps, late, moved) of which those from a call with one edge alone go on to where that one leads.

    Of edges between the same calls the longest stays, with the latest turn on any. moved: whether an edge went on.
    """
    alone = edges.groupBy("ck", "id").agg(F.count("*").alias("n"), F.first("needs").alias("on"), F.first("steps").alias("more"), F.first("late").alias("later"))
    alone = alone.filter("n = 1").select("ck", F.col("id").alias("needs"), "on", "more", "later")
    met = edges.join(alone, ["ck", "needs"], "left")
    to = F.coalesce("on", "needs").alias("needs")
    return met.groupBy("ck", "id", to).agg(F.max(F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.max(F.greatest("late", "later")).alias("late"), F.max(F.col("moved") | F.col("on").isNotNull()).alias("moved"))


def call_levels(calls: DataFrame) -> DataFrame:
    """ck (the conversation), id, level and ready (the turn from which it may stand) of calls (ck, id, turn, after) with ids.

    level and ready are null where "after" leads into a circle.
    """
    edges = calls.select("ck", "id", F.explode("after").alias("needs")).distinct()
    at_once = calls.select("ck", "id", F.lit(0).cast("long").alias("level"), F.col("turn").alias("ready"))
    if edges.isEmpty():
        return at_once
    # an id that no call has does not hold anything up; late is the latest turn on the way without its end
    edges = edges.join(calls.select("ck", F.col("id").alias("needs")), ["ck", "needs"], "left_semi").join(calls.select("ck", "id", F.col("turn").alias("late")), ["ck", "id"])
    edges = durable(edges.select("ck", "id", "needs", F.lit(1).cast("long").alias("steps"), "late", F.lit(False).alias("moved")))
    n = edges.count()
    known = durable(at_once.join(edges.select("ck", "id").distinct(), ["ck", "id"], "left_anti"))
    while True:
        ends = known.select("ck", F.col("id").alias("needs"), F.lit(True).alias("met"), F.col("level").alias("before"), F.col("ready").alias("from"))
        sums = edges.join(ends, ["ck", "needs"], "left").groupBy("ck", "id").agg(
            F.max(F.col("before") + F.col("steps")).alias("level"), F.max(F.greatest("late", "from")).alias("ready"),
            F.max(F.col("met").isNull()).alias("open"), F.max(F.coalesce("met", F.lit(False)) & F.col("before").isNull()).alias("round"),
        )
        fits = lambda c: F.when(~F.col("round"), F.col(c)).alias(c)
        settled = durable(sums.filter(~F.col("open") | F.col("round")).select("ck", "id", fits("level"), fits("ready")))
        any_settled = not settled.isEmpty()
        left = edges.join(settled, ["ck", "id"], "left_anti").withColumn("moved", F.lit(False))
        after = durable(shortened(shortened(left)))
        # an edge of more steps than there are edges has gone round; so has one that ends where it began
        round_ = durable(after.filter((F.col("id") == F.col("needs")) | (F.col("steps") > n)).select("ck", "id", F.lit(None).cast("long").alias("level"), F.lit(None).cast("long").alias("ready")).distinct())
        known = durable(known.union(settled).union(round_))
        if after.isEmpty() or not (any_settled or not round_.isEmpty() or not after.filter("moved").isEmpty()):
            return known  # what is left waits for a circle of calls that wait for several
        edges = after.join(round_, ["ck", "id"], "left_anti")


def by_conversation(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join with rows that are few for a conversation: these are repeated for each salt, as one conversation may hold much of left."""
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, [*on, "salt"], "left").drop("salt")


def format_chats(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per event: conv_id, turn, call_index, role, kind, status, order_turn, order_level, order_call, order_part, json.

    kind: message, tools, call or result. Sorting by the order columns, then turn, puts each call
    behind those it must follow, of later turns too, and each linked result behind its call; calls in a circle, or behind
    one, come last in their turn. status is ok or the first of:
    missing_id, duplicate_id (a later call with an id; the first, by turn, index and content, counts), circular,
    unknown_tool, the problem with the arguments, unanswered; for results missing_id, no_call, early (of an earlier turn than its
    call: not an answer), duplicate_result (the first, by turn and content, counts). Texts and conversations of any length are taken whole. Tools are known when the conversation declares any; without a declaration arguments are only held to
    be objects. Of several declarations of a tool the first counts. Null texts are empty messages,
    null roles read ''. A null conversation or turn is a value of its own. Rows that repeat are all kept. An
    empty table gives no rows; other columns are ignored.
    """
    base = conversations.select(conversations[conv_column].cast("long").alias("conv_id"), conversations[turn_column].cast("long").alias("turn"), F.coalesce(conversations[role_column].cast("string"), F.lit("")).alias("role"), F.coalesce(conversations[text_column].cast("string"), F.lit("")).alias("text"))
    parsed = base.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))

    def part(path: str, type_: str) -> Column:
        return F.try_variant_get("v", path, type_)

    calls_in = F.when(F.col("role") == "assistant", part("$.tool_calls", CALL))
    tools_in = F.when(F.col("role") == "system", part("$.tools", TOOL))
    result_id = F.when(F.col("role") == "tool", part("$.tool_call_id", "string"))
    is_result = (F.col("role") == "tool") & F.col("v").isNotNull()
    events = parsed.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("ck"), calls_in.alias("calls"), tools_in.alias("tools"), result_id.alias("result_id"), is_result.alias("is_result"))

    text_json = quoted(F.col("text"))
    message = events.filter(F.col("calls").isNull() & ~F.col("is_result")).select(
        "conv_id", "turn", F.lit(None).cast("int").alias("call_index"), "role", F.when(F.col("tools").isNotNull(), "tools").otherwise("message").alias("kind"), F.lit("ok").alias("status"),
        F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"), F.lit(-1).alias("order_call"), F.lit(0).alias("order_part"),
        F.concat(F.lit('{"content":'), F.when(F.col("tools").isNotNull(), canonical(F.col("v"))).otherwise(text_json), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")).alias("json"),
    )
    calls = events.filter("calls is not null").select("ck", "conv_id", "turn", "role", F.posexplode("calls").alias("call_index", "c")).select("ck", "conv_id", "turn", "role", "call_index", "c.id", "c.name", "c.arguments", "c.after")
    calls = calls.withColumn("own", F.xxhash64("conv_id", "turn", "call_index", "id", "name", F.to_json("arguments")))
    results = events.filter("is_result").select("ck", "conv_id", "turn", "role", F.col("result_id").alias("id"), canonical(part("$.content", "variant")).alias("content"))
    results = results.withColumn("own", F.xxhash64("conv_id", "turn", "id", "content"))
    declared = events.filter("tools is not null").select("ck", "turn", F.posexplode("tools").alias("at", "t"))
    tools = declared.groupBy("ck", F.col("t.name").alias("name")).agg(F.min_by(F.col("t.parameters"), F.struct("turn", "at")).alias("parameters"), F.lit(True).alias("known"))
    with_tools = declared.select("ck").distinct().withColumn("declares", F.lit(True))

    place = F.struct("turn", "call_index", "own")
    heads = calls.filter("id is not null").groupBy("ck", "id").agg(F.min(place).alias("head"), F.min_by("after", place).alias("after"))
    levels = call_levels(heads.select("ck", "id", F.col("head.turn").alias("turn"), "after"))
    placed = heads.drop("after").join(levels, ["ck", "id"], "left")
    met = results.join(placed, ["ck", "id"], "left").withColumn("linked", F.col("head").isNotNull() & F.coalesce(F.col("turn") >= F.col("head.turn"), F.lit(True)))
    answers = met.filter("linked").groupBy("ck", "id").agg(F.min(F.struct("turn", "own")).alias("answer"))
    linked = calls.join(placed.join(answers, ["ck", "id"], "left"), ["ck", "id"], "left")
    linked = by_conversation(by_conversation(linked, tools, ["ck", "name"]), with_tools, ["ck"])
    status = (
        F.when(F.col("id").isNull(), "missing_id").when(F.col("own") != F.col("head.own"), "duplicate_id").when(F.col("level").isNull(), "circular").when(F.col("declares") & F.col("known").isNull(), "unknown_tool")
        .otherwise(F.coalesce(problems(F.coalesce("arguments", F.parse_json(F.lit("null"))), F.col("parameters")), F.when(F.col("answer").isNull(), "unanswered"), F.lit("ok")))
    )
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"role":"assistant","type":"call"}'))
    in_order = F.col("id").isNull() | F.col("level").isNotNull()
    where = lambda turn: [F.coalesce("ready", turn).alias("order_turn"), F.when(in_order, F.coalesce("level", F.lit(0))).otherwise(LAST).cast("long").alias("order_level")]
    call_rows = linked.select("conv_id", "turn", F.col("call_index").cast("int"), "role", F.lit("call").alias("kind"), status.alias("status"), *where("turn"), F.col("call_index").cast("int").alias("order_call"), F.lit(0).alias("order_part"), call_json.alias("json"))
    met = met.join(answers, ["ck", "id"], "left")
    result_status = F.when(F.col("id").isNull(), "missing_id").when(F.col("head").isNull(), "no_call").when(~F.col("linked"), "early").when(F.col("own") != F.col("answer.own"), "duplicate_result").otherwise("ok")
    result_json = F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"role":"tool","type":"result"}'))
    on_call = F.col("linked")
    turn, level = where("head.turn")
    result_rows = met.select("conv_id", "turn", F.when(on_call, F.col("head.call_index")).cast("int").alias("call_index"), "role", F.lit("result").alias("kind"), result_status.alias("status"), F.when(on_call, turn).otherwise(F.col("turn")).alias("order_turn"), F.when(on_call, level).otherwise(0).alias("order_level"), F.when(on_call, F.col("head.call_index")).otherwise(-1).cast("int").alias("order_call"), F.when(on_call, 1).otherwise(0).alias("order_part"), result_json.alias("json"))
    return message.unionByName(call_rows).unionByName(result_rows)
