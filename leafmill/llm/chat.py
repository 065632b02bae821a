"""Chat formatting: tool calls and results linked, ordered, validated and serialised.

Calls and results meet in a hash join on (conv_id, call_id). An order is valid
when every result follows its call and every call follows the calls it depends
on: conversations whose turns already are such an order keep them; only the
others go through rounds that release the calls whose dependencies are done.
Arguments are checked against a JSON-Schema subset, and every event is written
as JSON with sorted keys, no white space, and variant-normalised numbers.

Only DataFrame functions are used. A conversation is never collected: each event
is a row with its ``rank`` in the conversation, so one conversation may hold
any share of the rows. Equal rows are merged, with their number in ``copies``.

Defined results: rows without conv_id or call_id can't be linked (status
``no_identifier``). Of several calls with one id the first by turn, name and
arguments counts, the others are ``duplicate``. Calls without a result are
``unanswered``, results without a call ``orphan``, calls in a ring of
dependencies ``cycle``. A dependency that is no call is an error and no
obstacle. Arguments that are null or no JSON object have the error
``not_object``; a null text is null in the JSON. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut

#: Schema of the calls that ``turns_as_calls`` makes.
REPLY_SCHEMA = {
    "reply": {
        "type": "object",
        "properties": {"conversation": {"type": "integer"}, "text": {"type": "string", "minLength": 1, "maxLength": 20000}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["conversation", "text", "turn"],
        "additionalProperties": False,
    }
}

_CALL = ["conv_id", "call_id", "turn", "name", "arguments", "depends_on"]
_RESULT = ["conv_id", "call_id", "turn", "content"]
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, other messages) of plain dialogues.

    A user turn calls ``reply`` under the id ``conv_id:turn``; the assistant turn
    after it is the result of that id. A call depends on the call two turns before.
    """
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    arguments = F.to_json(F.struct("turn", "text", F.col("conv_id").alias("conversation")))
    depends = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = m.where("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = m.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results, m.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text")


def messages_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, other messages) of messages that carry tool calls as JSON.

    An assistant text ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``
    holds calls; a text of role ``tool`` ``{"tool_call_id", "content"}`` is a result.
    """
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    listed = F.expr("try_variant_get(try_parse_json(text), '$.tool_calls', 'array<variant>')")
    held = m.where("role = 'assistant'").select("conv_id", "turn", F.explode(listed).alias("c"))
    get = lambda path, kind="string": F.expr(f"try_variant_get(c, '$.{path}', '{kind}')")
    calls = held.select(
        "conv_id", get("id").alias("call_id"), "turn", get("name").alias("name"), F.to_json(get("arguments", "variant")).alias("arguments"),
        F.coalesce(get("depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    )
    answer = F.expr("try_parse_json(text)")
    tool = m.where("role = 'tool'").select("conv_id", "turn", answer.alias("c"))
    results = tool.select("conv_id", get("tool_call_id").alias("call_id"), "turn", get("content").alias("content"))
    plain = m.where(F.col("role").isNull() | ((F.col("role") != "tool") & ~((F.col("role") == "assistant") & listed.isNotNull())))
    return calls, results, plain.select("conv_id", "turn", "role", "text")


def _problems(schema: dict, value: Column, variant: str) -> Column:
    """Errors of an arguments object against one schema, as an array of strings, sorted."""
    found: list[Column] = []
    say = lambda test, what: F.when(test, F.lit(what))
    keys = F.expr(f"json_object_keys({value})")
    properties = schema.get("properties", {})
    for name in schema.get("required", []):
        found.append(say(~F.array_contains(keys, name), f"missing:{name}"))
    for name, rule in properties.items():
        path = f"$.{name}"
        kind = F.expr(f"schema_of_variant(try_variant_get({variant}, '{path}', 'variant'))")
        there = F.array_contains(keys, name)
        if rule.get("type") in _TYPES:
            found.append(say(there & (kind != _TYPES[rule["type"]]), f"type:{name}"))
        elif rule.get("type") == "number":
            found.append(say(there & ~kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), f"type:{name}"))
        elif rule.get("type") in ("array", "object"):
            found.append(say(there & ~kind.startswith(rule["type"].upper()), f"type:{name}"))
        number = F.expr(f"try_variant_get({variant}, '{path}', 'double')")
        text = F.expr(f"try_variant_get({variant}, '{path}', 'string')")
        if "minimum" in rule:
            found.append(say(number < rule["minimum"], f"minimum:{name}"))
        if "maximum" in rule:
            found.append(say(number > rule["maximum"], f"maximum:{name}"))
        if "minLength" in rule:
            found.append(say((kind == "STRING") & (F.length(text) < rule["minLength"]), f"minLength:{name}"))
        if "maxLength" in rule:
            found.append(say((kind == "STRING") & (F.length(text) > rule["maxLength"]), f"maxLength:{name}"))
        if "enum" in rule:
            found.append(say(there & ~text.isin([str(v) for v in rule["enum"]]), f"enum:{name}"))
    errors = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(p) for p in properties]) if properties else F.array().cast("array<string>")
        errors = F.concat(errors, F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("extra:"), k)))
    return F.array_sort(errors)


def validate(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with args (variant) and errors (array of strings) of their arguments; unknown names are ``unknown_tool``."""
    parsed = calls.withColumn("args", F.expr("try_parse_json(arguments)"))
    # duplicate keys and anything that isn't an object give null here
    parsed = parsed.withColumn("object", F.when(F.expr("schema_of_variant(args)").startswith("OBJECT"), F.expr("to_json(args)")))
    errors = reduce(
        lambda rest, item: F.when(F.col("name") == item[0], _problems(item[1], "object", "args")).otherwise(rest), schemas.items(), F.array(F.lit("unknown_tool"))
    )
    return parsed.withColumn("errors", F.when(F.col("object").isNull(), F.array(F.lit("not_object"))).otherwise(errors)).drop("object")


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) merged and linked: each with copies and status, calls with their id's first row marked.

    Groups are only ever aggregated with partial sums, and the joins are on the
    identifier, whose hot values Spark can split.
    """
    key = ["conv_id", "call_id"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    merged = calls.select(*_CALL).groupBy(*_CALL).agg(F.count(F.lit(1)).alias("copies"))
    first = merged.where(known).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("first"))
    answers = results.select(*_RESULT).groupBy(*_RESULT).agg(F.count(F.lit(1)).alias("copies"))
    answered = answers.where(known).select(*key).distinct().withColumn("answered", F.lit(True))
    mine = F.struct("turn", "name", "arguments", "depends_on")
    linked = merged.join(first, key, "left").join(answered, key, "left")
    status = F.when(~known, "no_identifier").when(~mine.eqNullSafe(F.col("first")), "duplicate").when(F.col("answered"), "linked").otherwise("unanswered")
    linked = linked.withColumn("status", status).drop("first", "answered")
    found = answers.join(first.select(*key, F.col("first.turn").alias("call_turn")), key, "left")
    status = F.when(~known, "no_identifier").when(F.col("call_turn").isNull(), "orphan").otherwise("linked")
    return linked, found.withColumn("status", status)


def order(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linked calls and results with ``rank``; calls with the dependencies that are no call in ``lost``.

    Where turns are a topological order, rank is the turn. Elsewhere it is the
    round in which a call was released, and a result has the rank of its call.
    """
    live = calls.where("status in ('linked', 'unanswered')").select("conv_id", "call_id", "turn", "depends_on")
    asks = live.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("depends_on")).alias("on"))
    there = live.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = asks.join(there, ["conv_id", "on"], "left")
    lost = edges.where("on_turn is null").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("on")).alias("lost"))
    edges = edges.where("on_turn is not null")
    odd = edges.where("on_turn >= turn").select("conv_id").unionByName(results.where("status = 'linked' and turn <= call_turn").select("conv_id")).distinct()
    odd = cut(odd)
    calls = calls.join(lost, ["conv_id", "call_id"], "left")
    if odd.isEmpty():
        return calls.withColumn("rank", F.col("turn")), results.withColumn("rank", F.col("turn"))
    rest = cut(live.join(odd, "conv_id", "left_semi").select("conv_id", "call_id"))
    waits = cut(edges.join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "on"))
    done, level = None, 0
    while not rest.isEmpty():
        free = cut(rest.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level).cast("long")))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        names = free.select("conv_id", "call_id")
        rest = cut(rest.join(names, ["conv_id", "call_id"], "left_anti"))
        waits = cut(waits.join(names.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_anti").select("conv_id", "call_id", "on"))
        level += 1
    rest = rest.withColumn("level", F.lit(None).cast("long"))
    ranks = (rest if done is None else done.unionByName(rest)).withColumn("odd", F.lit(True))
    calls = calls.join(ranks, ["conv_id", "call_id"], "left")
    ring = F.coalesce("odd", F.lit(False)) & F.col("level").isNull() & F.col("status").isin("linked", "unanswered")
    calls = calls.withColumn("status", F.when(ring, "cycle").otherwise(F.col("status"))).withColumn("rank", F.when(F.col("odd"), F.col("level")).otherwise(F.col("turn"))).drop("odd", "level")
    results = results.join(ranks, ["conv_id", "call_id"], "left").withColumn("rank", F.when(F.col("odd"), F.col("level")).otherwise(F.col("turn"))).drop("odd", "level")
    return calls, results


def format_chats(calls: DataFrame, results: DataFrame, others: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, rank, kind, call_id, status, errors, copies, json): one row per distinct event.

    In a conversation, (rank, kind, turn) is the order of the events.
    """
    linked, answers = order(*link(calls, results))
    said = F.concat("errors", F.transform(F.coalesce("lost", F.array().cast("array<string>")), lambda d: F.concat(F.lit("dependency:"), d)))
    keep = {"ignoreNullFields": "false"}
    call_rows = validate(linked, schemas).select(
        "conv_id", "turn", "rank", F.lit("call").alias("kind"), "call_id", "status", F.array_join(said, ",").alias("errors"), "copies",
        F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type")), keep).alias("json"),
    )
    none = F.lit("")
    result_rows = answers.select(
        "conv_id", "turn", "rank", F.lit("result").alias("kind"), "call_id", "status", none.alias("errors"), "copies",
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")), keep).alias("json"),
    )
    plain = others.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).select(
        "conv_id", "turn", F.col("turn").alias("rank"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"), none.alias("errors"), "copies",
        F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("message").alias("type")), keep).alias("json"),
    )
    return call_rows.unionByName(result_rows).unionByName(plain)
