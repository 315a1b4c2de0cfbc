"""Chat formatting: tool calls and results linked by identifier, ordered, validated and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameter -> (JSON type, required), for each tool.
Schemas = dict[str, dict[str, tuple[str, bool]]]

#: The catalogue used where none is given.
TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
#: How the engine names the type of a JSON value.
_TYPES = {
    "string": "STRING", "integer": r"(BIGINT|DECIMAL\(\d+,0\))", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*",
    "object": "OBJECT.*",
}
RESULT_COLUMNS = ["kind", "order_turn", "order_depth", "n_calls", "n_valid_calls", "n_unanswered", "linked", "errors", "message_json"]
_FIELDS = "map<string,variant>"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _whole_numbers(json: Column) -> Column:
    masked = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))  # output has no raw control characters
    outside = F.transform(F.split(masked, '"'), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"(\d)\.0(?!\d)", "$1")).otherwise(x))
    return F.replace(F.replace(F.array_join(outside, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def canonical(json: Column) -> Column:
    """JSON text without spaces, with keys in the order of their UTF-16 units at every depth; null if it isn't JSON.

    Whole numbers have no fraction, however they were written; those that are written with an exponent keep one from ten
    million on. Text in which an object has a key twice isn't JSON here.
    """
    return _let(F.to_json(F.try_parse_json(json)), lambda x: F.when(x.contains(".0"), _whole_numbers(x)).otherwise(x))


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _object(entries: Column) -> Column:
    """JSON text from an array of `"key":value` texts; null entries are left out."""
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def _fields(value: Column, without: list[Column]) -> Column:
    """The `"key":value` texts of an object's fields but for some."""
    entries = F.filter(F.map_entries(value.try_cast(_FIELDS)), lambda e: ~e["key"].isin(*without))
    return F.coalesce(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.to_json(e["value"]))), F.array().cast("array<string>"))


def _check(parameter: str, kind: str, required: bool):
    """What is wrong with a parameter whose JSON type is x; null if nothing."""
    def check(x: Column) -> Column:
        lacking = F.when(F.lit(required) & (x.isNull() | (x == "VOID")), F.lit(f"missing {parameter}"))
        return lacking.when((x != "VOID") & ~x.rlike(f"^{_TYPES[kind]}$"), F.lit(f"{parameter} is not of type {kind}"))

    return check


def _problems(name: Column, value: Column, schemas: Schemas) -> Column:
    """The ways in which a call breaks its schema, as an array of strings; value: its arguments."""
    none = F.array().cast("array<string>")
    known = F.coalesce(name.isin(list(schemas)), F.lit(False))
    checks = [F.when(~known, F.array(F.lit("unknown tool"))).otherwise(none)]
    for tool, parameters in schemas.items():
        own = []
        for p, (kind, required) in parameters.items():
            found = F.schema_of_variant(F.try_variant_get(value, f'$["{p}"]', "variant"))
            own.append(_let(found, _check(p, kind, required)))
        given = F.map_keys(value.try_cast(_FIELDS))
        extra = _let(F.array_except(given, F.array(*[F.lit(p) for p in parameters]).cast("array<string>")), lambda x: F.when(F.size(x) > 0, F.concat(F.lit("unexpected "), F.array_join(F.array_sort(x), ","))))
        checks.append(F.when(name == tool, F.array_compact(F.array(*own, extra))).otherwise(none))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    otherwise = F.concat(checks[0], F.array(F.lit("arguments are not an object")))
    return F.when(is_object, F.concat(*checks)).otherwise(otherwise)


def _calls(value: Column, schemas: Schemas) -> Column:
    """The calls of a message: id, problems and canonical JSON, every field of theirs kept."""
    def call(c: Column) -> Column:
        given = F.try_variant_get(c, "$.arguments", "variant")
        text = _let(given, lambda g: F.when(F.schema_of_variant(g) == "STRING", F.try_variant_get(g, "$", "string")).otherwise(F.to_json(g)))
        text = _let(text, lambda t: F.coalesce(canonical(t), t))
        name = F.try_variant_get(c, "$.name", "string")
        return _let(
            F.struct(text.alias("text"), name.alias("name")),
            lambda x: F.struct(
                F.try_variant_get(c, "$.id", "string").alias("id"), _let(F.try_parse_json(x["text"]), lambda v: _problems(x["name"], v, schemas)).alias("problems"),
                _object(F.concat(_fields(c, [F.lit("arguments")]), F.array(F.concat(F.lit('"arguments":'), _quoted(x["text"]))))).alias("json"),
            ),
        )

    return F.transform(F.try_variant_get(value, "$.tool_calls", "array<variant>"), call)


def link(messages: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message of (conv_id, turn, role, text, ...) with its place, its links and its canonical JSON.

    A message whose text is a JSON object, white space around it aside, with ``tool_calls`` makes calls; one with
    ``tool_call_id`` is a result; any other is plain. Calls and results meet in a hash join on (conversation,
    identifier); a linked result follows its call directly, in the order of the calls, wherever it stood: (order_turn,
    order_depth, turn) sorts a conversation topologically. Rows stay one per message, so that no conversation, however
    long, is gathered in one task. Only tool messages are shuffled.

    An identifier that is used again belongs to each of its calls in turn: a result answers the last such call before
    it, or else the first. A second answer to a call is linked and reported in ``errors``, as are results without a
    call and calls that break their schema; ``n_unanswered`` counts a message's calls without an answer. All fields of
    calls and messages stay in ``message_json`` (see ``canonical``), the role column's value before a field's.

    Null conversations or identifiers link nothing and aren't counted as unanswered; null text has null content and a
    null role is left out of the JSON; repeated messages stay repeated, each a call or answer in its own right, equal
    calls being one. Very long texts are read whole within their row. Extra columns stay, whatever their names; those
    named like a result column give way to it. No rows give no rows.
    """
    schemas = TOOLS if schemas is None else schemas
    given = messages.drop(*RESULT_COLUMNS)
    # from here on all columns of the caller are within one, so that no name of theirs meets one of ours
    messages = given.select(F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("m"), F.col("conv_id").alias("conv"), F.col("turn").alias("at"))
    value = F.when(F.col("m.text").rlike(r"^\s*\{"), F.try_parse_json("m.text"))
    read = messages.withColumn("v", value)
    answered = F.try_variant_get("v", "$.tool_call_id", "string")
    asked = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    read = read.withColumn("kind", F.when(F.size(asked) > 0, "call").when(answered.isNotNull(), "result").otherwise("message"))
    none = F.array().cast("array<string>")

    plain = read.where("kind = 'message'").select("m", F.struct("kind", F.col("at").alias("order_turn"), F.lit(0).alias("order_depth"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid_calls"), F.lit(0).cast("long").alias("n_unanswered"), F.lit(False).alias("linked"),
        none.alias("errors"), F.to_json(F.struct(F.col("m.text").alias("content"), F.col("m.role").alias("role"))).alias("message_json")).alias("r"))

    role = F.when(F.col("m.role").isNotNull(), F.concat(F.lit('"role":'), _quoted(F.col("m.role"))))
    instead = [F.lit("tool_calls"), F.when(F.col("m.role").isNotNull(), F.lit("role")).otherwise(F.lit("tool_calls"))]

    # each call answers for the turns from its own to that of the next call with its identifier
    calls = read.where("kind = 'call' and conv is not null").select("conv", "at", F.posexplode(F.transform(asked, lambda c: F.try_variant_get(c, "$.id", "string"))).alias("place", "id"))
    calls = calls.select("conv", "id", F.col("at").alias("turn"), "place").where("id is not null").distinct()
    same = Window.partitionBy("conv", "id").orderBy("turn", "place")
    spans = calls.withColumns({"after": F.when(F.row_number().over(same) > 1, F.col("turn")), "until": F.lead("turn").over(same)})
    spans = spans.select(F.col("conv").alias("s_conv"), F.col("id").alias("s_id"), F.struct("turn", "place").alias("owner"), "after", "until")
    within = (F.col("after").isNull() | (F.col("at") > F.col("after"))) & (F.col("until").isNull() | (F.col("at") <= F.col("until")))
    to_span = (F.col("conv") == F.col("s_conv")) & (F.col("id") == F.col("s_id")) & within

    results = read.where("kind = 'result'").select("m", "conv", "at", "kind", answered.alias("id"), "v")
    ids = results.where("conv is not null").select("conv", "at", "id").join(spans.hint("shuffle_hash"), to_span)
    met = ids.groupBy("conv", "owner").agg(F.min("at").alias("first"))
    done = met.groupBy(F.col("conv").alias("a_conv"), F.col("owner.turn").alias("a_turn")).agg(F.count("*").alias("n_answered"))
    met = met.select(F.col("conv").alias("a_conv"), F.col("owner").alias("a_owner"), "first")
    # null conversations take no part in the joins, where they would meet in one task
    unlinked = results.where("conv is null").withColumns({"owner": F.lit(None).cast("struct<turn:bigint,place:int>"), "first": F.lit(None).cast("bigint")})
    results = results.where("conv is not null").join(spans.hint("shuffle_hash"), to_span, "left")
    results = results.join(met.hint("shuffle_hash"), (F.col("conv") == F.col("a_conv")) & (F.col("owner") == F.col("a_owner")), "left")
    results = results.select("m", "at", "kind", "id", "v", "owner", "first").unionByName(unlinked.drop("conv"))
    found = F.col("owner").isNotNull()
    late = F.when(~found, F.concat("id", F.lit(": no such call"))).when(F.col("at") > F.col("first"), F.concat("id", F.lit(": answered before")))
    results = results.select("m", F.struct("kind", F.when(found, F.col("owner.turn")).otherwise(F.col("at")).alias("order_turn"), F.when(found, F.col("owner.place") + 1).otherwise(0).alias("order_depth"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid_calls"), F.lit(0).cast("long").alias("n_unanswered"), found.alias("linked"),
        F.array_compact(F.array(late)).alias("errors"), canonical(_object(F.concat(_fields(F.col("v"), instead), F.array_compact(F.array(role))))).alias("message_json")).alias("r"))

    asks = read.where("kind = 'call'").withColumn("calls", _calls(F.col("v"), schemas))
    unasked = asks.where("conv is null").withColumn("n_answered", F.lit(None).cast("bigint"))
    asks = asks.where("conv is not null").join(done.hint("shuffle_hash"), (F.col("conv") == F.col("a_conv")) & (F.col("at") == F.col("a_turn")), "left")
    asks = asks.drop("a_conv", "a_turn").unionByName(unasked)
    wrong = F.flatten(F.transform("calls", lambda c: F.transform(c["problems"], lambda p: F.concat(F.coalesce(c["id"], F.lit("?")), F.lit(": "), p))))
    waiting = F.when(F.col("conv").isNotNull(), F.size(F.filter("calls", lambda c: c["id"].isNotNull())) - F.coalesce("n_answered", F.lit(0))).otherwise(0)
    spoken = F.concat(F.lit('"tool_calls":['), F.array_join(F.transform("calls", lambda c: c["json"]), ","), F.lit("]"))
    asks = asks.select("m", F.struct("kind", F.col("at").alias("order_turn"), F.lit(0).alias("order_depth"),
        F.size("calls").alias("n_calls"), F.size(F.filter("calls", lambda c: F.size(c["problems"]) == 0)).alias("n_valid_calls"), waiting.cast("long").alias("n_unanswered"),
        F.lit(False).alias("linked"), wrong.alias("errors"), canonical(_object(F.concat(_fields(F.col("v"), instead), F.array_compact(F.array(role, spoken))))).alias("message_json")).alias("r"))
    return plain.unionByName(results).unionByName(asks).select("m.*", "r.*")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations of (conv_id, turn, role, text) as tool use: every user turn calls a tool, every assistant turn answers the turn before it.

    Identifiers repeat every four turns. The tool follows the turn, the arguments the text; some break their schema, and
    where no user turn comes before, the answer has no call. Other roles stay as they are; ``text`` is replaced.
    """
    name = F.element_at(F.array(F.lit("search"), F.lit("calculator"), F.lit("lookup")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    length = F.length("text")
    search = F.to_json(F.struct(F.col("text").alias("query"), F.when(length % 2 == 0, length.cast("string").cast("long")).alias("limit")))
    vague = F.to_json(F.struct(F.col("text").alias("query"), F.when(length % 2 == 1, F.lit("all")).alias("limit")))
    compute = F.to_json(F.struct(F.col("text").alias("expression"), F.when(length % 5 == 0, F.lit(True)).alias("precise")))
    arguments = F.when(name == "calculator", compute).when((name == "search") & (length % 2 == 1), vague).otherwise(search)
    call = F.struct(F.struct(F.concat(F.lit("c"), F.pmod("turn", F.lit(4))).alias("id"), name.alias("name"), arguments.alias("arguments")).alias("call"))
    calls = F.to_json(F.struct(F.col("text").alias("content"), F.array(call["call"]).alias("tool_calls")))
    answer = F.to_json(F.struct(F.concat(F.lit("c"), F.pmod(F.col("turn") - 1, F.lit(4))).alias("tool_call_id"), F.col("text").alias("content")))
    return conversations.withColumn("text", F.when(F.col("role") == "user", calls).when(F.col("role") == "assistant", answer).otherwise(F.col("text")))
