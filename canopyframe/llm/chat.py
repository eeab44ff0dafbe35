"""Chat formatting with linked tool calls.

A message's text is plain content or a JSON object with any of ``content``,
``tools`` (declarations ``name``, ``parameters``), ``tool_calls`` (``id``, ``name``,
``arguments``) and ``tool_call_id`` (the call that a tool message answers). Calls
and results meet in hash joins by conversation and id; results are ordered behind
their calls, and calls behind the results that their arguments quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.runtime import cut_lineage

_CALL = "struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>"
_SHAPE = (f"struct<content:string,tool_call_id:string,tool_calls:array<{_CALL}>,"
          "tools:array<struct<name:string,parameters:string,function:struct<name:string,parameters:string>>>>")
#: Text in arguments that quotes the result of another call.
_QUOTE = r'"\$ref"\s*:\s*"([^"]+)"'
#: JSON schema types and the types of parsed values that fit them. Fixed values.
_FITS = {"string": r"^STRING", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": r"^BOOLEAN",
         "array": r"^ARRAY", "object": r"^OBJECT", "null": r"^VOID"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


#: Keywords that are checked, and those that only describe. Fixed values of the JSON schema format.
CHECKED = ("type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems",
           "required", "properties", "additionalProperties", "items")
DESCRIBING = ("title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment")
_MAP, _LIST, _NODE = "map<string,variant>", "array<variant>", "array<struct<path:string,value:variant,schema:variant>>"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _as(v: Column, kind: str, to: str) -> Column:
    """A variant of a kind as a Spark type, else null."""
    return F.when(_kind(v).startswith(kind), v.cast(to))


def _node_problems(path: Column, value: Column, schema: Column) -> Column:
    """What is wrong with one value under the keywords of its own schema node."""
    rules, shape = _as(schema, "OBJECT", _MAP), _kind(value)
    rule = lambda name: F.try_element_at(rules, F.lit(name))
    fields, items = _as(value, "OBJECT", _MAP), _as(value, "ARRAY", _LIST)
    said = lambda name, bad: F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit(name + ":"), path))
    number = F.when(shape.rlike(_FITS["number"]), value.cast("double"))
    length, count = F.char_length(_as(value, "STRING", "string")), F.size(items)
    limit = lambda name: F.when(_kind(rule(name)).rlike(_FITS["number"]), rule(name).cast("double"))
    named = F.coalesce(F.when(_kind(rule("type")) == "STRING", F.array(rule("type").cast("string"))),
                       F.transform(_as(rule("type"), "ARRAY", _LIST), lambda t: t.cast("string")))

    def fits(t: Column) -> Column:
        out = F.lit(False)
        for name, pattern in _FITS.items():
            out = F.when(t == name, shape.rlike(pattern)).otherwise(out)
        return out

    odd_types = F.array_except(F.coalesce(named, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in _FITS]))
    text = F.to_json(value)
    wanted = F.transform(_as(rule("required"), "ARRAY", _LIST), lambda k: k.cast("string"))
    inner = lambda k: F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit("."))), k)
    none = F.array().cast("array<string>")
    missing = F.transform(F.when(fields.isNotNull(), F.array_except(wanted, F.map_keys(fields))), lambda k: F.concat(F.lit("missing:"), inner(k)))
    known = F.coalesce(F.map_keys(_as(rule("properties"), "OBJECT", _MAP)), none)
    closed = F.when(_kind(rule("additionalProperties")) == "BOOLEAN", ~rule("additionalProperties").cast("boolean"))
    unknown = F.transform(F.when(closed & fields.isNotNull(), F.array_except(F.map_keys(fields), known)), lambda k: F.concat(F.lit("unknown:"), inner(k)))
    unread = F.transform(F.array_except(F.coalesce(F.map_keys(rules), none), F.array(*[F.lit(k) for k in (*CHECKED, *DESCRIBING)])),
                         lambda k: F.concat(F.lit("unsupported:"), inner(k)))
    single = F.array(
        said("not_allowed", (_kind(schema) == "BOOLEAN") & ~schema.cast("boolean")),
        said("type", named.isNotNull() & (F.size(odd_types) == 0) & ~F.exists(named, fits)), said("unsupported_type", F.size(odd_types) > 0),
        said("enum", ~F.exists(_as(rule("enum"), "ARRAY", _LIST), lambda e: F.to_json(e) == text)), said("const", rule("const").isNotNull() & (F.to_json(rule("const")) != text)),
        said("minimum", number < limit("minimum")), said("maximum", number > limit("maximum")),
        said("exclusiveMinimum", number <= limit("exclusiveMinimum")), said("exclusiveMaximum", number >= limit("exclusiveMaximum")),
        said("minLength", length < limit("minLength")), said("maxLength", length > limit("maxLength")),
        said("minItems", count < limit("minItems")), said("maxItems", count > limit("maxItems")))
    return F.concat(F.coalesce(missing, none), F.coalesce(unknown, none), F.filter(single, lambda p: p.isNotNull()), unread)


def _children(path: Column, value: Column, schema: Column) -> Column:
    """The values inside one value, each with its own schema node; those without a schema are left out."""
    rules = _as(schema, "OBJECT", _MAP)
    rule = lambda name: F.try_element_at(rules, F.lit(name))
    named, other = _as(rule("properties"), "OBJECT", _MAP), F.when(_kind(rule("additionalProperties")).startswith("OBJECT"), rule("additionalProperties"))
    inside = F.transform(F.map_entries(_as(value, "OBJECT", _MAP)), lambda e: F.struct(
        F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit("."))), e["key"]).alias("path"), e["value"].alias("value"),
        F.coalesce(F.try_element_at(named, e["key"]), other).alias("schema")))
    listed = F.transform(_as(value, "ARRAY", _LIST), lambda v, i: F.struct(
        F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("value"), rule("items").alias("schema")))
    none = F.array().cast(_NODE)
    return F.filter(F.concat(F.coalesce(inside, none), F.coalesce(listed, none)), lambda n: n["schema"].isNotNull())


def _argument_problems(calls: DataFrame) -> DataFrame:
    """``conv_id, turn, at, bad``: what is wrong with the arguments of calls of declared tools.

    Arguments and schema are walked together, one level of nesting a round; each value is a row.
    """
    keys = ["conv_id", "turn", "at"]
    given = F.try_parse_json("arguments")
    rows = calls.where("known").select(*keys, given.alias("value"), F.try_parse_json("schema").alias("schema"))
    objects = F.coalesce(_kind(F.col("value")).startswith("OBJECT"), F.lit(False))
    found = rows.where(~objects).select(*keys, F.lit("not_an_object").alias("bad"))
    nodes = cut_lineage(rows.where(objects & F.col("schema").isNotNull()).select(*keys, F.lit("").alias("path"), "value", "schema"))
    while nodes.take(1):
        node = (F.col("path"), F.col("value"), F.col("schema"))
        found = found.unionByName(nodes.select(*keys, F.explode(_node_problems(*node)).alias("bad")))
        nodes = cut_lineage(nodes.select(*keys, F.explode(_children(*node)).alias("n")).select(*keys, "n.*"))
    found = found.unionByName(calls.where(~F.coalesce("known", F.lit(False))).select(*keys, F.lit("unknown_tool").alias("bad")))
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list("bad")).alias("bad"))


def _levels(calls: DataFrame) -> DataFrame:
    """``conv_id, id, level``: 0 without quotes, else one above the quoted calls; null for calls in or behind a cycle.

    Each round settles the calls whose quoted calls are settled and ends when none is;
    the number of rounds is the depth of the quotes, 0 where nothing is quoted.
    """
    quotes = calls.select("conv_id", "id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(_QUOTE), 1))).alias("needs"))
    ids = calls.select("conv_id", F.col("id").alias("needs"))
    needs = cut_lineage(quotes.join(ids, ["conv_id", "needs"], "left_semi"))
    level = cut_lineage(calls.select("conv_id", "id").join(needs, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)))
    while needs.take(1):
        met = needs.join(level.withColumnRenamed("id", "needs"), ["conv_id", "needs"], "left")
        ready = met.groupBy("conv_id", "id").agg(F.count("level").alias("have"), F.count(F.lit(1)).alias("want"), F.max("level").alias("top"))
        new = cut_lineage(ready.where(F.col("have") == F.col("want")).select("conv_id", "id", (F.col("top") + 1).alias("level")))
        if not new.take(1):
            break
        needs = cut_lineage(needs.join(new, ["conv_id", "id"], "left_anti"))
        level = cut_lineage(level.unionByName(new))
    return level


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, position, message, problems`` and counts.

    ``message`` is canonical JSON. ``position`` (turn, level, call, own turn) sorts a
    conversation: a result comes right after its call whatever its own turn, a call
    after the results it quotes. Messages stay single rows, so a conversation of any
    length is never held by one task. Of several calls with one id the first in turn
    and place is linked and later ones are reported; a result without a call, a call
    without a result, a call of an undeclared tool, arguments that break the schema and
    quotes in a circle are reported, never dropped. Null text is empty content, null
    role is ``user``, null conv_id or turn are values of their own. Text that only looks
    like JSON is content. No rows give none.

    Arguments are checked against the declared schema on every level: the keywords in CHECKED,
    with types as names or lists. A keyword that is neither among them nor describes
    only is reported as ``unsupported`` (a ``pattern`` too: one that isn't a regular
    expression would end the job).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parsed = F.when(text.startswith("{"), F.from_json(text, _SHAPE))
    is_doc = F.coalesce(parsed["tool_calls"].isNotNull() | parsed["tools"].isNotNull() | parsed["tool_call_id"].isNotNull(), F.lit(False))
    # null keys get a stand-in for the joins
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00null"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = messages.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), conv.alias("conv_id"), turn.alias("turn"),
                           F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"), F.when(is_doc, parsed).alias("doc"))
    tool_rows = rows.where(F.col("doc").isNotNull())
    declared = (tool_rows.select("conv_id", "turn", F.explode("doc.tools").alias("t"))
                .select("conv_id", "turn", F.coalesce("t.name", "t.function.name").alias("name"), F.coalesce("t.parameters", "t.function.parameters").alias("schema"))
                .groupBy("conv_id", "name").agg(F.min_by("schema", F.struct("turn", "schema")).alias("schema"), F.lit(True).alias("known")))
    calls = tool_rows.select("conv_id", "turn", F.posexplode("doc.tool_calls").alias("at", "c")).select(
        "conv_id", "turn", "at", F.coalesce("c.id", F.lit("")).alias("id"), F.coalesce("c.name", "c.function.name").alias("name"),
        F.coalesce("c.arguments", "c.function.arguments").alias("arguments"))
    calls = cut_lineage(calls.join(declared, ["conv_id", "name"], "left"))
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "at")).alias("f"), F.min_by("arguments", F.struct("turn", "at")).alias("arguments"))
    level = _levels(first.select("conv_id", "id", "arguments"))
    first = cut_lineage(first.join(level, ["conv_id", "id"], "left").select("conv_id", "id", F.col("f.turn").alias("c_turn"), F.col("f.at").alias("c_at"), "level"))
    results = tool_rows.where(F.col("doc.tool_call_id").isNotNull()).select("conv_id", F.col("doc.tool_call_id").alias("id"))
    answered = results.distinct().withColumn("answered", F.lit(True))
    checked = (calls.join(first, ["conv_id", "id"]).join(answered, ["conv_id", "id"], "left")
               .join(_argument_problems(calls), ["conv_id", "turn", "at"], "left")
               .withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
               .withColumn("bad", F.concat(
                   "bad", F.when((F.col("turn") != F.col("c_turn")) | (F.col("at") != F.col("c_at")), F.array(F.lit("repeated_id"))).otherwise(F.array().cast("array<string>")),
                   F.when(F.col("answered").isNull(), F.array(F.lit("no_result"))).otherwise(F.array().cast("array<string>")),
                   F.when(F.col("level").isNull(), F.array(F.lit("circle"))).otherwise(F.array().cast("array<string>")))))
    # calls of one message: bounded by the message's own text
    per_message = checked.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct("at", "id", "bad"))).alias("calls"), F.max("level").alias("m_level"))
    joined = (rows.join(per_message, ["conv_id", "turn"], "left")
              .withColumn("id", F.col("doc.tool_call_id")).join(first.select("conv_id", "id", "c_turn", "c_at", F.col("level").alias("c_level")), ["conv_id", "id"], "left"))
    linked = F.col("c_turn").isNotNull()
    body = F.transform("doc.tool_calls", lambda c: F.struct(
        F.try_parse_json(F.coalesce(c["arguments"], c["function"]["arguments"], F.lit("null"))).alias("arguments"),
        F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(c["name"], c["function"]["name"]).alias("name")))
    tools = F.transform("doc.tools", lambda t: F.struct(
        F.coalesce(t["name"], t["function"]["name"]).alias("name"), F.try_parse_json(F.coalesce(t["parameters"], t["function"]["parameters"])).alias("parameters")))
    content = F.when(F.col("doc").isNull(), F.col("text")).otherwise(F.coalesce("doc.content", F.lit("")))
    message = F.to_json(F.struct(content.alias("content"), "role", F.col("doc.tool_call_id").alias("tool_call_id"), body.alias("tool_calls"), tools.alias("tools")))
    bad = F.concat(F.coalesce(F.flatten(F.transform("calls", lambda c: F.transform(c["bad"], lambda b: F.concat(c["id"], F.lit(":"), b)))), F.array().cast("array<string>")),
                   F.when(F.col("id").isNotNull() & ~linked, F.array(F.concat("id", F.lit(":no_call")))).otherwise(F.array().cast("array<string>")))
    position = F.struct(F.coalesce("c_turn", "turn").alias("turn"), F.coalesce("c_level", "m_level", F.lit(0)).cast("long").alias("level"),
                        F.coalesce(F.col("c_at") + 1, F.lit(0)).cast("long").alias("call"), F.col("turn").alias("own"))
    return joined.select(F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn"), "role", position.alias("position"), message.alias("message"),
                         F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"), linked.alias("linked"), bad.alias("problems"))


def op4_chat_format(messages: DataFrame) -> DataFrame:
    rows = format_chat(messages)
    return rows.select("conv_id", "turn", "role", F.to_json("position").alias("position"), "message", "n_calls", "linked",
                       F.array_join("problems", ",").alias("problems"))
