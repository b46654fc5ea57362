"""Chat formatting: tool calls linked to their results, ordered, validated and
written as canonical JSON.  DataFrame functions only.

Calls and results are joined by conversation and call identifier.  Repeated rows of
an identifier are folded before the join (the earliest counts, ``n_calls`` and
``n_results`` tell how many there were), so no key can multiply.  A call's level is
one more than that of the highest call that it depends on; levels come in rounds, each
written to the shared folder, whose number grows with the logarithm of a chain's
length.  Sorting by level, turn and identifier is a topological
order, so no conversation has to be gathered in one place.

Canonical JSON: no blanks, object keys sorted, nulls written out.

Defined results (column ``errors``, sorted): ``no call``: a result whose call is not
there; ``no result``; ``missing dependency``; ``cycle`` (the level is null then);
``unknown tool``; ``arguments are not an object``; ``missing NAME``, ``NAME is not
TYPE`` and ``unexpected NAME`` for the tool's schema.  Rows with a null conversation
or identifier can't be linked: they are kept, one row each, with the error ``no
identifier``.  Null and empty texts are results like any other.  Other columns are
dropped, so clashing names cannot occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import written

KEY = ["conv_id", "call_id"]
#: JSON schema type -> what Spark calls such a value in a variant.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def embedded_calls(messages: DataFrame) -> DataFrame:
    """Calls in assistants' texts of the form ``{"tool_calls": [{"id", "name",
    "arguments", "after"}]}``."""
    held = F.from_json("text", f"struct<tool_calls:{CALLS}>")["tool_calls"]
    rows = messages.filter("role = 'assistant' and text like '%tool_calls%'").select("conv_id", "turn", F.explode(held).alias("c"))
    return rows.select("conv_id", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), "turn", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))


def embedded_results(messages: DataFrame) -> DataFrame:
    """Results in texts of role ``tool``: ``{"tool_call_id", "content"}``."""
    held = F.from_json("text", "struct<tool_call_id:string,content:string>")
    return messages.filter("role = 'tool'").select("conv_id", held["tool_call_id"].alias("call_id"), held["content"].alias("content"), "turn")


def _problems(schemas: dict[str, dict]) -> Column:
    """Array of errors of a call's arguments."""
    value = F.try_parse_json("arguments")
    keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    of_tool = []
    for tool, schema in schemas.items():
        fields = schema["fields"]
        tests = []
        for name, kind in fields.items():
            if name in schema.get("required", fields):
                tests.append(F.when(~F.array_contains(keys, name), F.lit(f"missing {name}")))
            held = F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant"))
            tests.append(F.when(F.array_contains(keys, name) & ~F.coalesce(held.rlike(f"^{TYPES[kind]}$"), F.lit(False)), F.lit(f"{name} is not {kind}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unexpected "), k))
        of_tool.append((F.col("name") == tool, F.concat(F.array_compact(F.array(*tests)), extra)))
    first, *rest = of_tool
    chain = reduce(lambda out, x: out.when(*x), rest, F.when(*first)).otherwise(F.array(F.lit("unknown tool")))
    return F.when(~is_object, F.array(F.lit("arguments are not an object"))).otherwise(chain)


def levels(calls: DataFrame) -> DataFrame:
    """Key and ``after`` of distinct calls -> key, ``level`` (null in a cycle or
    behind one), ``lacks`` (a dependency is not there).

    In a round every edge to a settled call turns into a number, and every edge to a
    call with one dependency alone is moved on to that one: chains halve each round."""
    wanted = calls.select(*KEY, F.explode(F.array_distinct("after")).alias("dep"))
    there = calls.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("there"))
    edges = wanted.join(there, ["conv_id", "dep"], "left")
    lacking = edges.filter("there is null").select(*KEY).distinct().withColumn("lacks", F.lit(True))
    # level = the largest base (number) or level of dep and far
    left = written(edges.filter("there").select(*KEY, "dep", F.lit(1).alias("far"), F.lit(None).cast("int").alias("base")), "chat-edges")
    settled = written(calls.select(*KEY).join(left, KEY, "left_anti").withColumn("level", F.lit(0)), "chat-levels")
    idle, remaining = 0, left.count()
    # a chain of n calls is through after log2(n) rounds; what moves no more is a cycle
    while remaining and idle <= remaining.bit_length() + 1:
        done = settled.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("own"))
        alone = left.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("dep").alias("next"), F.min("far").alias("step")).filter("n = 1 and next is not null")
        alone = alone.select("conv_id", F.col("call_id").alias("dep"), "next", "step")
        open_edges = left.filter("dep is not null").join(done, ["conv_id", "dep"], "left").join(alone, ["conv_id", "dep"], "left")
        moved = open_edges.select(
            *KEY,
            F.when(F.col("own").isNull(), F.coalesce("next", "dep")).alias("dep"),
            (F.col("far") + F.when(F.col("own").isNull(), F.coalesce("step", F.lit(0))).otherwise(0)).alias("far"),
            (F.col("own") + F.col("far")).alias("base"),
        )
        now = written(moved.unionByName(left.filter("dep is null")), "chat-edges")
        ready = now.groupBy(*KEY).agg(F.count("dep").alias("n"), F.max("base").alias("level")).filter("n = 0").select(*KEY, "level")
        settled = written(settled.unionByName(ready), "chat-levels")
        left = written(now.join(settled, KEY, "left_anti"), "chat-edges")
        before, remaining = remaining, left.count()
        idle = idle + 1 if remaining == before else 0
    return calls.select(*KEY).join(settled, KEY, "left").join(lacking, KEY, "left")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls``: conv_id, call_id, name, arguments (JSON), turn, after (array of call
    ids); ``results``: conv_id, call_id, content, turn; ``schemas``: tool ->
    ``{"fields": {name: type}, "required": [name]}``.

    -> conv_id, call_id, turn, level, n_calls, n_results, errors, json: a row for
    every identifier of either side."""
    keyed = "conv_id is not null and call_id is not null"
    first_call = F.min(F.struct("turn", "name", "arguments", "after"))
    once = written(calls.filter(keyed).groupBy(*KEY).agg(first_call.alias("c"), F.count("*").alias("n_calls")), "chat-calls")
    answers = results.filter(keyed).groupBy(*KEY).agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r"), F.count("*").alias("n_results"))
    ordered = levels(once.select(*KEY, "c.after"))
    joined = once.join(ordered, KEY).join(answers, KEY, "full")
    rows = joined.select(*KEY, "c.*", "r.*", "level", "lacks", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_calls", "n_results")))
    errors = F.when(F.col("n_calls") == 0, F.array(F.lit("no call"))).otherwise(
        F.concat(
            F.array_compact(F.array(F.when(F.col("n_results") == 0, F.lit("no result")), F.when(F.col("lacks"), F.lit("missing dependency")), F.when(F.col("level").isNull(), F.lit("cycle")))),
            _problems(schemas),
        )
    )
    linked = rows.withColumn("errors", F.sort_array(errors))
    lost = [df.filter(f"not ({keyed})").select(*KEY, "turn", F.lit(None).cast("int").alias("level"), F.lit(n).cast("long").alias("n_calls"), F.lit(1 - n).cast("long").alias("n_results"), F.array(F.lit("no identifier")).alias("errors"), *(c.alias(a) for a, c in kept.items())) for df, n, kept in ((calls, 1, {"name": F.col("name"), "arguments": F.col("arguments"), "content": F.lit(None).cast("string")}), (results, 0, {"name": F.lit(None).cast("string"), "arguments": F.lit(None).cast("string"), "content": F.col("content")}))]
    shown = linked.select(*KEY, F.coalesce("turn", "result_turn").alias("turn"), "level", "n_calls", "n_results", "errors", "name", "arguments", "content")
    every = reduce(DataFrame.unionByName, [shown, *lost])
    # a variant's object keys are sorted; text that is no JSON stays a string
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.substring(F.to_json(F.struct(F.col("arguments").alias("x")), {"ignoreNullFields": "false"}), 6, 1 << 30))
    whole = F.to_json(F.struct("call_id", F.col("content").alias("content"), "errors", "level", "name"), {"ignoreNullFields": "false"})
    arguments = F.when(F.try_parse_json("arguments").isNotNull() | F.col("arguments").isNull(), F.coalesce(canonical, F.lit("null"))).otherwise(F.regexp_replace(canonical, r"\}$", ""))
    json = F.concat(F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), F.lit("null")).otherwise(arguments), F.lit(","), F.substring(whole, 2, 1 << 30))
    return every.select("conv_id", "call_id", "turn", "level", "n_calls", "n_results", F.array_join("errors", "; ").alias("errors"), json.alias("json"))


#: The tool that stands for a reply to a user: what :func:`turns_as_calls` calls.
REPLY = {"reply": {"fields": {"text": "string", "turn": "integer"}, "required": ["text", "turn"]}}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user's turn as a call of the tool ``reply``, answered by the assistant's
    next turn, depending on the call two turns before; and those answers."""

    def name(turn: Column) -> Column:
        return F.concat(F.lit("turn-"), turn.cast("string"))

    turn = F.col("turn")
    asked = messages.filter("role = 'user'")
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    before = asked.select("conv_id", (turn + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
    calls = asked.join(before, ["conv_id", "turn"], "left")
    after = F.when(F.col("follows"), F.array(name(turn - 2))).otherwise(F.array().cast("array<string>"))
    calls = calls.select("conv_id", name(turn).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), "turn", after.alias("after"))
    results = messages.filter("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"), "turn")
    return calls, results


def format_conversations(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Calls in the texts and turns as calls, linked."""
    calls, results = turns_as_calls(messages)
    plain = embedded_calls(messages).select(*calls.columns)
    return link_tool_calls(calls.unionByName(plain), results.unionByName(embedded_results(messages)), REPLY | (schemas or {}))
