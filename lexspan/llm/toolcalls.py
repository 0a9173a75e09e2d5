"""Chat formatting with linked tool calls, in DataFrame functions only.

Calls and results meet in an equi-join on their identifier (which shuffles by its hash), calls are put in topological
order of the results they wait for, arguments are validated against the tool's schema, and every call becomes one
canonical JSON text: keys in alphabetical order, no blanks, members without a value left out.

A call waits for at most one earlier call, so waiting calls form trees. Their depth comes from pointer jumping: every
round doubles the distance that a call looks up, so that the rounds grow with the logarithm of the longest chain.

Defined results: a call without a result is `unanswered`, one with several results takes the smallest text and is
`ambiguous`; a result without a call is an `orphan`; calls that wait for each other in a ring, or for one in a ring,
have no order and are a `cycle`; repeated identifiers of calls are one call, with the smallest content; null identifiers
never link and such rows are orphans (results) or unanswered (calls); empty tables give no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.columns import bind
from lexspan.functions.scale import written


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per call identifier or orphan result.

    calls(call_id, name, arguments, waits_for); results(call_id, content). Adds `content`, `n_results`, `status`.
    """
    one_call = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("name", "arguments", "waits_for")).alias("call"))
    loose = calls.where("call_id is null").select("call_id", F.struct("name", "arguments", "waits_for").alias("call"))
    one_result = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    strays = results.where("call_id is null").select("call_id", F.lit(None).cast(one_call.schema["call"].dataType).alias("call"), "content", F.lit(1).cast("long").alias("n_results"))
    joined = one_call.join(one_result, "call_id", "full")
    every = joined.unionByName(loose, allowMissingColumns=True).unionByName(strays)
    status = (
        F.when(F.col("call").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered")
        .when(F.col("n_results") > 1, "ambiguous").otherwise("linked")
    )
    return every.select("call_id", "call.name", "call.arguments", "call.waits_for", "content", F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"))


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth): 0 for a call that waits for none that exists, null for calls on or behind a ring."""
    named = calls.where("call_id is not null").select("call_id", "waits_for").distinct()
    there = named.select(F.col("call_id").alias("waits_for"), F.lit(1).alias("known"))
    start = named.join(there, "waits_for", "left").select(
        "call_id", F.when(F.col("known") == 1, F.col("waits_for")).alias("up"), F.when(F.col("known") == 1, 1).otherwise(0).cast("long").alias("depth")
    )
    now = written(start, "depths")
    open_before = None
    while True:
        still = now.where("up is not null").count()
        if still == 0 or still == open_before:
            return now.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        jumped = now.join(above, "up", "left").select(
            "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        now, open_before = written(jumped, "depths"), still


# What a member of each kind may be, by its type in JSON: a number without a fraction is an integer, also beyond 64 bits.
KINDS = {
    "string": "^STRING$", "filled": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT",
}


def broken_rules(name: Column, arguments: Column, tools: dict[str, dict[str, str]]) -> Column:
    """The rules that a call's arguments (a JSON text) break, as one comma-joined string; empty when valid.

    `tools` maps a tool to its members and their kinds, which `KINDS` lists; `filled` is a string that is not blank. Values are
    judged by their type: a number in quotes is no integer, and an array with a string no string. A kind with `?` behind it
    belongs to a member that may be missing or null. Members that the schema does not know are broken rules as well; an object
    that has a member twice is no object.
    """
    members = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    return bind(members, lambda m: F.concat_ws(",", *_rules(name, m, tools)))


def _rules(name: Column, members: Column, tools: dict[str, dict[str, str]]) -> list[Column]:
    rules = [F.when(members.isNull(), F.lit("not an object")), F.when(~F.coalesce(name, F.lit("")).isin(*tools), F.lit("unknown tool"))]
    for tool, schema in sorted(tools.items()):
        here = (name == F.lit(tool)) & members.isNotNull()
        for member, given in sorted(schema.items()):
            kind, value = given.rstrip("?"), F.element_at(members, member)
            told = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            wrong = ~told.rlike(KINDS[kind])
            if kind == "filled":
                wrong = wrong | (F.trim(F.try_variant_get(value, "$", "string")) == "")
            if given.endswith("?"):
                wrong = wrong & (told != "VOID")
            rules.append(F.when(here & wrong, F.lit(f"{tool}.{member}: {kind}")))
        extra = F.size(F.array_except(F.map_keys(members), F.array(*[F.lit(m) for m in sorted(schema)]).cast("array<string>")))
        rules.append(F.when(here & (extra > 0), F.lit(f"{tool}: unknown member")))
    return rules


def formatted(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, str]]) -> DataFrame:
    """Linked calls with `depth` (their topological order), `errors` and canonical `json`."""
    rows = linked(calls, results)
    ordered = rows.join(depths(rows.where("status <> 'orphan'")), "call_id", "left")
    status = F.when((F.col("status") != "orphan") & F.col("call_id").isNotNull() & F.col("depth").isNull(), "cycle").otherwise(F.col("status"))
    errors = F.when(F.col("status") != "orphan", broken_rules(F.col("name"), F.col("arguments"), tools))
    ordered = ordered.withColumns({"status": status, "errors": errors})
    # A parsed object keeps its members in alphabetical order; a text that is no JSON stays away.
    parsed = F.try_parse_json("arguments").alias("arguments")
    json = F.to_json(F.struct(parsed, "call_id", "content", "errors", "name", "status", "waits_for"))
    return ordered.withColumn("json", json)


# How a plain conversation maps to calls and results: a prompt asks the tool `reply`, which the next turn answers.
TOOLS = {"reply": {"conversation": "integer", "prompt": "filled", "turn": "integer"}}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text).

    A user's turn t is the call `conv_id:t`; it waits for the call of turn t - 2. An assistant's turn t answers the
    call `conv_id:(t - 1)`. Other roles neither call nor answer. No window over a conversation is needed.
    """
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.col("conv_id").alias("conversation"), F.col("text").alias("prompt"), "turn"))
    calls = conversations.where("role = 'user'").select(name(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), name(2).alias("waits_for"))
    results = conversations.where("role = 'assistant'").select(name(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
