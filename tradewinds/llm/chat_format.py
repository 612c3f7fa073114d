"""Tool-call linking and canonical chat JSON, in DataFrame functions only.

Results are joined to calls by the identifier of the call, in shuffled hash joins. Calls are put in topological order: turns follow each other,
and within a turn a call stands after those it waits for, by rounds that level all calls whose predecessors are
levelled. A call that waits for itself by a circle, for a call that does not exist or for a later turn can't be
ordered; it stands last in its turn and says so. Arguments are parsed and checked against the schema of the tool, which
is a parameter, and every row is written as JSON with sorted keys and no white space.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewinds.llm.components import checkpointed

_KINDS = {
    "string": "string",
    "integer": "bigint",
    "number": "bigint|decimal.*|double|float",
    "boolean": "boolean",
    "array": "array<.*",
    "object": "object<.*",
}
CALL_COLUMNS = ("conv_id", "turn", "call_id", "name", "arguments", "after")
RESULT_COLUMNS = ("conv_id", "turn", "call_id", "content")


@dataclass(frozen=True)
class Parameter:
    """What a schema asks of one argument; the limits are those of a number's value or a string's length."""

    kind: str
    required: bool = False
    least: int | None = None
    most: int | None = None


Schemas = dict[str, dict[str, Parameter]]


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _parameter_errors(parsed: Column, name: str, p: Parameter) -> list[Column]:
    given = F.try_variant_get(parsed, _path(name), "variant")
    kind = F.lower(F.schema_of_variant(given))
    right = kind.rlike(f"^({_KINDS[p.kind]})$")
    found = [F.when(given.isNotNull() & ~right, F.lit(f"{name}: not {p.kind}"))]
    if p.required:
        found.append(F.when(given.isNull(), F.lit(f"{name}: missing")))
    measure = F.length(F.try_variant_get(parsed, _path(name), "string")) if p.kind == "string" else F.try_variant_get(parsed, _path(name), "double")
    if p.least is not None:
        found.append(F.when(right & (measure < p.least), F.lit(f"{name}: below {p.least}")))
    if p.most is not None:
        found.append(F.when(right & (measure > p.most), F.lit(f"{name}: above {p.most}")))
    return found


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """The sorted list of what is wrong with the JSON ``arguments`` of a call of tool ``name``; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    canonical = F.to_json(parsed)
    no_object = parsed.isNull() | ~F.coalesce(canonical.startswith("{"), F.lit(False))
    errors = F.array(F.lit("tool: unknown"))
    for tool, parameters in schemas.items():
        found = [e for p in parameters.items() for e in _parameter_errors(parsed, *p)]
        known = F.array(*[F.lit(p) for p in parameters]) if parameters else F.array().cast("array<string>")
        extra = F.transform(F.array_except(F.json_object_keys(canonical), known), lambda k: F.concat(k, F.lit(": unknown")))
        own = F.array_sort(F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), extra))
        errors = F.when(name == tool, own).otherwise(errors)
    return F.when(no_object, F.array(F.lit("arguments: no JSON object"))).otherwise(errors)


def _hashed(right: DataFrame) -> DataFrame:
    """The side of a join that a hash table is built from, in each shuffled partition."""
    return right.hint("shuffle_hash")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, _level) of all calls that can be ordered within their turn; from 0.

    A round takes the calls whose last open predecessors were levelled in the round before, so a call's level is the
    round it is taken in. Only what still waits goes into the next round, and what is done is written once.
    """
    key = ["conv_id", "turn", "call_id"]
    waits = calls.select(*key, F.explode(F.array_distinct("after")).alias("_dep"))
    ids = calls.select("conv_id", F.col("call_id").alias("_dep"), F.col("turn").alias("_dep_turn"))
    edges = checkpointed(
        waits.join(_hashed(ids), ["conv_id", "_dep"], "left")
        .filter(F.col("_dep_turn").isNull() | (F.col("_dep_turn") >= F.col("turn")))
        .select(*key, "_dep", (F.col("_dep_turn") == F.col("turn")).alias("_same"))
    )
    # what waits for a missing call or a later turn is never ready
    waiting = edges.groupBy(*key).agg(F.bool_and(F.coalesce("_same", F.lit(False))).alias("_may"))
    first = checkpointed(calls.select(*key).join(_hashed(waiting), key, "left_anti").withColumn("_level", F.lit(0)))
    left = edges.join(_hashed(waiting.filter("_may").select(*key)), key, "left_semi").select(*key, "_dep")
    done, taken = [first], first
    while True:
        before = taken.select("conv_id", "turn", F.col("call_id").alias("_dep"), F.lit(True).alias("_met"))
        left = checkpointed(left.join(_hashed(before), ["conv_id", "turn", "_dep"], "left").select(*key, "_dep", "_met"))
        ready = left.groupBy(*key).agg(F.count("_met").alias("_n"), F.count("*").alias("_of")).filter("_n = _of")
        taken = checkpointed(ready.select(*key, F.lit(len(done)).alias("_level")))
        if taken.isEmpty():
            return reduce(DataFrame.union, done)
        done.append(taken)
        left = left.filter("_met is null").drop("_met")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Link, order, check and write tool calls.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON) and after (ids of calls it waits for); ``results`` has
    conv_id, turn, call_id and content. Other columns are ignored. One row for each call id of a conversation and one
    for each id of results without a call: conv_id, turn, place (from 1 within the turn; calls first), kind (call or
    result), call_id, status, errors, valid and json. Repeated rows count once; of calls or results with one id but
    different content the smallest by turn and content stands and the status says so: answered, unanswered, orphan,
    each with " twice" if several contents were given. Rows without a conversation or call id are left out, as nothing
    can refer to them; a missing turn counts as -1, a missing list of calls to wait for as empty. Arguments that are null
    or no JSON object are an error and written as null. Empty tables give no rows.
    """
    calls = calls.select(
        "conv_id", F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), "call_id", "name", "arguments",
        F.filter(F.coalesce("after", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("after"),
    ).filter("conv_id is not null and call_id is not null")
    results = results.select("conv_id", F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), "call_id", "content").filter(
        "conv_id is not null and call_id is not null"
    )
    key = ["conv_id", "call_id"]
    one_call = calls.groupBy(*key).agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("_c"),
        (F.min(F.struct("turn", "name", "arguments", "after")) != F.max(F.struct("turn", "name", "arguments", "after"))).alias("_calls_differ"),
    )
    calls = checkpointed(one_call.select(*key, "_c.*", "_calls_differ"))
    one_result = results.groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("_r"), (F.min(F.struct("turn", "content")) != F.max(F.struct("turn", "content"))).alias("_results_differ")
    ).select(*key, F.col("_r.turn").alias("_result_turn"), F.col("_r.content").alias("_content"), "_results_differ", F.lit(True).alias("_has"))
    levelled = calls.join(_hashed(_levels(calls).select(*key, "_level")), key, "left")
    joined = levelled.withColumn("_is_call", F.lit(True)).join(_hashed(one_result), key, "full")
    twice = F.coalesce("_calls_differ", F.lit(False)) | F.coalesce("_results_differ", F.lit(False))
    status = F.when(F.col("_is_call").isNull(), "orphan").when(F.col("_has").isNull(), "unanswered").otherwise("answered")
    rows = joined.select(
        "conv_id",
        F.coalesce("turn", "_result_turn").alias("turn"),
        F.when(F.col("_is_call"), "call").otherwise("result").alias("kind"),
        "call_id",
        F.concat(status, F.when(twice, " twice").otherwise("")).alias("status"),
        F.when(
            F.col("_is_call"),
            F.concat(
                argument_errors(F.col("name"), F.col("arguments"), schemas),
                F.when(F.col("_level").isNull(), F.array(F.lit("order: waits for no earlier call"))).otherwise(F.array().cast("array<string>")),
            ),
        ).otherwise(F.array(F.lit("result: no call"))).alias("errors"),
        "_level", "name", F.try_parse_json("arguments").alias("_parsed"), F.col("_content").alias("content"),
    )
    within = Window.partitionBy("conv_id", "turn").orderBy("kind", F.col("_level").asc_nulls_last(), F.length("call_id"), "call_id")
    written = F.to_json(
        F.struct(
            F.when(F.col("kind") == "call", F.col("_parsed")).alias("arguments"),
            F.col("call_id"),
            F.col("content"),
            F.col("errors"),
            F.col("kind"),
            F.col("name"),
            F.col("status"),
        )
    )
    return rows.select(
        "conv_id",
        "turn",
        F.row_number().over(within).alias("place"),
        "kind",
        "call_id",
        "status",
        "errors",
        (F.size("errors") == 0).alias("valid"),
        written.alias("json"),
    )


SAY: Schemas = {"say": {"text": Parameter("string", True, 1, 400), "words": Parameter("integer", True, 1, 40), "line": Parameter("integer", True)}}


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results for conversations in plain text (conv_id, turn, role, text).

    Each line of a user's turn is a call of the tool ``say`` with the line, its number and its count of words; line k
    waits for line (k - 1) div 2, the first for the first of the user's turn two turns before, if there is one. Line k of
    an assistant's turn is the result of line k of the turn before. Null texts have no lines, and other roles have
    neither calls nor results; ``with_messages`` adds those turns. Repeated rows count once. If one turn of a role is
    given with different texts, the smallest has the plain ids and the ids of any other hold the MD5 sum of its text.
    """
    turns = turns.filter("conv_id is not null and turn is not null and text is not null and role in ('user', 'assistant')").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).distinct()
    plain = turns.groupBy("conv_id", "turn", "role").agg(F.min("text").alias("_plain"))
    given = turns.join(_hashed(plain), ["conv_id", "turn", "role"]).withColumn("_mark", F.when(F.col("text") == F.col("_plain"), "").otherwise(F.concat(F.lit("~"), F.md5("text"))))
    lines = given.select("conv_id", "turn", "role", "_mark", F.posexplode(F.split("text", "\n")).alias("_k", "_line"))
    name = lambda turn, mark, k: F.concat_ws("-", "conv_id", F.concat(turn.cast("string"), mark), k.cast("string"))
    turn, mark, k = F.col("turn"), F.col("_mark"), F.col("_k")
    asked = lines.filter("role = 'user'")
    before = plain.filter("role = 'user'").select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("_before"))
    no_calls = F.array().cast("array<string>")
    waits = F.when(k > 0, F.array(name(turn, mark, F.floor((k - 1) / 2)))).when(F.col("_before"), F.array(name(turn - 2, F.lit(""), F.lit(0)))).otherwise(no_calls)
    words = F.size(F.filter(F.split("_line", "[ \\t\\r]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct(k.alias("line"), F.col("_line").alias("text"), words.alias("words")))
    calls = asked.join(_hashed(before), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", name(turn, mark, k).alias("call_id"), F.lit("say").alias("name"), arguments.alias("arguments"), waits.alias("after")
    )
    results = lines.filter("role = 'assistant'").select("conv_id", "turn", name(turn - 1, mark, k).alias("call_id"), F.col("_line").alias("content"))
    return calls, results


def with_messages(turns: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of ``link_tool_calls`` and one row of kind message for every row of ``turns`` (conv_id, turn, role, text).

    No turn is left out: any role, null roles and texts, and repeated rows have their row. Messages stand first in
    their turn, ordered by role and text, and ``place`` counts on from them. A missing turn counts as -1; a message
    without a conversation has no place. Status is said, call_id null, and the JSON holds role and content.
    """
    known = F.col("role").isin("system", "user", "assistant", "tool")
    errors = F.when(F.col("role").isNull(), F.array(F.lit("role: missing"))).when(~known, F.array(F.lit("role: unknown"))).otherwise(F.array().cast("array<string>"))
    said = turns.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.lit(None).cast("int").alias("place"),
        F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("said").alias("status"), errors.alias("errors"), "role", "text",
    )
    written = F.to_json(F.struct(F.col("text").alias("content"), "errors", "kind", "role", "status"))
    said = said.select(*linked.columns[:-2], (F.size("errors") == 0).alias("valid"), written.alias("json"), "role", "text")
    named = linked.select("*", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")).union(said.filter("conv_id is not null"))
    within = Window.partitionBy("conv_id", "turn").orderBy(F.col("place").isNotNull(), "place", "role", "text")
    return named.withColumn("place", F.row_number().over(within)).union(said.filter("conv_id is null")).select(*linked.columns)
