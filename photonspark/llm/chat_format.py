"""Chat formatting with linked tool calls, on SQL functions only.

Calls and results are hash-joined by identifier (each side first reduced to one row an
identifier, so repeated identifiers cannot multiply). Every message has at most one predecessor:
a result follows its call, a call may follow a result. The topological level is the length of
that chain, found by pointer doubling (each round doubles the distance, so a chain of n messages
takes log2(n) rounds); sorting by (conversation, level, turn) is a topological order. Arguments
are parsed as variants and validated against the tool's parameters (known, required, of the
right type, within limits). Messages are serialised as canonical JSON: keys sorted, no white space.

Defined results: an identifier with a null part is null and links nothing; a call without a
result and a result without a call have a null ``linked_turn``; of repeated identifiers the
smallest turn is linked to; a message on a cycle has a null level; arguments that are null, no
JSON object, or of an unknown tool are not valid; an empty table gives an empty result. Other
input columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.llm.workspace import Workspace

#: JSON type name -> pattern of the variant type names that satisfy it.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*", "array": "^ARRAY.*"}


#: A tool's parameters: name -> (JSON type, required, limits by the names of JSON schema).
Parameters = dict[str, tuple[str, bool, dict[str, float]]]


def within(value: Column, name: str, limits: dict[str, float]) -> Column:
    """Whether a parameter keeps its limits; null if it is absent."""
    number = F.try_variant_get(value, f"$.{name}", "double")
    length = F.length(F.try_variant_get(value, f"$.{name}", "string"))
    tests = {"minimum": lambda x: number >= x, "maximum": lambda x: number <= x, "minLength": lambda x: length >= x, "maxLength": lambda x: length <= x}
    return reduce(Column.__and__, (tests[k](F.lit(x)) for k, x in limits.items()), F.lit(True))


def valid_arguments(arguments: str, parameters: Parameters) -> Column:
    """Whether a JSON column holds an object with known, required and well-typed parameters within their limits."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    ok = kind.startswith("OBJECT")
    known = F.array(*(F.lit(p) for p in parameters))
    names = F.json_object_keys(F.col(arguments))
    ok &= F.coalesce(F.size(F.array_except(names, known)) == 0, F.lit(False))
    for name, (json_type, required, limits) in parameters.items():
        inner = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        fits = inner.rlike(TYPES[json_type]) & within(value, name, limits)
        ok &= F.coalesce(fits, F.lit(not required))
    return F.coalesce(ok, F.lit(False))


def levels(work: Workspace, edges: DataFrame) -> DataFrame:
    """``(node, level)`` of ``edges(node, parent)`` with at most one parent a node; null on cycles.

    ``level`` counts the steps to ``parent``, an ancestor; a round joins only the nodes that still
    have one, so short chains leave early.
    """
    state = work.table(edges.select("node", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")), "level-0")
    n, turn, closed = state.count(), 0, []
    reach = 2 * n
    while True:
        closed.append(state.where(F.col("parent").isNull()))
        waiting = state.where(F.col("parent").isNotNull())
        if (1 << turn) > reach or not (n := waiting.count()):
            break
        every = waiting
        for part in closed:
            every = every.unionByName(part)
        up = every.select(F.col("node").alias("up"), F.col("parent").alias("next"), F.col("level").alias("more"))
        hop = waiting.join(up, F.col("parent") == F.col("up"), "left").select("node", F.col("next").alias("parent"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        turn += 1
        state = work.table(hop, f"level-{turn}", n)
    found = waiting.select("node", F.lit(None).cast("long").alias("level"))
    for part in closed:
        found = found.unionByName(part.select("node", "level"))
    return found


def link(work: Workspace, messages: DataFrame) -> DataFrame:
    """Add ``linked_turn`` and ``level`` to ``messages(conv_id, turn, kind, call_id, after)``.

    ``kind`` is call, result or message; a result has the ``call_id`` of its call; ``after`` names
    the call whose result a call builds on.
    """
    ends = messages.where("call_id IS NOT NULL AND kind IN ('call', 'result')").groupBy("call_id", "kind").agg(F.min("turn").alias("turn"), F.max("after").alias("after"))
    ends = work.table(ends, "ends")
    other = ends.select(F.col("call_id").alias("o_id"), F.when(F.col("kind") == "call", "result").otherwise("call").alias("o_kind"), F.col("turn").alias("linked_turn"))
    node = lambda kind, ref: F.concat(kind, F.lit(" "), ref)
    results = ends.where("kind = 'result'").select(F.col("call_id").alias("r_id"))
    calls = ends.where("kind = 'call'").select(F.col("call_id").alias("c_id"), "after")
    of_result = results.join(calls.select("c_id"), F.col("r_id") == F.col("c_id"), "left").select(node(F.lit("result"), F.col("r_id")).alias("node"), node(F.lit("call"), F.col("c_id")).alias("parent"))
    of_call = calls.join(results, F.col("after") == F.col("r_id"), "left").select(node(F.lit("call"), F.col("c_id")).alias("node"), node(F.lit("result"), F.col("r_id")).alias("parent"))
    found = levels(work, of_result.unionByName(of_call))
    linked = messages.join(other, (F.col("call_id") == F.col("o_id")) & (F.col("kind") == F.col("o_kind")), "left")
    own = node(F.col("kind"), F.col("call_id"))
    lone = F.col("call_id").isNull() | ~F.col("kind").isin("call", "result")
    return linked.join(found.withColumnRenamed("level", "deep"), own == F.col("node"), "left").withColumn("level", F.when(lone, F.lit(0).cast("long")).otherwise(F.col("deep"))).drop("o_id", "o_kind", "node", "deep")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Turns as messages: a user's turn calls the tool ``reply`` with its text, the assistant's next
    turn is the result, and a call builds on the result of the turn before it."""
    c = F.col
    ref = lambda turn: F.concat(c("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    user, assistant = c("role") == "user", c("role") == "assistant"
    text = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(F.length(text).cast("long").alias("chars"), c("text").alias("text")))
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, ref(c("turn"))).when(assistant, ref(c("turn") - 1)).alias("call_id"),
        F.when(user, ref(c("turn") - 2)).alias("after"),
        F.when(user, arguments).alias("arguments"),
        F.when(~user | user.isNull(), c("text")).alias("content"),
    )


def format_chats(messages: DataFrame, parameters: Parameters, tool: str) -> DataFrame:
    """Linked, levelled, validated and serialised messages."""
    work = Workspace(messages.sparkSession, "chat")
    linked = link(work, messages)
    called = F.col("kind") == "call"
    canonical = F.to_json(
        F.struct(
            F.when(called, F.parse_json("arguments")).alias("arguments"),
            F.col("content"),
            F.col("conv_id").alias("conversation"),
            F.col("call_id").alias("id"),
            F.col("kind"),
            F.col("level"),
            F.when(called, F.lit(tool)).alias("name"),
            F.col("role"),
            F.col("turn"),
        )
    )
    return linked.select("conv_id", "turn", "role", "kind", "call_id", "linked_turn", "level", F.when(called, valid_arguments("arguments", parameters)).alias("valid"), canonical.alias("json"))
