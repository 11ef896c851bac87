"""Chat formatting: tool-call linking, in DataFrame functions only.

``calls`` (conv_id, turn, call_id, name, arguments, after) and ``results`` (conv_id, turn, call_id, content) are
hash-joined by (conv_id, call_id); what is hashed are identifiers, no contents. ``after`` names the call that must come first, or is null. The
output has a row for each event, in an order in which a call stands after the call it
names and a result after its call:

* ``status`` of a call: ``linked``, ``no_result``, or ``cycle`` (its chain of ``after`` never
  ends); of a result: ``linked``, ``no_call``. A call id that a conversation repeats counts by its first
  turn, the others are ``repeated``; of several results the first turn is ``linked``, the rest ``repeated``.
* ``depth``: how many calls stand before it in its chain, by pointer doubling: the number of rounds grows
  with the logarithm of the longest chain, and a chain that is still open after as many rounds as any
  chain could need is a cycle. An ``after`` that names no call counts as none.
* ``position``: gapless from 0 in a conversation, by (depth, turn, calls before results, call id, JSON). It is
  counted in slices of the order and shifted by the slices before, so of a conversation with
  a third of all events one task sees the sizes of slices only. (A chain has a slice a depth; events of a
  conversation without a turn are one slice.)
* ``errors``: what in the arguments breaks the tool's schema, in the order of names.
* ``json``: canonical JSON of the event: keys in order, no blanks.

Events of a null conversation or call id are kept, as ``no_result`` or ``no_call``. Arguments that
are null or no JSON object are an error. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wastelens.llm.common import WHITE, read, stored, text_of, words_of

SLICE = 1024  # turns in one slice of a conversation's order
KEYS = ["conv_id", "call_id"]
#: Variant types by schema type.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
         "boolean": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$"}


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth); depth is null in a cycle. ``calls``: (conv_id, call_id, after), ids once."""
    up = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(1).alias("known"))
    state = stored(calls.select(*KEYS, "after").join(up, ["conv_id", "after"], "left").select(
        *KEYS, F.when(F.col("known") == 1, F.col("after")).alias("up"), F.coalesce("known", F.lit(0)).cast("long").alias("depth")))
    for _ in range(math.ceil(math.log2(state.count() + 2)) + 1):
        if state.where(F.col("up").isNotNull()).limit(1).count() == 0:
            break
        # Calls whose chain is settled need no lookup.
        there = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        todo = state.where(F.col("up").isNotNull()).join(there, ["conv_id", "up"])
        state = stored(state.where(F.col("up").isNull()).unionByName(todo.select(
            *KEYS, F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))))
    return state.select(*KEYS, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def argument_errors(name: Column, arguments: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Errors of the arguments (a variant) against ``tools``: {tool: {argument: (type, required)}}."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit(""))))
    no_object = F.coalesce(~F.schema_of_variant(arguments).rlike("^OBJECT"), F.lit(True))
    for tool, schema in sorted(tools.items()):
        checks = []
        for arg, (kind, required) in sorted(schema.items()):
            value = F.variant_get(arguments, f"$.{arg}", "variant")
            wrong = ~F.schema_of_variant(value).rlike(TYPES[kind])
            missing = F.lit(f"missing {arg}") if required else F.lit(None).cast("string")
            checks.append(F.when(value.isNull() | F.is_variant_null(value), missing).when(
                wrong, F.lit(f"{arg} is not {kind}")))
        extra = F.transform(
            F.array_except(F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>")),
                           F.array(*[F.lit(a) for a in sorted(schema)]).cast("array<string>")),
            lambda k: F.concat(F.lit("unknown argument "), k))
        found = F.concat(F.filter(F.array(*checks).cast("array<string>"), lambda e: e.isNotNull()), F.array_sort(extra))
        out = F.when(name == tool, F.when(no_object, F.array(F.lit("arguments are no object"))).otherwise(found)).otherwise(out)
    return out


def link_calls(calls: DataFrame, results: DataFrame, tools: dict, others: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, turn, kind, call_id, depth, status, errors, json) of all events; ``others``
    (conv_id, turn, role, content) are messages that stand by themselves."""
    calls = calls.select(*KEYS, F.col("turn").cast("long").alias("turn"), "name", "arguments", "after")
    lead = F.min(F.struct("turn", F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), F.coalesce("after", F.lit(""))))
    # The first of a repeated call id, by a partial aggregate; the count tells the rest apart.
    rank = F.row_number().over(Window.partitionBy(*KEYS, "turn").orderBy("name", "arguments", "after"))
    first = calls.groupBy(*KEYS).agg(lead["turn"].alias("first_turn"))
    calls = calls.withColumn("nth", rank).join(first, (calls.conv_id.eqNullSafe(first.conv_id)) & (
        calls.call_id.eqNullSafe(first.call_id))).select(calls["*"], "nth", "first_turn") \
        .withColumn("is_first", (F.col("turn") == F.col("first_turn")) & (F.col("nth") == 1)).drop("nth", "first_turn")
    heads = calls.where("is_first").where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    answers = results.groupBy(*KEYS).agg(F.min(F.struct("turn", "content")).alias("answer"))
    depth = depths(heads)

    linked = calls.join(answers.select(*KEYS, F.lit(True).alias("answered")).hint("shuffle_hash"), KEYS, "left") \
        .join(depth, KEYS, "left")
    args = F.try_parse_json("arguments")
    call_status = F.when(~F.col("is_first"), "repeated").when(
        F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("depth").isNull(), "cycle").when(
        F.col("answered"), "linked").otherwise("no_result")
    call_rows = linked.withColumn("args", args).select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "depth", call_status.alias("status"),
        argument_errors(F.col("name"), F.col("args"), tools).alias("errors"),
        F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
                           F.lit("tool_call").alias("type"))).alias("json"))

    known = heads.select(*KEYS, F.lit(True).alias("called")).join(depth, KEYS)
    turns = answers.select(*KEYS, F.col("answer.turn").alias("answer_turn"))
    res = results.select(*KEYS, F.col("turn").cast("long").alias("turn"), "content")
    res = res.withColumn("nth", F.row_number().over(Window.partitionBy(*KEYS, "turn").orderBy("content"))) \
        .join(known.hint("shuffle_hash"), KEYS, "left").join(turns, KEYS, "left")
    head = (F.col("turn") == F.col("answer_turn")) & (F.col("nth") == 1)
    result_rows = res.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", "depth",
        F.when(F.col("called").isNull(), "no_call").when(head, "linked").otherwise("repeated").alias("status"),
        F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("tool_result").alias("type"))).alias("json"))

    rows = call_rows.unionByName(result_rows)
    if others is not None:
        rows = rows.unionByName(others.select(
            "conv_id", F.col("turn").cast("long").alias("turn"), F.lit("message").alias("kind"),
            F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("depth"), F.lit("plain").alias("status"),
            F.array().cast("array<string>").alias("errors"),
            F.to_json(F.struct("content", "role", F.lit("message").alias("type"))).alias("json")))
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds the events' positions: messages and events without a place in a chain come first, by turn."""
    rows = rows.withColumn("place", F.coalesce("depth", F.lit(-1)))
    rows = rows.withColumn("slice", F.struct("place", F.floor(F.col("turn") / SLICE).alias("turns")))
    inner = Window.partitionBy("conv_id", "slice").orderBy("turn", "kind", "call_id", "json")
    rows = rows.withColumn("nth", F.row_number().over(inner))
    sizes = rows.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("slice")) - F.col("size")
    sizes = sizes.select(F.col("conv_id").alias("_conv"), F.col("slice").alias("_slice"), before.alias("before"))
    return rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("slice").eqNullSafe(F.col("_slice")))).select(
        "conv_id", (F.col("before") + F.col("nth") - 1).alias("position"), "turn", "kind", "call_id", "depth", "status",
        F.array_join("errors", "; ").alias("errors"), "json")


#: What the query below takes a conversation's turns for: a user's turn calls a tool
#: with the text's figures, the assistant's next turn is the result of that call.
TOOLS = {
    "answer": {"text": ("string", True), "words": ("integer", True), "lines": ("integer", False)},
    "read": {"text": ("string", True), "words": ("integer", True), "lines": ("integer", True)},
}
LONG = 40


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, others) of plain conversations. A user's turn of LONG words and
    more calls ``read``, a shorter one ``answer``, after the call of two turns before;
    ``lines`` is only given for texts of more than one line."""
    text = text_of()
    df = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"),
                         F.size(words_of(text)).alias("words"), F.size(F.split(text, "\n")).alias("lines"))

    def call_id(back: int) -> Column:
        return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    calls = df.where("role = 'user'").select(
        "conv_id", "turn", call_id(0).alias("call_id"), F.when(F.col("words") >= LONG, "read").otherwise("answer").alias("name"),
        F.to_json(F.struct("words", "text", F.when(F.col("lines") > 1, F.col("lines")).alias("lines"))).alias("arguments"),
        call_id(2).alias("after"))
    results = df.where("role = 'assistant'").select("conv_id", "turn", call_id(1).alias("call_id"), F.col("text").alias("content"))
    others = df.where("role is null or role not in ('user', 'assistant')").select(
        "conv_id", "turn", "role", F.col("text").alias("content"))
    return calls, results, others


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    """All turns of all conversations as linked, ordered and validated events."""
    calls, results, others = from_turns(read(spark, sf_dir, "conversations"))
    return link_calls(calls, results, TOOLS, others)


_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"
OP10_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, {_WORDS} AS words, len(string_split(text, chr(10))) AS lines FROM conversations),
c AS (SELECT *, 'call_' || conv_id || '_' || turn AS call_id, 'call_' || conv_id || '_' || (turn - 2) AS after FROM t WHERE role = 'user'),
r AS (SELECT *, 'call_' || conv_id || '_' || (turn - 1) AS call_id FROM t WHERE role = 'assistant'),
d AS (
  SELECT conv_id, call_id, 0 AS depth FROM c WHERE (conv_id, after) NOT IN (SELECT conv_id, call_id FROM c)
  UNION ALL SELECT c.conv_id, c.call_id, d.depth + 1 FROM c JOIN d ON c.conv_id = d.conv_id AND c.after = d.call_id),
e AS (
  SELECT c.conv_id, c.turn, 'call' AS kind, call_id, depth,
         CASE WHEN (c.conv_id, call_id) IN (SELECT conv_id, call_id FROM r) THEN 'linked' ELSE 'no_result' END AS status,
         CASE WHEN words >= {LONG} AND lines <= 1 THEN 'missing lines' ELSE '' END AS errors,
         '{{"arguments":{{' || CASE WHEN lines > 1 THEN '"lines":' || lines || ',' ELSE '' END || '"text":' || to_json(text)
           || ',"words":' || words || '}},"id":"' || call_id || '","name":"' || CASE WHEN words >= {LONG} THEN 'read' ELSE 'answer' END
           || '","type":"tool_call"}}' AS json
  FROM c JOIN d USING (conv_id, call_id)
  UNION ALL
  SELECT r.conv_id, r.turn, 'result', r.call_id, d.depth, CASE WHEN d.call_id IS NULL THEN 'no_call' ELSE 'linked' END, '',
         '{{"content":' || to_json(text) || ',"id":"' || r.call_id || '","type":"tool_result"}}'
  FROM r LEFT JOIN d ON r.conv_id = d.conv_id AND r.call_id = d.call_id
  UNION ALL
  SELECT conv_id, turn, 'message', NULL, NULL, 'plain', '',
         '{{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}}'
  FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, -1), turn, kind, call_id, json) - 1 AS position,
       turn, kind, call_id, CAST(depth AS BIGINT) AS depth, status, errors, json FROM e
"""
