"""Chat formatting with linked tool calls.

Messages are (conv_id, turn, role, text). An assistant's text that is a JSON object with a list `tool_calls` of objects {id, name,
arguments} makes calls; a tool's text that is a JSON object with `tool_call_id` is a result. Everything else is plain.

Calls and results are joined by (conv_id, identifier). Arguments may hold {"$result": identifier} and then depend on that call's
result. Messages are ordered topologically: by turn, but a result after its call and a call after the results that it uses,
level by level; calls on a cycle, or that use one which is, keep their turn and are marked. Chains may have any length.

Arguments are validated against JSON schemas: those given for tool names, and those that a conversation declares itself, in a system
message that is a JSON object with a list `tools` of objects {name, parameters} (or {function: {name, parameters}}). Of two declarations
of a name the first holds; in a conversation that declares tools, others are unknown. Without schemas nothing is validated.
Each message is serialised as canonical JSON: keys sorted, no spaces, UTF-8, no NaN.

status: message, call, result, orphan (a result without a call), invalid (a call whose arguments fail their schema, or with an
unknown tool while schemas are given), repeated (a second call or result with an identifier), cyclic.

Edge cases: a null text counts as empty, a null role as "unknown"; messages with null conv_id are one conversation, those with null turn come
first in theirs;
repeated rows stay and are ordered next to each other; malformed JSON is plain text; an empty table gives no rows; other
columns are ignored. Positions are counted in runs of turns, so a conversation that holds a large part of all rows is split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

RUN_OF_TURNS = 256
#: levels are found within blocks of RUN_OF_TURNS turns, then in blocks of twice as many each round, up to this power of two
MOST_DOUBLINGS = 8
#: rows in memory before a task finds levels, beside those of one block
_HELD = 50_000
_types = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(schema: dict, value: Any, at: str = "$") -> list[str]:
    """What is wrong with value under a JSON schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    kinds = schema.get("type")
    if kinds:
        kinds = [kinds] if isinstance(kinds, str) else kinds

        def fits(kind: str) -> bool:
            if kind in ("number", "integer"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
            return isinstance(value, _types[kind])

        if not any(fits(k) for k in kinds):
            return [f"{at}: not {'|'.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                found += problems(known[k], v, f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unexpected")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            found += problems(schema["items"], v, f"{at}[{k}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above maximum")
    return found


def _uses(value: Any) -> list[str]:
    if isinstance(value, dict):
        if list(value) == ["$result"] and isinstance(value["$result"], str):
            return [value["$result"]]
        return [u for v in value.values() for u in _uses(v)]
    return [u for v in value for u in _uses(v)] if isinstance(value, list) else []


def _declared(body: Any) -> dict[str, str]:
    """Schemas by tool name that a system message's JSON declares."""
    found: dict[str, str] = {}
    for tool in body.get("tools") or [] if isinstance(body, dict) and isinstance(body.get("tools"), list) else []:
        tool = tool.get("function", tool) if isinstance(tool, dict) else None
        if isinstance(tool, dict) and isinstance(tool.get("name"), str) and isinstance(tool.get("parameters", {}), dict):
            found.setdefault(tool["name"], canonical(tool.get("parameters", {})))
    return found


def parse(role: str, text: str, schemas: dict[str, dict] | None) -> tuple[str, list[str], list[str], list[str], str, list[tuple[str, str]]]:
    """kind, call ids, ids whose results are used, problems, canonical JSON of one message, and (name, arguments) of each call or (name, schema) of each tool declared."""
    plain = ("message", [], [], [], canonical({"role": role, "content": text}), [])
    if role not in ("assistant", "tool", "system") or not text.lstrip().startswith("{"):
        return plain
    try:
        body = json.loads(text)
        if role == "system":
            return (*plain[:5], list(_declared(body).items()))
        if role == "tool" and isinstance(body.get("tool_call_id"), str):
            return "result", [body["tool_call_id"]], [], [], canonical({"role": role} | body), []
        calls = body.get("tool_calls") if role == "assistant" else None
        if not isinstance(calls, list) or not calls or not all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
            return plain
        wrong, uses, asked = [], [], []
        for c in calls:
            arguments = c.get("arguments", {})
            if isinstance(arguments, str):  # arguments as JSON text are taken apart
                arguments = c["arguments"] = json.loads(arguments)
            uses += _uses(arguments)
            asked.append((c["name"] if isinstance(c.get("name"), str) else "", canonical(arguments)))
            if schemas is not None:
                wrong += problems(schemas[c["name"]], arguments, c["id"]) if c.get("name") in schemas else [f"{c['id']}: unknown tool"]
        return "call", [c["id"] for c in calls], uses, wrong, canonical({"role": role} | body), asked
    except (ValueError, TypeError, RecursionError):
        return plain


SCHEMA = "conv_id long, turn long, role string, row long, kind string, ids array<string>, uses array<string>, problems array<string>, json string, names array<string>, bodies array<string>"


def parsed(messages: DataFrame, schemas: dict[str, dict] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, text, row = (c.to_pylist() for c in batch.columns)
            made = [parse(r, t, schemas) for r, t in zip(role, text, strict=True)]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(row, pa.int64()), pa.array([m[0] for m in made], pa.string())] + [pa.array([m[k] for m in made], lists) for k in (1, 2, 3)] + [pa.array([m[4] for m in made], pa.string())] + [pa.array([[x[k] for x in m[5]] for m in made], lists) for k in (0, 1)],
                names=["conv_id", "turn", "role", "row", "kind", "ids", "uses", "problems", "json", "names", "bodies"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("row", F.xxhash64("conv_id", "turn", "role", "text")).mapInArrow(run, SCHEMA)


def _wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, row, place, problems) of calls (conv_id, row, place, id, name, arguments, schema); without schema the tool is unknown."""
    for batch in batches:
        found = []
        for i, arguments, schema in zip(*(batch.column(k).to_pylist() for k in (3, 5, 6)), strict=True):
            try:
                found.append([f"{i}: unknown tool"] if schema is None else problems(json.loads(schema), json.loads(arguments), i))
            except (KeyError, TypeError, AttributeError, ValueError, RecursionError):
                found.append([f"{i}: the schema cannot be read"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], names=["conv_id", "row", "place", "problems"])


def _validated(rows: DataFrame) -> DataFrame:
    """rows with the problems of calls under the schemas that their conversations declare."""
    each = lambda kind: rows.where(kind & (F.size("names") > 0)).select("conv_id", "turn", "row", "ids", F.posexplode(F.arrays_zip("names", "bodies")).alias("place", "x"))
    declared = each(F.col("kind") == "message").groupBy("conv_id", F.col("x.names").alias("name")).agg(F.min_by("x.bodies", F.struct("turn", "row", "place")).alias("schema"))
    if declared.isEmpty():
        return rows
    calls = each(F.col("kind") == "call").select("conv_id", "row", "place", F.get("ids", F.col("place")).alias("id"), F.col("x.names").alias("name"), F.col("x.bodies").alias("arguments")).distinct()
    asked = calls.join(declared.select("conv_id").distinct(), "conv_id").join(declared, ["conv_id", "name"], "left")
    wrong = asked.select("conv_id", "row", "place", "id", "name", "arguments", "schema").mapInArrow(_wrong, "conv_id string, row long, place int, problems array<string>")
    of_row = wrong.groupBy("conv_id", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "problems"))), lambda w: w["problems"])).alias("more"))  # as many as the message has calls
    return rows.join(of_row, ["conv_id", "row"], "left").withColumn("problems", F.concat("problems", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the calls that use known results or, by way of calls of their block, nothing else.

    Rows (conv_id, block, id, need, level, need_ready, own) are in the order of blocks, and a call's rows are of one block.
    """
    names = ["conv_id", "id", "level", "ready", "need_ready"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        waits: dict[tuple, int] = {}
        users: dict[tuple, list[tuple]] = {}
        best: dict[tuple, tuple] = {}  # the level and the turn that needs give a call
        turns = {}

        def meet(call: tuple, level: int, ready: int | None) -> None:
            before = best.get(call, (-1, None))
            best[call] = (max(before[0], level), max((t for t in (before[1], ready) if t is not None), default=None))

        for conv, block, i, need, level, ready, own in rows:
            call = (conv, block, i)
            turns[call] = own
            waits.setdefault(call, 0)
            if level is None:
                waits[call] += 1
                users.setdefault((conv, block, need), []).append(call)
            else:
                meet(call, level, ready)
        free = [call for call, n in waits.items() if n == 0]
        out = []
        for call in free:  # grows meanwhile
            level, need_ready = best[call]
            ready = max((t for t in (turns[call], need_ready) if t is not None), default=None)
            out.append((call[0], call[2], level + 1, ready, need_ready))
            for user in users.get(call, ()):
                meet(user, level + 1, ready)
                waits[user] -= 1
                if waits[user] == 0:
                    free.append(user)
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(rows) >= _HELD and row[:2] != rows[-1][:2]:
                yield solve(rows)
                rows = []
            rows.append(row)
    if rows:
        yield solve(rows)


def link(messages: DataFrame, scratch: Scratch, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, position, status, call_ids, problems, json) for each message."""
    # in joins a conversation without id is one like others
    rows = scratch.save(parsed(messages, schemas).withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), "parsed")
    rows = _validated(rows).drop("names", "bodies")
    one = lambda kind: rows.where(F.col("kind") == kind).select("conv_id", F.explode("ids").alias("id"), "turn", "row", "uses")
    first = F.min(F.struct("turn", "row")).alias("first")
    calls = one("call").groupBy("conv_id", "id").agg(first).select("conv_id", "id", F.col("first.turn").alias("call_turn"), F.col("first.row").alias("call_row"))
    answers = one("result").groupBy("conv_id", "id").agg(first).select("conv_id", "id", F.col("first.row").alias("result_row"), F.col("first.turn").alias("result_turn"))
    linked = scratch.save(calls.join(answers, ["conv_id", "id"], "left"), "linked")
    # levels: a call that uses no linked result has 0, others one more than the calls they use
    needs = one("call").select("conv_id", "id", F.explode("uses").alias("need")).distinct().join(linked.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"])
    needs = scratch.save(needs.select("conv_id", "id", "need"), "needs")
    level = linked.join(needs, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level"), F.greatest("call_turn", "result_turn").alias("ready"))
    level = scratch.save(level, "level-0")
    if not needs.isEmpty():
        level = level.withColumn("need_ready", F.lit(None).cast("long"))
        own = linked.select("conv_id", "id", "call_turn", F.greatest("call_turn", "result_turn").alias("own"))
        total, n, i = linked.count(), level.count(), 0
        while n < total:
            i += 1
            known = level.select("conv_id", F.col("id").alias("need"), "level", F.col("ready").alias("need_ready"))
            todo = needs.join(level, ["conv_id", "id"], "left_anti").join(known, ["conv_id", "need"], "left").join(own, ["conv_id", "id"])
            todo = todo.withColumn("block", F.floor(F.col("call_turn") / (RUN_OF_TURNS << min(i - 1, MOST_DOUBLINGS))))
            blocks = todo.select("conv_id", "block", "id", "need", "level", "need_ready", "own").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block")
            done = blocks.mapInArrow(_levels, "conv_id string, id string, level int, ready long, need_ready long")
            level = scratch.save(level.unionByName(done), f"level-{i}")
            scratch.drop(f"level-{i - 1}")
            if (m := level.count()) == n:  # a call that is on no cycle and uses none would have got a level
                break
            n = m
    if "need_ready" not in level.columns:
        level = level.withColumn("need_ready", F.lit(None).cast("long"))
    facts = linked.join(level, ["conv_id", "id"], "left")
    facts = facts.select("conv_id", "id", "call_turn", "call_row", "result_row", "level", "need_ready", F.greatest("call_turn", "need_ready").alias("call_at"))
    plain = rows.where("kind = 'message'").select("*", F.lit("message").alias("status"), F.col("turn").alias("at"), F.lit(0).alias("level"))
    special = rows.where("kind <> 'message'").withColumn("id", F.explode("ids")).join(facts, ["conv_id", "id"], "left")
    keys = ["conv_id", "turn", "row", "role", "kind", "ids", "uses", "problems", "json"]
    own = F.when(F.col("kind") == "call", F.col("row") == F.col("call_row")).otherwise(F.col("row").eqNullSafe(F.col("result_row")))
    state = (
        F.when((F.col("kind") == "result") & F.col("call_row").isNull(), "orphan")
        .when(~own, "repeated")
        .when((F.col("kind") == "call") & F.col("level").isNull(), "cyclic")
        .when(F.size("problems") > 0, "invalid")
        .otherwise(F.col("kind"))
    )
    at = F.when(F.col("kind") == "call", F.greatest("turn", "call_at")).otherwise(F.greatest("turn", "call_at", "call_turn"))
    step = 2 * F.coalesce("level", F.lit(0)) + F.when(F.col("kind") == "call", 1).otherwise(2)
    # a message with several calls or a repeated row is one row again
    special = special.withColumn("status", state).withColumn("at", at).withColumn("step", step)
    special = special.groupBy(*keys, "id").agg(F.min("status").alias("status"), F.max("at").alias("at"), F.max("step").alias("step"), F.count("*").alias("copies"))
    worst = special.groupBy(*keys).agg(F.min_by("status", F.when(F.col("status").isin("call", "result"), 1).otherwise(0)).alias("status"), F.max("at").alias("at"), F.max("step").alias("level"), F.max("copies").alias("copies"))
    special = worst.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    every = plain.unionByName(special)
    # positions: within runs of turns, plus the rows of earlier runs
    every = every.withColumn("run", F.floor(F.col("at") / RUN_OF_TURNS))
    before = every.groupBy("conv_id", "run").count().withColumn("before", F.sum("count").over(Window.partitionBy("conv_id").orderBy("run")) - F.col("count"))
    before = before.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "before")
    order = Window.partitionBy("conv_id", "run").orderBy("at", "level", "turn", "row")
    placed = every.withColumn("number", F.row_number().over(order)).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r")))
    return placed.select(F.nullif("conv_id", F.lit("")).cast("long").alias("conv_id"), "turn", "role", (F.col("before") + F.col("number") - 1).cast("long").alias("position"), "status", F.col("ids").alias("call_ids"), "problems", "json")


def op8_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, status and canonical JSON of every message."""
    made = link(read(spark, sf_dir, "conversations"), Scratch(spark, "chat"))
    return made.select("conv_id", "turn", "role", "position", "status", "json")


#: For messages without tool calls, as in the tables given.
SQL = """
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, 'message' AS status,
  '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json
FROM conversations"""
