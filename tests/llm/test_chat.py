import json

from grantlens.llm import chat
from grantlens.llm.common import Scratch

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "object"]}}, "additionalProperties": False}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i):
    return json.dumps({"tool_call_id": i, "content": "ok"})


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", result("x")),  # before its call
        (1, 2, "assistant", call(("x", "add", {"a": 1}))),
        (1, 3, "assistant", call(("y", "add", {"a": {"$result": "z"}}))),  # uses a later result
        (1, 4, "assistant", call(("z", "add", {"b": 1}))),
        (1, 5, "tool", result("z")),
        (1, 6, "tool", result("y")),
        (1, 7, "tool", result("none")),
        (2, 0, "assistant", call(("p", "add", {"a": {"$result": "q"}}), ("q", "add", {"a": {"$result": "p"}}))),
        (2, 1, "assistant", "{not json"),
        (2, None, None, None),
        (None, 1, "user", "a"),
        (None, 1, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS status")
    got = chat.link(df, Scratch(spark, "t"), SCHEMAS).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(8))
    place = {(r.status, *r.call_ids): r.position for r in one}
    assert place["call", "x"] < place["result", "x"]
    assert place["invalid", "z"] < place["result", "z"] < place["call", "y"] < place["result", "y"]
    assert ("orphan", "none") in place
    two = {r.turn: r for r in got if r.conv_id == 2}
    assert two[0].status == "cyclic" and two[1].status == "message" and two[None].position == 0 and two[None].role == "unknown"
    assert json.loads(two[None].json) == {"role": "unknown", "content": ""}
    assert sorted(r.position for r in got if r.conv_id is None) == [0, 1]
    again = chat.link(df.where("conv_id = 1 AND turn = 2").unionAll(df.where("conv_id = 1 AND turn = 2")), Scratch(spark, "t")).collect()
    assert len(again) == 2


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link(none, Scratch(spark, "t")).count() == 0
    many = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "repeat('x', 100) AS text")
    got = chat.link(many, Scratch(spark, "t"))
    assert got.where("position <> turn").count() == 0 and got.count() == 3000


def test_long_chains(spark):
    n = 200
    use = lambda k: call((f"c{k}", "add", {"a": {"$result": f"c{k - 1}"} if k else 1}))
    rows = [r for k in range(n) for r in ((1, 2 * k, "assistant", use(k)), (1, 2 * k + 1, "tool", result(f"c{k}")))]
    rows += [(2, n - k, "assistant", use(k)) for k in range(n)]  # each uses a later call
    rows += [(3, 3000 * (k % 2) + k, "assistant", use(k)) for k in range(n)]  # each uses a call far away
    rows += [(3, 7000 + k, "assistant", call((f"d{k}", "add", {"a": [{"$result": f"d{(k + 1) % 3}"}, {"$result": "c9"}]}))) for k in range(3)]  # a cycle
    rows += [(3, 7003, "assistant", call(("e", "add", {"a": {"$result": "d0"}})))]  # uses it
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    for conv in (1, 2, 3):
        one = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in one] == list(range(len(one)))
        assert [r.call_ids[0] for r in one if r.status == "call"] == [f"c{k}" for k in range(n)]
        assert [r.call_ids[0] for r in one if r.status == "cyclic"] == (["d0", "d1", "d2", "e"] if conv == 3 else [])
    assert [r.turn for r in sorted(got, key=lambda r: r.position) if r.conv_id == 1] == list(range(2 * n))


def test_conversations_without_id_link_too(spark):
    rows = [(None, 1, "tool", result("x")), (None, 2, "assistant", call(("x", "add", {"a": {"$result": "w"}}))), (None, 3, "assistant", call(("w", "add", {}))), (5, 1, "tool", result("x"))]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Scratch(spark, "t")).collect()
    assert [(r.conv_id, r.turn, r.status) for r in sorted(got, key=lambda r: (r.conv_id or 0, r.position))] == [(None, 3, "call"), (None, 2, "call"), (None, 1, "result"), (5, 1, "orphan")]


def test_schemas_that_conversations_declare(spark, tmp_path):
    tools = json.dumps({"tools": [{"name": "add", "parameters": SCHEMAS["add"]}, {"type": "function", "function": {"name": "go"}}, {"name": "bad", "parameters": {"type": "odd"}}, 7, {"name": "add", "parameters": {}}]})
    rows = [
        (1, 0, "system", tools),
        (1, 1, "assistant", call(("a", "add", {"a": 1}), ("b", "add", {"b": 1}), ("c", "go", {"x": []}))),
        (1, 2, "assistant", call(("d", "fly", {}))),
        (1, 3, "assistant", call(("e", "bad", {}))),
        (1, 3, "assistant", call(("f", "go", {}))),
        (2, 0, "system", "{no json"),
        (2, 1, "assistant", call(("a", "add", {"b": 1}))),
        (None, 0, "system", tools),
        (None, 1, "assistant", call(("a", "add", {"b": 1}))),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.json): r.status for r in chat.op8_tool_links(spark, str(tmp_path)).collect()}
    status = lambda c, t: [s for (x, y, _), s in sorted(got.items(), key=str) if (x, y) == (c, t)]
    assert status(1, 0) == ["message"] and status(1, 1) == ["invalid"] and status(1, 2) == ["invalid"] and sorted(status(1, 3)) == ["call", "invalid"]
    assert status(2, 0) == ["message"] and status(2, 1) == ["call"] and status(None, 1) == ["invalid"]
    found = {r.turn: r.problems for r in chat.link(spark.createDataFrame(rows[:3], "conv_id long, turn long, role string, text string"), Scratch(spark, "t")).collect()}
    assert found == {0: [], 1: ["b.a: missing", "b.b: unexpected"], 2: ["d: unknown tool"]}


def test_canonical():
    assert chat.canonical({"b": 1, "a": "é\n"}) == '{"a":"é\\n","b":1}'
    assert chat.problems({"type": "integer", "minimum": 2}, 1) and not chat.problems({"type": "number"}, 1.5)
