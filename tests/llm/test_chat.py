import json

import duckdb
import pytest

from faceoff.llm import chat
from faceoff.llm.queries import ORACLES, QUERIES

CALL = "conv_id long, call_id string, after string, turn long, name string, arguments string, result int"
RESULT = "conv_id long, call_id string, turn long, content string"
SCHEMA = "name string, field string, type string, required boolean"
TOOL = [("f", "x", "integer", True), ("f", "y", "string", False), ("f", "z", "array", None), (None, None, None, None), ("f", "x", "integer", True)]


def run(spark, calls, results, tools=TOOL):
    out = chat.link(spark.createDataFrame([(*c, 0) for c in calls], CALL), spark.createDataFrame(results, RESULT), spark.createDataFrame(tools, SCHEMA))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_links_orders_and_validates(spark):
    calls = [(1, "c", "b", 3, "f", '{"y": "t", "x": 1}'), (1, "a", None, 1, "f", '{"x": "1", "w": null}'), (1, "b", "a", 2, "f", '{"z":{}, "x":2.5}'),
             (1, "b", "a", 9, "f", '{"x": 5}'), (2, "p", "q", 1, "f", "[1]"), (2, "q", "p", 1, "g", "{}"), (2, None, None, 1, "f", None), (3, "s", "none", None, "f", "{"),
             (1, "a", None, 1, "f", '{"x": "1", "w": null}')]
    results = [(1, "a", 2, "r1"), (1, "a", 3, "r2"), (1, "a", 2, "r1"), (1, "zz", 4, None), (1, None, 1, "n"), (1, "c", None, "")]
    got = {(r[1], r[4], r[5]): r for r in run(spark, calls, results)}
    assert sorted(got, key=str) == sorted([
        ("c", "ok", ""), ("a", "ok", "w:unknown,x:type"), ("b", "no_result", "x:type,z:type"), ("b", "duplicate_call", ""), ("p", "cycle", "json"),
        ("q", "cycle", "schema"), (None, "no_id", "json"), ("s", "no_result", "json"), ("a", "repeated_result", ""), ("zz", "orphan_result", ""), (None, "no_id", "")], key=str)
    assert [got[k][2] for k in (("a", "ok", "w:unknown,x:type"), ("b", "no_result", "x:type,z:type"), ("c", "ok", ""), ("s", "no_result", "json"))] == [0, 1, 2, 0]
    record = got["c", "ok", ""][6]
    assert record == '{"arguments":{"x":1,"y":"t"},"call_id":"c","conv_id":"1","depth":2,"errors":"","name":"f","result":"","status":"ok"}'
    for r in got.values():
        value = json.loads(r[6])
        assert json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r[6]


def test_long_chain_in_few_rounds(spark):
    n = 300
    calls = [(7, f"k{i}", f"k{i - 1}" if i else None, i, "f", '{"x":1}') for i in range(n)]
    assert {r[1]: r[2] for r in run(spark, calls, [])} == {f"k{i}": i for i in range(n)}


def test_other_turns_have_rows(spark):
    turns = [(1, 0, "system", "be kind", 1), (1, 0, "system", "be kind", 1), (1, None, None, None, 2), (None, 5, "tool", 'x "y"', 3)]
    calls = spark.createDataFrame([(1, "a", None, 1, "f", '{"x":1}', 0)], CALL)
    out = chat.link(calls, spark.createDataFrame([], RESULT), spark.createDataFrame(TOOL, SCHEMA),
                    spark.createDataFrame(turns, "conv_id long, turn long, role string, content string, status int"))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([
        (1, "a", 0, "0000000000:a", "no_result", "", '{"arguments":{"x":1},"call_id":"a","conv_id":"1","depth":0,"errors":"","name":"f","status":"no_result"}'),
        (1, None, None, "-0000000000", "unlinked", "", '{"conv_id":"1","errors":"","name":"system","result":"be kind","status":"unlinked"}'),
        (1, None, None, "-9999999999", "unlinked", "", '{"conv_id":"1","errors":"","status":"unlinked"}'),
        (None, None, None, "-0000000005", "unlinked", "", '{"errors":"","name":"tool","result":"x \\"y\\"","status":"unlinked"}')], key=str)


def test_a_very_long_text(spark):
    text = "word " * 400_000
    got = run(spark, [(1, "a", None, 1, "f", json.dumps({"x": 1, "y": text}))], [(1, "a", 2, text)])
    assert got[0][4] == "ok" and json.loads(got[0][6])["result"] == text == json.loads(got[0][6])["arguments"]["y"]


def test_empty(spark):
    assert run(spark, [], [], []) == []
    assert [r[4] for r in run(spark, [], [(1, "a", 1, "x")], [])] == ["orphan_result"]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    result = con.execute(ORACLES["op10_chat_formatting"])
    names = [d[0] for d in result.description]
    want = sorted((tuple(dict(zip(names, r, strict=True)).items()) for r in result.fetchall()), key=str)
    got = sorted((tuple((n, r[n]) for n in names) for r in QUERIES["op10_chat_formatting"](spark, path).collect()), key=str)
    assert got == want and len(got) == len({(d["conv_id"], d["order_key"]) for d in map(dict, got)})
    linked = [json.loads(dict(r)["record"]) for r in got]
    turns = sum(("arguments" in r) + (r["status"] in ("ok", "orphan_result", "unlinked")) for r in linked)
    assert turns == con.execute("SELECT count(*) FROM conversations").fetchone()[0]
