"""Parsers of completion texts on small literal cases."""

import json

import pytest

from turnframe.operators import responses as r


def texts(spark, *t):
    return spark.createDataFrame(list(enumerate(t)), "id long, text string")


def calls(frame):
    return [(x["id"], x["call_idx"], x["name"], x["arguments"], x["status"]) for x in frame.orderBy("id", "call_idx").collect()]


def test_only_the_initial_region_is_reasoning(spark):
    t = texts(spark, " <think>a</think>b<think>c</think>", "b</think>", "<think>open", None, "", "<think>x<tool_call>{}")
    got = {x["id"]: tuple(x)[1:4] for x in r.read_response(t, r.GRAMMARS["qwen3"]).collect()}
    assert got == {0: ("a", "b<think>c</think>", True), 1: (None, "b</think>", True), 2: ("open", "", False), 3: (None, "", True), 4: (None, "", True), 5: ("x", "", True)}
    assert r.read_response(texts(spark, "a</think>b"), r.GRAMMARS["deepseek-v3"], prefilled=True).first()["reasoning"] == "a"


def test_tool_markup_inside_reasoning_is_no_call(spark):
    t = texts(spark, "<think><tool_call><function=f></tool_call></think>done")
    assert calls(r.parse_xml(r.read_response(t, r.GRAMMARS["qwen3.5"]))) == []


def test_types_decide_what_is_text(spark):
    params = spark.createDataFrame([("f", "s", "string"), ("f", "u", "maybe_string")], "name string, key string, type string")
    t = texts(spark, "<tool_call><function=f><parameter=s>1</parameter><parameter=u>x</parameter><parameter=n>1</parameter><parameter=s>2</parameter></tool_call><tool_call><function=f><parameter=n>x</parameter></tool_call>")
    got = calls(r.parse_xml(r.read_response(t, r.GRAMMARS["qwen3.5"]), params))
    assert [json.loads(c[3]) for c in got] == [{"s": "2", "u": "x", "n": 1}, {"n": "x"}] and [c[4] for c in got] == ["ok", "invalid_json"]


def test_a_start_inside_a_block_is_part_of_it(spark):
    t = texts(spark, "<tool_call>a<tool_call>b</tool_call><tool_call>c")
    assert calls(r.parse_laguna(r.read_response(t, r.GRAMMARS["laguna"]))) == [(0, 0, "a<tool_call>b", "{}", "ok"), (0, 1, None, None, "unclosed")]


def test_sections_and_fences(spark):
    call = "<｜tool▁call▁begin｜>function<｜tool▁sep｜>{}<｜tool▁call▁end｜>"
    t = texts(spark, "<｜tool▁calls▁begin｜>" + call.format('f\n```json\n{"a": 1}\n```') + call.format("g") + call.format("g\noops") + "<｜tool▁calls▁end｜>" + call.format("late"))
    assert [c[2:] for c in calls(r.parse_deepseek(r.read_response(t, r.GRAMMARS["deepseek-v3"])))] == [("f", '{"a": 1}', "ok"), ("g", "{}", "ok"), ("g", '"oops"', "invalid_json")]


def test_a_call_without_arguments_ends_the_list(spark):
    t = texts(spark, "<|tool_calls_section_begin|><|tool_call_begin|>functions.a.b:3<|tool_call_argument_begin|><|tool_call_end|><|tool_call_begin|>functions.f:0")
    got = r.parse_kimi(r.read_response(t, r.GRAMMARS["kimi-k2"])).orderBy("call_idx").collect()
    assert [(x["name"], x["status"], x["tool_call_id"]) for x in got] == [("a.b", "invalid_json", "functions.a.b:3"), (None, "malformed", None)]


def test_channels(spark):
    m = "<|start|>assistant<|channel|>{}<|message|>{}"
    t = texts(spark, m.format("analysis", "why") + m.format("commentary to=functions.f", "{}") + "<|call|>" + m.format("final", "x<|return|>y"), "no message", m.format("analysis", ""))
    assert {x["id"]: tuple(x)[1:] for x in r.harmony_response(t).collect()} == {0: ("why", "x", True), 1: (None, "", True), 2: ("", "", False)}
    assert calls(r.parse_harmony(t)) == [(0, 0, "f", "{}", "ok")]


@pytest.mark.parametrize("family", sorted(r.GRAMMARS))
def test_empty_tables(spark, family):
    assert r.read_response(texts(spark, "x").limit(0), r.GRAMMARS[family]).count() == 0


def test_completions_of_one_file_piece_are_shared_by_all_cores(spark):
    rows = spark.range(400, numPartitions=1).selectExpr("id", "'<tool_call>{\"name\": \"f\"}</tool_call>' AS text")
    parsed = r.parse_hermes(rows)
    sizes = [n for n in parsed.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(sizes) == 400 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
