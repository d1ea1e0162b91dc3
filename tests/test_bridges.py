"""Bridges and tool calls in prompts on small literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from turnframe import operators as op
from turnframe.functions import argument_texts, spaced_json, token_id
from turnframe.plans import CALLS

MESSAGE = f"conv_id long, msg_idx int, role string, content string, calls {CALLS}, name string, tool_call_id string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rendered(spark, family, *rows):
    return op.render_text(spark.createDataFrame([(0, i, *r, *[None] * (5 - len(r))) for i, r in enumerate(rows)], MESSAGE), family).first()["text"]


def test_spaces_as_a_json_writer_puts_them(spark):
    for value in ({"a": [1, "x,y:z", {"b": 'q"\\,'}], "": None}, [], "a:b", {"é": {}}):
        compact = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        assert one(spark, spaced_json(F.lit(compact))) == json.dumps(value, ensure_ascii=False)


def test_argument_texts(spark):
    text = '{"s": "1", "t": true, "n": null, "o": {"b": 1, "a": [2, 3]}, "e": ""}'
    for words, want in ((False, ["1", "true", "null", '{"b": 1, "a": [2, 3]}', ""]), (True, ["1", "True", "None", '{"b": 1, "a": [2, 3]}', ""])):
        assert [x["v"] for x in one(spark, argument_texts(F.lit(text), words))] == want
    for bad in ("oops", "[1]", "", None):
        assert one(spark, argument_texts(F.lit(bad).cast("string"))) == []


def test_a_result_is_named(spark):
    text = rendered(spark, "kimi-k2", ("user", "q"), ("tool", "r", None, "look", "functions.look:0"))
    assert "<|im_system|>look<|im_middle|>## Return of functions.look:0\nr<|im_end|>" in text


def test_llama_takes_one_call_and_quotes_results(spark):
    call = ("1", "f", "{}")
    assert '{"name": "f", "parameters": {}}<|eot_id|>' in rendered(spark, "llama-3", ("user", "q"), ("assistant", "dropped", [call]))
    assert '"a\\"b"<|eot_id|>' in rendered(spark, "llama-3", ("user", "q"), ("tool", 'a"b'))
    with pytest.raises(Exception, match="one tool call"):
        rendered(spark, "llama-3", ("user", "q"), ("assistant", "", [call, call]))


def test_what_a_bridge_keeps_and_refuses(spark):
    ids = lambda *x: one(spark, F.array(*[token_id(F.lit(t)) for t in x]))
    end = "<|im_end|>"
    previous = spark.createDataFrame([(i, [] if i == 4 else [7], c) for i, c in enumerate([ids("a", end, "x"), ids("a"), ids("a", end), ids("a", end), ids("a", end), ids("a", end)])], "conv_id long, prompt_ids array<bigint>, completion_ids array<bigint>")
    new = spark.createDataFrame([(0, 9, "tool", "r"), (1, 9, "tool", "r"), (2, 9, "user", "q"), (3, 9, "assistant", "a"), (4, 9, "tool", "r"), (0, 10, "tool", "s")], "conv_id long, msg_idx int, role string, content string")
    got = {r["conv_id"]: r for r in op.bridge(previous, new, "qwen3").collect()}
    assert [got[i]["status"] for i in range(6)] == ["bridge", "synthesize_close", "user_query", "assistant", "no_prompt", "no_messages"]
    assert got[0]["token_ids"][:4] == [7, *ids("a", end, "\n")] and got[1]["token_ids"][:4] == [7, *ids("a", end, "\n")] and got[2]["token_ids"] is None
    with pytest.raises(ValueError, match="no bridge"):
        op.bridge_extension(new, "glm-5")


def test_a_late_system_message_is_refused_where_the_format_does(spark):
    rows = (("system", "a"), ("user", "b"), ("system", "c"))
    for family in ("qwen3.5", "qwen3.6"):
        assert "a" in rendered(spark, family, *rows[:2])
        with pytest.raises(Exception, match="at the beginning only"):
            rendered(spark, family, *rows)
    assert "c" in rendered(spark, "qwen3", *rows)
