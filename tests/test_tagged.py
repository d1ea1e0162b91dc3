"""The transducer against a plain state machine over token lists, and the readers on token arrays."""

import json
import random

from turnframe.operators import responses as r

SCHEMA = "id long, pieces array<string>"


def completions(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA)


def plain_glm(pieces):
    """GLM's grammar over tokens: (reasoning, content, complete, regions)."""
    for k, p in enumerate(pieces):
        if p in ("<|endoftext|>", "<|user|>", "<|observation|>"):
            pieces = pieces[:k]
            break
    state, opened, thought, said, regions, begun = "content", False, "", "", [], None
    for k, p in enumerate(pieces):
        if state == "tool":
            if p == "</tool_call>":
                regions.append(("".join(pieces[begun : k + 1]), begun, k + 1, True))
                state = "content"
        elif p in ("<think>", "</think>"):
            state = "reasoning" if p == "<think>" else "content"
            opened |= p == "<think>"
        elif p == "<tool_call>":
            state, begun = "tool", k
        elif state == "reasoning":
            thought += p
        else:
            said += p
    if state == "tool":
        regions.append(("".join(pieces[begun:]), begun, len(pieces), False))
    thought, open_ = thought.rstrip(), state == "reasoning"
    return (thought if open_ else thought or None, said.strip() if regions else said, not open_, regions)


def plain_dsml(pieces):
    """DeepSeek-V4's grammar: markers of markup are found in the text between atomic tokens, and cover whole tokens."""
    marks = {"<｜DSML｜tool_calls>": "section", "<｜DSML｜toolcalls>": "section", "<｜DSML｜tool>": "section", "</｜DSML｜tool_calls>": "shut", "<｜DSML｜invoke": "tool", "</｜DSML｜invoke>": "end"}
    if "<｜end▁of▁sentence｜>" in pieces:
        pieces = pieces[: pieces.index("<｜end▁of▁sentence｜>")]
    lexemes, at = [], 0
    while at < len(pieces):
        if pieces[at] in ("<think>", "</think>"):
            lexemes.append((pieces[at], pieces[at], at, at + 1))
            at += 1
            continue
        stop = next((k for k in range(at, len(pieces)) if pieces[k] in ("<think>", "</think>")), len(pieces))
        of = [k for k in range(at, stop) for _ in pieces[k]]
        text, c, begun = "".join(pieces[at:stop]), 0, 0
        while c < len(text):
            mark = max((m for m in marks if text.startswith(m, c)), key=len, default=None)
            if mark:
                lexemes += [("text", text[begun:c], 0, 0), (marks[mark], mark, of[c], of[c + len(mark) - 1] + 1)]
                c += len(mark)
                begun = c
            else:
                c += 1
        lexemes.append(("text", text[begun:], 0, 0))
        at = stop
    state, opened, thought, said, regions, held, begun = "content", False, "", "", [], "", 0
    for kind, text, lo, hi in lexemes:
        if state == "tool":
            if kind in ("end", "shut"):
                regions.append((held + (text if kind == "end" else ""), begun, hi if kind == "end" else lo, kind == "end"))
                state = "between"
            else:
                held += text
        elif kind in ("<think>", "</think>") and state in ("content", "reasoning"):
            state = "reasoning" if kind == "<think>" else "content"
            opened |= kind == "<think>"
        elif kind == "section" and state in ("content", "reasoning", "between"):
            state = "preamble"
        elif kind == "tool" and state in ("content", "preamble", "between"):
            state, held, begun = "tool", text, lo
        elif state == "reasoning":
            thought += text
        elif state == "content":
            said += text
    if state == "tool":
        regions.append((held, begun, len(pieces), False))
    said = said if said.strip() else ""
    if regions and said.endswith("\n\n"):
        said = said[:-2]
    thought, open_ = thought.rstrip(), state == "reasoning"
    return (thought if open_ else thought or None, said, not open_, regions)


def read(spark, rows, family):
    found = r.read_response(completions(spark, *rows), r.GRAMMARS[family]).orderBy("id").collect()
    return [(x["reasoning"], x["content"], x["complete"], [(g["text"].replace("￿", ""), g["start"], g["end"], g["closed"]) for g in x["regions"]]) for x in found]


def drawn(rnd, pool):
    return [[rnd.choice(pool) for _ in range(rnd.randint(0, 14))] for _ in range(400)]


def test_glm_grammar(spark):
    rows = drawn(random.Random(1), ["<think>", "</think>", "<tool_call>", "</tool_call>", "<", "tool_call", ">", " ", "\n\n", "word", "日本", "<|user|>", "<arg_key>"])
    assert read(spark, rows, "glm") == [plain_glm(x) for x in rows]


def test_dsml_grammar(spark):
    """Markers cut in all ways, also in the middle of a token that holds other text."""
    rows = drawn(random.Random(2), ["<think>", "</think>", "<", "</", "｜DSML｜", "tool_calls>", "invoke", "invoke>", "\n\n<", ">x", "tool", "_calls>", "word", "\n\n", " <｜DSML｜invoke name", "</｜DSML｜invoke>", "<｜DSML｜tool_calls>", "<｜end▁of▁sentence｜>"])
    want = [plain_dsml(x) for x in rows]
    assert sum(len(w[3]) for w in want) > 80
    assert read(spark, rows, "deepseek-v4") == want


def calls(frame, *columns):
    return [tuple(x[c] for c in columns) for x in frame.orderBy("id", "call_idx").collect()]


def test_spelled_markers_are_text(spark):
    spelled = ["<", "tool_call", ">", "{}", "</", "tool_call", ">"]
    rows = completions(spark, ["a", *spelled], ["<think>", *spelled, "</think>", "b"], ["<", "think", ">", "x"])
    read = {x["id"]: x for x in r.read_response(rows, r.GRAMMARS["qwen3"]).collect()}
    assert [(read[k]["reasoning"], read[k]["content"], len(read[k]["regions"])) for k in range(3)] == [(None, "a<tool_call>{}</tool_call>", 0), ("<tool_call>{}</tool_call>", "b", 0), (None, "<think>x", 0)]


def test_hermes_calls(spark):
    ok = '{"name": "f", "arguments": {"a": 1}}'
    rows = completions(
        spark, ["x", "<tool_call>", ok, "</tool_call>", "y", "<tool_call>", '{"name": ""}', "</tool_call>", "<tool_call>", "[]", "</tool_call>", "<tool_call>", "{", "</tool_call>", "<tool_call>", ok],
        ["<think>", "<tool_call>", ok, "</tool_call>", "</think>", "done"], ["<tool_call>", '{"name": "f", "arguments": "<tool_call>"}', "</tool_call>", "<|im_end|>", "<tool_call>", ok, "</tool_call>"], ["<tool_call>", '{"name":"g"}', "</tool_call>"],
    )
    tools = spark.createDataFrame([("f",)], "name string")
    assert calls(r.parse_hermes(rows, tools), "id", "call_idx", "name", "arguments", "status", "start", "end") == [
        (0, 0, "f", '{"a":1}', "ok", 1, 4), (0, 1, None, "{}", "missing_name", 5, 8), (0, 2, None, "{}", "missing_name", 8, 11), (0, 3, None, None, "invalid_json", 11, 14), (0, 4, None, None, "unclosed", 14, 16),
        (2, 0, "f", '"<tool_call>"', "ok", 0, 3), (3, 0, "g", "{}", "unknown_tool", 0, 3),
    ]


def test_glm_calls(spark):
    value = ["<arg_key>", "k", "</arg_key>", "<arg_value>", " see ", "<tool_call>", " x", "</arg_value>"]
    rows = completions(spark, ["<tool_call>", "f\n", *value, "</tool_call>"], ["<think>", "a", "</think>", "b", "<tool_call>", "f", "<arg_key>", "k", "</arg_key>", "</tool_call>"], ["<tool_call>", "f", "<", "arg_key", ">", "</tool_call>", "<tool_call>", " ", "</tool_call>"])
    tools = spark.createDataFrame([("f",)], "name string")
    assert calls(r.parse_glm(rows, tools), "id", "name", "arguments", "status", "start", "end") == [
        (0, "f", '{"k":"see <tool_call> x"}', "invalid_json", 0, 11), (1, "f", "{}", "malformed", 4, 10), (2, "f<arg_key>", "{}", "unknown_tool", 0, 6), (2, None, "{}", "missing_name", 6, 9),
    ]


def test_markup_must_tile_a_call(spark):
    head, tail = '<｜DSML｜invoke name="f">\n', "</｜DSML｜invoke>"
    p = lambda k, v, s="false": f'<｜DSML｜parameter name="{k}" string="{s}">{v}</｜DSML｜parameter>'
    bodies = [p("a", "1") + "\n" + p("b", "1", "true") + "\n", p("a", "1") + "debris", p("a", "1") + p("a", "2"), p("a", "x y"), ""]
    rows = spark.createDataFrame([(k, f"text\n\n<｜DSML｜tool_calls>\n{head}{b}{tail}") for k, b in enumerate(bodies)] + [(9, f"<｜DSML｜invoke>{tail}"), (10, head.replace("f", "") + tail), (11, head + p("a", "1"))], "id long, text string")
    read = r.read_response(rows, r.GRAMMARS["deepseek-v4"])
    assert {x["id"]: x["content"] for x in read.collect()}[0] == "text"
    assert calls(r.parse_deepseek_v4(read), "id", "name", "arguments", "status") == [
        (0, "f", '{"a":1,"b":"1"}', "ok"), (1, "f", '{"a":1}', "malformed"), (2, "f", '{"a":1}', "malformed"), (3, "f", '{"a":"x y"}', "invalid_json"), (4, "f", "{}", "ok"),
        (9, None, "{}", "missing_name"), (10, "", "{}", "missing_name"), (11, "f", '{"a":1}', "unclosed"),
    ]


def test_llama_calls_end_at_a_stop(spark):
    rows = spark.createDataFrame([(0, '<|start_header_id|>assistant<|end_header_id|>\n\n{"name": "f", "parameters": {"a": [1]}}<|eot_id|>x'), (1, '{"name": ""}'), (2, '{"name": "f"}'), (3, None)], "id long, text string")
    assert [tuple(x) for x in r.parse_llama(rows).orderBy("id").collect()] == [(0, "", "f", '{"a":[1]}', 3, 31), (1, '{"name": ""}', None, None, None, None), (2, "", "f", "{}", 0, 10), (3, "", None, None, None, None)]


def test_empty_reasoning_by_format(spark):
    rows = spark.createDataFrame([(0, "<think></think>a")], "id long, text string")
    got = {f: r.read_response(rows, r.GRAMMARS[f]).first()["reasoning"] for f in r.GRAMMARS if f != "hy3"}
    assert {f for f, x in got.items() if x == ""} == {"qwen3.5"} and {x for f, x in got.items() if f != "qwen3.5"} == {None}


def test_a_tool_declared_twice(spark):
    schema = lambda t: json.dumps({"properties": {"k": {"type": t}}})
    tools = spark.createDataFrame([("f", schema("string"), 0), ("f", schema("integer"), 1)], "name string, parameters string, tool_idx int")
    rows = spark.createDataFrame([(0, "<tool_call><function=f><parameter=k>1</parameter></tool_call>")], "id long, text string")
    assert calls(r.parse_xml(r.read_response(rows, r.GRAMMARS["qwen3.5"]), r.tool_params(tools)), "arguments") == [('{"k":1}',)]
    both = r.tool_params(tools.where("tool_idx = 0")).union(r.tool_params(tools.where("tool_idx = 1")))
    assert calls(r.parse_xml(r.read_response(rows, r.GRAMMARS["qwen3.5"]), both), "status") == [("ok",)]


def test_long_arguments_cost_no_stack(spark):
    from pyspark.sql import functions as F

    from turnframe.functions import argument_texts, spaced_json

    long = json.dumps({"a": {"s": 'x"' * 500_000, "n": [1, 2]}}, separators=(",", ":"))
    row = spark.createDataFrame([(long,)], "j string").select(spaced_json(F.col("j")).alias("s"), argument_texts(F.col("j")).alias("t")).first()
    assert row["s"] == json.dumps(json.loads(long)) and json.loads(row["t"][0]["v"]) == json.loads(long)["a"]
