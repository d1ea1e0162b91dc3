"""The nested argument grammar against a plain recursive reader, and its way back."""

import json
import random

import pytest

from turnframe.operators import nested

Q = nested.QUOTE
CASES = {
    '{city:<|"|>Paris<|"|>,n:3}': '{"city":"Paris","n":3}', "{}": "{}", "[]": "[]", " [ ] ": "[]", "{a:[1,{b:null}],c:true}": '{"a":[1,{"b":null}],"c":true}', "{a: some words }": '{"a":"some words"}',
    '{<|"|>a:b<|"|>:<|"|>{,"}<|"|>}': '{"a:b":"{,\\"}"}', "{a:1,a:2,b:3,a:4}": '{"a":4,"b":3}', "{u:http://x/y}": '{"u":"http://x/y"}', '{s:<|"|><|"|>}': '{"s":""}', "7": "7", '<|"|>x<|"|>': '"x"', '{a:"q"}': '{"a":"q"}', "{a:1e5}": '{"a":1e5}',
}
FAULTS = {
    "": "missing value", None: "missing value", "{a:1": "unclosed object", "[1": "unclosed array", "{a}": "missing colon", "{:1}": "missing key", '{a:<|"|>x}': "unclosed string", "{a:1}}": "trailing input", "{a:}": "missing value",
    "[1,]": "missing value", "{a:1,}": "missing key", '{a:<|"|>x<|"|>y}': "expected comma or end", "{a:[1}": "expected comma or end", "{": "missing key", "{a:1,": "missing key", "[1,": "missing value",
}


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r["id"]: (r["json"], r["fault"]) for r in nested.read_nested(rows, "text").collect()}


def test_reads(spark):
    got = read(spark, list(CASES))
    assert {t: got[k] for k, t in enumerate(CASES)} == {t: (v, None) for t, v in CASES.items()}


def test_faults(spark):
    got = read(spark, list(FAULTS))
    assert {t: got[k] for k, t in enumerate(FAULTS)} == {t: (None, v) for t, v in FAULTS.items()}


def value(rnd, depth):
    kind = rnd.randint(0, 5 if depth else 3)
    if kind == 0:
        return rnd.choice([True, False, None])
    if kind == 1:
        return rnd.randint(-99, 99)
    if kind < 4:
        return rnd.choice(["", "plain", 'with "quotes" \\ and\nlines', "{[:,]}", "日本🙂", "x" * 3000])
    if kind == 4:
        return [value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(["a", "B", "c d", "Ä", "zz"]) + str(k): value(rnd, depth - 1) for k in range(rnd.randint(0, 4))}


def written(x):
    """The grammar by plain recursion."""
    if isinstance(x, str):
        return Q + x + Q
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{written(v)}" for k, v in sorted(x.items(), key=lambda kv: kv[0].lower())) + "}"
    return "[" + ",".join(map(written, x)) + "]" if isinstance(x, list) else json.dumps(x)


def test_round_trip(spark):
    rnd = random.Random(8)
    values = [{"v": value(rnd, 5)} for _ in range(80)]
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=bool(k % 2), indent=k % 3 or None)) for k, v in enumerate(values)], "id long, j string")
    got = nested.read_nested(nested.write_nested(rows, "j"), "nested").collect()
    assert {r["id"]: r["nested"] for r in got} == {k: written(v) for k, v in enumerate(values)}
    assert all(r["fault"] is None and json.loads(r["json"]) == values[r["id"]] for r in got)


def test_depth_and_length(spark):
    deep = "[" * 60 + "1" + "]" * 60
    long = '{s:<|"|>' + "x{" * 500_000 + '<|"|>}'
    got = read(spark, [deep, long])
    assert got[0] == (deep, None) and got[1][1] is None and len(got[1][0]) > 1_000_000


@pytest.mark.parametrize("raw,closed,want", [
    ('call:f{a:<|"|>x<|"|>}', True, ("f", '{"a":"x"}', "ok")), ("call: g {}", True, ("g", "{}", "unknown_tool")), ("call:{a:1}", True, (None, '{"a":1}', "missing_name")),
    ("call:f{a:}", True, ("f", None, "invalid_json")), ("f{}", True, (None, None, "malformed")), ("call:f{a", True, (None, None, "malformed")), ("call:f{", False, (None, None, "unclosed")),
])
def test_calls(spark, raw, closed, want):
    attempts = spark.createDataFrame([(1, 0, raw, closed)], "id long, call_idx int, raw string, closed boolean")
    r = nested.parse_gemma_call(attempts, spark.createDataFrame([("f",)], "name string")).first()
    assert (r["name"], r["arguments"], r["status"]) == want
