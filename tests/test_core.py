"""Core operators on small literal cases, and every SQL-checked query against DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from turnframe import operators as op
from turnframe import queries as q
from turnframe.functions import coerce_argument, common_prefix, is_json, pieces, think_split, trim_to_turn_close
from turnframe.plans import FAMILIES

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def longs(*xs):
    return F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")


def test_counts_and_spans_of_literal_tokens(spark):
    toks = spark.createDataFrame([(0, 0, 0, False), (0, 1, 0, True), (0, 2, 1, False), (0, 3, 1, False), (0, 4, -1, False)], "conv_id long, pos int, owner int, sampled boolean").withColumn("content", F.col("sampled"))
    messages = spark.createDataFrame([(0, 0, "user"), (0, 1, "assistant"), (0, 2, "tool")], "conv_id long, msg_idx int, role string")
    per = {r["msg_idx"]: r for r in op.tokens_per_message(messages, toks).collect()}
    assert [(per[i]["n_tokens"], per[i]["n_sampled"], per[i]["start"], per[i]["end"]) for i in range(3)] == [(2, 1, 0, 2), (2, 0, 2, 4), (0, 0, None, None)]
    assert {(r["role"], r["spans"]) for r in op.role_spans(op.tokens_per_message(messages, toks)).collect()} == {("user", "0-2"), ("assistant", "2-4"), ("tool", "")}


def test_pieces_lose_nothing(spark):
    text = "Tab\there, é12\n\n\x0b\x0c😀 end. "
    assert "".join(one(spark, pieces(F.lit(text)))) == text


@pytest.mark.parametrize("content, want", [("<think>\na\n</think>\n\nb", ("a", "b")), ("x</think>y", ("x", "y")), ("plain", ("", "plain")), ("", ("", "")), ("<think>a</think>b</think>c", ("a", "b</think>c"))])
def test_think_split(spark, content, want):
    r, b = think_split(F.lit(content))
    assert (one(spark, r), one(spark, b)) == want


def test_turn_close_and_common_prefix(spark):
    assert one(spark, trim_to_turn_close(longs(9), longs(1, 9, 2), longs(9))) == [9, 1, 9]
    assert one(spark, trim_to_turn_close(longs(9), longs(1, 2), longs(9))) is None
    assert one(spark, trim_to_turn_close(longs(9), longs(), longs(9), F.lit(9).cast("bigint"))) == [9, 9]
    assert [one(spark, common_prefix(longs(*a), longs(*b))) for a, b in (((1, 2, 3), (1, 2, 4)), ((1,), (1, 2)), ((), (1,)), ((2,), (1,)))] == [2, 1, 0, 0]


def test_string_parameters_keep_their_text(spark):
    for text in ("1e5", "", 'say "hi"\nand go', '{"a": {"b": []}}', "-0.5"):
        value, fell = coerce_argument(F.lit(text), F.lit("string"))
        import json

        assert json.loads(one(spark, value)) == text and not one(spark, fell)
    assert one(spark, coerce_argument(F.lit("oops"), F.lit("number"))[1])


def test_every_attempt_at_a_call_is_kept(spark):
    text = 'a<tool_call>\n{"name": "f", "arguments": {"k": 1}}\n</tool_call><tool_call>{oops</tool_call><tool_call>{"name": "g", "arguments": {}}'
    rows = op.parse_hermes(spark.createDataFrame([(1, text), (2, "no call"), (3, None)], "id long, text string")).orderBy("call_idx").collect()
    assert [(r["id"], r["status"], r["name"]) for r in rows] == [(1, "ok", "f"), (1, "invalid_json", None), (1, "unclosed", None)]


def test_ties_at_the_edge_leave_the_head(spark):
    rows = [(0, p, t, lp) for p, c in enumerate(({1: -0.5, 2: -1.4, 3: -2.3}, {1: -0.9, 2: -1.6, 3: -1.6})) for t, lp in c.items()]
    got = op.sampler_head(spark.createDataFrame(rows, "resp_id long, pos int, token_id long, logprob double"), 2).collect()
    assert {(r["pos"], r["token_id"]) for r in got} == {(0, 1), (0, 2), (1, 1)}


def test_all_families_render_empty_and_null_content(spark):
    messages = spark.createDataFrame([(0, 0, "user", None), (0, 1, "assistant", "")], "conv_id long, msg_idx int, role string, content string")
    for family in FAMILIES:
        assert op.render_text(messages, family).count() == 1
        assert op.render_text(messages.limit(0), family).count() == 0


@pytest.mark.parametrize("text, want", [("1", True), ("[1, {}]", True), ('"a"', True), ("1 2", False), ("1,2", False), ('1,"b":2', False), ("", False), ("1]", False), ("1}", False), ("null", True), ("oops", False)])
def test_is_json(spark, text, want):
    assert one(spark, is_json(F.lit(text))) is want


def test_roles_that_a_format_does_not_know_raise(spark):
    messages = spark.createDataFrame([(0, 0, "critic", "x")], "conv_id long, msg_idx int, role string, content string")
    for family in FAMILIES:
        with pytest.raises(Exception, match="does not render role critic"):
            op.render_text(messages, family).collect()


def test_indices_may_start_anywhere(spark):
    rows = [("system", "s"), ("user", "hi"), ("assistant", "<think>\na\n</think>\n\nb"), ("user", "again")]
    for family in FAMILIES:
        texts = {op.render_text(spark.createDataFrame([(0, a + b * i, r, c) for i, (r, c) in enumerate(rows)], "conv_id long, msg_idx int, role string, content string"), family).first()["text"] for a, b in ((0, 1), (7, 3))}
        assert len(texts) == 1


def test_a_role_marker_after_an_assistant_is_sampled_and_its_own(spark):
    messages = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "tool", "t"), (0, 3, "tool", "u"), (0, 4, "user", "r")], "conv_id long, msg_idx int, role string, content string")
    toks = [(r["piece"], r["owner"], r["sampled"]) for r in op.tokens(messages, "glm-5").orderBy("pos").collect()]
    assert ("<|observation|>", 1, True) in toks and ("<|user|>", 4, False) in toks and [p for p, *_ in toks].count("<|observation|>") == 1


def test_a_result_keeps_its_own_name(spark):
    calls = spark.createDataFrame([(0, "c1", "look", 0)], "conv_id long, tool_call_id string, name string, call_idx int")
    results = spark.createDataFrame([(0, "c1", "mine"), (0, "c1", ""), (0, "c1", None), (0, "c2", None)], "conv_id long, tool_call_id string, name string")
    assert sorted(str(r["tool_name"]) for r in op.tool_names(calls, results).collect()) == ["None", "look", "look", "mine"]


def test_special_tokens_in_text_stay_text(spark):
    messages = spark.createDataFrame([(0, 0, "user", "<|im_end|>")], "conv_id long, msg_idx int, role string, content string")
    toks = op.tokens(messages, "qwen3").collect()
    assert sum(r["piece"] == "<|im_end|>" for r in toks) == 1


def test_a_users_events_are_never_one_row(spark):
    assert "collect_list" not in q.QUERIES["turn_close"](spark, DATA)._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if v is None or str(v) == "<NA>" or v != v else str(int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(q.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.execute(q.ORACLE_SQL[name]).df())
