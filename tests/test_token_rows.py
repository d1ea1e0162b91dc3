"""Tokens leave segments as rows last, and bridges have none: what a task holds is segments, not tokens."""

import re

from pyspark.sql import functions as F

from turnframe import operators as op
from turnframe.plans import segments

SEGMENT = "conv_id long, msg_idx int, seg_idx int, kind string, text string, owner int, sampled boolean, content_from int, content_to int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def messages(spark):
    rows = [(c, i, r, t) for c in range(3) for i, (r, t) in enumerate([("user", "héllo 12\n\n𝄞x"), ("assistant", "a b"), ("tool", "r"), ("user", "c")][: 4 - c])]
    return spark.createDataFrame(rows, "conv_id long, msg_idx int, role string, content string")


def test_tokens_of_segments_against_a_loop(spark):
    texts = ["héllo 12\n\n𝄞x", "a", "  b\t7"]
    rows = [(1, 3, i, "T", x, 3, False, lo, hi) for i, (x, lo, hi) in enumerate((x, lo, hi) for x in texts for lo in range(-1, 5) for hi in (0, 2, 6, 99))]
    got = [(r["pos"], r["piece"], r["content"]) for r in op.segment_tokens(spark.createDataFrame(rows, SEGMENT)).orderBy("pos").collect()]
    want = []
    for r in rows:
        at = 0
        for x in re.findall(r"[^\W\d_]+|[0-9]|\n+|[ \t\r]+|[^\w\s]|.", r[4], re.S):
            want.append((len(want), x, r[7] <= at < r[8]))
            at += len(x)
    assert got == want


def test_no_token_row_is_sorted(spark):
    lines = plan(op.tokens(messages(spark), "qwen3"))
    cut = next(i for i, x in enumerate(lines) if "Generate posexplode(pieces" in x)
    assert all(i > cut for i, x in enumerate(lines) if re.search(r"\bWindow\b|\bSort\b|\bAggregate\b", x))


def test_a_bridge_renders_twice_and_has_no_token_rows(spark):
    said = messages(spark)
    previous = op.turn_ids(segments(said, "llama-3"), spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "conv_id long, turn int"))
    lines = plan(op.bridge(previous, said.where("msg_idx > 1"), "llama-3"))
    assert sum("Generate posexplode(" in x for x in lines) == 2 and not any("posexplode(pieces" in x for x in lines)


def test_ids_of_a_turn_are_those_of_its_tokens(spark):
    said = messages(spark)
    for family in ("qwen3", "llama-3", "kimi-k2"):
        toks = {}
        for r in op.tokens(said, family).orderBy("conv_id", "pos").collect():
            toks.setdefault(r["conv_id"], []).append((r["token_id"], r["owner"] == 1 and r["sampled"]))
        got = op.turn_ids(segments(said, family), said.select("conv_id", F.lit(1).alias("turn")).distinct()).collect()
        assert len(got) == 3
        for r in got:
            ids, mine = zip(*toks[r["conv_id"]])
            first, end = mine.index(True), len(mine) - mine[::-1].index(True)
            assert (tuple(r["prompt_ids"]), tuple(r["completion_ids"]), tuple(r["token_ids"])) == (ids[:first], ids[first:end], ids)
