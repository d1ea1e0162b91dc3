"""Whether prompts and completions end in reasoning, against a plain reader of token texts, and what bridges do then."""

import random

import pytest
from pyspark.sql import functions as F

from turnframe import operators as op
from turnframe.functions import find_ids, token_id

SPELLED, CLOSED = ["<", "think", ">"], ["<", "/", "think", ">"]


def find(x, sub, last=False):
    at = [k for k in range(len(x) - len(sub) + 1) if sub and x[k : k + len(sub)] == sub]
    return (at[-1] if last else at[0]) if at else None


def after(x, header, last):
    at = find(x, header, last) if last else (0 if x[: len(header)] == header else None)
    if at is None:
        return x
    x = x[at + len(header) :]
    while x and not x[0].strip("\n"):
        x = x[1:]
    return x


def is_open(x, open_, close, prefilled, openers=()):
    at = find(x, open_)
    explicit = at is not None and not "".join(x[:at]).strip()
    if not explicit and not prefilled:
        return False
    x = x[at + len(open_) :] if explicit else x
    return find(x, close) is None and all(find(x, o) is None for o in openers)


def plain(prompt, said, stops, header, open_, close, openers):
    cut = max((k + 1 for k, p in enumerate(prompt) if p in stops), default=0)
    prefilled = is_open(after(prompt[cut:], header, True), open_, close, False)
    end = min((k for k, p in enumerate(said) if p in stops), default=len(said))
    return prefilled, is_open(after(said[:end], header, False), open_, close, prefilled, openers)


@pytest.mark.parametrize("family,stops,header,open_,close,openers", [
    ("qwen3.6", ["<|im_end|>", "<|endoftext|>"], ["<|im_start|>", "assistant", "\n"], ["<think>"], ["</think>"], [["<tool_call>"]]),
    ("kimi-k2", ["<|im_end|>"], ["<|im_assistant|>", "assistant", "<|im_middle|>"], SPELLED, CLOSED, [["<|tool_calls_section_begin|>"]]),
    ("deepseek-v3", ["<｜end▁of▁sentence｜>"], ["<｜Assistant｜>"], SPELLED, CLOSED, []),
])
def test_state(spark, family, stops, header, open_, close, openers):
    rnd = random.Random(4)
    pool = [stops[:1], header, header, open_, open_, open_, close, ["\n"], ["\n\n"], [" "], ["word"], *openers, ["<think>"], SPELLED]
    draw = lambda: [p for _ in range(rnd.randint(0, 6)) for p in rnd.choice(pool)]
    cases = [(draw(), draw()) for _ in range(300)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "id long, p array<string>, c array<string>")
    ids = rows.select("id", F.transform("p", token_id).alias("prompt_ids"), F.transform("c", token_id).alias("completion_ids"))
    got = {r["id"]: (r["prompt_open"], r["reasoning_open"]) for r in op.reasoning_state(ids, family).collect()}
    want = {k: plain(*c, stops, header, open_, close, openers) for k, c in enumerate(cases)}
    assert len({v for v in want.values()}) == 4
    assert got == want


def test_find_ids(spark):
    row = spark.range(1).select(*[find_ids(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)).cast("array<int>"), last).alias(f"x{k}") for k, (a, b, last) in enumerate([([1, 2, 1, 2], [1, 2], False), ([1, 2, 1, 2], [1, 2], True), ([1, 2], [2, 1], False), ([1], [1, 1], False), ([1, 2], [], False)])]).first()
    assert tuple(row) == (1, 3, None, None, None)


def test_bridges_from_open_reasoning(spark):
    """Without a stop the region is ended and the turn closed; with one the bridge is refused."""
    cases = [(1, ["a", "<think>", "x"], "synthesize_close"), (2, ["<think>", "x", "<|im_end|>"], "open_reasoning"), (3, ["<think>", "x"], "synthesize_close"), (4, ["<think>", "x", "</think>", "<|im_end|>"], "bridge"), (5, ["<think>", "x", "<tool_call>"], "synthesize_close")]
    rows = spark.createDataFrame([(c, ["<|im_start|>", "assistant", "\n"], said) for c, said, _ in cases], "conv_id long, p array<string>, c array<string>")
    previous = rows.select("conv_id", F.transform("p", token_id).alias("prompt_ids"), F.transform("c", token_id).alias("completion_ids"))
    new = spark.createDataFrame([(c, 3, "tool", "r") for c, *_ in cases], "conv_id long, msg_idx int, role string, content string")
    got = {r["conv_id"]: r for r in op.bridge(previous, new, "qwen3.6").collect()}
    assert {c: got[c]["status"] for c, *_ in cases} == {c: s for c, _, s in cases}
    one = lambda x: spark.range(1).select(token_id(F.lit(x)).alias("x")).first()["x"]
    close, stop = one("</think>"), one("<|im_end|>")
    assert got[2]["token_ids"] is None
    assert got[3]["token_ids"][3:7] == [one("<think>"), one("x"), close, stop] and got[1]["token_ids"][6] == stop and got[5]["token_ids"][6] == stop and got[4]["token_ids"][5:7] == [close, stop]
