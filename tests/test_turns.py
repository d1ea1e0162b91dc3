"""Logical turns against a fold over lists."""

import random

from turnframe.operators import turns

SCHEMA = "conv_id long, msg_idx int, role string, tool_call_id string, task string"
CALLS = "conv_id long, msg_idx int, call_idx int, tool_call_id string"


def plain(messages, calls):
    """[(msg_idx, logical, turn_role, turn_task, block)] of one conversation, messages in order."""
    merged, order = [], {}
    for idx, role, call, task in messages:
        open_ = merged and merged[-1]["role"] == "user"
        if open_ and (role == "tool" or role == "user" and merged[-1]["task"] is None):
            merged[-1]["blocks"].append((idx, role, call))
        else:
            merged.append({"role": "user" if role == "tool" else role, "task": None if role == "tool" else task, "blocks": [(idx, role, call)]})
    out = []
    for k, turn in enumerate(merged):
        blocks = turn["blocks"]
        asked = calls.get(blocks[0][0]) if turn["role"] == "assistant" else None
        if asked:
            order = {c: n for n, c in enumerate(asked) if c}
        elif turn["role"] == "user" and order:
            results = iter(sorted((b for b in blocks if b[1] == "tool"), key=lambda b: order.get(b[2], 0)))
            blocks = [next(results) if b[1] == "tool" else b for b in blocks]
        out += [(b[0], k, turn["role"], turn["task"], n) for n, b in enumerate(blocks)]
    return sorted(out)


def drawn(rnd):
    messages, calls, ids = [], {}, ["x"]
    for k in range(rnd.randint(1, 16)):
        role = rnd.choice(["user", "user", "tool", "tool", "tool", "assistant", "system", "developer"])
        idx = 5 + 3 * k
        messages.append((idx, role, rnd.choice([*ids, "lost", None]) if role == "tool" else None, rnd.choice([None, None, "t"])))
        if role == "assistant" and rnd.random() < 0.8:
            calls[idx] = [rnd.choice([f"c{idx}_{n}", "again", None]) for n in range(rnd.randint(1, 4))]
            ids = [c for c in calls[idx] if c] or ["x"]
    return messages, calls


def test_turns(spark):
    rnd = random.Random(6)
    cases = [drawn(rnd) for _ in range(300)]
    rows = spark.createDataFrame([(c, *m) for c, (ms, _) in enumerate(cases) for m in ms], SCHEMA)
    asked = spark.createDataFrame([(c, i, n, x) for c, (_, cs) in enumerate(cases) for i, xs in cs.items() for n, x in enumerate(xs)], CALLS)
    got = {}
    for r in turns.ordered_results(turns.logical_turns(rows), asked).collect():
        got.setdefault(r["conv_id"], []).append((r["msg_idx"], r["logical"], r["turn_role"], r["turn_task"], r["block"]))
    assert {c: sorted(v) for c, v in got.items()} == {c: plain(*case) for c, case in enumerate(cases)}


def test_result_order(spark):
    new = [(1, [("tool", "b", None), ("user", None, None), ("tool", "a", None)]), (2, [("tool", "lost", None)]), (3, [("user", None, "t"), ("tool", "a", None)]), (4, [("user", None, None)]), (5, [("tool", "a", None)]), (6, [("tool", "a", None), ("tool", "b", None)])]
    rows = spark.createDataFrame([(c, 10 + k, *m) for c, ms in new for k, m in enumerate(ms)], SCHEMA)
    ids = spark.createDataFrame([(c, k, x) for c, xs in ((1, "ab"), (2, "a"), (3, "a"), (4, "a"), (6, "aba")) for k, x in enumerate(xs)], "conv_id long, call_idx int, tool_call_id string")
    got = {r["conv_id"]: r["msg_indices"] for r in turns.result_order(rows, ids).collect()}
    assert got == {1: [12, 11, 10], 2: None, 3: None, 4: [10], 5: None, 6: [11, 10]}
    assert turns.result_order(rows.limit(0), ids).collect() == []
