"""Training samples on small literal cases."""

from pyspark.sql import functions as F

from turnframe import operators as op
from turnframe.functions import token_id

TOKENS = "conv_id long, pos long, piece string, owner int, sampled boolean, content boolean"


def made(spark, rows, roles=("user", "assistant"), **more):
    messages = spark.createDataFrame([(1, 10 + k, r) for k, r in enumerate(roles)], "conv_id long, msg_idx int, role string")
    toks = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], TOKENS).withColumn("token_id", token_id(F.col("piece")))
    r = op.training_samples(messages, toks, "qwen3", **more).first()
    stop = spark.range(1).select(token_id(F.lit("<|im_end|>")).alias("x")).first()["x"]
    return r["loss_mask"], r["fault"], r["token_ids"] and r["token_ids"][-1] == stop


OPEN = [("u", 10, False, True), ("a", 11, True, True), ("g", -1, False, False)]
CLOSED = [*OPEN[:2], ("<|im_end|>", 11, True, True), ("\n", 11, False, False)]


def test_final_stop(spark):
    assert made(spark, OPEN) == ([False, True, False], None, False)
    assert made(spark, OPEN, final_stop=True) == ([False, True, False, True], None, True)
    assert made(spark, CLOSED, final_stop=True)[0] == [False, True, True, False]
    assert made(spark, OPEN, roles=("assistant", "user"), final_stop=True)[0] == [False, True, False]
    assert made(spark, OPEN, final_stop=True, roles=("user", "assistant"), body_roles=("user",))[0] == [True, True, False, True]


def test_masks_and_signal(spark):
    mask = lambda *m: spark.createDataFrame([(1, list(m))], "conv_id long, mask array<int>")
    assert made(spark, OPEN, final_stop=True, masks=mask(1, 0))[0] == [False, False, False, False]
    assert made(spark, OPEN, final_stop=True, masks=mask(0, 1))[0] == [False, True, False, True]
    assert made(spark, OPEN, masks=mask(1))[:2] == (None, "length") and made(spark, OPEN, masks=mask(1, 2))[:2] == (None, "value")
    blind = [(p, o, None, None) for p, o, *_ in OPEN]
    assert made(spark, blind)[:2] == (None, "missing_signal")
    messages = spark.createDataFrame([(1, 10, "user"), (1, 11, "assistant")], "conv_id long, msg_idx int, role string")
    toks = spark.createDataFrame([(1, k, *r) for k, r in enumerate(blind)], TOKENS).withColumn("token_id", token_id(F.col("piece")))
    got = op.training_samples(messages, toks, "qwen3", roles=F.col("role") == "assistant", body_roles=("user",), final_stop=True).first()
    assert got["loss_mask"] == [False, True, False]
