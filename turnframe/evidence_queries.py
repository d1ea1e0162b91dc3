"""Registered queries on packed evidence: a response of each conversation, a token a turn, with one to three candidates each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.operators import evidence as ev
from turnframe.registry import query
from turnframe.sources import table

_ENTRIES = """e AS (SELECT conv_id AS id, turn, (conv_id + turn) % 3 + 1 AS k FROM conversations),
    c AS (SELECT id, turn, k, unnest(generate_series(1, k)) AS j FROM e)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, completion_ids, entries), both in order of turns."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", ((F.col("conv_id") + F.col("turn")) % 3 + 1).alias("k"))
    entry = F.transform(F.sequence(F.lit(1).cast("long"), F.col("k")), lambda j: F.struct((F.col("turn") * 70_000 + j).alias("token_id"), (-j / 4).alias("logprob")))
    sampled = F.col("turn") * 70_000 + F.when(F.col("id") % 5 == 1, 9).otherwise(F.col("k"))
    listed = turns.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", sampled.alias("s"), entry.alias("e")))).alias("t"))
    return listed.select("id", F.transform("t", lambda x: x["s"]).alias("completion_ids"), F.transform("t", lambda x: x["e"]).alias("entries"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    flat = ev.pack_rows(rows).join(rows.select("id", "completion_ids"), "id")
    offsets = F.transform(F.sequence(F.lit(0), F.size("counts")), lambda i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    wrong = F.when(F.col("id") % 5 == 3, 1).otherwise(0)
    shaped = flat.withColumn("offsets", F.transform(offsets, lambda x, i: x + F.when(i == F.size("counts"), wrong).otherwise(0)))
    return shaped.select("id", "completion_ids", F.when(F.col("id") % 5 == 2, "other").otherwise(ev.FORMAT).alias("format"), ev.base64_text(F.concat(ev.write_u32(F.col("ids")), ev.write_f32(F.col("logprobs")))).alias("data"), "offsets", F.lit(-1).alias("num_top"), "counts", "ids")


@query(f"""WITH {_ENTRIES}, h AS (SELECT id, turn, j, printf('%08x', turn * 70000 + j) AS x, CASE j WHEN 1 THEN '000080be' WHEN 2 THEN '000000bf' ELSE '000040bf' END AS f FROM c)
    SELECT id, md5(to_base64(unhex(string_agg(x[7:8] || x[5:6] || x[3:4] || x[1:2], '' ORDER BY turn, j) || string_agg(f, '' ORDER BY turn, j)))) AS data_md5 FROM h GROUP BY 1""")
def packed_evidence(spark, sf_dir):
    """What a response's ids and log-probabilities are when packed."""
    return _packed(spark, sf_dir).select("id", F.md5(F.col("data").cast("binary")).alias("data_md5"))


@query(f"""WITH {_ENTRIES} SELECT id, CASE id % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'format' WHEN 3 THEN 'length' END AS fault, CASE WHEN id % 5 IN (0, 4) THEN string_agg((-k / 4)::DECIMAL(9, 2)::VARCHAR, ',' ORDER BY turn) END AS logprobs FROM e GROUP BY 1""")
def sampled_evidence(spark, sf_dir):
    """Log-probabilities of sampled tokens, read from packed responses of which some are broken."""
    read = ev.sampled_logprobs(ev.decode_compact(_packed(spark, sf_dir)))
    return read.select("id", "fault", F.array_join(F.transform("logprobs", lambda x: x.cast("decimal(9,2)").cast("string")), ",").alias("logprobs"))


@query(f"""WITH {_ENTRIES} SELECT id, CASE id % 5 WHEN 1 THEN 'support' WHEN 4 THEN 'count' END AS fault, CASE WHEN id % 5 NOT IN (1, 4) THEN (SELECT string_agg(turn * 70000 + j, ',' ORDER BY turn, j) FROM c WHERE c.id = e.id) END AS support FROM (SELECT DISTINCT id FROM e) e""")
def sampling_masks(spark, sf_dir):
    """The ids that each token was sampled from, read from packed masks of which some are broken."""
    made = _packed(spark, sf_dir)
    packed = lambda data, n: F.struct(ev.base64_text(data).alias("data"), F.array(n).alias("shape"), F.lit("int32").alias("dtype"))
    counts = F.when(F.col("id") % 5 == 4, F.concat("counts", F.array(F.lit(1)))).otherwise(F.col("counts"))
    rows = made.withColumn("counts", counts).select("id", "completion_ids", packed(ev.write_i32(F.col("ids")), F.size("ids")).alias("mask_ids"), packed(ev.write_i32(F.col("counts")), F.size("counts")).alias("mask_counts"))
    return ev.decode_mask(rows).select("id", F.col("mask_fault").alias("fault"), F.array_join(F.flatten("support").cast("array<string>"), ",").alias("support"))
