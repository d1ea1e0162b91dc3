"""Registered queries on byte-pair tokens. They are there where the tokenizer files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.operators import bpe
from turnframe.registry import query
from turnframe.sources import conversations

#: Files of public tokenizers, on every machine; None where there are none.
try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None

_COVER = """WITH {0}, g AS (SELECT conv_id, g.o AS msg_idx, sum(length(g.x)) AS n_chars, sum(CASE WHEN g.s THEN length(g.x) ELSE greatest(0, length(g.x) - g.b) END) AS n_content FROM s WHERE g.k = 'T' AND g.o >= 0 GROUP BY 1, 2)
    SELECT conv_id, msg_idx, n_chars::BIGINT AS n_chars, n_content::BIGINT AS n_content FROM g"""


def _cover(toks: DataFrame) -> DataFrame:
    text = bpe.covered(toks).where("owner >= 0 and seg_idx is not null")
    return text.groupBy("conv_id", F.col("owner").alias("msg_idx")).agg(F.sum("chars").alias("n_chars"), F.sum(F.when(F.col("content"), F.col("chars")).otherwise(0)).alias("n_content"))


def register(segments_sql: str) -> None:
    """segments_sql: WITH clauses that make s (conv_id, msg_idx, g) of qwen3's segments."""
    if public_tokenizers is None:
        return

    def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
        from turnframe.plans import segments

        return segments(conversations(spark, sf_dir), "qwen3").where("kind = 'T'")

    @query(_COVER.format(segments_sql))
    def bpe_attribution(spark, sf_dir):
        return _cover(bpe.attribute_segments(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))

    @query(_COVER.format(segments_sql))
    def bpe_inferred_attribution(spark, sf_dir):
        return _cover(bpe.attribute_segments(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "decode"))

    @query()
    def bpe_tokens_per_message(spark, sf_dir):
        toks = bpe.bpe_tokens(conversations(spark, sf_dir), "qwen3", public_tokenizers.path("byte_bpe_50k.json"))
        return toks.where("owner >= 0").groupBy("conv_id", F.col("owner").alias("msg_idx")).agg(F.count("*").alias("n_tokens"), F.count_if("sampled").alias("n_sampled"), F.count_if("content").alias("n_content"))
