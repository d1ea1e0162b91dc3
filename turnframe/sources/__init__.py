"""Where conversations come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, msg_idx, role, content) of the conversations table."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("msg_idx"), "role", F.col("text").alias("content"))


def reasoning_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations whose assistants think: the text before the first line break, in a think block, then the rest."""
    cut = F.instr("content", "\n")
    thinks = (F.col("role") == "assistant") & (cut > 0)
    thought = F.concat(F.lit("<think>\n"), F.expr("substring(content, 1, instr(content, '\n') - 1)"), F.lit("\n</think>\n\n"), F.expr("substring(content, instr(content, '\n') + 1)"))
    return conversations(spark, sf_dir).withColumn("content", F.when(thinks, thought).otherwise(F.col("content")))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, call_idx, name, arguments, tool_call_id, result) from events: a user's events are calls, in order of time."""
    events = table(spark, sf_dir, "events")
    order = F.row_number().over(_by_user()) - 1
    return events.select(F.col("user_id").alias("conv_id"), order.cast("int").alias("call_idx"), F.col("event_type").alias("name"), F.col("props").alias("arguments"), F.col("value").cast("string").alias("result")).withColumn("tool_call_id", F.concat(F.lit("functions."), "name", F.lit(":"), F.col("call_idx").cast("string")))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")
