"""Logical turns: runs of user and tool messages folded into one, and tool results in the order of the calls that asked for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _has(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def logical_turns(messages: DataFrame) -> DataFrame:
    """messages (conv_id, msg_idx, role, ...) with logical, the number of the turn that a message is a block of, first_idx, the
    message that began it, turn_role, turn_task and block, its place there.

    A tool message joins the user turn before it or begins one; a user message joins unless the turn has a task (column task,
    of the message that began it). Any other message is a turn of its own. Any numbering of messages will do.
    """
    rows = messages.withColumn("_task", _has(messages, "task"))
    by = Window.partitionBy("conv_id").orderBy("msg_idx")
    joins = F.coalesce(F.col("role").isin("user", "tool"), F.lit(False))
    rows = rows.withColumn("_joins", joins).withColumn("_opens", joins & ~F.coalesce(F.lag("_joins").over(by), F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(~F.col("_joins") | F.col("_opens"), 1).otherwise(0)).over(by))
    # within a run the turn changes only while every message so far has begun a turn with a task
    earlier = Window.partitionBy("conv_id", "_run").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    settles = ((F.col("role") == "user") & F.col("_task").isNull()) | ((F.col("role") == "tool") & F.col("_opens"))
    rows = rows.withColumn("_settled", F.coalesce(F.max(settles).over(earlier), F.lit(False)))
    starts = ~F.col("_joins") | F.col("_opens") | ((F.col("role") == "user") & ~F.col("_settled"))
    rows = rows.withColumn("_starts", starts).withColumn("logical", (F.sum(F.col("_starts").cast("int")).over(by) - 1).cast("int"))
    within = Window.partitionBy("conv_id", "logical").orderBy("msg_idx")
    first = lambda c: F.first(c).over(within)
    rows = rows.withColumns({
        "first_idx": first("msg_idx"), "turn_role": F.when(F.col("_joins"), "user").otherwise(F.col("role")),
        "turn_task": F.when(first("role") == "tool", None).otherwise(first("_task")), "block": F.row_number().over(within) - 1,
    })
    return rows.drop("_task", "_joins", "_opens", "_run", "_settled", "_starts")


def ordered_results(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """logical_turns() with block such that the tool results of a turn stand in the order of their calls, in the places that results have.

    calls: conv_id, msg_idx of the assistant, call_idx, tool_call_id. The order is that of the last assistant before the turn
    with calls; a result of none of these counts as the first call's, and ties stay as they came. Where none of the calls
    has an id, nothing moves. An id that recurs counts where it came last.
    """
    asked = calls.groupBy("conv_id", "msg_idx").agg(F.max(F.coalesce("tool_call_id", F.lit("")) != "").alias("named")).withColumnRenamed("msg_idx", "_asker")
    ranks = calls.where("coalesce(tool_call_id, '') <> ''").groupBy("conv_id", F.col("msg_idx").alias("_asker"), "tool_call_id").agg(F.max("call_idx").alias("_rank"))
    marked = turns.join(asked.select("conv_id", F.col("_asker").alias("msg_idx"), F.lit(True).alias("_asks")), ["conv_id", "msg_idx"], "left")
    before = Window.partitionBy("conv_id").orderBy("msg_idx")
    marked = marked.withColumn("_asker", F.last(F.when(F.coalesce(F.col("_asks"), F.lit(False)) & (F.col("role") == "assistant"), F.col("msg_idx")), ignorenulls=True).over(before))
    joined = marked.join(asked, ["conv_id", "_asker"], "left").join(ranks, ["conv_id", "_asker", "tool_call_id"], "left")
    result = (F.col("role") == "tool") & F.coalesce("named", F.lit(False))
    slots = Window.partitionBy("conv_id", "logical", "_result")
    joined = joined.withColumn("_result", result)
    nth = F.row_number().over(slots.orderBy(F.coalesce("_rank", F.lit(0)), "msg_idx"))
    places = F.array_sort(F.collect_list("block").over(slots.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    moved = joined.withColumns({"_nth": nth, "_places": places})
    return moved.withColumn("block", F.when(F.col("_result"), F.get("_places", F.col("_nth") - 1)).otherwise(F.col("block"))).drop("_asks", "_asker", "named", "_rank", "_result", "_nth", "_places")


def result_order(new: DataFrame, call_ids: DataFrame) -> DataFrame:
    """(conv_id, msg_indices): new messages (conv_id, msg_idx, role, tool_call_id) in the order in which they extend a prompt, results in the order of call_ids (conv_id, call_idx, tool_call_id); null where it cannot be proved.

    That is where there are no call ids, where a message has a task, and where a result is of none of the calls.
    """
    rows = new.withColumn("_task", _has(new, "task"))
    ranks = call_ids.groupBy("conv_id", "tool_call_id").agg(F.max("call_idx").alias("_rank"))
    known = call_ids.select("conv_id", F.lit(True).alias("_known")).distinct()
    joined = rows.withColumn("tool_call_id", F.coalesce("tool_call_id", F.lit(""))).join(ranks, ["conv_id", "tool_call_id"], "left").join(known, "conv_id", "left")
    tool = F.coalesce(F.col("role") == "tool", F.lit(False))
    listed = joined.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("msg_idx", tool.alias("tool")))).alias("all"),
        F.array_sort(F.collect_list(F.when(tool, F.struct("_rank", "msg_idx")))).alias("results"),
        (F.max("_known").isNull() | F.bool_or(F.col("_task").isNotNull()) | F.bool_or(tool & F.col("_rank").isNull())).alias("open"),
    )
    nth = lambda i: F.size(F.filter(F.slice("all", F.lit(1), i), lambda x: x["tool"]))
    placed = F.transform("all", lambda x, i: F.when(x["tool"], F.get("results", nth(i))["msg_idx"]).otherwise(x["msg_idx"]))
    return listed.select("conv_id", F.when(~F.coalesce("open", F.lit(False)), placed).alias("msg_indices"))
