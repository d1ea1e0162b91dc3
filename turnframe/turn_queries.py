"""Registered queries on logical turns. Conversations get a second user message, tasks, calls and results in no order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.operators import turns
from turnframe.registry import query
from turnframe.sources import table

_MADE = """m0 AS (SELECT conv_id, turn, role, (conv_id * 7 + turn) % 4 AS n FROM conversations),
    calls AS (SELECT conv_id, turn * 10 AS msg_idx, unnest(range(n)) AS call_idx, n FROM m0 WHERE role = 'assistant'),
    c AS (SELECT conv_id, msg_idx, call_idx, CASE WHEN n = 3 AND conv_id % 3 = 0 THEN NULL ELSE 'c' || msg_idx || '_' || call_idx END AS tool_call_id FROM calls),
    m AS (SELECT conv_id, turn * 10 AS msg_idx, role, NULL::VARCHAR AS tool_call_id, CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN 't' END AS task FROM m0
      UNION ALL SELECT conv_id, turn * 10 + 1, 'user', NULL, CASE WHEN turn % 3 = 1 THEN 'u' END FROM m0 WHERE role = 'user'
      UNION ALL SELECT conv_id, msg_idx + 5 - call_idx, 'tool', CASE WHEN (conv_id + call_idx) % 11 = 0 THEN 'lost' ELSE 'c' || msg_idx || '_' || call_idx END, NULL FROM calls)"""


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.pmod(F.col("conv_id") * 7 + F.col("turn"), 4).alias("n"))
    none = F.lit(None).cast("string")
    calls = base.where("role = 'assistant' and n > 0").select("conv_id", (F.col("turn") * 10).alias("msg_idx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("call_idx"), "n")
    name = F.concat(F.lit("c"), F.col("msg_idx").cast("string"), F.lit("_"), F.col("call_idx").cast("string"))
    named = calls.select("conv_id", "msg_idx", "call_idx", F.when((F.col("n") == 3) & (F.col("conv_id") % 3 == 0), none).otherwise(name).alias("tool_call_id"))
    first = base.select("conv_id", (F.col("turn") * 10).alias("msg_idx"), "role", none.alias("tool_call_id"), F.when((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 5 == 0), "t").alias("task"))
    second = base.where("role = 'user'").select("conv_id", F.col("turn") * 10 + 1, "role", none, F.when(F.col("turn") % 3 == 1, "u"))
    results = calls.select("conv_id", F.col("msg_idx") + 5 - F.col("call_idx"), F.lit("tool"), F.when((F.col("conv_id") + F.col("call_idx")) % 11 == 0, "lost").otherwise(name), none)
    return first.union(second).union(results), named


_WALK = f"""WITH RECURSIVE {_MADE}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx) AS k FROM m),
    walk AS (SELECT conv_id, k, msg_idx, role, tool_call_id, 0 AS logical, msg_idx AS first_idx, CASE WHEN role = 'tool' THEN 'user' ELSE role END AS turn_role, task AS turn_task, NULL::BIGINT AS asker FROM o WHERE k = 1
      UNION ALL
      SELECT o.conv_id, o.k, o.msg_idx, o.role, o.tool_call_id,
        CASE WHEN j THEN w.logical ELSE w.logical + 1 END, CASE WHEN j THEN w.first_idx ELSE o.msg_idx END, CASE WHEN j OR o.role = 'tool' THEN 'user' ELSE o.role END, CASE WHEN j THEN w.turn_task ELSE o.task END,
        CASE WHEN w.role = 'assistant' AND EXISTS (SELECT 1 FROM c WHERE c.conv_id = w.conv_id AND c.msg_idx = w.msg_idx) THEN w.msg_idx ELSE w.asker END
      FROM (SELECT o.*, w.k AS wk, w.turn_role = 'user' AND (o.role = 'tool' OR o.role = 'user' AND w.turn_task IS NULL) AS j FROM o JOIN walk w ON w.conv_id = o.conv_id AND w.k = o.k - 1) o JOIN walk w ON w.conv_id = o.conv_id AND w.k = o.k - 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, logical ORDER BY msg_idx) - 1 AS place FROM walk),
    ranked AS (SELECT p.*, role = 'tool' AND EXISTS (SELECT 1 FROM c WHERE c.conv_id = p.conv_id AND c.msg_idx = p.asker AND c.tool_call_id IS NOT NULL) AS moves,
        coalesce((SELECT max(call_idx) FROM c WHERE c.conv_id = p.conv_id AND c.msg_idx = p.asker AND c.tool_call_id = p.tool_call_id), 0) AS rank FROM placed p),
    slot AS (SELECT conv_id, logical, place, row_number() OVER (PARTITION BY conv_id, logical ORDER BY place) AS nth FROM ranked WHERE moves),
    moved AS (SELECT *, row_number() OVER (PARTITION BY conv_id, logical, moves ORDER BY rank, msg_idx) AS nth FROM ranked)
    SELECT m.conv_id, m.msg_idx, m.logical, m.first_idx, m.turn_role, m.turn_task, (CASE WHEN moves THEN s.place ELSE m.place END)::INTEGER AS block
    FROM moved m LEFT JOIN slot s ON m.moves AND s.conv_id = m.conv_id AND s.logical = m.logical AND s.nth = m.nth"""


@query(_WALK)
def logical_turns(spark, sf_dir):
    """Merged turns with their results in the order of the calls."""
    messages, calls = _made(spark, sf_dir)
    return turns.ordered_results(turns.logical_turns(messages), calls).select("conv_id", "msg_idx", "logical", "first_idx", "turn_role", "turn_task", "block")


@query(f"""WITH {_MADE}, l AS (SELECT conv_id, max(msg_idx) AS at FROM c GROUP BY 1), n AS (SELECT m.* FROM m JOIN l ON l.conv_id = m.conv_id AND m.msg_idx > l.at),
    k AS (SELECT c.* FROM c JOIN l ON l.conv_id = c.conv_id AND c.msg_idx = l.at AND tool_call_id IS NOT NULL),
    r AS (SELECT n.*, (SELECT max(call_idx) FROM k WHERE k.conv_id = n.conv_id AND k.tool_call_id = n.tool_call_id) AS rank FROM n),
    bad AS (SELECT conv_id, bool_or(task IS NOT NULL OR role = 'tool' AND rank IS NULL) OR NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = r.conv_id) AS bad FROM r GROUP BY conv_id),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'tool' ORDER BY msg_idx) AS slot, row_number() OVER (PARTITION BY conv_id, role = 'tool' ORDER BY CASE WHEN role = 'tool' THEN rank END, msg_idx) AS nth FROM r)
    SELECT a.conv_id, CASE WHEN NOT any_value(bad.bad) THEN string_agg(b.msg_idx, ',' ORDER BY a.msg_idx) END AS msg_indices FROM s a JOIN s b ON a.conv_id = b.conv_id AND (a.role = 'tool') = (b.role = 'tool') AND a.slot = b.nth JOIN bad ON bad.conv_id = a.conv_id GROUP BY a.conv_id""")
def bridged_result_order(spark, sf_dir):
    """What follows a conversation's last calls, in the order in which it may extend the prompt."""
    messages, calls = _made(spark, sf_dir)
    last = calls.groupBy("conv_id").agg(F.max("msg_idx").alias("at"))
    new = messages.join(last, "conv_id").where("msg_idx > at").drop("at")
    ids = calls.join(last, "conv_id").where("msg_idx = at and tool_call_id is not null").select("conv_id", "call_idx", "tool_call_id")
    return turns.result_order(new, ids).select("conv_id", F.array_join(F.col("msg_indices").cast("array<string>"), ",").alias("msg_indices"))
