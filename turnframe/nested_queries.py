"""Registered queries on the nested argument grammar: values made of conversations' turns, read, written and taken from calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.functions import quoted
from turnframe.operators import nested
from turnframe.registry import query
from turnframe.sources import table

_Q = nested.QUOTE
_ROWS = "r AS (SELECT conv_id * 1000 + turn AS id, turn, role, text, to_json(text)::VARCHAR AS q FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "role", "text", quoted(F.col("text")).alias("q"))


@query(f"""WITH {_ROWS} SELECT id, md5('{{at:[' || turn || ',{{z:null}},[]],Role:{_Q}' || role || '{_Q},text:{_Q}' || text || '{_Q},True:true}}') AS nested_md5 FROM r""")
def nested_arguments_written(spark, sf_dir):
    """JSON of a turn as nested text, its members in order."""
    json = F.concat(F.lit('{"text": '), "q", F.lit(', "at": ['), F.col("turn").cast("string"), F.lit(', {"z": null}, [] ], "True": true, "Role": "'), "role", F.lit('"}'))
    return nested.write_nested(_turns(spark, sf_dir).select("id", json.alias("j")), "j").select("id", F.md5("nested").alias("nested_md5"))


@query(f"""WITH {_ROWS} SELECT id, CASE id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 3 THEN md5('[' || q || ']') ELSE md5('{{"n":' || turn || ',"o":{{"s":' || q || ',"w":"bare ' || role || '"}}}}') END AS json_md5,
    CASE id % 6 WHEN 4 THEN 'unclosed string' WHEN 5 THEN 'trailing input' END AS fault FROM r""")
def nested_arguments_read(spark, sf_dir):
    """Nested texts of turns, of which a third is broken."""
    kind, n = F.col("id") % 6, F.col("turn").cast("string")
    one = F.concat(F.lit("{n: "), n, F.lit(',<|"|>o<|"|>:{s:<|"|>'), "text", F.lit('<|"|> , w:bare '), "role", F.lit("}}"))
    text = F.when(kind == 3, F.concat(F.lit('[<|"|>'), "text", F.lit('<|"|>]'))).when(kind == 4, F.concat(F.lit('{s:<|"|>'), "text")).when(kind == 5, F.concat(one, F.lit("]"))).otherwise(one)
    return nested.read_nested(_turns(spark, sf_dir).select("id", text.alias("t")), "t").select("id", F.md5("json").alias("json_md5"), "fault")


@query(f"""WITH {_ROWS}, k AS (SELECT *, id % 7 AS kind FROM r)
    SELECT id, 0 AS call_idx, CASE WHEN kind IN (1, 2, 5) THEN NULL ELSE role END AS name, CASE WHEN kind IN (0, 3, 5, 6) THEN '{{"n":' || turn || ',"s":' || q || '}}' END AS arguments,
      CASE kind WHEN 1 THEN 'unclosed' WHEN 2 THEN 'malformed' WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'missing_name' ELSE CASE WHEN role = 'system' THEN 'unknown_tool' ELSE 'ok' END END AS status FROM k""")
def parse_calls_gemma(spark, sf_dir):
    kind = F.col("id") % 7
    args = F.concat(F.lit("{n:"), F.col("turn").cast("string"), F.lit(',s:<|"|>'), "text", F.lit('<|"|>}'))
    raw = F.when(kind == 2, args).when(kind == 4, F.concat(F.lit("call:"), "role", F.lit('{s:<|"|>'), "text", F.lit("}"))).when(kind == 5, F.concat(F.lit("call:"), args)).otherwise(F.concat(F.lit("call:"), "role", args))
    turns = _turns(spark, sf_dir)
    attempts = turns.select("id", F.lit(0).alias("call_idx"), raw.alias("raw"), (kind != 1).alias("closed"))
    return nested.parse_gemma_call(attempts, turns.where("role <> 'system'").select(F.col("role").alias("name")).distinct()).drop("raw")
