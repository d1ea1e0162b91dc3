"""Registered queries on tool schemas: a tool of each turn, with references, cycles and unions, and what a conversation declares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.functions import quoted
from turnframe.operators import schemas
from turnframe.registry import query
from turnframe.sources import table

_REFS = ("#", "#/$defs/Node", "#/$defs/Lost")
_DECLARED = """r AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text, length(text) AS n FROM conversations),
    p AS (SELECT *, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '' ELSE '  // ' || x END), chr(10)) || chr(10) || '  // maxLength: ' || n || chr(10) || '  ' || role || '?: string' AS own,
        '  next?: ' || CASE id % 3 WHEN 0 THEN 'parameters' ELSE 'Node' END AS next, '  // Default: [1, 2]' || chr(10) || '  u: number | null | Array<string>' AS u, '  e?: "' || role || '" | ' || n || ' | null' AS e FROM r),
    l AS (SELECT *, array_to_string(list_transform(list_sort([{'n': role, 'x': own}, {'n': 'next', 'x': next}, {'n': 'e', 'x': e}]), lambda z: z.x), ',' || chr(10)) AS rest FROM p),
    f AS (SELECT id, conv_id, turn, CASE id % 3 WHEN 2 THEN 'reference not found' END AS fault,
        CASE id % 3 WHEN 0 THEN 'interface parameters {' || chr(10) || own || ',' || chr(10) || next || ',' || chr(10) || u || ',' || chr(10) || e || chr(10) || '}' || chr(10) ELSE '' END
        || '// A node' || chr(10) || 'interface Node {' || chr(10) || '  next: Array<Node>,' || chr(10) || '  [k: string]: any' || chr(10) || '}' || chr(10)
        || 'type ' || role || turn || ' = (_: ' || CASE id % 3 WHEN 0 THEN 'parameters' ELSE '{' || chr(10) || u || ',' || chr(10) || rest || chr(10) || '}' END || ') => any;' AS typescript FROM l)"""


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("tool_id"), "conv_id", "turn", "role", quoted(F.col("text")).alias("q"), F.length("text").cast("string").alias("n"))
    ref = F.element_at(F.array(*map(F.lit, _REFS)), (F.col("tool_id") % 3 + 1).cast("int"))
    parameters = F.concat(
        F.lit('{"type": "object", "properties": {"'), "role", F.lit('": {"type": "string", "description": '), "q", F.lit(', "maxLength": '), "n", F.lit('}, "next": {"$ref": "'), ref,
        F.lit('"}, "u": {"anyOf": [{"type": "integer"}, {"type": "null"}, {"type": "array", "items": {"type": "string"}}], "default": [1,2]}, "e": {"enum": ["'), "role", F.lit('", '), "n",
        F.lit(', null]}}, "required": ["u"], "$defs": {"Node": {"type": "object", "description": "A node", "properties": {"next": {"type": "array", "items": {"$ref": "#/$defs/Node"}}}, "required": ["next"], "additionalProperties": true}}}'),
    )
    name = F.concat("role", F.col("turn").cast("string"))
    return schemas.function_types(turns.select("tool_id", name.alias("name"), F.lit(None).cast("string").alias("description"), parameters.alias("parameters")))


@query(f"WITH {_DECLARED} SELECT id AS tool_id, CASE WHEN fault IS NULL THEN typescript END AS typescript, fault FROM f")
def tool_types(spark, sf_dir):
    return _functions(spark, sf_dir)


@query(f"""WITH {_DECLARED} SELECT conv_id, md5('# Tools' || chr(10) || chr(10) || '## functions' || chr(10) || 'namespace functions {{' || chr(10) || string_agg(typescript, chr(10) ORDER BY turn) || chr(10) || '}}' || chr(10)) AS declaration_md5
    FROM f WHERE fault IS NULL GROUP BY 1""")
def tool_declarations(spark, sf_dir):
    """What each conversation declares, in the order of its turns."""
    listed = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("tool_idx"), (F.col("conv_id") * 1000 + F.col("turn")).alias("tool_id"))
    return schemas.declared_tools(_functions(spark, sf_dir), listed).select("conv_id", F.md5("declaration").alias("declaration_md5"))
