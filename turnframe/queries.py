"""Registered queries on conversations, each with SQL that states the same result independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe import operators as op
from turnframe import bpe_queries, evidence_queries, media_queries, nested_queries, schema_queries, turn_queries  # noqa: F401
from turnframe import response_queries  # noqa: F401  registers its queries
from turnframe.functions import coerce_argument, pieces, think_split, token_id
from turnframe.plans import FAMILIES, facts, segments
from turnframe.registry import ORACLE_SQL, QUERIES, query
from turnframe.sources import conversations, reasoning_conversations, table, tool_calls

# SQL for the oracles. c: conversations; m: with thinking assistants; f: with facts of the whole conversation.
_C = "c AS (SELECT conv_id, turn::INT AS msg_idx, role, coalesce(text, '') AS content FROM conversations)"
_M = (
    _C
    + r""", m AS (SELECT conv_id, msg_idx, role, CASE WHEN role = 'assistant' AND strpos(content, chr(10)) > 0
      THEN '<think>' || chr(10) || split_part(content, chr(10), 1) || chr(10) || '</think>' || chr(10) || chr(10) || substr(content, strpos(content, chr(10)) + 1) ELSE content END AS content FROM c)"""
)
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _facts_sql(source: str) -> str:
    return f"""t AS (SELECT *, CASE WHEN role = 'assistant' AND strpos(content, '</think>') > 0 THEN trim(replace(split_part(content, '</think>', 1), '<think>', ''), chr(10)) ELSE '' END AS reasoning,
      CASE WHEN role = 'assistant' AND strpos(content, '</think>') > 0 THEN ltrim(substr(content, strpos(content, '</think>') + 8), chr(10)) ELSE content END AS body FROM {source}),
    f AS (SELECT *, count(*) OVER w AS n, first_value(role) OVER (PARTITION BY conv_id ORDER BY msg_idx) AS first_role, lag(role) OVER (PARTITION BY conv_id ORDER BY msg_idx) AS prev_role,
      coalesce(max(CASE WHEN role = 'user' THEN msg_idx END) OVER w, -1) AS last_user, max(CASE WHEN role = 'user' THEN msg_idx END) OVER w AS last_query
      FROM t WINDOW w AS (PARTITION BY conv_id))"""


def _render_sql(message: str, begin: str, prompt: str, source: str) -> str:
    with_ = (_M if source == "m" else _C) + ", " + _facts_sql(source)
    return f"""WITH {with_}, r AS (SELECT conv_id, msg_idx, (CASE WHEN msg_idx = 0 THEN {begin} ELSE '' END) || ({message}) || (CASE WHEN msg_idx = n - 1 AND role <> 'assistant' THEN {prompt} ELSE '' END) AS x FROM f)
      SELECT conv_id, md5(string_agg(x, '' ORDER BY msg_idx)) AS text_md5, length(string_agg(x, '' ORDER BY msg_idx))::BIGINT AS n_chars FROM r GROUP BY 1"""


_N = "chr(10)"
_THINK = f"'<think>' || {_N} || reasoning || {_N} || '</think>' || {_N} || {_N}"
_FORMATS = {
    "qwen3": (
        f"'<|im_start|>' || role || {_N} || (CASE WHEN role = 'assistant' AND msg_idx > coalesce(last_query, n - 1) AND (msg_idx = n - 1 OR reasoning <> '') THEN {_THINK} || ltrim(body, {_N}) ELSE body END) || '<|im_end|>' || {_N}",
        "''", f"'<|im_start|>assistant' || {_N}",
    ),
    "qwen3.5": (
        f"'<|im_start|>' || role || {_N} || (CASE WHEN role = 'assistant' AND msg_idx > coalesce(last_query, n) THEN '<think>' || {_N} || {_strip('reasoning')} || {_N} || '</think>' || {_N} || {_N} ELSE '' END) || {_strip('body')} || '<|im_end|>' || {_N}",
        "''", f"'<|im_start|>assistant' || {_N} || '<think>' || {_N}",
    ),
    "glm-4.5": (
        f"CASE WHEN role = 'assistant' THEN '<|assistant|>' || {_N} || '<think>' || (CASE WHEN msg_idx > last_user THEN {_strip('reasoning')} ELSE '' END) || '</think>' || (CASE WHEN {_strip('body')} <> '' THEN {_N} || {_strip('body')} ELSE '' END) ELSE '<|' || role || '|>' || {_N} || content END",
        "'[gMASK]<sop>'", "'<|assistant|>'",
    ),
    "glm-5": (
        f"CASE WHEN role = 'assistant' THEN '<|assistant|>' || (CASE WHEN msg_idx > last_user AND reasoning <> '' THEN '<think>' || {_strip('reasoning')} ELSE '' END) || '</think>' || {_strip('body')} ELSE '<|' || role || '|>' || content END",
        "'[gMASK]<sop>'", "'<|assistant|><think>'",
    ),
    "deepseek-v3": ("CASE role WHEN 'system' THEN content WHEN 'user' THEN '<｜User｜>' || content ELSE (CASE WHEN coalesce(prev_role, '') = 'tool' THEN '' ELSE '<｜Assistant｜>' END) || content || '<｜end▁of▁sentence｜>' END", "'<｜begin▁of▁sentence｜>'", "(CASE WHEN role = 'tool' THEN '' ELSE '<｜Assistant｜>' END)"),
    "deepseek-r1": ("CASE role WHEN 'system' THEN content WHEN 'user' THEN '<｜User｜>' || content ELSE (CASE WHEN coalesce(prev_role, '') = 'tool' THEN '' ELSE '<｜Assistant｜>' END) || (CASE WHEN strpos(content, '</think>') > 0 THEN substr(content, strpos(content, '</think>') + 8) ELSE content END) || '<｜end▁of▁sentence｜>' END", "'<｜begin▁of▁sentence｜>'", f"(CASE WHEN role = 'tool' THEN '' ELSE '<｜Assistant｜>' END) || '<think>' || {_N}"),
    "kimi-k2": ("'<|im_' || role || '|>' || role || '<|im_middle|>' || content || '<|im_end|>'", f"CASE WHEN first_role <> 'system' THEN '<|im_system|>system<|im_middle|>You are Kimi, an AI assistant created by Moonshot AI.<|im_end|>' || {_N} ELSE '' END", "'<|im_assistant|>assistant<|im_middle|>'"),
    "llama-3": (
        f"'<|start_header_id|>' || role || '<|end_header_id|>' || {_N} || {_N} || (CASE WHEN role = 'system' AND msg_idx = 0 THEN 'Cutting Knowledge Date: December 2023' || {_N} || 'Today Date: 26 Jul 2024' || {_N} || {_N} ELSE '' END) || {_strip('content')} || '<|eot_id|>'",
        f"'<|begin_of_text|>' || (CASE WHEN first_role <> 'system' THEN '<|start_header_id|>system<|end_header_id|>' || {_N} || {_N} || 'Cutting Knowledge Date: December 2023' || {_N} || 'Today Date: 26 Jul 2024' || {_N} || {_N} || '<|eot_id|>' ELSE '' END)",
        f"'<|start_header_id|>assistant<|end_header_id|>' || {_N} || {_N}",
    ),
    "minimax-m2": (
        f"(CASE WHEN role = 'system' THEN ']~!b[' ELSE '' END) || ']~b]' || (CASE WHEN role = 'assistant' THEN 'ai' ELSE role END) || {_N} || (CASE WHEN role = 'assistant' AND reasoning <> '' AND msg_idx > last_user THEN {_THINK} || trim(body, {_N}) WHEN role = 'assistant' AND reasoning <> '' THEN trim(body, {_N}) ELSE content END) || '[e~[' || {_N}",
        f"CASE WHEN first_role <> 'system' THEN ']~!b[]~b]system' || {_N} || 'You are a helpful assistant. Your name is MiniMax-M2.5 and is built by MiniMax.[e~[' || {_N} ELSE '' END", f"']~b]ai' || {_N} || '<think>' || {_N}",
    ),
}
_FORMATS["qwen3.6"] = _FORMATS["qwen3.5"]
_FORMATS["glm-5.1"] = (_FORMATS["glm-5"][0].replace("AND reasoning <> ''", ""), *_FORMATS["glm-5"][1:])


def _register_render(family: str) -> None:
    key = family.replace("-", "_").replace(".", "_")
    for source, name, read in (("c", f"render_text_{key}", conversations), ("m", f"render_reasoning_{key}", reasoning_conversations)):

        def run(spark: SparkSession, sf_dir: str, read=read) -> DataFrame:
            return op.render_text(read(spark, sf_dir), family).select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))

        QUERIES[name], ORACLE_SQL[name] = run, _render_sql(*_FORMATS[family], source)


for _family in FAMILIES:
    _register_render(_family)

# Tokens of the qwen3 format: groups with the body's place, then pieces with running offsets.
_PIECE = r"\p{L}+|[0-9]|\n+|[ \t\r]+|[^\p{L}0-9\s]|(?s:.)"
_TOKENS = f"""WITH {_C}, {_facts_sql('c')}, s AS (
    SELECT conv_id, msg_idx, unnest([
      {{'i': 0, 'k': 'S', 'x': '<|im_start|>', 'o': msg_idx, 's': false, 'b': 0}},
      {{'i': 1, 'k': 'T', 'x': CASE WHEN role = 'assistant' THEN role || {_N} ELSE role || {_N} || content END, 'o': msg_idx, 's': false, 'b': CASE WHEN role = 'assistant' THEN 1000000000 ELSE length(role) + 1 END}},
      {{'i': 2, 'k': 'T', 'x': CASE WHEN role <> 'assistant' THEN '' WHEN msg_idx > coalesce(last_query, n - 1) AND msg_idx = n - 1 THEN {_THINK} || ltrim(body, {_N}) ELSE body END, 'o': msg_idx, 's': true, 'b': 0}},
      {{'i': 3, 'k': 'S', 'x': '<|im_end|>', 'o': msg_idx, 's': role = 'assistant', 'b': 0}},
      {{'i': 4, 'k': 'T', 'x': {_N}, 'o': msg_idx, 's': false, 'b': 1000000000}},
      {{'i': 5, 'k': 'S', 'x': CASE WHEN msg_idx = n - 1 AND role <> 'assistant' THEN '<|im_start|>' ELSE '' END, 'o': -1, 's': false, 'b': 0}},
      {{'i': 6, 'k': 'T', 'x': CASE WHEN msg_idx = n - 1 AND role <> 'assistant' THEN 'assistant' || {_N} ELSE '' END, 'o': -1, 's': false, 'b': 1000000000}}]) AS g FROM f),
    p AS (SELECT conv_id, msg_idx, g, unnest(CASE WHEN g.k = 'S' THEN [g.x] ELSE regexp_extract_all(g.x, '{_PIECE}') END) AS piece, generate_subscripts(CASE WHEN g.k = 'S' THEN [g.x] ELSE regexp_extract_all(g.x, '{_PIECE}') END, 1) AS j FROM s WHERE g.x <> ''),
    tok AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx, g.i, j) - 1 AS pos, ('0x' || substr(md5(piece), 1, 8))::BIGINT AS token_id, g.o AS owner, g.s AS sampled,
      g.s OR (g.k = 'T' AND coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, msg_idx, g.i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= g.b) AS content FROM p),
    per AS (SELECT c.conv_id, c.msg_idx, c.role, count(tok.pos)::BIGINT AS n_tokens, (count(tok.pos) FILTER (tok.sampled))::BIGINT AS n_sampled, (count(tok.pos) FILTER (tok.content))::BIGINT AS n_content, min(tok.pos)::BIGINT AS "start", max(tok.pos)::BIGINT + 1 AS "end"
      FROM c LEFT JOIN tok ON tok.conv_id = c.conv_id AND tok.owner = c.msg_idx GROUP BY 1, 2, 3) """


bpe_queries.register(_TOKENS.split("WITH ", 1)[1].split(",\n    p AS (SELECT", 1)[0])


def _qwen3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    messages = conversations(spark, sf_dir)
    return messages, op.tokens(messages, "qwen3")


@query("SELECT conv_id, count(*)::BIGINT AS n_messages, (count(*) FILTER (role = 'user'))::BIGINT AS n_user, sum(length(text))::BIGINT AS n_chars, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def message_spine(spark, sf_dir):
    return conversations(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("content")).alias("n_chars"), F.min_by("role", "msg_idx").alias("first_role"), F.max_by("role", "msg_idx").alias("last_role"))


@query("SELECT coalesce(p, '') AS prev_role, role, count(*)::BIGINT AS n FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1, 2")
def role_transitions(spark, sf_dir):
    return facts(conversations(spark, sf_dir)).groupBy(F.coalesce("prev_role", F.lit("")).alias("prev_role"), "role").agg(F.count("*").alias("n"))


@query("SELECT conv_id, coalesce(max(turn) FILTER (role = 'user'), -1)::INT AS last_user, coalesce(max(turn) FILTER (role = 'user'), count(*) - 1)::INT AS last_query FROM conversations GROUP BY 1")
def last_user_and_query(spark, sf_dir):
    return facts(conversations(spark, sf_dir)).where("msg_idx = first_idx").select("conv_id", "last_user", F.coalesce("last_query", "last_idx").alias("last_query"))


@query(f"WITH {_M}, {_facts_sql('m')} SELECT conv_id, msg_idx, md5(reasoning) AS reasoning_md5, md5(body) AS body_md5 FROM f WHERE role = 'assistant'")
def reasoning_split(spark, sf_dir):
    reasoning, body = think_split(F.col("content"))
    return reasoning_conversations(spark, sf_dir).where("role = 'assistant'").select("conv_id", "msg_idx", F.md5(reasoning.cast("binary")).alias("reasoning_md5"), F.md5(body.cast("binary")).alias("body_md5"))


@query(f"SELECT conv_id, turn::INT AS msg_idx, len(regexp_extract_all(text, '{_PIECE}'))::BIGINT AS n_tokens, list_sum(list_transform(regexp_extract_all(text, '{_PIECE}'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT))::BIGINT AS id_sum FROM conversations")
def lexical_tokens(spark, sf_dir):
    ids = F.transform(pieces(F.col("content")), token_id)
    return conversations(spark, sf_dir).select("conv_id", "msg_idx", F.size(ids).cast("bigint").alias("n_tokens"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query(_TOKENS + "SELECT conv_id, pos::BIGINT AS pos, token_id, owner, sampled, content FROM tok")
def render_tokens_qwen3(spark, sf_dir):
    return _qwen3(spark, sf_dir)[1].select("conv_id", F.col("pos").cast("bigint").alias("pos"), "token_id", "owner", "sampled", "content")


@query(_TOKENS + 'SELECT conv_id, msg_idx, role, n_tokens, n_sampled, n_content, "start", "end" FROM per')
def tokens_per_message(spark, sf_dir):
    r = op.tokens_per_message(*_qwen3(spark, sf_dir))
    return r.withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint"))


@query(_TOKENS + "SELECT conv_id, role, sum(n_tokens)::BIGINT AS n_tokens, sum(n_sampled)::BIGINT AS n_sampled FROM per GROUP BY 1, 2")
def tokens_by_role(spark, sf_dir):
    return op.tokens_by_role(op.tokens_per_message(*_qwen3(spark, sf_dir)))


@query(_TOKENS + """SELECT conv_id, role, coalesce(string_agg("start" || '-' || "end", ',' ORDER BY msg_idx) FILTER ("start" IS NOT NULL), '') AS spans FROM per GROUP BY 1, 2""")
def role_token_spans(spark, sf_dir):
    return op.role_spans(op.tokens_per_message(*_qwen3(spark, sf_dir)))


@query(_TOKENS + """, b AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, owner ORDER BY pos) AS run FROM tok WHERE owner >= 0 AND content)
    SELECT b.conv_id, c.role, min(pos)::BIGINT AS "start", max(pos)::BIGINT + 1 AS "end" FROM b JOIN c ON b.conv_id = c.conv_id AND b.owner = c.msg_idx GROUP BY b.conv_id, c.role, owner, run""")
def content_spans_by_role(spark, sf_dir):
    r = op.content_spans(*_qwen3(spark, sf_dir))
    return r.select("conv_id", "role", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def _mask_counts(masked: DataFrame) -> DataFrame:
    return masked.groupBy("conv_id").agg(F.count("*").alias("n_tokens"), F.count_if("train").alias("n_train"), F.sum(F.when(F.col("train"), F.col("pos")).otherwise(0)).cast("bigint").alias("pos_sum"))


def _mask_sql(train: str) -> str:
    return _TOKENS + f", k AS (SELECT tok.*, coalesce({train}, false) AS train FROM tok LEFT JOIN c ON tok.conv_id = c.conv_id AND tok.owner = c.msg_idx) SELECT conv_id, count(*)::BIGINT AS n_tokens, (count(*) FILTER (train))::BIGINT AS n_train, sum(CASE WHEN train THEN pos ELSE 0 END)::BIGINT AS pos_sum FROM k GROUP BY 1"


@query(_mask_sql("owner >= 0 AND sampled"))
def loss_mask_default(spark, sf_dir):
    return _mask_counts(op.loss_mask(*_qwen3(spark, sf_dir)))


@query(_mask_sql("owner >= 0 AND ((role = 'user' AND tok.content) OR (role = 'assistant' AND sampled))"))
def loss_mask_body_roles(spark, sf_dir):
    return _mask_counts(op.loss_mask(*_qwen3(spark, sf_dir), roles=F.col("role") == "assistant", body_roles=("user",)))


@query(_mask_sql("owner >= 0 AND sampled AND owner % 4 = 1"))
def loss_mask_selected(spark, sf_dir):
    return _mask_counts(op.loss_mask(*_qwen3(spark, sf_dir), selected=F.col("owner") % 4 == 1))


@query(_TOKENS + """, k AS (SELECT tok.*, c.role, c.n - 1 AS last, (c.msg_idx % 3 <> 1)::INT AS chosen FROM tok LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM c) c ON c.conv_id = tok.conv_id AND c.msg_idx = tok.owner),
    cut AS (SELECT * FROM k WHERE NOT (conv_id % 2 = 0 AND role = 'assistant' AND owner = last AND token_id = ('0x' || substr(md5('<|im_end|>'), 1, 8))::BIGINT)),
    g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (owner >= 0 AND sampled AND (conv_id % 5 <> 0 OR chosen = 1)) AS t FROM cut GROUP BY 1),
    e AS (SELECT conv_id, arg_max(role, msg_idx) AS role, max(msg_idx) AS tail, count(*) AS n FROM c GROUP BY 1)
    SELECT g.conv_id, (CASE WHEN g.conv_id % 5 = 1 THEN -1 ELSE g.n + (CASE WHEN role = 'assistant' AND g.conv_id % 2 = 0 THEN 1 ELSE 0 END) END)::INTEGER AS n_tokens,
      (CASE WHEN g.conv_id % 5 = 1 THEN -1 ELSE t + (CASE WHEN role = 'assistant' AND g.conv_id % 2 = 0 AND (g.conv_id % 5 <> 0 OR tail % 3 <> 1) THEN 1 ELSE 0 END) END)::INTEGER AS n_train, CASE WHEN g.conv_id % 5 = 1 THEN 'length' END AS fault FROM g JOIN e USING (conv_id)""")
def training_samples(spark, sf_dir):
    """Samples of conversations whose last turn may lack its stop; a fifth has a mask of messages, a fifth one of the wrong length (-1 tokens)."""
    messages, toks = _qwen3(spark, sf_dir)
    last = messages.groupBy("conv_id").agg(F.max("msg_idx").alias("at"), F.count("*").alias("n"))
    lost = (F.col("conv_id") % 2 == 0) & F.col("sampled") & (F.col("owner") == F.col("at")) & (F.col("token_id") == token_id(F.lit("<|im_end|>")))
    cut = toks.join(last.select("conv_id", "at"), "conv_id").where(~lost).drop("at")
    chosen = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: (i % 3 != 1).cast("int"))
    masks = last.where("conv_id % 5 < 2").select("conv_id", F.when(F.col("conv_id") % 5 == 1, F.concat(chosen, F.array(F.lit(1)))).otherwise(chosen).alias("mask"))
    made = op.training_samples(messages, cut, "qwen3", final_stop=True, masks=masks)
    counted = F.size(F.filter("loss_mask", lambda x: x))
    return made.select("conv_id", F.when(F.col("fault").isNull(), F.size("token_ids")).otherwise(-1).alias("n_tokens"), F.when(F.col("fault").isNull(), counted).otherwise(-1).alias("n_train"), "fault")


def _prefix(spark, sf_dir):
    messages = conversations(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("conv_id"))
    prompt = messages.withColumn("n", n).where("msg_idx < n - 1 or n = 1").drop("n")
    return op.id_arrays(op.tokens(prompt, "qwen3")), op.id_arrays(op.tokens(messages, "qwen3"))


_SHORT = _TOKENS.replace("FROM conversations)", "FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n0 FROM conversations) WHERE turn < n0 - 1 OR n0 = 1)", 1)


@query(f"""WITH a AS ({_SHORT} SELECT conv_id, pos, token_id FROM tok), b AS ({_TOKENS} SELECT conv_id, pos, token_id FROM tok),
    la AS (SELECT conv_id, count(*) AS n FROM a GROUP BY 1), lb AS (SELECT conv_id, count(*) AS n FROM b GROUP BY 1),
    d AS (SELECT a.conv_id, min(a.pos) AS k FROM a JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos WHERE a.token_id <> b.token_id GROUP BY 1)
    SELECT conv_id, coalesce(d.k, least(la.n, lb.n))::BIGINT AS n_prompt, (lb.n - coalesce(d.k, least(la.n, lb.n)))::BIGINT AS n_completion, coalesce(d.k, least(la.n, lb.n)) = la.n AS stable FROM la JOIN lb USING (conv_id) LEFT JOIN d USING (conv_id)""")
def trajectory_split(spark, sf_dir):
    return op.split_at_common_prefix(*_prefix(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type, value FROM events)
    SELECT conv_id, i::INT AS call_idx, CASE WHEN i % 7 = 3 THEN NULL ELSE event_type END AS tool_name FROM e""")
def tool_name_lookup(spark, sf_dir):
    calls = tool_calls(spark, sf_dir)
    orphan = F.when(F.col("call_idx") % 7 == 3, F.concat(F.lit("lost:"), "tool_call_id")).otherwise(F.col("tool_call_id"))
    results = calls.select("conv_id", "call_idx", orphan.alias("tool_call_id"))
    return op.tool_names(calls, results).select("conv_id", "call_idx", "tool_name")


_COMPLETIONS = """e AS (SELECT event_id AS id, event_type, json_extract_string(props, '$.k') AS k, event_id % 5 AS kind FROM events)"""


@query(f"""WITH {_COMPLETIONS} SELECT id, 0 AS call_idx,
      CASE WHEN kind IN (3, 4) OR kind = 2 THEN (CASE kind WHEN 4 THEN 'no_' || event_type END) ELSE (CASE WHEN kind = 0 THEN event_type END) END AS name,
      CASE WHEN kind IN (0, 4) THEN k END AS arg_k,
      CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'unclosed' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'missing_name' ELSE 'unknown_tool' END AS status FROM e""")
def parse_hermes_calls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind, call = F.col("event_id") % 5, lambda name: F.concat(F.lit('\n{"name": "'), name, F.lit('", "arguments": '), F.col("props"), F.lit("}\n"))
    body = (
        F.when(kind == 0, F.concat(call(F.col("event_type")), F.lit("</tool_call>")))
        .when(kind == 1, call(F.col("event_type")))
        .when(kind == 2, F.concat(F.lit('\n{"name": '), F.col("event_type"), F.lit(", oops\n</tool_call>")))
        .when(kind == 3, F.concat(F.lit('\n{"arguments": '), F.col("props"), F.lit("}\n</tool_call>")))
        .otherwise(F.concat(call(F.concat(F.lit("no_"), "event_type")), F.lit("</tool_call>")))
    )
    completions = events.select(F.col("event_id").alias("id"), F.concat(F.lit("I will.\n<tool_call>"), body).alias("text"))
    parsed = op.parse_hermes(completions, events.select(F.col("event_type").alias("name")))
    keep = F.col("status").isin("ok", "unknown_tool")
    return parsed.select("id", "call_idx", "name", F.when(keep, F.get_json_object("arguments", "$.k")).alias("arg_k"), "status")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '\"' || event_type || '\"' ELSE value::DECIMAL(18,2)::VARCHAR END AS value_json, event_id % 3 = 0 AND event_id % 2 = 1 AS fell_back FROM events")
def argument_coercion(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    type_ = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "string").otherwise("number")).otherwise("number")
    value, fell = coerce_argument(text, type_)
    return events.select("event_id", value.alias("value_json"), fell.alias("fell_back"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id, event_type FROM events)
    SELECT user_id, count(*)::BIGINT AS n_prompt_and_completion, max(i) FILTER (event_type = 'signup')::BIGINT AS closed_at FROM e GROUP BY 1""")
def turn_close(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    last = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("closer")).agg(F.max("at").alias("last"))
    placed = events.join(last, F.col("user_id").eqNullSafe(F.col("closer")), "left")
    return placed.groupBy("user_id").agg(F.count("*").alias("n_prompt_and_completion"), F.when(F.count("last") > 0, F.count_if(F.col("at") <= F.col("last"))).alias("closed_at"))


def _candidates(spark, sf_dir):
    """Per user and hour of day five candidate tokens with log-probabilities, ties included."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("user_id").alias("resp_id"), F.hour("ts").alias("pos"), "event_type").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("resp_id", "pos"))
    return counts.select("resp_id", "pos", F.length("event_type").cast("bigint").alias("l"), "event_type", (F.col("c") / total).alias("p")).withColumn("token_id", F.col("l") * 1000 + F.ascii("event_type")).withColumn("logprob", F.log("p"))


_CANDIDATES = """q AS (SELECT user_id AS resp_id, extract(hour FROM ts)::INT AS pos, event_type, count(*) AS c FROM events GROUP BY 1, 2, 3),
    cand AS (SELECT *, c / sum(c) OVER (PARTITION BY resp_id, pos) AS p, (length(event_type) * 1000 + ascii(event_type))::BIGINT AS token_id FROM q)"""


@query(f"""WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY resp_id, pos ORDER BY c DESC, token_id) AS rk FROM cand),
    e AS (SELECT *, max(CASE WHEN rk = 3 THEN c END) OVER (PARTITION BY resp_id, pos) AS edge FROM r)
    SELECT resp_id, pos, token_id, rk::INT AS rank FROM e WHERE rk <= 2 AND (edge IS NULL OR c > edge)""")
def sampler_head(spark, sf_dir):
    return op.sampler_head(_candidates(spark, sf_dir), 2).select("resp_id", "pos", "token_id", "rank")


@query(f"WITH {_CANDIDATES} SELECT resp_id, pos, round(sum(p), 6) AS mass, count(*)::BIGINT AS n, count(DISTINCT token_id)::BIGINT AS n_distinct FROM cand GROUP BY 1, 2")
def support_mass(spark, sf_dir):
    return op.support_mass(_candidates(spark, sf_dir))


@query(f"""WITH {_COMPLETIONS}, s AS (SELECT id, kind, CASE WHEN id % 2 = 0 THEN 'stop' ELSE 'length' END AS fr FROM e) SELECT id, CASE WHEN kind = 0 AND fr = 'stop' THEN 'tool_calls' ELSE fr END AS finish_reason FROM s""")
def finish_reason(spark, sf_dir):
    calls = parse_hermes_calls(spark, sf_dir)
    responses = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "stop").otherwise("length").alias("finish_reason"))
    return op.promoted_finish_reason(responses, calls).select("id", "finish_reason")


@query(_TOKENS + "SELECT conv_id, count(*)::BIGINT AS n_tokens FROM tok GROUP BY 1 HAVING count(*) > 500")
def overlong_prompts(spark, sf_dir):
    return op.overlong(_qwen3(spark, sf_dir)[1], 500)


@query("SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN value = 0 OR event_id % 17 = 0 THEN 'not_finite' WHEN event_id % 11 = 0 THEN 'wrong_token' ELSE 'ok' END AS status FROM events")
def logprob_validation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lp = F.when(F.col("event_id") % 13 == 0, F.lit(None)).when((F.col("value") == 0) | (F.col("event_id") % 17 == 0), F.lit(float("-inf"))).otherwise(-F.col("value"))
    named = F.concat(F.lit("token_id:"), F.when(F.col("event_id") % 11 == 0, F.col("event_id") + 1).otherwise(F.col("event_id")).cast("string"))
    samples = events.select(F.col("event_id").alias("id"), F.col("event_id").alias("token_id"), named.alias("token"), lp.cast("double").alias("logprob"))
    return op.validate_logprobs(samples).select("id", "status")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '{"name": oops}' WHEN 2 THEN 'say ' || event_type ELSE props END AS content, CASE WHEN event_id % 4 = 0 THEN event_type END AS name,
      CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') END AS arg_k FROM events""")
def parse_llama_calls(spark, sf_dir):
    kind = F.col("event_id") % 4
    body = F.when(kind == 0, F.concat(F.lit('\n\n{"name": "'), "event_type", F.lit('", "parameters": '), "props", F.lit("}  "))).when(kind == 1, F.lit('{"name": oops}')).when(kind == 2, F.concat(F.lit(" say "), "event_type")).otherwise(F.col("props"))
    completions = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("<|start_header_id|>assistant<|end_header_id|>"), body).alias("text"))
    return op.parse_llama(completions).select("id", "content", "name", F.get_json_object("arguments", "$.k").alias("arg_k"))


@query("""WITH e AS (SELECT event_id AS id, event_type, event_id % 7 AS kind, (event_id % 100)::VARCHAR AS v FROM events)
    SELECT id, 0 AS call_idx, CASE WHEN kind = 1 OR kind = 2 THEN NULL WHEN kind = 3 THEN 'no_' || event_type ELSE event_type END AS name,
      CASE kind WHEN 1 THEN NULL WHEN 2 THEN '{"n":' || v || ',"s":' || v || '}' WHEN 4 THEN '{"n":' || v || '}' WHEN 5 THEN '{"n":"' || v || ' apples","s":"' || v || '"}' WHEN 6 THEN '{}' ELSE '{"n":' || v || ',"s":"' || v || '"}' END AS arguments,
      CASE kind WHEN 1 THEN 'unclosed' WHEN 2 THEN 'missing_name' WHEN 3 THEN 'unknown_tool' WHEN 4 THEN 'malformed' WHEN 5 THEN 'invalid_json' ELSE 'ok' END AS status FROM e""")
def parse_glm_calls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind, v = F.col("event_id") % 7, (F.col("event_id") % 100).cast("string")
    arg = lambda k, x, end="</arg_value>": F.concat(F.lit(f"<arg_key>{k}</arg_key>\n<arg_value> "), x, F.lit(f" {end}\n"))
    name = F.when(kind == 2, F.lit(" ")).when(kind == 3, F.concat(F.lit("no_"), "event_type")).otherwise(F.col("event_type"))
    args = F.when(kind == 4, F.concat(arg("n", v), arg("s", v, ""))).when(kind == 5, F.concat(arg("n", F.concat(v, F.lit(" apples"))), arg("s", v))).when(kind == 6, F.lit("")).otherwise(F.concat(arg("n", F.lit("0")), arg("n", v), arg("s", v)))
    completions = events.select(F.col("event_id").alias("id"), F.concat(F.lit("Well.<tool_call>"), name, F.lit("\n"), args, F.when(kind == 1, "").otherwise("</tool_call>")).alias("text"))
    names = events.select(F.col("event_type").alias("name")).distinct()
    params = names.union(names.select(F.concat(F.lit("no_"), "name"))).select("name", F.lit("s").alias("key"), F.lit("string").alias("type"))
    return op.parse_glm(completions, names, params).drop("start", "end", "raw")


@query("""WITH l AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
    SELECT conv_id, CASE conv_id % 4 WHEN 1 THEN 'length' WHEN 2 THEN 'value' WHEN 3 THEN 'value' END AS fault FROM l""")
def mask_faults(spark, sf_dir):
    messages = conversations(spark, sf_dir)
    n = messages.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    kind, ones = F.col("conv_id") % 4, F.array_repeat(F.lit(1), F.col("n"))
    tail = F.when(kind == 2, F.lit(2)).otherwise(F.lit(None).cast("int"))
    mask = F.when(kind == 0, ones).when(kind == 1, F.concat(ones, F.array(F.lit(0)))).otherwise(F.concat(F.slice(ones, F.lit(1), F.col("n") - 1), F.array(tail)))
    return op.mask_faults(messages, n.select("conv_id", mask.alias("mask")))


@query("SELECT event_id AS id, substr(sha256(event_type), 1, 32) AS key, min(event_id) OVER (PARTITION BY event_type) AS first_id FROM events")
def media_dedupe(spark, sf_dir):
    media = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").cast("binary").alias("bytes"))
    return op.media_keys(media).select("id", "key", "first_id")


# Conversations in which some users are tool results, and indices start at 5 and have gaps.
_TOOL = "(CASE WHEN role = 'user' AND turn > 0 AND (conv_id + turn // 2) % 2 = 1 THEN 'tool' ELSE role END)"
_X = f"""c0 AS (SELECT conv_id, turn::INT AS turn, {_TOOL} AS role, CASE WHEN turn % 5 = 3 AND role <> 'assistant' THEN NULL ELSE text END AS text FROM conversations),
    c AS (SELECT conv_id, turn AS msg_idx, role, coalesce(text, '{{null}}') AS content FROM c0)"""


def with_tools(spark, sf_dir):
    messages = conversations(spark, sf_dir)
    tool = (F.col("role") == "user") & (F.col("msg_idx") > 0) & ((F.col("conv_id") + F.floor(F.col("msg_idx") / 2)) % 2 == 1)
    content = F.when((F.col("msg_idx") % 5 == 3) & (F.col("role") != "assistant"), F.lit(None)).otherwise(F.col("content"))
    return messages.select("conv_id", (F.col("msg_idx") * 2 + 5).alias("msg_idx"), F.when(tool, "tool").otherwise(F.col("role")).alias("role"), content.alias("content"))


_TOOL_TEXT = {
    "qwen3": (f"(CASE WHEN coalesce(prev_role, '') <> 'tool' THEN '<|im_start|>user' ELSE '' END) || {_N} || '<tool_response>' || {_N} || content || {_N} || '</tool_response>' || (CASE WHEN coalesce(next_role, '') <> 'tool' THEN '<|im_end|>' || {_N} ELSE '' END)", ""),
    "qwen3.5": (f"(CASE WHEN coalesce(prev_role, '') <> 'tool' THEN '<|im_start|>user' ELSE '' END) || {_N} || '<tool_response>' || {_N} || {_strip('content')} || {_N} || '</tool_response>' || (CASE WHEN coalesce(next_role, '') <> 'tool' THEN '<|im_end|>' || {_N} ELSE '' END)", ""),
    "glm-4.5": (f"(CASE WHEN coalesce(prev_role, '') <> 'tool' THEN '<|observation|>' ELSE '' END) || {_N} || '<tool_response>' || {_N} || content || {_N} || '</tool_response>'", "None"),
    "glm-5": ("(CASE WHEN coalesce(prev_role, '') <> 'tool' THEN '<|observation|>' ELSE '' END) || '<tool_response>' || content || '</tool_response>'", "None"),
    "deepseek-v3": ("(CASE WHEN coalesce(prev_role, '') <> 'tool' THEN '<｜tool▁outputs▁begin｜>' ELSE '' END) || '<｜tool▁output▁begin｜>' || content || '<｜tool▁output▁end｜>' || (CASE WHEN coalesce(next_role, '') <> 'tool' THEN '<｜tool▁outputs▁end｜>' ELSE '' END)", ""),
    "deepseek-r1": ("(CASE WHEN coalesce(prev_role, '') <> 'tool' THEN '<｜tool▁outputs▁begin｜>' ELSE '' END) || '<｜tool▁output▁begin｜>' || content || '<｜tool▁output▁end｜>' || (CASE WHEN coalesce(next_role, '') <> 'tool' THEN '<｜tool▁outputs▁end｜>' ELSE '' END)", ""),
    "kimi-k2": (f"'<|im_system|>tool<|im_middle|>## Return of ' || {_N} || content || '<|im_end|>'", ""),
    "llama-3": (f"'<|start_header_id|>ipython<|end_header_id|>' || {_N} || {_N} || (CASE WHEN content = '' THEN '' ELSE to_json(content)::VARCHAR END) || '<|eot_id|>'", ""),
    "minimax-m2": (f"(CASE WHEN coalesce(prev_role, '') <> 'tool' THEN ']~b]tool' ELSE '' END) || {_N} || '<response>' || content || '</response>' || (CASE WHEN coalesce(next_role, '') <> 'tool' THEN '[e~[' || {_N} ELSE '' END)", "None"),
}


_TOOL_TEXT |= {"qwen3.6": _TOOL_TEXT["qwen3.5"], "glm-5.1": _TOOL_TEXT["glm-5"]}

# Calls that assistants make: none, one or two by (conv_id + turn) % 3; llama-3 takes one at most. Of each format: where in its SQL
# the calls come, what is before the first and between two, what wraps them all, and one call as text.
_ARGS = '{"q": "a, b", "n": 3, "deep": {"x": [1, 2], "y": "c:d"}, "on": true, "off": null}'
_DEEP = '{"x": [1, 2], "y": "c:d"}'
_KEYS = {"q": "a, b", "n": "3", "deep": _DEEP, "on": "true", "off": "null"}
_NCALLS = "(CASE WHEN role = 'assistant' THEN (conv_id + msg_idx) % 3 ELSE 0 END)"
_GLM45 = "<tool_call>look\n" + "".join(f"<arg_key>{k}</arg_key>\n<arg_value>{v}</arg_value>\n" for k, v in _KEYS.items()) + "</tool_call>"
_INVOKE = '<invoke name="look">\n' + "".join(f'<parameter name="{k}">{v}</parameter>\n' for k, v in _KEYS.items()) + "</invoke>\n"
_CALL_TEXT = {
    "qwen3": ("|| '<|im_end|>'", f"(CASE WHEN body <> '' THEN {_N} ELSE '' END)", "\n", "", "", f'<tool_call>\n{{"name": "look", "arguments": {_ARGS}}}\n</tool_call>'),
    "qwen3.5": ("|| '<|im_end|>'", f"(CASE WHEN {_strip('body')} <> '' THEN {_N} || {_N} ELSE '' END)", "\n", "", "", "<tool_call>\n<function=look>\n" + "".join(f"<parameter={k}>\n{ {'true': 'True', 'null': 'None'}.get(v, v)}\n</parameter>\n" for k, v in _KEYS.items()) + "</function>\n</tool_call>"),
    "glm-4.5": (" ELSE '<|' || role", _N, "\n", "", "", _GLM45),
    "glm-5": (" ELSE '<|' || role", "''", "", "", "", _GLM45.replace("\n", "")),
    "deepseek-v3": ("|| '<｜end▁of▁sentence｜>'", "''", "", "<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>", f"<｜tool▁call▁begin｜>function<｜tool▁sep｜>look\n```json\n{_ARGS}\n```<｜tool▁call▁end｜>"),
    "deepseek-r1": ("|| '<｜end▁of▁sentence｜>'", "''", "", "<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>", f"<｜tool▁call▁begin｜>function<｜tool▁sep｜>look\n```json\n{_ARGS}\n```<｜tool▁call▁end｜>"),
    "kimi-k2": ("|| '<|im_end|>'", "''", "", "<|tool_calls_section_begin|>", "<|tool_calls_section_end|>", f"<|tool_call_begin|>functions.look:0<|tool_call_argument_begin|>{_ARGS}<|tool_call_end|>"),
    "llama-3": ("", "", "", "", "", f'{{"name": "look", "parameters": {_ARGS}}}'),
    "minimax-m2": ("|| '[e~['", _N, "", "<minimax:tool_call>\n", "</minimax:tool_call>", _INVOKE),
}
_CALL_TEXT["glm-5.1"] = _CALL_TEXT["glm-5"]
_CALL_TEXT["qwen3.6"] = tuple(x.replace("\nTrue\n", "\ntrue\n").replace("\nNone\n", "\nnull\n") for x in _CALL_TEXT["qwen3.5"])


def with_calls(messages: DataFrame, most: int) -> DataFrame:
    """messages, numbered from 5 in steps of 2, whose assistants call a tool."""
    call = F.struct(F.lit("functions.look:0").alias("id"), F.lit("look").alias("name"), F.lit(_ARGS).alias("arguments"))
    n = F.least((F.col("conv_id") + F.floor((F.col("msg_idx") - 5) / 2)) % 3, F.lit(most)).cast("int")
    return messages.withColumn("calls", F.when(F.col("role") == "assistant", F.array_repeat(call, n)))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _register_tools(family: str, called: bool) -> None:
    name = ("render_calls_" if called else "render_tools_") + family.replace("-", "_").replace(".", "_")
    (result, null), (message, begin, prompt) = _TOOL_TEXT[family], _FORMATS[family]
    facts_sql = _facts_sql("c").replace("AS prev_role,", "AS prev_role, lead(role) OVER (PARTITION BY conv_id ORDER BY msg_idx) AS next_role,")
    if called:
        place, before, between, lead, tail, one = _CALL_TEXT[family]
        if family == "llama-3":
            head = f"'<|start_header_id|>assistant<|end_header_id|>' || {_N} || {_N}"
            message = f"CASE WHEN {_NCALLS} > 0 THEN {head} || {_quote(one)} || '<|eot_id|>' ELSE {message} END"
        else:
            calls = f"(CASE WHEN {_NCALLS} > 0 THEN {before} || {_quote(lead + one)} || (CASE WHEN {_NCALLS} = 2 THEN {_quote(between + one)} ELSE '' END) || {_quote(tail)} ELSE '' END)"
            message = message.replace(place, f" || {calls} {place}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        messages = with_tools(spark, sf_dir)
        if called:
            messages = with_calls(messages, 1 if family == "llama-3" else 2)
        return op.render_text(messages, family).select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"""WITH {_X.replace('{null}', null)}, {facts_sql}, r AS (SELECT conv_id, msg_idx, (CASE WHEN msg_idx = 0 THEN {begin} ELSE '' END) || (CASE WHEN role = 'tool' THEN {result} ELSE {message} END) || (CASE WHEN msg_idx = n - 1 AND role <> 'assistant' THEN {prompt} ELSE '' END) AS x FROM f)
      SELECT conv_id, md5(string_agg(x, '' ORDER BY msg_idx)) AS text_md5, length(string_agg(x, '' ORDER BY msg_idx))::BIGINT AS n_chars FROM r GROUP BY 1"""


for _family in _TOOL_TEXT:
    _register_tools(_family, False)
    _register_tools(_family, True)


@query("""WITH l AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), x AS (SELECT conv_id, n, unnest(generate_series(0, n - 1)) AS i FROM l)
    SELECT conv_id AS id, string_agg(CASE WHEN i >= 1 AND i < 3 THEN '1' WHEN i >= 4 AND i < 5 THEN '2' ELSE '0' END, '' ORDER BY i) AS types FROM x GROUP BY 1""")
def placeholder_types(spark, sf_dir):
    lengths = conversations(spark, sf_dir).groupBy(F.col("conv_id").alias("id")).agg(F.count("*").cast("int").alias("n"))
    ranges = lengths.select("id", F.inline(F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("length"), F.lit(1).alias("type")), F.struct(F.lit(4).alias("start"), F.lit(1).alias("length"), F.lit(2).alias("type")))))
    return op.placeholder_types(ranges, lengths)


@query("""WITH l AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1), n AS (SELECT c.conv_id, c.role FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.t)
    SELECT conv_id, CASE WHEN role = 'assistant' THEN 'assistant' WHEN role = 'user' THEN 'user_query' WHEN conv_id % 2 = 1 THEN 'synthesize_close' ELSE 'bridge' END AS status FROM n""")
def bridge_eligibility(spark, sf_dir):
    messages = facts(conversations(spark, sf_dir))
    last = messages.where(F.col("msg_idx") == F.col("n") - 1).select("conv_id", "role")
    return op.bridge_eligibility(last.select("conv_id", (F.col("conv_id") % 2 == 0).alias("closed")), last, "tool_cycle")


# What a bridge puts after the close of an assistant turn, and whether its ids are those of a whole new render.
_AFTER_CLOSE = {"qwen3": (_N, False), "qwen3.5": (_N, False), "qwen3.6": (_N, False), "deepseek-v3": ("''", True), "deepseek-r1": ("''", False), "kimi-k2": ("''", True), "llama-3": ("''", True), "minimax-m2": (_N, False)}


def _register_bridge(family: str) -> None:
    name = "bridge_" + family.replace("-", "_").replace(".", "_")
    (after, same), retention = _AFTER_CLOSE[family], FAMILIES[family].retention
    (result, null), (message, _, prompt) = _TOOL_TEXT[family], _FORMATS[family]
    facts_sql = _facts_sql("c").replace("AS prev_role,", "AS prev_role, lead(role) OVER (PARTITION BY conv_id ORDER BY msg_idx) AS next_role, max(CASE WHEN role = 'assistant' THEN msg_idx END) OVER w AS la,")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        messages = with_tools(spark, sf_dir)
        last = F.max(F.when(F.col("role") == "assistant", F.col("msg_idx"))).over(Window.partitionBy("conv_id"))
        placed = messages.withColumn("la", last).where("la is not null")
        new = placed.where("msg_idx > la").drop("la")
        segs = segments(messages, family)
        # The turn's own tokens up to its close; what follows them is the extension's.
        truncated = (F.col("conv_id") % 3 == 0).cast("int")
        turns = op.turn_ids(segs, placed.select("conv_id", F.col("la").alias("turn")).distinct()).withColumnRenamed("token_ids", "whole")
        previous = turns.withColumn("completion_ids", F.slice("completion_ids", F.lit(1), F.greatest(F.size("completion_ids") - truncated, F.lit(0))))
        bridged = op.bridge(previous, new, family)
        compared = [F.when(F.col("token_ids").isNotNull(), F.when(F.col("token_ids") == F.col("whole"), "same").otherwise("other")).alias("as_rendered")] if same else []
        return bridged.select("conv_id", "status", F.md5(F.col("extension").cast("binary")).alias("extension_md5"), *compared)

    refused = {"all": "", "template": "WHEN true THEN 'template'", "tool_cycle": "WHEN bool_or(role = 'user') THEN 'user_query'"}[retention]
    QUERIES[name] = run
    ORACLE_SQL[name] = f"""WITH {_X.replace('{null}', null)}, {facts_sql}, r AS (SELECT conv_id, msg_idx, role, (CASE WHEN role = 'tool' THEN {result} ELSE {message} END) || (CASE WHEN msg_idx = n - 1 THEN {prompt} ELSE '' END) AS x FROM f WHERE msg_idx > la),
      b AS (SELECT conv_id, CASE {refused} WHEN conv_id % 3 = 0 THEN 'synthesize_close' ELSE 'bridge' END AS status, md5({after} || string_agg(x, '' ORDER BY msg_idx)) AS m FROM r GROUP BY 1)
      SELECT a.conv_id, coalesce(status, 'no_messages') AS status, CASE WHEN status IN ('bridge', 'synthesize_close') THEN m END AS extension_md5{", CASE WHEN status IN ('bridge', 'synthesize_close') THEN 'same' END AS as_rendered" if same else ''}
      FROM (SELECT DISTINCT conv_id FROM f WHERE la IS NOT NULL) a LEFT JOIN b ON a.conv_id = b.conv_id"""


for _family in op.BRIDGED:
    _register_bridge(_family)


# Of formats that bridge over any message: what a stop and a header before a turn are, what ends the turn, and a user message with what follows it.
_OPEN_ENDS = {
    "deepseek-v3": ("<｜end▁of▁sentence｜>", "<｜Assistant｜>", "'<｜User｜>' || content || '<｜Assistant｜>'", ("<｜end▁of▁sentence｜>", "<｜Assistant｜>", "<｜User｜>")),
    "kimi-k2": ("<|im_end|>", "<|im_assistant|>assistant<|im_middle|>", "'<|im_user|>user<|im_middle|>' || content || '<|im_end|><|im_assistant|>assistant<|im_middle|>'", ("<|im_end|>", "<|im_assistant|>", "<|im_middle|>", "<|im_user|>")),
}


def _register_open_ends(family: str) -> None:
    from turnframe.operators.tagged import completion_tokens

    stop, header, message, specials = _OPEN_ENDS[family]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), F.col("text").alias("content"))
        kind = F.col("conv_id") % 6
        prompt = F.concat(F.lit(stop + header), F.when(kind >= 4, "<think>\n").otherwise(""))
        said = F.concat(F.when(kind < 4, "<think>").otherwise(""), "content", F.when(kind == 2, "</think>").otherwise(""), F.when(kind.isin(0, 2, 5), stop).otherwise(""))
        ids = lambda x: F.transform(completion_tokens(x, specials), token_id)
        previous = turns.select("conv_id", ids(prompt).alias("prompt_ids"), ids(said).alias("completion_ids"))
        new = turns.select("conv_id", F.lit(5).alias("msg_idx"), F.lit("user").alias("role"), "content")
        return op.bridge(previous, new, family).select("conv_id", "status", F.md5(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary")).alias("ids_md5"))

    marks = "|".join(x.replace("|", r"\|") for x in specials)
    name = "bridge_open_reasoning_" + family.replace("-", "_")
    QUERIES[name] = run
    ORACLE_SQL[name] = f"""WITH t AS (SELECT conv_id * 1000 + turn AS conv_id, text AS content, (conv_id * 1000 + turn) % 6 AS kind FROM conversations WHERE role = 'user'),
      x AS (SELECT conv_id, kind, '{stop}{header}' || CASE WHEN kind >= 4 THEN '<think>' || chr(10) ELSE '<think>' END || content || CASE WHEN kind IN (1, 2, 3, 4) THEN '</think>' ELSE '' END || '{stop}' || {message} AS whole FROM t)
      SELECT conv_id, CASE WHEN kind IN (0, 5) THEN 'open_reasoning' WHEN kind = 2 THEN 'bridge' ELSE 'synthesize_close' END AS status,
        CASE WHEN kind NOT IN (0, 5) THEN md5(array_to_string(list_transform(regexp_extract_all(whole, '{marks}|{_PIECE}'), lambda p: ('0x' || substr(md5(p), 1, 8))::BIGINT), ',')) END AS ids_md5 FROM x"""


for _family in _OPEN_ENDS:
    _register_open_ends(_family)
