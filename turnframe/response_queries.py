"""Registered queries on completions: what is reasoning, what content, which calls and where, format by format.

Completions are made of the turns of conversations, whose texts become values of calls. The SQL takes the same completions
apart on its own: it cuts them into tokens, finds markers by their positions and values by patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.functions import PIECE, quoted
from turnframe.operators import responses as r
from turnframe.registry import ORACLE_SQL, QUERIES, query
from turnframe.sources import table

# Of each format: a call up to its end, its end, what leads and ends a section of calls, and a call without a name. In templates
# @f@ is a name, @n@ a number, @s@ a text, @q@ the text as JSON.
_J = '{"n": @n@, "s": @q@}'
_K = "<arg_key>n</arg_key>\n<arg_value>@n@</arg_value>\n<arg_key>s</arg_key>\n<arg_value>@s@</arg_value>\n"
_WRITE: dict[str, tuple[str, str, str, str, str]] = {
    "qwen3": ('<tool_call>\n{"name": "@f@", "arguments": ' + _J + "}\n", "</tool_call>", "", "", '<tool_call>{"name": "", "arguments": ' + _J + "}"),
    "qwen3.5": ("<tool_call>\n<function=@f@>\n<parameter=n>\n@n@\n</parameter>\n<parameter=s>\n@s@\n</parameter>\n</function>\n", "</tool_call>", "", "", "<tool_call><parameter=n>@n@</parameter>"),
    "glm": ("<tool_call>@f@\n" + _K, "</tool_call>", "", "", "<tool_call>\n" + _K),
    "minimax-m2": ('<minimax:tool_call>\n<invoke name="@f@">\n<parameter name="n">@n@</parameter>\n<parameter name="s">@s@</parameter>\n</invoke>\n', "</minimax:tool_call>", "", "", '<minimax:tool_call><parameter name="n">@n@</parameter>'),
    "deepseek-v3": ("<｜tool▁call▁begin｜>function<｜tool▁sep｜>@f@\n```json\n" + _J + "\n```", "<｜tool▁call▁end｜>", "<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>", "<｜tool▁call▁begin｜>function<｜tool▁sep｜>"),
    "deepseek-v4": ('<｜DSML｜invoke name="@f@">\n<｜DSML｜parameter name="n" string="false">@n@</｜DSML｜parameter>\n<｜DSML｜parameter name="s" string="true">@s@</｜DSML｜parameter>\n', "</｜DSML｜invoke>", "\n\n<｜DSML｜tool_calls>\n", "\n</｜DSML｜tool_calls>", '<｜DSML｜invoke name="">\n<｜DSML｜parameter name="n" string="false">@n@</｜DSML｜parameter>debris'),
    "kimi-k2": ("<|tool_call_begin|>functions.@f@:0<|tool_call_argument_begin|>" + _J, "<|tool_call_end|>", "<|tool_calls_section_begin|>", "<|tool_calls_section_end|>", "<|tool_call_begin|>functions.:0<|tool_call_argument_begin|>" + _J),
    "hy3": ("<tool_call:opensource>@f@<tool_sep:opensource>\n" + re.sub(r"(arg_\w+)>", r"\1:opensource>", _K), "</tool_call:opensource>", "<tool_calls:opensource>\n", "\n</tool_calls:opensource>", "<tool_call:opensource><tool_sep:opensource>" + re.sub(r"(arg_\w+)>", r"\1:opensource>", _K)),
    "laguna": ("<tool_call>@f@\n" + _K, "</tool_call>", "", "", "<tool_call>\n" + _K),
}
_OPENERS = {"minimax-m2": "<minimax:tool_call>", "deepseek-v3": "<｜tool▁call▁begin｜>", "kimi-k2": "<|tool_call_begin|>", "hy3": "<tool_call:opensource>"}
_PARSE = {"qwen3": lambda p, _: r.parse_hermes(p), "qwen3.5": r.parse_xml, "glm": lambda p, t: r.parse_glm(p, None, t), "minimax-m2": r.parse_minimax, "deepseek-v3": lambda p, _: r.parse_deepseek(p), "deepseek-v4": lambda p, _: r.parse_deepseek_v4(p), "kimi-k2": lambda p, _: r.parse_kimi(p), "hy3": r.parse_hy3, "laguna": r.parse_laguna}


def _think(family: str, x: str) -> str:
    return f"<{x}:opensource>" if family == "hy3" else f"<{x}>"


def _kinds(family: str) -> list[str]:
    """Templates of completions: calls of all sorts, drafts in reasoning, cut off in reasoning, spelled markers, stops."""
    call, end, lead, tail, nameless = _WRITE[family]
    open_, close, stop = _think(family, "think"), _think(family, "/think"), r.GRAMMARS[family].stops[0]
    one = lead + call + end + tail
    return [
        f"Well, @s@{one}",
        f"{open_}\nwhy @n@\n{close}\n\nSaid.{lead}{call}{end}{call.replace('@f@', '@f@2')}{end}{tail}",
        f"Cut.{lead}{call}",
        f"Nobody.{lead}{nameless}{end}{tail}",
        f"{open_}@s@",
        f"{open_}{one}{close}done{stop}{one}",
        f"{open_}{close}{one.replace('@n@', '@n@ apples')}",
        f" {close} @s@ {open_}late",
        "",
    ]


_SQL = {"f": "role", "n": "length(text)::VARCHAR", "s": "text", "q": "to_json(text)::VARCHAR"}


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql(template: str) -> str:
    """A template as SQL."""
    return " || ".join(_literal(x) if k % 2 == 0 else _SQL[x] for k, x in enumerate(re.split("@([fnsq])@", template)))


def _column(template: str) -> Column:
    values = {"f": F.col("role"), "n": F.length("text").cast("string"), "s": F.col("text"), "q": quoted(F.col("text"))}
    return F.concat(*[F.lit(x) if k % 2 == 0 else values[x] for k, x in enumerate(re.split("@([fnsq])@", template))])


def completions(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    kinds = _kinds(family)
    text = F.lit("")
    for k, template in enumerate(kinds):
        text = F.when(F.col("id") % len(kinds) == k, _column(template)).otherwise(text)
    return turns.select("id", text.alias("text"))


def _taken_apart(family: str) -> str:
    """SQL: cut (id, t) has each completion's tokens, body (id, t, thinks, p0) the place of the first that is not reasoning, blk its calls' places."""
    g, kinds = r.GRAMMARS[family], _kinds(family)
    cases = " ".join(f"WHEN {k} THEN {_sql(t)}" for k, t in enumerate(kinds))
    spelled = sorted(g.machine.spelled, key=len, reverse=True) if family == "deepseek-v4" else ["<think>", "</think>"] if g.machine.spelled else []
    specials = "|".join(re.escape(x).replace("'", "''") for x in sorted({*g.specials, *spelled}, key=len, reverse=True))
    start, end = _OPENERS.get(family, "<tool_call>"), _WRITE[family][1]
    if family == "deepseek-v4":
        start = "<｜DSML｜invoke"
    section = {"deepseek-v3": "<｜tool▁calls▁begin｜>", "kimi-k2": "<|tool_calls_section_begin|>"}.get(family, start)
    first = f"list_position(t, {_literal(section)})"
    ends_reasoning = bool(g.machine.openers) or g.free and family == "glm"
    shut = f"list_position(t, {_literal(_think(family, '/think'))})"
    after_close = f"coalesce(nullif({shut}, 0) + 1, {f'nullif({first}, 0)' if ends_reasoning else 'NULL'}, len(t) + 1)"
    return f"""made AS (SELECT conv_id * 1000 + turn AS id, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
      whole AS (SELECT id, CASE id % {len(kinds)} {cases} END AS text FROM made),
      tok AS (SELECT id, regexp_extract_all(text, '{specials}|{PIECE}') AS t FROM whole),
      cut AS (SELECT id, CASE WHEN list_position(t, {_literal(g.stops[0])}) > 0 THEN t[: list_position(t, {_literal(g.stops[0])}) - 1] ELSE t END AS t FROM tok),
      led AS (SELECT id, t, coalesce(list_filter(t, lambda x: regexp_replace(x, '\\s', '', 'g') <> '')[1], '') = {_literal(_think(family, 'think'))} AS thinks FROM cut),
      body AS (SELECT id, t, thinks, {f'CASE WHEN thinks THEN {after_close} ELSE 1 END' if not g.free else '1'} AS p0 FROM led)"""


def _blk(family: str) -> str:
    start, end = _OPENERS.get(family, "<｜DSML｜invoke" if family == "deepseek-v4" else "<tool_call>"), _WRITE[family][1]
    return f"""blk AS (
        SELECT id, t, 0 AS call_idx, p0 - 1 + nullif(list_position(t[p0 :], {_literal(start)}), 0) AS s FROM body
        UNION ALL
        SELECT id, t, call_idx + 1, e + nullif(list_position(t[e + 1 :], {_literal(start)}), 0) FROM (SELECT *, s + nullif(list_position(t[s + 1 :], {_literal(end)}), 0) AS e FROM blk) WHERE s IS NOT NULL AND e IS NOT NULL),
      call AS (SELECT id, call_idx, {_count(family, 's - 1')} AS b, {_count(family, f'coalesce(e, {_limit(family)})')} AS x, e IS NOT NULL AS closed, array_to_string(t[s + 1 : coalesce(e - 1, {_limit(family)})], '') AS inner_text
        FROM (SELECT *, s + nullif(list_position(t[s + 1 :], {_literal(end)}), 0) AS e FROM blk WHERE s IS NOT NULL))"""


def _count(family: str, to: str) -> str:
    """SQL: how many tokens the first pieces are. Spelled markers, which the SQL has whole, are several."""
    machine = r.GRAMMARS[family].machine
    if not machine.spelled:
        return to
    spelled = ", ".join(map(_literal, machine.spelled))
    return f"coalesce(list_sum(list_transform(t[: {to}], lambda p: CASE WHEN p IN ({spelled}) THEN len(regexp_extract_all(p, '｜DSML｜|{PIECE}')) ELSE 1 END)), 0)::BIGINT"


def _limit(family: str) -> str:
    """Where a call without an end ends: with its section, or with the completion."""
    ends = {"deepseek-v3": "<｜tool▁calls▁end｜>", "kimi-k2": "<|tool_calls_section_end|>", "deepseek-v4": "</｜DSML｜tool_calls>"}.get(family)
    return f"coalesce(nullif(list_position(t, {_literal(ends)}), 0) - 1, len(t))" if ends else "len(t)"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _inner_sql(family: str) -> str:
    """SQL: name, keys and values (or a JSON text) of a call's inner text, and what is wrong with it."""
    trim = _TRIM.format
    if family == "qwen3":
        return f"""SELECT *, {trim('inner_text')} AS raw, CASE WHEN json_valid({trim('inner_text')}) THEN nullif(json_extract_string({trim('inner_text')}, '$.name'), '') END AS name,
          regexp_extract({trim('inner_text')}, '"arguments": (\\{{.*\\}})\\}}$', 1, 's') AS json, CASE WHEN json_valid({trim('inner_text')}) THEN '' ELSE 'invalid_json' END AS first_fault, '' AS second_fault, json_valid({trim('inner_text')}) AS shown FROM call"""
    if family in ("deepseek-v3", "kimi-k2"):
        mark = "<｜tool▁sep｜>" if family == "deepseek-v3" else "<|tool_call_argument_begin|>"
        said = f"inner_text[strpos(inner_text, '{mark}') + {len(mark)} :]"
        name = f"nullif({trim(f'split_part({said}, chr(10), 1)')}, '')" if family == "deepseek-v3" else f"nullif(split_part(split_part({trim(f'split_part(inner_text, {_literal(mark)}, 1)')}, ':', 1), '.', 2), '')"
        json = f"regexp_extract({said}, '```json\\n(.*)\\n```', 1, 's')" if family == "deepseek-v3" else trim(said)
        return f"SELECT *, inner_text AS raw, {name} AS name, {json} AS json, '' AS first_fault, CASE WHEN json_valid(coalesce(nullif({json}, ''), '{{}}')) THEN '' ELSE 'invalid_json' END AS second_fault, true AS shown FROM call"
    pair, name, fault = {
        "qwen3.5": (r"<parameter=([^>]+)>(.*?)</parameter>", "nullif(regexp_extract(inner_text, '<function=([^>]+)>', 1), '')", "malformed"),
        "glm": (r"<arg_key>(.*?)</arg_key>\s*<arg_value>(.*?)</arg_value>", f"nullif({trim('split_part(inner_text, ' + _literal('<arg_key>') + ', 1)')}, '')", "missing_name"),
        "laguna": (r"<arg_key>(.*?)</arg_key>\s*<arg_value>(.*?)</arg_value>", f"nullif({trim('split_part(inner_text, ' + _literal('<arg_key>') + ', 1)')}, '')", "missing_name"),
        "hy3": (r"<arg_key:opensource>(.*?)</arg_key:opensource>\s*<arg_value:opensource>(.*?)</arg_value:opensource>", f"nullif({trim('split_part(inner_text, ' + _literal('<tool_sep:opensource>') + ', 1)')}, '')", "missing_name"),
        "minimax-m2": (r'<parameter name="([^"]+)">(.*?)</parameter>', "nullif(regexp_extract(inner_text, '<invoke name=\"([^\"]+)\">', 1), '')", "malformed"),
        "deepseek-v4": (r'<｜DSML｜parameter name="(.*?)" string="(?:true|false)">(.*?)</｜DSML｜parameter>', "nullif(regexp_extract(inner_text, '^ name=\"(.*?)\">', 1), '')", "missing_name"),
    }[family]
    return f"""SELECT *, inner_text AS raw, {name} AS name, regexp_extract_all(inner_text, '(?s){pair}', 1) AS keys, list_transform(regexp_extract_all(inner_text, '(?s){pair}', 2), lambda v: {trim('v')}) AS vals,
      CASE WHEN {name} IS NULL AND closed THEN '{fault}' ELSE '' END AS first_fault, '' AS second_fault, {'true' if family == 'deepseek-v4' else f"{name} IS NOT NULL OR '{fault}' = 'missing_name'"} AS shown FROM call"""


def _calls_sql(family: str) -> str:
    apart = _taken_apart(family)
    keyed = family not in ("qwen3", "deepseek-v3", "kimi-k2")
    typed = family != "deepseek-v4"
    if keyed:
        value = lambda k, v: f"CASE WHEN {k} = 's' OR NOT json_valid({v}) THEN to_json({v})::VARCHAR ELSE {v} END"
        args = f"""'{{' || coalesce(array_to_string(list_transform(generate_series(1, len(keys)), lambda i: to_json(keys[i])::VARCHAR || ':' || {value('keys[i]', 'vals[i]')}), ','), '') || '}}'"""
        bad = "len(list_filter(generate_series(1, len(keys)), lambda i: keys[i] <> 's' AND NOT json_valid(vals[i]))) > 0"
        first = "WHEN first_fault <> '' THEN first_fault"
        shown = "closed AND shown" if typed else "true"
    else:
        args = "CASE WHEN coalesce(json, '') = '' THEN '{}' WHEN json_valid(json) THEN json ELSE to_json(json)::VARCHAR END"
        bad, first, shown = "second_fault <> ''", "WHEN first_fault <> '' THEN first_fault WHEN name IS NULL THEN 'missing_name'", "closed AND shown" if family == "qwen3" else "true"
    raw = "raw" if family != "deepseek-v4" else f"'<｜DSML｜invoke' || inner_text || CASE WHEN closed THEN '{_WRITE[family][1]}' ELSE '' END"
    name = "name" if family != "deepseek-v4" else "coalesce(name, '')"
    return f"""WITH RECURSIVE {apart}, {_blk(family)}, parsed AS ({_inner_sql(family)})
      SELECT id, call_idx, CASE WHEN {shown} THEN {name} END AS name, CASE WHEN {shown} THEN {f"json({args})::VARCHAR" if family == "qwen3" else args} END AS arguments,
        CASE WHEN NOT closed THEN 'unclosed' {first} WHEN {bad} THEN 'invalid_json' ELSE 'ok' END AS status, b AS "start", x AS "end", md5({raw}) AS raw_md5 FROM parsed"""


def _name(family: str) -> str:
    return family.replace("-", "_").replace(".", "_")


def _register_calls(family: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = table(spark, sf_dir, "conversations").select("role").distinct()
        params = named.select(F.explode(F.array("role", F.concat("role", F.lit("2")), F.lit(""))).alias("name"), F.lit("s").alias("key"), F.lit("string").alias("type"))
        found = _PARSE[family](r.read_response(completions(spark, sf_dir, family), r.GRAMMARS[family]), params.distinct())
        return found.select("id", "call_idx", "name", "arguments", "status", "start", "end", F.md5("raw").alias("raw_md5"))

    QUERIES["parse_calls_" + _name(family)] = run
    ORACLE_SQL["parse_calls_" + _name(family)] = _calls_sql(family)


def _register_response(family: str) -> None:
    g = r.GRAMMARS[family]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = r.read_response(completions(spark, sf_dir, family), g)
        return read.select("id", F.md5("reasoning").alias("reasoning_md5"), F.md5("content").alias("content_md5"), "complete", F.size("regions").alias("n_calls"))

    apart = _taken_apart(family)
    trim = _TRIM.format
    clean = {"laguna": r"regexp_replace({}, '^\n+|\n+$', '', 'g')", "glm": r"regexp_replace({}, '\s+$', '')", "deepseek-v4": r"regexp_replace({}, '\s+$', '')"}.get(family, _TRIM).format
    close, open_ = _literal(_think(family, "/think")), _literal(_think(family, "think"))
    ender = _literal(_OPENERS.get(family, "<tool_call>") if family != "kimi-k2" else "<|tool_calls_section_begin|>")
    shut = f"list_position(t, {close})"
    ends = f"coalesce(nullif({shut}, 0), {f'nullif(list_position(t, {ender}), 0)' if g.machine.openers or family == 'glm' else 'NULL'})"
    first_tool = {"deepseek-v3": "<｜tool▁calls▁begin｜>", "kimi-k2": "<|tool_calls_section_begin|>", "hy3": "<tool_calls:opensource>", "deepseek-v4": "<｜DSML｜tool_calls>"}.get(family, _OPENERS.get(family, "<tool_call>"))
    reasoning = f"array_to_string(list_filter(t[: coalesce({ends} - 1, len(t))], lambda x: x <> {open_}), '')"
    raw_open = reasoning if not g.free else clean(reasoning)
    tail = "t[p0 :]"
    before = f"array_to_string(CASE WHEN list_position({tail}, {_literal(first_tool)}) > 0 THEN ({tail})[: list_position({tail}, {_literal(first_tool)}) - 1] ELSE {tail} END, '')"
    content = clean(before)
    if family == "glm":
        every = f"regexp_replace(regexp_replace(array_to_string({tail}, ''), '(?s)<tool_call>.*?(</tool_call>|$)', '', 'g'), '</?think>.*$|</think>', '', 'g')"
        content = f"CASE WHEN n_calls > 0 THEN {trim(every)} ELSE array_to_string(list_filter({tail}, lambda x: x <> '</think>' AND x <> '<think>'), '') END"
    if family == "deepseek-v4":
        content = f"CASE WHEN n_calls > 0 AND suffix({before}, chr(10) || chr(10)) THEN ({before})[: -3] ELSE {before} END"
    QUERIES["read_response_" + _name(family)] = run
    if g.free:
        return
    kept = clean(reasoning) if g.keeps_empty else f"nullif({clean(reasoning)}, '')"
    ORACLE_SQL["read_response_" + _name(family)] = f"""WITH RECURSIVE {apart}, {_blk(family)}, n AS (SELECT id, count(*) AS n_calls FROM call GROUP BY 1)
      SELECT id, md5(CASE WHEN thinks AND {ends} IS NULL THEN {raw_open} WHEN thinks THEN {kept} END) AS reasoning_md5,
        md5(CASE WHEN thinks AND {ends} IS NULL THEN '' ELSE {content} END) AS content_md5, NOT (thinks AND {ends} IS NULL) AS complete, coalesce(n_calls, 0)::INTEGER AS n_calls
      FROM body LEFT JOIN n USING (id)"""


for _family in _WRITE:
    _register_calls(_family)
    _register_response(_family)


_M = "<|start|>assistant<|channel|>{}<|message|>{}"
_CHANNEL_KINDS = [
    _M.format("analysis", "why @s@") + "<|end|>" + _M.format("commentary to=functions.@f@ <|constrain|>json", _J) + "<|call|>",
    _M.format("analysis", "cut @s@"),
    _M.format("commentary", "about @f@") + "<|end|>" + _M.format("final", "@s@") + "<|return|>after",
    _M.format("commentary to=functions.@f@", _J),
    _M.format("commentary to=functions.@f@", "{") + _M.format("final", "x"),
    "<|start|>assistant to=functions.<|channel|>commentary<|message|>{}<|call|><|start|>assistant",
]
_CHANNELS = f"""made AS (SELECT conv_id * 1000 + turn AS id, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
    whole AS (SELECT id, split_part(CASE id % {len(_CHANNEL_KINDS)} {' '.join(f'WHEN {k} THEN {_sql(t)}' for k, t in enumerate(_CHANNEL_KINDS))} END, '<|return|>', 1) AS text FROM made),
    tok AS (SELECT id, regexp_extract_all(text, '<\\|(?:start|message|end|call|channel|constrain)\\|>|{PIECE}') AS t FROM whole),
    pos AS (SELECT id, t, unnest(list_filter(generate_series(1, len(t)), lambda i: t[i] = '<|start|>')) AS s FROM tok),
    msg AS (SELECT *, s + nullif(list_position(t[s + 1 :], '<|message|>'), 0) AS m FROM pos),
    fin AS (SELECT *, m + list_filter(generate_series(1, len(t) - m), lambda i: t[m + i] IN ('<|end|>', '<|call|>', '<|start|>'))[1] AS e FROM msg WHERE m IS NOT NULL),
    block AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) AS k, s - 1 AS b, CASE WHEN e IS NULL THEN len(t) WHEN t[e] = '<|start|>' THEN e - 1 ELSE e END AS x, coalesce(t[e] <> '<|start|>', false) AS closed, e IS NULL AS last,
        array_to_string(t[s + 1 : m - 1], '') AS header, array_to_string(t[m + 1 : coalesce(e - 1, len(t))], '') AS body FROM fin),
    said AS (SELECT *, nullif(regexp_extract(header, 'to=([^\\s<]+)', 1), '') AS recipient, regexp_extract(header, '<\\|channel\\|>\\s*([a-z]+)', 1) AS channel FROM block)"""


def _channel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    text = F.lit("")
    for k, template in enumerate(_CHANNEL_KINDS):
        text = F.when(F.col("id") % len(_CHANNEL_KINDS) == k, _column(template)).otherwise(text)
    return turns.select("id", text.alias("text"))


@query(f"""WITH {_CHANNELS} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS call_idx, nullif(recipient[11 :], '') AS name, CASE WHEN json_valid(body) THEN body ELSE to_json(body)::VARCHAR END AS arguments,
    CASE WHEN NOT json_valid(body) THEN 'invalid_json' WHEN NOT closed THEN 'unclosed' WHEN recipient = 'functions.' THEN 'missing_name' ELSE 'ok' END AS status, b AS "start", x AS "end", md5(body) AS raw_md5 FROM said WHERE recipient LIKE 'functions.%'""")
def parse_calls_gpt_oss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parse_harmony(_channel_texts(spark, sf_dir)).select("id", "call_idx", "name", "arguments", "status", "start", "end", F.md5("raw").alias("raw_md5"))


@query(f"""WITH {_CHANNELS}, g AS (SELECT id, {_TRIM.format("string_agg(body, '' ORDER BY k) FILTER (WHERE recipient IS NULL AND channel = 'analysis')")} AS r, {_TRIM.format("string_agg(body, '' ORDER BY k) FILTER (WHERE recipient IS NULL AND channel IN ('final', 'commentary'))")} AS c,
      bool_or(recipient IS NULL AND channel = 'analysis' AND last) AS open FROM said GROUP BY 1)
    SELECT id, CASE WHEN open THEN coalesce(r, '') ELSE nullif(r, '') END AS reasoning, coalesce(c, '') AS content, NOT coalesce(open, false) AS complete FROM made LEFT JOIN g USING (id)""")
def read_response_gpt_oss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.harmony_response(_channel_texts(spark, sf_dir))


@query("""WITH t AS (SELECT DISTINCT event_type AS name FROM events) SELECT name, unnest(['text', 'list', 'either', 'number']) AS key, unnest(['string', 'string', 'maybe_string', 'other']) AS type FROM t""")
def tool_parameter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = '{"type": "object", "properties": {"text": {"type": "string"}, "list": {"type": ["string"]}, "either": {"anyOf": [{"type": "integer"}, {"type": "string"}]}, "number": {"type": "number"}}}'
    return r.tool_params(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit(schema).alias("parameters")).distinct())
