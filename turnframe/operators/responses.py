"""Completions read back: reasoning, content and tool calls, as each wire format writes them.

Every reader takes completions (id, pieces), of tokens, or (id, text), whose markers are then tokens of their own, and works
on columns alone, a row by itself; a null reads as an empty completion. Calls are (id, call_idx, name, arguments, status,
start, end, raw), every attempt kept: arguments is JSON text, [start, end) the call's tokens in the completion up to its
first stop, raw its text. The first status that applies is given.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.functions import after, coerced, held, is_json, json_member, json_object, quoted, rstrip, strip, strip_newlines
from turnframe.operators.tagged import SEP, Machine, completion_tokens, plain, scan, whole

_THINK = {"<think>": "think_start", "</think>": "think_end"}
_BLOCK = {"<tool_call>": "tool_start", "</tool_call>": "tool_end"}


def _initial(*openers: str) -> dict[tuple[str, str], str]:
    """Moves of formats with one region of reasoning, at the start; openers may begin calls at once."""
    terminals = {"think_end", "tool_end", "section_end", "argument", "tool_start"} - set(openers)
    return {
        ("start", "words"): "content", **{("start", t): "content+" for t in terminals},
        ("start", "think_start"): "reasoning", ("reasoning", "think_start"): "reasoning", ("reasoning", "think_end"): "content",
    }


def _blocks(atomic: Mapping[str, str], ends_reasoning: bool, spelled: Mapping[str, str] | None = None) -> Machine:
    """Calls in blocks of their own; what stands between and after them is dropped. A wrapper around them ends the content."""
    moves = _initial("tool_start") | {(s, "tool_start"): "tool" for s in ("start", "content", "after")} | {("tool", "tool_end"): "after", ("start", "wrapper"): "after", ("content", "wrapper"): "after"}
    if ends_reasoning:
        moves["reasoning", "tool_start"] = "tool"
    return Machine(atomic, moves, spelled or {}, openers=("tool_start",) if ends_reasoning else ())


def _sections(atomic: Mapping[str, str], ends_reasoning: bool, more: Mapping[tuple[str, str], str]) -> Machine:
    """Calls within one section, which ends the content; nothing after it is read. Reasoning markers are spelled."""
    moves = _initial("section_start") | {(s, "section_start"): "section" for s in ("start", "content")} | {("section", "tool_start"): "tool", ("section", "section_end"): "done", ("tool", "section_end"): "done", **more}
    if ends_reasoning:
        moves["reasoning", "section_start"] = "section"
    return Machine(atomic, moves, _THINK, regions=("tool", "args"), openers=("section_start",) if ends_reasoning else ())


_FREE = {("content", "think_start"): "reasoning", ("reasoning", "think_start"): "reasoning", ("reasoning", "think_end"): "content", ("content", "think_end"): "content"}


@dataclass(frozen=True)
class Grammar:
    """What ends a completion, what header may lead it, how it falls into regions, and what is taken off the ends of reasoning and content.

    keeps_empty: whether empty reasoning is "" and not null. free: whether reasoning may be opened again, and stays with its
    calls when it is open.
    """

    stops: tuple[str, ...]
    prefix: str
    machine: Machine
    clean: Callable[[Column], Column] = strip
    keeps_empty: bool = False
    free: bool = False
    drops_prefix: bool = False
    more: tuple[str, ...] = field(default=())

    @property
    def specials(self) -> tuple[str, ...]:
        """Texts that are one token each where a completion is given as text."""
        return (*self.stops, *self.machine.atomic, *self.more)


_HY3 = {f"<{x}:opensource>": t for x, t in (("think", "think_start"), ("/think", "think_end"), ("tool_calls", "wrapper"), ("tool_call", "tool_start"), ("/tool_call", "tool_end"))}
_ARGUMENTS = ("<arg_key>", "</arg_key>", "<arg_value>", "</arg_value>")
_GLM_MOVES = _FREE | {("content", "tool_start"): "tool", ("reasoning", "tool_start"): "tool", ("tool", "tool_end"): "content"}
_DSML_MOVES = _FREE | {(s, "section_start"): "preamble" for s in ("content", "reasoning", "between")} | {(s, "tool_start"): "tool" for s in ("content", "preamble", "between")} | {("tool", "tool_end"): "between", ("tool", "section_end"): "between"}
_DSML = {"<｜DSML｜tool_calls>": "section_start", "<｜DSML｜toolcalls>": "section_start", "<｜DSML｜tool>": "section_start", "</｜DSML｜tool_calls>": "section_end", "<｜DSML｜invoke": "tool_start", "</｜DSML｜invoke>": "tool_end"}

# Fixed values of the wire formats.
GRAMMARS: dict[str, Grammar] = {
    "qwen3": Grammar(("<|im_end|>", "<|endoftext|>"), "<|im_start|>assistant\n", _blocks(_THINK | _BLOCK, True)),
    "qwen3.5": Grammar(("<|im_end|>", "<|endoftext|>"), "<|im_start|>assistant\n", _blocks(_THINK | _BLOCK, True), keeps_empty=True),
    "glm": Grammar(("<|endoftext|>", "<|user|>", "<|observation|>"), "", Machine(_THINK | _BLOCK, _GLM_MOVES), clean=rstrip, free=True, more=_ARGUMENTS),
    "minimax-m2": Grammar(("[e~[",), "]~b]ai\n", _blocks(_THINK | {"<minimax:tool_call>": "tool_start", "</minimax:tool_call>": "tool_end"}, True)),
    "deepseek-v3": Grammar(("<｜end▁of▁sentence｜>",), "<｜Assistant｜>", _sections({"<｜tool▁calls▁begin｜>": "section_start", "<｜tool▁calls▁end｜>": "section_end", "<｜tool▁call▁begin｜>": "tool_start", "<｜tool▁call▁end｜>": "tool_end"}, False, {("tool", "tool_end"): "section"}), more=("<｜tool▁sep｜>",)),
    "deepseek-v4": Grammar(("<｜end▁of▁sentence｜>",), "", Machine(_THINK, _DSML_MOVES, _DSML), clean=rstrip, free=True, more=("｜DSML｜",)),
    "kimi-k2": Grammar(("<|im_end|>",), "<|im_assistant|>assistant<|im_middle|>", _sections({"<|tool_calls_section_begin|>": "section_start", "<|tool_calls_section_end|>": "section_end", "<|tool_call_begin|>": "tool_start", "<|tool_call_argument_begin|>": "argument", "<|tool_call_end|>": "tool_end"}, True, {("tool", "argument"): "args", ("args", "tool_end"): "section", ("args", "section_end"): "done"})),
    "hy3": Grammar(("<｜hy_eos:opensource｜>",), "<｜hy_Assistant:opensource｜>", _blocks(_HY3, False), drops_prefix=True, more=tuple(f"<{x}:opensource>" for x in ("tool_sep", "arg_key", "/arg_key", "arg_value", "/arg_value"))),
    "laguna": Grammar(("</assistant>",), "<assistant>", _blocks(_THINK | _BLOCK, False), clean=strip_newlines),
}

_HARMONY = {"<|start|>": "start", "<|message|>": "message", "<|end|>": "end", "<|call|>": "call"}
_CHANNELS = Machine(_HARMONY, {("out", "start"): "header", ("header", "message"): "body", ("body", "start"): "header!", ("body", "end"): "out", ("body", "call"): "out"}, regions=("header", "body"), closers=("end", "call"))


def before_stop(pieces: Column, stops: tuple[str, ...]) -> Column:
    """Tokens up to the first of the stops."""
    first = F.array_min(F.filter(F.array(*[F.array_position(pieces, s) for s in stops]), lambda p: p > 0))
    return F.when(first.isNotNull(), F.slice(pieces, F.lit(1), (first - 1).cast("int"))).otherwise(pieces)


def _tokens(completions: DataFrame, specials: tuple[str, ...]) -> Column:
    if "pieces" in completions.columns:
        return F.coalesce("pieces", F.array().cast("array<string>"))
    return completion_tokens(F.coalesce("text", F.lit("")), specials)


def read_response(completions: DataFrame, grammar: Grammar, prefilled: bool | Column = False) -> DataFrame:
    """(id, reasoning, content, complete, regions): reasoning is null where there is no such region, and where it is empty but for formats that keep it.

    Unless the grammar is free, only the initial region is reasoning: opened by the prompt (prefilled), or by a marker that
    at most white space precedes. Its first end closes it for good; later markers are content. Where no end follows, the
    first call ends it, in formats where it may; else it is not complete, stays as it is, and leaves no content or calls.
    regions are the attempted calls, their texts as joined pieces.
    """
    g, header = grammar, completion_tokens(F.lit(grammar.prefix), grammar.specials)
    specials = (*g.specials, *([g.prefix] if g.drops_prefix else []))
    # a completion is few bytes but much work: however few pieces its file has, all cores share it
    completions = completions.repartition(int(completions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    known = held(completions, tokens=_tokens(completions, specials), prefilled=prefilled if isinstance(prefilled, Column) else F.lit(prefilled))
    known = held(known, cut=before_stop(F.col("tokens"), g.stops)).select("id", "prefilled", F.col("cut").alias("pieces"))
    if g.drops_prefix:
        header = F.array(F.lit(g.prefix))
    led = (F.slice("pieces", F.lit(1), F.size(header)) == header) if g.prefix else F.lit(False)
    body = F.slice("pieces", F.size(header) + 1, F.size("pieces"))
    breaks = F.array_position(F.transform(body, lambda p: p.rlike(r"^\n+$")), False)
    skipped = F.when(led, F.size(header) + F.when(breaks == 0, F.size(body)).otherwise((breaks - 1).cast("int"))).otherwise(0)
    known = held(known, skipped=skipped)
    known = held(known, rest=F.slice("pieces", F.col("skipped") + 1, F.size("pieces")))
    read = scan(known, "rest", g.machine, F.when(F.col("prefilled"), "reasoning").otherwise("content" if g.free else "start"))
    r = F.col("read")
    open_ = r["state"] == "reasoning"
    reasoning, content = plain(r["reasoning"]), plain(r["content"])
    regions = F.transform(r["regions"], lambda x: F.struct(x["text"].alias("text"), (x["start"] + F.col("skipped")).alias("start"), (x["end"] + F.col("skipped")).alias("end"), x["closed"].alias("closed")))
    if g.free:
        cleaned = g.clean(reasoning)
        shown = F.when(open_, cleaned).otherwise(F.nullif(cleaned, F.lit("")))
        return read.select("id", shown.alias("reasoning"), _free_content(content, F.size(regions) > 0, bool(g.machine.spelled)).alias("content"), (~open_).alias("complete"), regions.alias("regions"))
    cleaned = g.clean(reasoning)
    shown = F.when(open_, reasoning).when(r["opened"], cleaned if g.keeps_empty else F.nullif(cleaned, F.lit("")))
    lead = F.lit("") if g.drops_prefix else F.when(r["opened"], "").otherwise(F.array_join(F.slice("pieces", F.lit(1), F.col("skipped")), ""))
    return read.select("id", shown.alias("reasoning"), F.when(open_, "").otherwise(g.clean(F.concat(lead, content))).alias("content"), (~open_).alias("complete"), F.when(~open_, regions).otherwise(F.slice(regions, 1, 0)).alias("regions"))


def _free_content(content: Column, called: Column, markup: bool) -> Column:
    """Content beside calls: without white space at its ends, or, where calls are markup, without the break before them."""
    if not markup:
        return F.when(called, strip(content)).otherwise(content)
    kept = F.when(strip(content) == "", "").otherwise(content)
    return F.when(called & kept.endswith("\n\n"), kept.substr(F.lit(1), F.length(kept) - 2)).otherwise(kept)


def tool_params(tools: DataFrame) -> DataFrame:
    """(name, key, type) from tools (name, parameters JSON schema text): type is string where only strings are allowed,
    maybe_string where one branch of a union is a string, else other. Tools without properties have no rows. Of a tool
    that is declared more than once the last declaration holds, by a column tool_idx, or else by its text."""
    order = "tool_idx" if "tool_idx" in tools.columns else "parameters"
    last = tools.groupBy("name").agg(F.max_by("parameters", order).alias("parameters"))
    listed = last.select("name", F.explode(F.from_json(F.get_json_object("parameters", "$.properties"), "map<string,string>")).alias("key", "schema"))
    declared = F.get_json_object("schema", "$.type")
    branches = F.coalesce(F.nullif(F.get_json_object("schema", "$.anyOf"), F.lit("[]")), F.get_json_object("schema", "$.oneOf"))
    maybe = F.exists(F.from_json(branches, "array<struct<type:string>>"), lambda b: F.coalesce(b["type"] == "string", F.lit(False)))
    return listed.select("name", "key", F.when(declared.isin("string", '["string"]'), "string").when(maybe, "maybe_string").otherwise("other").alias("type"))


def _attempts(parsed: DataFrame, start: str, end: str) -> DataFrame:
    """(id, call_idx, start, end, closed, inner): a row an attempted call; inner is what stands between its markers, as joined pieces."""
    rows = parsed.select("id", F.posexplode("regions").alias("call_idx", "x")).select("id", "call_idx", "x.start", "x.end", "x.closed", "x.text")
    body = F.col("text").substr(F.lit(len(start) + 1), F.length("text"))
    inner = F.when(F.col("closed"), body.substr(F.lit(1), F.length(body) - len(end))).otherwise(body)
    return rows.withColumn("inner", inner).drop("text")


def _typed(rows: DataFrame, params: DataFrame | None) -> DataFrame:
    """rows with types, the declared types of their tool's parameters; of a parameter given twice, the greatest. The map is one a tool, which a broadcast may carry."""
    if params is None:
        return rows.withColumn("types", F.lit(None).cast("map<string,string>"))
    types = params.groupBy("name", "key").agg(F.max("type").alias("type")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("key", "type"))).alias("types"))
    return rows.join(types, "name", "left")


_CALL = ("id", "call_idx", "name", "arguments", "status", "start", "end", "raw")


def _raw(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", plain(F.col("inner")))


def _keyed_calls(rows: DataFrame, params: DataFrame | None, broken: Column | None = None, extra: Column | None = None, unknown: Column | None = None) -> DataFrame:
    """Calls from rows (id, call_idx, name, keys, values, closed, start, end, raw). The first status that applies: unclosed,
    malformed where extra holds, missing_name, unknown_tool, malformed where broken holds, invalid_json, ok."""
    no = F.lit(False)
    flags = rows.withColumns({"broken": broken if broken is not None else no, "extra": extra if extra is not None else no, "unknown": unknown if unknown is not None else no})
    read = _typed(flags, params)
    value, fell = coerced("keys", "values", F.col("types"))
    status = (
        F.when(~F.col("closed"), "unclosed").when(F.col("extra"), "malformed").when(F.col("name").isNull(), "missing_name")
        .when(F.col("unknown"), "unknown_tool").when(F.col("broken"), "malformed").when(fell, "invalid_json").otherwise("ok")
    )
    shown = F.col("closed") & ~F.col("extra")
    return read.select("id", "call_idx", F.when(shown, F.col("name")).alias("name"), F.when(shown, json_object("keys", value)).alias("arguments"), status.alias("status"), "start", "end", "raw")


def _filled(name: Column) -> Column:
    return F.nullif(name, F.lit(""))


def _pairs(rows: DataFrame, pattern: str, inner: str = "inner") -> DataFrame:
    get = lambda n: F.transform(F.regexp_extract_all(inner, F.lit(pattern), F.lit(n)), lambda x: strip(plain(x)))
    return rows.withColumns({"keys": get(1), "values": get(2)})


def parse_hermes(completions: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Calls of completions in blocks of one JSON object with a name and arguments: unclosed, invalid_json, missing_name, unknown_tool (where tools (name) are given), ok.

    Arguments that are absent are {}; what is JSON but no object has neither name nor arguments.
    """
    parsed = completions if "regions" in completions.columns else read_response(completions, GRAMMARS["qwen3"])
    rows = held(_attempts(parsed, "<tool_call>", "</tool_call>"), raw=strip(plain(F.col("inner"))))
    rows = held(rows, valid=is_json(F.col("raw")))
    # what is not closed and JSON is shown neither name nor arguments, so it is not read for them
    shown = F.col("closed") & F.col("valid")
    rows = held(rows, name=_filled(F.when(F.col("valid") & F.col("raw").startswith("{"), F.get_json_object("raw", "$.name"))), arguments=F.when(shown, F.coalesce(json_member(F.col("raw"), "arguments"), F.lit("{}"))))
    if tools is not None:
        rows = rows.join(tools.select("name", F.lit(True).alias("known")).distinct(), "name", "left")
    unknown = ~F.coalesce("known", F.lit(False)) if tools is not None else F.lit(False)
    status = F.when(~F.col("closed"), "unclosed").when(~F.col("valid"), "invalid_json").when(F.col("name").isNull(), "missing_name").when(unknown, "unknown_tool").otherwise("ok")
    return rows.withColumn("status", status).withColumn("name", F.when(shown, F.col("name"))).select(*_CALL)


def parse_llama(completions: DataFrame) -> DataFrame:
    """(id, content, name, arguments, start, end) of completions: after the last role header, a text that is one JSON object
    with a name is a call, whose arguments are its parameters, else its arguments, else {}; any other text is content."""
    stops = ("<|eot_id|>", "<|end_of_text|>", "<|eom_id|>")
    header = "<|end_header_id|>"
    rows = completions.select("id", before_stop(_tokens(completions, (*stops, header, "<|start_header_id|>")), stops).alias("pieces"))
    rows = rows.withColumn("start", F.greatest(F.lit(0), F.size("pieces") + 1 - F.array_position(F.reverse("pieces"), header).cast("int")))
    rows = rows.withColumn("start", F.when(F.array_contains("pieces", header), F.col("start")).otherwise(0))
    rows = rows.withColumn("body", strip(F.array_join(F.slice("pieces", F.col("start") + 1, F.size("pieces")), "")))
    shaped = F.col("body").startswith("{") & F.col("body").endswith("}")
    rows = rows.withColumn("name", F.when(shaped & is_json(F.col("body")), _filled(F.get_json_object("body", "$.name"))))
    called = F.col("name").isNotNull()
    arguments = F.coalesce(json_member(F.col("body"), "parameters"), json_member(F.col("body"), "arguments"), F.lit("{}"))
    span = lambda c: F.when(called, c)
    return rows.select("id", F.when(called, "").otherwise(F.col("body")).alias("content"), "name", span(arguments).alias("arguments"), span(F.col("start")).alias("start"), span(F.size("pieces")).alias("end"))


def _keyed_block(rows: DataFrame, suffix: str, given: str) -> DataFrame:
    """keys, values and broken of blocks whose keys and values stand in tokens of their own; a key or value without its end is broken."""
    key, key_end, value, value_end = (whole(f"<{x}{suffix}>") for x in ("arg_key", "/arg_key", "arg_value", "/arg_value"))
    pair = f"(?s){key}(.*?){key_end}.*?{value}(.*?){value_end}"
    left = F.regexp_replace(given, pair, SEP)
    return _pairs(rows, pair, given).withColumn("broken", left.rlike(key))


def _before(text: Column, marker: str) -> Column:
    return F.get(F.split(text, whole(marker), 2), F.lit(0))


def parse_glm(completions: DataFrame, tools: DataFrame | None = None, params: DataFrame | None = None) -> DataFrame:
    """Calls of completions in blocks of a name, then keys and values.

    params (name, key, type): values of type string stay as they are, others are JSON, or strings where they are none.
    unknown_tool where tools (name) are given without it.
    """
    parsed = completions if "regions" in completions.columns else read_response(completions, GRAMMARS["glm"])
    rows = _raw(_attempts(parsed, "<tool_call>", "</tool_call>")).withColumn("name", _filled(strip(plain(_before(F.col("inner"), "<arg_key>")))))
    if tools is not None:
        rows = rows.join(tools.select("name", F.lit(True).alias("known")).distinct(), "name", "left")
    unknown = ~F.coalesce("known", F.lit(False)) if tools is not None else None
    return _keyed_calls(_keyed_block(rows, "", "inner"), params, broken=F.col("broken"), unknown=unknown)


def parse_xml(parsed: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Calls of blocks that name a function and its parameters in tags: <function=f><parameter=k>v</parameter>."""
    rows = _raw(_attempts(parsed, "<tool_call>", "</tool_call>"))
    named = F.filter(F.split("raw", "<function="), lambda x, i: (i > 0) & (F.instr(x, ">") > 1))
    rows = rows.withColumn("name", F.substring_index(F.get(named, F.lit(0)), ">", 1))
    shut = F.split("raw", "</parameter>")
    given = F.transform(F.slice(shut, F.lit(1), F.size(shut) - 1), lambda x: after(x, "<parameter="))
    given = F.filter(given, lambda x: F.instr(x, ">") > 1)
    rows = rows.withColumns({"keys": F.transform(given, lambda x: F.substring_index(x, ">", 1)), "values": F.transform(given, lambda x: strip(after(x, ">")))})
    return _keyed_calls(rows, params, extra=F.col("name").isNull())


def parse_minimax(parsed: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Calls of blocks of invoke tags; a block may hold many, which share its span, and one without any is malformed."""
    blocks = _raw(_attempts(parsed, "<minimax:tool_call>", "</minimax:tool_call>"))
    shut = F.split("raw", "</invoke>")
    invokes = F.filter(F.transform(F.slice(shut, F.lit(1), F.size(shut) - 1), lambda x: after(x, '<invoke name="')), lambda x: F.instr(x, '">') > 1)
    one = F.when(F.col("closed") & (F.size(invokes) > 0), invokes).otherwise(F.array(F.lit(None).cast("string")))
    rows = blocks.select("id", F.col("call_idx").alias("block"), "closed", "start", "end", "raw", F.posexplode(one).alias("invoke", "inner"))
    rows = rows.withColumns({"name": F.substring_index("inner", '">', 1), "body": after(F.col("inner"), '">')})
    ends = F.split("body", "</parameter>")
    given = F.filter(F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda x: after(x, '<parameter name="')), lambda x: F.instr(x, '">') > 1)
    rows = rows.withColumns({"keys": F.coalesce(F.transform(given, lambda x: F.substring_index(x, '">', 1)), F.array().cast("array<string>")), "values": F.coalesce(F.transform(given, lambda x: strip(after(x, '">'))), F.array().cast("array<string>"))})
    return _numbered(_keyed_calls(rows.withColumn("call_idx", F.struct("block", "invoke")), params, extra=F.col("name").isNull()))


def _numbered(calls: DataFrame) -> DataFrame:
    """call_idx, which orders a completion's calls, as a number from 0."""
    return calls.withColumn("call_idx", F.row_number().over(Window.partitionBy("id").orderBy("call_idx")) - 1)


def parse_deepseek(parsed: DataFrame) -> DataFrame:
    """Calls in a section of calls: a type, a separator, the name's line, and arguments as fenced JSON: malformed (no separator), unclosed, missing_name, invalid_json, ok.

    Arguments that are no JSON are quoted.
    """
    rows = _raw(_attempts(parsed, "<｜tool▁call▁begin｜>", "<｜tool▁call▁end｜>"))
    halves = F.split("inner", whole("<｜tool▁sep｜>"), 2)
    rows = rows.withColumns({"split": F.size(halves) > 1, "said": strip(plain(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))))})
    rest = strip(after(F.col("said"), "\n"))
    shut = rest.startswith("```") & rest.endswith("```") & (F.length(rest) >= 6)
    opened = F.regexp_replace(rest.substr(F.lit(4), F.length(rest) - 6), "^json", "")
    given = F.when(F.instr("said", "\n") == 0, "").when(shut, strip(opened)).otherwise(rest)
    rows = rows.withColumns({"name": _filled(strip(F.substring_index("said", "\n", 1))), "given": given})
    valid = (F.col("given") == "") | is_json(F.col("given"))
    status = F.when(~F.col("split"), "malformed").when(~F.col("closed"), "unclosed").when(F.col("name").isNull(), "missing_name").when(~valid, "invalid_json").otherwise("ok")
    return _json_calls(rows, F.col("split"), status)


def _json_calls(rows: DataFrame, shown: Column, status: Column) -> DataFrame:
    arguments = F.when(F.col("given") == "", "{}").when(is_json(F.col("given")), F.col("given")).otherwise(quoted(F.col("given")))
    return rows.select("id", "call_idx", F.when(shown, F.col("name")).alias("name"), F.when(shown, arguments).alias("arguments"), status.alias("status"), "start", "end", "raw", *[c for c in ("tool_call_id",) if c in rows.columns])


def parse_kimi(parsed: DataFrame) -> DataFrame:
    """Calls whose ids name the function: functions.name:index, then arguments as JSON: malformed, unclosed, missing_name, invalid_json, ok. The id comes along as tool_call_id.

    A call that no arguments follow is malformed and ends the list; empty arguments are not JSON.
    """
    rows = _raw(_attempts(parsed, "<|tool_call_begin|>", "<|tool_call_end|>"))
    halves = F.split("inner", whole("<|tool_call_argument_begin|>"), 2)
    rows = rows.withColumns({"split": F.size(halves) > 1, "said": strip(plain(F.get(halves, F.lit(0)))), "given": strip(plain(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))))})
    rows = rows.withColumn("tool_call_id", F.when(F.col("split"), _filled(F.col("said"))))
    part = F.substring_index("said", ":", 1)
    rows = rows.withColumn("name", _filled(F.when(F.instr(part, ".") > 0, after(part, ".")).otherwise(part)))
    status = F.when(~F.col("split"), "malformed").when(~F.col("closed"), "unclosed").when(F.col("name").isNull(), "missing_name").when(~is_json(F.col("given")), "invalid_json").otherwise("ok")
    judged = rows.withColumn("status", status).withColumn("given", F.when(F.col("given") == "", '""').otherwise(F.col("given")))
    return _json_calls(judged, F.col("split"), F.col("status"))


def parse_hy3(parsed: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Calls of blocks of a name, a separator, and keys and values; a key or value without its end is malformed."""
    rows = _raw(_attempts(parsed, "<tool_call:opensource>", "</tool_call:opensource>"))
    halves = F.split("inner", whole("<tool_sep:opensource>"), 2)
    split = F.size(halves) > 1
    name = F.when(split, F.get(halves, F.lit(0))).otherwise(_before(F.col("inner"), "<arg_key:opensource>"))
    rows = rows.withColumns({"name": _filled(strip(plain(name))), "given": F.when(split, F.get(halves, F.lit(1))).otherwise(F.col("inner"))})
    return _keyed_calls(_keyed_block(rows, ":opensource", "given"), params, broken=F.col("broken"))


def parse_laguna(parsed: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Calls of blocks of a name, then keys and values with at most white space between them; other text is skipped. Only the block's own markers are tokens."""
    rows = _raw(_attempts(parsed, "<tool_call>", "</tool_call>")).withColumn("name", _filled(strip(F.substring_index("raw", "<arg_key>", 1))))
    pair = r"(?s)<arg_key>(.*?)</arg_key>\s*<arg_value>(.*?)</arg_value>"  # fixed by the format
    return _keyed_calls(_pairs(rows, pair, "raw"), params)


def parse_deepseek_v4(parsed: DataFrame) -> DataFrame:
    """Calls of markup whose parameters say whether they are strings: unclosed, missing_name, malformed, invalid_json, ok.

    The parameters must tile the call's body: what is left beside line breaks is debris, and a key that recurs is malformed
    as well; the first of its values stays.
    """
    head, tail, mark = '<｜DSML｜invoke name="', "</｜DSML｜invoke>", '<｜DSML｜parameter name="'
    rows = parsed.select("id", F.posexplode("regions").alias("call_idx", "x")).select("id", "call_idx", "x.start", "x.end", "x.closed", plain(F.col("x.text")).alias("raw"))
    header = F.substring_index("raw", ">\n", 1)
    has = F.instr("raw", ">\n") > 0
    named = has & header.startswith(head) & header.endswith('"') & (F.length(header) > len(head))
    body = after(F.col("raw"), ">\n")
    body = F.when(F.col("closed"), body.substr(F.lit(1), F.length(body) - len(tail))).otherwise(body)
    rows = rows.withColumns({"name": F.when(named, header.substr(F.lit(len(head) + 1), F.length(header) - len(head) - 1)), "body": F.when(has, body).otherwise(""), "named": named})
    pattern = F.lit(r'(?s)\Q' + mark + r'\E(.*?)" string="(true|false)">(.*?)</｜DSML｜parameter>')  # fixed by the format
    get = lambda n: F.regexp_extract_all("body", pattern, F.lit(n))
    rows = rows.withColumns({"keys": get(1), "kinds": get(2), "values": get(3), "left": F.regexp_replace("body", pattern, F.lit(""))})
    debris = strip_newlines(F.col("left")) != ""
    again = F.size(F.array_distinct("keys")) < F.size("keys")
    listed = F.arrays_zip(F.col("keys").alias("k"), F.col("kinds").alias("t"), F.col("values").alias("v"))
    firsts = F.filter(listed, lambda x, i: ~F.array_contains(F.slice("keys", F.lit(1), i), x["k"]))
    fell = F.exists(firsts, lambda x: (x["t"] == "false") & ~is_json(x["v"]))
    shown = F.transform(firsts, lambda x: F.concat(quoted(x["k"]), F.lit(":"), F.when((x["t"] == "true") | ~is_json(x["v"]), quoted(x["v"])).otherwise(x["v"])))
    status = F.when(~F.col("closed"), "unclosed").when(_filled(F.col("name")).isNull(), "missing_name").when(~F.col("named") | debris | again, "malformed").when(fell, "invalid_json").otherwise("ok")
    return rows.select("id", "call_idx", "name", F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")).alias("arguments"), status.alias("status"), "start", "end", "raw")


def harmony_blocks(completions: DataFrame) -> DataFrame:
    """(id, block, header, body, closed, last, start, end): messages of a channel format, up to the first return. A message
    ends at its end or call marker, at the next message's start, or with the completion."""
    rows = completions.select("id", before_stop(_tokens(completions, (*_HARMONY, "<|return|>", "<|channel|>", "<|constrain|>")), ("<|return|>",)).alias("pieces"))
    rows = scan(rows, "pieces", _CHANNELS, F.lit("out")).select("id", F.size("pieces").alias("n"), "read.regions")
    found = F.filter("regions", lambda x: x["text"].rlike(whole("<|message|>")))
    rows = rows.select("id", "n", F.posexplode(found).alias("block", "x")).select("id", "n", "block", "x.start", "x.end", "x.closed", "x.text")
    halves = F.split("text", whole("<|message|>"), 2)
    body = F.get(halves, F.lit(1))
    for m in ("<|end|>", "<|call|>"):
        body = _before(body, m)
    return rows.select(
        "id", "block", after(plain(F.get(halves, F.lit(0))), "<|start|>").alias("header"), plain(body).alias("body"),
        "closed", (F.col("end") == F.col("n")).alias("last"), "start", "end",
    )


def _recipient() -> Column:
    """What follows the header's to=, up to white space or the next marker; null where that is nothing."""
    return _filled(F.regexp_extract(F.get(F.filter(F.split("header", "to="), lambda x, i: (i > 0) & ~x.rlike(r"^(\s|<|$)")), F.lit(0)), r"^[^\s<]+", 0))


def parse_harmony(completions: DataFrame) -> DataFrame:
    """Calls of a channel format: messages whose recipient is a function; invalid_json comes before unclosed and missing_name."""
    rows = harmony_blocks(completions).withColumn("to", _recipient()).where(F.col("to").startswith("functions."))
    status = F.when(~is_json(F.col("body")), "invalid_json").when(~F.col("closed"), "unclosed").when(F.col("to") == "functions.", "missing_name").otherwise("ok")
    named = rows.select("id", F.col("block").alias("call_idx"), _filled(after(F.col("to"), "functions.")).alias("name"), F.when(F.col("body") == "", '""').otherwise(F.col("body")).alias("given"), status.alias("status"), "start", "end", F.col("body").alias("raw"))
    return _numbered(_json_calls(named, F.lit(True), F.col("status")))


def harmony_response(completions: DataFrame) -> DataFrame:
    """(id, reasoning, content, complete): analysis is reasoning; final messages, and comments to nobody, are content."""
    channel = F.regexp_extract(strip(after(F.col("header"), "<|channel|>")), r"^[^\s<]+", 0)
    rows = harmony_blocks(completions).withColumns({"to": _recipient(), "channel": channel})
    call = F.coalesce(F.col("to").startswith("functions."), F.lit(False))
    thought, said = ~call & (F.col("channel") == "analysis"), ~call & F.col("channel").isin("final", "commentary")
    joined = lambda c: strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("block", "body")))), lambda x: x["body"]), ""))
    open_ = F.bool_or(thought & F.col("last") & ~F.col("closed"))
    read = rows.groupBy("id").agg(joined(thought).alias("r"), joined(said).alias("c"), open_.alias("open"))
    all_ = completions.select("id").join(read, "id", "left")
    complete = ~F.coalesce("open", F.lit(False))
    return all_.select("id", F.when(complete, _filled(F.col("r"))).otherwise(F.col("r")).alias("reasoning"), F.coalesce("c", F.lit("")).alias("content"), complete.alias("complete"))
