"""Wire formats: from a message to segments.

A segment is a special token (kind S) or a group of text that is tokenized in one pass (kind T). Of a group, characters
content_from to content_to are the message's body. owner is the message it belongs to, -1 for scaffolding of the prompt;
sampled says whether the model would have produced it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.functions import argument_texts, lstrip_newlines, quoted, strip, strip_newlines, think_split

#: Tool calls of an assistant; arguments is JSON text.
CALLS = "array<struct<id:string,name:string,arguments:string>>"
SEGMENTS = "array<struct<kind:string,text:string,owner:int,sampled:boolean,content_from:int,content_to:int>>"


def special(token: str, owner: Column, sampled: bool | Column = False) -> Column:
    s = sampled if isinstance(sampled, Column) else F.lit(sampled)
    return F.struct(F.lit("S").alias("kind"), F.lit(token).alias("text"), owner.cast("int").alias("owner"), s.alias("sampled"), F.lit(0).alias("content_from"), F.when(s, len(token)).otherwise(0).cast("int").alias("content_to"))


def text(owner: Column, *parts: tuple[str | Column, bool], sampled: bool = False) -> Column:
    """One group. Of its parts, at most one is body."""
    whole, start, size = F.lit(""), F.lit(0), F.lit(0)
    for part, body in parts:
        p = part if isinstance(part, Column) else F.lit(part)
        if body:
            start, size = F.length(whole), F.length(p)
        whole = F.concat(whole, p)
    return F.struct(F.lit("T").alias("kind"), whole.alias("text"), owner.cast("int").alias("owner"), F.lit(sampled).alias("sampled"), start.cast("int").alias("content_from"), (start + size).cast("int").alias("content_to"))


def _none() -> Column:
    return F.array().cast(SEGMENTS)


def is_user_query(content: Column | None = None) -> Column:
    """Whether a message is a user's own: one that only wraps a tool's response is not."""
    bare = strip(F.coalesce("content", F.lit("")) if content is None else content)
    return (F.col("role") == "user") & ~(bare.startswith("<tool_response>") & bare.endswith("</tool_response>"))


def facts(messages: DataFrame, null_text: str = "") -> DataFrame:
    """messages with what a format asks of the whole conversation; one exchange by conv_id serves all of it.

    msg_idx orders the messages of a conversation; it may start anywhere and have gaps. Null content reads as null_text.
    Columns that messages need not have: calls (CALLS, an assistant's), name and tool_call_id (a tool result's).
    """
    for column, kind in (("calls", CALLS), ("name", "string"), ("tool_call_id", "string")):
        if column not in messages.columns:
            messages = messages.withColumn(column, F.lit(None).cast(kind))
    w = Window.partitionBy("conv_id").orderBy("msg_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    content = F.coalesce("content", F.lit(null_text))
    reasoning, body = think_split(content)
    assistant = F.col("role") == "assistant"
    return messages.withColumns({
        "calls": F.when(assistant, F.coalesce("calls", F.array().cast(CALLS))).otherwise(F.array().cast(CALLS)), "given": F.col("content").isNotNull(),
        "content": content, "reasoning": F.when(assistant, reasoning).otherwise(""), "body": F.when(assistant, body).otherwise(content),
        "n": F.count("*").over(whole).cast("int"), "first_role": F.first("role").over(whole), "prev_role": F.lag("role").over(w), "next_role": F.lead("role").over(w),
        "first_idx": F.min("msg_idx").over(whole), "last_idx": F.max("msg_idx").over(whole), "prev_idx": F.lag("msg_idx").over(w),
        "last_user": F.coalesce(F.max(F.when(F.col("role") == "user", F.col("msg_idx"))).over(whole), F.min("msg_idx").over(whole) - 1),
        "last_query": F.max(F.when(is_user_query(content), F.col("msg_idx"))).over(whole),
        "leading": F.min(F.when(F.col("role") == "system", 1).otherwise(0)).over(w),
    })


@dataclass(frozen=True)
class Family:
    """name; begin, body and generation prompt as functions of the columns of facts(); stop tokens; what a bridge may keep;
    what null content reads as; the roles that are rendered here, others raise."""

    name: str
    begin: Callable[[], Column]
    message: Callable[[], Column]
    prompt: Callable[[], Column]
    stops: tuple[str, ...]
    retention: str
    null_text: str = ""
    roles: tuple[str, ...] = ("system", "user", "assistant")
    late_system: bool = True


WITH_TOOLS = ("system", "user", "assistant", "tool")


def _me() -> Column:
    return F.col("msg_idx")


def _first() -> Column:
    return F.col("msg_idx") == F.col("first_idx")


def _opens() -> Column:
    """Whether a tool result is the first of its block; a block is tool results in a row."""
    return F.coalesce(F.col("prev_role") != "tool", F.lit(True))


def _ends() -> Column:
    """Whether a tool result is the last of its block."""
    return F.coalesce(F.col("next_role") != "tool", F.lit(True))


def _tool_block(begin: list[Column], body: Column, end: list[Column]) -> Column:
    return F.concat(F.when(_opens(), F.array(*begin)).otherwise(_none()), F.array(body), F.when(_ends(), F.array(*end)).otherwise(_none()) if end else _none())


def _called() -> Column:
    """Whether an assistant calls tools."""
    return F.size("calls") > 0


def _each_call(parts: Callable[[Column, Column], Column]) -> Column:
    """The segments of all calls; parts takes a call and its place, and gives an array of segments."""
    return F.flatten(F.transform("calls", parts)).cast(SEGMENTS)


def _said(*parts: str | Column) -> Column:
    """Sampled text of the message."""
    return text(_me(), (F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), True), sampled=True)


def _mark(token: str) -> Column:
    return special(token, _me(), True)


def _later(i: Column, separator: str) -> Column:
    return F.when(i > 0, separator).otherwise("")


def _outside() -> Column:
    return F.lit(-1)


def _chatml(assistant: Callable[[], Column], clean: Callable[[Column], Column]) -> Callable[[], Column]:
    def message() -> Column:
        other = F.array(special("<|im_start|>", _me()), text(_me(), (F.col("role"), False), ("\n", False), (clean(F.col("content")), True)), special("<|im_end|>", _me()), text(_me(), ("\n", False)))
        result = text(_me(), ("\n<tool_response>\n", False), (clean(F.col("content")), True), ("\n</tool_response>", False))
        tool = _tool_block([special("<|im_start|>", _me()), text(_me(), ("user", False))], result, [special("<|im_end|>", _me()), text(_me(), ("\n", False))])
        return F.when(F.col("role") == "assistant", assistant()).when(F.col("role") == "tool", tool).otherwise(other)

    return message


def _qwen3_assistant() -> Column:
    last = F.col("msg_idx") == F.col("last_idx")
    query = F.coalesce("last_query", "last_idx")
    shown = (F.col("msg_idx") > query) & (last | (F.col("reasoning") != ""))
    body = F.when(shown, F.concat(F.lit("<think>\n"), strip_newlines(F.col("reasoning")), F.lit("\n</think>\n\n"), lstrip_newlines(F.col("body")))).otherwise(F.col("body"))
    body = F.concat(body, F.when(_called() & (F.col("body") != ""), "\n").otherwise(""))
    calls = _each_call(lambda c, i: F.array(_said(_later(i, "\n")), _mark("<tool_call>"), _said('\n{"name": "', c["name"], '", "arguments": ', c["arguments"], "}\n"), _mark("</tool_call>")))
    return F.concat(F.array(special("<|im_start|>", _me()), text(_me(), ("assistant\n", False)), _said(body)), calls, F.array(_mark("<|im_end|>"), text(_me(), ("\n", False))))


def _qwen36_assistant() -> Column:
    return _qwen35_assistant(python_words=False)


def _qwen35_assistant(python_words: bool = True) -> Column:
    query = F.coalesce("last_query", "last_idx")
    body = strip(F.col("body"))
    think = F.array(special("<think>", _me(), True), text(_me(), (F.concat(F.lit("\n"), strip(F.col("reasoning")), F.lit("\n")), True), sampled=True), special("</think>", _me(), True), text(_me(), (F.concat(F.lit("\n\n"), body), True), sampled=True))
    inner = F.when(F.col("msg_idx") > query, think).otherwise(F.array(text(_me(), (body, True), sampled=True)))

    def call(c: Column, i: Column) -> Column:
        given = F.transform(argument_texts(c["arguments"], python_words), lambda a: F.concat(F.lit("<parameter="), a["k"], F.lit(">\n"), a["v"], F.lit("\n</parameter>\n")))
        lead = F.when(i > 0, "\n").when(body != "", "\n\n").otherwise("")
        return F.array(_said(lead), _mark("<tool_call>"), _said("\n<function=", c["name"], ">\n", F.array_join(given, ""), "</function>\n"), _mark("</tool_call>"))

    inner = F.concat(inner, _each_call(call))
    return F.concat(F.array(special("<|im_start|>", _me()), text(_me(), ("assistant\n", False))), inner, F.array(special("<|im_end|>", _me(), True), text(_me(), ("\n", False))))


def _glm(newline: str, empty_think: bool = False) -> Callable[[], Column]:
    """A role marker after an assistant ends that assistant's turn: the model samples it. With empty_think an assistant
    after the last user that did not reason has an empty block."""

    def message() -> Column:
        me, role = _me(), F.col("role")
        closes = F.coalesce(F.col("prev_role") == "assistant", F.lit(False))
        body = strip(F.col("body"))
        system = F.array(special("<|system|>", me), text(me, (newline, False), (F.col("content"), True)))
        user = F.array(special("<|user|>", F.when(closes, F.col("prev_idx")).otherwise(me), closes), text(me, (newline, False), (F.col("content"), True)))
        shown = (F.col("msg_idx") > F.col("last_user")) & (F.col("reasoning") != "")
        after_body = F.when(_called(), newline).otherwise("")
        tail = F.when(body != "", F.array(_said(newline, body, after_body))).otherwise(_none())

        def call(c: Column, i: Column) -> Column:
            pair = lambda a: F.array(_mark("<arg_key>"), _said(a["k"]), _mark("</arg_key>"), _said(newline), _mark("<arg_value>"), _said(a["v"]), _mark("</arg_value>"), _said(newline))
            lead = F.when((i > 0) | (body == ""), newline).otherwise("")
            return F.concat(F.array(_said(lead), _mark("<tool_call>"), _said(c["name"], newline)), F.flatten(F.transform(argument_texts(c["arguments"]), pair)), F.array(_mark("</tool_call>")))

        tail = F.concat(tail, _each_call(call))
        thought = text(me, (strip(F.col("reasoning")), True), sampled=True)
        if newline:
            inner = F.when(shown, F.array(special("<think>", me, True), thought, special("</think>", me, True))).otherwise(F.array(special("<think>", me, True), special("</think>", me, True)))
            head = F.array(special("<|assistant|>", me), text(me, (newline, False)))
        else:
            shown = (F.col("msg_idx") > F.col("last_user")) if empty_think else shown
            inner = F.when(shown, F.array(special("<think>", me), thought, special("</think>", me, True))).otherwise(F.array(special("</think>", me)))
            head = F.array(special("<|assistant|>", me))
        result = text(me, (f"{newline}<tool_response>{newline}", False), (F.col("content"), True), (f"{newline}</tool_response>", False))
        tool = _tool_block([special("<|observation|>", F.when(closes, F.col("prev_idx")).otherwise(me), closes)], result, [])
        return F.when(role == "system", system).when(role == "user", user).when(role == "tool", tool).when(role == "assistant", F.concat(head, inner, tail)).otherwise(_none())

    return message


BOS_V3, USER_V3, ASSISTANT_V3, EOS_V3 = "<｜begin▁of▁sentence｜>", "<｜User｜>", "<｜Assistant｜>", "<｜end▁of▁sentence｜>"


def _deepseek_prompt(*after: tuple[str, str]) -> Callable[[], Column]:
    """What follows a tool's output flows on without a new marker."""
    return lambda: F.when(F.col("role") == "tool", _prompt(*after)().cast(SEGMENTS) if after else _none()).otherwise(_prompt(("S", ASSISTANT_V3), *after)().cast(SEGMENTS))


def _deepseek(last_block: bool) -> Callable[[], Column]:
    def message() -> Column:
        me = _me()
        content = F.substring_index("content", "</think>", -1) if last_block else F.col("content")
        leading = F.array(text(F.col("first_idx"), (F.when(F.col("msg_idx") > F.col("first_idx"), "\n\n").otherwise(""), True), (F.col("content"), True)))
        user = F.array(special(USER_V3, me), text(me, (F.col("content"), True)))
        after_tool = F.coalesce(F.col("prev_role") == "tool", F.lit(False))
        head = F.when(after_tool, _none()).otherwise(F.array(special(ASSISTANT_V3, me)))
        each = _each_call(lambda c, i: F.array(_mark("<｜tool▁call▁begin｜>"), _said("function"), _mark("<｜tool▁sep｜>"), _said(c["name"], "\n```json\n", c["arguments"], "\n```"), _mark("<｜tool▁call▁end｜>")))
        calls = F.when(_called(), F.concat(F.array(_mark("<｜tool▁calls▁begin｜>")), each, F.array(_mark("<｜tool▁calls▁end｜>")))).otherwise(_none())
        assistant = F.concat(head, F.array(_said(content)), calls, F.array(_mark(EOS_V3)))
        result = F.array(special("<｜tool▁output▁begin｜>", me), text(me, (F.col("content"), True)), special("<｜tool▁output▁end｜>", me))
        tool = F.concat(F.when(_opens(), F.array(special("<｜tool▁outputs▁begin｜>", me))).otherwise(_none()), result, F.when(_ends(), F.array(special("<｜tool▁outputs▁end｜>", me))).otherwise(_none()))
        return F.when(F.col("leading") == 1, leading).when(F.col("role").isin("user", "system"), user).when(F.col("role") == "tool", tool).otherwise(assistant)

    return message


def _kimi() -> Column:
    me, role = _me(), F.col("role")
    head = lambda token, name: [special(token, me), text(me, (name, False)), special("<|im_middle|>", me)]
    plain = F.array(*head("<|im_system|>", role), text(me, (F.col("content"), True)), special("<|im_end|>", me))
    user = F.array(*head("<|im_user|>", "user"), text(me, (F.col("content"), True)), special("<|im_end|>", me))
    each = _each_call(lambda c, i: F.array(_mark("<|tool_call_begin|>"), _said(F.coalesce(c["id"], F.lit(""))), _mark("<|tool_call_argument_begin|>"), _said(c["arguments"]), _mark("<|tool_call_end|>")))
    calls = F.when(_called(), F.concat(F.array(_mark("<|tool_calls_section_begin|>")), each, F.array(_mark("<|tool_calls_section_end|>")))).otherwise(_none())
    assistant = F.concat(F.array(*head("<|im_assistant|>", "assistant"), _said(F.col("content"))), calls, F.array(_mark("<|im_end|>")))
    of = F.concat(F.lit("## Return of "), F.coalesce("tool_call_id", F.lit("")), F.lit("\n"))
    tool = F.array(*head("<|im_system|>", F.coalesce(F.nullif("name", F.lit("")), F.lit("tool"))), text(me, (of, False)), text(me, (F.col("content"), True)), special("<|im_end|>", me))
    return F.when(role == "user", user).when(role == "assistant", assistant).when(role == "tool", tool).otherwise(plain)


KIMI_SYSTEM = "You are Kimi, an AI assistant created by Moonshot AI."


def _kimi_begin() -> Column:
    out = _outside()
    injected = F.array(special("<|im_system|>", out), text(out, ("system", False)), special("<|im_middle|>", out), text(out, (KIMI_SYSTEM, False)), special("<|im_end|>", out), text(out, ("\n", False)))
    return F.when(F.col("first_role") != "system", injected).otherwise(_none())


LLAMA_PREAMBLE = "\n\nCutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"


def _llama_system(owner: Column, body: Column) -> Column:
    return F.array(special("<|begin_of_text|>", _outside()), special("<|start_header_id|>", owner), text(owner, ("system", False)), special("<|end_header_id|>", owner), text(owner, (LLAMA_PREAMBLE, False), (body, True)), special("<|eot_id|>", owner))


def _llama() -> Column:
    me, role = _me(), F.col("role")
    body = strip(F.col("content"))
    head = [special("<|start_header_id|>", me), text(me, (role, False)), special("<|end_header_id|>", me)]
    assistant = F.array(*head, text(me, ("\n\n", False)), text(me, (body, True), sampled=True), special("<|eot_id|>", me, True))
    other = F.array(*head, text(me, ("\n\n", False), (body, True)), special("<|eot_id|>", me))
    one = F.element_at("calls", 1)
    call = F.array(*head, text(me, ("\n\n", False)), _said('{"name": "', one["name"], '", "parameters": ', one["arguments"], "}"), _mark("<|eot_id|>"))
    many = F.raise_error(F.lit("llama-3 takes one tool call a message")).cast(SEGMENTS)
    result = F.when(F.col("given"), quoted(F.col("content"))).otherwise("")
    tool = F.array(special("<|start_header_id|>", me), text(me, ("ipython", False)), special("<|end_header_id|>", me), text(me, ("\n\n", False), (result, True)), special("<|eot_id|>", me))
    first = (F.col("msg_idx") == F.col("first_idx")) & (role == "system")
    called = F.when(F.size("calls") > 1, many).when(_called(), call.cast(SEGMENTS)).otherwise(assistant.cast(SEGMENTS))
    return F.when(first, _llama_system(me, body).cast(SEGMENTS)).when(role == "tool", tool.cast(SEGMENTS)).when(role == "assistant", called).otherwise(other.cast(SEGMENTS))


MINIMAX_IDENTITY = "You are a helpful assistant. Your name is MiniMax-M2.5 and is built by MiniMax."


def _minimax_system(owner: Column, *body: tuple) -> Column:
    return F.array(special("]~!b[", owner), special("]~b]", owner), text(owner, ("system\n", False), *body), special("[e~[", owner), text(owner, ("\n", False)))


def _minimax() -> Column:
    me, role = _me(), F.col("role")
    shown = (F.col("reasoning") != "") & (F.col("msg_idx") > F.col("last_user"))
    body = F.when(F.col("reasoning") != "", strip_newlines(F.col("body"))).otherwise(F.col("body"))
    written = lambda c: F.concat(F.lit('<invoke name="'), c["name"], F.lit('">\n'), F.array_join(F.transform(argument_texts(c["arguments"]), lambda a: F.concat(F.lit('<parameter name="'), a["k"], F.lit('">'), a["v"], F.lit("</parameter>\n"))), ""), F.lit("</invoke>\n"))
    bare = _called() & ~shown & (body == "")  # the line break before the calls is then part of the header
    separator = F.when(_called() & ~bare, "\n").otherwise("")
    think = F.array(_mark("<think>"), _said("\n", F.col("reasoning"), "\n"), _mark("</think>"), _said("\n\n", body, separator))
    calls = F.when(_called(), F.array(_mark("<minimax:tool_call>"), _said("\n", F.array_join(F.transform("calls", written), "")), _mark("</minimax:tool_call>"))).otherwise(_none())
    inner = F.concat(F.when(shown, think).otherwise(F.array(_said(body, separator))), calls)
    assistant = F.concat(F.array(special("]~b]", me), text(me, (F.when(bare, "ai\n\n").otherwise("ai\n"), False))), inner, F.array(special("[e~[", me, True), text(me, ("\n", False))))
    user = F.array(special("]~b]", me), text(me, ("user\n", False), (F.col("content"), True)), special("[e~[", me), text(me, ("\n", False)))
    system = F.when(_first() & (F.col("content") != ""), _minimax_system(me, (F.col("content"), True))).when(_first(), _minimax_system(me, (MINIMAX_IDENTITY, False))).otherwise(_none())
    result = text(me, ("\n<response>", False), (F.col("content"), True), ("</response>", False))
    tool = _tool_block([special("]~b]", me), text(me, ("tool", False))], result, [special("[e~[", me), text(me, ("\n", False))])
    return F.when(role == "system", system).when(role == "user", user).when(role == "tool", tool).when(role == "assistant", assistant).otherwise(_none())


def _prompt(*parts: tuple[str, str]) -> Callable[[], Column]:
    return lambda: F.array(*[special(v, _outside()) if k == "S" else text(_outside(), (v, False)) for k, v in parts])


FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        Family("qwen3", _none, _chatml(_qwen3_assistant, lambda x: x), _prompt(("S", "<|im_start|>"), ("T", "assistant\n")), ("<|im_end|>", "<|endoftext|>"), "tool_cycle", roles=WITH_TOOLS),
        Family("qwen3.5", _none, _chatml(_qwen35_assistant, strip), _prompt(("S", "<|im_start|>"), ("T", "assistant\n"), ("S", "<think>"), ("T", "\n")), ("<|im_end|>", "<|endoftext|>"), "tool_cycle", roles=WITH_TOOLS, late_system=False),
        Family("glm-4.5", _prompt(("S", "[gMASK]"), ("S", "<sop>")), _glm("\n"), _prompt(("S", "<|assistant|>")), ("<|endoftext|>", "<|user|>", "<|observation|>"), "tool_cycle", "None", WITH_TOOLS),
        Family("glm-5", _prompt(("S", "[gMASK]"), ("S", "<sop>")), _glm(""), _prompt(("S", "<|assistant|>"), ("S", "<think>")), ("<|endoftext|>", "<|user|>", "<|observation|>"), "tool_cycle", "None", WITH_TOOLS),
        Family("qwen3.6", _none, _chatml(_qwen36_assistant, strip), _prompt(("S", "<|im_start|>"), ("T", "assistant\n"), ("S", "<think>"), ("T", "\n")), ("<|im_end|>", "<|endoftext|>"), "tool_cycle", roles=WITH_TOOLS, late_system=False),
        Family("glm-5.1", _prompt(("S", "[gMASK]"), ("S", "<sop>")), _glm("", empty_think=True), _prompt(("S", "<|assistant|>"), ("S", "<think>")), ("<|endoftext|>", "<|user|>", "<|observation|>"), "tool_cycle", "None", WITH_TOOLS),
        Family("deepseek-v3", _prompt(("S", BOS_V3)), _deepseek(False), _deepseek_prompt(), (EOS_V3,), "all", roles=WITH_TOOLS),
        Family("deepseek-r1", _prompt(("S", BOS_V3)), _deepseek(True), _deepseek_prompt(("T", "<think>\n")), (EOS_V3,), "template", roles=WITH_TOOLS),
        Family("kimi-k2", _kimi_begin, _kimi, _prompt(("S", "<|im_assistant|>"), ("T", "assistant"), ("S", "<|im_middle|>")), ("<|im_end|>",), "all", roles=WITH_TOOLS),
        Family("llama-3", lambda: F.when(F.col("first_role") != "system", _llama_system(_outside(), F.lit(""))).otherwise(_none()), _llama, _prompt(("S", "<|start_header_id|>"), ("T", "assistant"), ("S", "<|end_header_id|>"), ("T", "\n\n")), ("<|eot_id|>", "<|end_of_text|>", "<|eom_id|>"), "all", roles=WITH_TOOLS),
        Family("minimax-m2", lambda: F.when(F.col("first_role") != "system", _minimax_system(_outside(), (MINIMAX_IDENTITY, False))).otherwise(_none()), _minimax, _prompt(("S", "]~b]"), ("T", "ai\n"), ("S", "<think>"), ("T", "\n")), ("[e~[",), "tool_cycle", "None", WITH_TOOLS),
    )
}


def segments(messages: DataFrame, family: str, generation_prompt: bool = True, whole: bool = True) -> DataFrame:
    """(conv_id, msg_idx, seg_idx, kind, text, owner, sampled, content_from, content_to) of whole conversations.

    The generation prompt follows conversations that do not end in an assistant. Empty groups are left out. A system message
    that is not the first raises an error in formats that refuse it, unless messages extend a conversation (whole is false).
    """
    f = FAMILIES[family]
    rows = facts(messages, f.null_text)
    begin = F.when(_first(), f.begin().cast(SEGMENTS)).otherwise(_none())
    last = (F.col("msg_idx") == F.col("last_idx")) & (F.col("role") != "assistant")
    end = F.when(last, f.prompt().cast(SEGMENTS)).otherwise(_none()) if generation_prompt else _none()
    unknown = F.raise_error(F.concat(F.lit(f"{family} does not render role "), F.coalesce("role", F.lit("null")))).cast(SEGMENTS)
    body = F.when(F.col("role").isin(*f.roles), f.message().cast(SEGMENTS)).otherwise(unknown)
    if whole and not f.late_system:
        late = F.raise_error(F.lit(f"{family} takes a system message at the beginning only")).cast(SEGMENTS)
        body = F.when((F.col("role") == "system") & ~_first(), late).otherwise(body)
    exploded = rows.select("conv_id", "msg_idx", F.posexplode(F.filter(F.concat(begin, body, end), lambda s: s["text"] != "")).alias("seg_idx", "s"))
    return exploded.select("conv_id", "msg_idx", "seg_idx", "s.*")
