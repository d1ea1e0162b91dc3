"""Operators on rendered conversations: render, analyze, sample, split, parse, bridge, decode, resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.functions import after_header, common_prefix, find_ids, held, pieces, token_id, trim_to_turn_close
from turnframe.operators.responses import parse_glm, parse_hermes, parse_llama  # noqa: F401
from turnframe.plans import FAMILIES, is_user_query, segments


def render_text(messages: DataFrame, family: str) -> DataFrame:
    """(conv_id, text): the whole prompt as one string."""
    parts = segments(messages, family).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "seg_idx", "text"))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def tokens(messages: DataFrame, family: str) -> DataFrame:
    """(conv_id, pos, token_id, piece, owner, sampled, content): each group tokenized in one pass, each token in the part that
    its first character is in. On sampled text, content is sampled."""
    return segment_tokens(segments(messages, family))


def _cut(segs: DataFrame) -> DataFrame:
    """segs with pieces, their tokens' texts."""
    return segs.withColumn("pieces", F.when(F.col("kind") == "S", F.array("text")).otherwise(pieces(F.col("text"))))


def _starting_before(bound: Column) -> Column:
    """How many of a segment's pieces start before a character of it."""
    count = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), (a["n"] + (a["at"] < bound).cast("int")).alias("n"))
    counted = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), count, lambda a: a["n"])
    return F.when(bound <= 0, 0).when(bound >= F.length("text"), F.size("pieces")).otherwise(counted)


def segment_tokens(segs: DataFrame) -> DataFrame:
    """tokens() of segments. Segments are put in order and counted, tokens leave them as rows last: none is sorted."""
    before = Window.partitionBy("conv_id").orderBy("msg_idx", "seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = _cut(segs).withColumn("first", F.coalesce(F.sum(F.size("pieces")).over(before), F.lit(0)).cast("int"))
    bounded = placed.select("conv_id", "first", "owner", "sampled", _starting_before(F.col("content_from")).alias("lo"), _starting_before(F.col("content_to")).alias("hi"), "pieces")
    rows = bounded.select("conv_id", "first", "owner", "sampled", "lo", "hi", F.posexplode("pieces").alias("piece_idx", "piece"))
    content = F.col("sampled") | ((F.col("piece_idx") >= F.col("lo")) & (F.col("piece_idx") < F.col("hi")))
    return rows.select("conv_id", (F.col("first") + F.col("piece_idx")).alias("pos"), token_id(F.col("piece")).alias("token_id"), "piece", "owner", "sampled", content.alias("content"))


def _in_order(segs: DataFrame, *columns: Column | str) -> DataFrame:
    """(conv_id, s): a conversation's segments in order as an array of structs of msg_idx, seg_idx and columns."""
    return segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "seg_idx", *columns))).alias("s"))


def segment_arrays(segs: DataFrame) -> DataFrame:
    """(conv_id, token_ids, text): id_arrays() of segments and their pieces put together, without a row a token."""
    ids = F.transform("pieces", token_id).alias("ids")
    rows = _in_order(_cut(segs), ids, F.array_join("pieces", "").alias("text"))
    return rows.select("conv_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("token_ids"), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))


def turn_ids(segs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, prompt_ids, completion_ids, token_ids): ids before what is sampled of a message, from there to the last of it, and all.

    segs: whole conversations. turns (conv_id, turn): which message, by msg_idx. Of one that nothing is sampled of, both are empty.
    """
    mine = F.coalesce((F.col("owner") == F.col("turn")) & F.col("sampled"), F.lit(False)).alias("mine")
    rows = _in_order(_cut(segs.join(turns, "conv_id")), F.transform("pieces", token_id).alias("ids"), mine)
    at = F.filter(F.transform("s", lambda x, i: F.when(x["mine"], i)), lambda i: i.isNotNull())
    rows = rows.select("conv_id", "s", F.array_min(at).alias("begin"), F.array_max(at).alias("end"))
    ids = lambda keep: F.flatten(F.transform(F.filter("s", keep), lambda x: x["ids"]))
    completion = ids(lambda x, i: (i >= F.col("begin")) & (i <= F.col("end")))
    return rows.select("conv_id", ids(lambda x, i: i < F.col("begin")).alias("prompt_ids"), completion.alias("completion_ids"), F.flatten(F.transform("s", lambda x: x["ids"])).alias("token_ids"))


def tokens_per_message(messages: DataFrame, toks: DataFrame) -> DataFrame:
    """Counts and outer half-open span of every message; a message without tokens has counts 0 and a null span."""
    counted = toks.where("owner >= 0").groupBy("conv_id", F.col("owner").alias("msg_idx")).agg(F.count("*").alias("n"), F.count_if("sampled").alias("s"), F.count_if("content").alias("c"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return messages.select("conv_id", "msg_idx", "role").join(counted, ["conv_id", "msg_idx"], "left").select("conv_id", "msg_idx", "role", zero("n").alias("n_tokens"), zero("s").alias("n_sampled"), zero("c").alias("n_content"), "start", "end")


def tokens_by_role(per_message: DataFrame) -> DataFrame:
    return per_message.groupBy("conv_id", "role").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_sampled").alias("n_sampled"))


def role_spans(per_message: DataFrame) -> DataFrame:
    """(conv_id, role, spans): "start-end" of each message of the role, in order; empty if none has tokens."""
    spans = F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("msg_idx", "start", "end"))))
    listed = F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return per_message.groupBy("conv_id", "role").agg(listed.alias("spans"))


def content_spans(messages: DataFrame, toks: DataFrame) -> DataFrame:
    """(conv_id, role, start, end): maximal runs of content inside each message."""
    body = toks.where("owner >= 0 and content")
    w = Window.partitionBy("conv_id", "owner").orderBy("pos")
    runs = body.withColumn("run", F.col("pos") - F.row_number().over(w)).groupBy("conv_id", F.col("owner").alias("msg_idx"), "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return runs.join(messages.select("conv_id", "msg_idx", "role"), ["conv_id", "msg_idx"]).select("conv_id", "role", "start", "end")


def loss_mask(messages: DataFrame, toks: DataFrame, roles: Column | None = None, body_roles: tuple[str, ...] = (), selected: Column | None = None) -> DataFrame:
    """toks with train: whether the token counts in the loss.

    roles: predicate on the owner's role; none means what the model sampled. body_roles: roles whose body counts though it
    was not sampled. selected: predicate on the owner's columns that must hold besides.
    """
    owners = messages.select("conv_id", F.col("msg_idx").alias("owner"), "role")
    joined = toks.join(owners, ["conv_id", "owner"], "left")
    mask = F.when(F.col("owner") < 0, False).when(F.col("role").isin(*body_roles) if body_roles else F.lit(False), F.col("content")).when(~F.col("sampled"), False).otherwise(roles if roles is not None else F.lit(True))
    if selected is not None:
        mask = mask & F.when(F.col("owner") < 0, False).otherwise(selected)
    return joined.withColumn("train", F.coalesce(mask, F.lit(False)))


def training_samples(messages: DataFrame, toks: DataFrame, family: str, roles: Column | None = None, body_roles: tuple[str, ...] = (), final_stop: bool = False, masks: DataFrame | None = None) -> DataFrame:
    """(conv_id, token_ids, loss_mask, fault): a conversation's tokens and which of them count, one row each.

    roles and body_roles as for loss_mask(). Where sampled is null, tokens carry no signal: roles must be given then, else
    the fault is missing_signal; where content is null, body_roles do nothing. final_stop: where the last message is an
    assistant's that counts, its tokens end with a stop that counts, appended if they don't. masks (conv_id, mask array<int>,
    an entry a message in order): messages that count; faults as in mask_faults(). A fault leaves no sample.
    """
    order = Window.partitionBy("conv_id").orderBy("msg_idx")
    known = messages.select("conv_id", F.col("msg_idx").alias("owner"), "role", (F.row_number().over(order) - 1).alias("_place"), (roles if roles is not None else F.lit(True)).alias("_counts"))
    joined = toks.join(known, ["conv_id", "owner"], "left")
    bodied = (F.col("role").isin(*body_roles) if body_roles else F.lit(False)) & F.col("content").isNotNull()
    train = F.when(F.col("owner") < 0, False).when(bodied, F.col("content")).when(~F.coalesce("sampled", F.lit(True)), False).otherwise(F.coalesce("_counts", F.lit(False)))
    token = F.struct("pos", F.col("token_id").alias("id"), "_place", F.coalesce(train, F.lit(False)).alias("train"))
    rows = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list(token)).alias("t"), F.bool_and(F.col("sampled").isNotNull()).alias("signal"))
    last = known.groupBy("conv_id").agg(F.max(F.struct("_place", "role", "_counts")).alias("last"))
    rows = last.join(rows, "conv_id", "left").withColumns({"t": F.coalesce("t", F.array().cast("array<struct<pos:bigint,id:bigint,_place:int,train:boolean>>")), "signal": F.coalesce("signal", F.lit(True))})
    stops = [token_id(F.lit(s)) for s in FAMILIES[family].stops]
    counting = F.filter("t", lambda x: x["train"])
    ends = F.coalesce(F.get(counting, F.size(counting) - 1)["id"].isin(*stops), F.lit(False))
    wanted = F.lit(final_stop) & F.col("signal") & (F.col("last")["role"] == "assistant") & F.coalesce(F.col("last")["_counts"], F.lit(False)) & ~ends
    stop = F.struct(F.size("t").cast("bigint").alias("pos"), stops[0].alias("id"), F.col("last")["_place"].alias("_place"), F.lit(True).alias("train"))
    rows = held(rows, all=F.when(wanted, F.concat("t", F.array(stop))).otherwise(F.col("t")))
    fault, keep = F.when(~F.col("signal") & F.lit(roles is None), "missing_signal"), lambda x: x["train"]
    if masks is not None:
        rows = rows.join(mask_faults(messages, masks).withColumnRenamed("fault", "_mask_fault"), "conv_id", "left").join(masks, "conv_id", "left")
        fault = F.coalesce("_mask_fault", fault)
        keep = lambda x: x["train"] & (F.col("mask").isNull() | F.coalesce(F.get("mask", x["_place"]) == 1, F.lit(False)))
    rows = rows.withColumn("fault", fault)
    sound = F.col("fault").isNull()
    return rows.select("conv_id", F.when(sound, F.transform("all", lambda x: x["id"])).alias("token_ids"), F.when(sound, F.transform("all", keep)).alias("loss_mask"), "fault")


def id_arrays(toks: DataFrame) -> DataFrame:
    """(conv_id, token_ids): one row a conversation."""
    return toks.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]).alias("token_ids"))


def split_at_common_prefix(prompt: DataFrame, full: DataFrame) -> DataFrame:
    """(conv_id, n_prompt, n_completion, stable): the full render split where it departs from the prompt's."""
    both = prompt.select("conv_id", F.col("token_ids").alias("p")).join(full.select("conv_id", F.col("token_ids").alias("f")), "conv_id")
    cut = both.withColumn("k", common_prefix(F.col("p"), F.col("f")))
    return cut.select("conv_id", F.col("k").alias("n_prompt"), (F.size("f") - F.col("k")).alias("n_completion"), (F.col("k") == F.size("p")).alias("stable"))


def tool_names(calls: DataFrame, results: DataFrame) -> DataFrame:
    """results with tool_name: their own name where they have a column name that is neither null nor empty; else that of the last call with their id; null for an orphan."""
    last = calls.groupBy("conv_id", "tool_call_id").agg(F.max_by("name", "call_idx").alias("tool_name"))
    joined = results.join(last, ["conv_id", "tool_call_id"], "left")
    if "name" not in results.columns:
        return joined
    return joined.withColumn("tool_name", F.coalesce(F.nullif("name", F.lit("")), "tool_name"))


def promoted_finish_reason(responses: DataFrame, calls: DataFrame) -> DataFrame:
    """responses (id, finish_reason, ...) with finish_reason tool_calls in place of stop where a call (id, status) is ok."""
    called = calls.where("status = 'ok'").select("id", F.lit(True).alias("called")).distinct()
    promoted = F.when((F.col("finish_reason") == "stop") & F.col("called"), "tool_calls").otherwise(F.col("finish_reason"))
    return responses.join(called, "id", "left").withColumn("finish_reason", promoted).drop("called")


def overlong(toks: DataFrame, most: int) -> DataFrame:
    """(conv_id, n_tokens) of prompts of more than most tokens."""
    return toks.groupBy("conv_id").agg(F.count("*").alias("n_tokens")).where(F.col("n_tokens") > most)


def validate_logprobs(samples: DataFrame) -> DataFrame:
    """samples (id, token_id, token, logprob, ...) with status: missing (no log-probability), not_finite, wrong_token (token is not
    token_id: and the sampled id) or ok."""
    named = F.regexp_extract(F.coalesce("token", F.lit("")), r"^token_id:(\d+)$", 1)
    lp = F.col("logprob")
    finite = ~F.isnan(lp) & (F.abs(lp) < float("inf"))
    return samples.withColumn("status", F.when(lp.isNull(), "missing").when(~finite, "not_finite").when(named != F.col("token_id").cast("string"), "wrong_token").otherwise("ok"))


def mask_faults(messages: DataFrame, masks: DataFrame) -> DataFrame:
    """(conv_id, fault): of each conversation with a loss mask (conv_id, mask array<int>), whether it fits: length, value or null if it does."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    bad = F.exists("mask", lambda x: x.isNull() | ~x.isin(0, 1))
    return masks.join(n, "conv_id", "left").select("conv_id", F.when(F.size("mask") != F.coalesce("n", F.lit(0)), "length").when(bad, "value").alias("fault"))


def media_keys(media: DataFrame) -> DataFrame:
    """media (id, bytes binary, ...) with key, the first 32 hexadecimal digits of the bytes' SHA-256, and first_id, the least id with equal bytes."""
    keyed = media.withColumn("key", F.substring(F.sha2("bytes", 256), 1, 32))
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first_id"))
    return keyed.join(firsts, "key")


def sampler_head(candidates: DataFrame, k: int) -> DataFrame:
    """Of each position's candidates (resp_id, pos, token_id, logprob) the k most likely, without any that ties with the next."""
    w = Window.partitionBy("resp_id", "pos").orderBy(F.desc("logprob"), "token_id")
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    edge = F.max(F.when(F.col("rank") == k + 1, F.col("logprob"))).over(Window.partitionBy("resp_id", "pos"))
    return ranked.withColumn("edge", edge).where((F.col("rank") <= k) & (F.col("edge").isNull() | (F.col("logprob") > F.col("edge")))).drop("edge")


def support_mass(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("resp_id", "pos").agg(F.round(F.sum(F.exp("logprob")), 6).alias("mass"), F.count("*").alias("n"), F.countDistinct("token_id").alias("n_distinct"))


def bridge_eligibility(previous: DataFrame, new: DataFrame, retention: str) -> DataFrame:
    """(conv_id, status): whether the previous ids can be extended by the new messages, and why not.

    previous: conv_id, closed (the completion holds a stop). new: conv_id, role, and content if there is any. A bridge
    refuses no messages, an assistant among them, retention "template", and, under "tool_cycle", a new user query; a user
    message that only wraps a tool's response is none.
    """
    return _eligible(previous, new, retention).select("conv_id", "status")


def _eligible(previous: DataFrame, new: DataFrame, retention: str) -> DataFrame:
    """previous with the status of bridge_eligibility()."""
    query = is_user_query() if "content" in new.columns else F.col("role") == "user"
    asked = new.groupBy("conv_id").agg(F.bool_or(F.col("role") == "assistant").alias("assistant"), F.bool_or(query).alias("query"))
    status = F.when(F.col("assistant").isNull(), "no_messages").when(F.col("assistant"), "assistant").when(F.lit(retention) == "template", "template").when((F.lit(retention) == "tool_cycle") & F.col("query"), "user_query").when(~F.col("closed"), "synthesize_close").otherwise("bridge")
    return previous.join(asked, "conv_id", "left").withColumn("status", status).drop("assistant", "query")


#: Formats whose assistant turns end in a token of their own. In the others the next message's marker ends them.
BRIDGED = ("qwen3", "qwen3.5", "qwen3.6", "deepseek-v3", "deepseek-r1", "kimi-k2", "llama-3", "minimax-m2")


def extension_segments(new: DataFrame, family: str) -> DataFrame:
    """Segments that follow an assistant turn's close: what the format puts after it, the new messages, the generation prompt.

    The new messages are rendered behind an empty assistant turn, of which only what follows its close is kept.
    """
    if family not in BRIDGED:
        raise ValueError(f"no bridge for {family}: an assistant turn has no close of its own")
    lead = new.groupBy("conv_id").agg((F.min("msg_idx") - 1).cast("int").alias("msg_idx")).withColumns({"role": F.lit("assistant"), "content": F.lit("")})
    segs = segments(lead.unionByName(new, allowMissingColumns=True), family, whole=False)
    whole = Window.partitionBy("conv_id")
    first = F.min("msg_idx").over(whole)
    close = (F.col("msg_idx") == F.col("first")) & (F.col("kind") == "S") & F.col("text").isin(*FAMILIES[family].stops)
    placed = segs.withColumn("first", first).withColumn("close", F.max(F.when(close, F.col("seg_idx"))).over(whole))
    return placed.where((F.col("msg_idx") > F.col("first")) | (F.col("seg_idx") > F.col("close")))


def bridge_extension(new: DataFrame, family: str) -> DataFrame:
    """Tokens of extension_segments()."""
    return segment_tokens(extension_segments(new, family))


#: Of each format with reasoning: the header of an assistant turn, its markers (each one token, or spelled), and what else ends a region without an end. Fixed values of the formats.
_CHATML = (("S", "<|im_start|>"), ("T", "assistant\n"))
_THINKING: dict[str, tuple[tuple[tuple[str, str], ...], str, tuple[tuple[str, str], ...]]] = {
    "qwen3": (_CHATML, "T", (("S", "<tool_call>"), ("T", "<tool_call>"))), "qwen3.5": (_CHATML, "S", (("S", "<tool_call>"), ("T", "<tool_call>"))), "qwen3.6": (_CHATML, "S", (("S", "<tool_call>"), ("T", "<tool_call>"))),
    "deepseek-v3": ((("S", "<｜Assistant｜>"),), "T", ()), "deepseek-r1": ((("S", "<｜Assistant｜>"),), "T", ()), "minimax-m2": ((("S", "]~b]"), ("T", "ai\n")), "S", (("S", "<minimax:tool_call>"),)),
    "kimi-k2": ((("S", "<|im_assistant|>"), ("T", "assistant"), ("S", "<|im_middle|>")), "T", (("S", "<|tool_calls_section_begin|>"),)),
}
#: White space of more characters than this in one token counts as text before reasoning.
_BLANK = 64


def _ids(*parts: tuple[str, str]) -> Column:
    return F.concat(*[F.array(token_id(F.lit(x))) if kind == "S" else F.transform(pieces(F.lit(x)), token_id) for kind, x in parts])


def _opened(ids: Column, open_: Column, blanks: Column, prefilled: Column) -> tuple[Column, Column]:
    """(whether ids begin with reasoning, where its text begins): at most white space precedes the marker, unless the prompt opened it."""
    at = find_ids(ids, open_)
    explicit = at.isNotNull() & F.forall(F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0))), lambda i: F.array_contains(blanks, i))
    explicit = F.coalesce(explicit, F.lit(False))
    return explicit | prefilled, F.when(explicit, at + F.size(open_)).otherwise(1)


def reasoning_state(previous: DataFrame, family: str) -> DataFrame:
    """previous (prompt_ids, completion_ids, ...) with prompt_open, whether the prompt ends in reasoning that it has begun, and reasoning_open, whether the completion ends in reasoning.

    The prompt counts from its last stop on, and from its last assistant header there; the completion up to its first stop,
    without a header of its own. A region is ended by its marker, and in a completion by the first call in formats where that
    may be. Formats without reasoning have neither.
    """
    no = F.lit(False)
    if family not in _THINKING:
        return previous.withColumns({"prompt_open": no, "reasoning_open": no})
    head, form, openers = _THINKING[family]
    stops = F.array(*[token_id(F.lit(s)) for s in FAMILIES[family].stops])
    runs = lambda c: [token_id(F.lit(c * k)) for k in range(1, _BLANK + 1)]
    known = held(previous, _header=_ids(*head), _open=_ids((form, "<think>")), _close=_ids((form, "</think>")), _stops=stops, _breaks=F.array(*runs("\n")), _blanks=F.array(*runs("\n"), *runs(" "), *runs("\t")))
    stopped = F.arrays_overlap("prompt_ids", "_stops")
    last = F.array_max(F.transform(F.filter("_stops", lambda s: F.array_contains("prompt_ids", s)), lambda s: F.size("prompt_ids") + 1 - F.array_position(F.reverse("prompt_ids"), s).cast("int")))
    known = held(known, _tail=F.when(stopped, F.slice("prompt_ids", last + 1, F.size("prompt_ids"))).otherwise(F.col("prompt_ids")))
    known = held(known, _tail2=after_header(F.col("_tail"), F.col("_header"), F.col("_breaks"), last=True))
    begins, at = _opened(F.col("_tail2"), F.col("_open"), F.col("_blanks"), no)
    known = held(known, prompt_open=begins & find_ids(F.slice("_tail2", at, F.size("_tail2")), F.col("_close")).isNull())
    first = F.array_min(F.filter(F.transform("_stops", lambda s: F.array_position("completion_ids", s)), lambda p: p > 0)).cast("int")
    known = held(known, _said=F.when(first.isNotNull(), F.slice("completion_ids", F.lit(1), first - 1)).otherwise(F.col("completion_ids")))
    known = held(known, _said2=after_header(F.col("_said"), F.col("_header"), F.col("_breaks")))
    begins, at = _opened(F.col("_said2"), F.col("_open"), F.col("_blanks"), F.col("prompt_open"))
    known = held(known, _begins=begins, _region=F.slice("_said2", at, F.size("_said2")))
    ended = find_ids(F.col("_region"), F.col("_close")).isNotNull()
    for o in openers:
        ended = ended | find_ids(F.col("_region"), _ids(o)).isNotNull()
    return known.withColumn("reasoning_open", F.col("_begins") & ~ended).drop("_header", "_open", "_close", "_stops", "_breaks", "_blanks", "_tail", "_tail2", "_said", "_said2", "_begins", "_region")


def bridge(previous: DataFrame, new: DataFrame, family: str) -> DataFrame:
    """(conv_id, status, token_ids, extension, ...): the ids that a model has seen and sampled, extended by new messages without rendering
    the conversation again, and the text of what was added after the turn's close; both are null where status is neither
    bridge nor synthesize_close.

    previous: conv_id, prompt_ids, completion_ids, and columns that stay. A completion is cut after its last stop; one without any gets the
    format's close, behind the end of its reasoning where it broke off within that. One that stops within its reasoning
    has status open_reasoning. An empty prompt has status no_prompt.
    """
    f = FAMILIES[family]
    stops = F.array(*[token_id(F.lit(s)) for s in f.stops])
    others = [c for c in previous.columns if c not in ("conv_id", "prompt_ids", "completion_ids")]
    known = reasoning_state(previous, family).withColumn("closed", F.arrays_overlap("completion_ids", stops))
    added = segment_arrays(extension_segments(new, family)).withColumnsRenamed({"token_ids": "_added", "text": "_text"})
    joined = _eligible(known, new, f.retention).join(added, "conv_id", "left")
    within = F.col("reasoning_open") & F.arrays_overlap("completion_ids", stops)
    status_ = F.when(F.size("prompt_ids") == 0, "no_prompt").when(F.col("status").isin("no_messages", "assistant"), F.col("status")).when(within, "open_reasoning").otherwise(F.col("status"))
    close = _ids((_THINKING[family][1], "</think>")) if family in _THINKING else F.array().cast("array<bigint>")
    completion = F.when(F.col("reasoning_open"), F.concat("completion_ids", close)).otherwise(F.col("completion_ids"))
    kept = trim_to_turn_close(F.col("prompt_ids"), completion, stops, token_id(F.lit(f.stops[0])))
    done = status_.isin("bridge", "synthesize_close")
    return joined.select("conv_id", status_.alias("status"), F.when(done, F.concat(kept, "_added")).alias("token_ids"), F.when(done, F.col("_text")).alias("extension"), *others)


def placeholder_types(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, types): per token 0, 1 in an image's range, 2 in a video's, as a string."""
    spans = ranges.groupBy("id").agg(F.collect_list(F.struct("start", "length", "type")).alias("r"))
    joined = lengths.join(spans, "id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<start:int,length:int,type:int>>")))
    kind = F.expr("transform(sequence(0, n - 1), i -> coalesce(array_max(transform(filter(r, x -> i >= x.start and i < x.start + x.length), x -> x.type)), 0))")
    return joined.select("id", F.array_join(kind.cast("array<string>"), "").alias("types"))
