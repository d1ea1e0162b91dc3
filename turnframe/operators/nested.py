"""Nested argument texts: a grammar of quoted strings and bare keys, read into JSON and written from it.

Both ways are a fold over lexemes with an explicit stack of open objects and arrays, in columns, so a text may nest as deep as
it likes and no row leaves its executor.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.functions import held, is_json, quoted, strip
from turnframe.operators.tagged import CUT, _let

#: Stands around strings. Fixed value of the format.
QUOTE = '<|"|>'
#: A quoted string where a value or key may begin, up to its end or that of the text: one lexeme, however long.
_STRING = r'(?s)(?<=(?:^|[{\[:,])\s{0,64})<\|"\|>.*?(?:<\|"\|>|\z)'
_FRAME = "struct<kind:string,key:string,keys:array<string>,values:array<string>>"
_NO_TEXTS = "array<string>"


def _frame(kind: Column) -> Column:
    return F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("key"), F.array().cast(_NO_TEXTS).alias("keys"), F.array().cast(_NO_TEXTS).alias("values")).cast(_FRAME)


def _top(stack: Column) -> Column:
    return F.get(stack, F.size(stack) - 1)


def _below(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def _state(acc: Column, **changes: Column) -> Column:
    names = ("stack", "mode", "text", "done", "fault")
    return F.struct(*[changes.get(c, acc[c]).alias(c) for c in names])


def _keyed(stack: Column, key: Column) -> Column:
    """The stack with a key for the next value of its top."""
    top = _top(stack)
    return F.concat(_below(stack), F.array(F.struct(top["kind"].alias("kind"), key.alias("key"), top["keys"].alias("keys"), top["values"].alias("values")).cast(_FRAME)))


def _put(acc: Column, stack: Column, value: Column) -> Column:
    """The state after a value: it is the whole text's, or goes to the top of the stack. A key that recurs has its last value, in its first place."""

    def into(top: Column) -> Column:
        at = F.array_position(top["keys"], top["key"]).cast("int")
        new = (top["kind"] == "[") | (at == 0)
        values = F.when(new, F.concat(top["values"], F.array(value))).otherwise(F.transform(top["values"], lambda v, i: F.when(i == at - 1, value).otherwise(v)))
        keys = F.when((top["kind"] == "{") & (at == 0), F.concat(top["keys"], F.array(top["key"]))).otherwise(top["keys"])
        return F.struct(top["kind"].alias("kind"), F.lit(None).cast("string").alias("key"), keys.alias("keys"), values.alias("values")).cast(_FRAME)

    inner = _state(acc, stack=F.concat(_below(stack), F.array(_let(_top(stack), into))), mode=F.lit("after"), text=F.lit(""))
    return F.when(F.size(stack) > 0, inner).otherwise(_state(acc, stack=stack, mode=F.lit("end"), text=F.lit(""), done=value))


def _json_text(top: Column) -> Column:
    """An object or array as JSON text."""
    pairs = F.zip_with(top["keys"], top["values"], lambda k, v: F.concat(quoted(k), F.lit(":"), v))
    return F.when(top["kind"] == "{", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(top["values"], ","), F.lit("]")))


def _begin() -> Column:
    return F.struct(
        F.array().cast(f"array<{_FRAME}>").alias("stack"), F.lit("value").alias("mode"), F.lit("").alias("text"),
        F.lit(None).cast("string").alias("done"), F.lit(None).cast("string").alias("fault"),
    )


def _lexemes(text: Column, pattern: str) -> Column:
    return F.filter(F.split(F.regexp_replace(text, pattern, f"{CUT}$0{CUT}"), CUT), lambda x: x != "")


def _branch(*cases: tuple[Column, Column]) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:-1]:
        out = out.when(*c)
    return out.otherwise(cases[-1][1])


def _literal(raw: Column) -> Column:
    """A bare value: JSON, or else a string."""
    return F.when(is_json(raw), raw).otherwise(quoted(raw))


def read_nested(df: DataFrame, text: str) -> DataFrame:
    """df with json and fault of a nested text: {key:<|"|>string<|"|>,other:[1,true,bare words]}.

    Keys and strings may be quoted, at the start of a value or key; what is in quotes is verbatim. A bare value runs to the next comma or closing bracket
    and is JSON, or else a string without white space at its ends. json is null where fault is not: missing value, unclosed
    string, missing key, missing colon, unclosed object or array, expected comma or end, trailing input. An empty text or
    null has no value.
    """

    def step(acc: Column, x: Column) -> Column:
        mode, stack = acc["mode"], acc["stack"]
        blank = strip(x) == ""
        whole = x.startswith(QUOTE) & x.endswith(QUOTE) & (F.length(x) >= 2 * len(QUOTE))
        said = x.substr(F.lit(len(QUOTE) + 1), F.length(x) - 2 * len(QUOTE))
        fault = lambda why: _state(acc, mode=F.lit("fault"), fault=F.lit(why))
        push = lambda mode_: _state(acc, stack=F.concat(stack, F.array(_frame(x))), mode=F.lit(mode_), text=F.lit(""))
        close = _put(acc, _below(stack), _json_text(_top(stack)))

        def in_after(acc_: Column) -> Column:
            """After a value: a comma, the end of what is open, or, at the outermost, nothing."""
            kind = _top(acc_["stack"])["kind"]
            return _branch(
                (blank, acc_),
                (F.size(acc_["stack"]) == 0, _state(acc_, mode=F.lit("fault"), fault=F.lit("trailing input"))),
                ((x == ",") & (kind == "{"), _state(acc_, mode=F.lit("key"))),
                ((x == ",") & (kind == "["), _state(acc_, mode=F.lit("value"))),
                (((x == "}") & (kind == "{")) | ((x == "]") & (kind == "[")), _put(acc_, _below(acc_["stack"]), _json_text(_top(acc_["stack"])))),
                (F.lit(True), _state(acc_, mode=F.lit("fault"), fault=F.lit("expected comma or end"))),
            )

        value = _branch(
            (blank, acc),
            (whole, _put(acc, stack, quoted(said))),
            (x.startswith(QUOTE), _state(acc, mode=F.lit("string"))),
            (x == "{", push("first")),
            (x == "[", push("begun")),
            ((x == "]") & (mode == "begun"), close),
            (x.isin(",", "}", "]"), fault("missing value")),
            (F.lit(True), _state(acc, mode=F.lit("literal"), text=x)),
        )
        key = _branch(
            (blank, acc),
            ((x == "}") & (mode == "first"), close),
            (whole, _state(acc, stack=_keyed(stack, said), mode=F.lit("colon"))),
            (x.startswith(QUOTE), _state(acc, mode=F.lit("quoted key"))),
            (x.isin(":", ",", "{", "}", "[", "]"), fault("missing key")),
            (F.lit(True), _state(acc, mode=F.lit("bare key"), text=x)),
        )
        bare = _branch(
            (x == ":", _state(acc, stack=_keyed(stack, strip(acc["text"])), mode=F.lit("value"), text=F.lit(""))),
            (x.isin(",", "{", "}", "[", "]"), fault("missing colon")),
            (F.lit(True), _state(acc, text=F.concat(acc["text"], x))),
        )
        colon = _branch((blank, acc), (x == ":", _state(acc, mode=F.lit("value"))), (F.lit(True), fault("missing colon")))
        literal = F.when(x.isin(",", "}", "]"), _let(_put(acc, stack, _literal(strip(acc["text"]))), in_after)).otherwise(_state(acc, text=F.concat(acc["text"], x)))
        return _branch(
            (mode.isin("value", "begun"), value), (mode.isin("first", "key"), key), (mode == "bare key", bare),
            (mode == "colon", colon), (mode == "literal", literal), (mode.isin("after", "end"), in_after(acc)), (F.lit(True), acc),
        )

    folded = held(held(df, _lexemes=_lexemes(F.coalesce(F.col(text), F.lit("")), _STRING + r'|<\|"\|>|[{}\[\]:,]')), _read=F.aggregate("_lexemes", _begin(), step))
    r = F.col("_read")
    bare_end = (r["mode"] == "literal") & (F.size(r["stack"]) == 0)
    open_end = F.when(r["mode"].isin("string", "quoted key"), "unclosed string").when(r["mode"] == "value", "missing value").when(r["mode"].isin("first", "key"), "missing key").when(r["mode"].isin("bare key", "colon"), "missing colon").when(F.size(r["stack"]) > 0, F.concat(F.lit("unclosed "), F.when(_top(r["stack"])["kind"] == "{", "object").otherwise("array")))
    fault = F.coalesce(r["fault"], F.when(~bare_end, open_end))
    json = F.when(bare_end, _literal(strip(r["text"]))).otherwise(r["done"])
    return folded.withColumns({"json": F.when(fault.isNull(), json), "fault": fault}).drop("_lexemes", "_read")


def write_nested(df: DataFrame, json: str, quote_keys: bool = False) -> DataFrame:
    """df with nested, the text of a JSON value in this grammar: members by their keys without regard to case, strings in quotes.

    Numbers keep their digits. What is no JSON is null. A key that recurs has its last value.
    """

    def text_of(top: Column) -> Column:
        shown = lambda k: F.concat(F.lit(QUOTE), k, F.lit(QUOTE)) if quote_keys else k
        zipped = F.zip_with(top["keys"], top["values"], lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        members = F.transform(F.array_sort(F.transform(zipped, lambda x, i: F.struct(F.lower(x["k"]).alias("low"), i.alias("i"), x.alias("x")))), lambda x: F.concat(shown(x["x"]["k"]), F.lit(":"), x["x"]["v"]))
        return F.when(top["kind"] == "{", F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(top["values"], ","), F.lit("]")))

    def said(x: Column) -> Column:
        return F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")

    def step(acc: Column, x: Column) -> Column:
        stack = acc["stack"]
        is_key = (_top(stack)["kind"] == "{") & _top(stack)["key"].isNull() & x.startswith('"')
        return _branch(
            ((strip(x) == "") | x.isin(":", ","), acc),
            (x.isin("{", "["), _state(acc, stack=F.concat(stack, F.array(_frame(x))))),
            (x.isin("}", "]"), _put(acc, _below(stack), text_of(_top(stack)))),
            (F.coalesce(is_key, F.lit(False)), _state(acc, stack=_keyed(stack, said(x)))),
            (x.startswith('"'), _put(acc, stack, F.concat(F.lit(QUOTE), said(x), F.lit(QUOTE)))),
            (F.lit(True), _put(acc, stack, strip(x))),
        )

    valid = F.when(is_json(F.col(json)), F.col(json)).otherwise("")
    folded = held(held(df, _lexemes=_lexemes(valid, r'"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]')), _read=F.aggregate("_lexemes", _begin(), step))
    return folded.withColumn("nested", F.col("_read")["done"]).drop("_lexemes", "_read")


def parse_gemma_call(attempts: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """attempts (id, call_idx, raw, closed) with name, arguments and status: unclosed, malformed (no call: or no braces), invalid_json (arguments out of grammar), missing_name, unknown_tool (where tools (name) are given), ok."""
    shaped = F.col("raw").startswith("call:") & (F.instr("raw", "{") > 0) & F.col("raw").endswith("}")
    head = F.substring_index(F.col("raw").substr(F.lit(6), F.length("raw")), "{", 1)
    body = F.when(shaped, F.col("raw").substr(F.instr("raw", "{"), F.length("raw"))).otherwise("")
    rows = read_nested(attempts.withColumns({"shaped": shaped, "name": F.when(shaped, F.nullif(strip(head), F.lit(""))), "body": body}), "body")
    if tools is not None:
        rows = rows.join(tools.select("name", F.lit(True).alias("known")).distinct(), "name", "left")
    unknown = ~F.coalesce("known", F.lit(False)) if tools is not None else F.lit(False)
    status = F.when(~F.col("closed"), "unclosed").when(~F.col("shaped"), "malformed").when(F.col("fault").isNotNull(), "invalid_json").when(F.col("name").isNull(), "missing_name").when(unknown, "unknown_tool").otherwise("ok")
    return rows.select("id", "call_idx", F.when(F.col("closed"), F.col("name")).alias("name"), F.when(F.col("closed"), F.col("json")).alias("arguments"), status.alias("status"), "raw")
