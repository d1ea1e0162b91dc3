"""Column functions: text, tokens, arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters, single digits, line breaks, other white space, and any other character: lossless, in one pass.
PIECE = r"\p{L}+|[0-9]|\n+|[ \t\r]+|[^\p{L}0-9\s]|(?s:.)"


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row, however often later expressions name them: a generator of one element stands between, which is not merged with these."""
    for name, column in columns.items():
        df = df.select("*", F.explode_outer(F.array(column)).alias(name))
    return df


def strip(x: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+$", "")


def strip_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"^\n+|\n+$", "")


def lstrip_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"^\n+", "")


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def after(x: Column, marker: str) -> Column:
    """What follows the first marker; empty where there is none."""
    at = F.instr(x, marker)
    return F.when(at > 0, x.substr(at + F.lit(len(marker)), F.length(x))).otherwise("")


def between(x: Column, start: str, end: str) -> Column:
    """What follows the first start, up to the first end after it or else all."""
    return F.substring_index(after(x, start), end, 1)


def think_split(content: Column) -> tuple[Column, Column]:
    """(reasoning, body): what stands before the first </think>, from the last <think> in it, and what stands after."""
    has = F.instr(content, "</think>") > 0
    before = F.substring_index(content, "</think>", 1)
    after = content.substr(F.instr(content, "</think>") + F.lit(8), F.length(content))
    reasoning = strip_newlines(F.when(F.instr(before, "<think>") > 0, F.substring_index(before, "<think>", -1)).otherwise(before))
    return F.when(has, reasoning).otherwise(F.lit("")), F.when(has, lstrip_newlines(after)).otherwise(content)


def token_id(piece: Column) -> Column:
    """The lexical backend's id of a piece: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(piece.cast("binary")), 1, 8), 16, 10).cast("bigint")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    return F.when(differs == 0, n.cast("bigint")).otherwise(differs - 1)


def find_ids(ids: Column, sub: Column, last: bool = False) -> Column:
    """Where sub begins in ids, counted from 1, for the first or the last time; null if nowhere or if sub is empty."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), lambda i: (F.get(ids, i - 1) == F.get(sub, F.lit(0))) & (F.slice(ids, i, F.size(sub)) == sub))
    return F.get(at, F.size(at) - 1) if last else F.get(at, F.lit(0))


def after_header(ids: Column, header: Column, breaks: Column, last: bool = False) -> Column:
    """ids without a header at their start, or all up to its last occurrence, and without the line breaks (ids) that follow; ids that have no such header stay."""
    at = find_ids(ids, header, True) if last else F.when(F.slice(ids, F.lit(1), F.size(header)) == header, 1)
    rest = F.slice(ids, at + F.size(header), F.size(ids))
    text = F.array_position(F.transform(rest, lambda i: F.array_contains(breaks, i)), False).cast("int")
    return F.when(at.isNotNull(), F.when(text == 0, F.slice(rest, 1, 0)).otherwise(F.slice(rest, text, F.size(rest)))).otherwise(ids)


def trim_to_turn_close(prompt: Column, completion: Column, close_ids: Column, synthesize: Column | None = None) -> Column:
    """prompt and completion up to the completion's last close id; else with synthesize appended; else null."""
    at = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.size(completion), F.lit(1))), lambda i: F.array_contains(close_ids, F.get(completion, i - 1))))
    none = F.lit(None).cast("array<bigint>")
    open_end = F.concat(prompt, completion, F.array(synthesize)) if synthesize is not None else none
    return F.when(at.isNotNull(), F.concat(prompt, F.slice(completion, F.lit(1), at))).otherwise(open_end)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value. The parser ignores what follows a value, so it is asked for the text as an array's only element and as an object's only value."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def quoted(text: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.struct(text.alias("v")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def coerce_argument(text: Column, type_: Column) -> tuple[Column, Column]:
    """(JSON text, whether it fell back): a string parameter is quoted verbatim; others must be JSON, else are quoted."""
    valid = is_json(text)
    is_string = type_ == "string"
    return F.when(is_string | ~valid, quoted(text)).otherwise(text), ~is_string & ~valid


def coerced(keys: str, values: str, types: Column) -> tuple[Column, Column]:
    """(JSON texts of values, whether one fell back), by the types (a map or null) of their keys. Strings stay as they are,
    others are JSON, else strings; that is no falling back where the type is maybe_string."""
    listed = F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v"))
    declared = lambda x: F.coalesce(types[x["k"]], F.lit("other"))
    verbatim = lambda x: (declared(x) == "string") | ~is_json(x["v"])
    texts = F.transform(listed, lambda x: F.when(verbatim(x), quoted(x["v"])).otherwise(x["v"]))
    return texts, F.exists(listed, lambda x: (declared(x) == "other") & ~is_json(x["v"]))


def json_object(keys: str, values: Column) -> Column:
    """JSON text of an object. A key that recurs stands where it came first, with the value that came last."""
    listed = F.arrays_zip(F.col(keys).alias("k"), values.alias("v"))
    entry = lambda k: F.concat(quoted(k), F.lit(":"), F.element_at(F.filter(listed, lambda x: x["k"] == k), -1)["v"])
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_distinct(F.col(keys)), entry), ","), F.lit("}"))


def spaced_json(text: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside strings. The loops are possessive, so that strings of any length cost no stack."""
    return F.regexp_replace(text, r'\G((?:[^",:]++|"(?:[^"\\]++|\\.)*+")*+)([,:])', "$1$2 ")


def json_member(text: Column, key: str) -> Column:
    """JSON text of a member of a JSON object; null where the text is no object or has no such member. Numbers keep their digits; a member that recurs counts as it came last."""
    value = F.try_element_at(F.from_json(text, "map<string,string>"), F.lit(key))
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(text), f"$.{key}", "variant"))
    has = F.array_contains(F.map_keys(F.from_json(text, "map<string,string>")), key)
    return F.when(has, F.when(kind == "STRING", quoted(value)).otherwise(F.coalesce(value, F.lit("null"))))


def argument_texts(arguments: Column, python_words: bool = False) -> Column:
    """array<struct<k, v>> of the members of a JSON object, in order: strings as they are, other values as JSON with spaces,
    or with python_words True, False and None for the bare ones. Numbers keep their digits; what is no object has no members."""
    texts = F.from_json(arguments, "map<string,string>")
    kinds = F.from_json(arguments, "map<string,variant>")

    def shown(k: Column, v: Column, kind: Column) -> Column:
        bare = F.coalesce(v, F.lit("null"))
        word = F.element_at(F.create_map(*[F.lit(x) for x in ("true", "True", "false", "False", "null", "None")]), bare) if python_words else bare
        text = F.when(F.schema_of_variant(kind) == "STRING", v).when(F.schema_of_variant(kind).rlike("^(OBJECT|ARRAY)"), spaced_json(v)).otherwise(F.coalesce(word, bare))
        return F.struct(k.alias("k"), F.coalesce(text, word, bare).alias("v"))

    zipped = F.arrays_zip(F.map_keys(texts).alias("k"), F.map_values(texts).alias("v"), F.map_values(kinds).alias("t"))
    return F.coalesce(F.transform(zipped, lambda x: shown(x["k"], x["v"], x["t"])), F.array().cast("array<struct<k:string,v:string>>"))
