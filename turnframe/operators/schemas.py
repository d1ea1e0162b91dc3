"""JSON Schema of tools as type declarations.

Schemas are flattened to a table of nodes, a level at a time, and put together from the deepest level up. References stay
names, so cycles cost nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.functions import held, json_member, spaced_json

# Fixed values of the format.
_UNION = {"string": "string", "number": "number", "integer": "number", "boolean": "boolean", "null": "null", "object": "{}", "array": "Array<any>"}
_BOUNDS = {"string": ("maxLength", "minLength", "pattern"), "number": ("maximum", "minimum"), "integer": ("maximum", "minimum"), "array": ("maxItems", "minItems")}
_DEFS = "#/$defs/"

_CHILD = "struct<slot:string,ord:int,name:string,optional:boolean,indent:int,schema:string>"
_NODE = ("tool_id", "path", "parent", "slot", "ord", "name", "optional", "indent", "schema")


def _pad(n: Column) -> Column:
    return F.repeat(F.lit("  "), n)


def _get(key: str) -> Column:
    return F.try_element_at("members", F.lit(key))


def _members(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def _lines(text: Column, indent: Column) -> Column:
    """A text as comment lines; empty lines stay empty."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x != "", F.concat(_pad(indent), F.lit("// "), x)).otherwise("")), "\n")


def _described(indent: Column) -> Column:
    """Comment lines of the node in row: its description and its bounds."""
    said = F.when(F.coalesce(_get("description"), F.lit("")) != "", F.concat(_lines(_get("description"), indent), F.lit("\n"))).otherwise("")
    bounds = F.lit("")
    for kind, keys in _BOUNDS.items():
        found = F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), _get(k)) for k in keys])
        bounds = F.when(F.col("kind") == kind, found).otherwise(bounds)
    return F.concat(said, F.when(bounds != "", F.concat(_pad(indent), F.lit("// "), bounds, F.lit("\n"))).otherwise(""))


def _kind() -> Column:
    """any, null, ref, anyOf, enum, union, object, array, another type's name, or invalid."""
    type_ = _get("type")
    has = lambda k: F.array_contains(F.map_keys("members"), k)
    return (
        F.when(F.col("slot") == "root", "object").when(F.col("schema") == "true", "any").when(F.col("schema") == "false", "null").when(has("$ref"), "ref").when(has("anyOf"), "anyOf").when(has("enum"), "enum")
        .when(type_.startswith("["), "union").when(type_.isNotNull(), type_).when(F.size(F.map_keys("members")) == 0, "any").otherwise("invalid")
    )


def _looked_at(nodes: DataFrame) -> DataFrame:
    return held(held(nodes, members=_members(F.col("schema"))), kind=_kind())


def _children() -> Column:
    """The node's parts: properties, what others may be, items, branches."""
    child = lambda slot, i, name, optional, indent, schema: F.struct(F.lit(slot).alias("slot"), i.cast("int").alias("ord"), name.alias("name"), optional.alias("optional"), indent.cast("int").alias("indent"), schema.alias("schema"))
    none, no, here = F.lit(None).cast("string"), F.lit(False), F.col("indent")
    required = F.coalesce(F.from_json(_get("required"), "array<string>"), F.array().cast("array<string>"))
    listed = F.transform(F.map_entries(_members(_get("properties"))), lambda e, i: child("property", i, e["key"], ~F.array_contains(required, e["key"]), here + 1, e["value"]))
    others = F.when(_get("additionalProperties").isNotNull(), F.array(child("others", F.lit(-1), none, no, here + 1, _get("additionalProperties")))).otherwise(F.array())
    item = _get("items")
    item_members = _members(item)
    documented = F.coalesce(F.try_element_at(item_members, F.lit("description")), F.lit("")) != ""
    for kind, keys in _BOUNDS.items():
        documented = documented | ((F.try_element_at(item_members, F.lit("type")) == kind) & F.arrays_overlap(F.map_keys(item_members), F.array(*map(F.lit, keys))))
    inside = F.when(item.isNotNull() & ~item.isin("{}", "false", "null"), F.array(child("item", F.lit(0), none, no, here + F.when(F.coalesce(documented, no), 1).otherwise(0), item))).otherwise(F.array())
    branches = F.transform(F.from_json(_get("anyOf"), "array<string>"), lambda x, i: child("branch", i, none, no, here, x))
    empty = F.array().cast(f"array<{_CHILD}>")
    cast = lambda c: c.cast(f"array<{_CHILD}>")
    return F.when(F.col("kind") == "object", F.concat(cast(listed), cast(others))).when(F.col("kind") == "array", cast(inside)).when(F.col("kind") == "anyOf", cast(branches)).otherwise(empty)


def schema_nodes(tools: DataFrame) -> list[DataFrame]:
    """Levels of nodes of tools (tool_id, parameters JSON text): the root and its definitions, then parts of these, and so on; kept in memory, as each is made of the one before."""
    root = tools.select("tool_id", F.coalesce("parameters", F.lit("{}")).alias("schema"))
    none = F.lit(None).cast("string")
    first = root.select("tool_id", F.lit("root").alias("path"), none.alias("parent"), F.lit("root").alias("slot"), F.lit(0).alias("ord"), none.alias("name"), F.lit(False).alias("optional"), F.lit(0).alias("indent"), "schema")
    defs = root.select("tool_id", F.posexplode(F.map_entries(_members(F.try_element_at(_members(F.col("schema")), F.lit("$defs"))))).alias("ord", "e"))
    defs = defs.select("tool_id", F.concat(F.lit("def"), F.col("ord").cast("string")).alias("path"), none.alias("parent"), F.lit("def").alias("slot"), "ord", F.col("e.key").alias("name"), F.lit(False).alias("optional"), F.lit(0).alias("indent"), F.col("e.value").alias("schema"))
    level = _looked_at(first.unionByName(defs)).persist()
    out = [level]
    while True:
        parts = level.select("tool_id", F.col("path").alias("parent"), F.posexplode(_children()).alias("k", "c"))
        below = parts.select("tool_id", F.concat_ws("/", "parent", F.col("k").cast("string")).alias("path"), "parent", "c.slot", "c.ord", "c.name", "c.optional", "c.indent", "c.schema")
        level = _looked_at(below.select(*_NODE)).persist()
        if level.isEmpty():
            return out
        out.append(level)


def _body() -> Column:
    """The type of the node in row, from its parts (inner), which are in order."""
    here, parts = F.col("indent"), F.col("inner")
    joined = lambda by: F.array_join(F.transform(parts, lambda x: x["text"]), by)
    array = F.when(F.size(parts) == 0, "Array<any>").when(parts[0]["docs"] != "", F.concat(F.lit("Array<\n"), parts[0]["docs"], _pad(here + 1), parts[0]["text"], F.lit("\n"), _pad(here), F.lit(">"))).otherwise(F.concat(F.lit("Array<"), parts[0]["text"], F.lit(">")))
    values = F.from_json(_get("enum"), "array<variant>")
    shown = F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit('"'), F.variant_get(v, "$", "string"), F.lit('"'))).otherwise(spaced_json(F.to_json(v))))
    kinds = F.create_map(*[F.lit(x) for kv in _UNION.items() for x in kv])
    union = F.array_join(F.transform(F.from_json(_get("type"), "array<string>"), lambda t: F.try_element_at(kinds, t)), " | ")
    ref = _get("$ref")
    return (
        F.when(F.col("kind") == "object", F.when(F.size(parts) == 0, "{}").otherwise(F.concat(F.lit("{\n"), joined(",\n"), F.lit("\n"), _pad(here), F.lit("}"))))
        .when(F.col("kind") == "array", array).when(F.col("kind") == "anyOf", joined(" | ")).when(F.col("kind") == "enum", F.array_join(shown, " | ")).when(F.col("kind") == "union", union)
        .when(F.col("kind") == "ref", F.when(ref == "#", "parameters").otherwise(F.substring_index(ref, "/", -1))).when(F.col("kind") == "integer", "number").otherwise(F.col("kind"))
    )


def _as_part() -> Column:
    """How the node in row stands in its parent."""
    default = json_member(F.col("schema"), "default")
    noted = F.when(F.coalesce(default, F.lit("null")) != "null", F.concat(_pad(F.col("indent")), F.lit("// Default: "), spaced_json(default), F.lit("\n"))).otherwise("")
    line = F.concat("docs", noted, _pad(F.col("indent")), F.col("name"), F.when(F.col("optional"), "?").otherwise(""), F.lit(": "), "body")
    others = F.concat(_pad(F.col("indent")), F.lit("[k: string]: "), F.when(F.col("schema") == "true", "any").when(F.col("schema") == "false", "never").otherwise(F.col("body")))
    return F.when(F.col("slot") == "property", line).when(F.col("slot") == "others", others).otherwise(F.col("body"))


def function_types(tools: DataFrame) -> DataFrame:
    """(tool_id, typescript, fault) of tools (tool_id, name, description, parameters): a type of each function, after interfaces of what it names.

    Required properties come first, each kind by name. Definitions are those of the outermost schema; a reference to the
    whole makes an interface of it. Descriptions, bounds and defaults are comments. typescript is null where fault is not:
    invalid schema, unsupported reference, reference not found. Null or empty parameters take nothing.
    """
    levels = schema_nodes(tools)
    made, done = None, []
    for level in reversed(levels):
        if made is None:
            joined = level.withColumn("inner", F.array().cast("array<struct<rank:int,optional:boolean,name:string,ord:int,text:string,docs:string>>"))
        else:
            joined = level.join(made, ["tool_id", "path"], "left").withColumn("inner", F.coalesce("inner", F.array().cast("array<struct<rank:int,optional:boolean,name:string,ord:int,text:string,docs:string>>")))
        built = held(held(joined, docs=_described(F.col("indent"))), body=_body())
        part = F.struct((F.col("slot") == "others").cast("int").alias("rank"), "optional", "name", "ord", _as_part().alias("text"), "docs")
        made = built.where("parent is not null").groupBy("tool_id", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(part)).alias("inner"))
        done.append(built)
    tops = done[-1]
    nodes = reduce(DataFrame.unionByName, [x.select("tool_id", "path", "kind", "members") for x in levels])
    return _declared(tools, tops, _faults(tools, nodes), nodes)


def _faults(tools: DataFrame, nodes: DataFrame) -> DataFrame:
    names = F.map_keys(_members(F.try_element_at(_members(F.col("parameters")), F.lit("$defs"))))
    ref = _get("$ref")
    judged = nodes.join(tools.select("tool_id", names.alias("names")), "tool_id").withColumn("fault", F.when(F.col("kind") == "invalid", "invalid schema").when(F.col("kind") == "ref", F.when(ref == "#", None).when(~ref.startswith(_DEFS), "unsupported reference").when(~F.array_contains("names", F.substring_index(ref, "/", -1)), "reference not found")))
    return judged.groupBy("tool_id").agg(F.min("fault").alias("fault"))


def _declared(tools: DataFrame, tops: DataFrame, faults: DataFrame, nodes: DataFrame) -> DataFrame:
    recursive = nodes.where((F.col("kind") == "ref") & (F.col("members")["$ref"] == "#") & F.col("path").startswith("root")).select("tool_id", F.lit(True).alias("recursive")).distinct()
    in_order = F.array_sort(F.transform(F.filter("inner", lambda x: x["rank"] == 0), lambda x: F.struct(x["ord"].alias("ord"), x["text"].alias("text"))))
    flat = F.array_join(F.transform(in_order, lambda x: x["text"]), ",\n")
    whole = F.concat(F.lit("interface parameters {"), F.when(flat != "", F.concat(F.lit("\n"), flat, F.lit("\n"))).otherwise(""), F.lit("}"))
    root = tops.where("slot = 'root'").select("tool_id", F.col("body").alias("root_body"), whole.alias("whole"))
    said = F.when(F.coalesce(_get("description"), F.lit("")) != "", F.concat(_lines(_get("description"), F.lit(0)), F.lit("\n"))).otherwise("")
    defs = tops.where("slot = 'def'").groupBy("tool_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(said, F.lit("interface "), "name", F.lit(" "), "body").alias("text")))).alias("defs"))
    row = tools.join(root, "tool_id").join(defs, "tool_id", "left").join(recursive, "tool_id", "left").join(faults, "tool_id", "left")
    is_whole = F.coalesce("recursive", F.lit(False))
    interfaces = F.concat(F.when(is_whole, F.array("whole")).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("defs", lambda x: x["text"]), F.array().cast("array<string>")))
    type_ = F.concat(F.lit("type "), F.coalesce("name", F.lit("function")), F.lit(" = (_: "), F.when(is_whole, "parameters").otherwise(F.col("root_body")), F.lit(") => any;"))
    description = F.when(F.coalesce("description", F.lit("")) != "", _lines(F.col("description"), F.lit(0))).otherwise("")
    text = F.array_join(F.filter(F.array(F.array_join(interfaces, "\n"), description, type_), lambda x: x != ""), "\n")
    return row.select("tool_id", F.when(F.col("fault").isNull(), text).alias("typescript"), "fault")


def declared_tools(functions: DataFrame, listed: DataFrame) -> DataFrame:
    """(conv_id, declaration) from function_types() and the tools of each conversation (conv_id, tool_idx, tool_id); a conversation without any that can be declared has no row."""
    rows = listed.join(functions.where("typescript is not null"), "tool_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("tool_idx", "typescript"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: x["typescript"]), "\n")
    return rows.select("conv_id", F.concat(F.lit("# Tools\n\n## functions\nnamespace functions {\n"), body, F.lit("\n}\n")).alias("declaration"))
