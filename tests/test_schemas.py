"""Type declarations on literal schemas, and against a plain recursion on drawn ones."""

import json
import random

from turnframe.operators import schemas

SCHEMA = "tool_id long, name string, description string, parameters string"


def declared(spark, *tools):
    rows = [(k, f"f{k}", None, json.dumps(t) if isinstance(t, dict) else t) for k, t in enumerate(tools)]
    return {r["tool_id"]: (r["typescript"], r["fault"]) for r in schemas.function_types(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_literal_declarations(spark):
    obj = lambda required=(), **p: {"type": "object", "properties": p, "required": list(required)}
    got = declared(
        spark, None, {}, obj(["b"], a={"type": "integer", "description": "How\n\nmany", "minimum": 1, "maximum": 9.5, "default": 3}, b={"type": "string", "pattern": "^x", "default": "a, b"}, c={}),
        obj(x={"anyOf": [{"type": "string"}, {"type": "null"}, {"type": "array", "items": {"type": "number"}}]}, y={"enum": ["a", 1, None, "1"]}, z={"type": ["integer", "null", "array"]}),
        obj(o=obj(["n"], n={"type": "array", "minItems": 1, "items": {"type": "string", "description": "each"}}), m={"type": "object", "additionalProperties": {"type": "boolean"}}, k={"type": "object", "additionalProperties": False}),
        {**obj(left={"$ref": "#"}, node={"$ref": "#/$defs/Node"}), "$defs": {"Node": {**obj(next={"$ref": "#/$defs/Node"}), "description": "A node"}, "Id": {"type": "string"}}},
        obj(x={"$ref": "#/$defs/Lost"}), obj(x={"$ref": "other.json"}), obj(x={"nothing": 1}), obj(a=True, b=False, c={"type": "array"}),
    )
    assert got[0] == got[1][:0] + ("type f0 = (_: {}) => any;", None) and got[1] == ("type f1 = (_: {}) => any;", None)
    assert got[2][0] == 'type f2 = (_: {\n  // pattern: ^x\n  // Default: "a, b"\n  b: string,\n  // How\n\n  // many\n  // maximum: 9.5, minimum: 1\n  // Default: 3\n  a?: number,\n  c?: any\n}) => any;'
    assert got[3][0] == 'type f3 = (_: {\n  x?: string | null | Array<number>,\n  y?: "a" | 1 | null | "1",\n  z?: number | null | Array<any>\n}) => any;'
    assert got[4][0] == "type f4 = (_: {\n  k?: {\n    [k: string]: never\n  },\n  m?: {\n    [k: string]: boolean\n  },\n  o?: {\n    // minItems: 1\n    n: Array<\n      // each\n      string\n    >\n  }\n}) => any;"
    assert got[5][0] == "interface parameters {\n  left?: parameters,\n  node?: Node\n}\n// A node\ninterface Node {\n  next?: Node\n}\ninterface Id string\ntype f5 = (_: parameters) => any;"
    assert [got[k] for k in (6, 7, 8)] == [(None, "reference not found"), (None, "unsupported reference"), (None, "invalid schema")]
    assert got[9][0] == "type f9 = (_: {\n  a?: any,\n  b?: null,\n  c?: Array<any>\n}) => any;"


def test_descriptions_and_lists(spark):
    tools = spark.createDataFrame([(1, "f", "Does\nit", None), (2, "g", "", '{"properties": {"x": {"bad": 1}}}'), (3, "h", None, "{}")], SCHEMA)
    listed = spark.createDataFrame([(7, 0, 3), (7, 1, 1), (8, 0, 2)], "conv_id long, tool_idx int, tool_id long")
    got = schemas.declared_tools(schemas.function_types(tools), listed).collect()
    assert [tuple(r) for r in got] == [(7, "# Tools\n\n## functions\nnamespace functions {\ntype h = (_: {}) => any;\n// Does\n// it\ntype f = (_: {}) => any;\n}\n")]
    assert schemas.function_types(tools.limit(0)).collect() == []


def drawn(rnd, depth):
    kind = rnd.choice(["string", "integer", "boolean", "enum", "ref", "union"] + ["object", "array", "anyOf"] * (depth > 0) * 2)
    said = {"description": rnd.choice(["one", "two\nlines"])} if rnd.random() < 0.4 else {}
    if kind == "object":
        names = rnd.sample(["b", "A", "c_d", "é", "z"], rnd.randint(0, 4))
        return said | {"type": "object", "properties": {k: drawn(rnd, depth - 1) for k in names}, "required": names[:1]} | ({"additionalProperties": rnd.choice([True, False, drawn(rnd, depth - 1)])} if rnd.random() < 0.3 else {})
    if kind == "array":
        return said | {"type": "array", "items": drawn(rnd, depth - 1)}
    if kind == "anyOf":
        return said | {"anyOf": [drawn(rnd, depth - 1) for _ in range(rnd.randint(1, 3))]}
    return said | {"enum": {"enum": ["x", 2]}, "ref": {"$ref": "#/$defs/D"}, "union": {"type": ["string", "null"]}, "string": {"type": "string", "maxLength": 5}}.get(kind, {"type": kind})


def docs(s, pad):
    if not isinstance(s, dict):
        return ""
    out = "".join(f"{pad}// {x}\n" for x in s.get("description", "").split("\n") if s.get("description"))
    return out + (f"{pad}// maxLength: 5\n" if "maxLength" in s else "")


def shown(s, pad=""):
    if "$ref" in s:
        return "D"
    if "anyOf" in s:
        return " | ".join(shown(x, pad) for x in s["anyOf"])
    if "enum" in s:
        return '"x" | 2'
    if isinstance(s["type"], list):
        return "string | null"
    if s["type"] == "array":
        inner = docs(s["items"], pad + "  ")
        return f"Array<\n{inner}{pad}  {shown(s['items'], pad + '  ')}\n{pad}>" if inner else f"Array<{shown(s['items'], pad)}>"
    if s["type"] != "object":
        return {"integer": "number"}.get(s["type"], s["type"])
    lines = []
    for k in sorted(s["properties"], key=lambda k: (k not in s["required"], k)):
        p = s["properties"][k]
        lines.append(docs(p, pad + "  ") + f"{pad}  {k}{'' if k in s['required'] else '?'}: {shown(p, pad + '  ')}")
    more = s.get("additionalProperties")
    if more is not None:
        lines.append(f"{pad}  [k: string]: " + ({True: "any", False: "never"}[more] if isinstance(more, bool) else shown(more, pad + "  ")))
    return "{\n" + ",\n".join(lines) + f"\n{pad}}}" if lines else "{}"


def test_drawn_schemas(spark):
    rnd = random.Random(9)
    tools = []
    for _ in range(60):
        names = ["q", "B", "a"]
        tools.append({"type": "object", "properties": {k: drawn(rnd, 4) for k in names}, "required": ["a"], "$defs": {"D": drawn(rnd, 2) | {}}})
    got = declared(spark, *tools)
    for k, t in enumerate(tools):
        d = t["$defs"]["D"]
        head = "".join(f"// {x}\n" for x in d.get("description", "").split("\n") if d.get("description"))
        assert got[k] == (f"{head}interface D {shown(d)}\ntype f{k} = (_: {shown(t)}) => any;", None)
