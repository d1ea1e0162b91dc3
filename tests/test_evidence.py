"""Packed evidence against struct and numpy, and each fault."""

import base64
import struct

import numpy as np
from pyspark.sql import functions as F

from turnframe.operators import evidence as ev

SCHEMA = "id long, completion_ids array<long>, format string, data string, offsets array<int>, num_top int, mask_ids struct<data:string,shape:array<int>,dtype:string>, mask_counts struct<data:string,shape:array<int>,dtype:string>"


def test_numbers_both_ways(spark):
    rnd = np.random.default_rng(1)
    floats = np.concatenate((rnd.normal(size=300).astype(np.float32) * 10.0 ** rnd.integers(-38, 38, 300), [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 1e-45, -1e-40, 3.4028235e38, 1.1754944e-38, np.inf, -np.inf, -9999.0])).astype(np.float32)
    ints = np.concatenate((rnd.integers(0, 2**32, 200), [0, 1, 255, 256, 2**31, 2**32 - 1])).astype(np.uint32)
    row = spark.createDataFrame([(floats.tobytes(), ints.tobytes(), floats.tolist(), ints.tolist(), ints.view(np.int32).tolist(), b"")], "f binary, u binary, fs array<double>, us array<long>, is array<long>, e binary")
    got = row.select(ev.read_f32(F.col("f")), ev.read_u32(F.col("u")), ev.read_i32(F.col("u")), ev.write_f32(F.col("fs")), ev.write_u32(F.col("us")), ev.write_i32(F.col("is")), ev.read_u32(F.col("e"))).first()
    assert np.array_equal(np.array(got[0], np.float32), floats) and got[1] == ints.tolist() and got[2] == ints.view(np.int32).tolist()
    assert [x for x, y in zip(struct.iter_unpack("<I", bytes(got[3])), struct.iter_unpack("<I", floats.tobytes())) if x != y and y != (0x80000000,)] == []
    assert bytes(got[4]) == bytes(got[5]) == ints.tobytes() and got[6] == []


def b64(values, kind):
    return base64.b64encode(np.array(values, kind).tobytes()).decode()


def response(k, rows, sampled, **changes):
    ids, values = [i for r in rows for i, _ in r], [p for r in rows for _, p in r]
    data = base64.b64encode(np.array(ids, "<u4").tobytes() + np.array(values, "<f4").tobytes()).decode()
    packed = lambda v: (b64(v, "<i4"), [len(v)], "int32")
    out = {"id": k, "completion_ids": sampled, "format": "u32-f32-le-v1", "data": data, "offsets": [0, *np.cumsum([len(r) for r in rows]).tolist()], "num_top": -1, "mask_ids": packed(ids), "mask_counts": packed([len(r) for r in rows])}
    return tuple((out | changes).values())


HALF = float(np.float32(np.log(0.5)))
ROWS = [[(5, HALF), (7, HALF)], [(9, 0.0)]]


def test_faults(spark):
    good = response(0, ROWS, [7, 9])
    cases = {
        "ok": good, "format": response(1, ROWS, [7, 9], format="other"), "offsets": response(2, ROWS, [7, 9], offsets=[0, 2, 2]), "offsets2": response(3, ROWS, [7, 9, 1]), "candidate_count": response(4, ROWS, [7, 9], num_top=-2),
        "base64": response(5, ROWS, [7, 9], data="*"), "length": response(6, ROWS, [7, 9], offsets=[0, 2, 4]), "values": response(7, [[(5, 0.1), (7, HALF)], ROWS[1]], [7, 9]), "nan": response(8, [[(5, float("nan"))], ROWS[1]], [5, 9]),
        "disagree": response(9, [[(7, HALF), (7, -1.0)], ROWS[1]], [7, 9]), "missing": response(10, ROWS, [8, 9]), "sentinel": response(11, [[(7, -9999.0)], ROWS[1]], [7, 9]), "empty": response(12, [], []),
    }
    rows = spark.createDataFrame(list(cases.values()), SCHEMA)
    got = {r["id"]: r for r in ev.sampled_logprobs(ev.decode_compact(rows)).collect()}
    assert [got[k]["fault"] for k in range(13)] == [None, "format", "offsets", "offsets", "candidate_count", "base64", "length", "values", "values", "disagree", "missing", "missing", None]
    assert got[0]["logprobs"] == [HALF, 0.0] and got[12]["logprobs"] == [] and got[9]["logprobs"] is None


def test_support(spark):
    counts = lambda v, **k: (k.get("data", b64(v, "<i4")), k.get("shape", [len(v)]), k.get("dtype", "int32"))
    cases = [
        response(0, ROWS, [7, 9]), response(1, ROWS, [7, 9], mask_ids=counts([5, 7, 8])), response(2, ROWS, [7, 9], mask_ids=counts([5, 7, 9], dtype="int64")), response(3, ROWS, [7, 9], mask_counts=counts([2, 1], shape=[3])),
        response(4, ROWS, [7, 9], mask_counts=counts([2, 2])), response(5, ROWS, [7, 9], mask_ids=counts([7, 7, 9])), response(6, ROWS, [8, 9]), response(7, [[(5, HALF), (7, -9999.0)], ROWS[1]], [7, 9]), response(8, [[(5, HALF), (7, -2.0)], ROWS[1]], [7, 9]),
        response(9, ROWS, [7, 9], mask_ids=counts([7, 5, 9])), response(10, ROWS, [7, 9], mask_ids=counts([5, -7, 9])), response(11, ROWS, [7, 9], mask_ids=None),
    ]
    got = {r["id"]: r for r in ev.replayed_support(spark.createDataFrame(cases, SCHEMA)).collect()}
    assert [got[k]["fault"] for k in range(12)] == [None, "support", "mask", "mask", "count", "support", "support", "probabilities", "mass", "cover", "mask", "mask"]
    assert got[0]["logprobs"] == [HALF, 0.0]
    flat = ev.pack_rows(spark.createDataFrame(cases[:1], SCHEMA).transform(ev.decode_compact)).first()
    assert (flat["ids"], flat["counts"], flat["logprobs"]) == ([5, 7, 9], [2, 1], [HALF, HALF, 0.0])
