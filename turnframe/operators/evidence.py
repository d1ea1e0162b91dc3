"""Packed evidence of sampled tokens: little-endian numbers in binary columns, rows of candidates as slices of flat arrays, and what is wrong with them.

Numbers are read and written by arithmetic on bytes, so that a response of any size stays in columns. The first fault that
applies is given, and evidence with a fault is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.functions import held

# Fixed values of the evidence.
FORMAT = "u32-f32-le-v1"
MISSING = -9999.0
#: What log-probabilities may exceed 0 by, and their probabilities' sum 1.
ABOVE, OFF = 1e-6, 1e-4


def _words(data: Column, first: Column, count: Column) -> Column:
    """Unsigned 32-bit numbers of binary data, from the first (counted in numbers from 0)."""
    byte = lambda at: F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("bigint")

    def word(i: Column) -> Column:
        at = (first + i) * 4 + 1
        return byte(at) + byte(at + 1) * 256 + byte(at + 2) * 65536 + byte(at + 3) * 16777216

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), word)).otherwise(F.array().cast("array<bigint>"))


def read_u32(data: Column) -> Column:
    return _words(data, F.lit(0), F.floor(F.octet_length(data) / 4).cast("int"))


def read_i32(data: Column) -> Column:
    return F.transform(read_u32(data), lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x))


def _single(bits: Column) -> Column:
    """The number of 32 bits, as a double; not a number and the infinities as such."""
    sign = F.when(bits >= 2**31, -1.0).otherwise(1.0)
    exponent, fraction = F.floor(bits / 2**23).cast("int") % 256, bits % 2**23
    finite = F.when(exponent == 0, fraction * F.lit(2.0**-149)).otherwise(F.pow(F.lit(2.0), exponent - 127) * (1 + fraction / 2**23))
    return F.when(exponent < 255, sign * finite).when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def read_f32(data: Column, first: Column | None = None, count: Column | None = None) -> Column:
    n = F.floor(F.octet_length(data) / 4).cast("int")
    return F.transform(_words(data, first if first is not None else F.lit(0), count if count is not None else n), _single)


def _bits(x: Column) -> Column:
    """The 32 bits of a number that single precision holds."""
    x = x.cast("float").cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))).cast("int")
    exponent = F.when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).when(size < F.pow(F.lit(2.0), guess), guess - 1).otherwise(guess)
    normal = (exponent + 127).cast("bigint") * 2**23 + ((size / F.pow(F.lit(2.0), exponent) - 1) * 2**23).cast("bigint")
    bits = F.when(F.isnan(x), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).when(size < F.lit(2.0**-126), (size * F.lit(2.0**126) * 2**23).cast("bigint")).otherwise(normal)
    return F.when((x < 0) & ~F.isnan(x), bits + 2**31).otherwise(bits)


def _packed(words: Column) -> Column:
    """Little-endian bytes of unsigned 32-bit numbers."""
    byte = lambda x, k: F.lpad(F.hex((F.floor(x / 256**k) % 256).cast("bigint")), 2, "0")
    return F.unhex(F.array_join(F.transform(words, lambda x: F.concat(*[byte(x, k) for k in range(4)])), ""))


def write_u32(values: Column) -> Column:
    return _packed(values)


def write_i32(values: Column) -> Column:
    return _packed(F.transform(values, lambda x: F.when(x < 0, x + 2**32).otherwise(x)))


def write_f32(values: Column) -> Column:
    return _packed(F.transform(values, _bits))


def base64_text(data: Column) -> Column:
    """Base64 in one line."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def _first(*faults: tuple[Column, str]) -> Column:
    out = F.when(F.coalesce(faults[0][0], F.lit(True)), faults[0][1])
    for c, name in faults[1:]:
        out = out.when(F.coalesce(c, F.lit(True)), name)
    return out


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)


def decode_compact(responses: DataFrame) -> DataFrame:
    """responses (id, completion_ids, format, data, offsets, num_top) with fault and entries: of each completion token its candidates (token_id, logprob).

    data is base64 of all ids, then all log-probabilities; token i has entries offsets[i] to offsets[i + 1], one at least.
    Faults: format, offsets, candidate_count, base64, length, values (not finite, or above 0).
    """
    raw = held(responses, _raw=F.try_to_binary("data", F.lit("base64")))
    n = F.size("completion_ids")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("offsets") - 1, F.lit(1))), lambda i: (F.size("offsets") < 2) | (F.get("offsets", i) > F.get("offsets", i - 1)))
    count = F.get("offsets", F.size("offsets") - 1).cast("int")
    shape = _first((F.coalesce("format", F.lit("")) != FORMAT, "format"), ((F.size("offsets") != n + 1) | (F.get("offsets", F.lit(0)) != 0) | ~rising, "offsets"), (F.col("num_top") < -1, "candidate_count"), (F.col("_raw").isNull(), "base64"), (F.octet_length("_raw") != count * 8, "length"))
    shaped = held(raw, _shape=shape)
    sound = F.col("_shape").isNull()
    read = held(shaped, _ids=F.when(sound, _words(F.col("_raw"), F.lit(0), count)), _values=F.when(sound, read_f32(F.col("_raw"), count, count)))
    bad = F.exists("_values", lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | (v > ABOVE))
    fault = F.coalesce("_shape", F.when(bad, "values"))
    zipped = F.arrays_zip(F.col("_ids").alias("token_id"), F.col("_values").alias("logprob"))
    entries = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(zipped, F.get("offsets", i - 1).cast("int") + 1, (F.get("offsets", i) - F.get("offsets", i - 1)).cast("int")))).otherwise(F.array().cast("array<array<struct<token_id:bigint,logprob:double>>>"))
    judged = read.withColumn("fault", fault)
    return judged.withColumn("entries", F.when(F.col("fault").isNull(), entries)).drop("_raw", "_shape", "_ids", "_values")


def sampled_logprobs(decoded: DataFrame) -> DataFrame:
    """decode_compact() with logprobs, that of each sampled token. Faults besides: disagree (an id that a row repeats with another value), missing (a row without its sampled token, or with the value that stands for none)."""
    rows = F.arrays_zip(F.col("completion_ids").alias("id"), F.col("entries").alias("row"))
    disagree = F.exists("entries", lambda r: F.exists(r, lambda e: F.exists(r, lambda o: (o["token_id"] == e["token_id"]) & (o["logprob"] != e["logprob"]))))
    own = F.transform(rows, lambda r: F.get(F.filter(r["row"], lambda e: e["token_id"] == r["id"]), F.lit(0))["logprob"])
    found = held(decoded, _own=own)
    fault = F.coalesce("fault", F.when(disagree, "disagree").when(F.exists("_own", lambda v: v.isNull() | (v == MISSING)), "missing"))
    found = found.withColumn("fault", fault)
    return found.withColumn("logprobs", F.when(F.col("fault").isNull(), F.col("_own"))).drop("_own")


def decode_mask(responses: DataFrame) -> DataFrame:
    """responses (id, completion_ids, mask_ids, mask_counts, ...) with mask_fault and support: the ids of which each completion token was sampled.

    mask_ids and mask_counts are struct<data: base64 of int32, shape: array<int>, dtype>. Faults: mask (not so packed, a shape
    that is not its length, or negative), count (rows are not one a token, or don't take all ids), support (an empty row, a
    repeated id, or a row without its token).
    """
    mask, count = F.col("mask_ids"), F.col("mask_counts")
    raw = held(responses, _i=F.try_to_binary(mask["data"], F.lit("base64")), _c=F.try_to_binary(count["data"], F.lit("base64")))
    read = held(raw, _ids=read_i32(F.col("_i")), _counts=read_i32(F.col("_c")))
    wrong = lambda m, b, v: (m["dtype"] != "int32") | F.col(b).isNull() | (F.octet_length(b) % 4 != 0) | (m["shape"] != F.array(F.size(v))) | F.exists(v, lambda x: x < 0)
    n = F.size("completion_ids")
    shape = _first((wrong(mask, "_i", "_ids") | wrong(count, "_c", "_counts"), "mask"), ((F.size("_counts") != n) | (_sum(F.col("_counts")) != F.size("_ids")), "count"))
    ends = F.aggregate("_counts", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.get(a, F.size(a) - 1) + x)))
    shaped = held(read, _shape=shape)
    shaped = held(shaped, _ends=F.when(F.col("_shape").isNull(), ends))
    rows = F.when(F.size("_counts") > 0, F.transform("_counts", lambda c, i: F.slice("_ids", F.get("_ends", i).cast("int") + 1, c.cast("int")))).otherwise(F.array().cast("array<array<bigint>>"))
    shaped = held(shaped, _rows=F.when(F.col("_shape").isNull(), rows))
    unsound = F.exists(F.arrays_zip(F.col("completion_ids").alias("id"), F.col("_rows").alias("row")), lambda r: (F.size(r["row"]) == 0) | (F.size(F.array_distinct(r["row"])) < F.size(r["row"])) | ~F.array_contains(r["row"], r["id"]))
    judged = shaped.withColumn("mask_fault", F.coalesce("_shape", F.when(unsound, "support")))
    return judged.withColumn("support", F.when(F.col("mask_fault").isNull(), F.col("_rows"))).drop("_i", "_c", "_ids", "_counts", "_shape", "_ends", "_rows")


def replayed_support(responses: DataFrame) -> DataFrame:
    """(id, fault, logprobs, entries) of responses with compact evidence and a mask: log-probabilities over exactly the recorded support, which they sum to 1 over.

    Faults besides those of decode_compact() and decode_mask(): cover (candidates are not the mask's), probabilities (a
    missing one), mass.
    """
    both = decode_mask(decode_compact(responses))
    ids = F.transform("entries", lambda r: F.transform(r, lambda e: e["token_id"]))
    mass = F.forall("entries", lambda r: F.abs(F.aggregate(r, F.lit(0.0), lambda a, e: a + F.exp(e["logprob"])) - 1) <= OFF)
    lost = F.exists("entries", lambda r: F.exists(r, lambda e: e["logprob"] == MISSING))
    cover = F.when(F.col("mask_fault").isNull(), ids != F.col("support"))
    fault = F.coalesce("fault", "mask_fault", F.when(cover, "cover").when(lost, "probabilities").when(~mass, "mass"))
    own = F.transform(F.arrays_zip(F.col("completion_ids").alias("id"), F.col("entries").alias("row")), lambda r: F.get(F.filter(r["row"], lambda e: e["token_id"] == r["id"]), F.lit(0))["logprob"])
    judged = both.withColumn("fault", fault)
    sound = F.col("fault").isNull()
    return judged.select("id", "fault", F.when(sound, own).alias("logprobs"), F.when(sound, F.col("entries")).alias("entries"))


def pack_rows(rows: DataFrame) -> DataFrame:
    """(id, ids, counts, logprobs): candidate rows (id, entries) as flat arrays, row i owning counts[i] of them."""
    flat = F.flatten("entries")
    return rows.select("id", F.transform(flat, lambda e: e["token_id"]).alias("ids"), F.transform("entries", lambda r: F.size(r)).alias("counts"), F.transform(flat, lambda e: e["logprob"]).alias("logprobs"))
