"""What the operators of this subpackage share: the shared folder, words, hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset; it gets a new folder then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back. It cuts the lineage there, outlives executors, and later reads take only the columns they need."""
    path = f"{shared_dir(spark)}/turnframe/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def shards_for(docs: DataFrame, column: str, mb: int) -> int:
    """How many shards of about mb MB the whole texts make; at least 1."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // (mb << 20)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_RANDOM = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 16
_UP, _DOWN = _powers(_BASE, _CHUNK + 1), _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, modulo 2**64: with them, spans hash in a few vector steps."""
    out = np.zeros(len(data) + 1, np.uint64)
    scale = np.ones(1, np.uint64)
    for at in range(0, len(data), _CHUNK):
        part = _RANDOM[data[at : at + _CHUNK]] * _UP[: len(data[at : at + _CHUNK])]
        out[at + 1 : at + 1 + len(part)] = out[at] + scale * np.add.accumulate(part)
        scale = scale * _UP[_CHUNK:]
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, wherever it stands."""
    q, r = np.divmod(starts, _CHUNK)
    down = _DOWN[r]
    if len(q) and q.max() > 0:
        down = down * _powers(pow(_BASE, -_CHUNK, 1 << 64), int(q.max()) + 1)[q]
    return (sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order, without a Python object a word."""
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _GAPS[data], [True])).view(np.int8)))
    return mix(span_hashes(byte_sums(data), edges[::2], edges[1::2]))


#: Texts that are hashed at once, about; small enough for a processor's cache.
GROUP_BYTES = 1 << 18


def many_word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, the hashes of all their words, the text of each) for groups of texts (binary, no nulls)."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cuts = (np.flatnonzero(np.diff((ends[1:] - ends[0]) // GROUP_BYTES)) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(texts)]):
        data, at = whole[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        word, edge = ~_GAPS[data], np.zeros(len(data) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))[: len(word)]))
        stops = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False]))[: len(word)])) + 1
        yield lo, hi, mix(span_hashes(byte_sums(data), starts, stops)), lo + np.searchsorted(at, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each width consecutive values of x, by doubling: a power of two values is two halves."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, have, at, out = x, 1, 0, None
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            piece = part[at : at + n]
            out = piece if out is None else mix(out * np.uint64(0xD6E8FEB86659FD93) + piece)
            at += have
        if width >> (bit + 1):
            part = mix(part[:-have] * np.uint64(0xA0761D6478BD642F) + part[have:] + np.uint64(bit + 1))
            have *= 2
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values of x."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def member(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array; the array is not gone through for it."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component), the least node that can be reached.

    Alternating large-star and small-star rounds over DataFrames: each round is two grouped minima and joins, so a star
    with very many leaves is pre-aggregated and no neighbourhood is ever collected. Each round is written to the shared
    folder. Nulls are ignored, repeated and self edges are harmless, and no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(spark, e, "cc")
    before = None
    while True:
        # large star: each node's greater neighbours go to its least neighbour (itself included)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node's smaller neighbours and itself go to its least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = materialize(spark, small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if now == before or now[0] == now[2] and _flat(e):
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _flat(e: DataFrame) -> bool:
    """Whether no node's target points on: every component is a star then."""
    return e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()


TABLES = "turnframe_"


def drop_tables(spark: SparkSession) -> None:
    """Drop what bucketed() has left in the current database, files included. To be called when no result is read any more."""
    for t in spark.catalog.listTables():
        if t.name.startswith(TABLES):
            path = spark.sql(f"DESCRIBE FORMATTED {t.name}").where("col_name = 'Location'").first()["data_type"]
            spark.sql(f"DROP TABLE {t.name}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(spark: SparkSession, df: DataFrame, column: str, count: int, tag: str, move: bool = True, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, bucketed by column: grouping by it later moves no row of it again. drop_tables() removes it.

    Without move, each task writes the buckets of what it has; that is for few large rows, or rows that are placed already.
    """
    name = f"{TABLES}{tag}_{uuid.uuid4().hex}"
    (df.repartition(count, column) if move else df).write.format("parquet").option("compression", codec).bucketBy(count, column).option("path", f"{shared_dir(spark)}/turnframe/{name}").saveAsTable(name)
    return spark.table(name)
