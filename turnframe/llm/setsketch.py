"""MinHash near-duplicates with SetSketch registers.

A register holds the least of exponential values that a text's distinct shingles draw, truncated to a power of BASE: so
registers of two sets merge by their maximum, and agree about as often as the sets do. Texts meet under bands of register
values. Of two texts that meet, the registers that are equal, greater and less give, with the known set sizes, the
likelihood of each similarity; pairs for which LINK is too unlikely are left, all others are verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.common import connected_components, materialize, mix
from turnframe.llm.simhash import shingle_sets

SHINGLE = 5
#: Documents are linked from this similarity on, in hundredths.
LINK = 85
#: Two texts at LINK miss each other under all bands with a probability of (1 - 0.85**ROWS)**BANDS, 6e-9.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Registers are floor(1 - log(x) / log(BASE)) of the least x, of exponential values of rate RATE.
BASE, RATE = 1.001, 20.0
#: A pair is left if its greatest log likelihood exceeds the one at LINK by this: six standard deviations.
UNLIKELY = 18.0
#: A band's texts are compared in cells of about this many, and this many pairs at a time.
CELL = 1024
PAIRS = 20_000

_FACTORS = np.array([xxhash.xxh64_intdigest(j.to_bytes(2), 11) | 1 for j in range(REGISTERS)], np.uint64)
_SIGNED = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("registers", pa.binary())])
_SIGNED_SQL = "doc_id long, s1 long, s2 long, n long, registers binary"


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of registers of each run of distinct shingle hashes."""
    most = np.empty((REGISTERS, len(first)), np.uint64)
    product = np.empty_like(hashes)
    for j, factor in enumerate(_FACTORS):
        np.multiply(hashes, factor, out=product)
        np.maximum.reduceat(product, first, out=most[j])
    # the greatest uniform value is the least exponential one; what it lacks to 1 is exact in integers
    lacks = (~most).astype(np.float64) + 1
    x = -np.log1p(-lacks / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16).T


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text two sums that stand for its set of shingles, the set's size, and its registers."""
    for b in it:
        ids, texts = b.column(0), pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary())
        for lo, hi, h, of in shingle_sets(texts, SHINGLE):
            n = np.bincount(of - lo, minlength=hi - lo)
            has, first = np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]
            s1, s2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            rows: list[bytes | None] = [None] * (hi - lo)
            if len(h):
                scattered = mix(h)
                s1[has], s2[has] = np.add.reduceat(scattered, first), np.bitwise_xor.reduceat(mix(scattered), first)
                for k, r in zip(has.tolist(), np.ascontiguousarray(registers(scattered, first))):
                    rows[k] = r.tobytes()
            columns = (ids.slice(lo, hi - lo), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(n, pa.int64()), pa.array(rows, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), schema=_SIGNED)


def _matrix(column: pa.Array) -> np.ndarray:
    """Registers of a binary column without nulls, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(rows: np.ndarray) -> np.ndarray:
    """The keys of each row of registers, one a band."""
    value = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), BANDS))
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + value[:, :, k])
    return key.view(np.int64)


def _banded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            keys = bands(_matrix(part.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pc.take(part.column(c), pa.array(np.repeat(np.arange(len(keys)), BANDS))) for c in (0, 1))], names=["key", "id", "n"])


def _log_likelihood(s: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of similarity s, for relative sizes u and v (of sum 1): more registers are greater in the first set, less in the second."""
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    # for a BASE near 1, a register is greater in the first set about as often as u - v * s
    x, y = p(u - v * s), p(v - u * s)
    return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))


def plausible(n1: np.ndarray, n2: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether a pair may have a similarity of LINK: its likelihood there is not hopeless against the greatest one, searched for by thirds."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    link, top = np.full(len(u), LINK / 100), np.minimum(u, v) / np.maximum(u, v)
    possible = top * 100 >= LINK - 1e-6
    lo, hi = np.zeros(len(u)), top
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = _log_likelihood(a, u, v, more, less, same) < _log_likelihood(b, u, v, more, less, same)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    best = (lo + hi) / 2
    gap = _log_likelihood(best, u, v, more, less, same) - _log_likelihood(np.minimum(link, top), u, v, more, less, same)
    return possible & ((best >= link) | (gap <= UNLIKELY))


def _estimate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, n of b, x, y, m) -> (a, b, same, m) of the pairs that may be links."""
    for batch in it:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            x, y = _matrix(b.column(4)), _matrix(b.column(5))
            same, more = (x == y).sum(1), (x > y).sum(1)
            keep = plausible(b.column(2).to_numpy(), b.column(3).to_numpy(), more, REGISTERS - same - more, same)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64()), b.column(6)], names=["a", "b", "same", "m"]).filter(pa.array(keep))


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo, hi, h, of in shingle_sets(pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary()), SHINGLE):
            ends = np.searchsorted(of, np.arange(lo, hi + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())], names=["id", "shingles"])


def _linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose whole sets are similar enough."""
    for b in it:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= LINK * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingles(spark: SparkSession, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles): the full sets of the documents wanted (id)."""
    return materialize(spark, texts.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "sets")


def _verify(spark: SparkSession, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids that are links by their full sets."""
    sets = _shingles(spark, texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return materialize(spark, met.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long").distinct(), "links")


def _candidates(x: np.ndarray, y: np.ndarray, one: bool, comp: np.ndarray, n: np.ndarray, keys: np.ndarray, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs of a cell, many at a time: of different components, of sizes that can be a link, and met first under this band."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for at, i in enumerate(x.tolist()):
        j = y[at + 1 :] if one else y
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= LINK * np.maximum(n[j], n[i]))]
        j = j[keys[i][(keys[j] == keys[i]).argmax(1)] == key]
        if len(j):
            held.append((np.full(len(j), i), j))
            size += len(j)
        if size >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def compare_cell(table: pa.Table, left: int, right: int, key: int) -> pa.Table:
    """(a, b) links between texts of one cell, of all its texts where its two blocks are one: a forest that joins whatever they join.

    Pairs that the registers leave plausible are verified, the most alike first, unless links found before join their components.
    """
    block, ids, comp, n = (table.column(c).to_numpy() for c in ("block", "id", "component", "n"))
    rows, sets = _matrix(table.column("registers")), table.column("shingles")
    keys, x, y = bands(rows), np.flatnonzero(block == left), np.flatnonzero(block == right)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    opened: dict[int, np.ndarray] = {}

    def whole(k: int) -> np.ndarray:
        if k not in opened:
            opened[k] = np.frombuffer(sets[k].as_py(), np.uint64)
        return opened[k]

    out = []
    for i, j in _candidates(x, y, left == right, comp, n, keys, key):
        same, more = (rows[i] == rows[j]).sum(1), (rows[i] > rows[j]).sum(1)
        keep = np.flatnonzero(plausible(n[i], n[j], more, REGISTERS - same - more, same))
        for k in keep[np.argsort(-same[keep], kind="stable")].tolist():
            p, q = root(int(comp[i[k]])), root(int(comp[j[k]]))
            if p != q:
                s, t = whole(int(i[k])), whole(int(j[k]))
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= LINK * (len(s) + len(t) - both):
                    parent[max(p, q)] = min(p, q)
                    out.append((int(ids[i[k]]), int(ids[j[k]])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _compare_cells(key: tuple, table: pa.Table) -> pa.Table:
    return compare_cell(table, key[1].as_py(), key[2].as_py(), key[0].as_py())


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by their sets of five-word shingles at a similarity of 0.85 or more.

    Equal sets are one from the start. Under each band a text is first compared with the least id there, so that large
    groups of copies become one component with a pair a text. Where a band's texts are still of several components, all
    pairs between these are judged, in cells that bring the sets along; what a cell gives is links that join components.
    A pair at LINK that meets under no band is missed, with a probability of 6e-9.

    A null, empty or wordless text has no shingles and is linked with nothing; a text of fewer than five words has one
    shingle, all its words. A row without doc_id links nothing, has a null component and is not kept. Rows that repeat a
    doc_id are one document: the links of each of their texts count. Texts of any length are taken whole. Other columns
    are ignored. No rows give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(spark, texts.mapInArrow(_sign, _SIGNED_SQL), "sketches")
    texts, alike = texts.where("doc_id is not null"), ["s1", "s2", "n"]
    reps = materialize(spark, signed.where("n > 0 and doc_id is not null").groupBy(*alike).agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers")), "sketch-reps")
    # rows that repeat a doc_id and whose sets stand under other ids
    repeated = signed.where("n > 0").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id")
    edges = signed.where("n > 0").join(repeated, "doc_id", "left_semi").join(reps.select(*alike, "id"), alike).where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    met = reps.select("id", "n", "registers").mapInArrow(_banded, "key long, id long, n long")
    firsts = met.groupBy("key").agg(F.min(F.struct("id", "n")).alias("f"), F.count("*").alias("m")).where("m > 1")
    stars = materialize(spark, met.join(firsts, "key").where("id <> f.id").select("key", "m", F.col("f.id").alias("a"), F.col("id").alias("b"), F.col("f.n").alias("n"), F.col("n").alias("m_b")), "stars")
    side = lambda c, r: reps.select(F.col("id").alias(c), F.col("registers").alias(r))
    sized = stars.where(100 * F.least("n", "m_b") >= LINK * F.greatest("n", "m_b")).groupBy("a", "b", "n", "m_b").agg(F.max("m").alias("m"))
    likely = sized.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "n", "m_b", "x", "y", "m")
    likely = materialize(spark, likely.mapInArrow(_estimate, "a long, b long, same long, m long"), "likely")
    chosen = likely.groupBy("b").agg(F.max(F.struct("same", F.negative("a").alias("less"))).alias("best")).select(F.negative("best.less").alias("a"), "b")
    chosen = materialize(spark, chosen, "chosen")
    edges = materialize(spark, _verify(spark, texts, chosen).union(edges), "edges")
    groups = materialize(spark, connected_components(spark, edges), "groups")
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    placed = lambda df, c: df.join(of(c), c, "left").withColumn(f"{c}_component", F.coalesce(f"{c}_component", c))
    apart = lambda df: placed(placed(df, "a"), "b").where("a_component <> b_component")
    # of a band with two texts, the star was the only pair; others are gone through
    rest = apart(likely.where("m = 2")).select("a", "b").join(chosen, ["a", "b"], "left_anti")
    found = [_verify(spark, texts, materialize(spark, rest, "rest"))]
    mixed = apart(stars.where("m > 2")).select("key").distinct()
    members = stars.join(mixed, "key", "left_semi").select("key", "m", F.explode(F.array("a", "b")).alias("id")).distinct()
    members = materialize(spark, members, "members")
    whole = placed(_shingles(spark, texts, members.select("id").distinct()), "id").join(reps.select("id", "n", "registers"), "id")
    dealt = members.join(whole, "id").select("key", "id", "n", "registers", "shingles", F.col("id_component").alias("component"), F.ceil(F.col("m") / CELL).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = dealt.withColumn("other", other).select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id", "n", "component", "registers", "shingles")
    found.append(cells.groupBy("key", "left", "right").applyInArrow(_compare_cells, "a long, b long"))
    edges = materialize(spark, edges.union(found[0]).union(found[1]), "edges")
    groups = connected_components(spark, edges)
    named = reps.join(groups.withColumnRenamed("node", "id"), "id", "left").select(*alike, F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", *alike).join(named, alike, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNotNull() & (component == F.col("doc_id"))).alias("kept"))
