"""Exact removal of repeated 200-byte strings by difference-cover suffix sorting.

A 200-byte string is 25 characters of 8 bytes. Of each segment of text, the positions whose index modulo 3 is 1 or 2 (the
difference cover) are sampled. Sampled triples of characters are sorted and named in order, triples of those names are
sorted and named again (9 characters), and a name that occurs once ends the matter for its suffix. The remaining suffixes
are merged in: any two positions have a shift of 0, 1 or 2 characters that brings both onto samples, so each position is
sorted by its few first characters and the names from there, exactly 25 characters in all, and neighbours are compared.

Only segments that can differ from one another and still share a string are sorted: of each window of 200 bytes, the least
hash of its 64-byte grams is its anchor, and equal windows have equal anchors. Consecutive windows of one anchor are a
segment, so equal passages are cut alike. Of equal segments all windows recur, whatever else there is; a segment whose anchor
no other segment has is left out; of the others, one of each distinct kind is sorted. Suffixes are dealt to cells by their
anchors and each cell is sorted by itself; anchors with more segments than a cell may hold are sorted over all partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.llm.common import bucketed, byte_sums, materialize, member, mix, runs, shards_for, sliding_min, span_hashes

WINDOW = 200
GRAM = 64
CHARACTER = 8
SHARD_MB = 8
#: A run of windows of one anchor (text of a short period) is cut at so many bytes.
MOST_SEGMENT = 1 << 16
#: Bytes of segments that one task sorts or names at once, about; an anchor with more of them than MOST_BYTES is sorted over all partitions.
CELL_BYTES = MOST_BYTES = 2 << 20


def _to_shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their shard, a new one after every SHARD_MB of text, and their places in it. No row leaves its task."""
    from pyspark import TaskContext

    shard, row, size = TaskContext.get().partitionId() << 32, 0, 0
    for b in it:
        lengths, shards, rows = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist(), [], []
        for n in lengths:
            if size + n > SHARD_MB << 20 and row:
                shard, row, size = shard + 1, 0, 0
            shards.append(shard)
            rows.append(row)
            row, size = row + 1, size + n
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(rows, pa.int64()), *b.columns], names=["shard", "row", "doc_id", "text"])


def _segments_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of a text: first window, last window + 1, anchor, and whether the text holds that anchor twice."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(span_hashes(byte_sums(data), at, at + GRAM))
    width = WINDOW - GRAM + 1
    least = sliding_min(grams, width)
    edge = np.zeros(width - 1, np.uint64)
    reach = ~sliding_min(~np.concatenate((edge, least, edge)), width)  # the greatest least of the windows over each gram
    places = np.sort(grams[grams == reach])
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends, most = np.append(starts[1:], len(least)), MOST_SEGMENT - WINDOW
    if (ends - starts).max() > most:
        starts = np.concatenate([np.arange(a, b, most) for a, b in zip(starts, ends)])
        ends = np.append(starts[1:], len(least))
    return starts, ends, least[starts].view(np.int64), member(places[1:][places[1:] == places[:-1]], least[starts])


def _key(part: bytes) -> int:
    return xxhash.xxh64_intdigest(part, 7) - (1 << 63)


_KINDS = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("twice", pa.bool_())])
_KINDS_SQL = "anchor long, key long, shard long, n long, size long, twice boolean"


def _kinds(table: pa.Table) -> pa.Table:
    """The distinct segments of a shard, by anchor and a hash of their bytes, and how often each is there."""
    found = []
    for text in table.column("text"):
        t = text.as_py() or b""
        starts, ends, anchors, twice = _segments_of(t)
        keys = np.array([_key(t[a : b + WINDOW - 1]) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        found.append(np.stack((anchors, keys, ends - starts + WINDOW - 1, twice)))
    anchor, key, size, twice = np.concatenate(found, axis=1)
    order = np.lexsort((key, anchor))
    anchor, key, size, twice = anchor[order], key[order], size[order], twice[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]))))
    columns = (anchor[first], key[first], np.full(len(first), table.column("shard")[0].as_py()), np.diff(np.append(first, len(key))), size[first], np.logical_or.reduceat(twice != 0, first) if len(first) else twice != 0)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KINDS)], schema=_KINDS)


def _judged(kinds: DataFrame) -> DataFrame:
    """(shard, anchor, key, covered, sent, single, heavy): segments with copies are covered; where an anchor has segments of
    several kinds (or stands twice in its one segment), and one of them without a copy, one of each kind is to be sorted."""
    kind, anchor = Window.partitionBy("anchor", "key"), Window.partitionBy("anchor")
    met = kinds.repartition("anchor").withColumns({"copies": F.sum("n").over(kind), "holder": F.min("shard").over(kind)})
    met = met.withColumns({"single": F.col("copies") == 1, "covered": F.col("copies") > 1, "held": F.col("shard") == F.col("holder")})
    several = (F.min("key").over(anchor) < F.max("key").over(anchor)) | F.max("twice").over(anchor)
    met = met.withColumns({"sorted": several & F.max("single").over(anchor), "total": F.sum(F.when(F.col("held"), F.col("size"))).over(anchor)})
    met = met.withColumn("sent", F.col("sorted") & F.col("held")).where("covered or sent")
    return met.select("shard", "anchor", "key", "covered", "sent", (F.col("total") > MOST_BYTES).alias("heavy"))


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("shard", pa.int64()), ("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("single", pa.bool_()), ("heavy", pa.bool_()), ("bytes", pa.binary())])
_SEGMENTS_SQL = "anchor long, shard long, row long, a long, b long, single boolean, heavy boolean, bytes binary"


def _segments(table: pa.Table, side: pa.Table) -> pa.Table:
    """The spans of bytes that are covered (without bytes), and the segments to be sorted, each once."""
    if not table.num_rows or not side.num_rows:
        return _SEGMENTS.empty_table()
    shard, out, seen = table.column("shard")[0].as_py(), [], set()
    judged = {(a, k): f for a, k, *f in zip(*(side.column(c).to_pylist() for c in ("anchor", "key", "covered", "sent", "heavy")))}
    known = np.unique(side.column("anchor").to_numpy())
    for row, text in zip(table.column("row").to_pylist(), table.column("text")):
        t = text.as_py() or b""
        starts, ends, anchors, _ = _segments_of(t)
        use, spans = member(known, anchors), []
        for a, b, anchor in zip(starts[use].tolist(), (ends[use] + WINDOW - 1).tolist(), anchors[use].tolist()):
            kind = anchor, _key(t[a:b])
            covered, sent, heavy = judged.get(kind, (False, False, False))
            if covered and spans and a <= spans[-1][1]:
                spans[-1][1] = b
            elif covered:
                spans.append([a, b])
            if sent and kind not in seen:
                seen.add(kind)
                out.append((anchor, shard, row, a, b, not covered, heavy, t[a:b]))
        out += [(None, shard, row, a, b, False, False, None) for a, b in spans]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENTS)], schema=_SEGMENTS) if out else _SEGMENTS.empty_table()


class Shard:
    """The segments of one cell as one array, with what the levels read at each position (-1: no name, or past the end)."""

    def __init__(self, table: pa.Table):
        self.table = table = table.sort_by("seg")
        texts = table.column("bytes").to_pylist()
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.segs = table.column("seg").to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        self.at = (np.arange(self.sizes.sum()) - np.repeat(self.first, self.sizes)).astype(np.int32)
        self.room = np.repeat(self.sizes.astype(np.int32), self.sizes) - self.at
        self.seg = np.repeat(self.segs, self.sizes)
        self.sampled = self.at // CHARACTER % 3 != 0
        data = np.frombuffer(b"".join(texts) + bytes(CHARACTER), np.uint8)
        self.character = np.ndarray(len(self.at), ">u8", data, 0, (1,)).astype(np.uint64).view(np.int64)

    def names(self, side: pa.Table) -> np.ndarray:
        out = np.full(len(self.at), -1, np.int64)
        if side.num_rows:
            k = np.searchsorted(self.segs, side.column("seg").to_numpy())
            out[self.first[k] + side.column("place").to_numpy()] = side.column("name").to_numpy()
        return out


def _rows(shard: Shard, at: np.ndarray, keys: list[np.ndarray], shift: int = 0) -> pa.Table:
    return pa.table({"seg": shard.seg[at], "place": shard.at[at].astype(np.int32), "shift": np.full(len(at), shift, np.int32), **{f"k{i}": k for i, k in enumerate(keys)}})


def _triples(s: Shard) -> pa.Table:
    at = np.flatnonzero(s.sampled & (s.room >= 3 * CHARACTER))
    return _rows(s, at, [s.character[at + CHARACTER * i] for i in range(3)])


def _name_triples(s: Shard, side: pa.Table) -> pa.Table:
    a = s.names(side)
    at = np.flatnonzero(s.sampled & (s.room >= 9 * CHARACTER))
    keys = [a[at + 3 * CHARACTER * i] for i in range(3)]
    use = np.logical_and.reduce([k >= 0 for k in keys])
    return _rows(s, at[use], [k[use] for k in keys])


def _merged(s: Shard, level1: pa.Table, level2: pa.Table) -> pa.Table:
    """Each position by 25 characters, once for each shift that brings it onto a sample."""
    a, b = s.names(level1), s.names(level2)
    starts, out = np.flatnonzero(s.room >= WINDOW), []
    for shift, parts in ((0, "bbaac"), (1, "cbbaa"), (2, "ccbbacc")):
        at = starts[s.sampled[np.minimum(starts + CHARACTER * shift, len(s.at) - 1)]]
        keys, q, use = [], at, np.ones(len(at), bool)
        for part in parts:
            k = {"a": a, "b": b, "c": s.character}[part][q]
            if part != "c":
                use &= k >= 0
            keys.append(k)
            q = q + CHARACTER * {"a": 3, "b": 9, "c": 1}[part]
            q = np.minimum(q, len(s.at) - 1)
        keys += [np.zeros(len(at), np.int64)] * (7 - len(keys))
        out.append(_rows(s, at[use], [k[use] for k in keys], shift))
    return pa.concat_tables(out)


def _schema(n: int) -> pa.Schema:
    return pa.schema([("seg", pa.int64()), ("place", pa.int32()), ("shift", pa.int32()), *[(f"k{i}", pa.int64()) for i in range(n)]])


def _sql(n: int) -> str:
    return "seg long, place int, shift int, " + ", ".join(f"k{i} long" for i in range(n))


def _by_level(table: pa.Table, side: pa.Table) -> pa.Table:
    level = side.column("level").to_numpy() if side.num_rows else np.zeros(0)
    return _merged(Shard(table), *(side.filter(pa.array(level == k)) for k in (1, 2)))


def _in_pieces(step, n: int):
    """A step over segments and the names of one piece; names without segments give nothing."""
    return lambda table, side: step(table, side) if table.num_rows else _schema(n).empty_table()


def _ranked_here(rows: pa.Table, n: int) -> pa.Table:
    """What _ranked gives, of the rows of one cell."""
    keys = [rows.column(c).to_numpy() for c in ("shift", *[f"k{i}" for i in range(n)])]
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(order) else same
    named = np.cumsum(np.concatenate(([0], ~same)))[: len(order)]
    use = order[shared]
    return pa.table({"seg": rows.column("seg").to_numpy()[use], "place": rows.column("place").to_numpy()[use], "name": named[shared]})


def _sorted_cell(table: pa.Table) -> pa.Table:
    """The covered bytes of the segments of one cell, all steps in one."""
    s = Shard(table.append_column("seg", pa.array(np.arange(table.num_rows))))
    level1 = _ranked_here(_triples(s), 3)
    level2 = _ranked_here(_name_triples(s, level1), 3)
    return _covered(s, _ranked_here(_merged(s, level1, level2), 7))


def _ranked(rows: DataFrame, n: int, partitions: int) -> DataFrame:
    """(seg, place, name) of the rows whose key another row shares: rows sorted by key over all partitions, names in that order."""
    keys = ["shift", *[f"k{i}" for i in range(n)]]
    ordered = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)

    def name(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, base = 0, TaskContext.get().partitionId() << 40
        last, last_at, last_named = None, None, False
        for b in it:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in keys])
            at = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("seg", "place")])
            if last is not None:  # the row before the batch, so that neighbours meet
                k, at = np.concatenate((last, k), axis=1), np.concatenate((last_at, at), axis=1)
            same = (k[:, 1:] == k[:, :-1]).all(axis=0)
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            named = base + count + np.concatenate(([0], np.cumsum(~same)))
            count += int((~same).sum())
            emit = shared.copy()
            if last is not None and last_named:
                emit[0] = False  # it has been given out already
            yield pa.RecordBatch.from_arrays([pa.array(at[0][emit]), pa.array(at[1][emit].astype(np.int32)), pa.array(named[emit])], names=["seg", "place", "name"])
            last_named = bool(shared[-1])
            last, last_at = k[:, -1:], at[:, -1:]

    return ordered.mapInArrow(name, "seg long, place int, name long")


_COVERED = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_COVERED_SQL = "shard long, row long, a long, b long"


def _covered(s: Shard, side: pa.Table) -> pa.Table:
    """The bytes of the segments without copies under windows that stand elsewhere as well."""
    out, flags = [], s.names(side) >= 0
    for k, (shard, row, start, single) in enumerate(zip(*(s.table.column(c).to_pylist() for c in ("shard", "row", "a", "single")))):
        if single:
            out += [(shard, row, start + a, start + b + WINDOW - 1) for a, b in runs(flags[s.first[k] : s.first[k] + s.sizes[k]]).tolist()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _COVERED)], schema=_COVERED) if out else _COVERED.empty_table()


def _cut(table: pa.Table, side: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _RESULT.empty_table()
    spans: dict[int, list] = {}
    if side.num_rows:
        for r, a, b in zip(*(side.column(c).to_pylist() for c in ("row", "a", "b"))):
            spans.setdefault(r, []).append((a, b))
    out = []
    for doc, row, text in zip(table.column("doc_id"), table.column("row"), table.column("text")):
        t = text.as_py() or b""
        gone = np.zeros(len(t), bool)
        for a, b in spans.get(row.as_py(), ()):
            gone[a:b] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc.as_py(), len(t), int(gone.sum()), len(runs(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of every row.

    A byte goes if a 200-byte string over it starts anywhere else as well, in the same row too. A null text is empty; a null
    doc_id is carried along; a repeated row is a second copy, so both lose all strings of 200 bytes; a very long text is one
    row of one shard, whatever its size; other columns of docs are left out, whatever their names; no rows give no rows.
    """
    shards = shards_for(docs, "text", SHARD_MB)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    table = bucketed(spark, texts.mapInArrow(_to_shards, "shard long, row long, doc_id long, text binary"), "shard", shards, "suffixes", move=False, codec="zstd")
    texts = table.select("shard", "row", "text").groupBy("shard")
    judged = _judged(texts.applyInArrow(_kinds, _KINDS_SQL))
    found = materialize(spark, texts.cogroup(judged.groupBy("shard")).applyInArrow(_segments, _SEGMENTS_SQL), "segments", codec="zstd")
    heavy, light = (found.where(F.col("bytes").isNotNull() & (F.col("heavy") == h)) for h in (True, False))
    sizes = {h: n or 0 for h, n in found.where("bytes is not null").groupBy("heavy").agg(F.sum(F.col("b") - F.col("a"))).collect()}
    cells = max(1, -(-sizes.get(False, 0) // CELL_BYTES))
    cell = F.pmod(F.xxhash64("anchor"), F.lit(cells)).alias("cell")
    spans = found.where("bytes is null").select("shard", "row", "a", "b")
    spans = spans.union(light.select(cell, "shard", "row", "a", "single", "bytes").groupBy("cell").applyInArrow(_sorted_cell, _COVERED_SQL))
    if sizes.get(True, 0):
        spans = spans.union(_sorted_over_all(spark, heavy, -(-sizes[True] // CELL_BYTES)))
    return table.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _sorted_over_all(spark: SparkSession, segments: DataFrame, pieces: int) -> DataFrame:
    """What _sorted_cell gives, of segments that no cell holds: each sort is over all partitions."""
    piece = F.pmod(F.xxhash64("seg"), F.lit(pieces)).cast("long").alias("piece")
    numbered = segments.withColumn("seg", F.monotonically_increasing_id()).select(piece, "seg", "shard", "row", "a", "single", "bytes")
    by_piece = bucketed(spark, numbered, "piece", pieces, "pieces").groupBy("piece")

    def named(rows: DataFrame) -> DataFrame:
        return materialize(spark, _ranked(rows, 3, pieces), "names").select(piece, "seg", "place", "name")

    level1 = named(by_piece.applyInArrow(lambda table: _triples(Shard(table)), _sql(3)))
    level2 = named(by_piece.cogroup(level1.groupBy("piece")).applyInArrow(_in_pieces(lambda table, side: _name_triples(Shard(table), side), 3), _sql(3)))
    both = level1.withColumn("level", F.lit(1)).union(level2.withColumn("level", F.lit(2)))
    merged = _ranked(by_piece.cogroup(both.groupBy("piece")).applyInArrow(_in_pieces(_by_level, 7), _sql(7)), 7, pieces * 2).select(piece, "seg", "place", "name")
    return by_piece.cogroup(merged.groupBy("piece")).applyInArrow(lambda table, side: _covered(Shard(table), side) if table.num_rows else _COVERED.empty_table(), _COVERED_SQL)
