"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of their low or of their high half. Of each
half, 31 bits are covered by the perfect Hamming code of length 31: every value is within radius 1 of a code word, its
anchors are the code words within radius 1 + 1, so two values at distance 1 share the anchor that covers either of them.
A fingerprint is copied to at most 2 * (1 + 3 * 16) keys, whatever the size of the data, and is only compared under a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.common import connected_components, many_word_hashes, materialize, mix, rolling

SHINGLE = 3
SEED = 42
THRESHOLD = 3
_BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a text's 3-word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _BLOCK):
        part = words[lo : min(n, lo + _BLOCK) + SHINGLE - 1]
        if len(part) < SHINGLE:
            grams = [b" ".join(part)]
        else:
            grams = map(b"%b %b %b".__mod__, zip(part, part[1:], part[2:]))
        h = np.array([digest(g, SEED) for g in grams], np.uint64)
        for at in range(0, len(h), 255):  # sums of 255 bits fit a byte
            ones += np.unpackbits(h[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every document; a null text has fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], schema=schema)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks() -> np.ndarray:
    """By syndrome, what turns a 31-bit value into each code word within distance 2 of it: the bit that the syndrome names, and each pair of bits whose numbers add to it."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        out[s] = [1 << (s - 1), *(1 << (i - 1) | 1 << (j - 1) for i, j in pairs)]
    return out


_MASKS = _masks()
_CHECKS = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]


def anchors(half: np.ndarray) -> np.ndarray:
    """Rows of 16 code words of the Hamming code of length 31, those within distance 2 of a value; a code word itself is its only anchor, 16 times.

    Code words are at least 3 apart, so no other is within 2 of one.
    """
    syndrome = sum((np.bitwise_count(half & check) & 1).astype(np.int64) << k for k, check in enumerate(_CHECKS))
    return half[:, None] ^ _MASKS[syndrome]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, kind, value): the keys under which each fingerprint meets every other one at THRESHOLD bits or fewer.

    One of two such fingerprints' halves differs in no bit or in one. In no bit: they meet under that half itself. In one
    bit: the other halves differ in at most two, so they agree in one of three parts of it, and they meet under an anchor of
    the first half together with that part. Parts make groups small without losing a pair.
    """
    low, high, code = fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32), np.uint64(0x7FFFFFFF)
    which, kinds, values = [], [], []
    for half, this, other in ((0, low, high), (1, high, low)):
        which.append(np.arange(len(fps)))
        kinds.append(np.full(len(fps), 4 * half, np.int8))
        values.append(this)
        # bit 31 is outside the code: halves that differ there alone have the same anchors
        near = anchors(this & code)
        own = near[:, 0] == near[:, 1]
        for part, (at, width) in enumerate(PARTS):
            found = near << np.uint64(11) | ((other >> np.uint64(at)) & np.uint64((1 << width) - 1))[:, None]
            use = np.ones(found.shape, bool)
            use[own, 1:] = False
            which.append(np.nonzero(use)[0])
            values.append(found[use])
            kinds.append(np.full(len(values[-1]), 4 * half + 1 + part, np.int8))
    return np.concatenate(which), np.concatenate(kinds), np.concatenate(values).view(np.int64)


def _keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        fps = b.column(0).to_numpy()
        for at in range(0, len(fps), 1000):
            part = fps[at : at + 1000]
            which, kind, value = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(value), pa.array(part[which])], names=["kind", "value", "fp"])


#: (lowest bit, width) of the parts of a half.
PARTS = ((0, 11), (11, 11), (22, 10))
#: A group of more fingerprints is put off, to be compared in cells of about this many.
CELL = 4096
_FOUND = "a long, b long, kind byte, value long"
_FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int8()), ("value", pa.int64())])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= THRESHOLD


def pairs_within(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of one group that are near. group is sorted: all groups are gone through together, each row against the k-th after it."""
    out_i, out_j, at, k = [], [], np.arange(len(fps)), 1
    while True:
        at = at[at + k < len(fps)]
        at = at[group[at] == group[at + k]]
        if not len(at):
            break
        hits = at[_near(fps[at], fps[at + k])]
        out_i.append(hits)
        out_j.append(hits + k)
        k += 1
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (at, at)


def _spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) make a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = np.zeros(len(i), bool)
    for n, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep[n] = True
    return keep


def _batch(a: np.ndarray, b: np.ndarray | None, kind: np.ndarray | None = None, value: np.ndarray | None = None) -> pa.RecordBatch:
    none = lambda t: pa.nulls(len(a), t)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none(pa.int64()) if b is None else pa.array(b.view(np.int64)), none(pa.int8()) if kind is None else pa.array(kind), none(pa.int64()) if value is None else pa.array(value)], schema=_FOUND_ARROW)


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, value, fp), sorted -> near pairs of each group; rows of groups over CELL come out as they are, with no b."""
    held = [np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    put_off = None  # the group whose rows are being put off

    def done(kind, value, fp) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (value[1:] != value[:-1]))))
        size = np.diff(np.concatenate((new, [len(fp)])))
        group, large = np.repeat(np.arange(len(new)), size), np.repeat(size > CELL, size)
        if large.any():
            yield _batch(fp[large], None, kind[large], value[large])
            group, fp = group[~large], fp[~large]
        i, j = pairs_within(group, fp)
        if len(i):
            keep = _spanning(i, j)
            yield _batch(fp[i[keep]], fp[j[keep]])

    for b in it:
        parts = [np.concatenate((h, c.to_numpy().view(h.dtype))) for h, c in zip(held, b.columns)]
        if not len(parts[0]):
            continue
        kind, value, fp = parts
        if put_off is not None:
            same = (kind == put_off[0]) & (value == put_off[1])
            if same.any():
                yield _batch(fp[same], None, kind[same], value[same])
                kind, value, fp = kind[~same], value[~same], fp[~same]
                if not len(fp):
                    held = [kind, value, fp]
                    continue
            put_off = None
        last = len(fp) - int(((kind == kind[-1]) & (value == value[-1])).sum())
        if len(fp) - last > CELL:  # the last group is large already, and may go on
            put_off = (kind[-1], value[-1])
            yield _batch(fp[last:], None, kind[last:], value[last:])
            kind, value, fp = kind[:last], value[:last], fp[:last]
        if last:
            yield from done(kind[:last], value[:last], fp[:last])
        held = [kind[last:], value[last:], fp[last:]]
    if len(held[0]):
        yield from done(*held)


def _compare_cells(key: tuple, table: pa.Table) -> pa.Table:
    """Near pairs of one cell: of all its rows where its two blocks are one, else between them."""
    block, fps = table.column("block").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    left, right = key[2].as_py(), key[3].as_py()
    x, y = np.flatnonzero(block == left), np.flatnonzero(block == right)
    found = [(np.full(len(h), p), h) for p in x.tolist() if len(h := y[(y > p) & _near(fps[y], fps[p])] if left == right else y[_near(fps[y], fps[p])])]
    i, j = (np.concatenate(c) for c in zip(*found)) if found else (x[:0], x[:0])
    keep = _spanning(i, j)
    return pa.table({"a": fps[i[keep]].view(np.int64), "b": fps[j[keep]].view(np.int64)})


def links(spark: SparkSession, distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprints at THRESHOLD bits or fewer, as spanning forests of each group, so that reachability is whole.

    Groups of up to CELL are compared as their sorted rows pass by. Of a larger one, fingerprints are dealt to blocks and
    each pair of blocks is a cell of its own, so no group is ever in one task.
    """
    # a fingerprint is few bytes but many keys, so its rows are spread before they multiply
    spread = distinct.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = spread.mapInArrow(_keyed, "kind byte, value long, fp long")
    found = materialize(spark, rows.repartition("kind", "value").sortWithinPartitions("kind", "value").mapInArrow(_compare, _FOUND), "simhash-pairs")
    late = found.where("b is null").select("kind", "value", F.col("a").alias("fp"))
    sizes = late.groupBy("kind", "value").agg(F.ceil(F.count("*") / CELL).alias("blocks"))
    dealt = late.join(sizes, ["kind", "value"]).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = dealt.withColumn("other", other).select("kind", "value", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "fp")
    far = cells.groupBy("kind", "value", "left", "right").applyInArrow(_compare_cells, "a long, b long")
    return found.where("b is not null").select("a", "b").union(far).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id): documents linked by fingerprints at 3 or fewer differing bits.

    Equal fingerprints meet in one row first, so copies cost no comparison. A null or empty text has fingerprint 0 and is
    linked like any other; a row with a null doc_id keeps a null component unless others share its group; no rows give no rows.
    """
    fps = materialize(spark, fingerprints(docs), "simhash")
    reps = materialize(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-reps")
    edges = links(spark, reps.select("fp"))
    groups = connected_components(spark, edges)
    placed = reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    firsts = placed.groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = placed.join(firsts, "group").select("fp", "component_id")
    return fps.join(named, "fp")


#: Of the filtering stage: words of a shingle, and the Jaccard similarity of two texts' sets of shingles that makes them copies.
COPY_WORDS = 5
COPY_SIMILARITY = 0.8
#: A text's shingles are dealt into classes of about CLASS_SIZE; the first CLASSES of them have a fingerprint each.
CLASS_SIZE = 3
CLASSES = 8
#: Bits at which the fingerprints of two whole texts may differ for them to be compared; at the similarity above, 10 are expected and 3 is the deviation.
COPY_BITS = 22

_SIGNED = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("odd", pa.binary())])
_SIGNED_SQL = "doc_id long, s1 long, s2 long, n long, fp long, keys array<long>, odd binary"


def shingle_sets(texts: pa.Array, width: int = COPY_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, distinct shingle hashes, the text of each, both in order of text and hash) for groups of texts (binary, lower case).

    A text of fewer words than width has one shingle, all its words; one without words has none.
    """
    for lo, hi, h, text in many_word_hashes(texts):
        n = np.bincount(text - lo, minlength=hi - lo)
        found, of = rolling(h, width), text[: max(0, len(h) - width + 1)]
        inside = of == text[width - 1 :] if len(found) else np.zeros(0, bool)
        short = np.flatnonzero((n > 0) & (n < width))
        first = np.cumsum(n) - n
        whole = [rolling(h[first[k] : first[k] + n[k]], int(n[k])) for k in short]
        found, of = np.concatenate([found[inside], *whole]), np.concatenate([of[inside], short + lo])
        order = np.lexsort((found, of))
        found, of = found[order], of[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
        yield lo, hi, found[new], of[new]


def _majority(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    ones = np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


#: Places of an odd sketch: a power of two, at least twice the shingles of its set up to this. Fewer prove less, but nothing wrong.
MOST_PLACES = 1 << 20


def odd_sketches(scattered: np.ndarray, of: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set, a bit a place: whether an odd number of its n shingles falls there. of: the set of each shingle, from 0."""
    places = np.minimum(np.int64(1) << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64), MOST_PLACES)
    ends = np.cumsum(places)
    at = (ends - places)[of] + (scattered & (places[of] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(ends[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[(e - k) // 8 : e // 8] for e, k in zip(ends.tolist(), places.tolist())]


def least_difference(x: bytes, y: bytes) -> int:
    """No fewer shingles than these are in only one of the sets of two odd sketches: a place whose bits differ has one at least."""
    folded = []
    for sketch in (x, y):
        bits, size = int.from_bytes(sketch, "little"), 8 * len(sketch)
        while size > 8 * min(len(x), len(y)):
            size //= 2
            bits = (bits >> size) ^ (bits & ((1 << size) - 1))
        folded.append(bits)
    return (folded[0] ^ folded[1]).bit_count()


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: two sums that stand for its set of shingles, its size, its fingerprint, the keys under which it meets its copies, and its odd sketch."""
    for b in it:
        ids, texts = b.column(0), pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary())
        for lo, hi, h, of in shingle_sets(texts):
            n = np.bincount(of - lo, minlength=hi - lo)
            has, first = np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]
            s1, s2, fp = (np.zeros(hi - lo, np.uint64) for _ in range(3))
            keys: list[list[int]] = [[] for _ in range(hi - lo)]
            scattered = mix(h)
            if len(h):
                s1[has], s2[has] = np.add.reduceat(scattered, first), np.bitwise_xor.reduceat(mix(scattered), first)
                fp[has] = _majority(h, first, n[has])
                level = np.floor(np.log2(np.maximum(n / CLASS_SIZE, 1))).astype(np.uint64)
                for more in (0, 1):  # sizes of two copies may lie on both sides of a power of two
                    at_level = level + np.uint64(more)
                    kind = (scattered >> np.uint64(20)) & ((np.uint64(1) << at_level[of - lo]) - np.uint64(1))
                    use = np.flatnonzero(kind < CLASSES)
                    use = use[np.lexsort((h[use], kind[use], of[use]))]
                    who, kind = of[use] - lo, kind[use]
                    start = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (kind[1:] != kind[:-1]))))
                    found = _majority(h[use], start, np.diff(np.concatenate((start, [len(use)]))))
                    found = mix(found ^ mix(at_level[who[start]] * np.uint64(64) + kind[start] + np.uint64(1)))
                    for w, key in zip(who[start].tolist(), found.view(np.int64).tolist()):
                        keys[w].append(key)
            columns = (ids.slice(lo, hi - lo).to_pylist(), s1.view(np.int64), s2.view(np.int64), n, fp.view(np.int64), keys, odd_sketches(scattered, of - lo, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIGNED)], schema=_SIGNED)


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts = pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary())
        for lo, hi, h, of in shingle_sets(texts):
            ends = np.searchsorted(of, np.arange(lo, hi + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())], names=["id", "shingles"])


def _similar(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose sets of shingles are similar enough."""
    for b in it:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= COPY_SIMILARITY * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: The exact pass orders shingles: those that stand in FREQUENT sets or more of one in SAMPLED come last, the most frequent at the end. At most MOST_FREQUENT are told apart. Any order gives the same links; this one keeps groups small.
SAMPLED, FREQUENT, MOST_FREQUENT = 16, 3, 1 << 17
#: Sets that a task remembers to have gone through already.
_SEEN = 100_000


def _sampled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, hash) of the shingles of one set in SAMPLED, chosen by what is in it."""
    for b in it:
        texts = pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary())
        for lo, hi, h, of in shingle_sets(texts):
            has, first = np.unique(of, return_index=True)
            if len(has):
                sums = np.add.reduceat(mix(h), first)
                which = sums[np.searchsorted(has, of)]
                use = which % np.uint64(SAMPLED) == 0
                yield pa.RecordBatch.from_arrays([pa.array(which[use].view(np.int64)), pa.array(h[use].view(np.int64))], names=["set", "h"])


def _prefixes(frequent: np.ndarray):
    """(h, doc_id, info) of the first n // 5 + 1 of each set's n shingles in one order; info is n, and the place in the low 32 bits.

    Of two sets with 5 * both >= 4 * either, the first shingle that they share is among these of each. frequent: hashes that come last, as they stand there.
    """
    order = np.argsort(frequent)
    known = frequent[order]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in it:
            ids, texts = b.column(0).to_numpy(), pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary())
            for lo, hi, h, of in shingle_sets(texts):
                has, first, n = np.unique(of, return_index=True, return_counts=True)
                if not len(has):
                    continue
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[k] == h, order[k] + 1, 0)
                scattered = mix(h)
                sums = (np.add.reduceat(scattered, first), np.bitwise_xor.reduceat(mix(scattered), first), n)
                fresh = np.zeros(len(has), bool)
                for j, key in enumerate(zip(*(x.tolist() for x in sums))):  # equal sets have one representative, whichever text stands for it here
                    fresh[j] = key not in seen
                    seen.add(key)
                if len(seen) > _SEEN:
                    seen.clear()
                sorted_ = np.lexsort((h, rank, of))
                place = np.arange(len(h)) - np.repeat(first, n)
                use = (place <= np.repeat(n, n) // 5) & np.repeat(fresh, n)
                info = np.repeat(n, n) << 32 | place
                yield pa.RecordBatch.from_arrays([pa.array(h[sorted_][use].view(np.int64)), pa.array(ids[of[use]]), pa.array(info[use])], names=["h", "doc_id", "info"])

    return run


def _recurring(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, those whose h another row has. One row is held over, so that batches meet; no group is held."""
    last, given = None, False
    for b in it:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        if last is not None:
            cols = [np.concatenate((x, c)) for x, c in zip(last, cols)]
        same = cols[0][1:] == cols[0][:-1]
        emit = np.concatenate((same, [False])) | np.concatenate(([False], same))
        last, after = [c[-1:] for c in cols], bool(emit[-1])
        if given:
            emit[0] = False
        given = after
        yield pa.RecordBatch.from_arrays([pa.array(c[emit]) for c in cols], names=["h", "doc_id", "info"])


def _remaining(spark: SparkSession, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) representatives in different components whose sets of shingles may be similar enough; no such pair is left out.

    nodes: doc_id, n, id (the representative), component_id. Texts that share a shingle of their prefixes are paired if their
    sizes, and what is left of both from there on, let them be similar.
    """
    counted = texts.mapInArrow(_sampled, "set long, h long").distinct().groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") >= FREQUENT)
    most = counted.orderBy(F.desc("m"), "h").limit(MOST_FREQUENT).select("h").toArrow().column("h").to_numpy()
    rows = texts.mapInArrow(_prefixes(most[::-1].view(np.uint64)), "h long, doc_id long, info long")
    met = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_recurring, "h long, doc_id long, info long")
    size = F.shiftright("info", 32)
    met = met.join(nodes, "doc_id").where(size == F.col("n")).select("h", "id", "component_id", size.alias("n"), (size - F.col("info").bitwiseAND(0xFFFFFFFF)).alias("left")).distinct()
    met = materialize(spark, met, "prefixes")
    mixed = met.groupBy("h").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y").select("h")
    met = met.join(mixed, "h")
    other = met.select("h", *[F.col(c).alias(f"other_{c}") for c in ("id", "component_id", "n", "left")])
    fits = (F.col("id") < F.col("other_id")) & (F.col("component_id") != F.col("other_component_id")) & (5 * F.least("n", "other_n") >= 4 * F.greatest("n", "other_n")) & (9 * F.least("left", "other_left") >= 4 * (F.col("n") + F.col("other_n")))
    return met.join(other, "h").where(fits).select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()


def _not_apart(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose odd sketches allow that their sets are similar enough."""
    for b in it:
        n, xs, ys = (b.column(i).to_pylist() for i in (2, 3, 4))
        # both >= 0.8 * either is the same as difference <= sum of sizes / 9
        keep = [9 * least_difference(x, y) <= k for k, x, y in zip(n, xs, ys)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(spark: SparkSession, texts: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs of doc_ids whose sets of shingles are similar enough.

    Odd sketches, of a thirty-second or so of a set's bytes, go first: pairs that they prove apart never bring their sets along.
    """
    side = lambda d, n, odd: signed.select(F.col("doc_id").alias(d), F.col("n").alias(n), F.col("odd").alias(odd))
    sketched = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    pairs = materialize(spark, sketched.select("a", "b", (F.col("n") + F.col("m")).alias("both"), "x", "y").mapInArrow(_not_apart, "a long, b long").distinct(), "not-apart")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # rows that repeat a doc_id may have other texts; the pair was nominated by one of them, and any similar pair links the two
    sets = materialize(spark, texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "shingles")
    compared = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return materialize(spark, compared.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long").distinct(), "copies")


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): documents linked by five-word shingles at a Jaccard similarity of 0.8 or more.

    Texts with equal sets of shingles are one from the start. The others are nominated by fingerprints, of whole texts at
    THRESHOLD bits under their anchors, and of classes of their shingles where these agree: under each key a text is compared
    with the first text there, and with the first of its own size, so that a key which very many texts share is no more
    work a text than any other. Nominees are confirmed by their sets. What fingerprints do not bring together is found
    between the components of these, by prefixes of the sets, and confirmed alike: so no link is left to chance. All texts
    without words are copies of each other.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(spark, texts.mapInArrow(_sign, _SIGNED_SQL), "signed")
    alike = ["s1", "s2", "n"]
    reps = materialize(spark, signed.groupBy(*alike).agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "signed-reps")
    met = reps.select("id", "n", "fp", F.explode("keys").alias("key"))
    nominees = []
    for under in (["key"], ["key", "n"]):
        firsts = met.groupBy(*under).agg(F.min(F.struct("id", "n", "fp")).alias("f"), F.count("*").alias("m")).where("m > 1").drop("m")
        nominees.append(met.join(firsts, under).where("id <> f.id").select(F.col("id").alias("a"), F.col("f.id").alias("b"), "n", F.col("f.n").alias("other_n"), "fp", F.col("f.fp").alias("other_fp")))
    prints = materialize(spark, reps.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("f")), "prints")
    near = links(spark, prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("f").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("f").alias("y")), "b")
    nominees.append(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("other_n"), F.col("a").alias("fp"), F.col("b").alias("other_fp")))
    same = reps.join(prints, "fp").where("id <> f.id").select(F.col("id").alias("a"), F.col("f.id").alias("b"), "n", F.col("f.n").alias("other_n"), "fp", F.col("fp").alias("other_fp"))
    pairs = reduce(DataFrame.union, [*nominees, same])
    possible = (F.least("n", "other_n") >= COPY_SIMILARITY * F.greatest("n", "other_n")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= COPY_BITS)
    pairs = materialize(spark, pairs.where(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nominees")
    groups = connected_components(spark, _confirmed(spark, texts, signed, pairs))
    placed = materialize(spark, reps.join(groups.withColumnRenamed("node", "id"), "id", "left").select(*alike, "id", F.coalesce("component", "id").alias("component_id")), "placed")
    nodes = signed.select("doc_id", *alike).join(placed, alike).select("doc_id", "n", "id", "component_id").distinct()
    rest = materialize(spark, _remaining(spark, texts, nodes), "remaining")
    if not rest.isEmpty():
        of = placed.select("id", "component_id").distinct()
        found = _confirmed(spark, texts, signed, rest).join(of.select(F.col("id").alias("a"), F.col("component_id").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("component_id").alias("y")), "b")
        joined = connected_components(spark, found.select(F.col("x").alias("a"), F.col("y").alias("b")))
        placed = placed.join(joined.withColumnRenamed("node", "component_id"), "component_id", "left").select(*alike, "id", F.coalesce("component", "component_id").alias("component_id"))
    return signed.join(placed.drop("id"), alike).select("doc_id", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that are first of their group of near copies, with all their columns, whatever these are called.

    Copies are texts that near_copies() links; a null or empty text is a copy of any other such; rows without doc_id stay;
    rows that repeat a doc_id stay or go together; no rows give no rows.
    """
    gone = near_copies(spark, docs).where("doc_id > component_id").select(F.col("doc_id").alias(_GONE)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[_GONE], "left_anti")


_GONE = "turnframe_gone"
