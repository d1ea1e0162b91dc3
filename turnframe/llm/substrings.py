"""Substring dedup with repeated-phrase automata.

1. Anchors nominate: of each window of 50 words, the least hash of its 25-word phrases. Equal windows have equal anchors, so
   a window whose anchor is in one document only does not recur. About one phrase in thirteen is an anchor.
2. Passages are confirmed: the windows with recurring anchors are hashed whole; each window that two documents hold belongs
   to the smallest doc_id of them, its owner, and consecutive windows of an owner make a passage.
3. Per shard of documents, Aho-Corasick automata are compiled from those passages that occur in the shard, by blocks of 12
   words of them (a window of a passage holds at least one whole block), and all documents of the shard stream through
   them. A found block is extended to the longest common run of words; runs of 50 or more are what is removed.

Documents are dealt to shards of bounded bytes once, as a bucketed table; what moves after that is hashes and passages.
A shard's rows carry its windows' least and greatest doc_id, so a passage of very many documents is one row per shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.llm.common import bucketed, many_word_hashes, materialize, member, mix, rolling, runs, shards_for, sliding_min, word_hashes

WINDOW = 50
PHRASE = 25
#: Text of one shard, about; less where the kept words are handed on as well, as a task holds them beside the texts.
SHARD_MB, SHARD_MB_KEPT = 16, 8
#: A passage gives the automaton a block of BLOCK words every STRIDE words; a window of it holds at least one whole block.
BLOCK, STRIDE = 12, WINDOW - 12
#: Passages of one automaton, about. Where a shard has more, its documents go through several, one after another.
AUTOMATON_BYTES = 8 << 20
#: Odd; a second hash of a window is that of its words' hashes times this.
MORE = np.uint64(0xC2B2AE3D27D4EB4F)
_ALPHABET = 64


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """Of each window, the least scattered hash of its phrases."""
    return sliding_min(mix(rolling(hashes, PHRASE)), WINDOW - PHRASE + 1)


_SPANS = pa.schema([("hash", pa.int64()), ("more", pa.int32()), ("shard", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_SPANS_SQL = "hash long, more int, shard long, lo long, hi long"


def _spans(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shard: int) -> pa.Table:
    """Each distinct key (hash and more bits of it) with the least and the greatest of its docs."""
    if not found:
        return _SPANS.empty_table()
    keys, more, docs = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")
    if ((keys[order][1:] == keys[order][:-1]) & (more[order][1:] != more[order][:-1])).any():
        order = np.lexsort((more, keys))
    keys, more, docs = keys[order], more[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1]))))
    columns = (keys[first].view(np.int64), more[first], np.full(len(first), shard), np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPANS)], schema=_SPANS)


def recurring(spans: DataFrame) -> DataFrame:
    """(hash, shard, owner) of the keys that more than one document holds. A key that is everywhere is one row a shard."""
    same = Window.partitionBy("hash", "more")
    met = spans.withColumns({"owner": F.min("lo").over(same), "last": F.max("hi").over(same)})
    return met.where("owner < last").select("hash", "shard", "owner")


def _windows_of(table: pa.Table):
    """Of groups of documents: their words' hashes, the anchors of their windows, which of these lie in one document, and its doc_id."""
    for batch in table.to_batches():  # a shard's texts are not copied if nothing is null
        if batch.column("doc_id").null_count:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
        texts, ids = batch.column("text"), batch.column("doc_id").to_numpy()
        for _, _, h, text in many_word_hashes(pc.fill_null(texts, b"") if texts.null_count else texts):
            if len(h) >= WINDOW:
                inside = text[: 1 - WINDOW] == text[WINDOW - 1 :]
                if inside.any():
                    yield h, window_anchors(h), inside, ids[text[: 1 - WINDOW]]


def _anchors(table: pa.Table) -> pa.Table:
    found = []
    for _, anchors, inside, docs in _windows_of(table):
        new = inside.copy()  # neighbours mostly have one anchor
        new[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1] | (docs[1:] != docs[:-1])
        found.append((anchors[new], np.zeros(int(new.sum()), np.int32), docs[new]))
    return _spans(found, table.column("shard")[0].as_py())


def _windows(table: pa.Table, side: pa.Table) -> pa.Table:
    if not table.num_rows or not side.num_rows:
        return _SPANS.empty_table()
    found, known = [], np.sort(side.column("hash").to_numpy())
    for h, anchors, inside, docs in _windows_of(table):
        flags = inside & member(known, anchors.view(np.int64))
        if flags.any():
            found.append((rolling(h, WINDOW)[flags], rolling(h * MORE, WINDOW)[flags].astype(np.uint32).view(np.int32), docs[flags]))
    return _spans(found, table.column("shard")[0].as_py())


def _documents(table: pa.Table):
    for doc, text in zip(table.column("doc_id"), table.column("text")):
        if (d := doc.as_py()) is not None:
            yield d, text.as_py() or b""


_PASSAGES = pa.schema([("owner", pa.int64()), ("passage", pa.binary())])


def _passages(table: pa.Table, side: pa.Table) -> pa.Table:
    """Of each owner, the runs of words that its windows cover."""
    if not table.num_rows or not side.num_rows:
        return _PASSAGES.empty_table()
    owners, windows = side.column("owner").to_numpy(), side.column("hash").to_numpy()
    order = np.argsort(owners, kind="stable")
    owners, windows = owners[order], windows[order]
    out, seen = [], set()
    for doc, text in _documents(table):
        lo, hi = np.searchsorted(owners, doc), np.searchsorted(owners, doc, "right")
        if lo == hi:
            continue
        words = text.split()
        flags = member(np.sort(windows[lo:hi]), rolling(word_hashes(text), WINDOW).view(np.int64))
        for a, b in runs(flags).tolist():
            passage = (doc, b" ".join(words[a : b + WINDOW - 1]))
            if passage not in seen:
                seen.add(passage)
                out.append(passage)
    return pa.Table.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], schema=_PASSAGES)


class Automaton:
    """Blocks of passages. A word's number is written in a few characters, each place of them with an alphabet of its own:
    a node has few branches then, and no match begins inside a word."""

    def __init__(self, owners: list[int], passages: list[bytes]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.owners, self.passages, places = owners, [], {}
        for k, text in enumerate(passages):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in text.split(b" ")], np.int32)
            self.passages.append(ids)
            for at in range(0, len(ids) - BLOCK + 1, STRIDE):
                places.setdefault(ids[at : at + BLOCK].tobytes(), []).append((k, at))
        self.width = 1
        while _ALPHABET**self.width <= len(self.number):
            self.width += 1
        written = ["".join(chr(48 + _ALPHABET * i + (n // _ALPHABET**i) % _ALPHABET) for i in range(self.width)) for n in range(len(self.number) + 1)]
        self.written = {w: written[n] for w, n in self.number.items()}
        self.none = written[0]
        self.automaton = ahocorasick.Automaton()
        for block, where in places.items():
            self.automaton.add_word("".join([written[n] for n in np.frombuffer(block, np.int32).tolist()]), where)
        self.automaton.make_automaton()

    def removed(self, doc: int, words: list[bytes]) -> np.ndarray | None:
        """Which words lie in a window that starts in an owner with a smaller doc_id; None for none of them."""
        if len(words) < WINDOW or not self.passages:
            return None
        get, none, ids, out = self.written.get, self.none, None, None
        ends: dict[tuple[int, int], int] = {}
        covered = (0, 0)
        for last, where in self.automaton.iter("".join([get(w, none) for w in words])):
            q = last // self.width - BLOCK + 1
            if covered[0] <= max(0, q - STRIDE) and min(len(words), q + WINDOW) <= covered[1]:
                continue  # any window that holds the block lies in what is removed already
            for k, at in where:
                if self.owners[k] >= doc or ends.get((k, q - at), -1) > q:
                    continue
                if ids is None:
                    number = self.number.get
                    ids, out = np.array([number(w, 0) for w in words], np.int32), np.zeros(len(words), bool)
                p = self.passages[k]
                left = self._common(p[:at][::-1], ids[:q][::-1])
                right = self._common(p[at + BLOCK :], ids[q + BLOCK :])
                ends[k, q - at] = q + BLOCK + right
                if left + BLOCK + right >= WINDOW:
                    lo, hi = q - left, q + BLOCK + right
                    out[lo:hi] = True
                    if lo <= covered[1]:
                        lo = min(lo, covered[0])
                    covered = (lo, max(hi, covered[1]))
        return out

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n, at, step = min(len(a), len(b)), 0, 64
        while at < n:
            differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
            if differ.any():
                return at + int(differ.argmax())
            at, step = at + step, step * 4
        return n


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("row", pa.int64()), ("kept", pa.binary())])
_RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, row long, kept binary"


def _locate(with_text: bool):
    schema = _RESULT if with_text else pa.schema(list(_RESULT)[:5])

    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        docs, texts, gone = table.column("doc_id").to_pylist(), table.column("text").to_pylist(), {}
        sizes = np.cumsum(pc.binary_length(side.column("passage")).to_numpy().astype(np.int64)) if side.num_rows else np.zeros(0, np.int64)
        cuts = (np.flatnonzero(np.diff(sizes // AUTOMATON_BYTES)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, side.num_rows]) if side.num_rows else ():
            part = side.slice(lo, hi - lo)
            automaton = Automaton(part.column("owner").to_pylist(), part.column("passage").to_pylist())
            for i, (doc, text) in enumerate(zip(docs, texts)):
                if doc is not None and text and (found := automaton.removed(doc, text.split())) is not None:
                    gone[i] = gone[i] | found if i in gone else found
        rows = []
        for i, (doc, row, text) in enumerate(zip(docs, table.column("row").to_pylist(), texts)):
            words, flags = (text or b"").split(), gone.get(i)
            n = 0 if flags is None else int(flags.sum())
            kept = b" ".join([w for w, g in zip(words, flags.tolist()) if not g] if n else words)
            rows.append((doc, len(words), n, hashlib.sha256(kept).hexdigest(), row, kept)[: len(schema)])
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, with_text: bool = False, row_column: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, row (the values of row_column, or null) and, with_text, the kept words as binary.

    A word goes if a window of 50 words over it also starts in a document with a smaller doc_id. A null text has no words; a
    row with a null doc_id loses nothing and takes nothing; rows that repeat a doc_id do not count against each other; texts
    under 50 words stay; a very long text is one row of one shard, whatever its size; of equal texts that of the least doc_id
    stays whole; other columns of docs are left out, whatever their names; no rows give no rows.
    """
    shards = shards_for(docs, "text", SHARD_MB_KEPT if with_text else SHARD_MB)
    row = (F.col(row_column) if row_column else F.lit(None)).cast("long").alias("row")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long").alias("shard")
    table = bucketed(spark, docs.select(shard, F.col("doc_id").cast("long").alias("doc_id"), row, F.col("text").cast("binary").alias("text")), "shard", shards, "substrings")
    texts = table.select("shard", "doc_id", "text").groupBy("shard")
    anchors = recurring(texts.applyInArrow(_anchors, _SPANS_SQL)).select("shard", "hash")
    spans = texts.cogroup(anchors.groupBy("shard")).applyInArrow(_windows, _SPANS_SQL)
    windows = materialize(spark, recurring(spans), "windows")
    owned = windows.groupBy("owner", "hash").agg(F.count("*")).select(F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("long").alias("shard"), "owner", "hash")
    passages = materialize(spark, texts.cogroup(owned.groupBy("shard")).applyInArrow(_passages, "owner long, passage binary"), "passages")
    routes = windows.select("owner", "shard").distinct()
    routed = routes.join(passages, "owner").select("shard", "owner", "passage")
    schema = _RESULT_SQL if with_text else _RESULT_SQL.rpartition(", ")[0]
    return table.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(_locate(with_text), schema)


def cut_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, with all columns, their texts replaced by the kept words where words were removed; n_chars follows the text."""
    key, new = "turnframe_row", "turnframe_kept"
    numbered = materialize(spark, docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    kept = remove_repeats(spark, numbered.select("doc_id", "text", key), True, key).where("n_removed > 0").select(F.col("row").alias(key), F.col("kept").cast("string").alias(new))
    joined = numbered.join(kept, key, "left").withColumn("text", F.coalesce(new, "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
