"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.common import batches

SEED_WORDS = 3
#: A seed is rare where independent words would make it less often than this. Of each SPREAD consecutive seeds of an item the
#: rarest is kept anyway, so that any stretch of an item that is left unedited for SPREAD + 2 words has one.
RARE = 1e-7
SPREAD = 4
#: Alignment scores, the share of an item's full score that counts as a copy, and the unbroken run of words that does so in any item.
MATCH, MISMATCH, GAP = 2, -1, -1
COPY = 0.5
RUN = 13
#: Bytes of items that are searched for at once: what is sent to the workers is bounded by it, however many items there are.
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"\w+")


def words_of(text: bytes | str | None) -> list[str]:
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment score of two sequences of word numbers, the end of it in the passage (exclusive), and the longest run of equal words with its end."""
    n = len(passage)
    row, steps, run = np.zeros(n + 1, np.int64), -GAP * np.arange(n + 1), np.zeros(n + 1, np.int64)
    best, end, longest, run_end = 0, 0, 0, 0
    for w in item:
        same = passage == w
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(same, MATCH, MISMATCH), row[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        run[1:] = np.where(same, run[:-1] + 1, 0)
        at = int(run.argmax())
        if run[at] > longest:
            longest, run_end = int(run[at]), at
    return best, end, longest, run_end


class Items:
    """A block of items: word numbers from 1, seeds and where they stand."""

    def __init__(self, rows: list[tuple[int, list[str]]], frequency: dict[str, float]):
        self.number: dict[str, int] = {}
        self.items, self.ids, seeds = [], [], defaultdict(list)
        for item_id, words in rows:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
            k, grams = len(self.items), len(words) - SEED_WORDS + 1
            self.items.append(ids)
            self.ids.append(item_id)
            chance = [float(np.prod([frequency.get(w, 0.0) for w in words[i : i + SEED_WORDS]])) for i in range(grams)]
            kept = {min(range(i, min(i + SPREAD, grams)), key=chance.__getitem__) for i in range(max(1, grams - SPREAD + 1))}
            for i in range(grams):
                if chance[i] <= RARE or i in kept:
                    seeds[self.pack(ids[i : i + SEED_WORDS])].append((k, i))
        self.keys = np.array(sorted(seeds), np.int64)
        self.places = dict(seeds)

    @staticmethod
    def pack(ids) -> int:
        return int(reduce(lambda a, b: a << 21 | int(b), ids, 0))

    def copies(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """(item_id, share of the full score, first word, end) of each item that the text holds a copy of."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        n = len(ids) - SEED_WORDS + 1
        if n <= 0 or not len(self.keys):
            return []
        grams = ids[:n] << 42 | ids[1 : n + 1] << 21 | ids[2 : n + 2]
        at = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)] == grams)
        spans: dict[int, list[list[int]]] = {}
        for p in at.tolist():
            for k, i in self.places[int(grams[p])]:
                size = len(self.items[k])
                lo, hi = max(0, p - i - size // 2), min(len(ids), p - i + size + size // 2)
                known = spans.setdefault(k, [])
                while known and lo <= known[-1][1]:  # regions that overlap are one
                    last = known.pop()
                    lo, hi = min(lo, last[0]), max(hi, last[1])
                known.append([lo, hi])
        out = []
        for k, regions in spans.items():
            full = MATCH * len(self.items[k])
            score, end, longest = 0, 0, 0
            for lo, hi in regions:
                found = align(self.items[k], ids[lo:hi])
                whole, before = found[0] >= COPY * full, score >= COPY * full
                if found[0] > score and whole or not before and found[2] > longest:
                    score, end, longest = found[0], lo + (found[1] if whole else found[3]), found[2]
            if score >= COPY * full or longest >= RUN:
                out.append((self.ids[k], round(score / full, 6), max(0, end - (len(self.items[k]) if score >= COPY * full else longest)), end))
        return out


def word_frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, float]:
    """How large a share of all words of docs each word of the vocabulary is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in it:
            for t in b.column(0):
                words = words_of(t.as_py())
                counts.update(filter(vocabulary.__contains__, words))
                counts[""] += len(words)
        yield from batches(iter(counts.items()), pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = max(1, counts.pop("", 0))
    return {w: n / total for w, n in counts.items()}


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The items as (item_id, words), in blocks of about BLOCK_BYTES; items of fewer than SEED_WORDS words are too short to tell."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if len(words) >= SEED_WORDS:
            held.append((r["item_id"], words))
            size += len(r["text"])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every document and item of which it holds a copy: an alignment of at
    least COPY of the item's full score, or RUN of its words in a row.

    Items are searched for in bounded blocks, each a pass over all whole texts, in which a document meets only the items
    whose rare seeds it holds. Seeds are rare by the frequencies of their words, so a passage that very many documents copy
    stays searchable. A very long text is searched whole. Of passages that align equally well, the first is reported. A null or empty text holds nothing; a null item, or one under three words, is never found; repeated
    rows repeat their result; other columns are left out; no rows, or no items, give no rows.
    """
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    parts = []
    for block in blocks(benchmark):
        items = Items(block, word_frequencies(docs, {w for _, ws in block for w in ws}))

        def run(it: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield from batches(((d.as_py(), *row) for d, t in zip(b.column(0), b.column(1)) for row in items.copies(t.as_py())), arrow)

        parts.append(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all columns, without those that hold a copy of an item; rows without doc_id are judged by their text alone."""
    for block in blocks(benchmark):
        items = Items(block, word_frequencies(docs, {w for _, ws in block for w in ws}))

        @F.pandas_udf("boolean")
        def holds(texts, items=items):
            import pandas as pd

            return pd.Series([bool(items.copies(None if t is None else bytes(t))) for t in texts], dtype=bool)

        docs = docs.where(~holds(F.col("text").cast("binary")))
    return docs
