"""Divergence of sources: which terms set a source apart within its language, and how far sources are from each other.

Terms are searched by upper bounds: a group's terms lie in buckets by their count there and in the language, and the
extremes of a bucket bound the value of all its terms. Buckets are evaluated best first until the bounds of those unseen
are strictly below the k-th value found. Pairs come from postings: only terms that two sources share are gone through for
the two, terms of one alone are summed by the distinct probabilities of their source, all others are equal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.llm.common import materialize

#: A term is kept in a language that has it in so many documents.
LEAST_DOCUMENTS = 3
#: Terms reported of a group.
TOP = 200
#: How much more is evaluated of groups that have not found TOP terms yet, from round to round.
WIDEN = 8
#: Entries that a task counts before it hands them on, and characters that it takes apart at once.
HELD = 300_000
PIECE = 1 << 20
#: Pairs of postings that a task goes through at once.
PAIRS = 1 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTED_SQL = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of bounded size, cut between terms. A longer term is a piece."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, in part."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)
        held.clear()

    for b in it:
        for lang, source, text in zip(*b.columns):
            text = (text.as_py() or b"").lower()
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before = len(n)
            if len(text) <= PIECE:
                found = _TERM.findall(text)
                n.update(found)
                docs.update(set(found))
            else:
                terms = set()
                for piece in _pieces(text):
                    found = _TERM.findall(piece)
                    n.update(found)
                    terms.update(found)
                docs.update(terms)
            size += len(n) - before
            if size >= HELD:
                yield from hand_on()
                size = 0
    yield from hand_on()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / total), exact in 64 bits while total is below 9 * 10**15."""
    rest, out = count + 1, F.lit(0).cast("long")
    for step in (1, 1000, 1000, 1000):
        rest = rest * step
        out, rest = out * step + _div(rest, total), rest % total
    return out + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most 10**9 + 1."""
    return _div((p - q) * (p - q), q)


def _class(n: Column) -> Column:
    """Counts up to 15 each, then eight classes an octave."""
    return F.when(n < 16, n).otherwise(16 + F.floor((F.log2(n.cast("double")) - 4) * 8)).cast("int")


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (gid, p, p0 of each source with a term) -> for pairs of sources what their shared terms add to what else is assumed of them."""
    for b in it:
        lists = b.column(0)
        entries = lists.flatten()
        gid, p, p0 = (entries.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        names, g = np.unique(gid, return_inverse=True)
        length, first = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
        cuts = np.flatnonzero(np.diff(np.cumsum(length) // PAIRS)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(gid)]):
            n = length[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo:hi], n)
            apart = left != right
            left, right = left[apart], right[apart]
            if not len(left):
                continue
            f = lambda x, y: (x - y) ** 2 // y
            value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            pair = g[left] * len(names) + g[right]
            order = np.argsort(pair, kind="stable")
            pair, start = np.unique(pair[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)]), pa.array(np.add.reduceat(value[order], start))], names=["g", "h", "value"])


def _pairs(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(g, h, value) of every two groups of a language. cells: (lang, term, gid, p), stats: (lang, gid, v, p0).

    Value is summed from what all terms would give if neither had them, corrections for the terms of either, and
    corrections for the terms of both.
    """
    other = stats.select("lang", F.col("gid").alias("h"), F.col("p0").alias("h0"))
    base = stats.where("v > 0").join(other, "lang").where("gid <> h").select(F.col("gid").alias("g"), "h", (F.col("v") * excess(F.col("p0"), F.col("h0"))).alias("value"))
    alike = cells.groupBy("lang", "gid", "p", "p0").agg(F.count("*").alias("n"))
    met = alike.join(other, "lang").where("gid <> h")
    one = met.groupBy("gid", "h").agg(F.sum(F.col("n") * (excess(F.col("p"), F.col("h0")) - excess(F.col("p0"), F.col("h0")))).alias("to"), F.sum(F.col("n") * (excess(F.col("h0"), F.col("p")) - excess(F.col("h0"), F.col("p0")))).alias("back"))
    either = one.select(F.explode(F.array(F.struct(F.col("gid").alias("g"), "h", F.col("to").alias("value")), F.struct(F.col("h").alias("g"), F.col("gid").alias("h"), F.col("back").alias("value")))).alias("x")).select("x.*")
    postings = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("found")).where("size(found) > 1")
    both = postings.select("found").mapInArrow(_shared, "g long, h long, value long")
    none = stats.where("v = 0").join(other, "lang").where("gid <> h").select(F.col("gid").alias("g"), "h", F.lit(0).cast("long").alias("value"))
    return reduce(DataFrame.union, [base, either, both, none]).groupBy("g", "h").agg(F.sum("value").alias("value"))


def _best(found: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("gid").orderBy(F.desc("value"), "term")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def _search(spark: SparkSession, cells: DataFrame, top: int) -> DataFrame:
    """(gid, term, value, rank): each group's terms of greatest value among those that it has more often than its language.

    cells: (gid, term, p, q, kind, of), of the last two the classes of count in the group and in the language.
    """
    bounds = cells.groupBy("gid", "kind", "of").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("n")).where("p > q").select("gid", "kind", "of", "n", excess(F.col("p"), F.col("q")).alias("bound"))
    earlier = Window.partitionBy("gid").orderBy(F.desc("bound"), "kind", "of").rowsBetween(Window.unboundedPreceding, -1)
    unseen = materialize(spark, bounds.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "bounds")
    best, quota = None, top
    while True:
        if best is None:
            state, take = unseen, F.col("earlier") < quota
        else:
            kth = best.where(F.col("rank") == top).select("gid", F.col("value").alias("kth"))
            state = unseen.join(kth, "gid", "left")
            take = F.coalesce(F.col("bound") >= F.col("kth"), F.col("earlier") < quota)
        state = materialize(spark, state.withColumn("take", take).drop("kth"), "bounds")
        chosen = state.where("take").select("gid", "kind", "of")
        if chosen.isEmpty():
            # groups that have not TOP terms go on while they have buckets, so only bounds below the k-th value are left
            if best is None or state.join(kth, "gid", "left_anti").isEmpty():
                break
            quota *= WIDEN
            continue
        new = cells.join(chosen, ["gid", "kind", "of"]).where("p > q").select("gid", "term", excess(F.col("p"), F.col("q")).alias("value"))
        best = materialize(spark, _best(new if best is None else new.union(best.select("gid", "term", "value")), top), "best")
        unseen, quota = state.where("not take").drop("take"), quota * WIDEN
    return best if best is not None else _best(cells.select("gid", "term", F.col("p").alias("value")).limit(0), top)


def audit(spark: SparkSession, docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source), as part `term` the top terms of each group, as part `pair` all other sources of its language.

    Null text, lang and source are read as ''. A group without terms, or of a language that keeps none, has pairs (of
    value 0 in the latter case) and no terms. Ties come in bytewise order of the item. Repeated rows count each. Texts of any length are
    counted whole, in pieces. Other columns are ignored. No rows give no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = texts.mapInArrow(_count, _COUNTED_SQL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
    kept = materialize(spark, by_term.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "terms")
    each = kept.select("lang", "term", "total", F.explode("found").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    of_group = each.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("long")
    stats = texts.select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    stats = stats.select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("lang_n", zero).alias("lang_n"), F.coalesce("group_n", zero).alias("group_n"), F.monotonically_increasing_id().alias("gid"))
    stats = materialize(spark, stats.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("group_n") + F.col("v")))), "groups")
    told = stats.select("lang", "source", "gid", "v", "p0", "group_n", "lang_n")
    cells = each.join(told, ["lang", "source"]).select("lang", "term", "gid", "p0", share(F.col("n"), F.col("group_n") + F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n") + F.col("v")).alias("q"), _class(F.col("n")).alias("kind"), _class(F.col("total")).alias("of"))
    cells = materialize(spark, cells, "cells")
    names = stats.select("gid", "lang", "source")
    pairs = _pairs(cells, stats.select("lang", "gid", "v", "p0"))
    pairs = pairs.join(stats.select(F.col("gid").alias("h"), F.col("source").alias("item")), "h").join(names.withColumnRenamed("gid", "g"), "g")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = _search(spark, cells.select("gid", "term", "p", "q", "kind", "of"), top).join(names, "gid")
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumns({"part": F.lit("pair"), "rank": place}).select(out).union(terms.withColumn("part", F.lit("term")).withColumnRenamed("term", "item").select(out))
