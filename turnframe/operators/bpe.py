"""Byte-pair tokens of rendered segments, and whose they are.

Each group of text is encoded in one pass, in Arrow batches; a token belongs to the part that its first character is in.
Where a tokenizer gives no offsets, they are inferred by decoding: what is pending is decoded until it is text again, so
that characters of several tokens are settled with work in proportion to the text.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.functions import token_id
from turnframe.plans import segments

#: A batch of tokens is given out at about so many.
BATCH_TOKENS = 1 << 16
_TOKENS = pa.list_(pa.struct([("token_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_PLACED_SQL = "conv_id long, msg_idx int, seg_idx int, tokens array<struct<token_id:bigint,start:int,end:int>>"


def inferred_offsets(decode: Callable[[list[int]], str], ids: list[int], text: str) -> list[tuple[int, int]] | None:
    """(start, end) of each token in text's characters: from the first character that it holds a part of to the last that is whole with it; None where decoding does not give the text."""
    out: list[tuple[int, int]] = []
    at, pending = 0, []
    whole = 0  # characters of the pending tokens that are whole
    for one in ids:
        pending.append(one)
        start, seen = at + whole, decode(pending)
        whole = next((k for k, (x, y) in enumerate(zip(seen, text[at : at + len(seen)])) if x != y), min(len(seen), len(text) - at))
        out.append((start, max(at + whole, min(start + 1, len(text)))))
        if whole == len(seen):
            at, pending, whole = at + whole, [], 0
    return out if at == len(text) and not pending else None


def _backend(path: str, pattern: str | None, offsets: str):
    """text -> (ids, offsets or None), and special text -> id, of a tokenizer file: tokenizers' JSON, or ranks for tiktoken with the pattern that they go with."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = lambda text: (ids := t.encode_ordinary(text), inferred_offsets(t.decode, ids, text) if offsets != "none" else None)
        return encode, len(ranks), lambda special: None
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    def encode(text: str):
        found = t.encode(text, add_special_tokens=False)
        if offsets == "native":
            return found.ids, found.offsets
        return found.ids, inferred_offsets(lambda ids: t.decode(ids, skip_special_tokens=False), found.ids, text) if offsets == "decode" else None

    return encode, t.get_vocab_size(), t.token_to_id


def _encoder(path: str, pattern: str | None, offsets: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size, special = _backend(path, pattern, offsets)

        def made(b: pa.RecordBatch, counts: list[int], ids: list, starts: list, ends: list) -> pa.RecordBatch:
            whole = pa.StructArray.from_arrays([pa.array(x, t) for x, t in ((ids, pa.int64()), (starts, pa.int32()), (ends, pa.int32()))], fields=list(_TOKENS.value_type))
            tokens = pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), whole)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), tokens.cast(_TOKENS)], names=["conv_id", "msg_idx", "seg_idx", "tokens"])

        for b in it:
            lo, counts, columns = 0, [], (array("q"), [], [])
            for k in range(b.num_rows):
                kind, text, other = (b.column(c)[k].as_py() for c in (3, 4, 5))
                if kind == "S":
                    known = special(text)
                    ids, places = [size + other if known is None else known], [(0, len(text))]
                else:
                    ids, places = encode(text)
                counts.append(len(ids))
                columns[0].extend(ids)
                columns[1].extend(x for x, _ in places) if places else columns[1].extend([None] * len(ids))
                columns[2].extend(x for _, x in places) if places else columns[2].extend([None] * len(ids))
                if len(columns[0]) >= BATCH_TOKENS:  # what is held does not grow with the rows of a batch
                    yield made(b.slice(lo, k + 1 - lo), counts, *columns)
                    lo, counts, columns = k + 1, [], (array("q"), [], [])
            if counts:
                yield made(b.slice(lo), counts, *columns)

    return run


def attribute_segments(segs: DataFrame, path: str, pattern: str | None = None, offsets: str = "native", overlap: bool = False) -> DataFrame:
    """(conv_id, pos, token_id, owner, sampled, content, msg_idx, seg_idx, start, end) of segments (see plans), start and end in the segment's characters.

    path: a tokenizer's file, which executors must have as well. offsets: native, decode (inferred) or none. content is
    whether a token's first character is body, or with overlap any of its characters; sampled tokens are content; it is
    null where offsets are not known, while the ids are the same. A special token that the vocabulary lacks has its
    lexical id beyond the vocabulary. Empty groups have no tokens.
    """
    keys = ["conv_id", "msg_idx", "seg_idx"]
    texts = segs.where(F.length("text") > 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("msg_idx").cast("int").alias("msg_idx"), F.col("seg_idx").cast("int").alias("seg_idx"), "kind", "text", token_id(F.col("text")).alias("other"))
    placed = texts.mapInArrow(_encoder(path, pattern, offsets), _PLACED_SQL)
    rows = placed.select(*keys, F.posexplode("tokens").alias("k", "t")).select(*keys, "k", "t.*")
    rows = rows.join(segs.select(*keys, "owner", "sampled", "content_from", "content_to", F.length("text").alias("size")), keys)
    order = Window.partitionBy("conv_id").orderBy("msg_idx", "seg_idx", "k")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "token_id", "owner", "sampled", _content(overlap).alias("content"), "msg_idx", "seg_idx", "start", "end")


def _content(overlap: bool) -> Column:
    start, end, lo, hi = (F.col(c) for c in ("start", "end", "content_from", "content_to"))
    first = (start >= lo) & (start < hi)
    past = (hi == F.col("size")) & (hi > lo)
    body = F.when(start >= F.col("size"), past).when(F.lit(overlap) & (end > start), (hi > lo) & (lo < end) & (start < hi)).otherwise(first)
    return F.when(start.isNull(), None).otherwise(F.col("sampled") | body)


def bpe_tokens(messages: DataFrame, family: str, path: str, pattern: str | None = None, offsets: str = "native", overlap: bool = False) -> DataFrame:
    """attribute_segments() of rendered messages."""
    return attribute_segments(segments(messages, family), path, pattern, offsets, overlap)


def covered(toks: DataFrame) -> DataFrame:
    """toks with chars, the characters that a token is the first to reach: bytes of one character may be several tokens."""
    earlier = Window.partitionBy("conv_id", "msg_idx", "seg_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    return toks.withColumn("chars", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
