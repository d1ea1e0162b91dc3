"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnframe.llm.common import batches, materialize

LENGTH = 4096
END_ID = 1
#: Bins that one packer holds open. When it needs one more, the fullest closes.
OPEN_BINS = 64
#: Sequences that one packer makes, about: many times its open bins, so that those left at its end are a small share.
SEQUENCES_PER_PACKER = 8192
#: Text that is split into words at once, about; a longer text is split by itself.
GROUP_BYTES = 4 << 20
#: Distinct words whose ids a task holds. Beyond that it forgets them all and encodes what it meets anew, so this drops nothing.
KNOWN_WORDS = 400_000
#: It drops white space and merges nothing across it, and cuts between a letter and what is in TAIL.
VOCABULARY = "word_bpe_49k.json"
TAIL = ".,;:!?#$%&*"
#: A word of one id, which stands between words that are encoded together.
MARK = "♥"

PIECES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))])


def _is_letters(word: str) -> bool:
    """Whether a word is lower-case letters of Latin, Greek or Cyrillic script, composed."""
    return word.isascii() and word.isalpha() and word.islower() or word.isalpha() and word.islower() and max(word) < "\u0500" and unicodedata.is_normalized("NFC", word)


class WordEncoder:
    """ids of texts, for a tokenizer that drops white space and cuts between letters and punctuation: a text's ids are those of its words in order.

    Arrow splits many texts, lists their distinct words and cuts last punctuation off those in ASCII, which also are
    lower-cased, as the tokenizer does; a word that may hold an added token stays as it is. What is then not known is encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        # a word of lower-case letters is one part, which only the model changes
        self.letters = Tokenizer(self.tokenizer.model)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where those of each end."""
        listed = pc.fill_null(pc.ascii_split_whitespace(texts), [])
        words = listed.flatten().dictionary_encode()
        cores, tails = self._cut(words.dictionary)
        parts = self._numbers(pa.concat_arrays([cores, tails])).reshape(2, -1).T[words.indices.to_numpy()].ravel()
        sizes = self.sizes[parts]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[parts] - ends[:-1], sizes)
        at += np.arange(ends[-1])
        return self.ids[at], ends[2 * np.cumsum(pc.list_value_length(listed).to_numpy())]

    @staticmethod
    def _cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        stems = pc.utf8_rtrim(words, TAIL)
        cut = pc.and_(plain, pc.match_substring_regex(stems, "[A-Za-z]$"))
        cores = pc.if_else(plain, pc.ascii_lower(pc.if_else(cut, stems, words)), words)
        return cores, pc.if_else(cut, pc.struct_field(pc.extract_regex(words, f"(?P<tail>[{TAIL}]*)$"), "tail"), "")

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        listed = parts.dictionary_encode()
        words = listed.dictionary.to_pylist()
        if len(self.number) + len(words) > KNOWN_WORDS:
            self.forget()
        new = [w for w in words if w not in self.number]
        new.sort(key=_is_letters)
        plain = sum(map(_is_letters, new))
        rest = len(new) - plain
        found = [self._encode_words(new[at : min(rest, at + 1024)]) for at in range(0, rest, 1024)] + [self._encode_letters(new[at : at + 1024]) for at in range(rest, len(new), 1024)]
        sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, *(ids for ids, _ in found)))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[listed.indices.to_numpy()]

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        e = self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(e.ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, and how many each has; together, with MARK between them, or one by one where a word holds its id as well."""
        if self.mark is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            marks = ids == self.mark
            cuts = np.flatnonzero(marks)
            if len(cuts) == len(words) - 1:
                return ids[~marks], np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)


class TextEncoder:
    """ids of texts, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([len(x) for x in found])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Each document's ids and END_ID, cut into pieces of at most length: doc_id, piece, start, length, ids_crc32 (and ids as binary).

    vocabulary is the path of a tokenizer; whole texts are encoded with it. Only VOCABULARY, the default, goes word by word.
    """
    schema = T.StructType(PIECES.fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def rows(b: pa.RecordBatch, encode: Callable) -> Iterator[tuple]:
        doc_ids, texts = b.column(0).to_pylist(), b.column(1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        groups = np.flatnonzero(np.diff(sizes // GROUP_BYTES)) + 1
        for lo, hi in zip([0, *groups.tolist()], [*groups.tolist(), len(doc_ids)]):
            ids, ends = encode(texts.slice(lo, hi - lo))
            data, begin = memoryview(ids.astype("<u4").tobytes()), 0
            for doc, end in zip(doc_ids[lo:hi], ends.tolist()):
                n = end - begin + 1
                for k, at in enumerate(range(0, n, length)):
                    part, last = data[4 * (begin + at) : 4 * min(end, begin + at + length)], at + length >= n
                    tail = END_ID.to_bytes(4, "little") if last else b""
                    row = (doc, k, at, min(length, n - at), zlib.crc32(tail, zlib.crc32(part)))
                    yield (*row, bytes(part) + tail) if with_ids else row
                begin = end

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(vocabulary) if vocabulary else WordEncoder(vocabulary_path())
        for b in it:
            yield from batches(rows(b, encoder.encode), arrow, 2000 if with_ids else 20_000)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class Bins:
    """Open bins by free space: a bitset of the free spaces that some bin has, and the bins of each."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.free, self.by_free, self.made = length, most, 0, 0, {}, 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece: the open bin that it fills best, else a new one."""
        if fits := self.free >> size:
            space = (fits & -fits).bit_length() - 1 + size
            sequence = self._take(space)
        else:
            sequence, space = self.made, self.length
            self.made += 1
        left = space - size
        if left:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            self.by_free.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.length - space

    def _take(self, space: int) -> int:
        """A bin with this free space, which is no longer open."""
        bins = self.by_free[space]
        sequence = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return sequence


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Pieces are dealt by a hash to packers of about SEQUENCES_PER_PACKER sequences; each takes its own online, in the order
    of another hash, and holds only its open bins. sequence_id is packer * 2**32 + number. A null or empty text is the one
    id END_ID; a very long one is cut into pieces like any other; a row with a null doc_id is packed as well; repeated rows
    are packed once each; among bins that a piece fills equally well it goes to the last one opened; other columns of docs
    are left out; no rows give no rows.
    """
    cut = materialize(spark, pieces(docs, vocabulary, length, with_ids), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // (length * SEQUENCES_PER_PACKER)))
    dealt = cut.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(packers)).cast("long")).withColumn("turn", F.xxhash64("piece", "doc_id", "start"))
    dealt = dealt.repartition(packers, "packer").sortWithinPartitions("packer", "turn", "doc_id", "piece")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, now = None, None
        for b in it:
            sequences, offsets = [], []
            for packer, size in zip(b.column("packer").to_pylist(), b.column("length").to_pylist()):
                if packer != now:
                    bins, now = Bins(length, open_bins), packer
                sequence, offset = bins.place(size)
                sequences.append((packer << 32) + sequence)
                offsets.append(offset)
            kept = b.select([c for c in b.schema.names if c not in ("packer", "turn")])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*kept.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
