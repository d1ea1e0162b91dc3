"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of one to DEPTH words. A context is a candidate if at least LEAST_CONTEXT training tokens follow it, and
is kept if what follows it diverges enough from what its suffix says. A token is scored in the longest kept context that it
stands in; words that a context does not list take its back-off weight times their probability in the context's suffix,
down to the smoothed unigram. The least counts are fixed, so the tree grows with the corpus; it is never in one place:
documents are dealt to shards, and each shard sends the sorted keys of its own words, pairs of context and word, or contexts,
with what it counted of them, in ranges of keys. A range is summed over all shards, and the sums go back to each shard in
the order of its keys. A longer context is only counted where the shorter one is listed, so each depth moves fewer keys.
Each range numbers its words, or the pairs in it that can be contexts, and a pair travels as the number of its context, sorted,
and that of its word, so that a context is written once for all words after it (for each of a few groups of them, where it is
frequent, so that no range holds too much of it).

Words are told apart by 64-bit hashes, pairs within a range by 64-bit hashes of their numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.common import bucketed, many_word_hashes, mix

FOLDS, HELD_OUT = 7, 2
#: The longest contexts, in words.
DEPTH = 3
#: Training tokens that must follow a context, and occurrences of a word after it that make it listed there.
LEAST_CONTEXT, LEAST_NEXT = 32, 3
DISCOUNT = 0.5
#: Least gain in nats, over all occurrences of a context, for which it becomes a state.
GAIN = 20.0
#: Text of one shard, about; a longer text is a shard by itself, and shards are smaller where there would be too few for all cores.
SHARD_MB = 8
#: A range of keys holds about as many as this many shards send.
SHARDS_PER_PART = 3
#: Buckets a shard, so that few hold several shards, whose rows a task would read at once.
BUCKETS = 4
#: A context that more training tokens follow is in several ranges, by the numbers of its words; a power of two.
SPLIT = 1 << 16
#: What stands for the end of a text, as its last token, and for its begin, as context of its first.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: What is sent of gains, in nats, of probabilities and of back-off weights are whole numbers of such parts, so that sums do not depend on their order.
_GAIN_UNITS, _SHARE_UNITS, _WEIGHT_UNITS, _NO_STATE = 2.0**24, 2.0**40, 2.0**32, 1 << 40
_NEXT = np.uint64(0xD1342543DE82EF95)


#: The least values that 1, 2 and 4 bytes don't hold.
_WIDER = {"u": np.array([1 << 8, 1 << 16, 1 << 32], np.uint64), "i": np.array([1 << 7, 1 << 15, 1 << 31], np.uint64)}


def packed_runs(x: np.ndarray, bounds: np.ndarray, ascending: bool = False) -> list[bytes]:
    """Runs of an array (none empty, from each bound to the next), each in few bytes: how many there are and how wide, then the first bytes of all, the second bytes and so on, compressed; ascending ones by their differences."""
    starts = bounds[:-1]
    if not len(starts):
        return []
    if ascending:
        gaps = np.diff(x, prepend=x.dtype.type(0))
        gaps[starts] = x[starts]
        x = gaps
    x = np.ascontiguousarray(x)
    if x.dtype.kind in "iu":
        greatest = np.maximum.reduceat(x if x.dtype.kind == "u" else np.where(x < 0, ~x, x), starts).astype(np.uint64)
        widths = 1 << np.searchsorted(_WIDER[x.dtype.kind], greatest, "right")
    else:
        widths = np.full(len(starts), x.dtype.itemsize)
    zstd = pa.Codec("zstd")
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, : widths.max()].T)
    return [(hi - lo).to_bytes(7, "little") + bytes([w]) + zstd.compress(planes[:w, lo:hi].tobytes(), asbytes=True) for w, lo, hi in zip(widths.tolist(), starts.tolist(), bounds[1:].tolist())]


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """A whole array as one run; nothing for an empty one."""
    return packed_runs(x, np.array([0, len(x)]), ascending)[0] if len(x) else b""


def unpacked_runs(runs: list[bytes], dtype: type, ascending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Runs of integers, one after the other, and their bounds."""
    zstd, sizes = pa.Codec("zstd"), np.array([int.from_bytes(b[:7], "little") for b in runs], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    widths = np.array([b[7] if b else 1 for b in runs], np.int64)
    wide = int(widths.max(initial=1))
    planes = np.zeros((wide, bounds[-1]), np.uint8)
    for b, w, lo, hi in zip(runs, widths.tolist(), bounds.tolist(), bounds[1:].tolist()):
        if lo < hi:
            planes[:w, lo:hi] = np.frombuffer(zstd.decompress(memoryview(b)[8:], w * (hi - lo)), np.uint8).reshape(w, hi - lo)
    x = np.ascontiguousarray(planes.T).view(f"u{wide}").ravel()
    del planes
    if np.dtype(dtype).kind == "i":
        if widths.min(initial=wide) < wide:  # narrower ones get their signs
            unused = np.repeat((8 * (wide - widths)).astype(np.int8), sizes)
            x <<= unused.view(np.uint8)
            x = x.view(f"i{wide}")
            x >>= unused
        x = x.view(f"i{wide}").astype(np.int64, copy=False)
    else:
        x = x.astype(np.uint64, copy=False)
    if ascending:
        np.cumsum(x, out=x)
        x -= np.repeat(np.append(np.uint64(0), x)[bounds[:-1]], sizes)
    return x, bounds


def unpacked(b: bytes | None, dtype: type, ascending: bool = False) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    if np.dtype(dtype).kind in "iu":
        return unpacked_runs([b], dtype, ascending)[0].astype(dtype, copy=False)
    n, width = int.from_bytes(b[:7], "little"), b[7]
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(b)[8:], n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def joined(parts: list[bytes] | None, dtype: type) -> np.ndarray:
    if np.dtype(dtype).kind in "iu":
        return unpacked_runs(parts or [], dtype)[0]
    return np.concatenate([np.zeros(0, dtype), *(unpacked(b, dtype) for b in parts or ())])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


_ENCODED = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("ids", pa.binary())])
_ENCODED_SQL = "shard long, doc_ids array<long>, sizes array<long>, words binary, ids binary"


#: Rows that are encoded at once.
_ROWS = 256


def _encoder(limit: int):
    """Texts to shards of about limit bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard as one row: its words' hashes, sorted, and its texts as numbers of them, each with BEGIN before and END after it."""
        from pyspark import TaskContext

        shard, held, doc_ids, sizes, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            words = np.unique(np.concatenate([w for w, _ in held]))
            ids = np.concatenate([np.searchsorted(words, w).astype(np.int32)[at] for w, at in held])
            columns = ([shard], [doc_ids], [np.concatenate(sizes)], [packed(words, True)], [packed(ids)])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENCODED)], schema=_ENCODED)

        for b in (b.slice(at, _ROWS) for b in it for at in range(0, b.num_rows, _ROWS)):
            docs = b.column(0).to_pylist()
            texts = pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary())
            for lo, hi, h, text in many_word_hashes(texts):
                n = np.bincount(text - lo, minlength=hi - lo)
                first = np.cumsum(n + 2) - n - 2
                sequence = np.full(len(h) + 2 * (hi - lo), END)
                sequence[first] = BEGIN
                sequence[np.arange(len(h)) + 2 * (text - lo) + 1] = h
                # the words of a group of texts are told apart here, those of the shard among these only
                words, at = np.unique(sequence, return_inverse=True)
                held.append((words, at.astype(np.int32)))
                sizes.append(n + 2)
                doc_ids += docs[lo:hi]
                size += sum(pc.binary_length(texts.slice(lo, hi - lo)).to_pylist())
                if size >= limit:
                    yield row()
                    shard, held, doc_ids, sizes, size = shard + 1, [], [], [], 0
        if held:
            yield row()

    return run


def keys_of(numbers: np.ndarray, parts: int) -> np.ndarray:
    """A key of each number, in the range of keys that gave it; numbers of one range are close to each other there, so that differences of keys are small."""
    rank, part = np.divmod(numbers.astype(np.uint64), np.uint64(parts))
    return (((part << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts) << np.uint64(32)) + rank


def _marked(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flags[at], False where at is -1."""
    return np.append(flags, False)[at]


#: Tokens that are gone through at once, where more would need much memory.
_TOKENS = 1 << 18


class Level:
    """The contexts of one depth in a shard, and the pairs of them and a next word that can be listed. A context of d words is a
    pair of the depth before, one token earlier, so it goes by that pair's number in the shard, and nothing is sorted for it.

    n: how often training has each pair, 0 of those that are not listed; None before the counts of this depth are there."""

    def __init__(self, s: Shard, depth: int, before: Shard | Level):
        self.totals = before.n
        follows = _marked(before.n >= LEAST_CONTEXT, before.pair_of[:-1])
        follows &= s.place[1:] >= depth
        #: Tokens after a context that training has often enough, and their contexts.
        self.after = np.flatnonzero(follows).astype(np.int32)
        self.context = before.pair_of[self.after]
        self.after += 1
        used = np.zeros(len(before.n), bool)
        used[self.context] = True
        used = np.flatnonzero(used).astype(np.int32)
        hashes = keys_of(before.numbers_after[used], s.parts)
        order = np.argsort(hashes)
        #: The contexts, in the order of their keys, and of each its place in it.
        self.used, self.hashes = used[order], hashes[order]
        self.rank = np.zeros(len(before.n), np.int32)
        self.rank[self.used] = np.arange(len(used), dtype=np.int32)
        self.n, self.numbers_after = s.counts(depth)
        can = _marked(before.n >= LEAST_NEXT, before.pair_of[self.after])
        self._pairs(s, can)

    def _pairs(self, s: Shard, can: np.ndarray) -> None:
        at, rank = self.after[can], self.rank[self.context[can]]
        # a frequent context is several keys, by the last bits of its words' numbers
        splits = np.int64(1) << np.ceil(np.log2(np.maximum(self.totals[self.used] / SPLIT, 1))).astype(np.int64)
        first = np.cumsum(splits) - splits
        of = np.repeat(np.arange(len(splits)), splits)
        turn = np.arange(len(of)) - first[of]
        # keys of neighbours are numbers in a row, so they are scattered before a turn is added
        keys = np.where(turn == 0, self.hashes[of], mix(mix(self.hashes[of]) + turn.astype(np.uint64)))
        order = np.argsort(keys)
        by_key = np.empty(len(keys), np.int32)
        by_key[order] = np.arange(len(keys), dtype=np.int32)
        if len(keys) == len(splits):
            key = by_key[rank]
        else:
            key = s.number[s.ids[at]].view(np.int64)
            key &= (splits - 1)[rank]
            key += first[rank]
            key = by_key[key]
        del rank
        words, places = len(s.number).bit_length(), len(at).bit_length()
        if len(keys).bit_length() + words + places <= 64:  # one sort of values
            both = key.astype(np.uint64)
            del key
            both <<= np.uint64(words)
            both |= s.word_rank[s.ids[at]]
            both <<= np.uint64(places)
            for lo in range(0, len(at), _TOKENS):
                both[lo : lo + _TOKENS] |= np.arange(lo, min(lo + _TOKENS, len(at)), dtype=np.uint64)
            both.sort()
            turn = (both & np.uint64((1 << places) - 1)).astype(np.int32)
            both >>= np.uint64(places)
            new = np.concatenate((np.ones(min(1, len(at)), bool), both[1:] != both[:-1]))
            both = both[new]
            key, word = (both >> np.uint64(words)).view(np.int64), (both & np.uint64((1 << words) - 1)).view(np.int64)
        else:
            word = s.word_rank[s.ids[at]]
            turn = np.lexsort((word, key))
            key, word = key[turn], word[turn]
            new = np.concatenate((np.ones(min(1, len(at)), bool), (key[1:] != key[:-1]) | (word[1:] != word[:-1])))
            key, word = key[new], word[new]
        #: Of each pair, in the order of keys and words' numbers: its context, and one token; before it is counted, its key and its word's number.
        self.context_of, self.one = self.used[of[order[key]]], at[turn[new]]
        if self.n is None:
            self.keys, self.numbers = keys[order[key]], s.sorted_numbers[word]
        self.pair_of = np.full(len(s.ids), -1, np.int32)
        self.pair_of[at[turn]] = np.cumsum(new, dtype=np.int32) - 1


class Shard:
    """The tokens of one shard, and what counts and states say of each. Of the exchanges so far a row has n_0 and id_0, the counts
    and numbers of its words, n_d and own_n_d, the counts of its candidate pairs of depth d and which of them it answers for, and
    s_d, the back-off weights of its contexts. All are in the order of their keys.

    Only the deepest level so far is held; what its states say of tokens goes to the scores before the next one replaces it."""

    def __init__(self, row: dict, total: int, distinct: int, parts: int):
        self.shard, self.doc_ids, sizes = row["shard"], row["doc_ids"], np.array(row["sizes"], np.int64)
        self.ids, self.total, self.distinct, self.parts, self.row = unpacked(row["ids"], np.int32), total, distinct, parts, row
        self.first = np.cumsum(sizes) - sizes
        # 0 is BEGIN; places beyond the longest context are alike
        self.place = np.full(len(self.ids), 255, np.uint8)
        for k in range(min(255, int(sizes.max(initial=0)))):
            self.place[self.first[sizes > k] + k] = k
        self.train = np.repeat(~np.array([held_out(d) for d in self.doc_ids], bool), sizes)
        self.now, self.depth, self.scores, self.scored = self, 0, None, 0
        if "n_0" in row:  # words are pairs of no context
            self.pair_of, (self.n, self.number) = self.ids, self.counts(0)
            self.numbers_after, self.number = self.number, self.number.view(np.uint64)
            order = np.argsort(self.number)
            self.sorted_numbers, self.word_rank = self.number[order], np.empty(len(order), np.uint32)
            self.word_rank[order] = np.arange(len(order), dtype=np.uint32)

    def counts(self, depth: int) -> tuple[np.ndarray | None, np.ndarray | None]:
        """How often training has each pair of a depth, and the numbers of those that can be contexts, as far as they were exchanged; on the way there those of pairs are from 1."""
        if f"n_{depth}" not in self.row:
            return None, None
        return joined(self.row[f"n_{depth}"], np.int64), joined(self.row[f"id_{depth}"], np.int64) - (depth > 0)

    def level(self, depth: int) -> Level:
        """The level of a depth, which is not before the last one asked for."""
        while self.depth < depth:
            if f"s_{self.depth}" in self.row:
                self.log_probabilities(self.depth)
            self.now, self.depth = Level(self, self.depth + 1, self.now), self.depth + 1
        return self.now

    def log_probabilities(self, depth: int) -> np.ndarray:
        """log10 probability of each token by the states of up to depth words; depth is not before the last one asked for. The array is changed by deeper ones."""
        if self.scores is None:
            self.scores = np.log10((self.n + 1) / (self.total + self.distinct + 1))[self.ids]
        while self.scored < depth:
            self.scored += 1
            level, back_off = self.level(self.scored), weights(joined(self.row[f"s_{self.scored}"], np.int64))
            listed = np.where(level.n >= LEAST_NEXT, np.log10(np.maximum(level.n - DISCOUNT, DISCOUNT) / level.totals[level.context_of]), np.nan)
            listed = np.append(listed, np.nan)
            for at in range(0, len(level.after) if len(back_off) else 0, _TOKENS):
                after = level.after[at : at + _TOKENS]
                off, said, before = back_off[level.rank[level.context[at : at + _TOKENS]]], listed[level.pair_of[after]], self.scores[after]
                self.scores[after] = np.where(np.isnan(off), before, np.where(np.isnan(said), before + off, said))
        return self.scores


_SENT = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary()), ("sums", pa.list_(pa.binary()))])
_SENT_SQL = "kind int, part long, shard long, keys binary, numbers binary, sums array<binary>"


def _in_parts(shard: int, keys: np.ndarray, numbers: np.ndarray | None, sums: np.ndarray, parts: int) -> Iterator[tuple]:
    """Sorted keys and what belongs to them (rows of sums), cut into ranges of keys."""
    # the first key of each range
    least = np.array([((k << 32) + parts - 1) // parts << 32 for k in range(1, parts)], np.uint64)
    ends = np.concatenate(([0], np.searchsorted(keys, least), [len(keys)]))
    full = np.flatnonzero(ends[1:] > ends[:-1])
    bounds = np.append(ends[full], len(keys))
    columns = [packed_runs(keys, bounds, True), packed_runs(numbers, bounds) if numbers is not None else [b""] * len(full)]
    return zip(full.tolist(), [shard] * len(full), *columns, zip(*(packed_runs(x, bounds) for x in sums)))


def _over_shards(total: int, distinct: int, sends: list[Callable[[Shard], tuple[np.ndarray, np.ndarray | None, np.ndarray]]], parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                s = Shard(b.slice(k, 1).to_pylist()[0], total, distinct, parts)
                for kind, send in enumerate(sends):
                    rows = [(kind, *row) for row in _in_parts(s.shard, *send(s), parts)]
                    if not rows:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

    return run


def _send_words(s: Shard) -> tuple[np.ndarray, None, np.ndarray]:
    words = unpacked(s.row["words"], np.uint64, True)
    return words, None, np.bincount(s.ids[s.train], minlength=len(words))[None, :]


def _send_pairs(depth: int):
    def send(s: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        level = s.level(depth)
        use = s.train & (level.pair_of >= 0)
        return level.keys, level.numbers, np.bincount(level.pair_of[use], minlength=len(level.keys))[None, :]

    return send


def _send_contexts(depth: int):
    """Of each context, its total, and over those of its pairs that this shard answers for: how many, how often they are there, gain, and probability in the suffix."""

    def send(s: Shard) -> tuple[np.ndarray, None, np.ndarray]:
        level = s.level(depth)
        pairs = np.flatnonzero((level.n >= LEAST_NEXT) & joined(s.row[f"own_n_{depth}"], np.bool_))
        n, context = level.n[pairs], level.context_of[pairs]
        which, suffix = level.rank[context], 10 ** s.log_probabilities(depth - 1)[level.one[pairs]]
        gain = n * np.log(n / level.totals[context] / suffix)
        sums = [np.bincount(which, x, len(level.used)) for x in (np.ones(len(n)), n, gain * _GAIN_UNITS, suffix * _SHARE_UNITS)]
        return level.hashes, None, np.rint(np.stack([level.totals[level.used], *sums])).astype(np.int64)

    return send


def _summed(answers: list[Callable[..., list[np.ndarray]]], parts: int):
    """Sums of one range of keys over all shards, and for each shard what answer makes of them, in the order of its keys."""

    def run(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        table = table.sort_by("shard")
        shards = table.column("shard").to_numpy()
        same, bounds = unpacked_runs(table.column("keys").to_pylist(), np.uint64, True)
        same *= _NEXT
        numbers = table.column("numbers").to_pylist()
        if numbers[0]:
            same += joined(numbers, np.uint64)
        same = mix(same)
        order = np.argsort(same)
        same = same[order]
        new = np.append(True, same[1:] != same[:-1])
        which = np.empty(len(order), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        del same, order, new
        flat = [joined(row, np.int64) for row in zip(*table.column("sums").to_pylist())]
        found = np.stack([np.bincount(which, x) for x in flat])
        # the least shard that sent a key answers for it
        first = np.empty(found.shape[1], np.int32)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1, dtype=np.int32)
        own = np.zeros(len(which), bool)
        own[first] = True
        columns = answers[kind](found[:, which], flat[0], own)
        if answers[kind] is not _answer_states:
            # the words, or pairs that can be contexts, of a range are numbered from the most frequent on, so that frequent ones have small numbers in all ranges
            rank = np.empty(found.shape[1], np.int64)
            rank[np.argsort(-found[0], kind="stable")] = np.arange(found.shape[1])
            number = rank * parts + part
            columns.append((number if answers[kind] is _answer_counts else np.where(found[0] >= LEAST_CONTEXT, number + 1, 0))[which])
        cut = [packed_runs(x, bounds) for x in columns] + [[b""] * len(shards)] * 2
        return pa.table({"shard": shards, "kind": table.column("kind"), "part": table.column("part"), **{n: pa.array(c, pa.binary()) for n, c in zip(("values", "own", "numbers"), cut)}})

    return run


def _answer_counts(found: np.ndarray, one: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    return [np.rint(found[0]).astype(np.int64), own]


def _answer_listed(found: np.ndarray, one: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    n = np.rint(found[0]).astype(np.int64)
    return [np.where(n >= LEAST_NEXT, n, 0), own]


def _answer_states(found: np.ndarray, one: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """The divergence test: back-off weights of contexts that list a word and gain enough, in units; _NO_STATE of others."""
    _, words, n, gain, suffix = found
    gain, suffix = gain / _GAIN_UNITS, suffix / _SHARE_UNITS
    rest, suffix_rest = 1 - n / one, np.maximum(1 - suffix, 1e-9)
    gain = gain + np.where(rest > 1e-9, one * rest * np.log(np.maximum(rest, 1e-9) / suffix_rest), 0.0)
    weight = np.log10(np.maximum(1 - (n - DISCOUNT * words) / one, 1e-9) / suffix_rest)
    return [np.where((words > 0) & (gain >= GAIN), np.rint(weight * _WEIGHT_UNITS), _NO_STATE).astype(np.int64)]


def weights(x: np.ndarray) -> np.ndarray:
    """Back-off weights from their units; NaN where there is no state."""
    return np.where(x == _NO_STATE, np.nan, x / _WEIGHT_UNITS)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(depth: int, total: int, distinct: int, parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                s = Shard(b.slice(k, 1).to_pylist()[0], total, distinct, parts)
                token, held = s.place > 0, [held_out(d) for d in s.doc_ids]
                said = (lambda: token.astype(np.int64), lambda: (token & (s.n > 0)[s.ids]).astype(np.int64), lambda: s.log_probabilities(0), lambda: s.log_probabilities(depth))
                columns = [np.add.reduceat(np.where(token, x(), 0), s.first) for x in said]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((s.doc_ids, held, *columns[:2], np.full(len(held), total), *columns[2:]), _SCORED)], schema=_SCORED)

    return run


def dealt(size: int, cores: int) -> tuple[int, int, int]:
    """For whole texts of size bytes: the bytes of a shard, how many shards about, and how many ranges of keys. Each shard sends a row to each range."""
    limit = min(SHARD_MB << 20, max(1 << 20, size // (2 * cores)))
    shards = max(1, -(-size // limit))
    return limit, shards, -(-shards // SHARDS_PER_PART)


def language_model_scores(spark: SparkSession, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    A null or empty text is the end token alone; a null doc_id is not held out; repeated rows are counted and scored as they
    stand; a very long text is a shard by itself, whatever its size; other columns of docs are left out, whatever their
    names. Without training tokens every token has probability 1 / (0 + 0 + 1), so all scores are 0. No rows give no rows.
    """
    limit, shards, parts = dealt(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, spark.sparkContext.defaultParallelism)
    buckets = BUCKETS * shards
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = bucketed(spark, texts.mapInArrow(_encoder(limit), _ENCODED_SQL), "shard", buckets, "suffixtree", move=False, codec="zstd")

    def exchange(table: DataFrame, steps: list[tuple[Callable, Callable, str]], total: int = 0, distinct: int = 0) -> DataFrame:
        """What all shards together say of the keys of each, for each step as columns value and own_value of a row a shard."""
        sent = table.mapInArrow(_over_shards(total, distinct, [send for send, _, _ in steps], parts), _SENT_SQL)
        summed = sent.groupBy("kind", "part").applyInArrow(_summed([answer for _, answer, _ in steps], parts), "shard long, kind int, part long, values binary, own binary, numbers binary")
        whole = summed.repartition(buckets, "shard").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("kind", "part", "values", "own", "numbers"))).alias("all"))
        columns = []
        for kind, (_, _, name) in enumerate(steps):
            mine = F.filter("all", _of_kind(kind))
            columns += [mine[c].alias(n) for c, n in (("values", name), ("own", f"own_{name}"), ("numbers", name.replace("n_", "id_")))][: 3 if name.startswith("n_") else 1]
        return bucketed(spark, whole.select("shard", *columns), "shard", buckets, "suffixtree", move=False, codec="zstd")

    words = exchange(table, [(_send_words, _answer_counts, "n_0")])
    sizes = table.join(words, "shard").select("words", "n_0", "own_n_0").mapInArrow(_training_size, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    total, distinct = (int(x or 0) for x in sizes)
    table = table.drop("words").join(words.select("shard", "n_0", "id_0"), "shard")
    for d in range(1, depth + 2):
        # the pairs of a depth need the counts of the one before; contexts need the states of the one before and their own counts
        steps = [(_send_contexts(d - 1), _answer_states, f"s_{d - 1}")] if d > 1 else []
        steps += [(_send_pairs(d), _answer_listed, f"n_{d}")] if d <= depth else []
        table = table.join(exchange(table, steps, total, distinct), "shard", "left").drop(f"own_n_{d - 1}")
    return table.mapInArrow(_scorer(depth, total, distinct, parts), _SCORED_SQL)


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind


def _training_size(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens, and distinct ones, among the words that a shard answers for."""
    for b in it:
        for words, n, own in zip(*(c.to_pylist() for c in b.columns)):
            use = joined(own, np.bool_) & (unpacked(words, np.uint64, True) != BEGIN)
            found = joined(n, np.int64)[use]
            yield pa.RecordBatch.from_arrays([pa.array([int(found.sum())]), pa.array([int((found > 0).sum())])], names=["tokens", "words"])
