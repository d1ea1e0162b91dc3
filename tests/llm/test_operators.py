"""The operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from turnframe.llm import common, decontaminate, packing, quality, simhash, substrings, suffixarray, suffixtree, toxicity, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash string, words string"


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["er", "an", "th", "ou", "lé", "Z"]) for _ in range(rnd.randint(1, 4)))
    passage = [word() for _ in range(70)]
    texts = [None, "", "   \n", "one", "two words"]
    for k in range(12):
        body = [word() for _ in range(rnd.randint(5, 160))]
        at = rnd.randint(0, len(body))
        texts.append(" ".join(body[:at] + (passage[: 45 + k * 3] if k % 2 else []) + body[at:]))
    texts += [texts[8], texts[8], texts[9] + " end", "w " * 130 + "x", "w " * 90 + "x", " ".join(word() for _ in range(6000))]
    return [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or ""), "r", "h", "w") for i, t in enumerate(texts)] + [(9, texts[9], "en", "s", 1, "r", "h", "w"), (None, texts[9], "en", "s", 1, "r", "h", "w")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_substrings(spark, docs, rows):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in words:
        for k in range(len(w) - 49):
            if d is not None:
                g = tuple(w[k : k + 50])
                first[g] = min(first.get(g, d), d)
    want = Counter()
    for d, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if d is not None and first[tuple(w[k : k + 50])] < d:
                gone |= set(range(k, k + 50))
        want[d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    assert sum(k[2] for k in want) > 100
    assert Counter(tuple(r)[:4] for r in substrings.remove_repeats(spark, docs).collect()) == want


def test_suffix_array(spark, docs, rows):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    want = Counter()
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[d, len(t), int(gone.sum()), len(common.runs(gone)), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in suffixarray.remove_repeated_bytes(spark, docs).collect()) == want


def plain_repeats(texts):
    """What is left of each text, a 200-byte string at a time."""
    seen, out = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199)), Counter()
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d, len(t), int(gone.sum()), len(common.runs(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [suffixarray.MOST_BYTES, 0, 3000])
def test_repeats_sorted_in_cells_or_over_all(spark, monkeypatch, most):
    """Copies with edits, text of short periods, one passage amid many texts: by cells, by sorts over all partitions, and by both."""
    monkeypatch.setattr(suffixarray, "MOST_BYTES", most)
    monkeypatch.setattr(suffixarray, "CELL_BYTES", 30_000)
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    middle, base = prose(150), [prose(rnd.randint(150, 1500)) for _ in range(12)]
    texts = ["ab" * 400, "ab" * 130 + "c", "x" * 199, "x" * 200, "y" * 201, "é" * 150, prose(40) * 9]
    texts += [prose(rnd.randint(0, 90)) + middle + rnd.choice(base)[:rnd.randint(0, 60)] for _ in range(40)]
    for t in base:
        for _ in range(3):
            at = rnd.randrange(len(t))
            texts.append(t[:at] + rnd.choice(["", "Z", t[:70]]) + t[at:])
    rows = list(enumerate(texts)) + [(None, base[0]), (500, None)]
    want = plain_repeats([(d, (t or "").encode()) for d, t in rows])
    got = Counter(tuple(r)[:5] for r in suffixarray.remove_repeated_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and sum(k[2] for k in want) > 5000


def test_repeats_move_little(spark):
    """Edited copies are sorted only around their edits, so that shuffles stay within four times the text."""
    rnd = random.Random(9)
    base = [[f"{rnd.getrandbits(40):x}" for _ in range(400)] for _ in range(40)]
    rows = [(k, " ".join(w[:at] + [str(k)] + w[at:])) for k, (w, at) in enumerate((w, rnd.randrange(400)) for w in base * 6)]
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = moved()
    assert suffixarray.remove_repeated_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string")).agg({"n_removed": "sum"}).first()[0] > 100_000
    assert moved() - before < 4 * sum(len(t) for _, t in rows)


def plain_fingerprint(text):
    """A bit at a time, by xxhash of joined words."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows):
    got = simhash.near_duplicates(spark, docs).collect()
    fps = {}
    for d, t, *_ in rows:
        fps.setdefault(d, plain_fingerprint(t))
    ids = [d for d in fps if d is not None]
    least = {d: d for d in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    least[a] = least[b] = min(least[a], least[b])
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(least.items())
    assert all(r["fp"] & (1 << 64) - 1 == fps[r["doc_id"]] for r in got) and len(got) == len(rows)


def test_anchors_cover_every_pair_within_three_bits(spark):
    rnd = random.Random(1)
    fps = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        for n in range(5):
            y = x
            for bit in rnd.sample(range(64), n):
                y ^= 1 << bit
            fps += [x, y]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark, spark.createDataFrame([(s,) for s in signed], "fp long"))
    groups = {r["node"]: r["component"] for r in common.connected_components(spark, edges).collect()}
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                assert groups[signed[i]] == groups[signed[j]]


def test_near_copies_are_found_as_by_comparing_all(spark):
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randint(0, 400)}"
    texts, passage = [], [word() for _ in range(30)]
    for size in (6, 12, 30, 80, 200, 600):
        for _ in range(6):
            base = [word() for _ in range(size)] + (passage if size > 100 else [])
            texts.append(base)
            for rate in (0.005, 0.01, 0.02, 0.03, 0.05):
                copy = []
                for w in base:
                    x = rnd.random()
                    copy += [word()] if x < rate / 2 else [] if x < rate * 3 / 4 else [w, word()] if x < rate else [w]
                texts.append(copy)
    texts += [texts[3], [], [], ["one"], ["ONE"], ["one", "two"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, "one")]
    got = simhash.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    group = {}
    for r in got:
        group.setdefault(r["doc_id"], set()).add(r["component_id"])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in ([x.lower() for x in t] for t in texts)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    missed = [p for p in pairs if not group[p[0]] & group[p[1]]]
    assert len(pairs) > 150 and len(missed) <= 0.02 * len(pairs)
    least = list(range(len(sets)))
    for _ in range(4):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert all(least[d] <= min(c) and least[min(c)] == least[d] for d, c in group.items())


def test_no_near_copy_is_left_to_chance(spark):
    """Pairs just over the threshold, in which fingerprints often agree nowhere: every one is linked, and none just under it."""
    rnd = random.Random(31)
    common, rows, linked = [f"c{k}" for k in range(40)], [], []
    for k in range(1500):
        words = [f"w{k}x{j}" for j in range(rnd.choice((8, 24, 49, 104)))] + (common if k % 5 == 0 else [])
        copy = list(words)
        for at in (2, len(words) - 3, len(words) // 2, len(words) // 4, 3 * len(words) // 4):
            trial = [*copy[:at], f"e{k}x{at}", *copy[at + 1 :]]
            x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, trial))
            if len(x & y) >= 0.8 * len(x | y) or k % 10 == 3:
                copy = trial
        if copy == words:
            copy = [*words, f"e{k}"]
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, copy))
        linked.append(len(x & y) >= 0.8 * len(x | y))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 100 < sum(linked) < len(linked)
    assert [k for k, one in enumerate(linked) if (got[2 * k] == got[2 * k + 1]) != one] == []


def test_substring_shards_are_not_copied(spark, docs, monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{k % 977}" for k in range(40_000)).encode()
    table = pa.table({"doc_id": pa.array(range(64), pa.int64()), "text": pa.array([text] * 64, pa.binary())})
    held = pa.total_allocated_bytes()
    next(substrings._windows_of(table))
    assert pa.total_allocated_bytes() - held < table.nbytes // 4
    sizes = []
    monkeypatch.setattr(substrings, "shards_for", lambda docs, column, mb: sizes.append(mb) or 2)
    substrings.remove_repeats(spark, docs, with_text=True)
    substrings.remove_repeats(spark, docs)
    assert sizes[0] < sizes[1]


def test_language_model(spark, docs, rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t, *_ in rows if not held(d) for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    for r in suffixtree.language_model_scores(spark, docs).collect():
        w = [*(next(t for d, t, *_ in rows if d == r["doc_id"]) or "").encode().lower().split(), b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(x in counts for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] <= 0


def test_scores_follow_a_plain_suffix_tree(spark):
    rnd = random.Random(6)
    sentence = "the cat sat on the mat and the dog sat on the log".split()
    texts = [" ".join(rnd.choice(sentence + [f"w{rnd.randint(0, 9)}"]) for _ in range(rnd.randint(1, 9))) if i % 4 == 0 else " ".join(sentence[rnd.choice([0, 0, 3, 6]) : rnd.randint(7, 13)]) for i in range(700)]
    got = {r["doc_id"]: r["score"] for r in suffixtree.language_model_scores(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3).collect()}
    begin, end = "<", ">"
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    said = [[begin, *t.split(), end] for t in texts]
    words = Counter(w for d, s in enumerate(said) if not held(d) for w in s[1:])
    n, v, docs = sum(words.values()), len(words), sum(not held(d) for d in range(len(said)))
    after = {}
    for d, s in enumerate(said):
        for k in range(1, len(s)):
            for depth in range(1, min(3, k) + 1):
                if not held(d):
                    after.setdefault(tuple(s[k - depth : k]), Counter())[s[k]] += 1
    total = lambda c: docs if c == (begin,) else words[c[0]] if len(c) == 1 else sum(after.get(c, {}).values())
    states = {}

    def listed(c):
        """The words that a context lists: often enough after it, and listed after its suffix."""
        shorter = words if len(c) == 1 else listed(c[1:]) if total(c[1:]) >= suffixtree.LEAST_CONTEXT else {}
        return {w: m for w, m in after.get(c, {}).items() if m >= suffixtree.LEAST_NEXT and shorter.get(w, 0) >= suffixtree.LEAST_NEXT}

    def p(w, c):
        if not c:
            return (words[w] + 1) / (n + v + 1)
        if c not in states:
            return p(w, c[1:])
        found = listed(c)
        return (found[w] - suffixtree.DISCOUNT) / total(c) if w in found else states[c] * p(w, c[1:])

    for depth in (1, 2, 3):
        for c in [c for c in after if len(c) == depth and total(c) >= suffixtree.LEAST_CONTEXT]:
            found = listed(c)
            if not found:
                continue
            parent = {w: p(w, c[1:]) for w in found}
            mass, rest = sum(parent.values()), 1 - sum(found.values()) / total(c)
            gain = sum(m * math.log(m / total(c) / parent[w]) for w, m in found.items()) + (total(c) * rest * math.log(rest / max(1 - mass, 1e-9)) if rest > 1e-9 else 0)
            if gain >= suffixtree.GAIN:
                states[c] = max(1 - sum((m - suffixtree.DISCOUNT) / total(c) for m in found.values()), 1e-9) / max(1 - mass, 1e-9)
    assert {len(c) for c in states} == {1, 2, 3}
    for d, s in enumerate(said):
        want = sum(math.log10(p(s[k], tuple(s[max(0, k - 3) : k]))) for k in range(1, len(s)))
        assert math.isclose(got[d], want, rel_tol=1e-6), (d, texts[d])


def test_contexts_travel_as_small_numbers():
    """A shard names a context in 2 bytes or less, whatever its depth, and all shards send it to one range."""
    import numpy as np
    import pyarrow as pa

    rnd, parts, n = np.random.default_rng(4), 5, 60_000
    ids = rnd.integers(0, 6_000, n).astype(np.int32)
    numbers = rnd.permutation(8_000)[:6_000]
    row = {"shard": 1, "doc_ids": [1], "sizes": [n], "words": suffixtree.packed(np.sort(rnd.integers(0, 2**63, 6_000)).astype(np.uint64), True), "ids": suffixtree.packed(ids), "n_0": [suffixtree.packed(np.full(6_000, 40))], "id_0": [suffixtree.packed(numbers)]}
    sent = [x for b in suffixtree._over_shards(n, 6_000, [suffixtree._send_pairs(1)], parts)(iter([pa.RecordBatch.from_pylist([row])])) for x in b.to_pylist()]
    assert sum(len(x["keys"]) for x in sent) <= 2 * 6_000
    keys = suffixtree.keys_of(numbers, parts)
    assert ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == (numbers % parts).astype(np.uint64)).all()
    assert len(np.unique(keys)) == len(numbers)


def test_scores_do_not_depend_on_shards(spark):
    """A shard that holds a context, but none of the words listed after it, still backs off from it."""
    rnd = random.Random(16)
    texts = ["the cat " + rnd.choice(["sat", "ran"]) for _ in range(90)] + [f"the cat w{k}" for k in range(30)] + [f"a{rnd.randint(0, 9)} b{rnd.randint(0, 3)}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in suffixtree.language_model_scores(spark, d).collect()} for d in (docs.coalesce(1), docs.repartitionByRange(24, "doc_id")))
    assert [d for d in one if not math.isclose(one[d], many[d], rel_tol=1e-9)] == []


def test_frequent_contexts_keep_their_keys():
    """Contexts whose numbers are neighbours, each in several ranges, share no key with the same word."""
    n, words = 40_000, 50
    ids = np.random.default_rng(9).integers(0, words, n).astype(np.int32)
    counts = np.full(words, 40)
    counts[[0, 2]] = 4 * suffixtree.SPLIT, 2 * suffixtree.SPLIT
    row = {"shard": 1, "doc_ids": [1], "sizes": [n], "ids": suffixtree.packed(ids), "n_0": [suffixtree.packed(counts)], "id_0": [suffixtree.packed(np.arange(words))]}
    level = suffixtree.Shard(row, n, words, 1).level(1)
    assert len(set(zip(level.keys.tolist(), level.numbers.tolist()))) == len(level.keys)


def test_rows_between_shards_and_ranges():
    """Shards times ranges stay few on 10 GB of text (some 6 GB of Parquet), and small tables still have work for all cores."""
    _, shards, parts = suffixtree.dealt(10_200_000_000, 12)
    assert shards * parts < 600_000
    limit, shards, parts = suffixtree.dealt(25_000_000, 4)
    assert shards >= 8 and limit * shards >= 25_000_000 and parts >= 1
    assert suffixtree.dealt(0, 8)[1:] == (1, 1)


def test_packed_runs():
    rnd = np.random.default_rng(8)
    bounds = np.array([0, 1, 300, 301, 1000])
    for x, ascending in ((np.sort(rnd.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)), True), (rnd.integers(-(1 << 41), 1 << 41, 1000), False), (np.arange(1000, dtype=np.int32) - 300, False), (np.repeat([127, -128, 1 << 31, 255], 250), False), (np.repeat([-1, -200, 7, 1 << 40], [1, 299, 1, 699]), False), (rnd.random(1000) > 0.5, False)):
        runs = suffixtree.packed_runs(x, bounds, ascending)
        assert [suffixtree.unpacked(b, x.dtype, ascending).tolist() for b in runs] == [x[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])]
        if x.dtype != bool:
            assert [y.tolist() for y in suffixtree.unpacked_runs(runs, x.dtype, ascending)] == [x.tolist(), bounds.tolist()]
    assert suffixtree.packed_runs(np.zeros(0, np.int64), np.array([0])) == []


def test_packed_arrays(spark):
    rnd = np.random.default_rng(3)
    for x in (np.sort(rnd.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)), rnd.random(7) > 0.5, rnd.random(9), np.zeros(0, np.int64), np.array([1 << 40, -3])):
        assert (suffixtree.unpacked(suffixtree.packed(x, x.dtype == np.uint64), x.dtype, x.dtype == np.uint64) == x).all()


def test_quality_counts(spark, docs, rows):
    got = {r["doc_id"]: r for r in quality.quality(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for d, t, *_ in rows:
        if d is None:
            continue
        w = (t or "").encode().split()
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {i for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
        r = got[d]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), len(covered), sum(len(x.decode()) for x in w))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (r["kept"] is False if r["base_failed"] else True)


def test_planted_outliers_are_rejected_and_clean_rows_kept(spark):
    rnd = random.Random(8)
    clean = lambda: " ".join("abcdefghij"[: rnd.randint(2, 8)] for _ in range(rnd.randint(80, 160)))
    planted = [" ".join("#$ab" if k % 2 else w for k, w in enumerate(clean().split())), " ".join(w * 6 for w in clean().split())]
    # a group of its own, one judged by its language, and one by all rows
    groups = [("en", "big", 300), ("en", "small", 8), ("xx", None, 5)]
    texts = [(lang, source, text, bad) for lang, source, n in groups for bad, of in ((False, [clean() for _ in range(n)]), (True, planted)) for text in of]
    rows = [(i, text, lang, source) for i, (lang, source, text, _) in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert not any(got[i]["kept"] for i, (*_, bad) in enumerate(texts) if bad)
    assert sum(got[i]["kept"] for i, (*_, bad) in enumerate(texts) if not bad) >= 310


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.vocabulary_path()), Counter()
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32).tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            want[d, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    got = packing.pack(spark, docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def plain_bounded_best_fit(sizes, length, most):
    """A list of [sequence, used] in the order of opening, gone through for each piece; and how many bins were closed while some were open."""
    bins, made, placed, closed = [], 0, [], 0
    for size in sizes:
        fits = [x for x in bins if x[1] + size <= length]
        if fits:
            best = max(x[1] for x in fits)
            chosen = [x for x in fits if x[1] == best][-1]
            bins.remove(chosen)
        else:
            chosen, made = [made, 0], made + 1
        placed.append((chosen[0], chosen[1]))
        chosen[1] += size
        if chosen[1] < length:
            if len(bins) == most:
                full = max(x[1] for x in bins)
                bins.remove([x for x in bins if x[1] == full][-1])
                closed += 1
            bins.append(chosen)
    return placed, closed


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_bins_close_as_in_a_plain_packer(most):
    rnd = random.Random(most)
    sizes = [rnd.choice([rnd.randint(1, 10), rnd.randint(30, 50)]) for _ in range(2000)]
    bins = packing.Bins(50, most)
    want, closed = plain_bounded_best_fit(sizes, 50, most)
    assert [bins.place(s) for s in sizes] == want and closed > 100
    assert [packing.Bins(10, 2).place(10)] == [(0, 0)]


def test_words_are_encoded_as_whole_texts_are():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encoder, rnd = Tokenizer.from_file(packing.vocabulary_path()), packing.WordEncoder(packing.vocabulary_path()), random.Random(2)
    parts = ["a", "B", "é", "<|ENDOFTEXT|>", "<|endoftext|>", " ", "\n", "\u00a0", "'s", "'LL", "12", "-", "H\u0331", "ß", "中", "♥", "İ", "\x1c", "Ω", "...", "was,", "W!?", "<|", "x" * 30, "ñandú", "ς", "Σ", "жук", "ŉ", "ǆ", "ª", "e\u0301"]
    for _ in range(300):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3)] + [None]
        ids, ends = encoder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_get_whole_texts(spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path("byte_bpe_50k.json")
    text = "Two  words,\n\nthen <|endoftext|> more"
    got = packing.pack(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), path, with_ids=True).collect()
    assert np.frombuffer(got[0]["ids"], "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]


def test_packing_is_tight_when_bins_close(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, "the " * rnd.choice([3, 40, 400, 1500])) for i in range(800)], "doc_id long, text string")
    got = packing.pack(spark, docs, open_bins=8).collect()
    assert len({r["sequence_id"] for r in got}) <= 1.1 * sum(r["length"] for r in got) / 4096


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    edited = item.replace("delta", "DELTA!").replace("theta", "other")
    noise = " ".join(f"n{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{noise} {item} {noise}"), (2, f"{noise}, {edited}. {noise}"), (3, noise), (4, None), (5, ""), (6, "alpha beta gamma " + noise)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "a b")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, docs, items).collect()} == {(1, 7), (2, 7)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(spark, docs, items).collect()} == {3, 4, 5, 6}
    assert decontaminate.contaminated(spark, docs, items.limit(0)).count() == 0


def whole_text_share(item, text):
    """Score of the best local alignment of all words of both, as a share of the item's full score, cell by cell; and the longest common run."""
    best, longest, row, run = 0, 0, [0] * (len(text) + 1), [0] * (len(text) + 1)
    for w in item:
        new, new_run = [0], [0]
        for j, x in enumerate(text):
            new.append(max(0, row[j] + (2 if w == x else -1), row[j + 1] - 1, new[j] - 1))
            new_run.append(run[j] + 1 if w == x else 0)
        row, run = new, new_run
        best, longest = max(best, *row), max(longest, *run)
    return best / (2 * len(item)), longest


def test_edited_copies_are_found_as_by_alignment_over_whole_texts(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    pick = lambda: words[min(int(rnd.expovariate(0.02)), 299)]
    items = [[pick() for _ in range(rnd.choice([20, 40, 100]))] for _ in range(12)]
    texts = []
    for i in range(160):
        item, copy = items[i % 12], []
        rate = rnd.choice([0.0, 0.1, 0.2, 0.3])
        lo = rnd.choice([0, 0, len(item) // 3])
        for w in item[lo : rnd.choice([len(item), len(item), lo + len(item) // 2])]:
            x = rnd.random()
            copy += [pick()] if x < rate / 2 else [] if x < rate * 3 / 4 else [w, pick()] if x < rate else [w]
        stray = item[:3] if i % 3 == 0 else []  # a stray seed before the copy
        texts.append([pick() for _ in range(50)] + stray + [pick() for _ in range(10)] + (copy if i % 8 else []) + [pick() for _ in range(50)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, docs, marks).collect()}
    want = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            share, run = whole_text_share(item, t)
            if share >= decontaminate.COPY or run >= decontaminate.RUN:
                want.add((i, k))
    assert len(want) > 80 and got <= want and len(got) >= 0.97 * len(want)


def test_toxicity(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join(rnd.choice(["sun", "sea", "sky", "tree"]) for _ in range(30)) + (" scum idiot" if bad else "")))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (900, "you Scum, idiot!"), (901, None), (902, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(spark, docs, marks).collect()}
    assert got[900] and not got[901] and not got[902] and sum(got[i] == (i % 5 == 0) for i in range(400)) >= 396
    assert not any(r["toxic"] for r in toxicity.toxicity(spark, docs, marks.limit(0)).collect())


def test_warc_round_trip(spark):
    big = "é" * 60
    pages = spark.createDataFrame([(3, "http://a/ b", big), (1, None, big), (2, "u", "x\r\n\r\nWARC/1.1\r\n"), (4, "u", "x\r\n\r\nWARC/1.1\r\n"), (5, "u", None), (None, None, big), (None, "u", "z" * 200), (None, "u", "z" * 200)], "page_id long, url string, html string")
    rows = warc.archive(spark, pages).collect()
    assert sorted((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows if r["page_id"] is None) == [(120, "revisit", 1), (200, "response", None), (200, "response", None)]
    got = {r["page_id"]: r for r in rows if r["page_id"] is not None}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None)}
    assert got[3]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and got[3]["payload_bytes"] == 120
    assert warc.archive(spark, pages.limit(0)).count() == 0


def test_url_rules_and_pagerank(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = spark.createDataFrame([(1, "http://GOOD.com/a?b", link("near.org", "other.org")), (2, "http://bad.net/es/x", ""), (3, "http://near.org/", link("good.com")), (4, "http://evil.org", link("bad.net")), (5, None, None), (6, "nothing", ""), (7, "http://www.example.com/en/1", ""), (8, "http://a.example.com/en/1#x", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.url_filter(spark, pages).collect()}
    assert [got[i]["rule"] for i in range(1, 9)] == ["com/", "net/es/", None, None, None, None, "www.example.com/en/", "example.com/en/"]
    assert [got[i]["verdict"] for i in range(1, 9)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block"]
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("a", "c", 3), ("c", "a", 2)], "src string, dst string, links long")
    rank = {r["host"]: r["rank"] for r in urls.propagate(spark, edges, spark.createDataFrame([("a", 1.0)], "host string, rank double"), rounds=5).collect()}
    m, x, s = np.array([[0, 1, 1], [0.25, 0, 0], [0.75, 0, 0]]), np.array([1.0, 0, 0]), np.array([1.0, 0, 0])
    for _ in range(5):
        x = 0.15 * s + 0.85 * m @ x
    assert np.allclose([rank["a"], rank["b"], rank["c"]], x)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    hosts = [f"h{i}.org" for i in range(15)] + ["bad.net"]
    pages = spark.createDataFrame([(i, f"http://{h}/es/x", f'<a href="http://{to}/x">') for i, (h, to) in enumerate(zip(hosts, [*hosts[1:], "h14.org"]))], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.url_filter(spark, pages).collect()}
    assert [got[i]["verdict"] for i in range(16)] == ["block"] * 16
    m, s = np.zeros((16, 16)), np.eye(16)[15]
    for i in range(15):  # backwards; h14 is linked from h13 and bad.net
        m[i, i + 1] = 0.5 if i == 13 else 1.0
    m[15, 14] = 0.5
    assert np.allclose([got[i]["distrust"] for i in range(16)], np.linalg.solve(np.eye(16) - 0.85 * m, 0.15 * s), rtol=1e-4, atol=0)


def test_no_rows(spark, docs):
    none = docs.limit(0)
    assert substrings.remove_repeats(spark, none).count() == 0
    assert simhash.near_duplicates(spark, none).count() == 0
    assert packing.pack(spark, none).count() == 0
    assert quality.quality(spark, none).count() == 0
    assert suffixtree.language_model_scores(spark, none).count() == 0
    assert suffixarray.remove_repeated_bytes(spark, none).count() == 0
    assert simhash.keep_one(spark, none).count() == 0
    assert substrings.cut_repeats(spark, none).count() == 0
    assert toxicity.toxicity(spark, none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert urls.url_filter(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert decontaminate.drop_contaminated(spark, none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    pytest.importorskip("corpus_pipeline")
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    cut = substrings.cut_repeats(spark, docs)
    assert cut.columns == docs.columns and {tuple(r[5:]) for r in cut.collect()} == {("r", "h", "w")} and cut.count() == docs.count()
