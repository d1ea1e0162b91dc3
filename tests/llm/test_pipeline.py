"""The pipeline's stages, each against brute force on what its predecessor kept of a small table."""

import zlib

import numpy as np
import pytest

from turnframe.llm import packing
from turnframe.llm.common import materialize

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """The input, then each stage's result, as rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, SF_DIR), name)
        found.append(docs.collect())
    return found


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def labelled(spark, sf_dir, rows):
    """The toxic and the clean ones of rows, by labels."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    return [{r["doc_id"] for r in rows if labels.get(r["doc_id"]) == mark} for mark in (1, 0)]


def test_clean_documents_stay_where_labels_are_few(spark, outputs):
    before, after = by_id(outputs[0]), by_id(outputs[1])
    _, clean = labelled(spark, SF_DIR, outputs[0])
    assert len(clean & set(after)) >= 0.98 * len(clean)
    assert all(after[d] == before[d] for d in after)


def test_toxic_documents_go(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf_dir).select("doc_id").collect()}
    toxic, clean = labelled(spark, sf_dir, docs.select("doc_id").collect())
    assert len(toxic - after) >= 0.7 * len(toxic)
    assert len(clean & after) >= 0.98 * len(clean)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_one_of_each_group_stays(outputs):
    before, after = by_id(outputs[1]), by_id(outputs[2])
    sets = {d: shingles(r["text"]) for d, r in before.items()}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    assert set(after) == {d for d in sets if root(d) == d}
    assert all(after[d] == before[d] for d in after)


def test_repeated_windows_are_cut(outputs):
    before, after = by_id(outputs[2]), by_id(outputs[3])
    words, first = {d: (r["text"] or "").encode().split() for d, r in before.items()}, {}
    for d, w in words.items():
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, d), d)
    assert set(after) == set(before)
    for d, w in words.items():
        gone = {i for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for i in range(k, k + 50)}
        want = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else before[d]["text"]
        assert after[d]["text"] == want


def test_copies_of_benchmark_items_go(spark, outputs):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before, after = by_id(outputs[3]), by_id(outputs[4])
    leaks = {d for d, r in before.items() if any(i in " ".join((r["text"] or "").split()) for i in items if len(i.split()) >= 8)}
    assert not leaks & set(after)
    assert all(after[d] == before[d] for d in after)
    assert len(after) >= 0.8 * len(before)


def test_all_that_is_left_is_packed(outputs):
    from tokenizers import Tokenizer

    tokenizer, pieces, sequences = Tokenizer.from_file(packing.vocabulary_path()), {}, {}
    for r in outputs[5]:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    kept = by_id(outputs[4])
    assert set(pieces) == set(kept)
    for d, found in pieces.items():
        ids = np.array([*tokenizer.encode(kept[d]["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        cut = [(k, at, ids[at : at + packing.LENGTH]) for k, at in enumerate(range(0, len(ids), packing.LENGTH))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == [(k, at, len(x), zlib.crc32(x.tobytes())) for k, at, x in cut]
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
