"""Odd sketches never claim more difference than there is, and spare full sets for pairs that they prove apart."""

import random

import numpy as np

from turnframe.llm import simhash


def test_a_sketch_claims_no_more_than_the_difference():
    rng = np.random.default_rng(3)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (30, 33, 20), (500, 520, 480), (500, 400, 400), (3000, 1000, 0), (5000, 5000, 4900), (0, 40, 0)):
        shared, x, y = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (both, n - both, m - both))
        sizes = np.array([n, m])
        a, b = simhash.odd_sketches(np.concatenate((shared, x, shared, y)), np.repeat([0, 1], sizes), sizes)
        least = simhash.least_difference(a, b)
        assert least == simhash.least_difference(b, a) <= n + m - 2 * both
        if n + m - 2 * both > 100:
            assert 9 * least > n + m or both / (n + m - both) > 0.8


def test_only_pairs_that_may_be_copies_bring_their_sets(spark, monkeypatch):
    rng = random.Random(1)
    words = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(20)]
    words.append([*words[0][:195], "x", *words[0][196:]])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, j) for j in range(21) for i in range(j)], "a long, b long")
    written, write = {}, simhash.materialize

    def spy(session, df, tag):
        out = write(session, df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", spy)
    signed = docs.mapInArrow(simhash._sign, simhash._SIGNED_SQL)
    assert [tuple(r) for r in simhash._confirmed(spark, docs, signed, pairs).collect()] == [(0, 20)]
    assert written["shingles"] == 2 and written["not-apart"] == 1
