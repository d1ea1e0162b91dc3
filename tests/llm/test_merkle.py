"""The manifest against a plain tree in Python, and its query against its SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from turnframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp string, idx int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    d, _, lang, source, n, *_ = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, k):
    steps = []
    for level in levels[:-1]:
        run = level[k // 16 * 16 : k // 16 * 16 + 16]
        steps.append((run[: k % 16], run[k % 16 + 1 :]))
        k //= 16
    return steps


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for n, s in enumerate(order):
        for k, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path_of(trees[n], k) + path_of(top, n)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(r, text)
            for before, after in steps:
                folded = sha(*before, folded, *after)
            out.append((r[0], leaf, trees[n][-1][0], top[-1][0], sha(*(x for b, a in steps for x in (*b, *a))), folded, folded == top[-1][0], s))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def corpus(sizes):
    rows, d = [], 0
    for k, n in enumerate(sizes):
        source = None if k == 1 else f"s{k}é" if k % 2 else f"s{k}"
        for _ in range(n):
            rows.append((d, None if d % 11 == 3 else "" if d % 13 == 5 else f"Text Ä{d}\n" * (d % 4), "en" if d % 3 else None, source, None if d % 7 == 0 else d, "l", "g", 1))
            d += 1
    return rows


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1, 256, 257], [3] * 18])
def test_manifest(spark, sizes):
    rows = corpus(sizes)
    assert order(merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA)).collect()) == order(plain(rows))


def test_buckets_join_outer_levels(spark):
    """Sources larger than a bucket, the last of whose runs are of one node."""
    rows = corpus([4096 + 1, 256, 257, 2, 700])
    got = merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), inner=2).collect()
    assert order(got) == order(plain(rows))
    assert 0 < sum(not r.verified for r in got) < len(rows) / 4


def test_odd_rows(spark):
    """Repeated rows, repeated and null ids, a long text, no rows."""
    rows = corpus([20, 5])
    rows += [rows[3], rows[3], (4, "Other", "en", "s0", 1, "l", "g", 1), (None, "A", None, "s0", None, "l", "g", 1), (None, None, None, None, None, "l", "g", 1), (900, "Ab " * 500_000, "en", "s0", 2, "l", "g", 1)]
    got = merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert order(got) == order(plain(rows))
    assert merkle.manifest(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_change_is_seen(spark):
    rows = corpus([40])
    other = [(*rows[7][:1], "changed", *rows[7][2:]) if k == 7 else r for k, r in enumerate(rows)]
    root = lambda x: {r.root for r in merkle.manifest(spark, spark.createDataFrame(x, SCHEMA)).collect()}
    assert len(root(rows)) == 1 and root(rows) != root(other)
