"""Near-duplicates against comparing all sets, and the sketch against what is known of it."""

import random
import re

import numpy as np
import pyarrow as pa

from turnframe.llm import setsketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, block string"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [(d, s) for d, s in sets if d is not None and s]
    for k, (d, s) in enumerate(live):
        for e, t in live[k + 1 :]:
            both = len(s & t)
            if 100 * both >= 85 * (len(s) + len(t) - both):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d), d is not None and root(d) == d) for d, s in sets), key=repr)


def found(spark, rows):
    return sorted(map(tuple, setsketch.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def corpus(seed=11):
    """Families of texts with edits of all sizes about the threshold, chains whose ends are no copies, and odd rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["er", "an", "th", "ou", "lé", "Z"]) for _ in range(3)) + str(rnd.randint(0, 99))
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(20, 300))]
        for _ in range(8):
            edited = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 40)):
                edited[rnd.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    chain = [word() for _ in range(200)]
    for k in range(12):
        texts.append(" ".join(chain[k * 8 : k * 8 + 110]))
    texts += [texts[9], texts[9].upper(), "w " * 9000, "w " * 3]
    rows = [(i, t, "en", "s", 1, "i", "n", "b") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [(9, texts[30], "en", "s", 1, "i", "n", "b"), (None, texts[30], None, None, None, "i", "n", "b"), rows[4], rows[4]]


def test_all_links_are_found(spark):
    rows = corpus()
    want = plain(rows)
    assert len({r[2] for r in want}) < len(rows) - 60
    assert found(spark, rows) == want


def test_one_band_holds_texts_that_its_first_does_not_link(spark):
    """Many texts of one frame: close enough to meet everywhere, in groups that only their own members link."""
    rnd = random.Random(2)
    frame, rows = [f"f{k}" for k in range(150)], []
    for g in range(30):
        own = list(frame)
        for k in rnd.sample(range(150), 7):
            own[k] = f"g{g}x{k}"
        for m in range(4):
            text = list(own)
            text[rnd.randrange(150)] = f"m{g}y{m}"
            rows.append((g * 4 + m, " ".join(text), "en", "s", 1, "i", "n", "b"))
    assert found(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == []


def sketch(values):
    return setsketch.registers(np.array(sorted(values), np.uint64), np.array([0]))[0]


def test_registers_merge_and_agree_as_often_as_sets():
    rnd = random.Random(1)
    draw = lambda n: {rnd.getrandbits(64) for _ in range(n)}
    near = {0.5: [], 0.85: []}
    for share, out in near.items():
        for _ in range(60):
            both, x, y = draw(int(600 * share)), draw(int(300 * (1 - share))), draw(int(300 * (1 - share)))
            a, b = sketch(both | x), sketch(both | y)
            assert (np.maximum(a, b) == sketch(both | x | y)).all()
            out.append((a == b).mean())
        assert abs(np.mean(out) - share) < 0.02


def test_pairs_far_from_the_threshold_are_left():
    rnd = random.Random(3)
    draw = lambda n: {rnd.getrandbits(64) for _ in range(n)}

    def judge(shared, left, right):
        both = draw(shared)
        a, b = sketch(both | draw(left)), sketch(both | draw(right))
        same, more = np.array([(a == b).sum()]), np.array([(a > b).sum()])
        return bool(setsketch.plausible(np.array([shared + left]), np.array([shared + right]), more, setsketch.REGISTERS - same - more, same)[0])

    assert all(judge(850, 75, 75) for _ in range(40)) and all(judge(850, 0, 150) for _ in range(40)) and judge(500, 0, 0)
    assert not any(judge(500, 250, 250) for _ in range(40)) and not judge(800, 0, 200)


def test_a_cell_joins_what_its_links_join():
    """Two blocks of a chain of copies: links between them, verified, and no more than join the components."""
    rnd = random.Random(4)
    values = sorted(rnd.getrandbits(64) for _ in range(500))
    sets = [np.array(values[k * 10 : k * 10 + 400], np.uint64) for k in range(10)]
    rows = [sketch(x.tolist()) for x in sets]
    keys = setsketch.bands(np.array(rows))
    table = {"block": [k % 2 for k in range(10)], "id": list(range(10)), "component": list(range(10)), "n": [400] * 10, "registers": [x.tobytes() for x in rows], "shingles": [x.tobytes() for x in sets]}
    found = set()
    for key in {int(x) for x in keys.ravel()}:
        here = [k for k in range(10) if key in keys[k]]
        part = pa.table({c: [v[k] for k in here] for c, v in table.items()})
        for left, right in ((0, 0), (0, 1), (1, 1)):
            got = list(zip(*setsketch.compare_cell(part, left, right, key).to_pydict().values()))
            assert len(got) < max(len(here), 1)
            found |= set(got)
    assert all(abs(a - b) <= 3 for a, b in found)
    reach = {0}
    while more := {y for p in found for x, y in (p, p[::-1]) if x in reach} - reach:
        reach |= more
    assert reach == set(range(10))
