"""Places of media against lists."""

import random

from turnframe.operators import media

PADS = {"image": 900, "video": 901}
TOKENS, MEDIA = "conv_id long, pos long, token_id long", "conv_id long, modality string, item_idx int, grid array<int>"
RANGES = "conv_id long, modality string, item_idx int, offset long, length long"


def plain(tokens, items, merge=2):
    """(tokens once pads have grown, {(modality, n): (offset, length)}, faults)."""
    left = {m: list(v) for m, v in items.items()}
    out, places, faults, seen = [], {}, [], {}
    for t in tokens:
        m = {v: k for k, v in PADS.items()}.get(t)
        if m is None:
            out.append(t)
        elif left.get(m):
            g = left[m].pop(0)
            n = 1 if g is None else g[0] * g[1] * g[2] // merge**2
            places[m, seen.setdefault(m, 0)] = (len(out), n)
            seen[m] += 1
            out += [t] * n
        else:
            faults.append("unmatched_pad")
            out.append(t)
    return out, places, sorted(faults + ["unplaced_item"] * sum(map(len, left.values())))


def test_places_and_tokens(spark):
    rnd = random.Random(3)
    grid = lambda: rnd.choice([None, [1, 2, 2], [1, 4, 6], [3, 4, 4], [1, 1, 3]])
    cases = [([rnd.choice([1, 2, 3, 900, 901]) for _ in range(rnd.randint(0, 14))], {m: [grid() for _ in range(rnd.randint(0, 4))] for m in PADS}) for _ in range(150)]
    tokens = spark.createDataFrame([(c, p, t) for c, (ts, _) in enumerate(cases) for p, t in enumerate(ts)], TOKENS)
    items = spark.createDataFrame([(c, m, 2 * k + 1, g) for c, (_, ms) in enumerate(cases) for m, gs in ms.items() for k, g in enumerate(gs)], MEDIA)
    placed = media.placed_media(tokens, items, PADS)
    got, ranges, faults = {}, {}, {}
    for r in media.expanded_tokens(tokens, placed).orderBy("conv_id", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["conv_id"], []))
        got[r["conv_id"]].append(r["token_id"])
    for r in placed.collect():
        if r["fault"]:
            faults.setdefault(r["conv_id"], []).append(r["fault"])
        else:
            ranges.setdefault(r["conv_id"], {})[r["modality"], (r["item_idx"] - 1) // 2] = (r["offset"], r["length"])
    for c, case in enumerate(cases):
        assert (got.get(c, []), ranges.get(c, {}), sorted(faults.get(c, []))) == plain(*case)
    assert media.placed_media(tokens.limit(0), items.limit(0), PADS).collect() == []


def test_a_bridge_numbers_on(spark):
    before = spark.createDataFrame([(1, "image", 0, 3, 4), (1, "image", 1, 9, 2), (2, "video", 0, 0, 5)], RANGES)
    new = spark.createDataFrame([(1, "image", 0, 1, 6), (1, "video", 0, 8, 2), (3, "image", 0, 2, 2)], RANGES)
    lengths = spark.createDataFrame([(1, 20), (2, 7)], "conv_id long, n long")
    got = sorted(tuple(r) for r in media.bridged_media(before, lengths, new).collect())
    assert got == [(1, "image", 0, 3, 4), (1, "image", 1, 9, 2), (1, "image", 2, 21, 6), (1, "video", 0, 28, 2), (2, "video", 0, 0, 5), (3, "image", 0, 2, 2)]
