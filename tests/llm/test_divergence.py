"""The audit against sums over all terms in Python."""

import random
import re
from collections import Counter, defaultdict

from turnframe.llm import divergence

SCHEMA = "text string, lang string, source string, term string, n int, gid string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, top=200):
    groups, in_docs, counts = sorted({(r[1] or "", r[2] or "") for r in rows}), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        found = TERM.findall(lower(r[0] or ""))
        in_docs[r[1] or ""].update(set(found))
        counts[r[1] or "", r[2] or ""].update(found)
    out = []
    for lang in sorted({g for g, _ in groups}):
        kept = [t for t, n in in_docs[lang].items() if n >= 3]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: counts[g][t] for t in kept})
        chance = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 1) // total for t in kept})(sum(c[t] for t in kept) + len(kept))
        q, p = chance(whole), {g: chance(counts[g]) for g in groups if g[0] == lang}
        for g in p:
            terms = sorted((-((p[g][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[g][t] and p[g][t] > q[t])
            out += [(*g, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)]
            pairs = sorted((-sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h[1].encode()) for h in p if h != g)
            out += [(*g, "pair", h.decode(), -v, k) for k, (v, h) in enumerate(pairs, 1)]
    return sorted(out)


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("an", "ERT", "ü", "日本", "z") for b in ("a", "on", "É", "qu", "x", "ing", "er")]
    rows = []
    for k in range(160):
        source = rnd.choice([None, "", "s1", "s2", "s2", "s2", "S3é"])
        mine = words if source != "s2" else words[:20] * 3 + words
        rows.append((rnd.choice(["", ". ", "\n-"]).join(rnd.choice(mine) + rnd.choice([" ", "7", "@", "[", "'"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", None]), source, "t", 1, "g"))
    rows += [(None, "en", "empty", "t", 1, "g"), ("", "fr", "a", "t", 1, "g"), ("one two", "fr", "b", "t", 1, "g"), (None, "fr", None, "t", 1, "g"), rows[3], rows[3]]
    return rows


def found(spark, rows, **more):
    return sorted(map(tuple, divergence.audit(spark, spark.createDataFrame(rows, SCHEMA), **more).collect()))


def test_audit(spark):
    rows = corpus()
    want = plain(rows)
    assert len({r[:2] for r in want}) > 8 and any(r[4] == 0 for r in want)
    assert found(spark, rows) == want


def test_search_stops_early_and_keeps_ties(spark):
    """A small k, so that most buckets are never evaluated, and values that tie at the k-th place."""
    rows = corpus(7) + [(f"tie{chr(97 + k)} " * 2, "de", "t", "t", 1, "g") for k in range(9) for _ in range(3)] + [("other words here " * 9, "de", "u", "t", 1, "g")] * 3
    for top in (1, 4):
        assert found(spark, rows, top=top) == plain(rows, top)


def test_long_text_is_taken_in_pieces(spark):
    rows = [("Ab cd " * 400_000 + "e" * 2_500_000, "en", "s", "t", 1, "g")] * 3 + [("cd x", "en", "t", "t", 1, "g")]
    assert found(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
