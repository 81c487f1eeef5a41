"""Source divergence next to counting in Python, and segment trees next to plain sums."""

import random
import re

import numpy as np
import pytest

from lumicat.llm import divergence
from lumicat.llm.base import ready
from tests.llm.common import prose

TERMS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    ready(spark)


def brute(rows, min_docs=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = {}, {}
    for text, lang, source in rows:
        mine = counts.setdefault(lang, {}).setdefault(source, {})
        seen = [w.lower().decode() for w in TERMS.findall(text.encode())]
        for w in seen:
            mine[w] = mine.get(w, 0) + 1
        for w in set(seen):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang, groups in counts.items():
        kept = [w for (g, w), n in docs.items() if g == lang and n >= min_docs]

        def price(got):
            whole = sum(got.get(w, 0) for w in kept) + 5 * len(kept)
            return {w: 1 + 1_000_000_000 * (got.get(w, 0) + 5) // whole for w in kept}

        together = {w: sum(g.get(w, 0) for g in groups.values()) for w in kept}
        q, p = price(together), {s: price(g) for s, g in groups.items()}
        for s in groups:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if groups[s].get(w) and p[s][w] > q[w])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(f"{prose(rng, rng.randrange(3, 60), 90)} É{chr(97 + rng.randrange(9))}中 ABC_x9y", rng.choice(["en", "de"]), f"s{rng.randrange(6)}") for _ in range(400)]
    rows += [(prose(rng, 5, 40), "en", "hot")] * 150 + [(None, None, None), ("", "en", "empty"), ("only here", "xx", "one"), ("a b", "xx", "two"), (" 12 \t", "en", "é"), (prose(rng, 90_000, 300), "de", "long")]
    return [(t and re.sub(r"w(\d)", lambda m: "w" + "abcdefghij"[int(m[1])], t), g, s) for t, g, s in rows]


def audited(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS value", "'x' AS term", "3 AS docs", "4 AS rank", "5 AS doc_id")
    return sorted(tuple(r) for r in divergence.audit(df, **how).collect())


def test_audit(spark):
    rows = corpus(1)
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None), ("a b", None, "x")]) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_blocks_tiles_and_flushes(spark, monkeypatch):
    for name, value in (("WIDTH", 8), ("TILE", 2), ("HELD", 200), ("NUMBERED", 10), ("WALKED", 3)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(2)
    assert audited(spark, rows, min_docs=2, top=7) == brute(rows, 2, 7)


def test_equal_subtrees_are_one_node():
    leaves = np.zeros((3, 1 << 10), np.int64)
    leaves[0, 5], leaves[1, 5], leaves[2, 900] = 3, 3, 8
    root, levels, counts = divergence.consed(leaves)
    assert root[0] == root[1] != root[2] and counts.tolist() == [0, 3, 8]
    # one path per source besides the subtree without counts
    assert all(len(left) <= 3 for left, _ in levels)


def test_walk_is_a_plain_sum():
    rng = np.random.default_rng(3)
    leaves = rng.choice([0, 0, 0, 1, 2, 9], (7, 64)).astype(np.int64)
    leaves[:, 50:] = -1
    totals = np.maximum(leaves, 0).sum(axis=1) + 250
    left, right = np.triu_indices(7, 1)
    p = [[1 + 10**9 * (int(n) + 5) // int(t) for n in row[:50]] for row, t in zip(leaves, totals)]
    assert divergence.distances(leaves, totals, left, right).tolist() == [sum(abs(a - b) for a, b in zip(p[i], p[j])) for i, j in zip(left, right)]


def test_prices_are_exact():
    count = np.array([0, 10**9, 10**15, 123_456_789_012_345])
    for total in (10**15 + 7, 10**17 + 1):
        assert divergence.prices(count, np.full(4, total)).tolist() == [1 + 10**9 * (int(n) + 5) // total for n in count]
