"""Embedding near-dedup, nearest neighbours and vector codes next to comparing all, and components next to union-find."""

import hashlib
import random

import numpy as np
import pytest

from lumicat.llm import embedding_dedup, prefix_forest, vector_codes
from lumicat.llm.base import ready
from lumicat.llm.bitmap import bitmap
from lumicat.llm.components import components
from tests.llm.common import groups


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    ready(spark)


def brute(rows):
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, fine)]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    at, n = groups(len(rows), linked), [0] * len(rows)
    for i, j in linked:
        n[i] += 1
        n[j] += 1
    least = {}
    for k, (i, _) in zip(at, rows):
        least[k] = min(least.get(k, 1 << 60), i)
    return sorted((i, c, least[k], i == least[k]) for k, (i, _), c in zip(at, rows, n))


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    rows = [(int(k), rng.normal(size=16).astype("f4").tolist()) for k in rng.permutation(n)]
    rows += [(1000 + k, (np.array(rows[k % 7][1]) + rng.normal(size=16) * 0.1).astype("f4").tolist()) for k in range(60)]
    rows += [(2000 + k, rows[3][1]) for k in range(20)] + [(3000, (np.array(rows[3][1]) * 2).tolist())]
    return rows + [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [None] * 16), (4005, [1.0, float("inf")]), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (2000, rows[3][1])]


def test_one_cell_is_exact(spark):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS class", "2 AS label", "3 AS component")
    assert sorted(tuple(r) for r in embedding_dedup.near_copies(df).collect()) == brute(rows)
    assert embedding_dedup.near_copies(df.limit(0)).count() == 0


def test_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rows = vectors(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in embedding_dedup.near_copies(df).collect()) == brute(rows)


def test_cells_find_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "WHOLE", 50)
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 20)
    rows = vectors(3, 1_500)
    got = sorted(tuple(r) for r in embedding_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    want = brute(rows)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    assert all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(got, want))


def test_near_copies_of_extreme_doubles(spark):
    """Parallel vectors link at any length that a double can have."""
    base = np.array([1.0, 2.0, -3.0, 0.5])
    scales = [1e300, 1e200, 1.0, 1e-200, 1e-300, -1e250]
    rows = [(i, (base * f).tolist()) for i, f in enumerate(scales)] + [(9, [0.0, 0.0, 5e-324, 0.0]), (10, [0.0, 0.0, 1e308, 1.0])]
    got = embedding_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(i, 4, 0) for i in range(5)] + [(5, 0, 5), (9, 1, 9), (10, 1, 9)]


def test_components(spark):
    rng = random.Random(4)
    names = list(range(400))
    rng.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(120)] + [(names[rng.randrange(130, 400)], names[rng.randrange(130, 400)]) for _ in range(150)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + edges[:9], "u long, v long")).collect()}
    want = groups(400, [(a, b) for a, b in edges if a is not None])
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bitmap_lets_all_wanted_through(spark):
    ids = [random.Random(5).randrange(-(1 << 62), 1 << 62) for _ in range(5_000)]
    marks = bitmap(spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long"), 5_000)
    assert marks.has(np.array(ids)).all()
    assert marks.has(np.arange(20_000)).mean() < 0.2


def nearest_brute(rows, k=20):
    """query_id, rank, vec_id, score by comparing all."""
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, x in fine.items():
        if i % 20 == 0:
            near = sorted((-float(np.add.accumulate(x * y)[-1]), j) for j, y in fine.items() if j != i and len(y) == len(x))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def forest(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS class", "2 AS tree", "3 AS score", "4 AS rank", "'q' AS query")
    return sorted(tuple(r) for r in prefix_forest.nearest(df).collect())


def test_forest_on_awkward_rows(spark, monkeypatch):
    # so sure that it ascends to the roots
    monkeypatch.setattr(prefix_forest, "FOUND", 1 - 1e-15)
    rows = [r for r in vectors(6, 120) if r[0] != 2000]
    rows += [(5000 + 20 * k, rows[3][1]) for k in range(30)] + rows[:9] + [(None, rows[5][1]), (-40, rows[7][1]), (9000, [0.5]), (9020, [-2.0])]
    assert forest(spark, rows) == nearest_brute(rows)
    assert forest(spark, []) == []
    assert forest(spark, [(20, [1.0, 2.0])]) == []


def test_forest_with_segments_blocks_and_lengths(spark, monkeypatch):
    for name, value in (("SEGMENT", 60), ("QUERIES", 16), ("SAMPLE", 64), ("SCORES", 4_000), ("AROUND", 40)):
        monkeypatch.setattr(prefix_forest, name, value)
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 24)) * 3
    rows = [(k, ((middle[k % 12] + rng.normal(size=24)) * rng.choice([1, 1, 1, 4, 30])).tolist()) for k in range(2_400)]
    rows += [(2_400 + k, (middle[0] * 9).tolist()) for k in range(400)]
    got, want = forest(spark, rows, "double"), nearest_brute(rows)
    assert len(got) == len(want) and [r[:2] for r in got] == [r[:2] for r in want]
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)
    exact = {i: np.array(v) for i, v in rows}
    assert all(s == float(np.add.accumulate(exact[q] * exact[i])[-1]) for q, _, i, s in got)


def test_forest_of_extreme_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=6) * s).tolist()) for k, s in enumerate([1e300, 1e-300, 1.0, 5e-324, 1e200] * 30)]
    got = forest(spark, rows, "double")
    assert len(got) == 8 * 20 and all(q != i for q, _, i, _ in got)


def test_prefix_length_follows_the_angle():
    level = prefix_forest.level_for(np.array([1.0, 0.9, 0.5, 0.0, -1.0, -np.inf]))
    assert level[0] == prefix_forest.BITS and (np.diff(level) <= 0).all() and level[-1] == 0
    same = 1 - np.arccos(0.9) / np.pi
    assert 1 - (1 - same ** level[1]) ** prefix_forest.TREES >= prefix_forest.FOUND > 1 - (1 - same ** (level[1] + 1)) ** prefix_forest.TREES


def codes_brute(rows):
    """vec_id, code, error, label error and the digest of the codebooks, in Python's numbers."""
    def floor(x):
        n, d = float(x).as_integer_ratio()
        return n * 256 // d

    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [floor(x) for x in v] + [0] * (-len(v) % 16 if v else 16), g) for i, v, g in kept if len(v) == len(kept[0][1])]
    step = len(kept[0][1]) // 16 if kept else 0
    books = [[v[k * step: (k + 1) * step] for _, v, _ in kept[:64]] for k in range(16)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(2):
        for k in range(16):
            parts = [v[k * step: (k + 1) * step] for _, v, _ in kept]
            to = [near(x, books[k])[1] for x in parts]
            books[k] = [[sum(c) // len(c) for c in zip(*mine)] if (mine := [x for x, t in zip(parts, to) if t == e]) else old for e, old in enumerate(books[k])]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, sums = [], {}
    for i, v, g in kept:
        got = [near(v[k * step: (k + 1) * step], books[k]) for k in range(16)]
        error = sum(d for d, _ in got)
        sums[g] = sums.get(g, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in got), error, g))
    fits = {g: all(r[2] < 1 << 63 for r in out if r[3] == g) and sums[g] < 1 << 63 for g in sums}
    return sorted(((i, c, e if e < 1 << 63 else None, sums[g] if fits[g] else None, digest) for i, c, e, g in out), key=repr)


def coded(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS code", "2 AS error", "3 AS vector", "4 AS part", "5 AS of")
    return sorted((tuple(r) for r in vector_codes.encode(df).collect()), key=repr)


def test_codes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), (rng.normal(size=32) * rng.choice([0.1, 1])).astype("f4").tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(500)]
    rows += [(1000 + k, rows[4][1], 7) for k in range(200)] + [rows[8], (None, rows[9][1], None), (2000, None, 1), (2001, [float("nan")] * 32, 1), (2002, [None] * 32, 1), (2003, [1.0], 1), (2004, [0.0] * 32, 1)]
    assert coded(spark, rows) == codes_brute(rows)
    monkeypatch.setattr(vector_codes, "BLOCK", 1_000)
    assert coded(spark, rows) == codes_brute(rows)
    assert coded(spark, []) == []
    assert coded(spark, [(1, [], 1), (2, [], None)]) == codes_brute([(1, [], 1), (2, [], None)])


def test_codes_of_ties_odd_lengths_and_large_numbers(spark):
    rng = np.random.default_rng(10)
    rows = [(k, rng.integers(-2, 3, 21).astype(float).tolist(), k % 2) for k in range(300)]
    assert coded(spark, rows, "double") == codes_brute(rows)
    rows = [(k, (rng.normal(size=16) * 10.0 ** rng.integers(-3, 300 if k % 50 == 0 else 7)).tolist(), k % 5) for k in range(150)]
    assert coded(spark, rows, "double") == codes_brute(rows)


def test_both_trees_prune():
    rng = np.random.default_rng(11)
    x = np.repeat(rng.integers(-4000, 4000, (200, 4)), 50, axis=0)
    entries = x[::160][:60]
    built = vector_codes.tree(x, vector_codes.LEAF)
    asked = 0
    keep = vector_codes._keep

    def counted(*args):
        nonlocal asked
        asked += len(args[0])
        return keep(*args)

    vector_codes._keep, was = counted, keep
    try:
        code, total, count = vector_codes.assign(x, built, entries)
    finally:
        vector_codes._keep = was
    apart = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == apart.argmin(axis=1)).all()
    assert (count == np.bincount(code, minlength=60)).all() and all((total[e] == x[code == e].sum(axis=0)).all() for e in range(60))
    assert asked < len(x) * len(entries) / 20
