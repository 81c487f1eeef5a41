"""Operators over documents, next to plain readings of their contracts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumicat.llm import bpe, decontaminate, license_scan, ngram_join, quality, substring_dedup
from lumicat.llm import words as W
from lumicat.llm.base import ready
from lumicat.llm.fm_index import FMIndex
from tests.llm import common as C


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    ready(spark)


def test_words_are_those_of_the_patterns(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 64)
    rng = random.Random(1)
    for spec, pattern in ((W.WORDS, rb"[^\x20\x09-\x0D]+"), (W.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for _ in range(60):
            column = [None if rng.random() < 0.1 else "".join(rng.choice("aB é7!\n\tz") for _ in range(rng.choice([0, 1, 5, 30, 300]))) for _ in range(rng.randint(0, 6))]
            got, seen = [], {}
            for w in W.words(pa.array(column, pa.string()), spec):
                got += [w.hashes[a:b].tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
            text = [(c or "").encode() for c in column]
            want = [re.findall(pattern, t.lower() if spec is W.ALNUM else t) for t in text]
            assert [len(x) for x in got] == [len(x) for x in want]
            for a, b in zip(got, want):
                assert all(seen.setdefault(word, h) == h for h, word in zip(a, b))
            assert len(set(seen.values())) == len(seen)


def test_quality_learns_and_takes_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(k, C.prose(rng, 50) if k % 4 else " ".join(f"{w}$$$" for w in C.prose(rng, 50).split())) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(400)] + [(None, 1), (5, None), (3, 1)], "doc_id long, quality int")
    docs = C.frame(spark, rows, extra=True)
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    away = [k for k, r in got.items() if r.held_out]
    assert 40 < len(away) < 120
    assert np.mean([got[k].predicted == (k % 4 > 0) for k in away]) >= 0.97
    assert sorted(r.doc_id for r in quality.keep_good(docs, model).collect()) == sorted(k for k, r in got.items() if r.predicted)
    assert quality.keep_good(docs, model).dtypes == docs.dtypes
    odd = quality.score(C.frame(spark, C.awkward()), model).collect()
    assert len(odd) == len(C.awkward()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1
    none = quality.train(docs.limit(0), labels)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0
    assert quality.train(docs, labels).weights.tobytes() == model.weights.tobytes()


def test_join_equals_all_pairs(spark):
    rows = C.awkward(3)
    rng = random.Random(3)
    for k in range(30):  # copies of one text from near to far
        words = rows[3][1].split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        rows.append((100 + k, " ".join(words[: 300 - 3 * (k % 5)])))
    got = ngram_join.near_copies(C.frame(spark, rows, extra=True))
    assert C.ordered(got.collect()) == C.ordered(C.join_brute(rows))
    assert ngram_join.near_copies(C.frame(spark, []).limit(0)).count() == 0
    kept = ngram_join.keep_one(C.frame(spark, rows, extra=True))
    gone = {d for d, _, c in C.join_brute(rows) if d is not None and d != c} - {d for d, _, c in C.join_brute(rows) if d == c}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in gone)
    assert kept.dtypes == C.frame(spark, rows, extra=True).dtypes


def test_repeats_equal_all_windows(spark):
    rows = C.awkward(4)
    rng = random.Random(4)
    rows += [(200 + k, " ".join(C.prose(rng, 15, 6) for _ in range(6))) for k in range(10)]
    got = substring_dedup.remove_repeats(C.frame(spark, rows, extra=True))
    assert C.ordered(got.select("row.doc_id", "n_words", "n_removed", "kept").collect()) == C.ordered(C.repeats_brute(rows))
    docs = C.frame(spark, rows).selectExpr("*", "cast(0 AS int) AS n_chars", "'x' AS kept")
    out = substring_dedup.strip(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(rows)
    left = {d: k for d, _, n, k in C.repeats_brute(rows) if n}
    assert all(r.text == left[r.doc_id] and r.n_chars == len(r.text) for r in out.collect() if r.doc_id in (5, 6, 7, 44) and r.doc_id in left)
    assert substring_dedup.remove_repeats(C.frame(spark, [])).count() == 0


def test_frequent_anchors_go_by_window(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "OFTEN", 3)
    monkeypatch.setattr(substring_dedup, "INDEX_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "HELD", 5)
    rows = C.awkward(5)
    got = substring_dedup.remove_repeats(C.frame(spark, rows))
    assert C.ordered(got.select("row.doc_id", "n_words", "n_removed", "kept").collect()) == C.ordered(C.repeats_brute(rows))


def test_index_finds_all_places():
    rng = np.random.default_rng(0)
    for kinds, n in ((3, 200), (1, 50), (50, 500)):
        _, text = np.unique(np.append(rng.integers(0, kinds + 1, n), 0), return_inverse=True)
        index, ends = FMIndex(text, 8), np.arange(1, len(text) + 1)
        length, lo, hi = index.matching(text, ends, 6)
        for e, got, a, b in zip(ends, length, lo, hi):
            want = 0
            while want < 6 and e - want - 1 >= 0 and text[e - want - 1] > 0:
                want += 1
            assert got == want
            if got:
                assert sorted(index.order[a:b]) == [i for i in range(len(text) - got + 1) if (text[i: i + got] == text[e - got: e]).all()]


def _tiling(item, text, minimum):
    """Greedy string tiling by its definition."""
    p, t, out = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not p[i + k] and not t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < minimum:
            return out
        p[i: i + k], t[j: j + k] = [True] * k, [True] * k
        out += k


def test_tiles_cover_what_greedy_tiling_does(spark):
    rng = random.Random(6)
    for _ in range(40):
        item = [rng.randrange(4) for _ in range(rng.randint(3, 25))]
        text = [rng.randrange(4) for _ in range(rng.randint(3, 60))]
        seeds = [(i, j) for i in range(len(item) - 2) for j in range(len(text) - 2) if item[i: i + 3] == text[j: j + 3]]
        got = decontaminate.tiles(np.array(item), np.array(text), tuple(np.array(x, np.int64) for x in zip(*seeds)), 3) if seeds else []
        assert sum(n for *_, n in got) == _tiling(item, text, 3)
        assert all(item[a: a + n] == text[b: b + n] for a, b, n in got)


def test_texts_without_id_link_like_others(spark):
    """Near copies without ids, with and without one that has an id, and a bridge between two ids that only a null id makes."""
    rng = random.Random(9)

    def changed(words, at):
        return " ".join("x" + w if k in at else w for k, w in enumerate(words))

    words = [[f"d{k}w{rng.randrange(10**6)}" for _ in range(200)] for k in range(3)]
    rows = [(10, " ".join(words[0])), (None, changed(words[0], {50})), (None, changed(words[0], {150}))]
    rows += [(None, " ".join(words[1])), (None, changed(words[1], {3}))]
    # each end differs from the middle in 5 places, from the other end in 10
    rows += [(30, changed(words[2], {10, 30, 50, 70, 90})), (None, " ".join(words[2])), (20, changed(words[2], {110, 130, 150, 170, 190}))]
    want = C.join_brute(rows)
    assert [c for _, _, c in want] == [10, 10, 10, None, None, 20, 20, 20]
    assert C.join_brute(rows[5::2])[0][2] == 30
    assert C.ordered(ngram_join.near_copies(C.frame(spark, rows, extra=True)).collect()) == C.ordered(want)


def test_decontamination_catches_reordered_passages(spark):
    rng = random.Random(7)
    item = [f"item{k}" for k in range(40)]
    moved = " ".join(item[20:] + ["between"] * 9 + item[:20]).upper()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, "a b c d e f g")], "item_id long, text string")
    rows = C.awkward(7) + [(300, f"{C.prose(rng, 50)} {moved}"), (301, " ".join(item[:15])), (302, " ".join(item) + " " + " ".join(item))]
    got = {r.doc_id: r for r in decontaminate.scan(C.frame(spark, rows, extra=True), bench).collect() if r.doc_id and r.doc_id >= 300}
    assert (got[300].item_id, got[300].coverage, got[300].n_tiles, got[300].contaminated) == (1, 1.0, 2, True)
    assert (got[301].coverage, got[301].contaminated) == (15 / 40, False)
    assert (got[302].coverage, got[302].n_tiles) == (1.0, 1)
    kept = decontaminate.drop_contaminated(C.frame(spark, rows, extra=True), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in (300, 302))
    assert decontaminate.scan(C.frame(spark, rows), bench.limit(0)).where("coverage > 0").count() == 0
    assert decontaminate.scan(C.frame(spark, []), bench).count() == 0


def test_decontamination_finds_every_item(spark, monkeypatch):
    """A document with several items, in one block and in one block per few items; an id that two items have."""
    def item(k, n=30):
        return [f"i{k}w{j}" for j in range(n)]

    bench = spark.createDataFrame([(k, " ".join(item(k))) for k in range(12)] + [(3, " ".join(item(30)))], "item_id long, text string")
    dump = " ".join(" ".join(item(k)) for k in (5, 2, 9))
    rows = [(1, f"before {dump} after {' '.join(item(7)[:20])} and {' '.join(item(8)[:12])}"), (2, " ".join(item(4)[:10])), (None, " ".join(item(30))), (None, None), (5, "clean " * 9), (1, " ".join(item(11)))]
    want = [(None, 3, 1.0, 1), (1, 2, 1.0, 1), (1, 5, 1.0, 1), (1, 7, 20 / 30, 1), (1, 9, 1.0, 1), (1, 11, 1.0, 1)]
    best = [(None, None, 0.0, 0, False, []), (None, 3, 1.0, 1, True, [3]), (1, 2, 1.0, 1, True, [2, 5, 7, 9]), (1, 11, 1.0, 1, True, [11]), (2, 4, 10 / 30, 1, False, []), (5, None, 0.0, 0, False, [])]
    df = C.frame(spark, rows, extra=True)
    for words in (decontaminate.BLOCK_WORDS, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        assert (decontaminate.n_blocks(bench) > 1) == (words == 100)
        assert C.ordered(decontaminate.pairs(df, bench).collect()) == C.ordered(want)
        assert C.ordered(decontaminate.scan(df, bench).collect()) == C.ordered(best)
        kept = decontaminate.drop_contaminated(df, bench)
        assert kept.dtypes == df.dtypes and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "None"]


def test_licenses(spark):
    text = "Licensed under the Apache License, Version 2.0. See the MIT-License or mit license; GNU General Public License v3. SPDX-License-Identifier: BSD-3-Clause"
    rows = C.awkward(8) + [(400, text), (401, "general public licenses"), (402, "mit license " * 3000)]
    got = {r.doc_id: r for r in license_scan.scan(C.frame(spark, rows, extra=True)).collect()}
    assert len(license_scan.rules()) > 300
    r = got[400]
    assert (r.n_base, r.first_word, r.base_labels) == (4, 3, "apache,gpl,mit")
    assert {"apache-2.0", "gpl-3.0", "bsd-3-clause", "mit"} <= set(r.labels.split(",")) and r.score == 1.0
    assert (got[401].n_base, got[401].labels, got[401].first_word) == (0, "", None)
    assert (got[402].n_base, got[402].first_word, got[402].last_word) == (3000, 0, 5998)
    assert (got[1].n_words, got[1].n_base, got[1].labels, got[1].score) == (0, 0, "", 0.0)
    for doc, t in rows:
        if doc not in (4, 9, None):
            assert got[doc].n_words == len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower().encode() if (t or "").isascii() else (t or "").encode().lower()))
    assert license_scan.scan(C.frame(spark, [])).count() == 0


def test_contained_detections_are_suppressed():
    d = license_scan.Detection
    inner, outer, beside = d(2, 4, "a", 50, 0.5, False), d(0, 5, "b", 80, 0.9, False), d(3, 7, "c", 60, 0.8, False)
    assert license_scan.resolve([inner, beside, outer]) == [outer, beside]
    assert license_scan.resolve([d(0, 9, "low", 10, 0.1, False), inner]) == sorted([inner, d(0, 9, "low", 10, 0.1, False)])


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(9)
    letters = ["Foo,", "bar.!", "a", "b", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "​", "́", "é", "é", "İ", "Σ", "ß", "中", "'s", "'LL", "1", "<|endoftext|>", "<|", "\x00", "😀", "ﬁ"]
    rows = C.awkward(9) + [(500 + k, "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 3000])))) for k in range(120)]
    got = bpe.encode(C.frame(spark, rows, extra=True)).select("row.doc_id", "row.text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == plain.decode(ids, skip_special_tokens=False)
    one = bpe.digests(C.frame(spark, [(1, "Hello, world")])).first()
    ids = plain.encode("Hello, world", add_special_tokens=False).ids
    assert (one.n_tokens, one.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.digests(C.frame(spark, [])).count() == 0


def test_wrong_joins_are_repaired(monkeypatch):
    """Ids that don't agree around a join are replaced by those of the text."""
    from tokenizers import Tokenizer

    plain, coder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    text = C.prose(random.Random(10), 3_000).encode()
    real = coder._learn

    def wrong(words):
        ids, said = real(words)
        return ids | {w: b"\0\0\0\0" for w in ids if w == b"w1"}, said

    monkeypatch.setattr(coder, "_learn", wrong)
    joined = coder.encode([text])[0][0]
    assert len(bpe.cuts(np.frombuffer(text, np.uint8))[0]) > 5
    assert np.frombuffer(joined, "<u4").tolist() == plain.encode(text.decode(), add_special_tokens=False).ids


def test_windows_widen_until_they_agree():
    from tokenizers import Tokenizer

    plain, coder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    for text in ("one two three", "<|endof text|> a <|startoftext|> b", "", "a\u0301 e\u0301 " * 50):
        ids, said = coder._widened(text.lower().encode())
        want = plain.encode(text.lower(), add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and said == plain.decode(want, skip_special_tokens=False)


def test_other_tokenizers_are_refused(tmp_path):
    import json

    file = json.load(open(bpe.default_path(), encoding="utf-8"))
    for change in (lambda f: f["normalizer"]["normalizers"].pop(), lambda f: f["model"].update(end_of_word_suffix=None), lambda f: f.update(decoder={"type": "ByteLevel"}),
                   lambda f: f["pre_tokenizer"]["pretokenizers"].pop()):
        other = json.loads(json.dumps(file))
        change(other)
        path = tmp_path / "other.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Encoder(str(path))


def test_the_order_does_not_depend_on_how_documents_are_dealt(spark):
    rng = random.Random(12)
    passages = [C.prose(rng, 60) for _ in range(20)]
    rows = [(k, f"{C.prose(rng, 8)} {passages[rng.randrange(20) ** 2 // 20]}") for k in range(600)]
    orders, met = [], []
    for parts in (4, 211):
        docs = C.frame(spark, rows).repartition(parts)
        order = ngram_join.Order(ngram_join._sketched(ngram_join._profile(docs, 5)))
        orders.append((order.step.tobytes(), order.cuts.tobytes()))
        met.append(ngram_join._postings(docs, order, 5, 75, 600 * 56).groupBy("token").count().selectExpr("sum(count * (count - 1) div 2)").first()[0])
    assert orders[0] == orders[1] and met[0] == met[1] > 0
    shingles = list(ngram_join.sets(pa.array([t for _, t in rows])))
    count = Counter(np.concatenate(shingles).tolist())
    tokens = np.array(list(count), np.uint64)
    keys = order.keys(tokens)
    often = np.array([n for n in count.values()])
    assert keys[often == often.max()].min() > keys[often == 1].max()
    assert (np.bincount(order.fragments(tokens), weights=often, minlength=8) > 0).all()


def test_ranges_meet_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RANGE", 500)
    rows = C.awkward(3)
    assert C.ordered(ngram_join.near_copies(C.frame(spark, rows)).collect()) == C.ordered(C.join_brute(rows))


def test_repeated_words_take_bounded_memory(monkeypatch):
    item, rng = ["a"] * 400, random.Random(13)
    mixed = [rng.choice("ab") for _ in range(300)]
    block = decontaminate._block(pa.table({"_item": pa.array([1, 2], pa.int64()), "_text": pa.array([" ".join(item), " ".join(mixed)])}), 5)
    texts = pa.array([" ".join(["a"] * 6_000), " ".join(mixed[100:] + ["a"] * 50 + mixed[:150]), "a b"])
    want = decontaminate.matches(texts, block, 5, 0.6)
    assert want[0][0][:2] == (1.0, 1) and want[1][0][:2] == (1.0, 2)
    most = []
    real = decontaminate.runs_of
    monkeypatch.setattr(decontaminate, "runs_of", lambda p, t, m: (most.append(len(p)), real(p, t, m))[1])
    monkeypatch.setattr(decontaminate, "PLACES", 5_000)
    assert decontaminate.matches(texts, block, 5, 0.6) == want
    assert max(most) <= 5_000


def test_signatures_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for size in (1, 40, 300, 2_000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate((a[: size * 3 // 4], rng.integers(0, 1 << 63, size // 3 + 1).astype(np.uint64))))
        apart = int(np.bitwise_count((ngram_join.signature(a) ^ ngram_join.signature(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert (ngram_join.signature(a) == ngram_join.signature(a[::-1])).all()


def test_open_pairs_that_signatures_rule_out_are_not_met(spark):
    # three classes share the prefix; only the first two can share enough of the rest
    postings = spark.createDataFrame(
        [(t, k, 40, t, 11, k) for k in (1, 2, 3) for t in range(11)], "token long, class long, n int, place int, several int, component long")
    words = ngram_join.BITS // 64
    classes = spark.createDataFrame(
        [(1, *[0] * words), (2, *[1] * words), (3, *[-1] * words)], "class long, " + ", ".join(f"bits{k} long" for k in range(words)))
    assert [tuple(r) for r in ngram_join._open_pairs(postings, classes, 75).collect()] == [(1, 2)]


def test_long_open_pairs_meet_by_runs(spark):
    # two long sets share 2,000 prefix n-grams, a third one holds every 100th; before, each shared n-gram made a row
    both = [(t, k, 16_000, t, 2_000, k) for k in (1, 2) for t in range(2_000)]
    third = [(t, 3, 16_000, i, 20, 3) for i, t in enumerate(range(0, 2_000, 100))]
    # an n-gram of its own in each cuts the run
    cut = [(5_000 + k, k, 16_000, 1_000, 2_001, k) for k in (1, 2)] + [(5_001, 4, 16_000, 0, 2, 4), (5_002, 4, 16_000, 1, 2, 4)]
    postings = spark.createDataFrame(both + third + cut, "token long, class long, n int, place int, several int, component long")
    words = ngram_join.BITS // 64
    classes = spark.createDataFrame([(k, *[0] * words) for k in (1, 2, 3, 4)], "class long, " + ", ".join(f"bits{k} long" for k in range(words)))
    found = ngram_join._open_pairs(postings, classes, 75)
    assert (1, 2) in {tuple(r) for r in found.collect()}
    assert C.joined_rows(found._jdf.queryExecution().executedPlan()) < 200


def test_open_pairs_count_what_they_share(spark):
    rng = random.Random(8)
    sets = {k: sorted(rng.sample(range(400), 300)) for k in (1, 2, 3)}
    postings = spark.createDataFrame(
        [(t, k, 2_000, i, 300, k) for k, got in sets.items() for i, t in enumerate(got)], "token long, class long, n int, place int, several int, component long")
    words = ngram_join.BITS // 64
    classes = spark.createDataFrame([(k, *[0] * words) for k in sets], "class long, " + ", ".join(f"bits{k} long" for k in range(words)))
    met = ngram_join._meetings(postings, classes, 75)
    shared = met.groupBy("x.class", F.col("y.class").alias("b")).agg(F.expr("sum(if(ends, x.turn, 0) - if(begins, x.turn - 1, 0))")).collect()
    want = {}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        want[a, b] = len(set(sets[a]) & set(sets[b]))
    assert {(r[0], r[1]): r[2] for r in shared} == want


def test_substring_tasks_filter_and_send_in_one_worker(spark, monkeypatch):
    plans, stage = [], substring_dedup.stage

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df)

    monkeypatch.setattr(substring_dedup, "stage", noted)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "more " + text)], "doc_id long, text string")
    found = substring_dedup.repeats(docs)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert [(r.id, {w for x in r.ranges for w in range(x.start, x.end)}) for r in found.collect()] == [(2, set(range(1, 61)))]
    assert not [p for p in plans if re.search(r"MapInArrow [^\n]*\n[^\n]*MapInArrow ", p)]
