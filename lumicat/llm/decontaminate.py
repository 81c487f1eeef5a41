"""Benchmark decontamination by greedy string tiling.

Benchmark items are the stated queries: they go to all tasks in blocks of about ``BLOCK_WORDS`` words, and each document is
compared in place. A benchmark of one block takes one pass without a shuffle. For a larger one the documents are numbered and stored, each
block is a pass of its own, so a task holds one block at a time, and what the passes find is joined to the documents. Rolling (Karp-Rabin) hashes of ``MINIMUM`` words are the seeds. Where a document shares
one with an item, seeds along a diagonal grow into maximal matches; the longest match is marked as a tile, matches that
run into marked words are cut, and so on until none of ``MINIMUM`` words is left. The share of an item's words under tiles
is its coverage, in whatever order the passages stand in the document.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm import words as W
from lumicat.llm.base import filter_rows, rows_of, stage

MINIMUM = 5
COVERAGE = 0.6
BLOCK_WORDS = 2_000_000
#: Pairs of places in a text and in items that are listed at a time.
PLACES = 2_000_000


class Block(NamedTuple):
    ids: np.ndarray  # one per item
    words: np.ndarray  # all items' words
    begins: np.ndarray  # of each item in words, and the end
    seeds: np.ndarray  # sorted
    places: np.ndarray  # of the seeds in words
    maybe: np.ndarray  # by a seed's top bits


def _block(table: pa.Table, minimum: int) -> Block:
    ids, words, counts = [], [], []
    for w in W.words(table["_text"], W.ALNUM):
        ids += table["_item"][w.lo: w.hi].to_pylist()
        words.append(w.hashes)
        counts += w.counts.tolist()
    begins = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    words = np.concatenate(words) if words else np.zeros(0, W.U64)
    item = np.repeat(np.arange(len(counts)), counts)
    seeds = W.grams(words, minimum)
    places = np.flatnonzero(item[: len(seeds)] == item[minimum - 1:]) if len(seeds) else np.zeros(0, np.int64)
    places = places[np.argsort(seeds[places], kind="stable")]
    maybe = np.zeros(1 << 20, bool)
    maybe[(seeds[places] >> W.U64(44)).astype(np.int64)] = True
    return Block(np.array(ids, np.int64), words, begins, seeds[places], places, maybe)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("_item"), F.col("text").alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL")


def n_blocks(benchmark: DataFrame) -> int:
    letters = _items(benchmark).agg(F.sum(F.length("_text"))).first()[0] or 0
    return int(letters // (4 * BLOCK_WORDS)) + 1


def blocks(benchmark: DataFrame, minimum: int = MINIMUM) -> Iterator[Block]:
    """The items (item_id, text) in blocks of bounded size. Null ids and texts are left out. A block takes what the hash of the id
    deals to it, so one much longer item can make its block longer."""
    items = _items(benchmark)
    count = n_blocks(benchmark)
    for k in range(count):
        yield _block(items.where(F.pmod(F.xxhash64("_item"), F.lit(count)) == k).orderBy("_item", "_text").toArrow(), minimum)


def runs_of(p: np.ndarray, t: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, place in item and place in text of each run of seeds that follow each other in both."""
    by = np.lexsort((p, t - p))
    p, t = p[by], t[by]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(t - p) != 0) | (np.diff(p) != 1))))
    return np.diff(np.append(head, len(p))) + minimum - 1, p[head], t[head]


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of stretches of the text, put together where one goes on in the next stretch."""
    if len(parts) == 1:
        return parts[0]
    n, p, t = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((p, t - p))
    n, p, t = n[by], p[by], t[by]
    # a run of n words has n - minimum + 1 seeds
    goes_on = (np.diff(t - p) == 0) & (p[1:] == p[:-1] + n[:-1] - minimum + 1)
    head = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    return np.add.reduceat(n - minimum + 1, head) + minimum - 1, p[head], t[head]


def tiles(item: np.ndarray, text: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], minimum: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in text, words) of the tiles. ``seeds``: places where ``minimum`` words agree.
    Of matches of one length the first in the item goes first, then the first in the text."""
    return _tiled(item, text, runs_of(*seeds, minimum), minimum)


def _tiled(item: np.ndarray, text: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], minimum: int) -> list[tuple[int, int, int]]:
    heap = [(-n, a, b) for n, a, b in zip(*(x.tolist() for x in runs))]
    heapq.heapify(heap)
    marked_p, marked_t, out = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        taken = marked_p[a: a - n] | marked_t[b: b - n]
        if not taken.any():
            marked_p[a: a - n] = marked_t[b: b - n] = True
            out.append((a, b, -n))
            continue
        free = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for x, y in zip(free[::2].tolist(), free[1::2].tolist()):
            if y - x >= minimum:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return out


def _match(hashes: np.ndarray, block: Block, minimum: int, coverage: float) -> list[tuple[float, int, int]]:
    """Coverage, item and number of tiles: all items covered to ``coverage`` or more, and the best covered one, the best first, the smallest
    id of several. An id that several items have counts once, with the best of them."""
    grams = W.grams(hashes, minimum)
    at = np.flatnonzero(block.maybe[(grams >> W.U64(44)).astype(np.int64)])
    if not len(at) or not len(block.seeds):
        return []
    lo, hi = np.searchsorted(block.seeds, grams[at], "left"), np.searchsorted(block.seeds, grams[at], "right")
    at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    if not len(at):
        return []
    # places of a seed in the items, a bounded number of (text, item) places at a time: repeated words match everywhere
    under, runs, reach = {}, {}, {}
    ends = np.cumsum(count)
    x = 0
    while x < len(at):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PLACES, side="right")))
        some = count[x:y]
        text_at = np.repeat(at[x:y], some)
        item_at = block.places[np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(lo[x:y], some)]
        owner = np.searchsorted(block.begins, item_at, side="right") - 1
        by = np.argsort(owner, kind="stable")
        owner, item_at, text_at = owner[by], item_at[by], text_at[by]
        heads = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
        for i, j in zip(heads, heads[1:] + [len(owner)]):
            k = int(owner[i])
            a = int(block.begins[k])
            runs.setdefault(k, []).append(runs_of(item_at[i:j] - a, text_at[i:j], minimum))
            first, last = reach.get(k, (len(hashes), 0))
            reach[k] = min(first, int(text_at[i:j].min())), max(last, int(text_at[i:j].max()) + minimum)
            covered = under.setdefault(k, np.zeros(int(block.begins[k + 1]) - a, bool))
            covered[np.unique(item_at[i:j] - a)] = True
        x = y
    found: dict[int, tuple[float, int, int]] = {}
    best = 0.0
    for k in sorted(runs):
        a, b = int(block.begins[k]), int(block.begins[k + 1])
        # no tile can cover more than the seeds do
        most = float((np.convolve(under[k], np.ones(minimum, np.int64))[: b - a] > 0).sum()) / (b - a)
        if most < coverage and most < best:
            continue
        # the part of the text that seeds reach stands for all of it
        first, last = reach[k]
        n, p, t = _joined(runs[k], minimum)
        parts = _tiled(block.words[a:b], hashes[first:last], (n, p, t - first), minimum)
        got = (sum(n for *_, n in parts) / (b - a), int(block.ids[k]), len(parts))
        best = max(best, got[0])
        old = found.get(got[1])
        if old is None or (-got[0], got[2]) < (-old[0], old[2]):
            found[got[1]] = got
    ranked = sorted(found.values(), key=lambda g: (-g[0], g[1]))
    return ranked[:1] + [g for g in ranked[1:] if g[0] >= coverage]


def matches(column: pa.Array, block: Block, minimum: int, coverage: float) -> list[list[tuple[float, int, int]]]:
    """What each text of a column shares with a block (see ``_match``)."""
    out: list[list[tuple[float, int, int]]] = [[] for _ in range(len(column))]
    for w in W.words(column, W.ALNUM):
        bounds = w.bounds.tolist()
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            out[w.lo + i] = _match(w.hashes[a:b], block, minimum, coverage)
    return out


_FOUND = "struct<order:double,item_id:long,coverage:double,n_tiles:long>"


def _found(docs: DataFrame, block: Block, minimum: int, coverage: float, key: str) -> DataFrame:
    """``key`` and found (the matches of a block, the best first) for each row of ``docs (key, text)``."""

    def run(batches):
        for batch in batches:
            got = [[{"order": -c, "item_id": i, "coverage": c, "n_tiles": n} for c, i, n in g] for g in matches(batch.column(1), block, minimum, coverage)]
            kind = pa.struct([("order", pa.float64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(kind))], [key, "found"])

    return docs.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, found array<{_FOUND}>")


def _all_blocks(texts: DataFrame, benchmark: DataFrame, minimum: int, coverage: float) -> DataFrame:
    """at and found over all blocks, for the rows of ``texts (at, text)`` that share something with one."""
    passes = [stage(_found(texts, block, minimum, coverage, "at").where("size(found) > 0")) for block in blocks(benchmark, minimum)]
    every = functools.reduce(DataFrame.unionByName, passes).select("at", F.explode("found").alias("f"))
    # an id has all its items in one block; below the coverage only the best of all blocks stays
    ranked = every.groupBy("at").agg(F.sort_array(F.collect_list("f")).alias("found"))
    return ranked.withColumn("found", F.expr(f"filter(found, (x, k) -> k = 0 OR x.coverage >= {float(coverage)!r}D)"))


def _results(docs: DataFrame, benchmark: DataFrame, minimum: int, coverage: float) -> DataFrame:
    """doc_id and found for each row of ``docs``."""
    given = rows_of(docs, "doc_id", "text")
    if n_blocks(benchmark) == 1:
        return _found(given, next(blocks(benchmark, minimum)), minimum, coverage, "doc_id")
    numbered = stage(given.withColumn("at", F.monotonically_increasing_id()))
    found = _all_blocks(numbered.select("at", "text"), benchmark, minimum, coverage)
    return numbered.select("doc_id", "at").join(found, "at", "left").select("doc_id", F.coalesce("found", F.array().cast(f"array<{_FOUND}>")).alias("found"))


def pairs(docs: DataFrame, benchmark: DataFrame, *, minimum: int = MINIMUM, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles: every benchmark item that a row of ``docs`` covers to ``coverage`` or more."""
    every = _results(docs, benchmark, minimum, coverage).select("doc_id", F.explode("found").alias("f"))
    return every.select("doc_id", "f.item_id", "f.coverage", "f.n_tiles").where(F.col("coverage") >= coverage)


def scan(docs: DataFrame, benchmark: DataFrame, *, minimum: int = MINIMUM, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, contaminated, item_ids for each row of ``docs``: its best covered benchmark item, and all items
    that it covers to ``coverage`` or more, in order.

    Words are runs of letters and digits, A-Z folded. Items with fewer than ``minimum`` words match nothing. Documents that
    share no run of ``minimum`` words with any item (null and empty texts too) have a null item, coverage 0 and no tiles.
    """
    best = F.get("found", F.lit(0))
    over = F.filter("found", lambda f: f["coverage"] >= coverage)
    return _results(docs, benchmark, minimum, coverage).select(
        "doc_id", best["item_id"].alias("item_id"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.coalesce(best["n_tiles"], F.lit(0).cast("long")).alias("n_tiles"),
        (F.size(over) > 0).alias("contaminated"), F.array_sort(F.transform(over, lambda f: f["item_id"])).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, minimum: int = MINIMUM, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no benchmark item that far, with all their columns."""

    def clean(block, texts):
        return [not g or g[0][0] < coverage for g in matches(texts, block, minimum, coverage)]

    if n_blocks(benchmark) == 1:
        return filter_rows(docs, "text", functools.partial(clean, next(blocks(benchmark, minimum))))
    numbered = stage(docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("at")))
    found = _all_blocks(numbered.select("at", F.col("doc.text").alias("text")), benchmark, minimum, coverage)
    bad = found.where(F.get("found", F.lit(0))["coverage"] >= coverage).select("at")
    return numbered.join(bad, "at", "left_anti").select("doc.*")
