"""Source divergence audit: how far the word frequencies of the sources of a language lie apart, and by which terms.

1. Tasks count terms per (lang, source) over Arrow batches; Spark sums. A language keeps the terms that enough of its documents have.
2. Kept terms get ids from 0 per language, frequent ones first, so that terms with equal counts (most of all none) lie side by side.
   The ids are numbered within bands of frequency and shifted by the sizes of the bands before, without a sort of all terms.
3. The ids of a language are cut into blocks of ``WIDTH``, its sources into tiles of ``TILE``; each block with each two tiles is a
   task of its own. There each source is a segment tree over the block. Trees are hash-consed: level by level, equal (left, right)
   pairs become one node, so equal count subtrees of all sources are one.
4. The trees of two sources are walked at the same time from their roots. Node pairs that come up several times on a level are
   merged with their number, so each different pair is opened and priced once. Block sums are added in Spark.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.llm import words as W
from lumicat.llm.base import stage

#: Terms: runs of letters and of anything beyond ASCII, A-Z folded.
LETTERS = W.spec(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)
MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
WIDTH, TILE = 4_096, 64
#: Words that a task counts at a time, terms of one numbering window, and pairs of trees walked at a time.
HELD, NUMBERED, WALKED = 2_000_000, 100_000, 256


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed over all documents. Nulls are empty texts and names."""
    form = "lang string, source string, term string, n long, docs long"

    def run(batches):
        groups: dict = {}
        kept: list = []
        spelt: dict = {}
        size = 0

        def flush():
            nonlocal kept, spelt, size
            group, token, n, in_docs = (np.concatenate(x) for x in zip(*kept))
            by = np.lexsort((token, group))
            group, token, n, in_docs = group[by], token[by], n[by], in_docs[by]
            first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (token[1:] != token[:-1]))))
            n, in_docs = np.add.reduceat(n, first), np.add.reduceat(in_docs, first)
            names = list(groups)
            group, token = group[first], token[first]
            for a in range(0, len(first), 50_000):
                at = slice(a, a + 50_000)
                g = [names[k] for k in group[at].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in g], pa.string()), pa.array([x[1] for x in g], pa.string()), pa.array([spelt[t] for t in token[at].tolist()], pa.string()),
                     pa.array(n[at]), pa.array(in_docs[at])], ["lang", "source", "term", "n", "docs"])
            kept, spelt, size = [], {}, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = (batch.column(k).to_pylist() for k in (0, 1))
            row_group = np.array([groups.setdefault(x, len(groups)) for x in zip(lang, source)], np.int64)
            text = batch.column(2)
            data, places = W.buffers(text)
            for w in W.words(text, LETTERS):
                if not len(w.hashes):
                    continue
                row = np.repeat(np.arange(w.lo, w.hi), w.counts)
                by = np.lexsort((w.hashes, row))
                token, row = w.hashes[by], row[by]
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (token[1:] != token[:-1]))))
                n = np.diff(np.append(first, len(token)))
                kept.append((row_group[row[first]], token[first], n, np.ones(len(n), np.int64)))
                size += len(n)
                base = places[w.lo]
                new, at = np.unique(w.hashes, return_index=True)
                for t, a, b in zip(new.tolist(), (w.starts[at] + base).tolist(), (w.ends[at] + base).tolist()):
                    if t not in spelt:
                        # A-Z only: the lower() of bytes leaves all others
                        spelt[t] = data[a:b].tobytes().lower().decode()
                if size > HELD:
                    yield from flush()
        if kept:
            yield from flush()

    got = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("`text`").alias("text"))
    return got.mapInArrow(run, form).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _numbered(kept: DataFrame) -> DataFrame:
    """``kept (lang, term, n)`` with ``id`` from 0 per language, frequent terms first."""
    banded = kept.withColumn("band", -F.floor(F.log2(F.col("n").cast("double"))))
    # one row per language and power of two of the frequency
    deals = banded.groupBy("lang", "band").agg(F.ceil(F.count("*") / NUMBERED).alias("deals"))
    dealt = stage(banded.join(deals, ["lang", "band"]).withColumn("deal", F.pmod(F.xxhash64("term"), F.col("deals"))).drop("deals"))
    # one row per about NUMBERED terms
    before = dealt.groupBy("lang", "band", "deal").agg(F.count("*").alias("terms")).withColumn(
        "before", F.coalesce(F.sum("terms").over(Window.partitionBy("lang").orderBy("band", "deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("terms")
    place = F.row_number().over(Window.partitionBy("lang", "band", "deal").orderBy(F.desc("n"), "term")) - 1
    return dealt.withColumn("place", place).join(before, ["lang", "band", "deal"]).select("lang", "term", F.col("n").alias("all_n"), (F.col("place") + F.col("before")).alias("id"))


def prices(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), exact: three decimal digits at a time, so nothing overflows."""
    if len(total) and int(total.max()) >= 1 << 53:
        count, total = count.astype(object), total.astype(object)
    rest, out = count + PRIOR, count * 0
    for _ in range(3):
        whole, rest = rest // total, rest % total
        out, rest = (out + whole) * 1000, rest * 1000
    return 1 + out + rest // total


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Roots (a node per row), per level from the top the children of its nodes, and the counts of the leaf nodes.

    ``leaves``: one row per source, its width a power of two. Equal subtrees of whatever row and place are one node."""
    counts, node = np.unique(leaves, return_inverse=True)
    node = node.reshape(leaves.shape)
    levels = []
    while node.shape[1] > 1:
        size = int(node.max()) + 1 if node.size else 1
        both, at = np.unique(node[:, ::2].astype(np.int64) * size + node[:, 1::2], return_inverse=True)
        levels.append((both // size, both % size))
        node = at.reshape(len(leaves), -1)
    return node[:, 0], levels[::-1], counts


def distances(leaves: np.ndarray, totals: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows, the sum of price differences over all leaves; leaves of -1 are no terms."""
    root, levels, counts = consed(leaves)
    out = np.zeros(len(left), np.int64)
    for lo in range(0, len(left), WALKED):
        g, h = left[lo: lo + WALKED], right[lo: lo + WALKED]
        pair, a, b, times = np.arange(len(g)), root[g], root[h], np.ones(len(g), np.int64)
        for down, up in levels:
            pair, times = np.tile(pair, 2), np.tile(times, 2)
            a, b = np.concatenate((down[a], up[a])), np.concatenate((down[b], up[b]))
            size = int(max(a.max(), b.max())) + 1
            key, at = np.unique((pair * size + a) * size + b, return_inverse=True)
            merged = np.zeros(len(key), np.int64)
            np.add.at(merged, at, times)
            times, b, key = merged, key % size, key // size
            a, pair = key % size, key // size
        x, y = counts[a], counts[b]
        real = x >= 0
        pair, x, y, times = pair[real], x[real], y[real], times[real]
        apart = np.abs(prices(x, totals[g[pair]]) - prices(y, totals[h[pair]]))
        np.add.at(out, lo + pair, (apart * times).astype(np.int64))
    return out


def _pairs(counts: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, g, h, value: each two sources of a language once (g < h, numbers within the language).

    ``counts (lang, g, id, n)``, ``groups (lang, g, total, tiles)``, ``langs (lang, terms)``."""
    tile, block = F.floor(F.col("g") / TILE).cast("int"), F.floor(F.col("id") / WIDTH).cast("long")
    rows = counts.select("lang", "g", "tiles", block.alias("block"), F.pmod("id", F.lit(WIDTH)).cast("int").alias("at"), "n", F.lit(0).cast("long").alias("total"))
    # every source is in every block, with or without terms; a language without terms has one empty block
    blocks = langs.select("lang", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("terms") - 1) / WIDTH)).cast("long"))).alias("block"))
    width = F.least(F.lit(WIDTH), F.col("terms") - F.col("block") * WIDTH)
    heads = groups.join(blocks, "lang").select("lang", "g", "tiles", "block", F.lit(-1).alias("at"), width.cast("long").alias("n"), "total")
    met = (
        rows.unionByName(heads).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    )

    def price(key, table):
        low, high = key[2].as_py(), key[3].as_py()
        g, at, n, total = (table[c].to_numpy() for c in ("g", "at", "n", "total"))
        head = at < 0
        names, first = np.unique(g[head], return_index=True)
        totals, width = total[head][first], int(n[head].max())
        leaves = np.full((len(names), 1 << max(0, width - 1).bit_length()), -1, np.int64)
        leaves[:, :width] = 0
        leaves[np.searchsorted(names, g[~head]), at[~head]] = n[~head]
        of = names // TILE
        left, right = np.meshgrid(np.flatnonzero(of == low), np.flatnonzero(of == high), indexing="ij")
        fine = left < right
        left, right = left[fine], right[fine]
        value = distances(leaves, totals, left, right) if width > 0 and len(left) else np.zeros(len(left), np.int64)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "g": pa.array(names[left], pa.int64()), "h": pa.array(names[right], pa.int64()), "value": pa.array(value)})

    each = met.groupBy("lang", "block", "low", "high").applyInArrow(price, "lang string, g long, h long, value long")
    return each.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def _price(n: str, total: str) -> Column:
    return F.expr(f"1 + (cast({n} + {PRIOR} AS decimal(28,0)) * {SCALE}) div cast({total} AS decimal(28,0))")


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs (text, lang, source)``; nulls in any of them count as ''.

    Part ``pair``: every other source of the language, by the sum of |p - q| over the language's kept terms. Part ``term``: the ``top``
    terms that a group has and uses more often than its language, by p - q. Ranks by value, largest first, ties by item in byte
    order. A language without kept terms has pairs of value 0 and no terms; a group without terms is a group. Repeated rows are
    documents of their own. An empty table gives no rows.
    """
    counted = stage(term_counts(docs))
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    terms = stage(_numbered(stage(kept)))
    used = stage(counted.select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    names = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    # one row per language, one per group
    langs = names.select("lang").distinct().join(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("words")), "lang", "left").na.fill(0)
    langs = stage(langs.withColumn("lang_total", F.col("words") + PRIOR * F.col("terms")).drop("words"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = names.join(sums, ["lang", "source"], "left").na.fill(0, ["words"]).join(langs, "lang").withColumn("total", F.col("words") + PRIOR * F.col("terms"))
    whole = Window.partitionBy("lang")
    groups = groups.withColumn("g", F.row_number().over(whole.orderBy("source")).cast("long") - 1).withColumn("tiles", F.ceil(F.count("*").over(whole) / TILE).cast("int"))
    groups = stage(groups)

    ids = used.join(groups.select("lang", "source", "g", "tiles"), ["lang", "source"])
    pairs = stage(_pairs(ids.select("lang", "g", "tiles", "id", "n"), groups.select("lang", "g", "tiles", "total"), langs.select("lang", "terms")))
    both = pairs.unionByName(pairs.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    named = groups.select("lang", "g", "source")
    pair = both.join(named, ["lang", "g"]).join(named.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")

    over = used.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).where("n > 0").withColumn("value", _price("n", "total") - _price("all_n", "lang_total"))
    term = over.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by)
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
