"""Similarity join on word n-gram sets with vertical partitioning.

N-grams have one global order: rare before frequent. The order is cut into ``FRAGMENTS`` pieces; a document's set falls
into segments, one per piece. The overlap of two documents is counted in each fragment apart and summed per pair.

1. Each text gives its set size and a class: the hash of its set. Equal sets are one class, so copies cost nothing below.
   Tasks count n-grams in a sketch of fixed size; the sum of all tasks' sketches gives each n-gram a frequency and so its place
   in the order, however the documents are dealt (the order decides about speed only).
2. Each class gives its prefix: so many of its first n-grams that two linked sets must share one of them. Equal n-grams
   meet; what stays alone is dropped. In ``ROUNDS`` rounds each n-gram names one of its classes per order of size as hub: the
   one that shares most of its prefix with others (as the source of a group of copies does), later also one at random. Each class
   is compared with the hubs of either kind that most of its n-grams name, unless they are joined already. These stars join
   a group of near copies without listing its pairs.
3. Of what is left, n-grams whose documents lie in different components give candidate pairs, where a signature of both sets
   allows it: the parity of the n-grams in each of ``BITS`` cells. Sets differ in at least as many n-grams as their signatures
   in bits, which bounds the overlap from above. Shared prefix n-grams are counted per pair; with the places of the last one
   they bound the overlap, and pairs that cannot reach the threshold go. The rest is verified.
4. Verification sends the segments of the pairs' documents to (pair, fragment), counts, and sums per pair.

Links within a component that step 2 found are not listed, links between different components all are, so components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicat.llm import words as W
from lumicat.llm.base import chosen, fanout, release, rows_of, stage
from lumicat.llm.bitmap import Bitmap, bitmap
from lumicat.llm.components import components

N = 5
#: Linked: PERCENT * size of the union <= 100 * size of the intersection.
PERCENT = 75
FRAGMENTS = 8
#: Fragments that are compared before the others.
FIRST = 2
#: The sketch of n-gram frequencies: tables, counters of each, counters of a slice; n-grams that a task counts at a time; lots of tasks.
ROWS, CELLS, SLICE, BLOCK, LOTS = 2, 1 << 20, 1 << 14, 500_000, 32
#: Prefix n-grams that a task deals out or lets meet at a time.
RANGE = 1_000_000
#: Rounds of stars; a hub has to be named by so many n-grams, as a share of the set. Both decide about the work left to step 3 only.
ROUNDS, NAMED = 2, 0.1
FAR = 65_535
#: Cells of a set's signature, a multiple of 64. Decides about speed only.
BITS = 512


def sets(column: pa.Array, n: int = N):
    """The set of each text in turn, as sorted hashes: its n-word shingles; the whole sequence if it has fewer words;
    nothing without words."""
    for w in W.words(column, W.FOLDED):
        whole, bounds = W.grams(w.hashes, n), w.bounds
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                got = np.sort(whole[a: b - n + 1])
                yield got[np.concatenate(([True], got[1:] != got[:-1]))]
            else:
                yield W.grams(w.hashes[a:b], b - a) if b > a else whole[:0]


def class_of(shingles: np.ndarray) -> int:
    """A hash of the set, as a signed number."""
    with np.errstate(over="ignore"):
        total = W.mix(shingles).sum(dtype=W.U64) + W.U64(len(shingles)) * W.U64(W.BASE)
    return int(W.mix(np.array([total]))[0].astype(np.int64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The parity of the n-grams in each of ``BITS`` cells, as signed 64-bit numbers."""
    odd = np.bincount((shingles & W.U64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """One row per document (doc_id, n_shingles, class, bits: its signature), and rows with a task's counts of n-grams for the sketch
    (class null)."""
    names = ["doc_id", "n_shingles", "class", "bits", "slice", "counts"]
    wide = BITS // 64

    def run(batches):
        sketch, held, size, kind = Sketch.empty(), [], 0, None
        for batch in batches:
            kind, lengths, classes, bits = batch.column(0).type, [], [], [np.empty(0, np.int64)]
            for got in sets(batch.column(1), n):
                lengths.append(len(got))
                classes.append(class_of(got))
                bits.append(signature(got))
                held.append(got)
                size += len(got)
                if size > BLOCK:
                    Sketch.add(sketch, np.concatenate(held))
                    held, size = [], 0
            rows = len(lengths)
            lists = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * wide, pa.array(np.concatenate(bits)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(classes, pa.int64()), lists, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if kind is not None:
            if size:
                Sketch.add(sketch, np.concatenate(held))
            at, packed = Sketch.slices(sketch)
            none = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(none, kind), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())), pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names)
        release()

    return rows_of(docs, "doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, class long, bits array<long>, slice int, counts binary")


class Sketch:
    """How often n-grams occur, from above: ``ROWS`` tables of ``CELLS`` counters. An n-gram adds to one counter of each; its frequency is the
    smallest of them. Counters of all tasks are summed, so the estimate does not depend on how the documents are dealt."""

    @staticmethod
    def empty() -> np.ndarray:
        return np.zeros((ROWS, CELLS), np.int64)

    @staticmethod
    def cells(tokens: np.ndarray) -> Iterator[np.ndarray]:
        bits = W.U64(CELLS.bit_length() - 1)
        yield (tokens & W.U64(CELLS - 1)).astype(np.int64)
        for row in range(1, ROWS):
            yield (tokens * W.U64(W.BASE + 2 * row) >> (W.U64(64) - bits)).astype(np.int64)

    @staticmethod
    def add(sketch: np.ndarray, tokens: np.ndarray) -> None:
        for row, at in enumerate(Sketch.cells(tokens)):
            sketch[row] += np.bincount(at, minlength=CELLS)

    @staticmethod
    def slices(sketch: np.ndarray) -> tuple[list[int], list[bytes]]:
        """The slices that hold anything: few counters as places and counts, many as they are, in as few bytes as the largest takes."""
        at, packed = [], []
        for k, part in enumerate(sketch.reshape(-1, SLICE)):
            most = int(part.max())
            if most:
                kind = next(x for x in "1248" if most < 1 << 8 * int(x))
                used = np.flatnonzero(part)
                if len(used) * (2 + int(kind)) < SLICE * int(kind):
                    packed.append(b"s" + kind.encode() + used.astype("<u2").tobytes() + part[used].astype(f"<u{kind}").tobytes())
                else:
                    packed.append(b"d" + kind.encode() + part.astype(f"<u{kind}").tobytes())
                at.append(k)
        return at, packed

    @staticmethod
    def summed(packed) -> np.ndarray:
        total = np.zeros(SLICE, np.int64)
        for value in packed:
            value = value.as_py()
            kind = int(value[1:2])
            if value[:1] == b"s":
                some = (len(value) - 2) // (2 + kind)
                total[np.frombuffer(value, "<u2", some, 2)] += np.frombuffer(value, f"<u{kind}", some, 2 + 2 * some).astype(np.int64)
            else:
                total += np.frombuffer(value, f"<u{kind}", SLICE, 2).astype(np.int64)
        return total


def _sketched(profile: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters; ``ROWS`` * ``CELLS`` of them reach the driver."""

    def merge(key, slices):
        at, packed = Sketch.slices(Sketch.summed(slices["counts"]))
        return pa.table({"slice": pa.array([key[0].as_py()] * len(at), pa.int32()), "counts": pa.array(packed, pa.binary())})

    form = "slice int, counts binary"
    rows = profile.where("class IS NULL AND slice IS NOT NULL").select("slice", "counts")
    # in two steps, so that no task holds what all tasks have sent for a slice
    some = rows.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(LOTS))).groupBy("slice", "lot").applyInArrow(merge, form)
    sketch = Sketch.empty()
    for row in some.groupBy("slice").applyInArrow(merge, form).collect():
        sketch.reshape(-1, SLICE)[row.slice] = Sketch.summed([pa.scalar(bytes(row.counts), pa.binary())])
    return sketch


class Order:
    """The global order of n-grams as a number: rare before frequent by the sketch (in steps of a quarter of a power of two), then by hash."""

    def __init__(self, sketch: np.ndarray):
        self.step = np.minimum(np.floor(4 * np.log2(np.maximum(sketch, 1))), 127).astype(np.uint8)
        # the order is cut where the n-grams before reach the next share of all
        mass = np.bincount(self.step[0], weights=sketch[0], minlength=128)
        before = np.cumsum(mass) - mass
        wanted = mass.sum() * np.arange(1, FRAGMENTS) / FRAGMENTS
        level = np.searchsorted(before, wanted, side="right") - 1 if mass.sum() else np.zeros(FRAGMENTS - 1, np.int64)
        share = np.clip((wanted - before[level]) / np.maximum(mass[level], 1), 0, 1 - 2.0**-50)
        self.cuts = (level.astype(W.U64) << W.U64(57)) + (share * 2.0**57).astype(W.U64)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        step = None
        for row, at in enumerate(Sketch.cells(tokens)):
            step = self.step[row][at] if step is None else np.minimum(step, self.step[row][at])
        return step.astype(W.U64) << W.U64(57) | tokens >> W.U64(7)

    def fragments(self, tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.keys(tokens), side="right")


def _postings(docs: DataFrame, order: Order, n: int, percent: int, total: int) -> DataFrame:
    """token, class, n, place: prefix n-grams that several classes have. ``place``: from 0 in the class's order, at most ``FAR``.
    ``total``: size of all sets. N-grams meet in ranges of about ``RANGE`` of them, one at a time in a task."""
    spark = docs.sparkSession
    tasks = fanout(spark)
    parts = tasks * max(1, -(-total * (100 - percent) // (100 * tasks * RANGE)))

    def deal(tokens, places, owners, classes, sizes):
        tokens, places, owners = np.concatenate(tokens), np.concatenate(places), np.concatenate(owners)
        classes, sizes = np.array(classes, np.int64), np.array(sizes, np.int32)
        part = (W.mix(tokens) % W.U64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(parts + 1))
        for k in range(parts):
            at = by[cuts[k]: cuts[k + 1]]
            if len(at):
                used, owner = np.unique(owners[at], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (tokens[at], places[at], owner.astype(np.uint32), classes[used], sizes[used]))],
                    ["part", "tokens", "places", "owner", "classes", "sizes"])

    def send(batches):
        seen, tokens, places, owners, classes, sizes, held = set(), [], [], [], [], [], 0
        for batch in batches:
            for got in sets(batch.column(0), n):
                key = class_of(got)
                if not len(got) or key in seen:
                    continue
                seen.add(key)
                length = _prefix_length(len(got), percent)
                keys = order.keys(got)
                first = np.argpartition(keys, length - 1)[:length]
                tokens.append(got[first[np.argsort(keys[first])]])
                places.append(np.minimum(np.arange(length), FAR).astype(np.uint16))
                owners.append(np.full(len(tokens[-1]), len(classes), np.int64))
                classes.append(key)
                sizes.append(len(got))
                held += len(tokens[-1])
                if held > RANGE:
                    yield from deal(tokens, places, owners, classes, sizes)
                    tokens, places, owners, classes, sizes, held = [], [], [], [], [], 0
        if held:
            yield from deal(tokens, places, owners, classes, sizes)
        release()

    def meet(batches):
        found, now = [[], [], [], []], None
        for batch in batches:
            for part, tokens, places, owner, classes, sizes in zip(*batch.columns):
                if part != now and found[0]:
                    yield from meet_range(*(np.concatenate(x) for x in found))
                    found = [[], [], [], []]
                now = part
                owner = np.frombuffer(owner.as_py(), np.uint32)
                found[0].append(np.frombuffer(tokens.as_py(), W.U64))
                found[1].append(np.frombuffer(classes.as_py(), np.int64)[owner])
                found[2].append(np.frombuffer(sizes.as_py(), np.int32)[owner])
                found[3].append(np.frombuffer(places.as_py(), np.uint16))
        if found[0]:
            yield from meet_range(*(np.concatenate(x) for x in found))
        del found
        release()

    def meet_range(token, key, size, place):
        # only tokens that several rows have; then one row per token and class
        by = np.argsort(token)
        same = token[by[1:]] == token[by[:-1]]
        by = by[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        by = by[np.lexsort((key[by], token[by]))]
        token, key, size, place = token[by], key[by], size[by], place[by]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, size, place = token[first], key[first], size[first], place[first]
        same = token[1:] == token[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(token) else first[:0]
        token, key, size, place = token[keep], key[keep], size[keep], place[keep]
        for a in range(0, len(token), 100_000):
            at = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[at].view(np.int64)), pa.array(key[at]), pa.array(size[at]), pa.array(place[at].astype(np.int32))], ["token", "class", "n", "place"])

    return (
        rows_of(docs, "text").mapInArrow(send, "part int, tokens binary, places binary, owner binary, classes binary, sizes binary")
        .repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part").mapInArrow(meet, "token long, class long, n int, place int")
    )


def _segments(docs: DataFrame, has, order: Order, n: int, part: range, named: Bitmap | None = None) -> DataFrame:
    """class, fragment, size, tokens: the sets of the rows whose ids pass ``has``, cut along the global order; the fragments of ``part``
    only, and of ``named`` classes."""

    def run(batches):
        for batch in chosen(batches, 0, has):
            classes, fragments, sizes, tokens = [], [], [], []
            for got in sets(batch.column(1), n):
                key = class_of(got)
                if named is not None and not named.has(np.array([key], np.int64))[0]:
                    continue
                at = order.fragments(got)
                for k in part:
                    mine = got[at == k]
                    if len(mine):
                        classes.append(key)
                        fragments.append(k)
                        sizes.append(len(mine))
                        tokens.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(fragments, pa.int32()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary())], ["class", "fragment", "size", "tokens"])

    return rows_of(docs, "doc_id", "text").mapInArrow(run, "class long, fragment int, size int, tokens binary")


def _partial(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared: the overlap of the pairs within the given segments, where there is any."""

    def count(batches):
        for batch in batches:
            shared = [len(np.intersect1d(np.frombuffer(x.as_py(), W.U64), np.frombuffer(y.as_py(), W.U64), assume_unique=True)) for x, y in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(shared, pa.int64())], ["a", "b", "fragment", "shared"])

    left = parts.select(F.col("class").alias("a"), "fragment", F.col("tokens").alias("ta"))
    right = parts.select(F.col("class").alias("b"), "fragment", F.col("tokens").alias("tb"))
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "fragment", "ta", "tb")
    # a document that stands twice in the table counts once
    each = met.mapInArrow(count, "a long, b long, fragment int, shared long").groupBy("a", "b", "fragment").agg(F.max("shared").alias("shared"))
    return each.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def linked_pairs(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order: Order, n: int, percent: int) -> DataFrame:
    """a, b: the pairs (of classes) that are linked. ``classes``: class, n, doc_id of one of its documents.

    The first fragments come first. What lies outside them can't be shared beyond the rest of the smaller side, so most pairs that
    are not linked end there, and only the others send their remaining segments.
    """
    def wanted(pairs):
        ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        return stage(ends.join(classes, "class").select("doc_id", "class", "n"))

    def segments(ends, part):
        # documents are found by id; those without one by their class, which only they have to be read for
        count = ends.count()
        marks, nulls = bitmap(ends.select("doc_id"), count), not ends.where("doc_id IS NULL").isEmpty()
        named = bitmap(ends.select("class"), count) if nulls else None

        def has(ids):
            some = marks.has(ids.fill_null(0).to_numpy(zero_copy_only=False))
            none = ids.is_null().to_numpy(zero_copy_only=False)
            return some & ~none | none & nulls

        return _segments(docs, has, order, n, part, named)

    ends = wanted(pairs)
    parts = stage(segments(ends, range(FIRST)).join(ends.select("class"), "class", "left_semi"))
    rest = parts.groupBy("class", "fragment").agg(F.max("size").alias("size")).groupBy("class").agg(F.sum("size").alias("size"))
    rest = ends.join(rest, "class", "left").select("class", "n", (F.col("n") - F.coalesce("size", F.lit(0))).alias("rest"))
    known = (
        pairs.join(_partial(parts, pairs), ["a", "b"], "left").join(rest.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra")), "a")
        .join(rest.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb")), "b").withColumn("first", F.coalesce("shared", F.lit(0)))
    )
    need = f"{100 + percent}L * ({{}}) >= {percent}L * (cast(na AS long) + nb)"
    left = stage(known.where(need.format("first + least(ra, rb)")).select("a", "b", "na", "nb", "first"))
    others = _partial(segments(wanted(left), range(FIRST, FRAGMENTS)), left)
    return left.join(others, ["a", "b"], "left").where(need.format("first + coalesce(shared, 0)")).select("a", "b")


def near_copies(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs (doc_id long, text)``.

    ``component_id`` is the smallest doc_id that is reached by links; a document without words has its own. Null texts
    count as empty. Rows with the same doc_id are rows of their own; a null doc_id never becomes a component's id unless
    nothing else is in it. An empty table gives no rows.
    """
    profile = stage(_profile(docs, n))
    order = Order(_sketched(profile))
    rows = profile.where("class IS NOT NULL").select("doc_id", "n_shingles", "class")
    known_sets = profile.where("class IS NOT NULL AND n_shingles > 0")
    # aggregated as numbers, which Spark does in a hash table; equal sets have equal signatures
    words = [F.first(F.get("bits", F.lit(k))).alias(f"bits{k}") for k in range(BITS // 64)]
    classes = stage(known_sets.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").cast("int").alias("n"), *words))

    def linked(pairs):
        return stage(linked_pairs(docs, pairs, classes.select("class", "doc_id", "n"), order, n, percent).select(F.col("a").alias("u"), F.col("b").alias("v")))

    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    postings = stage(_postings(docs, order, n, percent, total))
    postings = stage(postings.join(postings.groupBy("class").agg(F.count("*").cast("int").alias("several")), "class"))
    rich = postings.withColumn("shared", F.col("several") / F.col("n")).where(F.col("shared") >= NAMED)
    known = None
    for turn in range(ROUNDS + 1):
        pairs = stage(_stars(_placed(rich, known), turn, percent) if turn < ROUNDS else _open_pairs(_placed(postings, known), classes, percent))
        found = linked(pairs)
        if not found.isEmpty():
            joined = found if known is None else found.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
            known = stage(components(joined))
    if known is None:
        known = classes.select(F.col("class").alias("node"), F.col("class").alias("component")).limit(0)

    owner = stage(
        classes.join(known.withColumnRenamed("node", "class"), "class", "left").select("class", "doc_id", F.coalesce("component", "class").alias("component")))
    smallest = owner.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage(owner.join(smallest, "component").select("class", "component_id"))
    return rows.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _placed(postings: DataFrame, known: DataFrame | None) -> DataFrame:
    """The postings with the component of each class; a class that no link has reached is its own."""
    if known is None:
        return postings.withColumn("component", F.col("class"))
    return postings.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _stars(postings: DataFrame, turn: int, percent: int) -> DataFrame:
    """a, b: each class with the hubs that most of its n-grams name. Sizes are cut into orders elsewhere in each turn."""
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + turn / ROUNDS)
    sized = postings.withColumn("step", step)
    one, chance = F.struct("class", "component"), F.xxhash64("class", F.lit(turn))
    hubs = sized.groupBy("token", "step").agg(F.max_by(one, F.struct("shared", chance)).alias("source"), F.min_by(one, chance).alias("random"), F.count("*").alias("several")).where("several > 1")
    named = sized.join(hubs, ["token", "step"]).select("class", "n", "component", F.posexplode(F.array("source", "random") if turn else F.array("source")).alias("kind", "hub"))
    named = named.where("component <> hub.component").groupBy("class", "n", "kind", F.col("hub.class").alias("hub")).agg(F.count("*").alias("names"))
    best = Window.partitionBy("class", "kind").orderBy(F.desc("names"), "hub")
    return named.where(F.col("names") >= F.col("n") * NAMED).withColumn("best", F.row_number().over(best)).where("best = 1").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()


def _behind(n: str, percent: int) -> str:
    """What a set of ``n`` has beyond its prefix: no more than that is shared beyond the prefix that ends first."""
    return f"(({percent}L * {n} + 99) div 100 - 1)"


def _meetings(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """x, y, begins, ends: classes (class, n, place, several, turn) of the open pairs at each begin and end of a run of prefix n-grams
    that they share: n-grams that follow each other in both, among those that lead to open pairs. The n-grams within a run
    bring nothing new, and long texts share hundreds. ``turn``: the n-gram's number in the class, so a run's length is the
    difference of its end and its begin and one."""
    tokens = postings.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component", True).alias("main")).where("low < high")
    bits = [f"bits{k}" for k in range(BITS // 64)]
    order = Window.partitionBy("class").orderBy("place", "token")
    turns = postings.join(tokens.select("token", "main"), "token").withColumns(
        {"turn": F.row_number().over(order), "before": F.lag("token").over(order), "after": F.lead("token").over(order)})
    left = stage(turns.join(classes.select("class", *bits), "class"))
    # pairs of the token's main component with itself need no look, so only others are on one side
    one = F.struct("class", "n", "place", "several", "turn", "before", "after", *bits)
    x = left.where("component <> main").select("token", one.alias("x"), F.col("component").alias("cx"))
    y = left.select("token", one.alias("y"), F.col("component").alias("cy"), (F.col("component") == F.col("main")).alias("other"))
    rest = lambda n: _behind(n, percent)

    # before this n-gram at most as many are shared as the smaller place, behind it at most what the shorter rest holds
    ahead, behind = (f"least({', '.join(f'if({k}.place < {FAR}, {k}.place, {k}.n)' for k in 'xy')})", "least(x.n - x.place, y.n - y.place)")
    # sets differ in so many n-grams at least
    apart = " + ".join(f"bit_count(x.{k} ^ y.{k})" for k in bits)
    met = x.join(y, "token").where(
        f"cx <> cy AND NOT coalesce(x.before = y.before AND x.after = y.after, false) AND (other OR x.class < y.class) AND 100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n) "
        f"AND {100 + percent}L * ({ahead} + {behind}) >= {percent}L * (x.n + y.n) "
        f"AND {100 + percent}L * (least(x.several, y.several) + greatest({rest('x.n')}, {rest('y.n')})) >= {percent}L * (x.n + y.n) "
        f"AND {100 + percent}L * (x.n + y.n - ({apart})) >= {2 * percent}L * (x.n + y.n)")
    side = lambda k: F.struct(*(F.col(f"{k}.{name}") for name in ("class", "n", "place", "several", "turn")))
    return met.select(F.least(side("x"), side("y")).alias("x"), F.greatest(side("x"), side("y")).alias("y"),  # by class first
                      F.expr("NOT coalesce(x.before = y.before, false)").alias("begins"), F.expr("NOT coalesce(x.after = y.after, false)").alias("ends"))


def _open_pairs(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: classes of different components that can still be linked by what their signatures and prefixes share."""
    shared = _meetings(postings, classes, percent).groupBy("x.class", F.col("y.class").alias("b"), "x.n", F.col("y.n").alias("nb")).agg(
        F.expr("sum(if(ends, x.turn, 0) - if(begins, x.turn - 1, 0))").alias("shared"), F.max("x.place").alias("i"), F.max("y.place").alias("j"))
    most = f"least(shared - 1 + least(n - i, nb - j), shared + greatest({_behind('n', percent)}, {_behind('nb', percent)}))"
    return shared.where(f"{100 + percent}L * {most} >= {percent}L * (n + nb)").select(F.col("class").alias("a"), "b")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each component, all columns as they are: the one with its smallest doc_id. An id stays if one of its
    rows is that one; documents without words and null ids stay."""
    marked = near_copies(docs, **how)
    gone = stage(marked.groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
