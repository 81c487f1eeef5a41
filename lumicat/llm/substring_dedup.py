"""Substring dedup: words of passages that also stand earlier are taken out, found with FM-indexes over shards.

A window is ``SPAN`` consecutive words of one document. A word goes if a window that covers it has a word sequence that
starts earlier as well: in a document with a smaller doc_id, or earlier in the same one.

1. Texts that are equal word for word form a class; all but the smallest doc_id go as a whole, and only the smallest is looked at below.
2. Each window has an anchor: the ``ANCHOR``-word run in it with the smallest hash. Equal windows have equal anchors, and
   neighbouring windows share one, so a passage is a run of windows with one anchor. Anchors are counted; passages with
   an anchor that occurs once can't repeat anything.
3. The other passages go to the shard of their anchor. A passage that a task meets again is decided there and then and is
   not sent. Passages of very frequent anchors are cut into single windows, which go by their own hash.
4. Each shard builds an FM-index over its passages in document order. The passages stream through it: backward search
   gives the matching statistic at each window's end, and where it reaches ``SPAN`` words the rows of that window, whose
   first place says whether this window stands earlier too. Reported word ranges go back to their documents.

Rows with one doc_id count as one document whose word positions coincide; a null doc_id comes after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm import words as W
from lumicat.llm.base import chosen, fanout, filter_rows, release, stage
from lumicat.llm.bitmap import bitmap
from lumicat.llm.fm_index import FMIndex

SPAN = 20
ANCHOR = 6
#: Words of an index, about. A shard with more passages builds several, cut between anchors.
INDEX_WORDS = 400_000
#: An anchor is very frequent from this count on, or this share of all.
OFTEN, OFTEN_SHARE = 1_000, 1e-4
HELD = 50_000  # passages that a task keeps before it sends them
LAST = (1 << 63) - 1


def _class(hashes: np.ndarray) -> int:
    """A hash of the whole word sequence."""
    return W.sequence(hashes)


def _passages(w: W.Words, span: int):
    """Row, first word in the piece, number of windows and anchor of each run of windows with one anchor."""
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    anchors = W.grams(w.hashes, ANCHOR)
    if len(w.hashes) < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, W.U64),)
    reach = span - ANCHOR + 1
    at = np.arange(len(w.hashes) - span + 1)
    at = at[row[at] == row[at + span - 1]]
    place = at + np.lib.stride_tricks.sliding_window_view(anchors, reach)[at].argmin(axis=1)
    begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(at) != 1)))) if len(at) else at
    count = np.diff(np.append(begin, len(at)))
    first = at[begin]
    return row[first], first, count, anchors[place[begin]]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))


def _profile(docs: DataFrame) -> DataFrame:
    """id, n_words, class."""

    def run(batches):
        for batch in batches:
            counts, classes = [], []
            for w in W.words(batch.column(1), W.WORDS):
                bounds = w.bounds
                counts += w.counts.tolist()
                classes += [_class(w.hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(_ids(batch.column(0))), pa.array(counts, pa.int64()), pa.array(classes, pa.int64())], ["id", "n_words", "class"])

    return _texts(docs).mapInArrow(run, "id long, n_words long, class long")


def _anchor_counts(texts: DataFrame, first, span: int) -> DataFrame:
    """anchor, count of those that occur more than once, in the rows whose ids pass ``first``. A task sends each of its anchors once, with a
    count."""
    parts = fanout(texts.sparkSession)

    def deal(found):
        anchor, count = np.unique(np.concatenate(found), return_counts=True)
        part = (W.mix(anchor) % W.U64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(parts + 1))
        for k in range(parts):
            at = by[cuts[k]: cuts[k + 1]]
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([anchor[at].tobytes()], pa.binary()), pa.array([count[at].astype(np.uint32).tobytes()], pa.binary())], ["part", "anchors", "counts"])

    def send(batches):
        found, held = [], 0
        for batch in chosen(batches, 0, first):
            for w in W.words(batch.column(1), W.WORDS):
                found.append(_passages(w, span)[3])
                held += len(found[-1])
                if held > 1_000_000:
                    yield from deal(found)
                    found, held = [], 0
        if held:
            yield from deal(found)
        del found
        release()

    def meet(batches):
        got = [(np.frombuffer(a.as_py(), W.U64), np.frombuffer(c.as_py(), np.uint32)) for batch in batches for a, c in zip(batch.column(1), batch.column(2))]
        if got:
            anchor, at = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([x for _, x in got])).astype(np.int64)
            anchor, count = anchor[count > 1].view(np.int64), count[count > 1]
            for a in range(0, len(anchor), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[a: a + 100_000]), pa.array(count[a: a + 100_000])], ["anchor", "count"])

    return texts.mapInArrow(send, "part int, anchors binary, counts binary").repartitionById(parts, "part").mapInArrow(meet, "anchor long, count long")


class _Outbox:
    """Passages of a task by shard: each word sequence once, with its earliest place; later ones are decided."""

    def __init__(self, parts: int, span: int):
        self.parts, self.span, self.held, self.done = parts, span, {}, []

    def put(self, key: bytes, anchor: int, place: tuple[int, int, int]):
        old = self.held.get(key)
        if old is None:
            self.held[key] = [anchor, place]
        else:
            if (place[0], place[2]) < (old[1][0], old[1][2]):
                place, old[1] = old[1], place
            if (place[0], place[2]) != (old[1][0], old[1][2]):
                self.done.append((place[0], place[1], place[2], place[2] + len(key) // 8))

    def send(self):
        """One row per shard: passages (words, lengths, anchor, id, class, start), and decided ranges by any row."""
        items = list(self.held.items())
        anchor = np.array([x[1][0] for x in items], W.U64)
        part = (W.mix(anchor ^ W.U64(W.BASE)) % W.U64(self.parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(self.parts + 1))
        share = -(-len(self.done) // self.parts)
        for k in range(self.parts):
            at = by[cuts[k]: cuts[k + 1]].tolist()
            done = np.array(self.done[k * share: (k + 1) * share], np.int64)
            if at or len(done):
                keys = [items[i][0] for i in at]
                meta = np.array([(items[i][1][0] - (1 << 64) if items[i][1][0] >= 1 << 63 else items[i][1][0], *items[i][1][1], len(items[i][0]) // 8) for i in at], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"".join(keys), meta.tobytes(), done.tobytes()))], ["part", "words", "meta", "done"])
        self.held, self.done = {}, []


def _search(words: np.ndarray, meta: np.ndarray, span: int):
    """Word ranges (id, class, start, end) that one index reports for its passages. ``meta``: anchor, id, class, start, words."""
    ends = np.cumsum(meta[:, 4])
    keys: dict[bytes, list] = {}
    for (_, doc, kind, start, n), b in zip(meta.tolist(), ends.tolist()):
        keys.setdefault(words[b - n: b].tobytes(), []).append((doc, start, kind))
    out, passages = [], []
    for key, places in keys.items():
        places.sort()
        n = len(key) // 8
        passages.append((places[0][0], places[0][1], key))
        for doc, start, kind in places:
            if (doc, start) != places[0][:2]:
                out.append((doc, kind, start, start + n))
    passages.sort()
    _, number = np.unique(np.frombuffer(b"".join(p[2] for p in passages), W.U64), return_inverse=True)
    size = np.array([len(p[2]) // 8 for p in passages])
    # passages in document order, a separator behind each
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(begin[-1], np.int64)
    text[np.arange(len(number)) + np.repeat(np.arange(len(size)), size)] = number + 1
    index = FMIndex(text, span)
    windows = size - span + 1
    of = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    length, lo, hi = index.matching(text, begin[of] + offset + span, span)
    assert (length == span).all()
    earliest = index.first_places(lo, hi)
    owner = np.searchsorted(begin, earliest, side="right") - 1
    doc, start = np.array([p[0] for p in passages]), np.array([p[1] for p in passages])
    there, here = start[owner] + earliest - begin[owner], start[of] + offset
    later = (doc[owner] < doc[of]) | (doc[owner] == doc[of]) & (there < here)
    # runs of reported windows are one range
    at = np.flatnonzero(later)
    if len(at):
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]]))))
        last = np.append(cut[1:], len(at)) - 1
        for a, b in zip(at[cut].tolist(), at[last].tolist()):
            first = passages[of[a]]
            for d, s, kind in keys[first[2]]:
                if (d, s) == first[:2]:
                    out.append((d, kind, s + int(offset[a]), s + int(offset[b]) + span))
    return out


def _ranges(texts: DataFrame, first, counts: DataFrame, span: int) -> DataFrame:
    """id, class, start, end of the words to remove in the rows whose ids pass ``first``."""
    spark = texts.sparkSession
    parts = fanout(spark)
    shared, total = counts.agg(F.count("*"), F.sum("count")).first()
    known = bitmap(counts.select("anchor"), shared)
    often = counts.where(F.col("count") >= max(OFTEN, int(OFTEN_SHARE * (total or 0)))).select("anchor").toArrow()["anchor"]  # at most 1 / OFTEN_SHARE
    often = np.sort(often.to_numpy()).view(W.U64) if len(often) else np.zeros(0, W.U64)

    def send(batches):
        box = _Outbox(parts, span)
        for batch in chosen(batches, 0, first):
            ids = _ids(batch.column(0))
            for w in W.words(batch.column(1), W.WORDS):
                row, begin, count, anchor = _passages(w, span)
                at = np.flatnonzero(known.has(anchor.view(np.int64)))
                row, begin, count, anchor, bounds = row[at], begin[at], count[at], anchor[at], w.bounds
                single = np.isin(anchor, often)
                classes: dict[int, int] = {}
                for r, a, n, key, alone in zip(row.tolist(), begin.tolist(), count.tolist(), anchor.tolist(), single.tolist()):
                    kind = classes.get(r)
                    if kind is None:
                        kind = classes[r] = _class(w.hashes[bounds[r]: bounds[r + 1]])
                    doc, start = int(ids[w.lo + r]), a - int(bounds[r])
                    if alone:
                        for j in range(n):
                            own = w.hashes[a + j: a + j + span]
                            box.put(own.tobytes(), W.sequence(own) & (1 << 64) - 1, (doc, kind, start + j))
                    else:
                        box.put(w.hashes[a: a + n + span - 1].tobytes(), key, (doc, kind, start))
                if len(box.held) + len(box.done) > HELD:
                    yield from box.send()
        yield from box.send()
        del box
        release()

    def meet(batches):
        words, meta, done = [], [], []
        for batch in batches:
            for a, b, c in zip(batch.column(1), batch.column(2), batch.column(3)):
                words.append(np.frombuffer(a.as_py(), W.U64))
                meta.append(np.frombuffer(b.as_py(), np.int64).reshape(-1, 5))
                done.append(np.frombuffer(c.as_py(), np.int64).reshape(-1, 4))
        if not meta:
            return
        words, meta, done = np.concatenate(words), np.concatenate(meta), np.concatenate(done)
        yield from _rows(done)
        if not len(meta):
            return
        # passages with one anchor next to each other, then cut into indexes between anchors
        by = np.argsort(meta[:, 0], kind="stable")
        begin = np.cumsum(meta[:, 4]) - meta[:, 4]
        fresh = np.concatenate(([True], meta[by[1:], 0] != meta[by[:-1], 0]))
        behind = np.cumsum(meta[by, 4])
        a = 0
        while a < len(by):
            b = int(np.searchsorted(behind, behind[a] - meta[by[a], 4] + INDEX_WORDS, side="left")) + 1
            while b < len(by) and not fresh[b]:
                b += 1
            part = meta[by[a:b]]
            at = np.repeat(begin[by[a:b]] - (np.cumsum(part[:, 4]) - part[:, 4]), part[:, 4]) + np.arange(part[:, 4].sum())
            yield from _rows(np.array(_search(words[at], part, span), np.int64).reshape(-1, 4))
            a = b
        del words, meta
        release()

    def _rows(ranges):
        for a in range(0, len(ranges), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ranges[a: a + 100_000, k])) for k in range(4)], ["id", "class", "start", "end"])

    return texts.mapInArrow(send, "part int, words binary, meta binary, done binary").repartitionById(parts, "part").mapInArrow(
        meet, "id long, class long, start long, end long")


def repeats(docs: DataFrame, *, span: int = SPAN) -> DataFrame:
    """id, class, ranges: the word ranges [start, end) to remove, one row per document that has any. ``class`` is the hash
    of its word sequence (rows may share an id), ``id`` the doc_id, nulls as the largest number."""
    profile = stage(_profile(docs).where(F.col("n_words") >= span))
    heads = stage(profile.groupBy("class").agg(F.min("id").alias("head")))
    copies = profile.join(heads, "class").where("id > head").select("id", "class", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")).distinct()
    lead = bitmap(heads.select("head"), heads.count())
    # lets some copies through as well, which changes nothing but the time
    first, texts = lambda ids: lead.has(_ids(ids)), _texts(docs)
    found = _ranges(texts, first, stage(_anchor_counts(texts, first, span)), span)
    return found.unionByName(copies).groupBy("id", "class").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def remove_repeats(docs: DataFrame, *, span: int = SPAN) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words``, ``n_removed``, ``kept`` (the words left, one space between them).

    Null and empty texts have no words; a text without words keeps the empty string. Nothing is removed from texts with
    fewer than ``span`` words. An empty table gives no rows.
    """
    spans = stage(repeats(docs, span=span))
    some = bitmap(spans.select("id"), spans.count())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    touched = filter_rows(packed, "id", lambda ids: some.has(_ids(ids)))
    rest = filter_rows(packed, "id", lambda ids: ~some.has(_ids(ids)))
    form = f"row {kind}, n_words long, n_removed long, kept string"

    def classed(batches):
        for batch in batches:
            found = []
            for w in W.words(batch.column(2), W.WORDS):
                bounds = w.bounds
                found += [_class(w.hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_ids(batch.column(1))), batch.column(2), pa.array(found, pa.int64())], ["row", "id", "text", "class"])

    def cut(batches):
        for batch in batches:
            ranges = batch.column("ranges") if "ranges" in batch.schema.names else None
            total, removed, kept = [], [], []
            for k, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                found = ranges[k].as_py() if ranges is not None else None
                total.append(len(words))
                if found:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [r["start"] for r in found], 1)
                    np.add.at(gone, [r["end"] for r in found], -1)
                    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    words = [words[i] for i in left.tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    found = touched.mapInArrow(classed, f"row {kind}, id long, text string, class long").join(spans, ["id", "class"], "left")
    return found.select("row", "text", "ranges").mapInArrow(cut, form).unionByName(rest.select("row", "text").mapInArrow(cut, form))


def strip(docs: DataFrame, *, span: int = SPAN) -> DataFrame:
    """``docs`` with the repeated words out of ``text`` (and ``n_chars`` counted anew, where it is a column); a text that
    loses nothing stays as it is."""
    got = remove_repeats(docs, span=span)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row")["text"])
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("row")[name]
        if name == "text":
            value = text
        elif name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(value)
        columns.append(value.alias(name))
    return got.select(*columns)
