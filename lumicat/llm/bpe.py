"""BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash over ``WINDOW`` bytes cuts each text into chunks where its top bits are 0, so equal passages have equal
   chunks wherever they stand. A text's route is the smallest hash of its chunks: texts that share most chunks mostly share
   it and go to one task. Frequent routes (the list is bounded by a share of the rows) are dealt over several tasks.
2. A task encodes a chunk once and keeps the result: the ids of its whole words (a word is what stands between ASCII white
   space; merges never cross it), and the loose bytes before the first and behind the last white space.
3. At a join, the loose bytes of both sides are one word, which is encoded anew. The repair is checked: the words around
   the join are encoded together and have to give exactly the ids in place; windows that have agreed are remembered. Where one
   doesn't, the text is put together from windows that grow until they agree, at last from the whole text.

Tokenizer files are a parameter and are opened by each task; their results are bound to those of the tokenizers library.
"""

from __future__ import annotations

import json
import string
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm import words as W
from lumicat.llm.base import fanout

WINDOW = 16
CHUNK = 10  # bits: chunks of 1024 bytes on average
SPACE = b" \t\n\v\f\r"
MARKS = string.punctuation
END = "</w>"
#: How the pattern of pieces has to end: letters, single digits, runs of other signs.
PIECES = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEPT_WORDS, KEPT_BYTES = 150_000, 24_000_000  # of each of the two generations of a task's memory
OFTEN_SHARE = 1e-3
_code = W.mix(np.arange(1, 257, dtype=W.U64))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, ascending from 0, and the rolling hash there (0 at the begin). A cut never splits a character."""
    found, hashes = [np.zeros(1, np.int64)], [np.zeros(1, W.U64)]
    for a in range(0, max(0, len(data) - WINDOW), W.PIECE):
        part = data[a: a + W.PIECE + WINDOW]
        power, inverse = W._powers(len(part) + 1)
        total = np.zeros(len(part) + 1, W.U64)
        np.cumsum(_code[part] * power[: len(part)], out=total[1:])
        # the bytes' codes are random in all bits, so the top ones of the polynomial can decide; only what is found is mixed
        rolled = total[WINDOW:-1] - total[: -WINDOW - 1]
        rolled *= inverse[: len(part) - WINDOW]
        at = np.flatnonzero(rolled < W.U64(1 << 64 - CHUNK))
        at = at[part[WINDOW + at] & 0xC0 != 0x80]
        found.append(at + a + WINDOW)
        hashes.append(W.mix(rolled[at]))
    return np.concatenate(found), np.concatenate(hashes)


class _Memory:
    """A dictionary of bounded size: what wasn't asked for while a generation filled up is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got, 0)
        return got

    def put(self, key, value, cost: int):
        self.new[key] = value
        self.size += cost or 1
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0


def refuse_others(file: dict) -> None:
    """Raise unless the tokenizer's file says what ``Encoder`` takes for granted."""
    steps = {"NFC", "Replace", "Lowercase"}
    normal = (file.get("normalizer") or {}).get("normalizers", [])
    cut = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    fits = (
        {x["type"] for x in normal} == steps and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal if x["type"] == "Replace")
        and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"].get("Regex", "").endswith(PIECES) and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and file.get("decoder") is None and file.get("post_processor") is None
        and file["model"]["type"] == "BPE" and file["model"].get("end_of_word_suffix") == END and not file["model"].get("dropout")
    )
    if not fits:
        raise ValueError("this tokenizer folds, cuts or decodes in another way than the encoder relies on")


def _parts(chunk: bytes) -> tuple[bytes, list[bytes], bytes, bool]:
    """Loose head, whole words, loose tail, and whether there is no white space at all."""
    words = chunk.split()
    head = words.pop(0) if words and chunk[0] not in SPACE else b""
    loose = not words and len(head) == len(chunk)
    tail = words.pop() if words and chunk[-1] not in SPACE else b""
    return head, words, tail, loose


def _put_together(parts, known):
    head, words, tail, loose = parts
    said = [x for x in map(known[1].__getitem__, words) if x]
    return head, b"".join(map(known[0].__getitem__, words)), " ".join(said), tail, loose, words[:1], words[-1:]


class Encoder:
    """``encode(texts)`` gives ids (little-endian 32 bits) and decoded text for each text of a batch.

    The tokenizer has to be of the kind whose words are cut apart here: lower case, pieces of letters, of digits and of other
    signs, word ends marked, decoded by spaces. Any other file is refused."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            refuse_others(json.load(file))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.cores, self.agreed, self.chunks = _Memory(KEPT_WORDS), _Memory(KEPT_WORDS), _Memory(KEPT_WORDS), _Memory(KEPT_BYTES)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for t, i in vocabulary.items() if t.endswith(END)]] = True
        #: without a decoder, decoding puts a space between the pieces
        self.names = [""] * len(self.ending)
        for t, i in vocabulary.items():
            self.names[i] = t

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def _letters(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Entries of words that are letters only. Many are encoded as one text; each ends with its only end-of-word piece. Where
        the number of these differs from that of the words, they are encoded one by one."""
        out, names = [], self.names
        for a in range(0, len(words), 256):
            some = words[a: a + 256]
            ids = self._ids([" ".join(some)])[0]
            packed = np.array(ids, "<u4")
            ends = np.flatnonzero(self.ending[packed]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, said, lo = packed.tobytes(), [names[i] for i in ids], 0
                for hi in ends.tolist():
                    out.append((raw[4 * lo: 4 * hi], " ".join(said[lo:hi])))
                    lo = hi
            else:
                out += [self._entry(x) for x in self._ids(some)]
        return out

    def _learn(self, words: set[bytes]) -> tuple[dict[bytes, bytes], dict[bytes, str]]:
        """Ids and decoded text of each word. Letters and the marks that end a word are looked up apart: no piece holds both."""
        ids, said, cores, whole, again = {}, {}, {}, [], []
        new, old = self.words.new, self.words.old
        for word in words:
            known = new.get(word)
            if known is None and (known := old.get(word)) is not None:
                again.append(word)
            if known is not None:
                ids[word], said[word] = known
                continue
            text = word.decode()
            core = text.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or core.lower().isalpha()):  # folding may set a mark apart from its letter
                cores.setdefault(core, []).append((word, text[len(core):]))
            else:
                whole.append((word, text))
        fresh = [x for x in cores if self.cores.get(x) is None]
        letters = dict(zip(fresh, self._letters(fresh)))
        marks = list({mark for found in cores.values() for _, mark in found if mark})
        ends = {mark: self._entry(x) for mark, x in zip(marks, self._ids(marks))}
        put = self.words.put
        for core, found in cores.items():
            entry = letters.get(core)
            if entry is None:
                entry = self.cores.get(core)
            else:
                self.cores.put(core, entry, 1)
            for word, mark in found:
                both = (entry[0] + ends[mark][0], f"{entry[1]} {ends[mark][1]}") if mark else entry
                ids[word], said[word] = both
                put(word, both, 1)
        for (word, _), got in zip(whole, self._ids([x[1] for x in whole])):
            entry = self._entry(got)
            ids[word], said[word] = entry
            put(word, entry, 1)
        for word in again:
            put(word, (ids[word], said[word]), 1)
        return ids, said

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        # every text as chunks, every chunk as loose head, whole words, loose tail
        pieces, wanted, fresh = [], set(), {}
        # capitals are folded before anything is looked up, unless a special token could stand in the text
        texts = [text if b"<|" in text else text.lower() for text in texts]
        for text in texts:
            at = np.append(cuts(np.frombuffer(text, np.uint8))[0], len(text)).tolist() if text else [0]
            mine = [text[a:b] for a, b in zip(at[:-1], at[1:])]
            pieces.append(mine)
            for chunk in mine:
                if chunk not in fresh and self.chunks.get(chunk) is None:
                    fresh[chunk] = _parts(chunk)
                    wanted.update(fresh[chunk][1])
        known = self._learn(wanted)
        ready = {}
        for chunk, parts in fresh.items():
            ready[chunk] = _put_together(parts, known)
            self.chunks.put(chunk, ready[chunk], 4 * len(chunk) + 500)
        joined = []
        for mine in pieces:
            parts, carry = [], b""
            for chunk in mine:
                got = ready.get(chunk) or self.chunks.get(chunk)
                if got is None:  # forgotten within the batch
                    cut = _parts(chunk)
                    got = _put_together(cut, self._learn(set(cut[1])))
                ready[chunk] = got
                head, ids, said, tail, loose, *_ = got
                if loose:  # no white space at all: the word goes on
                    carry += head
                    continue
                parts.append((carry + head, got))
                carry = tail
            joined.append((parts, carry))
        known = self._learn({w for parts, carry in joined for w in [carry, *(p[0] for p in parts)] if w})
        known[0][b""], known[1][b""] = b"", ""
        wrong = self._disagreeing(joined, known)
        out = []
        for k, (parts, carry) in enumerate(joined):
            if k in wrong:
                out.append(self._widened(texts[k]))
                continue
            ids, said = [], []
            for word, got in parts:
                ids += [known[0][word], got[1]]
                said += [known[1][word], got[2]]
            ids.append(known[0][carry])
            said.append(known[1][carry])
            out.append((b"".join(ids), " ".join([x for x in said if x])))
        return out

    def _disagreeing(self, joined, known) -> set[int]:
        """The texts where a join, encoded with a whole word on either side, gives other ids than those that are put together. A window
        that has agreed once is not encoded again."""
        windows: dict[bytes, tuple[list[int], list[bytes]]] = {}
        for k, (parts, _) in enumerate(joined):
            for left, (word, right) in zip(parts, parts[1:]):
                window = [*left[1][6], word, *right[5]] if word else [*left[1][6], *right[5]]
                windows.setdefault(b" ".join(window), ([], window))[0].append(k)
        new = [text for text in windows if self.agreed.get(text) is None]
        some = self._learn({w for text in new for w in windows[text][1] if w not in known[0]})[0]
        wrong = set()
        for text, ids in zip(new, self._ids([x.decode() for x in new])):
            together = b"".join([some[w] if w in some else known[0][w] for w in windows[text][1]])
            if array("I", ids).tobytes() == together:
                self.agreed.put(text, True, 1)
            else:
                wrong.update(windows[text][0])
        return wrong

    def _widened(self, text: bytes) -> tuple[bytes, str]:
        """A text whose words don't stand for themselves: windows of words that grow on the right, twice as many each time, until what is
        put together agrees with the window encoded as one, and then begin anew behind it with one word of overlap checked. Where
        no window agrees, the widest is the whole text, as the library encodes it."""
        words, ids, said, at = text.split(), [], [], 0
        alone = self._learn(set(words))
        while at < len(words):
            size = 2
            while True:
                window = words[at: at + size]
                whole = self._ids([b" ".join(words[max(0, at - 1): at + size]).decode()])[0]
                before = alone[0][words[at - 1]] if at else b""
                packed = array("I", whole).tobytes()
                if packed == before + b"".join([alone[0][w] for w in window]):
                    ids += [alone[0][w] for w in window]
                    said += [alone[1][w] for w in window]
                    break
                if at + size >= len(words):
                    return self._entry(self._ids([text.decode()])[0])
                size *= 2
            at += size
        return b"".join(ids), " ".join([x for x in said if x])

def routes(column: pa.Array) -> np.ndarray:
    """The smallest chunk hash of each text; a text of one chunk has the polynomial hash of its bytes."""
    data, places = W.buffers(column)
    out = np.zeros(len(column), W.U64)
    for i, (a, b) in enumerate(zip(places[:-1].tolist(), places[1:].tolist())):
        hashes = cuts(data[a:b])[1][1:]
        out[i] = hashes.min() if len(hashes) else W.mix((_code[data[a:b]] * W._powers(b - a + 1)[0][: b - a]).sum(dtype=W.U64, keepdims=True))[0]
    return out.view(np.int64)


def encode(docs: DataFrame, path: str | Callable[[], str] = default_path) -> DataFrame:
    """``row`` (all columns of ``docs``), ``ids`` (binary: 32-bit little-endian numbers) and ``decoded`` for each row.

    Null texts count as empty; an empty text has no ids and decodes to the empty string. ``path``: of the tokenizer's file,
    or a function that finds it on the executor.
    """
    parts = fanout(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # the text travels once, within the row
    kind = packed.schema["row"].dataType.simpleString()

    def only(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(routes(batch.column(0)))], ["route"])

    def routed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(routes(batch.column(0).field("text")))], ["row", "route"])

    counted = docs.select("text").mapInArrow(only, "route long").groupBy("route").count()
    total = packed.count()
    share = max(64, int(total * OFTEN_SHARE))
    often = counted.where(F.col("count") > share).select("route", (F.col("count") / share).cast("int").alias("ways"))  # at most 1 / OFTEN_SHARE rows
    dealt = (
        packed.mapInArrow(routed, f"row {kind}, route long").join(F.broadcast(often), "route", "left")
        .withColumn("way", F.pmod(F.xxhash64("row.doc_id"), F.coalesce("ways", F.lit(0)) + 1))
        .repartition(parts, "route", "way").select("row")
    )

    def run(batches):
        coder = Encoder(path if isinstance(path, str) else path())
        for batch in batches:
            got = coder.encode([(x.as_py() or "").encode() for x in batch.column(0).field("text")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.string())], ["row", "ids", "decoded"])

    return dealt.mapInArrow(run, f"row {kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str | Callable[[], str] = default_path) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text."""
    return encode(docs.select("doc_id", "text"), path).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
