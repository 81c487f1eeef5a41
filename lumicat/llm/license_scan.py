"""License scans: ordered signature rules over word sequences.

Rules are regular expressions over a text's words, joined by one space. A rule names the words without which it can't match; these
gate it, so most texts run no rule at all and the others only those whose words they hold. Detections are resolved in
order of priority, then length, then place: one that lies within a kept detection is suppressed. Base phrases are rules
too; their places and labels stay whatever covers them.

The rules are made from a table of licenses and one of forms (several hundred expressions).
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumicat.llm import words as W
from lumicat.llm.base import rows_of

# fixed values: label, name in texts, identifier, versions
LICENSES = (
    ("mit", "mit|expat|massachusetts institute of technology", "mit", ""),
    ("mit-0", "mit no attribution", "mit 0", ""),
    ("apache", "apache|apache software", "apache", "1.0 1.1 2.0"),
    ("gpl", "general public|gnu general public|gnu gpl", "gpl", "1.0 2.0 3.0"),
    ("lgpl", "lesser general public|gnu lesser general public|library general public|gnu lgpl", "lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero general public|gnu affero general public|gnu agpl", "agpl", "1.0 3.0"),
    ("gfdl", "free documentation|gnu free documentation", "gfdl", "1.1 1.2 1.3"),
    ("bsd", "bsd|berkeley software distribution", "bsd", ""),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|two clause bsd", "bsd 2 clause", ""),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|modified bsd|three clause bsd", "bsd 3 clause", ""),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", "bsd 4 clause", ""),
    ("0bsd", "zero clause bsd|bsd zero clause", "0bsd", ""),
    ("mpl", "mozilla public", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public", "epl", "1.0 2.0"),
    ("cpl", "common public", "cpl", "1.0"),
    ("ipl", "ibm public", "ipl", "1.0"),
    ("cddl", "common development and distribution", "cddl", "1.0 1.1"),
    ("eupl", "european union public", "eupl", "1.0 1.1 1.2"),
    ("isc", "isc|internet systems consortium", "isc", ""),
    ("zlib", "zlib|zlib libpng", "zlib", ""),
    ("boost", "boost software", "bsl", "1.0"),
    ("artistic", "artistic|perl artistic", "artistic", "1.0 2.0"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "do what the fuck you want to public", "wtfpl", ""),
    ("cc0", "creative commons zero|cc0|cc zero", "cc0", "1.0"),
    ("cc-by", "creative commons attribution|cc by", "cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative commons attribution sharealike|creative commons attribution share alike|cc by sa", "cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative commons attribution noncommercial|cc by nc", "cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative commons attribution noderivatives|cc by nd", "cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike|cc by nc sa", "cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives|cc by nc nd", "cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("odbl", "open database", "odbl", "1.0"),
    ("pddl", "public domain dedication and", "pddl", "1.0"),
    ("ofl", "open font|sil open font", "ofl", "1.0 1.1"),
    ("psf", "python software foundation|psf", "psf", "2.0"),
    ("php", "php", "php", "3.0 3.01"),
    ("ruby", "ruby", "ruby", ""),
    ("openssl", "openssl", "openssl", ""),
    ("vim", "vim", "vim", ""),
    ("curl", "curl", "curl", ""),
    ("ncsa", "university of illinois ncsa open source|ncsa", "ncsa", ""),
    ("w3c", "w3c software notice and|w3c", "w3c", ""),
    ("apsl", "apple public source", "apsl", "1.0 1.1 1.2 2.0"),
    ("afl", "academic free", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software", "osl", "1.0 2.0 2.1 3.0"),
    ("ms-pl", "microsoft public", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal", "ms rl", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("elastic", "elastic", "elastic", "2.0"),
    ("sspl", "server side public", "sspl", "1.0"),
    ("busl", "business source", "busl", "1.1"),
    ("mulan", "mulan permissive software", "mulanpsl", "1.0 2.0"),
    ("cecill", "cecill", "cecill", "1.0 1.1 2.0 2.1"),
    ("zpl", "zope public", "zpl", "1.1 2.0 2.1"),
    ("qpl", "q public", "qpl", "1.0"),
    ("lppl", "latex project public", "lppl", "1.0 1.1 1.2 1.3"),
    ("x11", "x11", "x11", ""),
    ("openrail", "openrail|responsible ai", "openrail", ""),
    ("llama", "llama community|llama 2 community|llama 3 community", "llama", ""),
)
#: Phrases that are counted at all their places.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Of forms with names and identifiers: priority, confidence, expression ({n}: name, {i}: identifier, {v}: version) and the words it needs besides.
FORMS = (
    (100, 1.00, "spdx license identifier {i}(?: only| or later)?", "spdx license identifier"),
    (90, 0.95, "opensource org licenses {i}", "opensource org"),
    (70, 0.90, "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{n}(?: licen[cs]e)?", "under"),
    (60, 0.85, "{n} licen[cs]e", ""),
)
VERSIONED = (
    (110, 1.00, "spdx license identifier {i} {v}(?: only| or later)?", "spdx license identifier"),
    (80, 0.95, "{n} (?:licen[cs]e )?(?:version |v )?v?{v}", ""),
    (75, 0.90, "{i} (?:version |v )?v?{v}", ""),
)


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    expression: re.Pattern
    keywords: frozenset[bytes]
    base: bool


def rules() -> list[Rule]:
    out = []

    def add(label, priority, confidence, form, needs, base=False, **parts):
        text = form.format(**parts)
        out.append(Rule(label, priority, confidence, re.compile(b"(?<![^ ])(?:" + text.encode() + b")(?![^ ])"), frozenset(w.encode() for w in needs.split()), base))

    for label, phrase in BASE:
        add(label, 50, 0.8, "{n}", phrase, True, n=phrase)
    for label, names, identifier, versions in LICENSES:
        for priority, confidence, form, needs in FORMS:
            if "{i}" in form:
                add(label, priority, confidence, form, f"{needs} {identifier}", i=identifier)
            else:
                for name in names.split("|"):
                    add(label, priority, confidence, form, f"{needs} {name}", n=name)
        for version in versions.split():
            major, _, minor = version.partition(".")
            written = f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"
            for priority, confidence, form, needs in VERSIONED:
                for name in names.split("|") if "{n}" in form else [""]:
                    add(f"{label}-{version}", priority, confidence, form, f"{needs} {name or identifier}", n=name, i=identifier, v=written)
    return out


class Detection(NamedTuple):
    first: int  # word
    end: int
    label: str
    priority: int
    confidence: float
    base: bool


def _normal(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def detect(text: bytes, having: set[bytes], scan: list[Rule]) -> list[Detection]:
    """All detections of the rules whose keywords the text has."""
    normal, out = _normal(text), []
    for rule in scan:
        if rule.keywords <= having:
            at = word = 0
            for m in rule.expression.finditer(normal):
                word += normal.count(b" ", at, m.start())
                at = m.start()
                out.append(Detection(word, word + m[0].count(b" ") + 1, rule.label, rule.priority, rule.confidence, rule.base))
    return out


def resolve(found: list[Detection]) -> list[Detection]:
    """The detections that no kept one contains, by place. An interval that is kept later may contain kept ones, not the reverse."""
    kept: list[Detection] = []
    begins: list[int] = []
    reach: list[int] = []  # the largest end of the kept intervals with this or a smaller begin
    for d in sorted(found, key=lambda d: (-d.priority, d.first - d.end, d.first, d.label)):
        k = bisect.bisect_right(begins, d.first)
        if k and reach[k - 1] >= d.end:
            continue
        begins.insert(k, d.first)
        reach.insert(k, max(d.end, reach[k - 1] if k else 0))
        for j in range(k + 1, len(reach)):
            if reach[j] >= d.end:
                break
            reach[j] = d.end
        kept.append(d)
    return sorted(kept)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of ``docs``.

    Words are runs of ASCII letters, digits and other characters, A-Z folded. ``spans``: the kept detections with their first word
    and the word behind the last. ``score``: the highest confidence among them, 0 without any. Null and empty texts have no
    words, no labels (empty strings) and null places.
    """
    known = rules()
    keywords = sorted({w for r in known for w in r.keywords})
    hashed = next(W.words(pa.array([b" ".join(keywords).decode()]), W.ALNUM)).hashes
    by = np.argsort(hashed)
    hashed, keywords = hashed[by], [keywords[i] for i in by]
    maybe = np.zeros(1 << 16, bool)
    maybe[(hashed >> W.U64(48)).astype(np.int64)] = True
    by_word = {}
    for r in known:  # any rule is looked at under one of its words only
        by_word.setdefault(max(r.keywords, key=lambda w: (len(w), w)), []).append(r)

    def run(batches):
        for batch in batches:
            n_words, rows = [], []
            texts = batch.column(1)
            for w in W.words(texts, W.ALNUM):
                n_words += w.counts.tolist()
                at = np.flatnonzero(maybe[(w.hashes >> W.U64(48)).astype(np.int64)])
                place = np.minimum(np.searchsorted(hashed, w.hashes[at]), len(hashed) - 1)
                hit = hashed[place] == w.hashes[at]
                row = np.searchsorted(w.bounds, at[hit], side="right") - 1
                having: dict[int, set[bytes]] = {}
                for r, k in set(zip(row.tolist(), place[hit].tolist())):
                    having.setdefault(r, set()).add(keywords[k])
                for r in range(len(w.counts)):
                    words = having.get(r)
                    some = [x for word in words or () for x in by_word.get(word, ())]
                    found = detect(texts[w.lo + r].as_py().encode(), words, some) if some else []
                    base = [d for d in found if d.base]
                    kept = resolve(found)
                    rows.append((
                        len(base), min((d.first for d in base), default=None), max((d.first for d in base), default=None),
                        ",".join(sorted({d.label for d in base})), ",".join(sorted({d.label for d in [*base, *kept]})), max((d.confidence for d in kept), default=0.0),
                        [{"first": d.first, "end": d.end, "label": d.label} for d in kept]))
            n, first, last, base, labels, score, spans = (list(x) for x in zip(*rows)) if rows else ([],) * 7
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()),
                pa.array(labels, pa.string()), pa.array(score, pa.float64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return rows_of(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<first: bigint, end: bigint, label: string>>")
