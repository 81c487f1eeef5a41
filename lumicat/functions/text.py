"""Query text, patterns and ranks. Query text is a Python string (one
search) or a Column (a table of searches); both forms build the same pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH_MODES = ("tag", "author", "title", "random", "similar", "clip")
SUGGEST_MODES = ("tag", "author", "title")
# fixed values: the Unicode White_Space set
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

SPACES = "".join(ch for ch in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", ch))


def trim_unicode(text: str | Column) -> str | Column:
    """Strip every Unicode white space, not only blanks."""
    if isinstance(text, str):
        return re.sub(f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "", text)
    return F.btrim(text, F.lit(SPACES))


def escape_like(text: str | Column) -> str | Column:
    """Make backslash, percent and underscore literal."""
    if isinstance(text, str):
        return re.sub(r"([\\%_])", r"\\\1", text)
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def underscored(text: str | Column) -> str | Column:
    return text.replace(" ", "_") if isinstance(text, str) else F.translate(text, " ", "_")


def autocomplete_pattern(text: str | Column) -> str | Column:
    """Substring match from three characters on, prefix match below."""
    if isinstance(text, str):
        return ("%" if len(text) >= 3 else "") + escape_like(text) + "%"
    head = F.when(F.char_length(text) >= 3, F.lit("%")).otherwise(F.lit(""))
    return F.concat(head, escape_like(text), F.lit("%"))


def live_contains_pattern(text: str) -> str:
    """The pattern of a search whose wildcards stay live. A backslash keeps a
    following wildcard literal and vanishes before anything else, which Spark
    would refuse to parse (T2)."""
    return re.sub(r"\\(?![\\%_])|(\\[\\%_])", lambda m: m.group(1) or "", f"%{text}%")


def ilike_contains(col: Column, text: str) -> Column:
    """Case-insensitive contains, wildcards live."""
    return col.ilike(live_contains_pattern(text))


def ilike_literal(col: Column, text: str) -> Column:
    """C4: case-insensitive contains, wildcards escaped."""
    return col.ilike(f"%{escape_like(text)}%")


def name_match(col: Column, text: str, make=lambda t: f"%{escape_like(t)}%") -> Column:
    """The raw form, or the form with underscores where that differs."""
    raw, alt = make(text), make(underscored(text))
    return col.ilike(raw) if raw == alt else col.ilike(raw) | col.ilike(alt)


def match_rank(col: Column, text: str, with_underscores: bool = False) -> Column:
    """0 for the same text, 1 for a prefix, 2 for any other match."""
    forms = [text]
    if with_underscores and underscored(text) != text:
        forms.append(underscored(text))
    same = prefix = F.lit(False)
    for form in forms:
        same = same | (F.lower(col) == F.lower(F.lit(form)))
        prefix = prefix | col.ilike(f"{escape_like(form)}%")
    return F.when(same, 0).when(prefix, 1).otherwise(2)


def should_suggest(mode: Column, text: Column) -> Column:
    """Suggestions start at two characters, at one for non-ASCII text."""
    trimmed = trim_unicode(text)
    long_enough = (F.char_length(trimmed) >= 2) | (
        F.octet_length(trimmed) > F.char_length(trimmed)
    )
    return mode.isin(*SUGGEST_MODES) & (trimmed != "") & long_enough


def parse_mode(text: Column) -> Column:
    """An unknown or missing mode is a tag search."""
    return F.coalesce(F.when(text.isin(*SEARCH_MODES), text), F.lit("tag"))


def gallery_params(mode: Column, text: Column, limit: Column) -> Column:
    return F.struct(
        parse_mode(mode).alias("mode"),
        F.coalesce(text, F.lit("")).alias("q"),
        F.coalesce(limit, F.lit(50)).cast("int").alias("limit"),
    )


ITEM_CAP = 100


def parse_items(raw: Column, kinds: tuple[str, ...], mode: str = "reject") -> Column:
    """``kind:id,kind:id`` to an array of different (kind, id), first mention first.

    ``reject`` gives NULL for more than 100 different items or 200 pieces;
    ``truncate`` looks at the first 200 pieces and keeps the first 100 items; ``all`` has no limit.
    """
    pieces = F.split(raw, ",", -1)
    looked = pieces if mode == "all" else F.slice(pieces, 1, 2 * ITEM_CAP)

    def to_item(piece: Column) -> Column:
        head = trim_unicode(F.regexp_extract(piece, r"(?s)^([^:]*):", 1))
        number = F.regexp_extract(piece, rf"(?s)^[^:]*:[{WHITE_SPACE}]*([+-]?[0-9]+)[{WHITE_SPACE}]*$", 1)
        return F.struct(
            F.when(head.isin(*kinds), head).alias("kind"), number.try_cast("bigint").alias("id")
        )

    items = F.array_distinct(
        F.filter(F.transform(looked, to_item), lambda x: x["kind"].isNotNull() & x["id"].isNotNull())
    )
    if mode == "all":
        return items
    if mode == "truncate":
        return F.slice(items, 1, ITEM_CAP)
    fits = F.when(F.size(pieces) <= 2 * ITEM_CAP, items)
    return F.get(F.filter(F.array(fits), lambda x: F.size(x) <= ITEM_CAP), F.lit(0))
