"""Object keys and media paths: C10, C11, C20, C21, C23, C24, Q4-Q6, Q10 helpers."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumicat.functions.text import trim_unicode

# fixed values: file extensions a target path replaces
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "svg", "ico", "heic", "avif", "bin",
)
# fixed values: size limits of one source object
MAX_SOURCE_BYTES = 128 * 1024 * 1024
MAX_PIXELS = 100_000_000


def non_image_extensions(mime_types: dict[str, str] | None = None) -> list[str]:
    """Extensions with a known type that is not an image, from a MIME map
    (by default the standard library's)."""
    table = mime_types
    if table is None:
        table = dict(mimetypes.types_map) | dict(mimetypes.common_types)
    return sorted(
        ext.lstrip(".").lower() for ext, mime in table.items() if not mime.startswith("image/")
    )


def format_duration(seconds: Column) -> Column:
    """``M:SS`` or ``H:MM:SS``; below zero counts as zero."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    hours = F.floor(s / 3600).cast("bigint")
    minutes, rest = F.floor(s / 60).cast("bigint") % 60, s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%d:%02d", minutes, rest)
    )


def encode_path(path: Column) -> Column:
    """C11: percent-encode each segment, keep the slashes."""
    def encode(segment: Column) -> Column:
        coded = F.url_encode(segment)
        coded = F.regexp_replace(coded, r"\+", "%20")
        return F.regexp_replace(F.regexp_replace(coded, "%7E", "~"), r"\*", "%2A")

    return F.array_join(F.transform(F.split(path, "/", -1), encode), "/")


def decode_form(text: Column) -> Column:
    """Strict form decoding: ``+`` is a blank, a broken escape or bytes that are
    not UTF-8 give NULL."""
    well_formed = ~text.rlike(r"%(?![0-9A-Fa-f]{2})")
    # the decoder only replaces bytes that are not UTF-8, so validate them here
    raw = F.regexp_replace(text, r"\+", " ")
    decoded = F.try_url_decode(text)
    rejected = decoded.contains("\ufffd") & ~raw.contains("\ufffd") & ~F.upper(raw).contains(
        "%EF%BF%BD"
    )
    return F.when(well_formed & ~rejected, decoded)


def decode_path(path: Column) -> Column:
    """Lenient path decoding: ``+`` stays, a broken escape stays as it is."""
    safe = F.regexp_replace(path, r"%(?![0-9A-Fa-f]{2})", "%25")
    return decode_form(F.regexp_replace(safe, r"\+", "%2B"))


def segment_prefix(path: Column, prefix: str | Column) -> Column:
    """C20: the folder itself or anything below it."""
    folder = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def has_dot_segment(path: Column) -> Column:
    return F.exists(F.split(path, "/", -1), lambda s: s.isin(".", ".."))


def in_free_scope(path: Column, kind: Column, rules: Column) -> Column:
    """Whether a media path lies in a folder that the free allowance covers."""
    decoded = decode_path(path)
    inside = F.exists(rules, lambda rule: segment_prefix(decoded, rule))
    clean = decoded.isNotNull() & ~decoded.contains("\\") & ~has_dot_segment(decoded)
    everything = (F.size(rules) <= 0) | ~kind.isin("image", "video")
    return everything | (clean & F.coalesce(inside, F.lit(False)))


def valid_key(key: Column) -> Column:
    """Q4: an object key is not blank and has no NUL and no empty or dot segment."""
    segments_ok = F.forall(F.split(key, "/", -1), lambda s: ~s.isin("", ".", ".."))
    return F.coalesce(
        (trim_unicode(key) != "") & ~key.contains("\x00") & segments_ok, F.lit(False)
    )


def extension(path: Column) -> Column:
    """The lower-case extension of the file name; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def convertible(path: Column, mime_types: dict[str, str] | None = None) -> Column:
    """Q5: convert images, ``.bin`` and unknown types, never ``.webp`` or folders."""
    lower = F.lower(path)
    return (
        F.when((path == "") | path.endswith("/") | lower.endswith(".webp"), False)
        .when(lower.endswith(".bin"), True)
        .otherwise(~extension(path).isin(*non_image_extensions(mime_types)))
    )


def within_limits(length: Column, width: Column, height: Column) -> Column:
    """Q6: at most 128 MiB and 100 million pixels, no empty picture."""
    pixels = width.cast("bigint") * height.cast("bigint")
    return (length <= MAX_SOURCE_BYTES) & (width > 0) & (height > 0) & (pixels <= MAX_PIXELS)


def target_path(path: Column) -> Column:
    """struct(target, key) of a source path; only a known extension is cut off."""
    stem = F.regexp_extract(path, r"(?s)^(.*)\.[^.]*$", 1)
    ext = F.lower(F.regexp_extract(path, r"(?s)\.([^.]*)$", 1))
    key = F.when(path.contains(".") & ext.isin(*IMAGE_EXTENSIONS), stem).otherwise(path)
    return F.struct(F.concat(key, F.lit(".webp")).alias("target"), key.alias("key"))


def cover_dims(width: Column, height: Column) -> Column:
    """Dimensions to lay a cover out with, 16:9 where they are unknown."""
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.struct(
        F.when(known, width).otherwise(16).cast("int").alias("width"),
        F.when(known, height).otherwise(9).cast("int").alias("height"),
    )


def folder_of(path: Column) -> Column:
    """The parent folder without outer slashes; NULL at the root."""
    parent = F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), r"^/+|/+$", "")
    return F.when(parent != "", parent)
