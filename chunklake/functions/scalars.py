"""Column expressions over paths, sizes, times and tokens; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension classes of the type filter (fixed values). An archive format of one's own is added by the ``types`` of type_class.
TYPES = {
    "images": ["jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp"],
    "video": ["mp4", "mov", "avi", "mkv", "webm", "m4v"],
    "audio": ["mp3", "wav", "flac", "m4a", "ogg", "aac"],
    "docs": ["pdf", "txt", "md", "json", "yaml", "toml", "rs", "ts", "tsx", "js", "csv", "doc", "docx"],
    "archives": ["zip", "tar", "gz", "7z", "rar"],
}

# Extension classes of the preview, which differ from the filter's (fixed values).
PREVIEWS = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp"],
    "video": ["mp4", "mov", "webm", "mkv", "m4v"],
    "audio": ["mp3", "wav", "flac", "m4a", "ogg", "aac"],
    "pdf": ["pdf"],
    "text": [
        "txt", "md", "json", "yaml", "yml", "toml", "rs", "ts", "tsx", "js", "jsx", "py", "sh", "log", "csv", "xml", "html", "css", "go", "java",
    ],
    "archive": ["zip", "tar", "gz", "7z", "rar"],
}


def extension(path: Column) -> Column:
    """The lower-cased part after the last dot; a path without one is its own extension."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def basename(path: Column) -> Column:
    """The part after the last / or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def type_class(path: Column, types: dict[str, list[str]] | None = None) -> Column:
    out = None
    for name, ext in (types or TYPES).items():
        out = F.when(extension(path).isin(ext), name) if out is None else out.when(extension(path).isin(ext), name)
    return out.otherwise("other")


def preview_class(path: Column) -> Column:
    """How a file is previewed; "other" if it isn't."""
    return type_class(path, PREVIEWS)


def matches_path(path: Column, wanted: str) -> Column:
    """An optional filter: an empty one matches every path."""
    return F.lit(wanted == "") | (path == wanted)


def saved_pct(logical: Column, savings: Column) -> Column:
    """Percentage of the logical bytes that is saved, 0 or more."""
    return F.when(logical > 0, F.greatest(F.lit(0.0), savings / logical * 100)).otherwise(0.0)


def stored_pct(logical: Column, stored: Column) -> Column:
    """Percentage of the logical bytes that is stored, 100 or less; 100 without any bytes."""
    return F.when(logical > 0, F.least(F.lit(100.0), stored / logical * 100)).otherwise(100.0)


def list_line(path: Column, encrypted: Column, u_size: Column, c_size: Column, chunks: Column) -> Column:
    """One line of a text listing."""
    return F.format_string("%s%s  u=%d  c=%d  chunks=%d", path, F.when(encrypted, " [E]").otherwise(""), u_size, c_size, chunks)


def has_thumbnail(path: Column, size: Column, most: int = 8 << 20) -> Column:
    return extension(path).isin(TYPES["images"]) & (size < most)


def in_subtree(path: Column, top: str) -> Column:
    """The path itself or anything below it; a / is added to ``top`` only where it lacks one."""
    return (path == top) | path.startswith(top if top.endswith("/") else top + "/")


def contains_ignoring_case(path: Column, part: str) -> Column:
    return F.contains(F.lower(path), F.lit(part.lower()))


def is_safe_to_extract(path: Column) -> Column:
    """Not absolute and without a parent step."""
    return ~(path.startswith("/") | path.startswith("\\") | F.contains(path, F.lit("../")) | F.contains(path, F.lit("..\\")) | (path == ".."))


def is_safe_upload(path: Column) -> Column:
    """Relative, not empty, no parent step and no leading dot step; inner dots and double slashes are tolerated."""
    parts = F.split(path, "/")
    return (path != "") & ~path.startswith("/") & ~F.exists(parts, lambda p: p == "..") & (F.element_at(parts, 1) != ".")


def is_valid_label(name: Column) -> Column:
    return F.octet_length(F.trim(name)).between(1, 128)


def is_safe_archive_id(name: Column) -> Column:
    return (name != "") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit(".."))


def relative_to(path: Column, roots: list[str]) -> Column:
    """Without the first root that it lies under; a root that is the file itself gives its basename."""
    tried = []
    for root in roots:
        prefix = root.rstrip("/") + "/"
        tried += [F.when(path == root, basename(path)), F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1)))]
    return F.coalesce(*tried, path)


def without_leading_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+", "")


def picks_zstd(u_size: Column, c_size: Column, min_gain: float = 0.05) -> Column:
    """Codec 1 (compressed) if that saves at least ``min_gain`` of the size, else 0; a gain of 0 or less means 0.05."""
    gain = min_gain if min_gain > 0 else 0.05
    return F.when((u_size - c_size) >= u_size * F.lit(gain), 1).otherwise(0)


def in_units(n: Column, bits: int, digits: int) -> Column:
    """n / 2**bits with ``digits`` decimals, halves to the even digit as C's printf does.

    format_string rounds halves up, and the shortest decimal of a large quotient may show a half that isn't one; so
    the digits are counted in whole numbers. n is taken as a double, which changes it from 2**53 on.
    """
    exact, parts = n.cast("double").cast("long"), F.lit(10**digits)
    scaled = exact.bitwiseAND(F.lit((1 << bits) - 1)) * parts
    down, rest, half = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit((1 << bits) - 1)), 1 << (bits - 1)
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    total = F.shiftright(exact, bits) * parts + down + up.cast("long")
    return F.format_string(f"%d.%0{digits}d", F.floor(total / parts), total % parts)


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(n < kb, F.format_string("%d B", n))
        .when(n < mb, F.concat(in_units(n, 10, 1), F.lit(" KB")))
        .when(n < gb, F.concat(in_units(n, 20, 1), F.lit(" MB")))
        .when(n >= gb, F.concat(in_units(n, 30, 2), F.lit(" GB")))
    )


def parse_size(text: Column) -> Column:
    """Bytes of '10', '4KB', '1.5 MB', '2G'; null if it is none of these."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?\s*$"
    number, unit = (F.regexp_extract(F.upper(text), pattern, k) for k in (1, 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)
    return F.when(number != "", (number.cast("double") * factor).cast("long"))


def time_ago(mtime: Column, now: int) -> Column:
    """How long before ``now`` (epoch seconds); empty for times of 0 or less."""
    age = F.lit(now) - mtime
    return (
        F.when(mtime <= 0, "")
        .when(age < 60, "just now")
        .when(age < 3600, F.format_string("%dm ago", F.floor(age / 60)))
        .when(age < 86400, F.format_string("%dh ago", F.floor(age / 3600)))
        .when(age >= 86400, F.format_string("%dd ago", F.floor(age / 86400)))
    )


def iso_date(epoch: Column) -> Column:
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(epoch <= 0, "")


def expires_at(now: Column, seconds: Column) -> Column:
    """When a token granted now expires; 0 seconds: never (null)."""
    return F.when(seconds != 0, now + seconds)


def is_live(revoked: Column, expires: Column, now: Column) -> Column:
    return ~revoked & (expires.isNull() | (expires > now))


def is_expired(expires: Column, now: Column, early: int = 30) -> Column:
    return now >= expires - early


def label_of(own: Column, manifest: Column, encrypted: Column, archive_id: Column) -> Column:
    """The label that was set, else the manifest's unless it is encrypted, else the id's first 8 characters."""
    return F.coalesce(own, F.when(~encrypted, manifest), F.substring(archive_id, 1, 8))


def preview_text(content: Column, most: int = 64 << 10) -> Column:
    """The first bytes as text, invalid ones replaced."""
    return F.make_valid_utf8(F.substring(content, 1, most).cast("string"))


def parse_key(text: Column, size: int = 32) -> Column:
    """A key of ``size`` bytes from hex digits; null if it isn't one."""
    raw = F.try_to_binary(text, F.lit("hex"))
    return F.when((F.octet_length(raw) == size) & (F.length(text) == 2 * size), raw)
