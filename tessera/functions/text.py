"""Column functions over names, texts and paths; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_score(name: Column, query: str) -> Column:
    """0 for equal names, 100 + extra length for a prefix, 200 + place + extra length where it is contained, else null."""
    low, q = F.lower(name), query.strip().lower()
    extra = F.length(low) - len(q)
    return F.when(low == q, 0).when(low.startswith(q), 100 + extra).when(F.instr(low, q) > 0, 199 + F.instr(low, q) + extra).cast("int")


def snippet(text: Column, limit: int = 180) -> Column:
    """Collapsed text; a longer one is cut to the limit, dots included."""
    short = collapse(text)
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit - 3), F.lit("..."))).otherwise(short)


def context_snippet(text: Column, start: Column, stop: Column, limit: int = 160) -> Column:
    """What surrounds [start, stop): half the limit on either side (24 at least), collapsed; a longer one is cut about
    its middle, trimmed and given dots."""
    pad = max(24, limit // 2)
    low = F.greatest(start - pad, F.lit(0))
    short = collapse(F.substring(text, low + 1, stop + pad - low))
    middle = F.floor((F.length(short) - limit) / 2).cast("int")
    return F.when(F.length(short) > limit, F.concat(F.trim(F.substring(short, middle + 1, F.lit(limit - 3))), F.lit("..."))).otherwise(short)


def clean_path(path: Column) -> Column:
    """Forward slashes, none doubled, no leading ./ and no trailing slash."""
    out = F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(out, r"^(\./)+", ""), "(.)/$", "$1")


def extension(path: Column) -> Column:
    """The lower-cased last extension with its dot, or the empty text."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it, by whole segments."""
    return (path == prefix) | path.startswith(prefix + "/")


def longest_owner(path: Column, owners: list[tuple[str, str]]) -> Column:
    """The owner (name, prefix) whose prefix holds the path, by whole segments; of several the longest, an empty one holds all."""
    out = F.lit(None).cast("string")
    for name, prefix in sorted(owners, key=lambda x: len(x[1])):
        out = F.when(under(path, prefix) if prefix else F.lit(True), name).otherwise(out)
    return out


def content_hash(content: Column) -> Column:
    """SHA-1 of a text in UTF-8; a null one counts as empty."""
    return F.sha1(F.coalesce(content, F.lit("")).cast("binary"))


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern without a slash excludes paths with a segment equal to it; one with a slash the path itself, what lies
    below it, and paths that hold it between slashes."""
    words = [p for p in patterns if "/" not in p]
    paths = [p for p in patterns if "/" in p]
    out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, words))) if words else F.lit(False)
    for p in paths:
        out = out | under(path, p) | (F.instr(F.concat(F.lit("/"), path, F.lit("/")), f"/{p}/") > 0)
    return out


def half_up(value: Column, places: int = 2) -> Column:
    """Rounded half up, as floor(x * 10^n + 0.5) / 10^n."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / F.lit(float(scale))


def fingerprint(root: Column, exclusions: Column, version: str) -> Column:
    """SHA-1 of the JSON of root, sorted distinct exclusions and version."""
    return F.sha1(F.to_json(F.struct(root.alias("root"), F.array_sort(F.array_distinct(exclusions)).alias("exclusions"), F.lit(version).alias("version"))).cast("binary"))


def in_locale(text: Column) -> Column:
    """text as a key to sort by in the order of a dictionary (letters before their case and accents), not of code points."""
    return F.collate(text, "UNICODE")
