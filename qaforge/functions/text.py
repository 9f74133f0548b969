"""Text functions as native column expressions. Lengths and places are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str knows it (29 code points), which is more than Java's \s.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def collapse(c: Column) -> Column:
    """Strip, and one space for each run of white space: all of it becomes spaces, then runs of those, where there are any, one."""
    spaced = F.translate(c, _WS_CHARS, " " * len(_WS_CHARS))
    return F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, "  +", " ")).otherwise(spaced))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def content_id(question: Column, context: Column, source_url: Column) -> Column:
    """Identity of a question: its text and context up to white space, and the URL as it is. The answer plays no part."""
    empty = F.lit("")
    return sha256(F.concat_ws("|", collapse(F.coalesce(question, empty)), collapse(F.coalesce(context, empty)), F.coalesce(source_url, empty)))


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters that begin every size - overlap; short ones at the end stay, an empty text has none."""
    step = size - overlap
    if size < 1 or overlap < 0 or step < 1:
        raise ValueError("size must exceed overlap, and overlap must not be negative")
    begins = F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))
    return F.when(F.length(c) > 0, F.transform(begins, lambda s: F.substring(c, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def truncated(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def default(c: Column, value: str) -> Column:
    """value for a null or empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def dataset_name(path: Column) -> Column:
    """A file's stem with '-' for '_' and ' '. A leading dot is part of the stem."""
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.translate(F.regexp_replace(base, r"^(.+)\.[^.]+$", "$1"), "_ ", "--")


def parsed_list(c: Column, otherwise: list[str]) -> Column:
    """The parts of a comma-separated setting, stripped; null gives the default."""
    return F.when(c.isNull(), F.array(*map(F.lit, otherwise)).cast("array<string>")).otherwise(F.transform(F.split(c, ","), strip))


def enum_name(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit("_"))


def iso_time(c: Column) -> Column:
    """ISO 8601, with microseconds only where there are some."""
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
