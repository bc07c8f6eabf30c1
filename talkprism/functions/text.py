"""Measures, prefixes, ranges and tokens of text columns, all as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def _col(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def byte_length(text) -> Column:
    return F.octet_length(_col(text)).cast("long")


def line_count(text) -> Column:
    """0 for an empty text; a newline at the end adds no line."""
    t = _col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(breaks + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1)).cast("long")


def utf8_prefix(text, limit) -> Column:
    """The longest prefix of at most ``limit`` bytes that doesn't cut a character."""
    t, n = _col(text), limit if isinstance(limit, Column) else F.lit(limit)
    whole = t.cast("binary")
    # A character has at most four bytes, so one of the last four cuts is valid.
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(whole, F.lit(1), F.greatest(n - k, F.lit(0)).cast("int")).cast("string")) for k in range(4)])
    return F.when(F.octet_length(t) <= n, t).otherwise(cut)


def byte_range(text, start: int, end: int) -> Column:
    """Bytes start (from 0) to end, exclusive; null if out of range or inside a character."""
    t = _col(text)
    whole = t.cast("binary")
    parts = [F.substring(whole, F.lit(a + 1), F.lit(b - a)).cast("string") for a, b in ((0, start), (start, end))]
    fits = (F.octet_length(t) >= end) & F.is_valid_utf8(parts[0]) & F.is_valid_utf8(parts[1])
    return F.when(fits, parts[1]) if 0 <= start <= end else F.lit(None).cast("string")


def lines(text) -> Column:
    """The lines of a text; a newline at the end adds none."""
    t = _col(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t), "\n", -1))


def line_range(text, start: int, end: int) -> Column:
    """Lines start (from 1) to end, exclusive, joined by newlines; null if out of range."""
    own = lines(text)
    return F.when((F.size(own) >= end - 1), F.array_join(F.slice(own, start, end - start), "\n")) if 1 <= start <= end else F.lit(None).cast("string")


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def reference(prefix: str, *parts) -> Column:
    """Opaque, stable identifier of a row."""
    return F.concat(F.lit(prefix + ":v1:"), F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]).cast("binary")))


def byte_estimate(size: Column, start: int, end: int) -> Column:
    """Bytes of a range of bytes; null if the range leaves the text."""
    return F.when(F.lit(0 <= start <= end) & (size >= end), F.lit(end - start).cast("long"))


def line_estimate(size: Column, lines: Column, start: int, end: int) -> Column:
    """Bytes of a range of lines, by their share of the lines; null if the range leaves the text."""
    return F.when(F.lit(1 <= start <= end) & (lines + 1 >= end), F.floor(size * (end - start) / F.greatest(lines, F.lit(1))).cast("long"))
