"""Scalar helpers of the media operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fourcc(code: Column) -> Column:
    """Four little-endian bytes of a codec number as text, without what can't be shown; null if none."""
    parts = [F.shiftright(code.cast("long"), 8 * k).bitwiseAND(255) for k in range(4)]
    shown = F.concat(*[F.when(p.between(33, 126), F.char(p)).otherwise(F.lit("")) for p in parts])
    return F.when(code > 0, F.nullif(shown, F.lit("")))


def stretched(value: Column, least: Column, most: Column) -> Column:
    """Between 0 and 255 by the range's ends; a range of nothing counts as a millionth."""
    return (value - least) / F.greatest(most - least, F.lit(1e-6)) * 255


def percent(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100)).otherwise("—")


def escaped(text: Column) -> Column:
    """Text with the five characters that HTML reads put as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def wrapped(text: Column, width: int = 92) -> Column:
    """Lines of at most `width` characters, broken at spaces where there are any."""
    lines = F.regexp_extract_all(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(rf"(\S.{{0,{width - 1}}}(?=\s|$)|\S{{{width}}})"), 1)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))


def utc_iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
