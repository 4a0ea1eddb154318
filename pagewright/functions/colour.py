"""Colour expressions over 8-bit channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def grey(r="r", g="g", b="b") -> Column:
    """Luma of a pixel as an integer. ITU-R 601 weights in 16-bit fixed point."""
    return F.shiftright(F.col(r) * 19595 + F.col(g) * 38470 + F.col(b) * 7471 + 32768, 16)


def chroma(r="r", g="g", b="b") -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def mean_level(r="r", g="g", b="b") -> Column:
    return (F.col(r) + F.col(g) + F.col(b)) / 3.0


def hex_of(r, g, b) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def channels_of(text: Column) -> Column:
    """``#rrggbb`` as a struct of channels; anything else is black."""
    good = F.lower(F.ltrim(text)).rlike("^#?[0-9a-f]{6}$")
    digits = F.when(good, F.replace(text, F.lit("#"), F.lit(""))).otherwise("000000")
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
