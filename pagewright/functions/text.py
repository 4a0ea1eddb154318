"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of ``text``; stop words removed when given."""
    found = F.array_distinct(F.split(F.lower(text), WORD_BREAK))
    dropped = ("",) + tuple(w.lower() for w in stop_words)
    return F.array_except(found, F.array(*[F.lit(w) for w in dropped]))


def md5_order(*parts: Column) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
