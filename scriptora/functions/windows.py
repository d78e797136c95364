"""Fixed windows of words, for text without a usable structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptora.functions.text import words

#: (size, overlap) for documents of the lowest quality, and for those in which no block was found.
LOW_QUALITY, FALLBACK = (120, 20), (100, 20)


def fixed_windows(text: Column, size: int = LOW_QUALITY[0], overlap: int = LOW_QUALITY[1], least: int = 6) -> Column:
    """Windows of ``size`` words that share ``overlap`` with the next one, as an array; those under ``least`` words go."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be from 0 to below size")

    def cut(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.size(w) - i >= least)
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))

    return F.get(F.transform(F.array(words(text)), cut), F.lit(0))
