"""Heading state as windows: a heading sets its level and clears the deeper ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions.text import LEVELS


def with_hierarchy(rows: DataFrame, partition: list[str], order: str, level: Column, title: Column, most: int = 100) -> DataFrame:
    """rows with hierarchy: for each, the headings in force. level is null for rows that aren't headings.

    The last heading of level k holds unless one of a higher rank came after it. One window, one sort for all levels.
    """
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"__level": level, "__title": F.substring(title, 1, most)})
    mark = F.struct(F.col(order).alias("at"), F.col("__title").alias("title"))
    seen = {k: F.last(F.when(F.col("__level") == k, mark), ignorenulls=True).over(w) for k in range(1, 7)}
    out = out.withColumns({f"__h{k}": c for k, c in seen.items()})
    cols, above = [], F.lit(-1).cast("long")
    for k, name in enumerate(LEVELS, 1):
        at = F.coalesce(F.col(f"__h{k}.at").cast("long"), F.lit(-1))
        cols.append(F.when(at > above, F.col(f"__h{k}.title")).otherwise(F.lit("")).alias(name))
        above = F.greatest(above, at)
    return out.withColumn("hierarchy", F.struct(*cols)).drop("__level", "__title", *[f"__h{k}" for k in range(1, 7)])


def reset_from(h: Column, depth: int) -> Column:
    """The hierarchy with level depth and deeper cleared."""
    return F.struct(*[(h[x] if i < depth else F.lit("")).alias(x) for i, x in enumerate(LEVELS, 1)])


def shift_down(h: Column, by: int, keep_first: bool = True) -> Column:
    """Level k moves to k - by; level 1 stays if keep_first, and what would land on it or above is dropped."""
    low = 2 if keep_first else 1
    source = {k - by: k for k in range(low, 7) if k - by >= low}
    cols = []
    for k, x in enumerate(LEVELS, 1):
        c = h[x] if keep_first and k == 1 else h[f"level_{source[k]}"] if k in source else F.lit("")
        cols.append(c.alias(x))
    return F.struct(*cols)


def heading_like(text: Column, words: Column) -> Column:
    """At most 15 words, and all capitals or over .7 of the words capitalised."""
    letters = (F.upper(text) == text) & (F.lower(text) != text)
    big = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / F.size(words)
    return (F.size(words) > 0) & (F.size(words) <= 15) & (letters | (big > 0.7))


def font_size(style: Column) -> Column:
    """struct(value, unit) of an inline style, or null."""
    p = "(?i)font-size" + r"\s*:\s*" + "([.0-9]+)(%|r?em|p[tx])"
    v, u = F.regexp_extract(style, p, 1), F.lower(F.regexp_extract(style, p, 2))
    return F.when(u != "", F.struct(v.try_cast("double").alias("value"), u.alias("unit")))


def is_large(style: Column, threshold: float = 1.3) -> Column:
    s = font_size(style)
    least = F.when(s["unit"] == "%", threshold * 100).when(s["unit"] == "pt", 16.0).when(s["unit"] == "px", 20.0).otherwise(threshold)
    return F.coalesce(s["value"] >= least, F.lit(False))


def level_of_size(style: Column) -> Column:
    """Level by size in em: 2 and more 1, 1.5 2, 1.3 3, else 2."""
    s = font_size(style)
    em = s["value"] / F.when(s["unit"] == "%", 100.0).when(s["unit"] == "pt", 12.0).when(s["unit"] == "px", 16.0).otherwise(1.0)
    return F.when(em >= 2.0, 1).when(em >= 1.5, 2).when(em >= 1.3, 3).otherwise(2)


def is_visual_heading(style: Column, emphasised: Column, text: Column, words: Column, threshold: float = 1.3) -> Column:
    """Two of: large font, emphasis, text like a heading; at most 15 words."""
    signs = sum((F.when(x, 1).otherwise(0) for x in (emphasised, heading_like(text, words))), F.when(is_large(style, threshold), 1).otherwise(0))
    return F.size(words).between(1, 15) & (signs >= 2)
