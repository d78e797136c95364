"""What a PDF decoder gives (pages, characters, spans, outlines as tables) to spans, blocks and paragraph rows.

chars: doc_id, page_num, block_idx, line_idx, char_idx, c, font, font_size, flags. spans: doc_id, page_num, block_idx,
line_idx, span_idx, text, font_size, is_bold, is_mono. Each step is an aggregate or a window over one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions import text as T
from scriptora.operators.headings import heading_like, with_hierarchy
from scriptora.sources.shared import checkpointed

_PLACE = ("doc_id", "page_num", "block_idx", "line_idx")
BOLD, ITALIC, MONO = 1, 2, 4


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def segment(chars: DataFrame) -> DataFrame:
    """spans of characters: within a line a new one begins where the font or its size changes."""
    w = Window.partitionBy(*_PLACE).orderBy("char_idx")
    changed = ~(F.lag("font").over(w).eqNullSafe(F.col("font")) & F.lag("font_size").over(w).eqNullSafe(F.col("font_size")))
    first = F.row_number().over(w) == 1
    c = chars.withColumn("starts", (changed & ~first).cast("int")).withColumn("span_idx", F.sum("starts").over(w).cast("int"))
    letters = F.array_sort(F.collect_list(F.struct("char_idx", "c")))
    g = c.groupBy(*_PLACE, "span_idx").agg(letters.alias("l"), F.first("font").alias("font"), F.first("font_size").alias("font_size"), F.min_by("flags", "char_idx").alias("flags"))
    flags = [has_flag(F.col("flags"), f).alias(n) for f, n in ((BOLD, "is_bold"), (ITALIC, "is_italic"), (MONO, "is_mono"))]
    return g.select(*_PLACE, "span_idx", F.array_join("l.c", "").alias("text"), "font", "font_size", *flags)


def flatten_outline(entries: DataFrame, most: int = 32) -> DataFrame:
    """entries: doc_id, id, parent_id (null at the top), seq, title, page_num. In reading order: doc_id, order, level (from
    0), title, page_num. Entries deeper than ``most`` are an error, as a cycle would be."""
    level = checkpointed(entries.where("parent_id is null").withColumn("path", F.array("seq")))
    found, depth = level, 0
    while not level.isEmpty():
        if depth == most:
            raise ValueError(f"an outline is deeper than {most} levels")
        above = level.select("doc_id", F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = entries.join(above, ["doc_id", "parent_id"]).withColumn("path", F.concat("above", F.array("seq"))).select(*found.columns)
        level = checkpointed(level)
        found, depth = found.unionByName(level), depth + 1
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    return found.select("doc_id", n.alias("order"), (F.size("path") - 1).alias("level"), "title", "page_num")


def font_statistics(spans: DataFrame) -> DataFrame:
    """doc_id, size, is_bold, is_mono, characters, spans."""
    return spans.groupBy("doc_id", F.round("font_size", 1).alias("size"), "is_bold", "is_mono").agg(F.sum(F.length("text")).alias("characters"), F.count("*").alias("spans"))


def body_font(spans: DataFrame, otherwise: float = 12.0) -> DataFrame:
    """doc_id, body_size: the size with the most characters; of several, the first seen; of none, the usual one."""
    g = spans.groupBy("doc_id", F.round("font_size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page_num", "block_idx", "line_idx", "span_idx")).alias("seen"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "seen"))
    return g.withColumn("r", best).where("r = 1").select("doc_id", F.coalesce("size", F.lit(otherwise)).alias("body_size"))


def heading_sizes(spans: DataFrame, threshold: float = 1.2) -> DataFrame:
    """doc_id, size, level: sizes well above the body's, or bold and above it, that are frequent enough; six at most."""
    s = spans.where(~F.col("is_mono")).groupBy("doc_id", F.round("font_size", 1).alias("size"), "is_bold").agg(F.count("*").alias("n"))
    s = s.join(body_font(spans), "doc_id").where((F.col("size") >= F.col("body_size") * threshold) | ((F.col("size") > F.col("body_size")) & F.col("is_bold")))
    s = s.groupBy("doc_id", "size").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy("doc_id"))
    s = s.withColumn("least", F.greatest(F.lit(5), F.floor(top / 10))).where("n >= least")
    s = s.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))
    return s.where("level <= 6").select("doc_id", "size", "level")


def blocks(spans: DataFrame, spaced_caps: bool = True) -> DataFrame:
    """doc_id, page_num, block_idx, text (lines joined by spaces), size, bold and mono: the largest size of the lines' first
    spans, and whether any of these is bold or of one width."""
    line = F.array_sort(F.collect_list(F.struct("span_idx", "text", "font_size", "is_bold", "is_mono")))
    lines = spans.groupBy(*_PLACE).agg(line.alias("s"))
    first = lambda c: F.get(F.col(f"s.{c}"), F.lit(0))
    lines = lines.select(*_PLACE, F.array_join("s.text", "").alias("t"), F.round(first("font_size"), 1).alias("size"), first("is_bold").alias("b"), first("is_mono").alias("m"))
    g = lines.groupBy(*_PLACE[:3]).agg(F.array_sort(F.collect_list(F.struct("line_idx", "t"))).alias("l"), F.max("size").alias("size"), F.max("b").alias("bold"), F.max("m").alias("mono"))
    return g.select(*_PLACE[:3], T.clean_text(F.array_join("l.t", " "), spaced_caps).alias("text"), "size", "bold", "mono")


def span_paragraphs(spans: DataFrame, outline: DataFrame | None = None, least_words: int = 1, strong: float = 1.5, spaced_caps: bool = True) -> DataFrame:
    """Blocks in reading order. One of a heading's size, under 15 words, bold or ``strong`` times the body's size, sets the
    hierarchy; the others are paragraphs.

    outline: doc_id, order, level, title, page_num as flatten_outline() gives them; its entries hold from the start of
    their page, a level below their own.
    """
    b = blocks(spans, spaced_caps).where("text <> ''").join(heading_sizes(spans), ["doc_id", "size"], "left").join(body_font(spans), "doc_id", "left")
    b = b.withColumn("w", T.word_count(F.col("text")))
    # a page's outline comes before its first block
    at = F.col("page_num").cast("long") * (1 << 32)
    heading = (F.col("w") < 15) & ~F.col("mono") & (F.col("bold") | (F.col("size") >= F.col("body_size") * strong))
    rows = b.select("doc_id", "page_num", "text", "w", "mono", (at + (1 << 20) + F.col("block_idx")).alias("at"), F.when(heading, F.col("level")).alias("lv"))
    if outline is not None:
        marks = outline.select("doc_id", "page_num", F.col("title").alias("text"), F.lit(0).alias("w"), F.lit(False).alias("mono"), (at + F.col("order")).alias("at"), F.least(F.col("level") + 1, F.lit(6)).alias("lv"))
        rows = rows.unionByName(marks)
    h = with_hierarchy(rows, ["doc_id"], "at", F.col("lv"), F.col("text")).where((F.col("lv").isNull()) & (F.col("w") >= least_words))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return h.select("doc_id", n.alias("paragraph_id"), "text", "page_num", F.col("w").alias("word_count"), F.when(F.col("mono"), "code").otherwise("prose").alias("content_type"), "hierarchy")


def page_paragraphs(pages: DataFrame, least_words: int = 1) -> DataFrame:
    """pages: doc_id, page_num, text. Blocks between blank lines; one like a heading becomes level 1 for what follows."""
    b = pages.select("doc_id", "page_num", F.posexplode(F.transform(F.split(T.nfc(F.coalesce("text", F.lit(""))), "\n\n"), lambda x: T.tidy(x))).alias("i", "text"))
    b = b.where(F.col("text") != "").withColumn("w", T.words(F.col("text"))).where(F.size("w") >= least_words)
    b = b.withColumns({"at": F.col("page_num").cast("long") * (1 << 32) + F.col("i"), "heading": heading_like(F.col("text"), F.col("w"))})
    b = with_hierarchy(b, ["doc_id"], "at", F.when(F.col("heading"), 1), F.col("text")).where(~F.col("heading"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return b.select("doc_id", n.alias("paragraph_id"), "text", "page_num", F.size("w").alias("word_count"), "hierarchy")
