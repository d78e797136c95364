"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``width`` consecutive words (a shorter item is one window). Words are ordered by
how often they occur in the documents. For a whole window to occur, its rarest word has to occur at the same offset:
that one token is the necessary prefix, so documents are joined on it alone, then checked by length and position
(the window has to lie within the text) and last by exact comparison of the words in between.

The windows are joined in blocks of at most BLOCK_BYTES, each broadcast; the number of blocks follows the measured
size of the benchmark, so what a task holds doesn't grow with it. Every document carries one sentinel word, which
matches a sentinel row, so documents without a hit come out of the same pass.

Null or empty texts have no words; such items have no windows. Null item ids count as the empty text. Documents
repeated with the same id and text each give their row. Other columns are not read. Texts are processed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.llm.common import GAPS, ascii_lower, id_and_text, unused, written

WIDTH, BLOCK_BYTES = 8, 8 << 20
#: About as many items at most are in one row of a window; there are further rows for more.
ITEMS_A_ROW = 500
_SENTINEL = " "


def _words(text):
    return F.split(ascii_lower(text), GAPS)


def item_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """key, part, words, item_ids (distinct, as text) of each distinct window; one that very many items share has parts."""
    w = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
        F.filter(_words(F.coalesce(F.col(text_col), F.lit(""))), lambda x: x != "").alias("w"),
    ).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    w = (
        w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
        .withColumn("key", F.array_join("words", " "))
        .groupBy("key", "item_id")
        .agg(F.first("words").alias("words"))
    )
    many = w.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > ITEMS_A_ROW)
    part = F.pmod(F.xxhash64("item_id"), F.ceil(F.coalesce("n", F.lit(1)) / ITEMS_A_ROW))
    return (
        w.join(many, "key", "left")
        .groupBy("key", part.alias("part"))
        .agg(F.first("words").alias("words"), F.collect_set("item_id").alias("item_ids"))
    )


def _anchored(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """windows with anchor, its rarest word in docs (ties: the smaller word), and offset, where that stands first."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    seen = docs.select(F.explode_outer(_words(F.col("text"))).alias("word")).join(F.broadcast(vocabulary), "word")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    rarest = (
        windows.select("key", "words").distinct().select("key", F.explode("words").alias("word"))
        .join(counts, "word", "left")
        .groupBy("key")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("low"))
    )
    # a window with a word that no document has can't occur
    return windows.join(rarest.where("low.n > 0"), "key").select(
        F.col("low.word").alias("anchor"),
        (F.array_position("words", F.col("low.word")) - 1).cast("int").alias("offset"),
        F.col("words").alias("wanted"),
        "item_ids",
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated; a row a document."""
    d = id_and_text(docs, id_col, text_col)
    windows = item_windows(items, width)
    total = windows.agg(F.coalesce(F.sum(F.length("key") + 16 * F.size("item_ids") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    parts = [_block(d, windows.where(F.pmod(F.xxhash64("key", "part"), F.lit(blocks)) == b) if blocks > 1 else windows) for b in range(blocks)]
    if blocks == 1:
        merged = parts[0]
    else:
        merged = (
            reduce(DataFrame.unionByName, parts)
            .groupBy("doc_id", "text_hash")
            .agg(
                F.max("rows").alias("rows"),
                F.max("n_words").alias("n_words"),
                F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"),
                F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
            )
        )
    hit = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1))))
    return (
        merged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            F.size(hit).cast("long").alias("n_hit"),
            F.size("found").cast("long").alias("n_items"),
            F.array_sort("found").alias("item_ids"),
        )
        .withColumn("contaminated", F.col("n_items") >= min_items)
    )


def _block(d: DataFrame, windows: DataFrame) -> DataFrame:
    w = F.col("w")
    cut = d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(F.array(F.lit(_SENTINEL)), _words(F.col("text"))).alias("w"))
    n_words = (
        F.size(w) - 1 - F.when(F.get(w, F.lit(1)) == "", 1).otherwise(0) - F.when((F.size(w) > 2) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    )
    anchors = _anchored(windows, d)
    sentinel = d.sparkSession.range(1).select(
        F.lit(_SENTINEL).alias("anchor"),
        F.lit(0).alias("offset"),
        F.array(F.lit(_SENTINEL)).alias("wanted"),
        F.lit(None).cast("array<string>").alias("item_ids"),
    )
    small = F.broadcast(anchors.unionByName(sentinel))
    start, length = F.col("pos") - F.col("offset"), F.size("wanted")
    found = (
        cut.select("doc_id", "text_hash", "w", F.posexplode_outer("w").alias("pos", "word"))
        .join(small, F.col("word") == F.col("anchor"))
        .where((start >= 0) & (start + length <= F.size(w)))
        .where(F.get(w, start) == F.get(F.col("wanted"), F.lit(0)))
        .where(F.slice(w, F.greatest(start, F.lit(0)) + 1, length) == F.col("wanted"))
    )
    is_doc = F.col("item_ids").isNull()
    return found.select(
        "doc_id",
        "text_hash",
        F.when(is_doc, n_words.cast("long")).alias("n_words"),
        is_doc.cast("long").alias("is_doc"),
        F.when(~is_doc, F.struct(start.alias("start"), length.alias("len"))).alias("run"),
        "item_ids",
    ).groupBy("doc_id", "text_hash").agg(
        F.sum("is_doc").alias("rows"),
        F.max("n_words").alias("n_words"),
        F.collect_set("run").alias("runs"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("found"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    own_id, own_hash = unused(docs, "own_id", "own_hash")
    bad = contamination(docs, items, width, min_items, id_col, text_col).where("contaminated").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    bad = written(bad, "contaminated")  # its size is known from its files, so the planner broadcasts it only below the threshold
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(own_hash))
    return docs.join(bad, same, "left_anti")
