"""Documents to paragraphs: one row each, in order, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.functions import refs, text
from scriptora.functions.identity import stable_id


def paragraph_texts(c: Column, spaced_caps: bool = True) -> Column:
    """The cleaned lines of a text that aren't empty."""
    lines = F.split(text.nfc(F.coalesce(c, F.lit(""))), "\n")  # a line end composes with nothing
    return F.filter(F.transform(lines, lambda x: text.tidy(x, spaced_caps)), lambda x: x != "")


def from_lines(docs: DataFrame, h: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep=(), spaced_caps: bool = True) -> DataFrame:
    """doc_id, the columns keep, paragraph_id (from 1), text, word_count, hierarchy of each line with a text.

    spaced_caps: whether capitals set apart become words, as in clean_text().
    """
    h = text.no_hierarchy() if h is None else h
    d = docs.select(F.col(id_col).alias("doc_id"), *keep, h.alias("hierarchy"), F.posexplode(paragraph_texts(F.col(text_col), spaced_caps)).alias("i", "text"))
    return d.select("doc_id", *keep, (F.col("i") + 1).alias("paragraph_id"), "text", text.tidy_word_count(F.col("text")).alias("word_count"), "hierarchy")


def nested(docs: DataFrame, h: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep=(), spaced_caps: bool = True) -> DataFrame:
    """doc_id, the columns keep, ps: the paragraphs of from_lines() as an array (paragraph_id, text, word_count, hierarchy).

    What works on a document's paragraphs in order takes them from here, so that they never leave their row.
    """
    h = text.no_hierarchy() if h is None else h
    d = docs.select(F.col(id_col).alias("doc_id"), *keep, h.alias("hierarchy"), paragraph_texts(F.col(text_col), spaced_caps).alias("texts"))
    item = lambda x, i: F.struct((i + 1).alias("paragraph_id"), x.alias("text"), text.tidy_word_count(x).alias("word_count"), F.col("hierarchy").alias("hierarchy"))
    return d.select("doc_id", *keep, F.transform("texts", item).alias("ps"))


def unnest(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """The columns keep with a row for each element of array, which isn't null.

    A plain explode makes Spark test the array's size in a filter of its own, below, where all that it is made from is
    computed again (for each element, where a lambda refers to it); the outer one doesn't.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def enrich_nested(nested: DataFrame, content_type: str = "prose") -> DataFrame:
    """The rows (doc_id, ps) with what a chunk inherits in each of ps: sentences, type and references as enrich() finds them."""
    none = F.array().cast("array<string>")
    kept = ("paragraph_id", "text", "word_count", "hierarchy")
    code = content_type == "code"

    def item(p: Column) -> Column:
        t = p["text"]
        return F.struct(
            *[p[c].alias(c) for c in kept],
            F.lit(content_type).alias("content_type"),
            (F.array(t) if code else text.sentences(t)).alias("sentences"),
            (none if code else refs.cross_references(t)).alias("cross_references"),
            (none if code else refs.scripture_references(t)).alias("scripture_references"),
            (none if code else refs.dates(t)).alias("dates_mentioned"),
        )

    return nested.withColumn("ps", F.transform("ps", item))


def enrich(paragraphs: DataFrame, tag: str = "p", content_type: str = "prose") -> DataFrame:
    """Every field of a chunk, from doc_id, paragraph_id, text and hierarchy; a source_tag or content_type that is there stays."""
    have = set(paragraphs.columns)
    p = paragraphs if "source_tag" in have else paragraphs.withColumn("source_tag", F.lit(tag))
    p = p if "content_type" in have else p.withColumn("content_type", F.lit(content_type))
    p = p.withColumn("sentences", F.when(F.col("content_type") == "code", F.array("text")).otherwise(text.sentences(F.col("text"))))
    none = F.array().cast("array<string>")
    unless_code = lambda c: F.when(F.col("content_type") == "code", none).otherwise(c)
    return p.withColumns(
        {
            "stable_id": stable_id(F.col("doc_id"), F.col("source_tag"), F.col("paragraph_id")),
            "source_order": F.col("paragraph_id"),
            "text_length": F.length("text"),
            "word_count": text.word_count(F.col("text")),
            "cross_references": unless_code(refs.cross_references(F.col("text"))),
            "scripture_references": unless_code(refs.scripture_references(F.col("text"))),
            "dates_mentioned": unless_code(refs.dates(F.col("text"))),
            "heading_path": text.heading_path(F.col("hierarchy")),
            "hierarchy_depth": text.hierarchy_depth(F.col("hierarchy")),
            "sentence_count": F.size("sentences"),
            "normalized_text": F.lower("text"),
        }
    )
