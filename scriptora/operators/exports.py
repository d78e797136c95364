"""Records that leave the engine: annotated chunks, captured spans, documents with their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions.text import LEVELS, word_count
from scriptora.functions.tokens import count_tokens

_META = ("hierarchy", "word_count", "sentence_count", "quality", "quality_score", "scripture_references", "cross_references", "heading_path")


def annotation_records(chunks: DataFrame, annotations: DataFrame, document: Column | None = None, with_metadata: bool = True) -> DataFrame:
    """One record for each chunk with a label: what was said of it, its own fields as metadata, and its document.

    chunks: chunk_id, text, source_file if known. Chunks without a label and labels without a chunk are left out.
    """
    have, said = set(chunks.columns), set(annotations.columns)
    field = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in said else F.lit(default)
    meta = [c for c in _META if c in have]
    note = annotations.where("label is not null").select(
        "chunk_id",
        "label",
        *[(F.col(c) if c in said else F.lit(None).cast("string")).alias(c) for c in ("confidence",)],
        field("rationale", "").alias("rationale"),
        (F.coalesce("issues", F.array().cast("array<string>")) if "issues" in said else F.array().cast("array<string>")).alias("issues"),
        (F.col("timestamp") if "timestamp" in said else F.lit(None).cast("string")).alias("annotation_timestamp"),
        field("annotator_id", "default").alias("annotator_id"),
    )
    c = chunks.select(
        "chunk_id",
        (F.coalesce("source_file", F.lit("")) if "source_file" in have else F.lit("")).alias("source_file"),
        F.coalesce("text", F.lit("")).alias("text"),
        *([F.struct(*meta).alias("metadata")] if with_metadata and meta else []),
        *([] if document is None else [document.alias("document")]),
    )
    return c.join(note, "chunk_id")


def captures(spans: DataFrame, documents: DataFrame, bounds: DataFrame | None = None, tokenizer: str | None = None) -> DataFrame:
    """Spans of documents as captured chunks: text, counts, order, the chunks that they overlap and the first heading of
    these that isn't empty.

    spans: doc_id, capture_id, s_start, s_end (code points, the end exclusive), order, notes. bounds: doc_id, chunk_id,
    start, end, hierarchy.
    """
    from scriptora.operators.corpus import overlapping_boundaries

    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("document"))
    c = spans.join(d, "doc_id").withColumn("text", F.trim(F.substring("document", F.col("s_start") + 1, F.col("s_end") - F.col("s_start"))))
    c = c.drop("document").withColumns({"word_count": word_count(F.col("text")), "token_count": count_tokens(F.col("text"), tokenizer)})
    if bounds is None:
        return c
    hit = overlapping_boundaries(spans.withColumnRenamed("capture_id", "span_id"), bounds).withColumnRenamed("span_id", "capture_id")
    e = hit.select("doc_id", "capture_id", F.posexplode("chunk_ids").alias("i", "chunk_id")).join(bounds.select("doc_id", "chunk_id", "hierarchy"), ["doc_id", "chunk_id"])
    named = F.concat(*[F.col(f"hierarchy.{x}") for x in LEVELS]) != ""
    first = e.groupBy("doc_id", "capture_id").agg(F.min_by(F.when(named, F.col("hierarchy")), F.when(named, F.col("i"))).alias("hierarchy"))
    return c.join(hit, ["doc_id", "capture_id"], "left").join(first, ["doc_id", "capture_id"], "left").withColumnRenamed("chunk_ids", "source_chunk_ids")


def capture_totals(captured: DataFrame) -> DataFrame:
    """doc_id, captures, words, tokens."""
    return captured.groupBy("doc_id").agg(F.count("*").alias("captures"), F.sum("word_count").alias("words"), F.sum("token_count").alias("tokens"))


def capture_chunks(captured: DataFrame) -> DataFrame:
    """Captures as chunk rows like those of an extraction, flagged as made by hand."""
    return captured.select(
        "doc_id",
        F.col("capture_id").alias("stable_id"),
        F.col("order").alias("paragraph_id"),
        "text",
        "hierarchy",
        "word_count",
        F.array(F.lit("manually_captured")).alias("quality_flags"),
        F.col("order").alias("source_order"),
    )


def apply_results(index: DataFrame, results: DataFrame, *more: str) -> DataFrame:
    """index (url, status, ...) with the status of results (url, status) by URL, so that a failure doesn't shift those after it.

    more: columns of both that tell rows with one URL apart, so that each gets its own result; nulls count as equal.
    """
    last = results.groupBy("url", *more).agg(F.max("status").alias("new_status")).withColumnsRenamed({c: f"__{c}" for c in ("url", *more)})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) if c in more else F.col(c) == F.col(f"__{c}") for c in ("url", *more)]
    out = index.join(last, same, "left").withColumn("status", F.coalesce("new_status", "status"))
    return out.select("url", *[c for c in index.columns if c != "url"])


def pending(index: DataFrame, step: str) -> DataFrame:
    """The rows still to be downloaded, or downloaded and still to be processed."""
    if step == "download":
        return index.where("not downloaded")
    if step == "process":
        return index.where("downloaded and not processed")
    raise ValueError(f"unknown step {step!r}; download or process")


def storage_statistics(files: DataFrame, place: Column) -> DataFrame:
    """place, files, size: by folder, host or section."""
    return files.groupBy(place.alias("place")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with number, from 1 in each value of by."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
