"""Annotation sessions as event logs: what was said last holds, undo takes events back, edits are appended as versions.

annotation events: session, seq, chunk_id, kind ('set' or 'undo'), label, ...; edits: chunk_id, version, edited_text, ....
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions.identity import edited_id

MOST_UNDO = 50


def effective_events(events: DataFrame, most: int = MOST_UNDO) -> DataFrame:
    """The set events that no undo took back: an undo takes the last one on a stack that holds the last ``most``.

    Sets and undos match like brackets. The depth of the stack without a bound is the running sum of sets and undos
    above its least value so far (an undo of an empty stack does nothing). The bracket that follows a set at its own level
    is the undo that takes it, unless the level ``most`` above was reached before: then the bounded stack had dropped it.
    """
    by_seq = Window.partitionBy("session").orderBy("seq")
    so_far = by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_set = F.col("kind") == "set"
    e = events.select("session", "seq", is_set.alias("is_set"), F.sum(F.when(is_set, 1).otherwise(-1)).over(so_far).alias("sum"))
    e = e.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    e = e.withColumn("before", F.coalesce(F.lag("depth").over(by_seq), F.lit(0))).where("is_set or before > 0")
    level = F.when(F.col("is_set"), F.col("depth")).otherwise(F.col("before"))
    own = F.struct(level.alias("level"), F.when(F.col("is_set"), "set").otherwise("undo").alias("role"))
    over = F.when(F.col("is_set") & (F.col("depth") > most), F.struct((level - most).alias("level"), F.lit("over").alias("role")))
    roles = e.select("session", "seq", F.explode(F.array_compact(F.array(own, over))).alias("r")).select("session", "seq", "r.level", "r.role")
    then = F.lead("role").over(Window.partitionBy("session", "level").orderBy("seq"))
    gone = roles.withColumn("then", then).where("role = 'set' and then = 'undo'").select("session", "seq")
    return events.where(is_set).join(gone, ["session", "seq"], "left_anti")


def current_labels(events: DataFrame, most: int = MOST_UNDO) -> DataFrame:
    """session, chunk_id, label: the last label that stands; null for skipped."""
    return effective_events(events, most).groupBy("session", "chunk_id").agg(F.max_by("label", "seq").alias("label"))


def unannotated(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks without a label that isn't null."""
    return chunks.join(labels.where("label is not null").select("chunk_id"), "chunk_id", "left_anti")


def add_edits(edits: DataFrame, new: DataFrame, chunks: DataFrame) -> DataFrame:
    """edits with new ones (chunk_id, edited_text, edit_reason, at) as next versions of known chunks; a reason is required.

    Only the last version of a chunk is current.
    """
    known = new.where(F.trim(F.coalesce("edit_reason", F.lit(""))) != "").join(chunks.select("chunk_id", F.col("text").alias("original_text")), "chunk_id")
    done = edits.groupBy("chunk_id").agg(F.max("version").alias("__v"))
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("at"))
    rows = known.withColumn("__n", nth).join(done, "chunk_id", "left").withColumn("version", (F.coalesce("__v", F.lit(0)) + F.col("__n")).cast("int"))
    cols = ["chunk_id", "version", "edited_text", "edit_reason"]
    every = edits.select(*cols).unionByName(rows.select(*cols))
    last = F.max("version").over(Window.partitionBy("chunk_id"))
    return every.withColumn("is_current_version", F.col("version") == last).withColumn("edited_chunk_id", edited_id(F.col("edited_text")))


def restore(edits: DataFrame, wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted: chunk_id, version, edit_reason, at. Each old version's text becomes the newest one."""
    texts = wanted.join(edits.select("chunk_id", "version", "edited_text"), ["chunk_id", "version"]).drop("version")
    return add_edits(edits, texts, chunks)


def progress(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: total, annotated, percent (0 for no chunks)."""
    j = chunks.select("chunk_id").join(labels.where("label is not null").select("chunk_id").distinct().withColumn("y", F.lit(1)), "chunk_id", "left")
    n, k = F.count("*"), F.count("y")
    return j.agg(n.alias("total"), k.alias("annotated"), F.when(n > 0, 100.0 * k / n).otherwise(0.0).alias("percent"))


def training_records(chunks: DataFrame, annotations: DataFrame, session: Column) -> DataFrame:
    """chunk_id, text, label, source_session, features, annotation: one record for each labelled chunk."""
    from scriptora.functions.text import LEVELS

    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    have = set(chunks.columns)
    depth = F.size(F.filter(F.array(*[F.col("hierarchy")[x] for x in LEVELS]), lambda x: x != "")) if "hierarchy" in have else F.lit(0)
    num = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    feats = F.struct(
        num("word_count", 0).alias("word_count"),
        num("sentence_count", 0).alias("sentence_count"),
        depth.alias("hierarchy_depth"),
        num("quality_score", 0.0).alias("quality_score"),
        (size("scripture_references") if "scripture_references" in have else F.lit(0)).alias("scripture_refs_count"),
        (size("cross_references") if "cross_references" in have else F.lit(0)).alias("cross_refs_count"),
    )
    note = [c for c in ("confidence", "rationale", "issues", "timestamp", "annotator_id") if c in annotations.columns]
    j = chunks.withColumn("features", feats).join(annotations.where("label is not null"), "chunk_id")
    keep = ["chunk_id", "text", "label", session.alias("source_session"), "features"]
    return j.select(*keep, F.struct(*note).alias("annotation")) if note else j.select(*keep)


def capture_order(captured: DataFrame) -> DataFrame:
    """Captured spans that weren't removed, numbered by their given order, then by when they were made."""
    n = F.row_number().over(Window.partitionBy("session").orderBy(F.col("position").asc_nulls_last(), "seq"))
    return captured.where(~F.col("removed")).withColumn("number", n)
