"""Where results go: NDJSON, chunk documents, reports, corpora, splits, issues, shards by date. All writes are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.functions.text import LEVELS


def write_ndjson(df: DataFrame, path: str) -> None:
    """One object a line; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_documents(metadata: DataFrame, chunks: DataFrame, path: str) -> None:
    """One object a document: metadata and its chunks in order. doc_id joins them; documents without chunks have none."""
    fields = [c for c in chunks.columns if c != "doc_id"]
    first = "paragraph_id" if "paragraph_id" in fields else fields[0]
    item = F.struct(first, *[c for c in fields if c != first])
    nested = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    meta = metadata.select("doc_id", F.struct(*[c for c in metadata.columns if c != "doc_id"]).alias("metadata"))
    write_ndjson(meta.join(nested, "doc_id", "left"), path)


def write_document_set(metadata: DataFrame, chunks: DataFrame, path: str, lines: bool = False) -> None:
    """Three folders for all documents: data (metadata and chunks), metadata alone, reports; and chunks as lines on request."""
    write_documents(metadata, chunks, f"{path}/data")
    write_ndjson(metadata, f"{path}/metadata")
    report_lines(hierarchy_report(chunks)).write.mode("overwrite").json(f"{path}/hierarchy_report")
    if lines:
        write_ndjson(chunks, f"{path}/chunks")


def write_training(records: DataFrame, path: str) -> DataFrame:
    """Training records as lines, and what is in them by label (rows, characters) as the manifest that is returned."""
    write_ndjson(records, f"{path}/records")
    out = manifest(records, "label")
    out.write.mode("overwrite").json(f"{path}/manifest")
    return out


def write_index(index: DataFrame, path: str) -> None:
    """Replaces the index of an archive; readers see the old or the new files, never a mixture of both in one plan."""
    index.write.mode("overwrite").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Adds events of annotation sessions to their log, a folder a session."""
    events.write.mode("append").partitionBy("session").parquet(path)


def hierarchy_report(chunks: DataFrame) -> DataFrame:
    """doc_id, the six levels, first and last paragraph, words, paragraphs: the tree of a document's report, by first seen."""
    g = chunks.groupBy("doc_id", *[F.col(f"hierarchy.{x}").alias(x) for x in LEVELS])
    return g.agg(F.min("paragraph_id").alias("first_paragraph"), F.max("paragraph_id").alias("last_paragraph"), F.sum("word_count").alias("words"), F.count("*").alias("paragraphs"))


def report_lines(report: DataFrame) -> DataFrame:
    """doc_id, text: the report printed, one row a document."""
    shown = [F.when(F.col(x) != "", F.concat(F.lit("  " * i + ("└─ " if i else "")), F.col(x))) for i, x in enumerate(LEVELS)]
    n = sum((F.when(F.col(x) != "", 1).otherwise(0) for x in LEVELS[1:]), F.when(F.col(LEVELS[0]) != "", 1).otherwise(0))
    tail = F.concat(F.repeat(F.lit("  "), n), F.lit("[¶ "), F.col("first_paragraph").cast("string"), F.lit("-"), F.col("last_paragraph").cast("string"), F.lit(", ~"), F.col("words").cast("string"), F.lit(" words]"))
    block = F.concat_ws("\n", *shown, tail)
    rows = report.where(n > 0).select("doc_id", "first_paragraph", "words", block.alias("block"))
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_paragraph", "block"))).alias("b"))
    return g.select("doc_id", F.array_join("b.block", "\n\n").alias("text"))


def write_split(df: DataFrame, path: str, column: str) -> None:
    """A folder for each value of the column: a split, a label's name, an issue."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def by_issue(annotated: DataFrame, issues: list[str] | None = None) -> DataFrame:
    """A row for each issue of a row, so that it is in several files; only the named ones if given."""
    e = annotated.withColumn("issue", F.explode(F.array_distinct("issues")))
    return e if issues is None else e.where(F.col("issue").isin(*issues))


def by_label(annotated: DataFrame) -> DataFrame:
    return annotated.where("label is not null").withColumn("label_name", F.when(F.col("label") == 0, "good").when(F.col("label") == 1, "bad").otherwise(F.concat(F.lit("label_"), F.col("label").cast("string"))))


def audit(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Chunks with their lineage: every version in order."""
    fields = [c for c in edits.columns if c not in ("chunk_id", "version")]
    g = edits.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("version", *fields))).alias("lineage"))
    return chunks.join(g, "chunk_id", "left")


def diff_report(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """chunk_id, text: a Markdown section with the original, the latest edit, its reason and the versions before."""
    # only numbers and reasons meet as a list; of the texts none but the last one is moved
    item = F.struct("version", "edit_reason")
    last = F.max_by(F.struct("version", "edited_text", "edit_reason"), "version").alias("last")
    g = edits.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("v"), last).join(chunks.select("chunk_id", "text"), "chunk_id")
    last = F.col("last")
    fence = lambda title, body: F.concat(F.lit(f"**{title}**:\n```\n"), body, F.lit("\n```\n\n"))
    history = F.when(F.size("v") > 1, F.concat(F.lit("**Versions**: "), F.array_join(F.transform("v", lambda x: F.concat(F.lit("v"), x["version"].cast("string"), F.lit(" "), x["edit_reason"])), "; "), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("## Chunk "), F.col("chunk_id").cast("string"), F.lit(" (version "), last["version"].cast("string"), F.lit(")\n\n"))
    return g.select("chunk_id", F.concat(head, fence("Original", F.col("text")), fence("Edited", last["edited_text"]), F.lit("**Reason**: "), last["edit_reason"], F.lit("\n"), history).alias("text"))


def manifest(corpus: DataFrame, by: str) -> DataFrame:
    """How many rows and characters there are for each value."""
    return corpus.groupBy(by).agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters"))


def write_by_date(days: DataFrame, path: str, column: str = "date") -> None:
    """Replaces the partitions of the dates in days and leaves the others."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
