"""Where documents come from: files by format, imported chunk documents, chunk lists, sessions. Nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptora.functions.text import LEVELS
from scriptora.operators.epub import EpubConfig, epub_paragraphs
from scriptora.operators.parsers import format_of, html_paragraphs, markdown_paragraphs

_LEVELS = ", ".join(f"{x}: string" for x in LEVELS)
_FIELDS = {
    **dict.fromkeys(("stable_id", "chunk_id"), "string"),
    "paragraph_id": "int",
    "text": "string",
    "word_count": "int",
    "hierarchy": f"struct<{_LEVELS}>",
    "content_type": "string",
    **dict.fromkeys(("sentences", "scripture_references", "cross_references", "dates_mentioned"), "array<string>"),
}
CHUNK = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
_CHUNKS = ", ".join(f"{k}: {v}" for k, v in _FIELDS.items())
DOCUMENT = (
    "metadata struct<title: string, author: string, provenance: struct<doc_id: string, source_file: string>>, "
    f"chunks array<struct<{_CHUNKS}>>"
)
EXTENSIONS = "*.{epub,pdf,html,htm,md,markdown,json}"


def files(spark: SparkSession, path: str, pattern: str = EXTENSIONS) -> DataFrame:
    """path, format, length, modificationTime, content of the files of a folder and those below it."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.withColumn("format", format_of(F.col("path")))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    f = files(spark, path, "*.{html,htm}").select("path", F.decode("content", "UTF-8").alias("html"))
    return html_paragraphs(f, "path", "html")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    f = files(spark, path, "*.{md,markdown,txt}").select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    return markdown_paragraphs(f)


def read_epub(spark: SparkSession, path: str, config: EpubConfig = EpubConfig()) -> DataFrame:
    return epub_paragraphs(files(spark, path, "*.epub"), config)


def read_chunk_documents(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of imported documents: doc_id, source_file and each chunk's fields; levels that are missing are ''."""
    d = spark.read.schema(DOCUMENT).option("multiLine", "true").json(path)
    c = d.select(
        F.coalesce("metadata.provenance.doc_id", F.lit("")).alias("doc_id"), F.col("metadata.provenance.source_file").alias("source_file"), F.posexplode("chunks").alias("source_order", "c")
    ).select("doc_id", "source_file", "source_order", "c.*")
    return with_ids(c.withColumn("hierarchy", F.struct(*[F.coalesce(f"hierarchy.{x}", F.lit("")).alias(x) for x in LEVELS])))


def with_ids(c: DataFrame) -> DataFrame:
    """Chunks without any id get one of their file and place."""
    made = F.concat_ws("_", F.coalesce("source_file", F.lit("")), F.lit("chunk"), F.col("source_order").cast("string"))
    return c.withColumn("chunk_id", F.coalesce("stable_id", "chunk_id", made))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of files of either kind in a folder: .jsonl and .ndjson hold a chunk a line, .json a document or a list.

    A list is a document without metadata. Chunks without an id get one of their file and place.
    """
    has = lambda pattern: not files(spark, path, pattern).limit(1).isEmpty()
    cols = ["source_file", "source_order", *_FIELDS]
    parts = []
    if has("*.{jsonl,ndjson}"):
        read = spark.read.schema(CHUNK).option("pathGlobFilter", "*.{jsonl,ndjson}").option("recursiveFileLookup", "true").json(path)
        lines = read.select(_name(), F.monotonically_increasing_id().alias("source_order"), *_FIELDS)
        parts.append(lines.where("text is not null or stable_id is not null"))
    if has("*.json"):
        whole = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
        doc = F.from_json("value", DOCUMENT)
        chunks = F.when(F.col("value").rlike(r"\A\s*\["), F.from_json("value", f"array<struct<{_CHUNKS}>>")).otherwise(doc["chunks"])
        c = whole.select(F.coalesce(doc["metadata"]["provenance"]["source_file"], _name()).alias("source_file"), F.posexplode(chunks).alias("source_order", "c"))
        parts.append(c.select("source_file", F.col("source_order").cast("long").alias("source_order"), "c.*").select(*cols))
    if not parts:
        raise ValueError(f"{path} has no .json, .jsonl or .ndjson file")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_ids(out)


def _name():
    return F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_file")


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of NDJSON."""
    c = spark.read.schema(CHUNK).json(path)
    return c.where("text is not null or stable_id is not null")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session, chunk_id, label, confidence, rationale, issues, timestamp, annotator_id from session files."""
    note = "struct<label: int, confidence: int, rationale: string, issues: array<string>, timestamp: string, annotator_id: string>"
    s = spark.read.schema(f"annotations map<string, {note}>").option("multiLine", "true").json(path)
    s = s.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("session"), F.explode("annotations").alias("chunk_id", "a"))
    return s.select("session", "chunk_id", "a.*").withColumn("annotator_id", F.coalesce("annotator_id", F.lit("default")))
