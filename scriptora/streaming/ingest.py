"""Incremental ingest with Structured Streaming: parse, chunk and index documents as they arrive.

A document is one row, so parsing and rechunking are stateless and run in append mode; what has been seen is the
checkpoint's business. URLs are deduplicated within a watermark, so state is bounded; annotation events fold into the
latest label of each chunk by a keyed aggregation.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from scriptora.functions import quality, text
from scriptora.functions.identity import stable_id
from scriptora.operators.chunking import RETRIEVAL, TokenConfig, rechunk
from scriptora.operators.paragraphs import from_lines


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, **options) -> DataFrame:
    """Parquet files of a folder as they appear."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).parquet(path)


def paragraphs(docs: DataFrame, spaced_caps: bool = True) -> DataFrame:
    """Paragraph rows of a stream (or batch) of doc_id, text."""
    return from_lines(docs, spaced_caps=spaced_caps)


def scored(docs: DataFrame) -> DataFrame:
    """docs with quality score and route."""
    s = quality.score(quality.signals(F.col("text")))
    return docs.withColumn("score", s).withColumn("route", quality.route(s))


def token_chunks(docs: DataFrame, cfg: TokenConfig = RETRIEVAL) -> DataFrame:
    """Overlapping token chunks: a stateless explode."""
    d = docs.select("doc_id", stable_id(F.col("doc_id")).alias("stable_id"), "text", text.sentences(F.col("text")).alias("sentences"))
    return rechunk(d, cfg)


def new_urls(found: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first of each URL within the watermark."""
    return found.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total in tumbling windows of ts."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def latest_labels(events: DataFrame) -> DataFrame:
    """chunk_id, label, version of the last event of each chunk; update or complete mode."""
    return events.groupBy("chunk_id").agg(F.max_by("label", "version").alias("label"), F.max("version").alias("version"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that takes all that is there and ends: run again, it goes on where it stopped."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start()


class Progress(StreamingQueryListener):
    """What each batch of each stream did: (query, batch, rows, milliseconds), the last ``most`` of them."""

    def __init__(self, most: int = 1000):
        self.batches: deque[tuple[str, int, int, int]] = deque(maxlen=most)
        self.failed: list[tuple[str, str]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name or str(p.id), p.batchId, p.numInputRows, int(p.batchDuration)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append((str(event.id), event.exception))


def latest_rows(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs a stream in update mode to the end of what is there; the last row of each key, read from a table.

    Each batch writes what it changed under its own number, so one that is run again replaces what it wrote.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = df.sparkSession.read.option("basePath", path).schema(f"{_ddl(df)}, batch long").parquet(path)
    rest = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
