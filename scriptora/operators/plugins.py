"""Extension points: parsers, chunking strategies, analyzers and scrapers by name, each a function over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.functions import refs
from scriptora.operators import analysis


class Parser(Protocol):
    """files (path, content) to paragraph rows."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


class Strategy(Protocol):
    """Paragraph rows and a configuration (or None) to chunk rows."""

    def __call__(self, paragraphs: DataFrame, config: Any) -> DataFrame: ...


class Analyzer(Protocol):
    """documents (doc_id, text) and their chunks (doc_id, paragraph_id, text, word_count, hierarchy) to metadata columns."""

    def __call__(self, documents: DataFrame, chunks: DataFrame) -> DataFrame: ...


class Scraper(Protocol):
    """pages (url, html) to rows of what is found in them."""

    def __call__(self, pages: DataFrame) -> DataFrame: ...


class Registry:
    """Functions of one kind by name and alias."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, *names: str, replace: bool = False):
        """A decorator. A name that is taken raises ValueError unless it is to be replaced."""

        def add(f: Callable) -> Callable:
            for n in names:
                if n in self._known and not replace:
                    raise ValueError(f"there is a {self.kind} {n!r}")
                self._known[n] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"no {self.kind} {name!r}; there are {', '.join(self.names())}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


PARSERS, STRATEGIES, ANALYZERS, SCRAPERS = (Registry(k) for k in ("parser", "strategy", "analyzer", "scraper"))


@PARSERS.register("html")
def _html(files: DataFrame) -> DataFrame:
    from scriptora.operators.parsers import html_paragraphs

    return html_paragraphs(files.select("path", F.decode("content", "UTF-8").alias("html")), "path")


@PARSERS.register("markdown", "md")
def _markdown(files: DataFrame) -> DataFrame:
    from scriptora.operators.parsers import markdown_paragraphs

    return markdown_paragraphs(files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text")))


@PARSERS.register("epub")
def _epub(files: DataFrame) -> DataFrame:
    from scriptora.operators.epub import epub_paragraphs

    return epub_paragraphs(files)


@SCRAPERS.register("images")
def _images(pages: DataFrame) -> DataFrame:
    from scriptora.operators.archive import images

    return images(pages)


@ANALYZERS.register("generic")
def generic(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Type, subjects and themes; related documents and places are empty, and there are neither dates nor counts."""
    d = documents.select("doc_id", analysis.generic_type(F.col("text")).alias("document_type"))
    j = d.join(analysis.subjects(chunks), "doc_id", "left").join(analysis.themes(chunks), "doc_id", "left")
    none = F.array().cast("array<string>")
    return j.select("doc_id", "document_type", F.coalesce("subject", none).alias("subject"), F.coalesce("key_themes", none).alias("key_themes"), none.alias("related_documents"), F.lit("").alias("geographic_focus"))


@ANALYZERS.register("church", "catholic")
def church(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Type, subjects, places, related documents and dates from the text; themes and counts from the chunks."""
    t = F.col("text")
    d = documents.select(
        "doc_id",
        analysis.first_match(t, analysis.CHURCH_TYPES).alias("document_type"),
        analysis.all_matches(t, analysis.CHURCH_SUBJECTS).alias("subject"),
        analysis.mentioned(t).alias("related_documents"),
        analysis.first_match(t, analysis.CHURCH_PLACES).alias("geographic_focus"),
        analysis.promulgation_date(t, refs.dates(t)).alias("date_promulgated"),
    )
    counts = analysis.counts(chunks).select("doc_id", "word_count", "pages")
    none = F.array().cast("array<string>")
    j = d.join(analysis.long_headings(chunks), "doc_id", "left").join(counts, "doc_id", "left")
    about = F.lit("approximately ")
    return j.withColumns({"key_themes": F.coalesce("key_themes", none), "word_count": F.coalesce("word_count", F.concat(about, F.lit("0"))), "pages": F.coalesce("pages", F.concat(about, F.lit("1")))})
