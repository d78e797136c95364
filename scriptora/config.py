"""Settings in layers, errors, and a thin façade that keeps the order of steps."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

DEFAULTS: dict[str, Any] = dict(analyzer="generic", chunking_strategy="rag", filter_noise=True, keep_small=True, levels=5, max_chunk_words=500, min_chunk_words=100)


#: The strategies that merge by words.
BY_WORDS = ("embeddings", "rag", "semantic")


class ScriptoraError(Exception):
    """The base of all errors raised here."""


class ConfigError(ScriptoraError, ValueError):
    pass


class OrderError(ScriptoraError, RuntimeError):
    """A step was asked for before those that it needs."""


def _toml(path: Path, *keys: str) -> dict[str, Any]:
    """A table of a TOML file; {} where the file or table isn't there or can't be read."""
    try:
        found: Any = tomllib.loads(path.read_text())
        for k in keys:
            found = found[k]
        return dict(found)
    except (OSError, KeyError, TypeError, ValueError):
        return {}


def load(given: Mapping[str, Any] | None = None, folder: Path | str = ".", home: Path | str | None = None) -> dict[str, Any]:
    """Defaults, then the user's file, pyproject, the folder's file and what is given, later ones first. Unknown keys are ignored."""
    folder, out = Path(folder), dict(DEFAULTS)
    user = Path(home) if home else Path.home() / ".config" / "scriptora.toml"
    for layer in (_toml(user), _toml(folder / "pyproject.toml", "tool", "scriptora"), _toml(folder / "scriptora.toml"), given or {}):
        out.update({k: v for k, v in layer.items() if k in DEFAULTS and v is not None})
    return validated(out)


def validated(c: dict[str, Any]) -> dict[str, Any]:
    if not 0 <= c["min_chunk_words"] <= c["max_chunk_words"]:
        raise ConfigError("min_chunk_words has to be from 0 to max_chunk_words")
    if not 1 <= c["levels"] <= 6:
        raise ConfigError("levels has to be from 1 to 6")
    return c


@dataclass
class Extraction:
    """load, parse, chunk, metadata: lazy plans in that order; a step before its time raises OrderError."""

    spark: SparkSession
    config: dict[str, Any] = field(default_factory=lambda: dict(DEFAULTS))
    _steps: dict[str, DataFrame] = field(default_factory=dict)

    def _need(self, step: str) -> DataFrame:
        if step not in self._steps:
            raise OrderError(f"{step} comes first")
        return self._steps[step]

    def load(self, documents: DataFrame) -> Extraction:
        self._steps = {"load": documents}
        return self

    def parse(self) -> Extraction:
        from scriptora.operators.paragraphs import enrich, from_lines, nested
        from scriptora.operators.parsers import markdown_paragraphs

        d = self._need("load")
        markdown = self.config.get("format") == "markdown"
        self._steps["parse"] = enrich(markdown_paragraphs(d) if markdown else from_lines(d))
        if not markdown:
            self._steps["nested"] = nested(d)
        return self

    def chunk(self) -> DataFrame:
        from scriptora.operators.paragraphs import enrich_nested

        p, plain = self._need("parse"), None
        if self._in_rows():
            plain = self._steps["nested"]
            p = enrich_nested(plain)
        self._steps["chunk"] = self._chunks(p)
        # what is counted takes nothing from the fields that chunks inherit, so they aren't found for it
        self._steps["counted"] = self._steps["chunk"] if plain is None else self._chunks(plain)
        return self._steps["chunk"]

    def _in_rows(self) -> bool:
        """Whether documents are merged by words within their rows."""
        return "nested" in self._steps and self.config["chunking_strategy"] in BY_WORDS

    def _chunks(self, p: DataFrame) -> DataFrame:
        from scriptora.functions.noise import low_value
        from scriptora.operators.chunking import ChunkConfig, apply_strategy

        c, name = self.config, self.config["chunking_strategy"]
        cfg = ChunkConfig(c["min_chunk_words"], c["max_chunk_words"], c["levels"], c["keep_small"]) if name in BY_WORDS else None
        out = apply_strategy(name, p, cfg)
        if c["filter_noise"] and "hierarchy" in out.columns:
            out = out.where(~low_value(out["text"], out["word_count"], out["hierarchy"]))
        return out

    def metadata(self) -> DataFrame:
        from scriptora.operators import analysis

        self._need("chunk")
        c, p = self._steps["counted"], self._need("parse")
        return analysis.counts(c).join(analysis.subjects(p), "doc_id", "left").join(analysis.themes(p), "doc_id", "left")
