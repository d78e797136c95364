"""Exact token counts by a tokenizer's file; the estimate from words where none can be loaded."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptora.functions import text

LOG = logging.getLogger(__name__)


def estimate(s: str | None) -> int:
    return int(len((s or "").split()) * 1.5)


@functools.lru_cache(maxsize=4)
def load_counter(path: str, pattern: str | None = None) -> Callable[[str], int]:
    """A function that counts the tokens of a string. path: a .json of the tokenizers library (special tokens counted), a
    .model of sentencepiece, or ranks as .tiktoken, which need the pattern that splits texts. Each process loads it once."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda s: len(t.encode(s, add_special_tokens=True).ids)
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda s: len(p.encode(s, num_threads=1))
    if path.endswith(".tiktoken") and pattern:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda s: len(e.encode_ordinary(s))
    raise ValueError(f"no tokenizer can be made of {path!r}")


def load_counter_safe(path: str | None, pattern: str | None = None) -> Callable[[str], int] | None:
    """load_counter(), or None with a warning where the file or its library isn't there or can't be read."""
    if path is None:
        return None
    try:
        return load_counter(path, pattern)
    except Exception as e:  # noqa: BLE001 - tokenizer libraries raise their own kinds
        LOG.warning("no tokenizer from %s (%s): tokens are estimated from words", path, e)
        return None


def counter(path: str | None, pattern: str | None = None) -> Callable[[str], int]:
    """Counts tokens of a string, which are 0 for a blank one; by the tokenizer, or the estimate without one."""
    count = load_counter_safe(path, pattern)
    return estimate if count is None else lambda s: count(s) if s and s.strip() else 0


def count_tokens(c: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of a column in Arrow batches; without a tokenizer the estimate, which needs no Python."""
    if path is None:
        return text.estimate_tokens(text.word_count(c))

    @F.arrow_udf("int")
    def count(a: pa.Array) -> pa.Array:
        one = counter(path, pattern)
        # a text at a time: a batch never lies there as strings
        return pa.array((one(x.as_py() or "") for x in a), pa.int32(), size=len(a))

    return count(c)
