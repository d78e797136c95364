"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its leaves are short, each leaf is encoded alone, and neighbours are joined by re-encoding a
window around their boundary. The window grows until it reaches, on either side, a place where the split pattern
always starts a new match: a space, tab or line end after a character that isn't white space. No match spans such
a place and none that ends before it looks past it, so the tokens outside of the window are those of the whole text.
Where a side has no such place, the window takes in the whole side. Decoding concatenates up the same tree.

A null text counts as empty (no tokens); empty tables give empty results; repeated rows each give a row; only the id
and text columns are read, so other columns can't clash; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptora.llm.common import id_and_text

#: Short enough that most texts are encoded by joins of several leaves.
LEAF_CHARS = 1 << 9
WINDOW_CHARS = 64
_CUT = re.compile(r"(?<=\S)[ \t\r\n]")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut_left(text: str) -> int:
    """The last stable place of text, found in a growing window at its end; 0 if there is none."""
    w = WINDOW_CHARS
    while True:
        at = max(0, len(text) - w)
        last = -1
        for m in _CUT.finditer(text, at):
            last = m.start()
        if last >= 0 or at == 0:
            return max(last, 0)
        w *= 2


def _cut_right(text: str) -> int:
    """The first stable place of text, found in a growing window at its start; its length if there is none."""
    w = WINDOW_CHARS
    while True:
        m = _CUT.search(text, 0, w)
        if m or w >= len(text):
            return m.start() if m else len(text)
        w *= 2


def encode_text(enc, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """The ids of text, as enc.encode_ordinary gives them."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    mid = len(text) // 2
    left, right = text[:mid], text[mid:]
    return _join(enc, left, encode_text(enc, left, leaf), right, encode_text(enc, right, leaf))


def _join(enc, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    p, q = _cut_left(left), _cut_right(right)
    a, need = len(left_ids), len(left[p:].encode())
    while need > 0:
        a -= 1
        need -= len(enc.decode_single_token_bytes(left_ids[a]))
    b, need = 0, len(right[:q].encode())
    while need > 0:
        need -= len(enc.decode_single_token_bytes(right_ids[b]))
        b += 1
    return left_ids[:a] + enc.encode_ordinary(left[p:] + right[:q]) + right_ids[b:]


def decode_ids(enc, ids: list[int], leaf: int = LEAF_CHARS) -> bytes:
    """The bytes of ids, concatenated up a tree of halves."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode_ids(enc, ids[:mid], leaf) + decode_ids(enc, ids[mid:], leaf)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and token_ids: the ids packed as little-endian unsigned 32-bit integers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            # packed text by text: a batch's ids as Python integers would take ten times the memory
            ids = [np.array(encode_text(enc, t.as_py()), dtype="<u4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "token_ids"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of encode() with decoded: the bytes of token_ids."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            out = [decode_ids(enc, np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())],
                names=["doc_id", "n_tokens", "token_ids", "decoded"],
            )

    return encoded.select("doc_id", "n_tokens", "token_ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, token_ids binary, decoded binary"
    )
