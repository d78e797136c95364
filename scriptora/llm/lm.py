"""Unbounded n-gram scoring by binary search in sharded arrays of corpus contexts.

The corpus is packed into parts of about PART_TOKENS tokens (whole texts; a local dictionary of 64-bit word hashes and
compressed indexes into it). A shard holds, sorted, every context that falls into its range of hashes; each part sends
a shard its distinct contexts with their counts, once, however often they occur, and the shard answers by binary search
with the counts summed over all parts. What a shard holds is fixed by the number of shards, which follows the corpus.

Contexts have 0, 1, 2, 8, 32, 128, ... tokens, as far as texts go. Those of up to 2 tokens go in the first round. A
longer context can only occur elsewhere if all of its 3-token windows do, so the second round sends long contexts
only along runs of such windows; all others are known to occur just in their own text, if that is learned from. The probability of a token
after the longest matching context is smoothed by those after shorter ones, down to the base model:
p_n = (c(context, token) + ALPHA * p_shorter) / (c(context) + ALPHA). Training texts count their own occurrences.

The method named visits every suffix array with every query, which costs queries times shards: the square of the
corpus. Routing each context by its hash makes one visit of it; the price is that matching lengths beyond 2 go by the
ladder above, to the next lower step, rather than token by token.

op9_lm_scoring uses suffixes.py, which pays no such price and shares the parts and the first round with this module.

A null text counts as empty: it has the end token only. Hashes of contexts have 18 bits more than the corpus needs to
number its tokens, so one query in some 250,000 may count a wrong context; counts of single tokens use all 64 bits.
Repeated rows each give a row; only the id and text are read; texts are used whole; empty tables give no rows.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.llm.common import LOWER_BYTES, written

PART_TOKENS, SHARD_TOKENS, ALPHA, SPARE_BITS = 1_000_000, 2_000_000, 1.0, 18
#: Context lengths beyond 2.
LADDER = tuple(8 * 4**k for k in range(12))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pack(a: np.ndarray) -> bytes:
    """Compressed, with bytes of equal weight side by side."""
    import zstandard

    raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b""
    return struct.pack("<BQ", a.itemsize, len(a)) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(b: bytes) -> np.ndarray:
    import zstandard

    size, n = struct.unpack_from("<BQ", b)
    if not n:
        return np.zeros(0, dtype=f"<u{size}")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:]), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(f"<u{size}")


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(_narrow(np.diff(a, prepend=np.uint64(0))))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b).astype(np.uint64), dtype=np.uint64)


PART_SCHEMA = "part string, tokens long, train_tokens long, longest long, ids binary, lens binary, learn binary, words binary, at binary"


def parts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """The texts as packed parts. ids: pickled list of doc ids; learn: whether each text is learned from."""
    import pickle

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        task, seq = TaskContext.get(), 0
        where = f"{task.partitionId()}"
        ids, lens, flags, index, at, size = [], [], [], {}, [], 0

        def out():
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), dtype=np.uint64, count=len(index))
            n, f = np.array(lens, dtype=np.uint64), np.array(flags, dtype=np.uint8)
            cols = [
                f"{where}.{seq}", int(n.sum()), int(n[f == 1].sum()), int(n.max()), pickle.dumps(ids),
                _pack(_narrow(n)), _pack(f), _pack(words), _pack(_narrow(np.concatenate(at))),
            ]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PART_SCHEMA.split(", ")]
            )

        for b in batches:
            for i, t, f in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                w = t.as_py().encode().translate(LOWER_BYTES).split()
                w.append(b" ")  # the end
                at.append(np.fromiter((index.setdefault(x, len(index)) for x in w), dtype=np.uint64, count=len(w)))
                ids.append(i)
                lens.append(len(w))
                flags.append(int(f))
                size += len(w)
                if size >= part_tokens:
                    yield out()
                    seq += 1
                    ids, lens, flags, index, at, size = [], [], [], {}, [], 0
        if size:
            yield out()

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), learn.alias("learn"))
    return d.mapInArrow(run, PART_SCHEMA)


class Part:
    """A part's tokens as hashes, with the windows that end at each of them."""

    def __init__(self, row):
        lens = _unpack(row["lens"]).astype(np.int64)
        self.words, self.at = _unpack(row["words"]), _unpack(row["at"])
        self.tokens = self.words[self.at]
        self.lens = lens
        self.first = np.repeat(np.cumsum(lens) - lens, lens)  # where each token's text starts
        self.pos = np.arange(len(self.tokens)) - self.first
        self.learn = np.repeat(_unpack(row["learn"]).astype(bool), lens)
        h = (self.tokens ^ (self.tokens >> np.uint64(31))) * _MIX
        power = np.ones(len(h), dtype=np.uint64)
        power[1:] = _MIX
        np.cumprod(power, out=power)
        self._power = power
        # sums of hash * odd**place: a window's difference, divided by odd**(its place), depends on its tokens only
        self._sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * power, dtype=np.uint64)])
        inverse = np.ones(len(h), dtype=np.uint64)
        inverse[1:] = np.uint64(pow(int(_MIX), -1, 1 << 64))
        self._inverse = np.cumprod(inverse, dtype=np.uint64)

    def windows(self, n: int, end: np.ndarray, bits: int) -> np.ndarray:
        """Hashes of the n tokens that end at each place of end."""
        if n == 1:
            return self.tokens[end]
        h = (self._sums[end + 1] - self._sums[end + 1 - n]) * self._inverse[end + 1 - n]
        h = (h ^ (h >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)

    def ends(self, n: int, repeated: np.ndarray | None) -> np.ndarray:
        """Where the windows of n tokens end that have to be asked for: all, or those within runs of ``repeated``."""
        if repeated is None:
            return np.flatnonzero(self.pos >= n - 1)
        return np.flatnonzero((self.pos >= n - 1) & (repeated >= n - 2))

    def ask(self, n: int, end: np.ndarray, bits: int, starts: bool = False):
        """Distinct hashes, how often each is in texts learned from and in others, and each window's place among them.

        starts: the first window of a text learned from counts among the others too.
        """
        if n == 1:
            keys, back = np.unique(self.words, return_inverse=True)
            back = back[self.at[end]]
        else:
            keys, back = np.unique(self.windows(n, end, bits), return_inverse=True)
        count = lambda who: np.bincount(back, weights=who, minlength=len(keys)).astype(np.uint64)
        others = ~self.learn[end] | (self.pos[end] == n - 1) if starts else ~self.learn[end]
        return keys, count(self.learn[end]), count(others), back


def _runs(part: Part, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each place, the length of the run of 3-token windows up to it whose count is asked for or isn't just their own.

    counts, others: of those windows, in texts learned from and in others.
    """
    good = np.where(part.learn, counts + others >= 2, counts >= 1)
    place = np.arange(len(good))
    last_bad = np.maximum.accumulate(np.where(good, -1, place))
    return np.where(good, place - last_bad, 0)


#: counts, others: of contexts in texts learned from, and in other texts (of 3 tokens only).
REQUEST = "shard int, part string, n int, keys binary, counts binary, others binary"
#: numbers: of single tokens, their places in the shard.
ANSWER = "part string, shard int, n int, counts binary, others binary, numbers binary, distinct long"


def _requests(p: Part, name: str, orders, bits: int, shards: int, repeated=None, starts: bool = False):
    out = []
    for n in orders:
        end = p.ends(n, repeated)
        if not len(end):
            continue
        keys, counts, others, _ = p.ask(n, end, bits, starts)
        for s, a, b in _slices(keys, 64 if n == 1 else bits, shards):
            more = _pack(_narrow(others[a:b])) if n == 3 else None
            out.append((s, name, n, _pack_sorted(keys[a:b]), _pack(_narrow(counts[a:b])), more))
    return pd.DataFrame(out, columns=["shard", "part", "n", "keys", "counts", "others"])


def _slices(keys: np.ndarray, bits: int, shards: int):
    cut = [0, *np.searchsorted(keys, np.array([(k << bits) // shards for k in range(1, shards)], dtype=np.uint64)).tolist(), len(keys)]
    return [(s, cut[s], cut[s + 1]) for s in range(shards) if cut[s] < cut[s + 1]]


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard: its contexts of each length sorted, and for each part the total counts of those that it asked for."""
    out = []
    for n, rows in pdf.groupby("n"):
        keys = [_unpack_sorted(k) for k in rows["keys"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        add = lambda c: np.bincount(back, weights=np.concatenate([_unpack(x) for x in c]), minlength=len(every)).astype(np.uint64)
        total, more = add(rows["counts"]), add(rows["others"]) if n == 3 else None
        known = int((total > 0).sum())
        cut = np.cumsum([len(k) for k in keys])[:-1]
        for i, (part, at) in enumerate(zip(rows["part"], np.split(back, cut))):
            others = None if more is None else _pack(_narrow(more[at]))
            numbers = _pack(_narrow(at)) if n == 1 else None
            out.append((part, int(pdf["shard"].iloc[0]), int(n), _pack(_narrow(total[at])), others, numbers, known if i == 0 else 0))
    return pd.DataFrame(out, columns=["part", "shard", "n", "counts", "others", "numbers", "distinct"])


def _answered(p: Part, answers: pd.DataFrame, n: int, bits: int, repeated=None, of: str = "counts") -> np.ndarray:
    """For each place, the training count of the window of n tokens that ends there; its own text's where none was asked."""
    return _answers(p, answers, n, bits, repeated, (of,))[0]


def _answers(p: Part, answers: pd.DataFrame, n: int, bits: int, repeated, columns) -> list[np.ndarray]:
    out = [np.where(p.learn & (p.pos >= n - 1), 1, 0).astype(np.uint64) for _ in columns]
    end = p.ends(n, repeated)
    if len(end):
        back = p.ask(n, end, bits)[-1]
        mine = answers[answers["n"] == n].sort_values("shard")
        for o, of in zip(out, columns):
            o[end] = np.concatenate([_unpack(c).astype(np.uint64) for c in mine[of]])[back]
    return out


def _long_orders(longest: int) -> list[int]:
    """Window lengths of the second round: contexts, and contexts with their token."""
    return [k for n in LADDER if n < longest for k in (n, n + 1)]


def score(
    docs: DataFrame,
    learn: Column,
    alpha: float = ALPHA,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_tokens: int = PART_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10); learn: which rows are learned from."""
    import pickle

    kind = docs.schema[id_col].dataType.simpleString()
    packed = written(parts(docs, learn, id_col, text_col, part_tokens), "lm-parts")
    total, n_train = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    bits = min(63, max(1, math.ceil(math.log2(max(2, total)))) + SPARE_BITS)
    shards = max(1, -(-total // shard_tokens))

    def first(batches):
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pandas(_requests(Part(row), row["part"], (1, 2, 3), bits, shards), schema=request, preserve_index=False)

    request = pa.schema([("shard", pa.int32()), ("part", pa.string()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("others", pa.binary())])
    short = written(packed.mapInArrow(first, REQUEST).groupBy("shard").applyInPandas(_count, ANSWER), "lm-short")

    def second(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        p = Part(row)
        runs = _runs(p, _answered(p, answers, 3, bits), _answered(p, answers, 3, bits, of="others"))
        return _requests(p, row["part"], _long_orders(int(row["longest"])), bits, shards, runs)

    by_part = packed.groupBy("part")
    long = by_part.cogroup(short.where("n = 3").groupBy("part")).applyInPandas(second, REQUEST)
    long = written(long.groupBy("shard").applyInPandas(_count, ANSWER), "lm-long")
    distinct = short.where("n = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    def final(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        p = Part(row)
        c = {n: _answered(p, answers, n, bits) for n in (1, 2, 3)}
        base = (c[1] + 0.1) / (n_train + 0.1 * (distinct + 1))
        prob, runs = base, _runs(p, c[3], _answered(p, answers, 3, bits, of="others"))
        for n in (1, 2, *(x for x in LADDER if x < row["longest"])):
            at = np.flatnonzero(p.pos >= n)  # where a context of n tokens precedes
            if n > 2:
                whole, context = (_answered(p, answers, k, bits, runs) for k in (n + 1, n))
            else:
                whole, context = c[n + 1], c[n]
            prob = prob.copy()
            prob[at] = (whole[at] + alpha * prob[at]) / (context[at - 1] + alpha)
        start = np.cumsum(p.lens) - p.lens
        return pd.DataFrame(
            {
                "doc_id": pickle.loads(row["ids"]),
                "n_tokens": p.lens,
                "n_known": np.add.reduceat((c[1] > 0).astype(np.int64), start),
                "train_tokens": n_train,
                "base_score": np.add.reduceat(np.log10(base), start),
                "score": np.add.reduceat(np.log10(prob), start),
            }
        )

    out = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_part.cogroup(short.unionByName(long).groupBy("part")).applyInPandas(final, out)
