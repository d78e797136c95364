"""Unbounded n-gram scoring by the longest matching context, found in suffix arrays that are sharded by first tokens.

Texts are packed into parts (lm.parts). A first round counts windows of 1 to 3 tokens. A suffix (the tokens from some place
to its text's end) is searched for if it is of a text that isn't learned from, or is a whole text learned from; it is
held in the arrays if it is of a text learned from. Only suffixes whose first 3 tokens occur on both sides go on. They go
to the shard of these tokens, so that each search visits one shard and each shard holds every suffix that it may ask for.

A shard sorts its suffixes token by token and narrows the interval of each search alike, as long as both sides are left in
it: what a full suffix array and binary search give. Tokens are compared one by one, by their numbers. A suffix brings
STEP tokens along in the first round; those that still match go on with the rest of their text, which is sent once a part
and shard. A match that the token before extends on both sides is part of a longer one and doesn't go on.

Matches reach from a start as far as possible; so the longest context of a token starts at the first place whose match
reaches it. Contexts of 0, 1 and 2 tokens smooth one another, as in lm, down to the base model. Where the longest context
has more, its counts c come on top: (c(context, token) + ALPHA * p_shorter) / (c(context) + ALPHA). Texts learned from
count their own occurrences, so their longest context is always all that precedes.

A null text counts as empty: it has the end token only. Words are told apart by 64 bits of hash, and so are the windows of
2 and 3 tokens where those are counted. Repeated rows each give a row; only the id and text are read; texts are used whole;
empty tables give no rows. The order of suffixes is of no consequence: only counts are taken from it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.llm.common import written
from scriptora.llm.lm import (
    ALPHA, ANSWER, PART_TOKENS, REQUEST, SHARD_TOKENS, Part, _answered, _answers, _count, _narrow, _pack, _requests, _unpack, parts,
)

#: Tokens that a suffix brings along at first; tokens compared at once after that.
STEP, BLOCK, BITS = 8, 64, 64
_HELD, _SEARCHED = 1, 2
#: In ANSWER: counts of searches from some length on (numbers: start, others: length), and suffixes that go on (counts: group, others: kind).
_FOUND, _ON = -1, -2

#: at: place in the part; kind: held, searched; before: the token before; rest: tokens left; tokens: of all, from place "from" each.
SUFFIXES = "shard int, part string, at binary, kind binary, before binary, rest binary, group binary, tokens binary, place binary"
_COLUMNS = [c.split()[0] for c in SUFFIXES.split(", ")]


def _numbers(p: Part, answers: pd.DataFrame, shards: int) -> np.ndarray:
    """The number of each token, from 1 on, which is the same in all parts."""
    mine = answers[answers["n"] == 1].sort_values("shard")
    words = np.concatenate([_unpack(x).astype(np.uint64) * np.uint64(shards) + np.uint64(s + 1) for x, s in zip(mine["numbers"], mine["shard"])])
    return _narrow(words[np.unique(p.words, return_inverse=True)[1]])[p.at]


def _before(p: Part, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(p.pos[at] == 0, 0, numbers[at - 1])


def _first(p: Part, name: str, answers: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The suffixes whose first 3 tokens occur on both sides, with STEP tokens."""
    end = np.flatnonzero(p.pos >= 2)
    held, searched = (c[end] for c in _answers(p, answers, 3, BITS, None, ("counts", "others")))
    learn, start = p.learn[end], p.pos[end] == 2
    kind = np.where(
        learn,
        np.where(start, np.where((held >= 2) | (searched >= 2), _HELD | _SEARCHED, 0), np.where(searched >= 1, _HELD, 0)),
        np.where(held >= 1, _SEARCHED, 0),
    )
    live = kind > 0
    end, kind = end[live], kind[live]
    at = end - 2
    shard = _shard_of(p.windows(3, end, BITS), shards)
    numbers = _numbers(p, answers, shards)
    order = np.lexsort((numbers[at + 2], numbers[at + 1], numbers[at], shard))
    at, kind, shard = at[order], kind[order], shard[order]
    rest = p.first[at] + np.repeat(p.lens, p.lens)[at] - at
    column = [np.where(rest > k, numbers[np.minimum(at + k, len(numbers) - 1)], 0) for k in range(STEP)]
    cut = np.searchsorted(shard, np.arange(shards + 1))
    before, out = _before(p, numbers, at), []
    for s in np.flatnonzero(np.diff(cut)):
        i = slice(cut[s], cut[s + 1])
        lay = [_pack(_narrow(x)) for x in (at[i], kind[i], before[i], rest[i])]
        out.append((int(s), name, *lay, None, _pack(_narrow(np.concatenate([c[i] for c in column]))), None))
    return pd.DataFrame(out, columns=_COLUMNS)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _rest(p: Part, name: str, answers: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The suffixes that go on, with the rest of their texts: once a shard, however many of them share it."""
    on = answers[answers["n"] == _ON]
    if not len(on):
        return pd.DataFrame([], columns=_COLUMNS)
    at, kind, group = (np.concatenate([_unpack(x).astype(np.int64) for x in on[c]]) for c in ("numbers", "others", "counts"))
    numbers = _numbers(p, answers, shards)
    shard = group % shards
    order = np.lexsort((at, shard))
    at, kind, group, shard = at[order], kind[order], group[order], shard[order]
    a, b = at + STEP, p.first[at] + np.repeat(p.lens, p.lens)[at]
    cut = np.searchsorted(shard, np.arange(shards + 1))
    before, out = _before(p, numbers, at), []
    for s in np.flatnonzero(np.diff(cut)):
        i = slice(cut[s], cut[s + 1])
        # texts don't overlap, so a text is sent from its first place that is needed
        texts, head = np.unique(b[i], return_index=True)
        size = texts - a[i][head]
        skip = np.cumsum(size) - size
        text = np.searchsorted(texts, b[i])
        place = a[i] - a[i][head][text] + skip[text]
        tokens = numbers[np.repeat(a[i][head] - skip, size) + np.arange(size.sum())]
        lay = [_pack(_narrow(x)) for x in (at[i], kind[i], before[i], b[i] - a[i], group[i], tokens, place)]
        out.append((int(s), name, *lay))
    return pd.DataFrame(out, columns=_COLUMNS)


class _Search:
    """The suffixes of a shard in the order of their tokens, searches first among equals; sets of equals are groups."""

    def __init__(self, pdf: pd.DataFrame, first: bool):
        column = {c: [_unpack(x) for x in pdf[c]] for c in ("at", "kind", "before", "rest", "tokens")}
        self.owner = np.repeat(np.arange(len(pdf)), [len(x) for x in column["at"]])
        whole = lambda c, kind=np.int64: np.concatenate([x.astype(kind) for x in column[c]])
        self.at, self.before, self.rest, kind = whole("at"), whole("before"), whole("rest"), whole("kind", np.uint8)
        self.held, self.searched = (kind & _HELD) > 0, (kind & _SEARCHED) > 0
        number = np.uint64 if any(x.itemsize > 4 for x in column["tokens"]) else np.uint32
        self.kind, self.done = kind, 0 if first else STEP
        if first:
            self.tokens = np.concatenate([x.reshape(STEP, -1).T.reshape(-1).astype(number) for x in column["tokens"]])
            self.place = np.arange(len(self.at)) * STEP
            self.room = np.minimum(self.rest, STEP)
        else:
            skip = np.cumsum([0] + [len(x) for x in column["tokens"]])[:-1]
            self.tokens = np.concatenate([*(x.astype(number) for x in column["tokens"]), np.zeros(BLOCK, number)])
            self.place = np.concatenate([_unpack(x).astype(np.int64) + s for x, s in zip(pdf["place"], skip)])
            self.room = self.rest
        self.depth = np.zeros(len(self.at), dtype=np.int64)
        self.last = np.full(len(self.at), -1, dtype=np.int64)
        self.found: list[tuple] = []
        self.on: list[tuple] = []

    def _emit(self, rows, lengths, counts):
        self.found.append((rows, lengths + self.done, np.broadcast_to(counts, rows.shape)))

    def _split(self, idx: np.ndarray, *keys: np.ndarray):
        """Order rows by keys, count each new group, tell its searches and leave out groups that have no more to tell."""
        order = np.lexsort((~self.searched[idx], *reversed(keys)))
        idx = idx[order]
        new = np.ones(len(idx), dtype=bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        return self._keep(idx, np.flatnonzero(new))

    def _keep(self, idx: np.ndarray, heads: np.ndarray, told: bool = True):
        if not len(idx):
            return idx, heads
        size = np.diff(np.append(heads, len(idx)))
        held = np.add.reduceat(self.held[idx].astype(np.int64), heads)
        searched = np.add.reduceat(self.searched[idx].astype(np.int64), heads)
        count = np.repeat(held, size)
        if told:
            say = self.searched[idx] & (self.last[idx] != count)
            self._emit(idx[say], self.depth[idx[say]], count[say])
        self.last[idx] = count
        good = (held > 0) & (searched > 0) & (size > 1)
        idx = idx[np.repeat(good, size)]
        size = size[good]
        return idx, np.cumsum(size) - size

    def _leap(self, idx: np.ndarray, heads: np.ndarray):
        """As far as the searches of a group agree, up to BLOCK tokens; held suffixes that differ before are counted off."""
        size = np.diff(np.append(heads, len(idx)))
        group = np.repeat(np.arange(len(heads)), size)
        same, ahead = np.empty(len(idx), dtype=np.int64), np.lib.stride_tricks.sliding_window_view(self.tokens, BLOCK)
        for k in range(0, len(idx), 1 << 14):
            rows, lead = idx[k : k + (1 << 14)], idx[heads[group[k : k + (1 << 14)]]]
            differ = ahead[self.place[rows] + self.depth[rows]] != ahead[self.place[lead] + self.depth[lead]]
            same[k : k + (1 << 14)] = np.where(differ.any(axis=1), differ.argmax(axis=1), BLOCK)
        # what lies behind a text's end is no part of it
        same = np.minimum(same, self.room[idx] - self.depth[idx])
        step = np.minimum.reduceat(np.where(self.searched[idx], same, BLOCK), heads)
        off = np.flatnonzero(same < step[group])
        if len(off):
            off = off[np.lexsort((same[off], group[off]))]
            g, f = group[off], same[off]
            final = np.append((g[1:] != g[:-1]) | (f[1:] != f[:-1]), True)
            rank = np.arange(len(off)) - np.searchsorted(g, g) + 1
            g, f, gone = g[final], f[final], rank[final]
            n_searched = np.add.reduceat(self.searched[idx].astype(np.int64), heads)
            times = n_searched[g]
            row = idx[np.repeat(heads[g], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            self._emit(row, self.depth[row] + np.repeat(f, times) + 1, self.last[row] - np.repeat(gone, times))
        self.depth[idx] += step[group]
        stay = same >= step[group]
        idx, group = idx[stay], group[stay]
        return self._keep(idx, np.flatnonzero(np.diff(group, prepend=-1)), told=False)

    def _leave(self, idx: np.ndarray, heads: np.ndarray):
        """Take out the groups that have come to the end of their tokens."""
        size = np.diff(np.append(heads, len(idx)))
        out = self.depth[idx] >= self.room[idx]
        if out.any():
            row = idx[out]
            ended = row[(self.room[row] == self.rest[row]) & self.searched[row]]
            self._emit(ended, self.rest[ended] + 1, np.int64(0))
            group = np.repeat(np.arange(len(heads)), size)[out]
            on = self.room[row] < self.rest[row]
            self._go_on(row[on], group[on])
            size = size[~out[heads]]
            idx = idx[~out]
        return idx, np.cumsum(size) - size

    def _go_on(self, idx: np.ndarray, group: np.ndarray):
        """Leave out what the token before extends on both sides: it belongs to a match that starts earlier."""
        if not len(idx):
            return
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(heads, len(idx)))
        before = self.before[idx]

        def differs(side):
            low = np.minimum.reduceat(np.where(side, before, np.iinfo(np.int64).max), heads)
            high = np.maximum.reduceat(np.where(side, before, -1), heads)
            return (np.repeat(low, size) != before) | (np.repeat(high, size) != before)

        start = before == 0  # of a text
        any_start = np.repeat(np.logical_or.reduceat(start & self.searched[idx], heads), size)
        need = (self.searched[idx] & (start | differs(self.held[idx]))) | (self.held[idx] & (any_start | differs(self.searched[idx])))
        self.on.append((idx[need], group[need] + sum(int(g[-1]) + 1 for _, g in self.on if len(g))))

    def run(self, groups: np.ndarray | None):
        every = np.arange(len(self.at))
        if groups is None:
            self.depth[:] = 3
            idx, heads = self._split(every, *(self.tokens[self.place + k] for k in range(3)))
        else:
            # told again, since those that don't go on are counted off
            idx, heads = self._split(every, groups)
        while len(idx):
            if groups is not None:
                idx, heads = self._leap(idx, heads)
            idx, heads = self._leave(idx, heads)
            if len(idx):
                group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(idx))))
                token = self.tokens[self.place[idx] + self.depth[idx]]
                self.depth[idx] += 1
                idx, heads = self._split(idx, group, token)


def _search(pdf: pd.DataFrame, first: bool, shards: int) -> pd.DataFrame:
    """A shard: the counts of its searches, at each length where they change, and the suffixes that go on."""
    names, shard = pdf["part"].tolist(), int(pdf["shard"].iloc[0])
    s = _Search(pdf, first)
    s.run(None if first else np.concatenate([_unpack(x).astype(np.int64) for x in pdf["group"]]))
    out = []

    def to_parts(n, row, counts, others):
        order = np.lexsort((others, s.at[row], s.owner[row])) if n == _FOUND else np.argsort(s.owner[row], kind="stable")
        row, counts, others = row[order], counts[order], others[order]
        cut = np.searchsorted(s.owner[row], np.arange(len(names) + 1))
        for k in np.flatnonzero(np.diff(cut)):
            i = slice(cut[k], cut[k + 1])
            out.append((names[k], shard, n, *(_pack(_narrow(x)) for x in (counts[i], others[i], s.at[row[i]])), 0))

    if s.found:
        row, length, count = (np.concatenate([f[k] for f in s.found]) for k in range(3))
        to_parts(_FOUND, row, count, length)
    if s.on:
        row, group = (np.concatenate([f[k] for f in s.on]) for k in range(2))
        to_parts(_ON, row, group * shards + (shard + group) % shards, s.kind[row])
    return pd.DataFrame(out, columns=["part", "shard", "n", "counts", "others", "numbers", "distinct"])


def smooth(p: Part, answers: pd.DataFrame, prob: np.ndarray, alpha: float) -> None:
    """Put the counts of each token's longest context, alone and with the token, on top, if it has more than 2 tokens."""
    found = answers[answers["n"] == _FOUND]
    take = lambda c: np.concatenate([np.zeros(0, np.int64), *(_unpack(x).astype(np.int64) for x in found[c])])
    at, length, count = take("numbers"), take("others"), take("counts")
    order = np.lexsort((-count, length, at))
    at, length, count = at[order], length[order], count[order]
    reach = np.arange(len(p.tokens))
    final = np.flatnonzero(np.diff(at, append=-1))
    # counted off to none: the match ends there; else it is at least that long and part of one that starts earlier
    reach[at[final]] += np.where(count[final] == 0, length[final] - 1, length[final])
    np.maximum.accumulate(reach, out=reach)
    known = np.zeros(len(reach), dtype=bool)
    known[at] = True
    # texts learned from: all that precedes, which is there once if it wasn't searched for
    own = p.learn & (p.pos > 2)
    once = np.flatnonzero(own & ~known[p.first])
    prob[once] = (1 + alpha * prob[once]) / (1 + alpha)
    held_out = np.flatnonzero(~p.learn & (p.pos > 2))
    token = np.concatenate([np.flatnonzero(own & known[p.first]), held_out])
    start = np.concatenate([p.first[token[: len(token) - len(held_out)]], np.maximum(p.first[held_out], np.searchsorted(reach, held_out))])
    size = token - start
    del reach, known, own, once, held_out
    token, start, size = (x[size > 2] for x in (token, start, size))
    if len(token):
        key = (at << 32) | length
        ask = (start << 32) | size
        context, whole = (count[np.searchsorted(key, q, side="right") - 1] for q in (ask, ask + 1))
        prob[token] = (whole + alpha * prob[token]) / (context + alpha)


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
    shards = max(1, -(-total // shard_tokens))

    def counted(*orders: int) -> DataFrame:
        def windows(batches):
            for b in batches:
                for row in b.to_pylist():
                    yield pa.RecordBatch.from_pandas(_requests(Part(row), row["part"], orders, BITS, shards, starts=True), schema=request, preserve_index=False)

        return written(packed.mapInArrow(windows, REQUEST).groupBy("shard").applyInPandas(_count, ANSWER), "lm-short")

    request = pa.schema([("shard", pa.int32()), ("part", pa.string()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("others", pa.binary())])
    # one after the other, so that the disk holds the keys of one at a time
    short = counted(1, 2).unionByName(counted(3))
    distinct = short.where("n = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    by_part = packed.groupBy("part")

    def searched(answers: DataFrame, first: bool) -> DataFrame:
        def send(rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
            row = rows.iloc[0]
            return (_first if first else _rest)(Part(row), row["part"], mine, shards)

        sent = by_part.cogroup(answers.groupBy("part")).applyInPandas(send, SUFFIXES)
        return written(sent.groupBy("shard").applyInPandas(lambda pdf: _search(pdf, first, shards), ANSWER), "lm-found")

    near = searched(short.where("n in (1, 3)"), True)
    far = searched(short.where("n = 1").unionByName(near.where(F.col("n") == _ON)), False)

    def final(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        p = Part(row)
        before = _answered(p, answers, 1, BITS)
        known = before > 0
        base = (before + 0.1) / (n_train + 0.1 * (distinct + 1))
        prob = base.copy()
        for n in (1, 2):
            at = np.flatnonzero(p.pos >= n)  # where a context of n tokens precedes
            whole = _answered(p, answers, n + 1, BITS)
            prob[at] = (whole[at] + alpha * prob[at]) / (before[at - 1] + alpha)
            before = whole
        del before, whole, at
        smooth(p, answers, prob, alpha)
        start = np.cumsum(p.lens) - p.lens
        return pd.DataFrame(
            {
                "doc_id": pickle.loads(row["ids"]),
                "n_tokens": p.lens,
                "n_known": np.add.reduceat(known.astype(np.int64), start),
                "train_tokens": n_train,
                "base_score": np.add.reduceat(np.log10(base), start),
                "score": np.add.reduceat(np.log10(prob), start),
            }
        )

    out = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = short.unionByName(near.where(F.col("n") == _FOUND)).unionByName(far)
    return by_part.cogroup(answers.groupBy("part")).applyInPandas(final, out)
