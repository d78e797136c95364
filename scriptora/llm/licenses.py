"""License scans by a generalised suffix automaton of license tokens.

One automaton holds every token sequence of all templates. A text is streamed through it: after each token the state
and length give the longest template passage that ends there (the matching statistic). Maximal matches of at least
MIN_MATCH tokens are chained, per template, in growing template order into covered spans; a template whose covered
share reaches the threshold gives its label. A token that no template has resets the automaton, so runs of known
tokens shorter than MIN_MATCH are skipped without changing any result.

Null and empty texts have no words and no labels. Repeated rows each give a row, with the same answer; empty tables give
no rows; only id and text are read, and other columns may have any names; a text of any length is scanned whole. Of
chains that cover the same number of tokens the first found holds; every template that reaches the threshold is named.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptora.llm.common import WORD_BYTES, id_and_text

MIN_MATCH, COVERED, MAX_SKIP = 4, 0.6, 40
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: label, text of well-known notices.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mit", "Released under the MIT License."),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
)


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII, as bytes."""
    return text.encode().translate(WORD_BYTES).split()


class Automaton:
    """A generalised suffix automaton; each state knows one end position in each template that has its passages."""

    def __init__(self, templates: list[list[int]]):
        self.next, self.link, self.len, self.ends = [{}], [-1], [0], [{}]
        for k, tokens in enumerate(templates):
            last = 0
            for i, t in enumerate(tokens):
                last = self._extend(last, t)
                self.ends[last].setdefault(k, i)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            for k, i in self.ends[s].items():
                self.ends[self.link[s]].setdefault(k, i)

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.ends.append({})
        return len(self.len) - 1

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            q = self.next[last][t]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, t, q)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p != -1 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][t]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, t, q)
        return cur

    def _split(self, p: int, t: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def matches(self, tokens: list[int], least: int):
        """(end, length, state) of each maximal match of at least ``least`` tokens: those that the next token doesn't extend."""
        s = size = 0
        for i, t in enumerate(tokens):
            before, was = s, size
            while s and t not in self.next[s]:
                s = self.link[s]
                size = self.len[s]
            if t in self.next[s]:
                s, size = self.next[s][t], size + 1
            else:
                s = size = 0
            if was >= least and size <= was:
                yield i, was, before
        if size >= least:
            yield len(tokens), size, s


def chain(found: list[tuple[int, int, int]], max_skip: int = MAX_SKIP) -> tuple[int, int, int]:
    """found: (start, end, template end), by end. The chain that covers the most template tokens: (covered, start, end)."""
    best = (0, 0, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    for start, end, at in found:
        cover, first, low = end - start, start, at - (end - start)
        for _, e, a, c, f in reversed(rows):
            if start - e > max_skip:
                break
            if a <= at:
                gain = c + min(at - max(a, low), end - max(e, start))
                if gain > cover:
                    cover, first = gain, f
        rows.append((start, end, at, cover, first))
        best = max(best, (cover, first, end))
    return best


@lru_cache(maxsize=2)
def scanner(templates=TEMPLATES, base=BASE):
    """Vocabulary, automaton, templates' lengths, and the base phrases as ids."""
    split = [words(t) for _, t in templates]
    vocabulary: dict[bytes, int] = {}
    for x in [*split, *[words(p) for p, _ in base]]:
        for w in x:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    ids = [[vocabulary[w] for w in x] for x in split]
    return vocabulary, Automaton(ids), [len(x) for x in ids], [([vocabulary[w] for w in words(p)], label) for p, label in base]


def scan_text(text: str, templates=TEMPLATES, base=BASE, covered: float = COVERED):
    """n_words, places (start, label) of base phrases, spans (label, start, end, share) of covered templates, best share."""
    vocabulary, automaton, sizes, phrases = scanner(templates, base)
    w = words(text)
    get = vocabulary.get
    ids = np.array([get(x, 0) for x in w], dtype=np.int32)
    places: list[tuple[int, str]] = []
    for p, label in phrases:
        if len(ids) >= len(p):
            n = len(ids) - len(p) + 1
            hit = ids[:n] == p[0]
            for k in range(1, len(p)):
                if not hit.any():
                    break
                hit = hit & (ids[k : k + n] == p[k])
            places += [(int(i), label) for i in np.flatnonzero(hit)]
    found: dict[int, list] = {}
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= MIN_MATCH:
            for end, size, state in automaton.matches(ids[a:b].tolist(), MIN_MATCH):
                for k, at in automaton.ends[state].items():
                    found.setdefault(k, []).append((a + end - size, a + end, at + 1))
    spans, best = [], 0.0
    for k, f in found.items():
        cover, start, end = chain(f)
        share = min(1.0, cover / sizes[k])
        best = max(best, share)
        if share >= covered:
            spans.append((templates[k][0], start, end, share))
    return len(w), places, spans, best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (start, label), spans (label, start, end, share), score."""
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        for b in batches:
            out = [scan_text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([[{"start": s, "label": y} for s, y in x[1]] for x in out], place),
                    pa.array([[dict(zip(("label", "start", "end", "share"), y)) for y in x[2]] for x in out], span),
                    pa.array([x[3] for x in out], pa.float64()),
                ],
                names=["doc_id", "n_words", "places", "spans", "score"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run,
        f"doc_id {kind}, n_words long, places array<struct<start:long,label:string>>, "
        "spans array<struct<label:string,start:long,end:long,share:double>>, score double",
    )
