"""Toxicity: a counterfactual-regularised logistic classifier.

Features are the distinct words of a text and their starts of 3 to 6 characters, hashed to FEATURES cells; each counts
once. Where a labelled sentence names a group (IDENTITY), counterfactual texts swap that term for the others of its
set, and the fit penalises the squared change of the score, so weights can't rest on the mention itself. The fit runs
follow-the-regularised-leader with elastic-net penalties over at most SAMPLE labelled rows, at most a third of them
toxic, and of these, in the order of a hash, as many as have CELLS cells together; those bounds are parameters,
everything else covers all rows. Of a counterfactual only the cells in which it differs go to the fit.

Null and empty texts score as the bias alone. Without labelled rows every score is 0. Repeated rows each give a row, with
the same score; only the named columns are read, and other columns may have any names; texts are used whole. Of several
labels of one id the highest counts, of several texts of one id the last in order is learned from. Ties of the sampling
hash go by id. Empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import id_and_text, written
from scriptora.llm.ftrl import Ftrl

BITS, STARTS, SAMPLE, CELLS, EPOCHS, PENALTY = 20, (3, 4, 5, 6), 9000, 40_000_000, 4, 4.0
FEATURES = 1 << BITS
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"), ("immigrants", "locals", "refugees"), ("deaf", "blind", "disabled"),
    ("old", "young"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
_SWAP = {t: [x for x in group if x != t] for group in IDENTITY for t in group}
_TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _SWAP), key=len, reverse=True)) + r")\b")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))


def features(text: str) -> np.ndarray:
    """The distinct cells of text."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    word = (cp >= 128) | ((cp >= 97) & (cp <= 122)) | ((cp >= 48) & (cp <= 57)) | (cp == 39)
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    size = end - start
    h = np.zeros(len(start), dtype=np.uint64)
    out, longest = [], int(size.max())
    k = 0
    live = np.arange(len(start))
    while k < longest:
        live = live[size[live] > k]
        h[live] = (h[live] ^ (cp[start[live] + k] + np.uint64(k + 1))) * _MIX
        h[live] ^= h[live] >> np.uint64(29)
        k += 1
        if k in STARTS:
            out.append(h[live] ^ np.uint64(k))
    out.append(h ^ np.uint64(99))
    return np.unique(((np.concatenate(out) * _POWER[0]) >> np.uint64(64 - BITS)).astype(np.int64))


def counterfactuals(text: str, most: int = 4) -> list[str]:
    """text with the group terms of its sentences swapped for others of their sets, up to ``most`` versions, and last
    with the terms left out: alike scores for all groups would else still allow a high score for any mention."""
    low = text.lower()
    if not _TERM.search(low):
        return []
    swaps = [lambda m, k=k: _SWAP[m[1]][k % len(_SWAP[m[1]])] for k in range(most)]
    new = ["".join(_TERM.sub(swap, s) for s in _SENTENCE.findall(low)) for swap in [*swaps, ""]]
    return list(dict.fromkeys(new))


def differences(at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that only the text has, and those that only its counterfactual has."""
    return np.setdiff1d(at, other), np.setdiff1d(other, at)


def train(examples: list[tuple[np.ndarray, list[np.ndarray], int]], epochs: int = EPOCHS, penalty: float = PENALTY) -> dict:
    """examples: cells, cells of counterfactuals, label. Returns cells with a weight, their weights, and the bias."""
    return fit_differences([(at, [differences(at, o) for o in others], y) for at, others, y in examples], epochs, penalty)


def fit_differences(examples, epochs: int = EPOCHS, penalty: float = PENALTY) -> dict:
    """train() of examples whose counterfactuals are given by the cells in which they differ."""
    model = Ftrl(1, FEATURES, alpha=0.2, l1=1.0, l2=0.5)
    x = lambda a: (np.append(a, FEATURES), np.ones(len(a) + 1))
    for _ in range(epochs):
        for at, others, y in examples:
            p = 1 / (1 + np.exp(-np.clip(model.scores(*x(at))[0], -30, 30)))
            model.step(*x(at), np.array([p - y]))
            for a, b in others:
                # d/ds of penalty * (s(x) - s(x'))^2: on both sides only the cells in which the two differ are left
                cells, sign = np.concatenate([a, b]), np.concatenate([np.ones(len(a)), -np.ones(len(b))])
                gap = model.scores(cells, sign)[0]
                g = np.clip(2 * penalty * gap, -5, 5) / max(1, len(others))
                model.step(cells, sign, np.array([g]))
    w = model.weights()[0]
    at = np.flatnonzero(w[:-1])
    return {"at": at, "w": w[at], "bias": float(w[-1])}


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """labels: doc_id, toxic; keep: which of its rows may be learned from. sample, cells: bounds of what the fit takes in."""
    y = labels.where(keep & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in y.groupBy(F.when(F.col("toxic") == 1, 1).otherwise(0)).count().collect()}
    most = {1: sample // 3, 0: sample - sample // 3}
    h = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.when(F.col("toxic") == 1, min(1.0, 3 * most[1] / max(1, sizes.get(1, 0)))).otherwise(min(1.0, 3 * most[0] / max(1, sizes.get(0, 0))))
    picked = (
        y.where(F.pmod(h, F.lit(1 << 20)) / (1 << 20) < share)
        .withColumn("toxic", F.when(F.col("toxic") == 1, 1).otherwise(0))
        .withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy(h, "doc_id")))
        .where(F.col("r") <= F.when(F.col("toxic") == 1, most[1]).otherwise(most[0]))
    )

    def run(batches):
        pack = lambda a: a.astype(np.int32).tobytes()
        for b in batches:
            rows = []
            for t in b.column(0):
                at = features(t.as_py())
                pairs = [differences(at, features(o)) for o in counterfactuals(t.as_py())]
                # an even number of arrays: what goes, then what comes
                rows.append((pack(at), [pack(d) for p in pairs for d in p], len(at) + sum(len(d) for p in pairs for d in p)))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.list_(pa.binary())), pa.array([x[2] for x in rows], pa.int64())],
                names=["toxic", "h", "at", "others", "size"],
            )

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = (
        d.join(F.broadcast(picked), "doc_id")  # at most ``sample`` rows
        .groupBy("doc_id", "toxic")
        .agg(F.max("text").alias("text"))  # one text for each id, however often it is repeated
        .select("text", "toxic", F.xxhash64("doc_id", "text").alias("h"))
        .mapInArrow(run, "toxic int, h long, at binary, others array<binary>, size long")
    )
    # at most ``sample`` rows, of which the driver takes the first that fit its bound; only their sizes are summed up
    found = written(found, "toxicity-examples")
    fit_so_far = found.select("h", F.sum("size").over(Window.orderBy("h")).alias("so_far")).where(F.col("so_far") <= cells)
    last = fit_so_far.agg(F.max("h")).first()[0]
    got = found.where(F.col("h") <= F.lit(last)).drop("size").toPandas().sort_values(["h"], ignore_index=True)
    if not len(got):
        return None
    unpack = lambda a: np.frombuffer(a, dtype=np.int32).astype(np.int64)
    paired = lambda x: list(zip(x[::2], x[1::2]))
    return fit_differences([(unpack(a), paired([unpack(o) for o in os]), int(t)) for t, a, os in zip(got.toxic, got["at"], got.others)])


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches):
        m = shared.value
        w = np.zeros(FEATURES, dtype=np.float64)
        if m is not None:
            w[m["at"]] = m["w"]
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                s = w[features(t)].sum() + (m["bias"] if m is not None else -np.inf)
                out.append(float(1 / (1 + np.exp(-np.clip(s, -700, 700)))) if m is not None else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
