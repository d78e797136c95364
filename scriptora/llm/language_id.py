"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased text, hashed to FEATURES cells; a cell's value is its count
times its inverse document frequency, divided by the sum of these over the text. Document frequencies come from every
training row. The regression is fitted by follow-the-regularised-leader with elastic-net penalties on a sample of
SAMPLE different training texts, the same number for each language, and calibrated by a temperature on a part held
back. Every language is learned, from at least LEAST_EACH texts where it has them: only the sample is bounded, by
SAMPLE or, for more languages, LEAST_EACH for each. The model is dense: FEATURES weights for each language.

A text that is null or has no letter is ``und`` with score 0, as is every text where no training row exists. Of equal
probabilities the first language by name holds; ties of the sampling hash go by text. Repeated rows each give a row, with
the same answer, and are learned from once. Empty tables give no rows. Only the named columns are read, and other columns
may have any names. Texts are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import id_and_text, written
from scriptora.llm.ftrl import Ftrl, softmax, temperature

FEATURES, ORDERS, SAMPLE, LEAST_EACH, SCALE, EPOCHS = 1 << 16, 3, 4000, 4, 30.0, 3
PIECE = 1 << 18


def cells(text: str):
    """The hashed n-grams of text, in pieces that bound memory; n-grams that span pieces are counted once."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    for a in range(0, max(1, len(cp)), PIECE):
        part = cp[a : a + PIECE + ORDERS - 1]
        own = min(PIECE, len(cp) - a)
        h, out = np.zeros(own, dtype=np.uint64), []
        for n in range(ORDERS):
            x = part[n : n + own]
            h = (h[: len(x)] * np.uint64(0x9E3779B97F4A7C15)) ^ (x + np.uint64(n + 1))
            out.append(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64))
        yield np.concatenate(out)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def document_frequency(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts and, for each cell, of texts that have it."""

    def run(batches):
        total, seen, n = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=bool), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[:] = False
                for c in cells(t):
                    seen[c] = True
                total += seen
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["cell", "n"])

    rows = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES)
    known = rows[rows.cell >= 0]
    df[known.cell.to_numpy()] = known.n.to_numpy()
    return int(rows[rows.cell < 0].n.sum()), df


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict | None:
    """rows: text, lang (training rows only). The model, or None where there are no rows."""
    h = F.xxhash64("text")
    # different texts, by their hash: copies don't lessen a language's share of the others
    sizes = written(rows.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("texts")), "languages")
    names = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not names:
        return None
    n, df = document_frequency(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = max(LEAST_EACH, sample // len(names))
    picked = (
        rows.join(F.broadcast(sizes), "lang")  # a row for each language, which the model has too
        .where((F.pmod(h, F.lit(1 << 20)) / (1 << 20)) < 3 * each / F.col("texts"))
        .select("text", "lang")
        .distinct()  # copies share their hash: a hot text would else come whole into one window
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(h, "text")))
        .where(F.col("r") <= each)
    )

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                tf = np.zeros(FEATURES, dtype=np.int64)
                for c in cells(t):
                    tf += np.bincount(c, minlength=FEATURES)
                at = np.flatnonzero(tf)
                out.append((at.astype(np.int32).tobytes(), tf[at].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                names=["lang", "r", "at", "tf"],
            )

    data = picked.select("text", "lang", "r").mapInArrow(run, "lang string, r int, at binary, tf binary").toPandas()
    data = data.sort_values(["r", "lang"], ignore_index=True)
    y = data.lang.map({k: i for i, k in enumerate(names)}).to_numpy()
    x = []
    for at, tf in zip(data["at"], data["tf"]):
        at = np.frombuffer(at, dtype=np.int32)
        v = np.frombuffer(tf, dtype=np.float32) * idf[at]
        # 32 bits each: the sample is the largest thing that the driver holds
        x.append((np.append(at, np.int32(FEATURES)), np.append(SCALE * v / max(v.sum(), 1e-9), 1.0).astype(np.float32)))
    held = (data.r % 5 == 0).to_numpy()
    del data
    model = Ftrl(len(names), FEATURES, l1=0.02, l2=0.1)
    for _ in range(EPOCHS):
        for k in np.flatnonzero(~held):
            p = softmax(model.scores(*x[k]))
            p[y[k]] -= 1
            model.step(*x[k], p)
    back = np.flatnonzero(held)
    scores = np.array([model.scores(*x[k]) for k in back]).reshape(len(back), len(names))
    w = model.weights()
    return {
        "names": names,
        "table": np.concatenate([(w[:, :-1] * idf * SCALE).T, idf[:, None]], axis=1).astype(np.float32),
        "bias": w[:, -1],
        "temperature": temperature(scores, y[back]),
    }


def classify(text: str, m: dict | None) -> tuple[str, float]:
    """The language and its calibrated probability."""
    if m is None or not has_letter(text):
        return "und", 0.0
    s = np.zeros(m["table"].shape[1])
    for c in cells(text):
        for a in range(0, len(c), 1 << 16):
            s += m["table"][c[a : a + (1 << 16)]].sum(0, dtype=np.float64)
    p = softmax((s[:-1] / s[-1] + m["bias"]) / m["temperature"])
    k = int(np.argmax(p))
    return m["names"][k], float(p[k])


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x (languages + 1) floats

    def run(batches):
        for b in batches:
            out = [classify(t.as_py(), shared.value) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: dict | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with at least that score, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = [classify(t.as_py() or "", shared.value) for t in b.column(at)]
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, keep: Column, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    return docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
