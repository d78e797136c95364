"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 values of a text's 3-word shingles. Equal fingerprints
collapse first, so a group of copies costs one row. Two fingerprints that differ in at most 3 bits agree on at least
2 of 5 bit blocks; each is therefore looked up in 10 tables, one for each pair of blocks, and no link is lost. Within
a bucket the fingerprints are stored as 64 vertical bit planes: one XOR updates the distances of 64 fingerprints, a
carry-save counter adds them up, and words of 64 are abandoned once all exceed the radius. Buckets beyond TILE
fingerprints are cut into tiles that meet in pairs, each its own unit of work. A tile returns one row for each linked
fingerprint, never its pairs: how many documents it links to (counted only in the first table where the two meet) and
a representative of its local component. Components join by alternating large and small stars. The tiles go over as
many tasks as their counted comparisons need, a tile being at most TILE squared.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are separate documents. Null
ids are ignored for component_id. Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import SPACES, ascii_lower, discard, unused, written

RADIUS, TILE = 3, 2048
#: Comparisons of fingerprints that one task makes (a few seconds' work).
TASK_PAIRS = 1 << 27
#: Bit blocks as (lowest bit, bits), and the tables: pairs of blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = tuple(combinations(range(len(BLOCKS)), 2))
_MASKS = np.array([((1 << n) - 1) << at for at, n in BLOCKS], dtype=np.uint64)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text):
    """XXH64 (seed 42) of each 3-word shingle; of the whole sequence if it is shorter; none without words."""
    w = F.filter(F.split(ascii_lower(text), SPACES), lambda x: x != "")
    at = lambda w, i: F.get(w, i)
    return F.transform(
        F.filter(F.array(w), lambda w: F.size(w) > 0),
        lambda w: F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
                lambda i: F.xxhash64(F.concat_ws(" ", at(w, i), at(w, i + 1), at(w, i + 2))),
            ),
        ).otherwise(F.array(F.xxhash64(F.array_join(w, " ")))),
    )


def _majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One fingerprint for each slice of values."""
    n, out = len(offsets) - 1, np.zeros(len(offsets) - 1, dtype=np.uint64)
    weights, step = np.uint64(1) << np.arange(64, dtype=np.uint64), 1 << 15
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if a == b:
            continue
        count = np.zeros(64, dtype=np.int64)
        for s in range(a, b, step):
            bits = np.unpackbits(values[s : min(b, s + step)].view(np.uint8), bitorder="little").reshape(-1, 64)
            count += bits.sum(0, dtype=np.int32)
        out[i] = weights[2 * count > b - a].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """doc_id, the columns keep and fp, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            h = b.column(b.num_columns - 1)
            flat = h.flatten()
            values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
            offsets = np.asarray(h.offsets.to_numpy(), dtype=np.int64)
            fp = _majority(values, offsets - (offsets[0] if len(offsets) else 0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=["doc_id", *keep, "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = F.coalesce(F.flatten(shingle_hashes(text)), F.array().cast("array<bigint>"))
    more = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(F.col(id_col).alias("doc_id"), *keep, hashes.alias("h")).mapInArrow(run, f"doc_id {kind}{more}, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of 64-bit words; the last word is padded with zeros."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 64), dtype=np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_pairs(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS):
    """Indexes (i, j) with queries[i] and fps[j] at most radius (up to 3) bits apart, by carry-save bit planes."""
    planes = _planes(fps)
    words, every = planes.shape[1], 8
    i = np.repeat(np.arange(len(queries)), words)
    w = np.tile(np.arange(words), len(queries))
    low = np.zeros(len(i), dtype=np.uint64)
    high, over = low.copy(), low.copy()
    for b in range(64):
        wanted = np.where((queries >> np.uint64(b)) & np.uint64(1), _FULL, np.uint64(0))
        diff = planes[b][w] ^ wanted[i]
        carry = low & diff
        low ^= diff
        over |= high & carry
        high ^= carry
        if b % every == every - 1:
            alive = over != _FULL
            if not alive.all():
                i, w, low, high, over = i[alive], w[alive], low[alive], high[alive], over[alive]
            if not len(i):
                break
    if not len(i):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    near = ~over
    if radius < 3:
        near &= ~high if radius < 2 else ~(high & low)
        if radius < 1:
            near &= ~low
    hit = near != 0
    i, w, near = i[hit], w[hit], near[hit]
    r, bit = np.nonzero(np.unpackbits(near.view(np.uint8), bitorder="little").reshape(-1, 64))
    j = w[r] * 64 + bit
    keep = j < len(fps)
    return i[r][keep], j[keep]


def _first_table(x: np.ndarray) -> np.ndarray:
    """For XORs of linked fingerprints: the first table in which the two meet."""
    same = (x[:, None] & _MASKS[None, :]) == 0
    out = np.full(len(x), len(TABLES), dtype=np.int64)
    for t in range(len(TABLES) - 1, -1, -1):
        a, b = TABLES[t]
        out[same[:, a] & same[:, b]] = t
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            return label


def _tile(table: int, fps: np.ndarray, count: np.ndarray, side: np.ndarray, both: bool):
    """(fp, linked documents, representative) of a tile's linked fingerprints; both: only pairs across its sides."""
    near = np.zeros(len(fps), dtype=np.int64)
    label = np.arange(len(fps))
    q = np.flatnonzero(side == 0) if both else np.arange(len(fps))
    c = np.flatnonzero(side == 1) if both else q
    if not len(q) or not len(c):
        return None
    for s in range(0, len(q), 512):
        part = q[s : s + 512]
        i, j = near_pairs(fps[part], fps[c])
        i, j = part[i], c[j]
        if not both:
            i, j = i[i < j], j[i < j]
        first = _first_table(fps[i] ^ fps[j]) == table
        i, j = i[first], j[first]
        np.add.at(near, i, count[j])
        np.add.at(near, j, count[i])
        if len(i):
            label = _roots(len(fps), np.concatenate([i, np.arange(len(fps))]), np.concatenate([j, label]))
    linked = near > 0
    return fps[linked], near[linked], fps[label[linked]]


def _link(batches):
    """Over rows sorted by (bucket, a, b): the linked fingerprints of each tile."""

    def tiles():
        held = None
        for batch in batches:
            x = np.stack([np.asarray(batch.column(k).to_numpy(zero_copy_only=False)).astype(np.int64) for k in range(6)])
            held = x if held is None else np.concatenate([held, x], axis=1)
            change = np.flatnonzero((np.diff(held[:3], axis=1) != 0).any(0)) + 1
            at = 0
            for c in change.tolist():
                yield held[:, at:c]
                at = c
            held = held[:, at:]
        if held is not None and held.shape[1]:
            yield held

    out, size = [], 0
    for t in tiles():
        if t.shape[1] < 2:
            continue
        got = _tile(int(t[0, 0]) >> 26, t[4].view(np.uint64), t[5], t[3], bool(t[1, 0] != t[2, 0]))
        if got is not None and len(got[0]):
            out.append(got)
            size += len(got[0])
        if size > 50_000:
            yield _batch(out)
            out, size = [], 0
    yield _batch(out)


def _batch(out):
    cat = lambda k, kind: np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(cat(0, np.uint64).view(np.int64)), pa.array(cat(1, np.int64)), pa.array(cat(2, np.uint64).view(np.int64))],
        names=["fp", "near", "link"],
    )


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """distinct: fp, n. Rows (fp, near, link): partial counts of linked documents, and members of one component."""
    key = [
        F.shiftleft(F.lit(t).cast("long"), 26)
        + F.shiftleft(F.shiftrightunsigned("fp", BLOCKS[a][0]).bitwiseAND((1 << BLOCKS[a][1]) - 1), 13)
        + F.shiftrightunsigned("fp", BLOCKS[b][0]).bitwiseAND((1 << BLOCKS[b][1]) - 1)
        for t, (a, b) in enumerate(TABLES)
    ]
    keyed = distinct.select("fp", "n", F.explode(F.array(*key)).alias("bucket"))
    sizes = written(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    work = sizes.agg(F.coalesce(F.sum(F.pow(F.col("size").cast("double"), 2)), F.lit(0.0))).first()[0]
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work // TASK_PAIRS) + 1)
    m = F.ceil(F.col("size") / F.lit(tile))
    mine = F.pmod(F.xxhash64("fp"), F.col("m"))
    rows = (
        keyed.join(sizes.hint("shuffle_hash"), "bucket")
        .withColumn("m", m)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        .select(
            "bucket",
            F.least("mine", "other").alias("a"),
            F.greatest("mine", "other").alias("b"),
            F.when(F.col("mine") > F.col("other"), 1).otherwise(0).cast("long").alias("side"),
            "fp",
            "n",
        )
    )
    return rows.repartition(tasks, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(_link, "fp long, near long, link long")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Rows (u, root), root the smallest node of u's component; nodes that are roots are left out.

    Rounds go on until nothing changes, after about log(n) of them and log(n) squared at most.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        before, e = e, written(small, "edges")
        discard(before)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select("u", F.col("v").alias("root"))


def classes(fp: DataFrame) -> DataFrame:
    """fp: doc_id, fp. For each fingerprint: n_near, root (the class of its documents) and component_id."""
    distinct = written(fp.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    found = written(links(distinct), "links")
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    root = components(found.select(F.col("fp").alias("u"), F.col("link").alias("v")))
    each = (
        distinct.join(near, "fp", "left")
        .join(root.withColumnRenamed("u", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
        .select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "root", "least")
    )
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(least, "root").select("fp", "n_near", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), n_near (documents linked directly) and component_id (smallest id reachable), a row a document."""
    fp = written(fingerprints(docs, id_col, text_col), "fingerprints")
    return fp.join(classes(fp).drop("root"), "fp").select("doc_id", "fp", "n_near", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with its columns: that of the smallest id, documents without an id last.

    Of different texts with that same id the one of the smallest hash stays, of rows that differ in other columns only
    that of the smallest hash of the row. Two texts of one id that aren't near each other are in two classes: both stay.
    """
    id_hash, text_hash, row_hash, nth, own_id, own_hash = unused(docs, "id_hash", "text_hash", "row_hash", "nth", "own_id", "own_hash")
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hashed = docs.select(id_col, text_col, h.alias("own_hash"))
    fp = written(fingerprints(hashed, id_col, text_col, keep=("own_hash",)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "own_hash")).alias("first")
    kept = fp.join(classes(fp).select("fp", "root"), "fp").groupBy("root").agg(first)
    kept = kept.select(F.xxhash64("first.doc_id").alias(own_id), F.col("first.own_hash").alias(own_hash)).distinct()
    # repeated rows are reduced to one before they are moved (the window's limit works within each task first), and the
    # join finds the rows where the window has put them: hashes are never null, so both go by the same keys
    window = Window.partitionBy(id_hash, text_hash).orderBy(row_hash)
    d = docs.withColumns({id_hash: F.xxhash64(id_col), text_hash: h, row_hash: F.xxhash64(*docs.columns)})
    d = d.withColumn(nth, F.row_number().over(window)).where(F.col(nth) == 1)
    on = (F.col(id_hash) == F.col(own_id)) & (F.col(text_hash) == F.col(own_hash))
    return d.join(kept.hint("shuffle_hash"), on, "left_semi").select(*docs.columns)
