"""Sharding by extendible hashing: a directory of hash-prefix bits whose oversized buckets split on another bit.

Rows are hashed by id and text. Bytes are first summed into cells of STEP prefix bits, so a directory level is built
from pre-aggregated rows however large the table is; only rows in cells that are still oversized are summed again, by
STEP more bits. Within the cells, a bucket is the shortest prefix whose bytes fit the limit. Rows that share all BITS
bits (repeats of one row) can't be told apart by bits; they are numbered within their input partition, in the order of a
hash of the row, and packed into parts that fit the limit. A row that alone exceeds the limit is a shard of its own.

The directory has about as many rows as there are shards. It is broadcast if its counted rows are at most
BROADCAST_ROWS, else joined by a shuffle. Null texts count 0 bytes, null ids hash like the empty text. Empty tables give
no shards. Other columns pass through, whatever their names; columns n_bytes, shard or depth are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import unused, written

STEP, BITS, BROADCAST_ROWS = 12, 60, 1_000_000


def directory(cells: DataFrame, limit: int, base: int, step: int = STEP) -> DataFrame:
    """cells: prefix (base + step bits, as a long), bytes. Adds depth: the least one at which its bucket fits; null if none."""
    out = cells.withColumn("__base", F.shiftright("prefix", step)).repartition("__base")
    fits = []
    for b in range(base, base + step + 1):
        w = Window.partitionBy("__base", F.shiftright("prefix", base + step - b))
        out = out.withColumn(f"__fits{b}", F.sum("bytes").over(w) <= limit)
        fits.append(F.when(F.col(f"__fits{b}"), F.lit(b)))
    return out.select("prefix", "bytes", F.coalesce(*fits).alias("depth"))


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, shard (prefix bits as text; '-' and a part where bits don't suffice) and depth."""
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    h = F.shiftrightunsigned(h, 64 - BITS)
    small = written(docs.select(h.alias("h"), n_bytes.alias("bytes")), "shard-bytes")
    buckets, left = [], None
    for base in range(0, BITS, STEP):
        rows = small if left is None else small.join(left, F.shiftright("h", BITS - base) == F.col("over"), "left_semi")
        cells = rows.groupBy(F.shiftright("h", BITS - base - STEP).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        cells = written(directory(cells, limit, base), "shard-cells")
        bucket = F.expr(f"shiftright(prefix, {base + STEP} - depth)")
        buckets.append(cells.where("depth is not null").select("depth", bucket.alias("bucket")).distinct())
        left = cells.where("depth is null").select(F.col("prefix").alias("over"))
        if left.isEmpty():
            left = None
            break
    if left is not None:
        buckets.append(left.select(F.lit(BITS + 1).alias("depth"), F.col("over").alias("bucket")))
    found = written(reduce(DataFrame.unionByName, buckets), "shard-directory")
    sizes = {r[0]: r[1] for r in found.groupBy("depth").count().collect()}  # at most BITS + 1 rows
    own_h, own_b, own_p, row_hash, *ds = unused(docs.drop("n_bytes", "shard", "depth"), "h", "b", "p", "row_hash", *[f"d{d}" for d in sorted(sizes)])
    at_depth = dict(zip(sorted(sizes), ds))
    out = docs.withColumns({own_h: h, "n_bytes": n_bytes})
    for d in sorted(sizes):
        at = found.where(F.col("depth") == d).select(F.col("bucket").alias(own_b), F.lit(d).alias(at_depth[d]))
        at = F.broadcast(at) if sizes[d] <= BROADCAST_ROWS else at
        out = out.join(at, F.shiftright(own_h, max(0, BITS - d)) == F.col(own_b), "left").drop(own_b)
    depth = F.coalesce(*[F.col(k) for k in ds], F.lit(None).cast("int"))
    out = out.withColumn("depth", F.least(depth, F.lit(BITS)))
    out = out.withColumn("shard", F.substring(F.lpad(F.bin(own_h), BITS, "0"), F.lit(1), F.col("depth")))
    if BITS + 1 in sizes:
        mark = at_depth[BITS + 1]
        # the order doesn't depend on how a task reads its rows, so one that is run again gives the same names
        deep = out.where(F.col(mark).isNotNull()).withColumns({own_p: F.spark_partition_id(), row_hash: F.xxhash64(*docs.columns)})
        nth = F.row_number().over(Window.partitionBy(own_h, own_p, "n_bytes").orderBy(row_hash)) - 1
        part = F.floor(nth / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))))
        name = F.concat_ws("-", "shard", F.col(own_p).cast("string"), F.col("n_bytes").cast("string"), part.cast("string"))
        out = out.where(F.col(mark).isNull()).unionByName(deep.withColumn("shard", name).drop(own_p, row_hash))
    return out.drop(own_h, *ds)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard; rows move once, by shard."""
    assigned.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
