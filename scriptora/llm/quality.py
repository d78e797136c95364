"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each text becomes a vector of transformed statistics: how long its words are (the logarithm), its share of symbols (the
root), of repeated lines, and of words in repeated 3-word windows. Per language and source, the minimum covariance
determinant is estimated: from three starts (medians with the least scales, medians with quartile scales, means with the
covariance of all rows) concentration steps take the SUPPORT share of rows that are nearest and recompute mean and
covariance from them, until the determinants settle; the estimate of the least determinant holds. A floor on the
variances keeps the covariance of statistics that are mostly zero invertible. Distances are scaled down if their median
exceeds that of a chi-square, and a text is rejected if its squared Mahalanobis distance exceeds CUTOFF, a quantile of that
chi-square. How many words a text has is left to the base rule: a long text is no outlier.

All estimates cover all rows that pass the base rule and are aggregates by group: partial sums and quantile sketches
are merged map-side, so a hot group never meets in one task. Rows of a group with fewer than LEAST of these rows are
judged by a pooled estimate: that of their language's rows, or of all rows if the language has fewer than LEAST too
(of the group columns, one more is left out from the right each time). If no row passes the base rule there is no
estimate, and no distance: every row is rejected by the base rule. Null texts have no words and null languages or sources
form their own group. Empty tables give no rows. Repeated rows each count and each give a row; rows of one text have one
verdict in a group; only the named columns are read. Windows are compared by 64-bit hashes within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.llm.common import SPACES, written

SUPPORT, LEAST = 0.75, 50
#: Concentration ends when no determinant falls by more than this share, or after so many steps.
SETTLED, STEPS = 1e-3, 20
#: Quantiles of the chi-square with 4 degrees, at 0.5 and 0.999.
CHI2_MEDIAN, CUTOFF = 3.3567, 18.467
DIMS = ("x_length", "x_symbols", "x_lines", "x_repeats")
#: Least standard deviation of a statistic. Each lets its statistic alone exceed CUTOFF (shares of repeated lines go up to
#: 1, those of repeated words to 0.5 after the base rule); one repeated line of three stays below.
FLOOR = (0.05, 0.03, 0.08, 0.08)


def _let(value: Column, f):
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeat_words(w: Column) -> Column:
    """How many words of the array w lie in 3-word windows found twice or more."""

    def count(h):
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s):
            starts = F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]),
                ),
                lambda i: i.isNotNull(),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(by_hash, covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(hashes, count)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=("lang", "source")) -> DataFrame:
    """doc_id, the group's columns g0.., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)],
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    keep = ["doc_id", *[f"g{i}" for i in range(len(group_cols))]]
    d = d.select(
        *keep,
        F.filter(F.split("text", SPACES), lambda x: x != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n_words = F.size("w").cast("long")
    d = d.select(
        *keep,
        n_words.alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector(s: DataFrame) -> DataFrame:
    """The transformed statistics of each row."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return s.withColumns(
        {
            "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "x_symbols": F.sqrt(share("n_symbols", "word_chars")),
            "x_lines": share("n_dup_lines", "n_lines"),
            "x_repeats": share("n_repeat_words", "n_words"),
        }
    )


def _distance() -> Column:
    """The squared Mahalanobis distance by forward substitution through the Cholesky factor's columns."""
    z = []
    for i, x in enumerate(DIMS):
        v = F.col(x) - F.col(f"m_{x}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * z[j]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


#: The columns of an estimate.
_ESTIMATE = [f"m_{x}" for x in DIMS] + [f"l{i}{j}" for i in range(len(DIMS)) for j in range(i + 1)]


def _estimate(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: means m_*, the Cholesky factor l** of the floored covariance, and log_det, the logarithm of its determinant."""
    p = len(DIMS)
    sums = [F.avg(x).alias(f"m_{x}") for x in DIMS] + [
        F.avg(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)
    ]
    g = rows.groupBy(*groups).agg(*sums)
    cov = {}
    for i in range(p):
        for j in range(i + 1):
            c = F.col(f"c{i}{j}") - F.col(f"m_{DIMS[i]}") * F.col(f"m_{DIMS[j]}")
            cov[i, j] = F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2 if i == j else c
    out = g
    for j in range(p):
        # each column of the factor is made a column of the table before the next one uses it
        d = cov[j, j]
        for k in range(j):
            d = d - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(d, F.lit(1e-9))))
        for i in range(j + 1, p):
            v = cov[i, j]
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", v / F.col(f"l{j}{j}"))
    log_det = sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00")) * 2
    return out.select(*groups, *_ESTIMATE, log_det.alias("log_det"))


def _join(rows: DataFrame, per_group: DataFrame, groups: list[str]) -> DataFrame:
    on = [rows[g].eqNullSafe(per_group[g]) for g in groups]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(per_group, cond, "left").drop(*[per_group[g] for g in groups])


def _levels(stats: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: level, how many of its columns its estimate goes by, and feeds, the levels of the estimates it is part of."""
    size = written(stats.groupBy(*groups).agg(F.count_if(~F.col("base_failed")).alias("size")), "groups")

    def with_prefix(out, of, k, agg):
        """out with an aggregate over the groups of ``of`` that agree in the first k columns."""
        some = of.groupBy(*[F.col(g).alias(f"p_{g}") for g in groups[:k]]).agg(agg)
        same = F.lit(True)
        for g in groups[:k]:
            same = same & F.col(g).eqNullSafe(F.col(f"p_{g}"))
        return out.join(some, same, "left").drop(*[f"p_{g}" for g in groups[:k]])

    out, level = size, F.lit(0)
    for k in range(1, len(groups) + 1):
        out = with_prefix(out, size, k, F.sum("size").alias(f"n{k}"))
        level = F.when(F.col(f"n{k}") >= LEAST, F.lit(k)).otherwise(level)
    out = level_of = written(out.select(*groups, level.alias("level")), "levels")
    for k in range(len(groups) + 1):
        out = with_prefix(out, level_of, k, F.max(F.col("level") == k).alias(f"used{k}"))
    feeds = F.array(*[F.when(F.col(f"used{k}"), F.lit(k)) for k in range(len(groups) + 1)])
    return written(out.select(*groups, "level", F.filter(feeds, lambda k: k.isNotNull()).alias("feeds")), "feeds")


def _at_level(groups: list[str]) -> list[Column]:
    """The names of an estimate: its level and as many of the columns."""
    return [F.col("level"), *[F.when(F.col("level") > i, F.col(g)).alias(f"e_{g}") for i, g in enumerate(groups)]]


def _starts(good: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and start: a first estimate."""
    q = good.groupBy(*groups).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{x}") for x in DIMS])
    medians = [F.get(f"q_{x}", F.lit(1)).alias(f"m_{x}") for x in DIMS]

    def diagonal(scale):
        return [(scale(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(len(DIMS)) for j in range(i + 1)]

    quartiles = lambda i: F.greatest(F.lit(FLOOR[i]), (F.get(f"q_{DIMS[i]}", F.lit(2)) - F.get(f"q_{DIMS[i]}", F.lit(0))) / 1.349)
    least = q.select(*groups, *medians, *diagonal(lambda i: F.lit(FLOOR[i])), F.lit(0).alias("start"))
    spread = q.select(*groups, *medians, *diagonal(quartiles), F.lit(1).alias("start"))
    every = _estimate(good, groups).select(*groups, *_ESTIMATE, F.lit(2).alias("start"))
    return least.unionByName(spread).unionByName(every)


def _least_determinant(good: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: the estimate of the least determinant that concentration steps reach from any start.

    A step is two aggregates: the quantile of the distances, then the moments of the rows within it. Of all steps from all
    starts the least determinant counts.
    """
    keys = [*groups, "start"]
    now, before, best = written(_starts(good, groups), "starts"), None, None
    for _ in range(STEPS):
        d = _join(good, now, groups).select(*keys, *DIMS, _distance().alias("d2"))
        limit = written(d.groupBy(*keys).agg(F.percentile_approx("d2", SUPPORT, 1000).alias("h")), "support")
        now = written(_estimate(_join(d, limit, keys).where("d2 <= h"), keys), "concentrated")
        best = now if best is None else best.unionByName(now)
        if before is not None:
            fall = _join(now, before, keys).agg(F.max(F.col("log_det_before") - F.col("log_det"))).first()[0]
            if fall is None or fall <= SETTLED:
                break
        before = now.select(*keys, F.col("log_det").alias("log_det_before"))
    return best.groupBy(*groups).agg(F.min_by(F.struct(*_ESTIMATE), F.struct("log_det", "start")).alias("e")).select(*groups, "e.*")


def verdicts(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", group_cols=("lang", "source")) -> DataFrame:
    """The columns of statistics() with distance (squared, scaled; null if no row passes the base rule) and kept."""
    by = [f"g{i}" for i in range(len(group_cols))]
    stats = vector(written(statistics(docs, id_col, text_col, group_cols), "statistics"))
    stats = _join(stats, _levels(stats, by), by)
    good = stats.where(~F.col("base_failed")).withColumn("level", F.explode("feeds")).select(*_at_level(by), *DIMS)
    groups = ["level", *[f"e_{g}" for g in by]]
    per_group = written(_least_determinant(good, groups), "covariance")
    d = _join(good, per_group, groups).select(*groups, _distance().alias("d2"))
    scale = written(d.groupBy(*groups).agg(F.percentile_approx("d2", 0.5, 1000).alias("middle")), "scale")
    per_group = _join(per_group, scale, groups)
    out = _join(stats.select("*", *_at_level(by)[1:]), per_group, groups)
    distance = _distance() * F.least(F.lit(1.0), CHI2_MEDIAN / F.greatest(F.col("middle"), F.lit(1e-9)))
    out = out.withColumn("distance", distance)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
