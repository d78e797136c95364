"""Labels and edits joined to chunks: corpora, training records, splits, samples, statistics, spans, indexes.

chunks: chunk_id, text, quality_score, ...; annotations: chunk_id, label (0 good, 1 bad, null skipped), ...; edits: chunk_id,
version, edited_text, edit_reason, .... Ids that repeat among chunks mean the last one by ``pos`` where that is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions.text import WS
from scriptora.sources.shared import checkpointed


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: an aggregate, so that a hot key's rows are reduced before they are moved."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("last")
    return rows.groupBy(F.col(key).alias("of")).agg(last).select("last.*")


def latest_edits(edits: DataFrame) -> DataFrame:
    """chunk_id, edited_text, edit_reason, edit_version (how many there are): an aggregate, so versions never meet as a list."""
    return edits.groupBy("chunk_id").agg(
        F.max_by("edited_text", "version").alias("edited_text"),
        F.max_by("edit_reason", "version").alias("edit_reason"),
        F.count("*").alias("edit_version"),
    )


def build_corpus(chunks: DataFrame, annotations: DataFrame, edits: DataFrame | None = None, least_quality: float | None = None) -> DataFrame:
    """Chunks labelled good, of enough quality, with the text of their latest edit where there is one."""
    good = annotations.where("label = 0").drop("label")
    c = chunks if least_quality is None else chunks.where(F.coalesce("quality_score", F.lit(0.0)) >= least_quality)
    out = c.join(good, "chunk_id")
    if edits is None:
        return out.withColumn("edited", F.lit(False))
    out = out.join(latest_edits(edits), "chunk_id", "left").withColumn("edited", F.col("edited_text").isNotNull())
    return out.withColumn("text", F.coalesce("edited_text", "text")).drop("edited_text")


def corpus_statistics(chunks: DataFrame, annotations: DataFrame, edits: DataFrame, least_quality: float) -> DataFrame:
    """One row: good_chunks, edited_chunks, quality_filtered."""
    j = chunks.join(annotations.where("label = 0"), "chunk_id").join(edits.select("chunk_id").distinct().withColumn("e", F.lit(1)), "chunk_id", "left")
    ok = F.coalesce("quality_score", F.lit(0.0)) >= least_quality
    return j.agg(F.count_if(ok).alias("good_chunks"), F.count_if(ok & F.col("e").isNotNull()).alias("edited_chunks"), F.count_if(~ok).alias("quality_filtered"))


def match_sources(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """sessions: stem; files: stem, path, depth. The file of each session: the same name, then in any case, then deeper."""
    s, f = sessions.select(F.col("stem").alias("session")), files
    j = s.join(f, F.lower("session") == F.lower("stem"))
    rank = F.when((F.col("session") == F.col("stem")) & (F.col("depth") == 0), 0).when(F.col("depth") == 0, 1).otherwise(2)
    w = Window.partitionBy("session").orderBy("rank", "path")
    return j.withColumn("rank", rank).withColumn("r", F.row_number().over(w)).where("r = 1").select("session", "path")


def _hash(seed: int) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("chunk_id").cast("string")).cast("binary"))


def global_rank(df: DataFrame, key: list[str], buckets: list[str], order: list) -> DataFrame:
    """df with __rank (from 1, within a key) and __size (of the key), exact, without a window over a whole key.

    buckets: columns that are few and agree with the order. Rows are ranked within their bucket; what comes before a bucket
    is a running sum over the buckets' counts. A key that holds most rows is thus spread over all of its buckets.
    """
    counts = df.groupBy(*key, *buckets).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(w.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"__before": before, "__size": F.sum("__n").over(w)}).drop("__n")
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy(*key, *buckets).orderBy(*order)))
    same = F.lit(True)
    for c in (*key, *buckets):
        same = same & local[c].eqNullSafe(counts[c])
    j = local.join(counts, same).drop(*[counts[c] for c in (*key, *buckets)])
    return j.withColumn("__rank", F.col("__before") + F.col("__local")).drop("__before", "__local")


def balance(records: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has: those of the highest quality (to four places), then by a seeded hash."""
    fewest = records.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("__fewest"))
    r = records.withColumns({"__worse": -F.round(F.coalesce("quality_score", F.lit(-1.0)), 4), "__h": _hash(seed)})
    r = r.withColumn("__part", F.substring("__h", 1, 2))
    ranked = global_rank(r, ["label"], ["__worse", "__part"], ["__h", "chunk_id"])
    return ranked.join(F.broadcast(fewest), F.col("__rank") <= F.col("__fewest")).select(*records.columns)  # one row


def train_test_split(records: DataFrame, test_size: float = 0.2, stratify: bool = True, seed: int = 42, label: str = "label") -> DataFrame:
    """records with split: a fixed share of each label by the order of a seeded hash of the id, the same on every run."""
    r = records.withColumn("__h", _hash(seed)).withColumn("__part", F.substring("__h", 1, 3))
    ranked = global_rank(r, [label] if stratify else [], ["__part"], ["__h", "chunk_id"])
    split = F.when(F.col("__rank") <= F.ceil(F.col("__size") * F.lit(test_size)), "test").otherwise("train")
    return ranked.withColumn("split", split).select(*records.columns, "split")


def diversity_sample(chunks: DataFrame, annotated: DataFrame, size: int, deciles: int = 10, seed: int = 42) -> DataFrame:
    """Unlabelled chunks, round robin over the deciles of their quality; a score of 1 is in none and comes last."""
    u = chunks.join(annotated.select("chunk_id"), "chunk_id", "left_anti")
    d = F.floor(F.coalesce("quality_score", F.lit(0.5)) * deciles)
    w = Window.partitionBy("decile").orderBy(_hash(seed))
    # a rank bound against a number: Spark keeps the first of each decile before the shuffle
    u = u.withColumn("decile", d).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= size)
    return u.orderBy((F.col("decile") >= deciles).cast("int"), "turn", "decile").limit(size)


def uncertainty_sample(scored: DataFrame, annotated: DataFrame, size: int) -> DataFrame:
    """Unlabelled chunks whose probability is nearest to a half: a top-k, never a full sort."""
    u = scored.join(annotated.select("chunk_id"), "chunk_id", "left_anti")
    return u.orderBy(F.abs(F.col("probability") - 0.5), "chunk_id").limit(size)


def session_statistics(annotations: DataFrame) -> DataFrame:
    """session, total, good, bad, skipped, average confidence."""
    return annotations.groupBy("session").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label") == 0).alias("good"),
        F.count_if(F.col("label") == 1).alias("bad"),
        F.count_if(F.col("label").isNull()).alias("skipped"),
    )


def issue_counts(annotations: DataFrame) -> DataFrame:
    """issue, n: an annotation counts once for each of its issues."""
    return annotations.select(F.explode(F.array_distinct("issues")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def features(chunks: DataFrame) -> DataFrame:
    """chunk_id and the features of the chunk classifier, from text, word_count, sentence_count, hierarchy and references."""
    from scriptora.functions.text import LEVELS, NOT_WS, WS, count_of, words

    have = set(chunks.columns)
    t = F.coalesce(F.col("text"), F.lit(""))
    num = lambda c, d=0: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) if c in have else F.lit(0)
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    n, chars, thousand = num("word_count"), F.length(t), num("word_count") / 1000
    depth = F.size(F.filter(F.array(*[F.col("hierarchy")[x] for x in LEVELS]), lambda x: x != "")) if "hierarchy" in have else F.lit(0)
    lines = F.split(t, "\n")
    c = chunks.withColumn("__w", words(F.lower(t)))  # no letter's small form depends on another word
    w = F.col("__w")
    # words of one class are counted in the text; the class is looked for first: it is rare
    share = lambda x: over(F.regexp_count(t, F.lit(rf"(?U)(?={x})(?<!{NOT_WS}){x}++(?!{NOT_WS})")), F.size(w))
    few = lambda x: ~x.rlike(rf"\A{WS}*+(?:{NOT_WS}++{WS}++){{4}}{NOT_WS}")
    stop = ("a", "an", "and", "at", "but", "for", "in", "on", "or", "the", "to")
    cols = {
        "word_count": n,
        "text_length": chars,
        "sentence_count": num("sentence_count"),
        "hierarchy_depth": depth,
        "avg_sentence_length": over(n, num("sentence_count")),
        "chars_per_word": over(chars, n),
        "tokens_per_word": over(F.size(w), n),
        "unique_words_ratio": over(F.size(F.array_distinct(w)), F.size(w)),
        "stopword_ratio": over(F.size(F.filter(w, lambda x: x.isin(*stop))), F.size(w)),
        "punctuation_density": over(count_of(t, "[.,;:!?]"), chars),
        "number_token_ratio": share("[0-9]"),
        "capital_ratio": over(count_of(t, r"[A-Z[[^\x00-\x7f]&&\p{Lu}]]"), chars),
        "scripture_density": over(size("scripture_references"), thousand),
        "cross_ref_density": over(size("cross_references"), thousand),
        "date_density": over(size("dates_mentioned"), thousand),
        "has_hierarchy": F.when(depth > 0, 1.0).otherwise(0.0),
        "position_normalized": num("source_order") / 1000.0,
        "hierarchy_consistency": over(depth, depth),
        "number_density": share(rf"[[^A-Za-z]&&[\d\W]&&{NOT_WS}]"),
        "token_word_ratio": over(F.size(w), n),
        "reference_pattern_density": over(F.regexp_count(t, F.lit(r"\d+:\d+(-\d+)?")), n),
        "short_line_ratio": F.size(F.filter(lines, few)) / F.size(lines),
        "nav_keyword_presence": F.when(F.lower(t).rlike("(?=[bcinp])(?:back|contents|index|next|page|previous)"), 1.0).otherwise(0.0),
        "garble_rate": num("garble_rate", 0.0),
        "mean_conf": num("mean_conf", 0.5),
        "line_len_std_norm": num("line_len_std_norm", 0.5),
    }
    return c.select("chunk_id", *[v.cast("double").alias(k) for k, v in cols.items()], *[x for x in ("label",) if x in have])


def train_classifier(feats: DataFrame, seed: int = 42):
    """A gradient-boosted pipeline over features() with a label; classes weighted by their ratio. Raises for one class."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    sizes = {r["label"]: r["count"] for r in feats.where("label is not null").groupBy("label").count().collect()}  # two rows
    if len(sizes) < 2:
        raise ValueError("training needs both classes")
    rows = feats.where("label is not null").withColumn("weight", F.when(F.col("label") == 1, sizes[0] / sizes[1]).otherwise(1.0))
    names = [c for c in feats.columns if c not in ("chunk_id", "label")]
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=10, maxDepth=4, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), gbt]).fit(rows)


def predict(model, feats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """chunk_id, probability, prediction."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(feats).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return p.select("chunk_id", "probability", (F.col("probability") >= threshold).cast("int").alias("prediction"))


def save_classifier(model, threshold: float, path: str) -> None:
    """The model and its threshold in a folder."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(threshold,)], "threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/threshold")


def load_classifier(spark, path: str):
    """(model, threshold) as they were saved."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), spark.read.schema("threshold double").json(f"{path}/threshold").first()[0]


BOOTSTRAP, RETRAIN = 100, 500


def should_retrain(annotated: int, has_model: bool, bootstrap: int = BOOTSTRAP, every: int = RETRAIN) -> bool:
    """Without a model always, with one after each so many labels beyond those of the first training."""
    since = annotated - bootstrap
    return not has_model or (since > 0 and since % every == 0)


def progress_estimate(scored: DataFrame, annotated: DataFrame, has_model: bool = True, bootstrap: int = BOOTSTRAP, certainty: float = 0.8) -> DataFrame:
    """One row, percent. Before there is a model: half of how far the bootstrap is. Then half the share of labelled chunks
    and half that of the others whose probability (scored: chunk_id, probability) is far enough from a half."""
    known = annotated.select("chunk_id").distinct().withColumn("known", F.lit(True))
    j = scored.join(known, "chunk_id", "left")
    n, k = F.count("*"), F.count("known")
    if not has_model:
        return j.agg(F.when(n == 0, 100.0).otherwise(F.least(F.lit(50.0), 50.0 * k / F.lit(bootstrap))).alias("percent"))
    unsure = F.count_if(F.col("known").isNull() & (F.abs(F.col("probability") - 0.5) < F.lit(1.0 - certainty)))
    share = F.when(n == 0, 100.0).when(n == k, 100.0).otherwise(100.0 * (0.5 * k / n + 0.5 * (1 - unsure / (n - k))))
    return j.agg(share.alias("percent"))


def boundaries(chunks: DataFrame, gap: int = 2) -> DataFrame:
    """doc_id, chunk_id, start, end of each chunk in its document's joined text, with a header line where the path changes."""
    w = Window.partitionBy("doc_id").orderBy("paragraph_id")
    header = F.when((F.col("path") != "") & ~F.col("path").eqNullSafe(F.lag("path").over(w)), F.length("path") + 10).otherwise(0)
    c = chunks.withColumn("size", F.length("text") + header)
    start = F.coalesce(F.sum(F.col("size") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("doc_id", "chunk_id", start.alias("start"), (start + F.col("size")).alias("end"))


def overlapping_boundaries(spans: DataFrame, bounds: DataFrame, step: int = 4096) -> DataFrame:
    """span_id and the ids of the chunks that it overlaps, in order: a range join over blocks of ``step`` characters, so
    that a document's spans meet only the chunks near them."""
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / step), F.floor((b - 1) / step)))
    s = spans.where("s_end > s_start").withColumn("block", blocks(F.col("s_start"), F.col("s_end")))
    b = bounds.where(F.col("end") > F.col("start")).withColumn("block", blocks(F.col("start"), F.col("end")))
    hit = s.join(b, ["doc_id", "block"]).where((F.col("start") < F.col("s_end")) & (F.col("end") > F.col("s_start")))
    pairs = hit.select("doc_id", "span_id", "chunk_id", "start").distinct()
    g = pairs.groupBy("doc_id", "span_id").agg(F.array_sort(F.collect_list(F.struct("start", "chunk_id"))).alias("c"))
    return g.select("doc_id", "span_id", F.col("c.chunk_id").alias("chunk_ids"))


def index_summary(index: DataFrame) -> DataFrame:
    """section (null: all), total, downloaded, processed, pending."""
    return index.rollup("section").agg(
        F.count("*").alias("total"),
        F.count_if("downloaded").alias("downloaded"),
        F.count_if("processed").alias("processed"),
        F.count_if(F.col("downloaded") & ~F.col("processed")).alias("pending"),
    )


def add_to_index(index: DataFrame, found: DataFrame) -> DataFrame:
    """index with the rows of found whose URL is new, the first of each."""
    new = found.join(index.select("url"), "url", "left_anti")
    return index.unionByName(new.dropDuplicates(["url"]))


def deduplicate(paragraphs: DataFrame) -> DataFrame:
    """One row of each text (white space folded) and hierarchy in a document: that of the lowest paragraph_id."""
    first = F.min_by(F.struct(*paragraphs.columns), "paragraph_id").alias("first")
    same = F.sha2(F.encode(_folded(F.col("text")), "UTF-8"), 256)
    return paragraphs.groupBy(F.col("doc_id").alias("of"), same.alias("same"), F.col("hierarchy").alias("h")).agg(first).select("first.*")


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def deduplicate_nested(nested: DataFrame) -> DataFrame:
    """The rows (doc_id, ps) with the first of each text (white space folded) and hierarchy, in order: no shuffle."""
    keys = F.transform("ps", lambda p, i: F.struct(_folded(p["text"]).alias("text"), p["hierarchy"].alias("hierarchy"), i.alias("i")))

    def firsts(s: Column) -> Column:
        other = lambda x, k: (k == 0) | (x["text"] != F.get(s, k - 1)["text"]) | (x["hierarchy"] != F.get(s, k - 1)["hierarchy"])
        return F.array_sort(F.transform(F.filter(s, other), lambda x: x["i"]))

    at = F.get(F.transform(F.array(F.array_sort(keys)), firsts), F.lit(0))
    return nested.withColumn("ps", F.transform(at, lambda i: F.get("ps", i)))


def mark_front_matter(chunks: DataFrame, reason: Column, remove: bool, safe: float = 0.9) -> DataFrame:
    """Front and back matter flagged, or removed with the children of removed parents; where over ``safe`` of a document
    would go, nothing goes and it is flagged."""
    c = chunks.withColumn("__reason", reason)
    hit = F.col("__reason") != "content"
    flag = F.when(hit, F.array(F.concat(F.lit("likely_noncore_matter_"), "__reason"))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), flag)
    if not remove:
        return c.withColumn("quality_flags", flags).drop("__reason")
    gone = c.where(hit & (F.col("chunk_level") == "parent")).select("doc_id", F.col("stable_id").alias("parent_chunk_id"), F.lit(True).alias("__orphan"))
    c = c.join(gone, ["doc_id", "parent_chunk_id"], "left")
    go = hit | F.coalesce("__orphan", F.lit(False))
    ratio = F.avg(go.cast("int")).over(Window.partitionBy("doc_id"))
    c = c.withColumn("__go", go).withColumn("__ratio", ratio)
    too_many = F.col("__ratio") > safe
    c = c.where(too_many | ~F.col("__go")).withColumn("quality_flags", F.when(too_many, flags).otherwise(F.col("quality_flags")))
    return c.select(*chunks.columns)


def crawl(seeds: DataFrame, links: DataFrame, depth: int = 3) -> DataFrame:
    """seeds: url; links: src, dst. url and the least number of links to it, up to depth: a frontier join for each level,
    with visited URLs left out by an anti-join."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(links, frontier["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        # kept: else each level would run all levels before it again, twice
        frontier = checkpointed(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def fill_seasons(days: DataFrame, look_back: int = 6, otherwise: str = "Ordinary Time") -> DataFrame:
    """days: date, season. A missing season is the last known one within so many rows before, else ``otherwise``."""
    w = Window.partitionBy("year").orderBy("date").rowsBetween(-look_back, -1)
    return days.withColumn("season", F.coalesce("season", F.last("season", ignorenulls=True).over(w), F.lit(otherwise)))
