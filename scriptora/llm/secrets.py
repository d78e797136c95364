"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every row is one version of one path and is addressed by the SHA-256 of its text. The ledger, a table in a folder of
its own, says which blobs each rule version has scanned and what it found; only blob and rule-version pairs that it
lacks are scanned, each blob once however many paths and versions hold it, the new rows are appended, and the findings
are joined back to all paths. With no ledger yet, all blobs are scanned. A rule whose pattern changes gets a new version
and is run again over all blobs; what its former version found doesn't count any more. An append that breaks off leaves
whole rows or none, so what is there is right and the rest is scanned the next time.

What is unseen is found by hashes alone. Where that is little (FEW blobs), texts stay where they are read and only those
to scan go on, if the planner finds the list small enough to broadcast; else every text is moved once, to the row
that stands for its blob, after rows that repeat have been reduced to one in each task.

A match's place comes from splitting the text by the same pattern: it starts after all gaps and matches before it.
Places are code points, the end exclusive. Null texts count as empty; empty tables give empty results; repeated rows
each give their row; texts of any length are scanned whole; only the id and text columns are read, and other columns may
have any names. The paths of a hot blob are small rows that carry no text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptora.llm.common import exists, id_and_text, shared_dir, unused, written

#: Blobs to scan below which texts are looked up rather than sorted out.
FEW = 1_000_000
#: Spans in the ledger, and as findings have them.
FOUND = "array<struct<start:int,rule:string,end:int>>"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob string, rules array<string>, spans {FOUND}"


@dataclass(frozen=True)
class Rule:
    """kind and version name a rule; a match counts if its group has at least so many characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules, in their order, then those that the method adds.
RULES = (
    Rule("assign", 1, _ASSIGN, 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),  # as AKIA[A-Z0-9]+ of 16 characters or more: a shorter run has no longer match
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _scan(blobs: DataFrame, rules) -> DataFrame:
    """blobs: blob, text, todo (names of rules). Rows (blob, spans) of the blobs with findings."""
    cell = []
    for r in rules:
        cut = F.struct(
            F.lit(r.name).alias("rule"),
            F.split("text", r.pattern, -1).alias("gaps"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("found"),
        )
        due = F.array_contains("todo", r.name) & F.col("text").rlike(r.pattern)
        cell.append(F.when(due, cut))
    per_rule = blobs.select("blob", F.explode(F.filter(F.array(*cell), lambda x: x.isNotNull())).alias("x"))
    pieces = per_rule.select(
        "blob",
        "x.rule",
        F.posexplode(F.arrays_zip(F.transform("x.gaps", F.length).alias("gap"), F.col("x.found").alias("m"))).alias("i", "p"),
    ).select("blob", "rule", "i", F.col("p.gap").alias("gap"), F.col("p.m").alias("m"))
    # the running length of gaps and matches before a match
    total = "sum(gap + coalesce(length(m), 0)) over (partition by blob, rule order by i) - coalesce(length(m), 0)"
    spans = pieces.withColumn("start", F.expr(f"cast({total} as int)")).where("m is not null")
    keep = F.lit(False)
    for r in rules:
        long_enough = F.length(F.regexp_extract("m", r.pattern, r.group)) >= r.least if r.least else F.lit(True)
        keep = keep | ((F.col("rule") == r.name) & long_enough)
    return (
        spans.where(keep)
        .select("blob", F.struct("start", "rule", (F.col("start") + F.length("m")).alias("end")).alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("s")).alias("spans"))
    )


def ledger_of(spark: SparkSession, name: str) -> str:
    """The folder of the ledger that belongs to name, in the shared folder."""
    return f"{shared_dir(spark)}/secret-ledger-{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows to append to the ledger: blob, rules (names run now), spans. ledger: what earlier calls returned."""
    path = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("path")
    d = id_and_text(docs, id_col, text_col).select(path, blob_of(F.col("text")).alias("blob"), "text")
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = d.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        due, few = blobs.select("blob", "path", names.alias("todo")), False
    else:
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
        due = written(blobs.join(done, "blob", "left").select("blob", "path", todo.alias("todo")).where("size(todo) > 0"), "due-blobs")
        few = due.count() < FEW
    # one path of each blob brings the text, and of rows that repeat with the same path and text one
    if few:
        texts = d.join(due, ["blob", "path"]).dropDuplicates(["blob", "path"])
    else:
        texts = d.dropDuplicates(["blob", "path"]).join(due.hint("shuffle_hash"), ["blob", "path"])
    texts = texts.select("blob", "text", "todo")
    found = _scan(texts, rules)
    return due.select("blob", F.col("todo").alias("rules")).join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(FOUND)))


def append_to_ledger(docs: DataFrame, path: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger in the folder path lacks, append it there, and return the whole ledger."""
    spark = docs.sparkSession
    read = lambda: spark.read.schema(LEDGER).parquet(path)
    update_ledger(docs, read() if exists(spark, path) else None, rules, id_col, text_col).write.mode("append").parquet(path)
    return read()


def findings(docs: DataFrame, ledger: DataFrame | str | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob and spans (start, rank of the rule, kind, end), sorted by start, then rank; a row for each row of docs.

    ledger: the folder of a ledger, which is read and appended to, or what is scanned already as a table.
    """
    if isinstance(ledger, str):
        every = append_to_ledger(docs, ledger, rules, id_col, text_col)
    else:
        every = written(update_ledger(docs, ledger, rules, id_col, text_col), "ledger")
        every = every if ledger is None else ledger.select("blob", "rules", "spans").unionByName(every)
    # only what the rules in these versions found
    ranks = F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(k) for k in range(len(rules))]))
    hits = every.where("size(spans) > 0").select("blob", F.explode("spans").alias("s")).withColumn("rank", F.element_at(ranks, F.col("s.rule"))).where("rank is not null")
    span = F.struct("s.start", "rank", F.substring_index("s.rule", "@", 1).alias("kind"), "s.end")
    hits = hits.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    paths = id_and_text(docs, id_col, text_col).select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def redact(
    docs: DataFrame, mark: str = "[SECRET]", rules=RULES, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None
) -> DataFrame:
    """docs with every found span replaced by mark; overlapping spans count as one. Columns and rows stay as they are."""
    blob, spans = unused(docs, "blob", "spans")
    hits = findings(docs, ledger, rules, id_col, text_col).where("size(spans) > 0").select(F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob])
    hits = written(hits, "secrets")  # of known size: broadcast only below the threshold
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(
        spans,
        start,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).otherwise(a["out"]).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return (
        docs.withColumn(blob, blob_of(text))
        .join(hits, blob, "left")
        .withColumn(text_col, F.when(F.col(spans).isNotNull(), cut).otherwise(F.col(text_col)))
        .select(*docs.columns)
    )


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
