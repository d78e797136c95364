"""A training-data pipeline over the documents table: identified, deduplicated, decontaminated, redacted, tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
rereads it as the next one's docs. All stages but the last return the columns of documents; further columns pass
through whatever their names. Tables that a stage leaves behind are deleted once the next one has its input.

Null and empty texts have no language and go in the first stage; where they come to a later one, they are one class of
near duplicates, hold no passage and no secret and have no tokens. Rows that repeat are near duplicates of each other, so
one stays; documents with null ids are treated like any others. Of ties, the smallest id stays, then the smallest hash.
Empty tables give empty tables. Texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptora.llm import bpe, decontaminate, language_id, secrets, simhash
from scriptora.llm.common import discard, remainder, scratch, table, written

#: A language is known if its probability is at least this.
LEAST_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on."""
    model = language_id.fit(language_id.training_rows(docs, remainder(F.col("doc_id"), 4) != 2))
    return language_id.identified(docs, model, LEAST_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class goes on, that of the smallest id."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows. The ledger of these tables stays in the shared folder."""
    out = secrets.redact(docs, ledger=secrets.ledger_of(spark, sf_dir))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids (little-endian unsigned 32-bit integers)."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontaminate", decontaminated),
    ("secrets", redact),
    ("bpe", tokenize),
]
#: Classifiers and byte-pair merges can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if k:
            discard(before)
    return docs
