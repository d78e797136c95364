"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptora.llm.common import table


def op2_simhash_near_dedup(spark, sf_dir):
    from scriptora.llm import simhash

    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def op3_byte_bpe(spark, sf_dir, vocabulary=None):
    import public_tokenizers

    from scriptora.llm import bpe

    path, pattern = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    d = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return d.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_decontaminate(spark, sf_dir):
    from scriptora.llm import decontaminate

    d = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return d.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
iw AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda k: array_to_string(list_slice(w, k, k + 7), ' '))) AS k,
       least(len(w), 8) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, n FROM iw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, lens WHERE len(w) >= n),
hits AS (SELECT r, p, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND array_to_string(list_slice(w, p, p + dw.n - 1), ' ') = win.k),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""


def op4_quality(spark, sf_dir):
    from scriptora.llm import quality

    d = quality.verdicts(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


SHARD_BYTES = 4 << 20


def op5_sharding(spark, sf_dir):
    from scriptora.llm import sharding

    d = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return d.select("doc_id", "n_bytes", "shard", "depth")


def op7_secrets(spark, sf_dir):
    from scriptora.llm import secrets

    # the ledger of these tables stays in the shared folder: a later run scans only what is new
    d = secrets.findings(table(spark, sf_dir, "documents"), secrets.ledger_of(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return d.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def _op7_sql() -> str:
    """Each rule's matches and the gaps before them; a match starts after all gaps and matches before it."""
    from scriptora.llm import secrets

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(secrets.RULES):
        keep = f"length(regexp_extract(m, {quoted(r.pattern)}, {r.group})) >= {r.least}" if r.least else "true"
        parts.append(
            f"SELECT r, {k} AS rank, '{r.kind}' AS kind, s, s + length(m) AS e FROM (SELECT r, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), "
            "lambda i: coalesce(list_sum(list_transform(g[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))) AS s "
            f"FROM (SELECT r, regexp_extract_all(text, {quoted(r.pattern)}) AS m, string_split_regex(text, {quoted(r.pattern)}) AS g FROM d)) WHERE {keep}"
        )
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    n = ", ".join(f"count(f.r) FILTER (rank = {k}) AS n_{secrets.RULES[k].kind}" for k in range(3))
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(parts)}) "
        f"SELECT any_value(doc_id) AS doc_id, {n}, sha256(coalesce(string_agg({one}, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg({one}, ',' ORDER BY s, rank), '') AS spans "
        "FROM d LEFT JOIN f USING (r) GROUP BY d.r"
    )


def op6_language_id(spark, sf_dir):
    from scriptora.llm import language_id
    from scriptora.llm.common import remainder

    d = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.training_rows(d, remainder(F.col("doc_id"), 4) != 2))
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return language_id.predict(d, model).select("doc_id", held, "lang_pred", "score")


def op8_licenses(spark, sf_dir):
    from scriptora.llm import licenses

    d = licenses.scan(table(spark, sf_dir, "documents"))
    places, joined = F.col("places.start"), lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return d.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"),
        "score",
    )


def op9_lm_scoring(spark, sf_dir):
    from scriptora.llm import suffixes
    from scriptora.llm.common import remainder

    d = suffixes.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0)
    held = (remainder(F.col("doc_id"), 10) == 0).alias("held_out")
    return d.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark, sf_dir):
    from scriptora.llm import toxicity
    from scriptora.llm.common import remainder

    d = table(spark, sf_dir, "documents")
    model = toxicity.fit(d, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return toxicity.score(d, model).select("doc_id", held, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_simhash_near_dedup, op3_byte_bpe, op4_quality, op5_sharding, op6_language_id, op7_secrets, op8_licenses, op9_lm_scoring, op10_toxicity, pipeline)}
_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op7_secrets": _op7_sql()}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
