"""Session, archive and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptora.config import Extraction, load
from scriptora.operators import archive, sessions
from scriptora.plans.corpus_plans import chunks_of, edits_of, notes_of, table
from scriptora.plans.text_plans import documents
from scriptora.registry import register


@register(
    "ses_current_labels",
    """WITH RECURSIVE e AS (SELECT user_id % 20 AS session, event_id AS seq, event_id % 50 AS chunk_id, event_type, event_type = 'error' OR event_id % 3 = 0 AS undo,
         row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i FROM events),
       r AS (SELECT session, i, CASE WHEN undo THEN [] ELSE [seq] END AS stack, NULL::BIGINT AS popped FROM e WHERE i = 1
         UNION ALL SELECT e.session, e.i, CASE WHEN undo THEN stack[:len(stack) - 1] ELSE list_append(stack, seq)[greatest(1, len(stack) - 48):] END, CASE WHEN undo THEN stack[len(stack)] END
         FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1)
       SELECT session, CAST(chunk_id AS BIGINT) AS chunk_id, arg_max(event_type, seq) AS label FROM e WHERE NOT undo AND seq NOT IN (SELECT popped FROM r WHERE popped IS NOT NULL) GROUP BY ALL""",
)
def ses_current_labels(spark, sf_dir):
    # errors and every third event take the one before back
    undo = (F.col("event_type") == "error") | (F.col("event_id") % 3 == 0)
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(undo, "undo").otherwise("set"))
    e = e.select((F.col("user_id") % 20).alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("chunk_id"), "kind", F.col("event_type").alias("label"))
    return sessions.current_labels(e)


@register(
    "ses_edits",
    """WITH e AS (SELECT conv_id AS chunk_id, turn, c.text, role FROM conversations c JOIN documents d ON d.doc_id = conv_id)
       SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY turn) AS INTEGER) AS version, role AS edit_reason, 'ed_' || substr(sha256(e.text), 1, 16) AS edited_chunk_id,
              row_number() OVER (PARTITION BY chunk_id ORDER BY turn DESC) = 1 AS is_current_version FROM e""",
)
def ses_edits(spark, sf_dir):
    e = edits_of(spark, sf_dir)
    first = e.limit(0).withColumn("version", F.col("version").cast("int"))  # a log without edits
    new = e.withColumnRenamed("version", "at")
    return sessions.add_edits(first, new, chunks_of(spark, sf_dir)).select("chunk_id", "version", "edit_reason", "edited_chunk_id", "is_current_version")


@register(
    "ses_progress",
    "SELECT count(*) AS total, count(l.doc_id) AS annotated, 100.0::DOUBLE * count(l.doc_id) / count(*) AS percent FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def ses_progress(spark, sf_dir):
    return sessions.progress(chunks_of(spark, sf_dir), notes_of(spark, sf_dir))


@register(
    "ml_training_records",
    r"""SELECT d.doc_id AS chunk_id, 1 - quality AS label, source AS source_session, len(regexp_extract_all(text, '\S+')) AS word_count FROM documents d JOIN labels USING (doc_id)""",
)
def ml_training_records(spark, sf_dir):
    from scriptora.functions import text

    d = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "source", text.word_count(F.col("text")).cast("long").alias("word_count"))
    r = sessions.training_records(d, notes_of(spark, sf_dir), F.col("source"))
    return r.select("chunk_id", "label", "source_session", F.col("features.word_count").alias("word_count"))


@register(
    "arc_links",
    """WITH l AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"#]*)"[^>]*>', 1)) AS href FROM pages)
       SELECT count(DISTINCT regexp_extract(src, '^(https?://[^/]+)', 1) || href) AS n FROM l WHERE starts_with(href, '/')""",
)
def arc_links(spark, sf_dir):
    return archive.links(table(spark, sf_dir, "pages"), "^/").agg(F.count("*").alias("n"))


@register("arc_valid_downloads", "SELECT page_id, page_id % 4 NOT IN (1, 2, 3) AND length(html) > 0 AND regexp_matches(html, '(?i)<body') AS valid FROM pages")
def arc_valid_downloads(spark, sf_dir):
    k = F.col("page_id") % 4  # some empty, without a body, or null
    html = F.when(k == 1, "").when(k == 2, F.regexp_replace("html", "(?i)<body", "<main")).when(k == 0, F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", archive.valid_download(html).alias("valid"))


@register(
    "arc_image_names",
    """SELECT page_id, 'page_' || page_id || '_' || substr(md5(url || '/a.png'), 1, 12) || '.png' AS name FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages)""",
)
def arc_image_names(spark, sf_dir):
    url = F.concat(F.substring_index(F.substring_index("url", "?", 1), "#", 1), F.lit("/a.png"))
    return table(spark, sf_dir, "pages").select("page_id", archive.image_name(url, F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("name"))


@register("arc_images")
def arc_images(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.concat("html", F.lit('<img src="/a/b.png" alt="x"><img data-src="c.jpg"><img src="logo.png">')).alias("html"))
    return archive.images(p)


@register(
    "arc_sections",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'bible' WHEN 'click' THEN 'canon_law' ELSE 'other' END AS folder FROM events""",
)
def arc_sections(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "BIBLE").when(F.col("event_type") == "click", "CANON_LAW").otherwise("x")
    return table(spark, sf_dir, "events").select("event_id", archive.section_folder(kind).alias("folder"))


@register(
    "arc_numbered",
    """SELECT doc_id % 10 AS doc_id, CAST(doc_id % 7 + 1 AS INTEGER) AS number, length(arg_max(t, (length(t), t))) AS n
       FROM (SELECT doc_id, trim(regexp_extract(doc_id % 7 + 1 || ' ' || text, '(?s)^\\s*[0-9]{1,4}\\s+(\\S.*)$', 1)) AS t FROM documents) WHERE t <> '' GROUP BY ALL""",
)
def arc_numbered(spark, sf_dir):
    d = documents(spark, sf_dir)
    lines = d.select((F.col("doc_id") % 10).alias("doc_id"), F.concat((F.col("doc_id") % 7 + 1).cast("string"), F.lit(" "), F.col("text")).alias("text"))
    return archive.numbered_paragraphs(lines).select("doc_id", "number", F.length("text").cast("long").alias("n"))


@register("e2e_extraction")
def e2e_extraction(spark, sf_dir):
    """Documents to chunks and their counts, in the order of a whole extraction."""
    x = Extraction(spark, load({"levels": 2})).load(documents(spark, sf_dir).select("doc_id", "text")).parse()
    x.chunk()
    return x.metadata().select("doc_id", "words", "word_count", "pages")
