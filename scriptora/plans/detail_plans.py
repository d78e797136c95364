"""Single rules over the driver's tables: formats, links, headings, footnotes, reference blocks, reports of edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptora.functions import noise, refs, text
from scriptora.operators import analysis, corpus, headings, parsers
from scriptora.plans import sql
from scriptora.plans.corpus_plans import chunks_of, edits_of, notes_of, table
from scriptora.plans.text_plans import documents, paragraphs
from scriptora.registry import register
from scriptora.sources import sinks


@register(
    "src_format",
    """SELECT event_id, CASE lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'epub' THEN 'epub' WHEN 'htm' THEN 'html' WHEN 'html' THEN 'html' WHEN 'json' THEN 'json'
         WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'markdown' WHEN 'pdf' THEN 'pdf' END AS format
       FROM (SELECT event_id, 'a/b.' || (['epub','HTM','html','json','md','txt','pdf','doc'])[event_id % 8 + 1] AS p FROM events)""",
)
def src_format(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("epub", "HTM", "html", "json", "md", "txt", "pdf", "doc")])
    path = F.concat(F.lit("a/b."), F.get(ends, (F.col("event_id") % 8).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", parsers.format_of(path).alias("format"))


@register(
    "src_front_matter",
    "SELECT doc_id, 'lang ' || lang || ', source ' || source AS meta, md5(text) AS h FROM documents",
)
def src_front_matter(spark, sf_dir):
    d = documents(spark, sf_dir)
    content = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nno pair\nsource: x\nsource: "), "source", F.lit("\n---\n"), "text")
    body, meta = parsers.front_matter(content)
    return d.select("doc_id", meta.alias("m"), body.alias("b")).select("doc_id", F.concat(F.lit("lang "), F.col("m")["lang"], F.lit(", source "), F.col("m")["source"]).alias("meta"), F.md5("b").alias("h"))


@register(
    "src_norm_href",
    """SELECT page_id, split_part(regexp_replace('../' || split_part(url, '/', 4) || '#x', '^[./]+', ''), '#', 1) AS href FROM pages""",
)
def src_norm_href(spark, sf_dir):
    href = F.concat(F.lit("../"), F.split_part("url", F.lit("/"), F.lit(4)), F.lit("#x"))
    return table(spark, sf_dir, "pages").select("page_id", parsers.norm_href(href).alias("href"))


@register(
    "prs_heading_like",
    f"""WITH {sql.PARAGRAPHS}, w AS (SELECT doc_id, paragraph_id, text, regexp_extract_all(text, '\\S+') AS w FROM paragraphs)
        SELECT doc_id, paragraph_id, len(w) BETWEEN 1 AND 15 AND ((upper(text) = text AND lower(text) <> text) OR len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / len(w) > 0.7) AS heading FROM w""",
)
def prs_heading_like(spark, sf_dir):
    p = paragraphs(spark, sf_dir).withColumn("w", text.words(F.col("text")))
    return p.select("doc_id", F.col("paragraph_id").cast("long").alias("paragraph_id"), headings.heading_like(F.col("text"), F.col("w")).alias("heading"))


@register(
    "prs_font_sizes",
    """WITH s AS (SELECT event_id, value AS v, (['em','%','pt','px'])[event_id % 4 + 1] AS u FROM events),
       e AS (SELECT event_id, v >= CASE u WHEN '%' THEN 130 WHEN 'pt' THEN 16 WHEN 'px' THEN 20 ELSE 1.3 END AS large, v / CASE u WHEN '%' THEN 100 WHEN 'pt' THEN 12 WHEN 'px' THEN 16 ELSE 1 END AS em FROM s)
       SELECT event_id, large, CASE WHEN em >= 2 THEN 1 WHEN em >= 1.5 THEN 2 WHEN em >= 1.3 THEN 3 ELSE 2 END AS level FROM e""",
)
def prs_font_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    unit = F.get(F.array(*[F.lit(x) for x in ("em", "%", "pt", "px")]), (F.col("event_id") % 4).cast("int"))
    style = F.concat(F.lit("color: red; Font-Size : "), F.col("value").cast("string"), unit)
    return e.select("event_id", headings.is_large(style).alias("large"), headings.level_of_size(style).alias("level"))


@register(
    "prs_footnotes",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN n::VARCHAR WHEN 1 THEN n::VARCHAR WHEN 2 THEN '' ELSE '' END AS notes FROM (SELECT event_id, event_id % 998 + 1 AS n FROM events)""",
)
def prs_footnotes(spark, sf_dir):
    n = (F.col("event_id") % 998 + 1).cast("string")
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.concat(F.lit("A word. "), n)).when(k == 1, F.concat(F.lit("A word ["), n, F.lit("]."))).when(k == 2, F.concat(F.lit("John 3:"), n)).otherwise(F.concat(F.lit("About 3."), n))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(refs.trailing_footnotes(s), ",").alias("notes"))


@register(
    "nse_reference_block",
    """SELECT doc_id, doc_id % 3 = 0 AS found, CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE -1 END::INTEGER AS start, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS count FROM documents""",
)
def nse_reference_block(spark, sf_dir):
    block = F.lit("\n1. Smith, Book (2001), 12-14.\n2. Ibid, 3.\n3. Jones, trans. Lee (1999).")
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, block).otherwise(F.lit("")))
    d = documents(spark, sf_dir).select("doc_id", noise.reference_block(t).alias("r"))
    return d.select("doc_id", "r.found", "r.start", "r.count")


_NAMES = ", ".join("'" + " ".join(n.split()).replace("'", "''") + "'" for n in analysis.CHURCH_DOCUMENTS)


@register(
    "anl_mentioned",
    f"""SELECT doc_id, array_to_string(list_sort(list_filter([{_NAMES}], lambda n: contains(lower(text || CASE WHEN doc_id % 2 = 0 THEN ' After TRENT came dei verbum.' ELSE '' END), lower(n)))), ';') AS names
        FROM documents""",
)
def anl_mentioned(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " After TRENT came dei verbum.").otherwise(""))
    return documents(spark, sf_dir).select("doc_id", F.array_join(analysis.mentioned(t), ";").alias("names"))


@register(
    "anl_footnote_rollup",
    """WITH c AS (SELECT user_id AS doc_id, event_id % 9 AS number, count(*) AS n FROM events GROUP BY ALL)
       SELECT doc_id, string_agg(number::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY number) AS counts FROM c GROUP BY doc_id""",
)
def anl_footnote_rollup(spark, sf_dir):
    r = analysis.footnote_rollup(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 9).alias("number")))
    pairs = F.transform("unique_citations", lambda x: F.concat(x.cast("string"), F.lit(":"), F.element_at("counts", x.cast("string")).cast("string")))
    return r.select("doc_id", F.array_join(pairs, ",").alias("counts"))


@register("chk_hierarchy_shift", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' / b' ELSE source END AS path, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS depth FROM documents")
def chk_hierarchy_shift(spark, sf_dir):
    h = text.hierarchy(level_1=F.col("source"), level_2=F.col("lang"), level_3=F.lit("a"), level_4=F.when(F.col("doc_id") % 2 == 0, "b"))
    d = documents(spark, sf_dir).select("doc_id", headings.shift_down(h, 2).alias("h"))
    return d.select("doc_id", text.heading_path(F.col("h")).alias("path"), text.hierarchy_depth(F.col("h")).alias("depth"))


@register("txt_context_prefix", "SELECT doc_id, 'Document: ' || source || ' by ' || lang || chr(10) || 'Section: x' AS prefix FROM documents")
def txt_context_prefix(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.context_prefix(F.col("source"), F.col("lang"), F.lit("x")).alias("prefix"))


@register(
    "snk_by_label",
    "SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS label_name, count(*) AS n FROM labels GROUP BY ALL",
)
def snk_by_label(spark, sf_dir):
    return sinks.by_label(notes_of(spark, sf_dir)).groupBy("label_name").agg(F.count("*").alias("n"))


@register(
    "snk_audit",
    """SELECT d.doc_id AS chunk_id, count(c.turn) AS versions, coalesce(string_agg(c.role, ',' ORDER BY c.turn), '') AS reasons FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id""",
)
def snk_audit(spark, sf_dir):
    a = sinks.audit(chunks_of(spark, sf_dir), edits_of(spark, sf_dir))
    none = F.array().cast("array<string>")
    reasons = F.coalesce(F.col("lineage.edit_reason"), none)
    return a.select("chunk_id", F.size(reasons).cast("long").alias("versions"), F.array_join(reasons, ",").alias("reasons"))


@register(
    "snk_diff_report",
    """WITH e AS (SELECT conv_id AS chunk_id, max(turn) AS version, arg_max(text, turn) AS edited, arg_max(role, turn) AS reason, count(*) AS k, string_agg('v' || turn || ' ' || role, '; ' ORDER BY turn) AS versions FROM conversations GROUP BY conv_id)
       SELECT chunk_id, md5('## Chunk ' || chunk_id || ' (version ' || version || ')' || chr(10) || chr(10) || '**Original**:' || chr(10) || '```' || chr(10) || d.text || chr(10) || '```' || chr(10) || chr(10) || '**Edited**:' || chr(10) || '```' || chr(10)
         || edited || chr(10) || '```' || chr(10) || chr(10) || '**Reason**: ' || reason || chr(10) || CASE WHEN k > 1 THEN '**Versions**: ' || versions || chr(10) ELSE '' END) AS h FROM e JOIN documents d ON d.doc_id = chunk_id""",
)
def snk_diff_report(spark, sf_dir):
    c = chunks_of(spark, sf_dir)
    r = sinks.diff_report(c, edits_of(spark, sf_dir))
    return r.select("chunk_id", F.md5("text").alias("h"))


@register(
    "snk_manifest",
    "SELECT lang, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY lang",
)
def snk_manifest(spark, sf_dir):
    return sinks.manifest(documents(spark, sf_dir), "lang")


@register(
    "rel_union_latest_index",
    "SELECT url, min(k) AS k FROM (SELECT url, 1 AS k FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 2 AS k FROM pages) GROUP BY url",
)
def rel_union_latest_index(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    index = p.where("page_id % 2 = 0").select("url", F.lit(1).alias("k")).distinct()
    return corpus.add_to_index(index, p.select("url", F.lit(2).alias("k")))
