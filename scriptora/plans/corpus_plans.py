"""Chunking, parsing, analysis, corpus and index queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptora.functions import identity, refs, text
from scriptora.operators import analysis, chunking, corpus, parsers
from scriptora.operators.paragraphs import enrich_nested, unnest
from scriptora.plans import sql
from scriptora.plans.text_plans import PLANTED_SQL, documents, nested_paragraphs, paragraphs, planted
from scriptora.registry import register
from scriptora.sources.shared import checkpointed


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed_sql(most: int) -> str:
    return f"""RECURSIVE {sql.PARAGRAPHS},
    p AS (SELECT doc_id, source, lang, paragraph_id AS id, text, word_count AS n FROM paragraphs),
    r AS (SELECT doc_id, id, n AS total, 0 AS bin FROM p WHERE id = 1
          UNION ALL SELECT p.doc_id, p.id, CASE WHEN r.total + p.n > {most} THEN p.n ELSE r.total + p.n END, r.bin + (CASE WHEN r.total + p.n > {most} THEN 1 ELSE 0 END)
          FROM r JOIN p ON p.doc_id = r.doc_id AND p.id = r.id + 1),
    c AS (SELECT p.doc_id, bin, min(p.id) AS paragraph_id, string_agg(text, chr(10) || chr(10) ORDER BY p.id) AS text, sum(n) AS n, count(*) AS k, any_value(source) AS source, any_value(lang) AS lang
          FROM r JOIN p USING (doc_id, id) GROUP BY p.doc_id, bin),
    f AS (SELECT *, max(bin) OVER (PARTITION BY doc_id) = bin AND n < 100 AS small FROM c)"""


@register(
    "chk_rag",
    f"""WITH {_packed_sql(500)} SELECT doc_id, paragraph_id, substr(sha1(text), 1, 16) AS stable_id, len(regexp_extract_all(text, '\\S+')) AS word_count,
        k AS source_paragraph_count, source || ' / ' || lang AS heading_path, small FROM f""",
)
def chk_rag(spark, sf_dir):
    c = chunking.merge_by_words(nested_paragraphs(spark, sf_dir))
    return c.select(
        "doc_id",
        F.col("paragraph_id").cast("long").alias("paragraph_id"),
        "stable_id",
        F.col("word_count").cast("long").alias("word_count"),
        F.col("source_paragraph_count").cast("long").alias("source_paragraph_count"),
        "heading_path",
        F.col("quality_flags").isNotNull().alias("small"),
    )


@register(
    "chk_rag_drop_small",
    f"WITH {_packed_sql(300)} SELECT source, count(*) AS n, CAST(sum(n) AS BIGINT) AS words, max(k) AS most FROM f WHERE NOT small GROUP BY source",
)
def chk_rag_drop_small(spark, sf_dir):
    c = chunking.merge_by_words(nested_paragraphs(spark, sf_dir), chunking.ChunkConfig(max_words=300, keep_small=False))
    g = c.groupBy(F.col("hierarchy.level_1").alias("source"))
    words = F.size(text.words(F.col("text")))
    return g.agg(F.count("*").alias("n"), F.sum(words).cast("long").alias("words"), F.max("source_paragraph_count").cast("long").alias("most"))


@register("chk_token_aware")
def chk_token_aware(spark, sf_dir):
    return chunking.token_aware(chunking.nest(nested_paragraphs(spark, sf_dir, spaced_caps=True)))


@register("chk_small_to_big")
def chk_small_to_big(spark, sf_dir):
    return chunking.parents_and_children(chunking.nest(nested_paragraphs(spark, sf_dir, spaced_caps=True)), chunking.TokenConfig(max_tokens=128))


@register("chk_rechunk")
def chk_rechunk(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", identity.stable_id(F.col("doc_id")).alias("stable_id"), "text", text.sentences(F.col("text")).alias("sentences"))
    return chunking.rechunk(d)


@register("agg_rechunk_statistics")
def agg_rechunk_statistics(spark, sf_dir):
    return chunking.rechunk_statistics(chk_rechunk(spark, sf_dir))


@register("chk_merged_fields")
def chk_merged_fields(spark, sf_dir):
    c = chunking.merge_by_words(enrich_nested(nested_paragraphs(spark, sf_dir, spaced_caps=True)))
    return c.select("doc_id", "stable_id", "paragraph_id", "sentence_count", "content_type", "dates_mentioned")


@register(
    "prs_markdown",
    f"""SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS paragraph_id, md5(t) AS h, 'p' AS source_tag, role AS level_2, 'conversation' AS level_1
        FROM (SELECT conv_id, turn, role, {sql.clean("replace(text, chr(10), ' ')")} AS t FROM conversations) WHERE t <> ''""",
)
def prs_markdown(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), x["text"], F.lit("\n\n"))), "")
    d = turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("# conversation\n\n"), body).alias("text"))
    p = parsers.markdown_paragraphs(d, spaced_caps=False)
    return p.select("doc_id", F.col("paragraph_id").cast("long").alias("paragraph_id"), F.md5("text").alias("h"), "source_tag", F.col("hierarchy.level_2").alias("level_2"), F.col("hierarchy.level_1").alias("level_1"))


@register("prs_html")
def prs_html(spark, sf_dir):
    return parsers.html_paragraphs(table(spark, sf_dir, "pages"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_PAGE = f"""SELECT page_id AS doc_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
    lower(regexp_extract(html, '(?is)<html[^>]*\\blang\\s*=\\s*["'']?([\\w-]+)', 1)) AS lang, len(regexp_extract_all({_BARE}, '(?i)<p[\\s>]')) AS n_p,
    len(regexp_extract_all({_BARE}, '(?i)<a[\\s>]')) AS n_a, len(regexp_extract_all(regexp_replace({_BARE}, '<[^>]*>', '', 'g'), '[^\\s\\x{{00A0}}]+')) AS n_w FROM pages"""


@register(
    "src_page_metadata",
    f"""WITH p AS ({_PAGE}) SELECT doc_id, replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title,
        lang, n_p AS n_paragraphs, n_a AS n_links, n_w AS n_words FROM p""",
)
def src_page_metadata(spark, sf_dir):
    m = parsers.html_metadata(table(spark, sf_dir, "pages"))
    return m.select("doc_id", "title", "lang", *[F.col(c).cast("long").alias(c) for c in ("n_paragraphs", "n_links", "n_words")])


@register(
    "src_page_predicates",
    f"""WITH p AS ({_PAGE}) SELECT doc_id, n_p >= 3 AND n_w >= 100 AND n_a <= 3 * n_p AS is_document,
        CASE WHEN regexp_matches(url, '(?i)/eng[0-9]+/|_en\\.html?$|/en/|/english/') THEN true WHEN lang LIKE 'en%' THEN true WHEN lang <> '' THEN false
             ELSE regexp_matches(lower(title), 'english|catechism|new american bible') END AS is_english FROM p""",
)
def src_page_predicates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    m = parsers.html_metadata(pages).join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    return m.select("doc_id", parsers.is_document_page(F.col("n_paragraphs"), F.col("n_words"), F.col("n_links")).alias("is_document"), parsers.is_english(F.col("url"), F.col("lang"), F.col("title")).alias("is_english"))


@register(
    "src_links",
    "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages",
)
def src_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@register(
    "src_crawl",
    """WITH RECURSIVE links AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
       r AS (SELECT 1 AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN links ON src = url WHERE depth < 3)
       SELECT CAST(url AS BIGINT) AS url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url""",
)
def src_crawl(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return corpus.crawl(spark.range(1, 2).withColumnRenamed("id", "url"), links)


@register(
    "ded_paragraphs",
    f"WITH {sql.PARAGRAPHS}, k AS (SELECT doc_id, text, min(paragraph_id) AS paragraph_id FROM paragraphs GROUP BY ALL) SELECT doc_id, paragraph_id, md5(text) AS h FROM k",
)
def ded_paragraphs(spark, sf_dir):
    d = unnest(corpus.deduplicate_nested(nested_paragraphs(spark, sf_dir)), F.col("ps"), "p", "doc_id")
    return d.select("doc_id", F.col("p.paragraph_id").cast("long").alias("paragraph_id"), F.md5("p.text").alias("h"))


def _case(table_, expr: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, '{p}') THEN '{n}'" for n, p in table_) + f" ELSE '{otherwise}' END"


@register(
    "anl_types",
    f"""WITH {PLANTED_SQL} SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'Document' WHEN len(regexp_extract_all(text, '```')) > 5 THEN 'Technical Document'
          WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*[0-9]') AND contains(substr(x, 1, 5), '.'))) > 10 THEN 'Manual'
          WHEN length(text) < 5000 AND contains(text, chr(10) || chr(10)) THEN 'Article' ELSE 'Document' END AS generic,
        {_case(analysis.CHURCH_TYPES, 'lower(text)', '')} AS church, {_case(analysis.CHURCH_PLACES, 'lower(text)', '')} AS place FROM planted""",
)
def anl_types(spark, sf_dir):
    t = F.col("text")
    return planted(spark, sf_dir).select("doc_id", analysis.generic_type(t).alias("generic"), analysis.first_match(t, analysis.CHURCH_TYPES).alias("church"), analysis.first_match(t, analysis.CHURCH_PLACES).alias("place"))


@register(
    "anl_subjects",
    f"WITH {PLANTED_SQL} SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in analysis.CHURCH_SUBJECTS)
    + "], lambda x: x IS NOT NULL), ',') AS subjects FROM planted",
)
def anl_subjects(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", F.array_join(analysis.all_matches(F.col("text"), analysis.CHURCH_SUBJECTS), ",").alias("subjects"))


# a page's title with one of the words that tell what it is
_KINDS = ("", *[p.split("|")[-1] for _, p in analysis.TITLE_TYPES])


@register(
    "anl_title_types",
    f"WITH p AS ({_PAGE}), t AS (SELECT doc_id, title || ' ' || ([{', '.join(map(sql.quoted, _KINDS))}])[doc_id % {len(_KINDS)} + 1] AS title FROM p) SELECT doc_id, {_case(analysis.TITLE_TYPES, 'lower(title)', 'Document')} AS kind FROM t",
)
def anl_title_types(spark, sf_dir):
    m = parsers.html_metadata(table(spark, sf_dir, "pages"))
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % len(_KINDS)).cast("int"))
    return m.select("doc_id", analysis.first_match(F.concat_ws(" ", "title", kind), analysis.TITLE_TYPES, "Document").alias("kind"))


@register(
    "anl_counts",
    f"""WITH {sql.PARAGRAPHS}, g AS (SELECT doc_id, CAST(sum(word_count) AS BIGINT) AS words FROM paragraphs GROUP BY doc_id)
        SELECT doc_id, words, 'approximately ' || format('{{:,}}', words) AS word_count, 'approximately ' || greatest(1, words // 250) AS pages FROM g""",
)
def anl_counts(spark, sf_dir):
    return analysis.counts(paragraphs(spark, sf_dir))


@register(
    "anl_themes",
    f"WITH {sql.PARAGRAPHS} SELECT doc_id, source || ';' || lang AS themes, source || ';' || lang AS subject FROM paragraphs GROUP BY ALL",
)
def anl_themes(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    j = analysis.themes(p).join(analysis.subjects(p), "doc_id")
    return j.select("doc_id", F.array_join("key_themes", ";").alias("themes"), F.array_join("subject", ";").alias("subject"))


@register(
    "anl_promulgation",
    f"""WITH {PLANTED_SQL} SELECT doc_id, CASE WHEN len(d) = 0 THEN '' WHEN near <> '' THEN near ELSE d[1] END AS date FROM (SELECT doc_id,
        list_sort(list_distinct({' || '.join(f"regexp_extract_all(text, '{p}')" for p in refs.DATE_PATTERNS)})) AS d,
        regexp_extract(text, '(?i)(?:published|issued|given|promulgated?).*?({refs.MONTH_DAY_YEAR})', 1) AS near FROM planted)""",
)
def anl_promulgation(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("d", refs.dates(F.col("text")))
    return d.select("doc_id", analysis.promulgation_date(F.col("text"), F.col("d")).alias("date"))


@register(
    "anl_questions",
    "SELECT doc_id, 'What is ' || lang || '?|What does ' || lang || ' cover in ' || source || '?|What does Corpus say about ' || lang || '?' AS questions FROM documents",
)
def anl_questions(spark, sf_dir):
    d = documents(spark, sf_dir)
    h = text.hierarchy(level_1=F.col("source"), level_2=F.col("lang"))
    q = analysis.questions(h, F.lit("prose"), F.col("text"), F.lit("Corpus"), F.array().cast("array<string>"))
    return d.select("doc_id", F.array_join(q, "|").alias("questions"))


@register(
    "snk_hierarchy_report",
    f"""WITH {sql.PARAGRAPHS} SELECT source AS level_1, lang AS level_2, min(paragraph_id) AS first_paragraph, max(paragraph_id) AS last_paragraph,
        CAST(sum(word_count) AS BIGINT) AS words, count(*) AS paragraphs FROM paragraphs GROUP BY ALL""",
)
def snk_hierarchy_report(spark, sf_dir):
    from scriptora.sources.sinks import hierarchy_report

    r = hierarchy_report(paragraphs(spark, sf_dir).withColumn("doc_id", F.lit(0)))
    return r.select("level_1", "level_2", *[F.col(c).cast("long").alias(c) for c in ("first_paragraph", "last_paragraph", "words", "paragraphs")])


# Labels of documents stand for annotations (quality 1: good, so label 0), turns of conversations for versions of edits.
_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, text, (doc_id % 100) / 100.0 AS quality_score FROM documents)"
_NOTES = "notes AS (SELECT doc_id AS chunk_id, 1 - quality AS label FROM labels)"
_EDITS = "edits AS (SELECT conv_id AS chunk_id, turn AS version, text AS edited_text, role AS edit_reason FROM conversations)"


def chunks_of(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", ((F.col("doc_id") % 100) / 100.0).alias("quality_score"))


def notes_of(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), (1 - F.col("quality")).alias("label"))


def edits_of(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("version"), F.col("text").alias("edited_text"), F.col("role").alias("edit_reason"))


_LATEST = "latest AS (SELECT chunk_id, arg_max(edited_text, version) AS edited_text, arg_max(edit_reason, version) AS edit_reason, count(*) AS edit_version FROM edits GROUP BY chunk_id)"


@register(
    "agg_corpus",
    f"""WITH {_CHUNKS}, {_NOTES}, {_EDITS}, {_LATEST} SELECT chunk_id, md5(coalesce(edited_text, text)) AS h, edited_text IS NOT NULL AS edited, edit_version
        FROM chunks JOIN notes USING (chunk_id) LEFT JOIN latest USING (chunk_id) WHERE label = 0 AND quality_score >= 0.2""",
)
def agg_corpus(spark, sf_dir):
    c = corpus.build_corpus(chunks_of(spark, sf_dir), notes_of(spark, sf_dir), edits_of(spark, sf_dir), 0.2)
    return c.select("chunk_id", F.md5("text").alias("h"), "edited", "edit_version")


@register(
    "agg_corpus_statistics",
    f"""WITH {_CHUNKS}, {_NOTES}, {_EDITS}, j AS (SELECT quality_score >= 0.2 AS ok, chunk_id IN (SELECT chunk_id FROM edits) AS e FROM chunks JOIN notes USING (chunk_id) WHERE label = 0)
        SELECT count(*) FILTER (ok) AS good_chunks, count(*) FILTER (ok AND e) AS edited_chunks, count(*) FILTER (NOT ok) AS quality_filtered FROM j""",
)
def agg_corpus_statistics(spark, sf_dir):
    return corpus.corpus_statistics(chunks_of(spark, sf_dir), notes_of(spark, sf_dir), edits_of(spark, sf_dir), 0.2)


@register(
    "ml_balance",
    f"""WITH {_CHUNKS}, {_NOTES}, j AS (SELECT chunk_id, label, row_number() OVER (PARTITION BY label ORDER BY round(quality_score, 4) DESC, sha1('42|' || chunk_id::VARCHAR), chunk_id) AS r FROM chunks JOIN notes USING (chunk_id)),
        m AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM j GROUP BY label)) SELECT chunk_id, label FROM j, m WHERE r <= k""",
)
def ml_balance(spark, sf_dir):
    return corpus.balance(chunks_of(spark, sf_dir).join(notes_of(spark, sf_dir), "chunk_id")).select("chunk_id", "label")


@register(
    "ml_split",
    f"""WITH {_NOTES}, j AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('42|' || chunk_id::VARCHAR), chunk_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM notes)
        SELECT chunk_id, label, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM j""",
)
def ml_split(spark, sf_dir):
    return corpus.train_test_split(notes_of(spark, sf_dir))


@register(
    "ml_diversity_sample",
    f"""WITH {_CHUNKS}, {_NOTES}, u AS (SELECT chunk_id, CAST(floor(quality_score * 10) AS BIGINT) AS decile FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM notes)),
        t AS (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY sha1('42|' || chunk_id::VARCHAR)) AS turn FROM u)
        SELECT chunk_id, decile FROM t ORDER BY decile >= 10, turn, decile LIMIT 50""",
)
def ml_diversity_sample(spark, sf_dir):
    return corpus.diversity_sample(chunks_of(spark, sf_dir), notes_of(spark, sf_dir), 50).select("chunk_id", "decile")


@register(
    "ml_uncertainty_sample",
    f"WITH {_CHUNKS}, {_NOTES} SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM notes) ORDER BY abs(quality_score - 0.5), chunk_id LIMIT 25",
)
def ml_uncertainty_sample(spark, sf_dir):
    c = chunks_of(spark, sf_dir).select("chunk_id", F.col("quality_score").alias("probability"))
    return corpus.uncertainty_sample(c, notes_of(spark, sf_dir), 25).select("chunk_id")


_SHARE = "coalesce(len(list_filter(w, lambda x: {})) / greatest(len(w), 1), 0)"
_FEATURES = {
    "word_count": "len(w)",
    "text_length": "length(text)",
    "avg_sentence_length": "len(w) / greatest(k, 1)",
    "chars_per_word": "length(text) / greatest(len(w), 1)",
    "tokens_per_word": "len(w) / greatest(len(w), 1)",
    "unique_words_ratio": "len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(len(w), 1)",
    "stopword_ratio": _SHARE.format("lower(x) IN ('a','an','and','at','but','for','in','on','or','the','to')"),
    "punctuation_density": "len(regexp_extract_all(text, '[.,;:!?]')) / greatest(length(text), 1)",
    "number_token_ratio": _SHARE.format("regexp_matches(x, '^[0-9]+$')"),
    "capital_ratio": r"len(regexp_extract_all(text, '\p{Lu}')) / greatest(length(text), 1)",
    "number_density": _SHARE.format(r"NOT regexp_matches(x, '[\pL\pM\p{Nl}\p{Pc}]')"),
    "token_word_ratio": "len(w) / greatest(len(w), 1)",
    "reference_pattern_density": r"len(regexp_extract_all(text, '[0-9]+:[0-9]+(-[0-9]+)?')) / greatest(len(w), 1)",
    "short_line_ratio": r"len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\S+')) < 5)) / len(string_split(text, chr(10)))",
    "nav_keyword_presence": "CASE WHEN regexp_matches(lower(text), 'back|contents|index|next|page|previous') THEN 1 ELSE 0 END",
    "sentence_count": "k",
    "hierarchy_depth": "k % 2",
    "scripture_density": "(k % 3) / greatest(len(w) / 1000, 1)",
    "cross_ref_density": "(k % 4) / greatest(len(w) / 1000, 1)",
    "date_density": "(k % 5) / greatest(len(w) / 1000, 1)",
    "has_hierarchy": "k % 2",
    "position_normalized": "chunk_id / 1000",
    "hierarchy_consistency": "(k % 2) / 1",
    "garble_rate": "k / 10",
    "mean_conf": "1 - k / 10",
    "line_len_std_norm": "k / 20",
}


@register(
    "ml_features",
    rf"WITH {PLANTED_SQL}, w AS (SELECT doc_id AS chunk_id, doc_id % 7 AS k, text, regexp_extract_all(text, '\S+') AS w FROM planted) SELECT chunk_id, "
    + ", ".join(f"round(({e})::DOUBLE, 6) AS {k}" for k, e in _FEATURES.items())
    + " FROM w",
)
def ml_features(spark, sf_dir):
    k, i = F.col("doc_id") % 7, F.col("doc_id")
    some = lambda n: F.slice(F.array(*[F.lit(x) for x in "abcd"]), 1, n.cast("int"))
    d = planted(spark, sf_dir).select(
        i.alias("chunk_id"), "text", text.word_count(F.col("text")).alias("word_count"), k.alias("sentence_count"), i.alias("source_order"), text.hierarchy(level_1=F.when(k % 2 == 1, "a")).alias("hierarchy"),
        some(k % 3).alias("scripture_references"), some(k % 4).alias("cross_references"), some(k % 5).alias("dates_mentioned"), (k / 10).alias("garble_rate"), (1 - k / 10).alias("mean_conf"), (k / 20).alias("line_len_std_norm"),
    )
    f = corpus.features(d)
    return f.select("chunk_id", *[F.round(c, 6).alias(c) for c in _FEATURES])


@register("ml_classifier")
def ml_classifier(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", text.word_count(F.col("text")).alias("word_count"))
    f = checkpointed(corpus.features(d))  # training goes over its rows many times
    model = corpus.train_classifier(f.join(notes_of(spark, sf_dir), "chunk_id"))
    return corpus.predict(model, f)


@register(
    "agg_session_statistics",
    "SELECT lang AS session, count(*) AS total, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS skipped FROM labels JOIN documents USING (doc_id) GROUP BY lang",
)
def agg_session_statistics(spark, sf_dir):
    n = notes_of(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("session")), "chunk_id")
    return corpus.session_statistics(n)


@register(
    "agg_issue_counts",
    "SELECT issue, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter([CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL))) AS issue FROM labels) GROUP BY issue",
)
def agg_issue_counts(spark, sf_dir):
    issues = F.array_compact(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return corpus.issue_counts(table(spark, sf_dir, "labels").select(issues.alias("issues")))


@register(
    "agg_index_summary",
    """WITH i AS (SELECT split_part(url, '/', 3) AS section, page_id % 2 = 0 AS downloaded, page_id % 4 = 0 AS processed FROM pages)
       SELECT section, count(*) AS total, count(*) FILTER (downloaded) AS downloaded, count(*) FILTER (processed) AS processed, count(*) FILTER (downloaded AND NOT processed) AS pending
       FROM i GROUP BY ROLLUP (section)""",
)
def agg_index_summary(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("section"), (F.col("page_id") % 2 == 0).alias("downloaded"), (F.col("page_id") % 4 == 0).alias("processed"))
    return corpus.index_summary(p)


@register(
    "agg_storage",
    "SELECT split_part(url, '/', 3) AS host, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY ALL",
)
def agg_storage(spark, sf_dir):
    from scriptora.operators.exports import storage_statistics

    p = table(spark, sf_dir, "pages").withColumn("size", F.length("html"))
    return storage_statistics(p, F.split_part("url", F.lit("/"), F.lit(3))).withColumnRenamed("place", "host")


@register(
    "snk_object_path",
    """SELECT page_id, 'archive/' || trim(substr(regexp_replace(regexp_replace(lower(url), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '_', 'g'), 1, 100), '_') || '_' || substr(md5(url), 1, 8) || '.json' AS path FROM pages""",
)
def snk_object_path(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", identity.object_path(F.lit("archive"), text.slug(u), u, ".json").alias("path"))


_BOUNDS = "b AS (SELECT doc_id, paragraph_id AS id, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM paragraphs)"


@register(
    "rel_boundaries",
    f"""WITH {sql.PARAGRAPHS}, b AS (SELECT doc_id, paragraph_id AS chunk_id, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM paragraphs)
        SELECT doc_id, chunk_id, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end" FROM b""",
)
def rel_boundaries(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    b = corpus.boundaries(p.select("doc_id", F.col("paragraph_id").cast("long").alias("chunk_id"), "paragraph_id", "text", F.lit("").alias("path")))
    return b.select("doc_id", "chunk_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@register(
    "rel_range_join",
    f"""WITH {sql.PARAGRAPHS}, b AS (SELECT doc_id, paragraph_id AS id, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM paragraphs),
        spans AS (SELECT doc_id, unnest(range(0, length(text) // 700 + 1)) AS span_id FROM documents)
        SELECT b.doc_id, span_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM spans JOIN b ON b.doc_id = spans.doc_id AND s < span_id * 700 + 300 AND s + n > span_id * 700 GROUP BY ALL""",
)
def rel_range_join(spark, sf_dir):
    n = F.floor(F.length("text") / 700).cast("long")  # spans over the whole of each document
    spans = documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("span_id"))
    spans = spans.select("doc_id", "span_id", (F.col("span_id") * 700).alias("s_start"), (F.col("span_id") * 700 + 300).alias("s_end"))
    o = corpus.overlapping_boundaries(spans, rel_boundaries(spark, sf_dir), 1024)
    return o.select("doc_id", "span_id", F.size("chunk_ids").cast("long").alias("n"), F.array_join("chunk_ids", ",").alias("ids"))


@register("rel_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def rel_semi_join(spark, sf_dir):
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@register("rel_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rel_anti_join(spark, sf_dir):
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@register(
    "rel_latest",
    "SELECT conv_id AS chunk_id, max(turn) AS version, md5(arg_max(text, turn)) AS h FROM conversations GROUP BY conv_id",
)
def rel_latest(spark, sf_dir):
    e = corpus.latest(edits_of(spark, sf_dir), "chunk_id", "version")
    return e.select("chunk_id", "version", F.md5("edited_text").alias("h"))


@register(
    "rel_rollup",
    f"WITH {sql.PARAGRAPHS} SELECT source, lang, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words FROM paragraphs GROUP BY ROLLUP (source, lang)",
)
def rel_rollup(spark, sf_dir):
    return paragraphs(spark, sf_dir).rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("word_count").cast("long").alias("words"))


@register(
    "rel_season_fill",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), s AS (SELECT date, year(date) AS year, CASE WHEN day(date) IN (1, 9, 20) THEN monthname(date) END AS season FROM d)
       SELECT date, coalesce(season, last_value(season IGNORE NULLS) OVER (PARTITION BY year ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 'Ordinary Time') AS season FROM s""",
)
def rel_season_fill(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    d = d.select("date", F.year("date").alias("year"), F.when(F.dayofmonth("date").isin(1, 9, 20), F.date_format("date", "MMMM")).alias("season"))
    return corpus.fill_seasons(d).select("date", "season")
