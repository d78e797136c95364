"""What documents are about: type, subjects, themes, related documents, places, dates and counts, from text and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions.refs import MONTH_DAY_YEAR

#: Ordered: the first that a text has is its type.
CHURCH_TYPES = (
    ("Dogmatic Constitution", r"constitutio dogmatica|\bdogmatic constitution\b"),
    ("Pastoral Constitution", r"constitutio pastoralis|\bpastoral constitution\b"),
    ("Apostolic Constitution", "constitutio apostolica|apostolic constitution"),
    ("Encyclical", r"litterae encyclicae|\bencyclical\b"),
    ("Apostolic Exhortation", "adhortatio|apostolic exhortation"),
    ("Apostolic Letter", r"\bepistula\b|apostolic letter"),
    ("Motu Proprio", r"\bmotu proprio\b"),
    ("Decree", r"\b(?:decretum|decree)\b"),
    ("Instruction", r"\binstructio(?:n)?\b"),
    ("Declaration", r"\bdeclaratio(?:n)?\b"),
    ("Constitution", r"\bconstitutio(?:n)?\b"),
)
CHURCH_SUBJECTS = (
    ("Liturgy", r"\blitur(?:gical|gica|gy)\b|officium divinum"),
    ("Mass", r"eucharist|holy sacrifice|\bmass\b"),
    ("Divine Office", "breviar(?:ium|y)|divine office"),
    ("Sacraments", r"\bsacrament|\b(?:anointing|baptism|confirmation|marriage|orders|reconciliation)\b"),
    ("Magisterium", r"\b(?:apostolic see|holy see|magisterium)\b"),
    ("Ecclesiology", r"\b(?:bishop|church|diocese|ecclesia|episcopal|parish)\b"),
    ("Mariology", r"\b(?:assumption|immaculate conception|mary|theotokos)\b"),
    ("Moral Theology", r"\b(?:conscience|ethics|moral|virtue)\b"),
    ("Scripture", r"\b(?:divine revelation|scripture|verbum)\b"),
    ("Canon Law", r"canon law|\bc(?:ceo|ic)\b"),
    ("Prayer", r"\b(?:devotion|oratio|prayer)\b"),
    ("Council Documents", r"council of trent|dei verbum|lumen gentium|vatican\s*i"),
)
CHURCH_PLACES = (
    ("Vatican City (Rome)", r"apostolic see|holy see|\brome\b|vatican"),
    ("Universal Church", "(?:catholic|universal|whole) church"),
    ("Diocese", r"\b(?:bishop|diocese|episcopal)\b"),
    ("Parish", r"\b(?:faithful|parish|pastor)\b"),
)
CHURCH_DOCUMENTS = tuple(
    """Catechism of the Catholic Church; Council of Trent; Dei Filius; Dei Verbum; Evangelii Nuntiandi; Fidei Depositum;
    Gaudium et Spes; General Instruction of the Roman Missal; Humanae Vitae; Laudato Si'; Liturgiam Authenticam; Lumen Gentium;
    Mediator Dei; Missale Romanum; Mysterii Paschalis; Pastor Aeternus; Quo Primum; Roman Catechism; Sacrosanctum Concilium;
    Syllabus of Errors; Trent""".replace("\n", " ").split(";")
)
TITLE_TYPES = (
    ("Encyclical", "encyclical"), ("Apostolic Letter", "apostolic letter"), ("Apostolic Exhortation", "apostolic exhortation"),
    ("Apostolic Constitution", "apostolic constitution"), ("Motu Proprio", "motu proprio"), ("Bull", "bull"), ("Decree", "decree"),
    ("Declaration", "declaration"), ("Instruction", "instruction"), ("Catechism", "catechism"), ("Compendium", "compendium"),
    ("Canon Law", "code|canon law"), ("Constitution", "constitution"), ("Scripture", "john|matthew|exodus|genesis|bible"),
)


def first_match(text: Column, table, otherwise: str = "") -> Column:
    """The name of the first pattern of the table that the lower-cased text has."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(otherwise)
    for name, p in reversed(table):
        out = F.when(low.rlike(p), name).otherwise(out)
    return out


def all_matches(text: Column, table) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), name) for name, p in table]))


def mentioned(text: Column, names=CHURCH_DOCUMENTS) -> Column:
    """The names that the text has in any case, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names = sorted({" ".join(n.split()) for n in names})
    return F.array_compact(F.array(*[F.when(low.contains(n.lower()), n) for n in names]))


def generic_type(text: Column) -> Column:
    """Technical with over 5 fences, a manual with over 10 numbered lines, a short text with a blank line an article."""
    t = F.coalesce(text, F.lit(""))
    numbered = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"^\s*[0-9]") & F.substring(x, 1, 5).contains(".")))
    return (
        F.when(~t.rlike(r"\S"), "Document")
        .when(F.regexp_count(t, F.lit("```")) > 5, "Technical Document")
        .when(numbered > 10, "Manual")
        .when((F.length(t) < 5000) & t.contains("\n\n"), "Article")
        .otherwise("Document")
    )


def promulgation_date(text: Column, dates: Column) -> Column:
    """A date after promulgated, given, issued or published on one line, else the first of dates, else ''."""
    near = F.regexp_extract(text, rf"(?i)(?:published|issued|given|promulgated?).*?({MONTH_DAY_YEAR})", 1)
    return F.when(F.size(dates) == 0, "").otherwise(F.coalesce(F.nullif(near, F.lit("")), F.get(dates, F.lit(0))))


def counts(chunks: DataFrame) -> DataFrame:
    """doc_id, words, word_count and pages as they are printed."""
    g = chunks.groupBy("doc_id").agg(F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    pages = F.greatest(F.lit(1), F.floor(F.col("words") / 250))
    about = lambda c: F.concat(F.lit("approximately "), c)
    return g.select("doc_id", "words", about(F.format_number("words", 0)).alias("word_count"), about(pages.cast("string")).alias("pages"))


def subjects(chunks: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, subject: the first distinct headings of levels 1 and 2, in order."""
    heads = F.filter(F.array(F.trim("hierarchy.level_1"), F.trim("hierarchy.level_2")), lambda x: x != "")
    # one row a pair of headings before they meet, however many paragraphs have it
    first = chunks.groupBy("doc_id", heads.alias("h")).agg(F.min("paragraph_id").alias("at"))
    g = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("hs"))
    return g.select("doc_id", F.slice(F.array_distinct(F.flatten("hs.h")), 1, most).alias("subject"))


def themes(chunks: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, key_themes: the most frequent headings of levels 1 to 4; of equal ones the first seen."""
    heads = F.filter(F.array(*[F.trim(F.col(f"hierarchy.level_{k}")) for k in range(1, 5)]), lambda x: x != "")
    e = chunks.select("doc_id", "paragraph_id", F.posexplode(heads).alias("k", "theme"))
    g = e.groupBy("doc_id", "theme").agg(F.count("*").alias("n"), F.min(F.struct("paragraph_id", "k")).alias("seen"))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "seen"))
    top = g.withColumn("r", r).where(F.col("r") <= most)
    return top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", "theme"))).alias("t")).select("doc_id", F.col("t.theme").alias("key_themes"))


def long_headings(chunks: DataFrame, longer_than: int = 10, most: int = 10) -> DataFrame:
    """doc_id, key_themes: the first distinct headings of levels 1 to 4 that have more than so many characters, in order."""
    heads = F.filter(F.array(*[F.col(f"hierarchy.level_{k}") for k in range(1, 5)]), lambda x: F.length(x) > longer_than)
    seen = chunks.select("doc_id", "paragraph_id", F.posexplode(heads).alias("k", "theme"))
    # one row a heading before they meet, however often it is repeated
    first = seen.groupBy("doc_id", "theme").agg(F.min(F.struct("paragraph_id", "k")).alias("at"))
    g = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "theme"))).alias("t"))
    return g.select("doc_id", F.slice("t.theme", 1, most).alias("key_themes"))


def enriched_questions(existing: Column, generated: Column) -> Column:
    """Questions that are there stay; others are generated."""
    return F.when(F.size(F.coalesce(existing, F.array().cast("array<string>"))) > 0, existing).otherwise(generated)


def footnote_rollup(citations: DataFrame) -> DataFrame:
    """citations: doc_id, number. doc_id, unique_citations (sorted), counts (number to how often)."""
    g = citations.groupBy("doc_id", "number").agg(F.count("*").alias("n"))
    g = g.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("c"))
    keys = F.transform("c", lambda x: F.struct(x["number"].cast("string"), x["n"]))
    return g.select("doc_id", F.col("c.number").alias("unique_citations"), F.map_from_entries(keys).alias("counts"))


def questions(h: Column, content_type: Column, text: Column, title: Column, scripture: Column) -> Column:
    """Questions that a chunk answers, by templates."""
    from scriptora.functions.text import LEVELS, strip_heading_number

    levels = F.transform(F.filter(F.array(*[h[x] for x in LEVELS]), lambda x: x != ""), strip_heading_number)
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def ask(levels: Column) -> Column:
        n = F.size(levels)
        last, before = F.get(levels, n - 1), F.get(levels, n - 2)
        line = F.trim(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1))
        function = F.regexp_extract(line, r"^(?:async )?def ([^(]*)", 1)
        cls = F.regexp_extract(line, r"^class ([^(:]*)", 1)
        named = F.trim(F.when(function != "", function).otherwise(cls))
        code = F.array(
            F.when(n > 0, q("How is ", last, " implemented?")),
            F.when(named != "", F.when(function != "", q("What does ", named, " do?")).otherwise(q("What is ", named, "?"))),
            F.when(named != "", q("How to use ", named, "?")),
        )
        prose = F.array(
            F.when(n >= 2, q("What is ", last, "?")),
            F.when(n >= 2, q("What does ", last, " cover in ", before, "?")),
            F.when(n == 1, q("What is ", last, " about?")),
            F.when((n > 0) & (F.coalesce(title, F.lit("")) != ""), q("What does ", title, " say about ", last, "?")),
        )
        verses = F.transform(F.slice(F.coalesce(scripture, F.array().cast("array<string>")), 1, 2), lambda r: q("What does ", r, " say?"))
        return F.when(content_type == "code", F.array_compact(code)).otherwise(F.concat(F.array_compact(prose), verses))

    return F.get(F.transform(F.array(levels), ask), F.lit(0))
