"""Chunks of little meaning: indexes, navigation, legal boilerplate, front and back matter, reference blocks.

Each function takes the columns of a chunk: text, word_count, hierarchy (struct of six levels) and, where known,
token_count; nulls count as '' and 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptora.functions.text import CAP, LEVELS, NOT_WS, strip, word_count as count_words

ENDORSEMENTS = ("acclaim for", "advance praise", "praise for", "testimonials", "what people are saying", "what readers are saying")
FRONT_LABELS = """abbreviations; acknowledgements; acknowledgments; also by; dedication; editor's preface; editors' preface;
endorsements; figures; illustrations; list of abbreviations; list of figures; list of illustrations; praise; preface;
series page; testimonials; title page"""
BACK_LABELS = """about the author; about the authors; back cover; bibliography; endnotes; footnotes; further reading; general
index; glossary; index of sidebars; index of subjects; recommended reading; scripture index; subject index; suggested resources"""
DEDICATION = r"(?m)\A\s*(?:dedicated to\b|in memory of\b|(?:for|to)\s+(?:the|our|my)\s+\w+|for\s+\w+\s*,\s*(?:the|our|my))"
_PAGES = r"{}\s*[0-9]+[–-][0-9]+"
INDICATORS = (r"(?i)\bIbid\b", r"(?i)\bed\.\s", r"(?i)\btrans\.\s", r"(?i)\bvol\.\s", r"\([0-9]{4}\)", _PAGES.format(":"), _PAGES.format(",") + r"\.")
CITATION = r"(?m)(?:\n|^)\s*" + "([0-9]{1,3})" + rf"\.\s+({CAP}(?:\.|[a-z]+)\s*{CAP}?)"


def labels(x: str) -> list[str]:
    """The labels of a table that is written with semicolons."""
    return [" ".join(p.split()) for p in x.split(";")]


_strip = strip
#: A word that is a number or an index's marks. The class is looked for first: it is rare.
_NUMBERS = rf"(?=[0-9*,.\-:;])(?<!{NOT_WS})[0-9*,.\-:;]++(?!{NOT_WS})"


def _low(h: Column, level: str) -> Column:
    return F.lower(F.coalesce(h[level], F.lit("")))


def is_index_page(text: Column, token_count: Column | None = None) -> Column:
    """Over half numbers; or a run of 5 numbers and many digits; or many tokens a word and over .3 numbers."""
    t = _strip(text)

    def judge(n: Column) -> Column:
        share = F.regexp_count(t, F.lit(_NUMBERS)) / n
        runs = t.rlike(r"(?:[0-9]+[*,.\-:;\s]+){5}") & (F.regexp_count(t, F.lit(r"[0-9]+")) > n * 0.3)
        out = (share > 0.5) | runs
        if token_count is not None:
            k = F.coalesce(token_count, F.lit(0))
            out = out | ((k > 0) & (k / n > 2.5) & (share > 0.3))
        return F.when(n > 0, out).otherwise(F.lit(False))

    return F.get(F.transform(F.array(count_words(t)), judge), F.lit(0))


def is_navigation(text: Column, word_count: Column, h: Column) -> Column:
    t, top = F.lower(_strip(text)), _low(h, "level_1")
    short = (top.contains("index") | top.contains("contents")) & (F.coalesce(word_count, F.lit(0)) < 20)
    return short | t.rlike(r"\A(?:back|forward|home|next|previous|up|(?:part|section|chapter)\s+[0-9]+|page\s+[0-9]+)\Z")


def is_boilerplate(text: Column, word_count: Column) -> Column:
    t = F.lower(_strip(text))
    legal = (F.coalesce(word_count, F.lit(0)) < 50) & t.rlike(r"(?=[©ac])(?:©|\ball rights reserved\b|\bcopyright\b)")
    return legal | t.rlike(r"(?=[cip])(?:\bisbn\b|catalog number|publisher code)")


def low_value(text: Column, word_count: Column, h: Column, token_count: Column | None = None) -> Column:
    return is_index_page(text, token_count) | is_navigation(text, word_count, h) | is_boilerplate(text, word_count)


def noise_reasons(text: Column, word_count: Column, h: Column, token_count: Column | None = None) -> Column:
    """The reasons joined by +, or ''."""
    return F.concat_ws(
        "+",
        F.when(is_index_page(text, token_count), "index"),
        F.when(is_navigation(text, word_count, h), "navigation"),
        F.when(is_boilerplate(text, word_count), "boilerplate"),
    )


def front_matter(text: Column, h: Column) -> Column:
    """Why a chunk is front or back matter, or ``content``: the first rule that holds, in a fixed order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    levels = F.array(*[_low(h, x) for x in LEVELS])
    top = _low(h, "level_1")
    some = lambda f: F.exists(levels, f)
    has = lambda x, names: x.rlike("|".join(n.replace(".", r"\.") for n in labels(names)))
    publisher = lambda x: x.rlike(r"\Aabout\s+(?!the\s+author)") & x.rlike("books|editions|house|media|press|publishing")
    index = lambda x: (
        x.isin("index", "geography")
        | (x.rlike(r"\bindex\b") & ~x.rlike("index(?:es|ed|ing)"))
        | x.rlike(r"\bgeography\b|\bmaps?\b")
    )
    notes = top.isin("notes", "endnotes") | (top.rlike(r"\bnotes\b") & ~top.rlike("note(?:d|worthy)"))
    return (
        F.when(t.rlike(DEDICATION), "dedication_phrase")
        .when(t.rlike("|".join(ENDORSEMENTS)), "endorsement_section")
        .when(some(lambda x: has(x, FRONT_LABELS) | publisher(x)), "front_matter_toc_label")
        .when(some(lambda x: has(x, BACK_LABELS)), "back_matter_toc_label")
        .when(some(index) | notes, "back_matter_toc_label")
        .when(some(lambda x: x.contains("outline")), "front_matter_toc_label")
        .otherwise("content")
    )


def reference_block(text: Column) -> Column:
    """found, start (code points, -1 if none), count: citations numbered from 1, three or more rising, two signs of citing."""
    c = F.coalesce(text, F.lit(""))
    numbers = F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))

    def judge(n: Column) -> Column:
        run = F.aggregate(
            F.slice(n, 2, F.greatest(F.size(n), F.lit(1))),
            F.struct(F.get(n, F.lit(0)).alias("last"), F.lit(1).alias("k"), F.lit(True).alias("on")),
            lambda a, x: F.struct(
                x.alias("last"),
                (a["k"] + F.when(a["on"] & (x > a["last"]), 1).otherwise(0)).alias("k"),
                (a["on"] & (x > a["last"])).alias("on"),
            ),
            lambda a: a["k"],
        )
        start = F.regexp_instr(c, F.lit(CITATION)) - 1
        rest = F.substring(c, start + 1, F.length(c))
        signs = sum((F.when(rest.rlike(p), 1).otherwise(0) for p in INDICATORS[1:]), F.when(rest.rlike(INDICATORS[0]), 1).otherwise(0))
        ok = (F.size(n) >= 2) & (F.get(n, F.lit(0)) == 1) & (run >= 3) & (signs >= 2)
        yes = F.struct(F.lit(True).alias("found"), start.alias("start"), run.alias("count"))
        no = F.struct(F.lit(False).alias("found"), F.lit(-1).alias("start"), F.lit(0).alias("count"))
        return F.when(ok, yes).otherwise(no)

    return F.get(F.transform(F.array(numbers), judge), F.lit(0))


def is_skippable_section(level_1: Column) -> Column:
    return F.lower(F.coalesce(level_1, F.lit(""))).isin("contents", "index", "table of contents", "toc")


TINY_MODES = tuple("off conservative standard aggressive".split())


def tiny_chunk(text: Column, word_count: Column, h: Column, mode: str) -> Column:
    """Whether a chunk of under 5 words goes. Each mode has the rules of those before it.

    conservative: index and contents sections, at most two letters or digits, numbers, labels of figures. standard: answer
    keys, bullets of one word, page ranges. aggressive: appendices and cross references.
    """
    if mode not in TINY_MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(TINY_MODES)}")
    t, top = _strip(text), _low(h, "level_1")
    tiers = [
        top.contains("index")
        | top.contains("contents")
        | (F.length(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}]", "")) <= 2)
        | F.translate(t, ".,- ", "").rlike(r"\A[0-9]+\Z")
        | t.rlike(r"(?i)\A(?:diagram|example|figure|listing|table)\s+[0-9]+"),
        (top.contains("answer") & t.rlike(r"(?U)\A[0-9]+\.\s+\w+\Z"))
        | t.rlike(r"(?U)\A[•·◦▪–—]\s+\w+\Z")
        | t.rlike(r"\A[0-9]+\s*[-–—]\s*[0-9]+\Z"),
        top.contains("appendix") | top.contains("appendices") | t.rlike(r"(?i)\bsee\s+(?:section|page|chapter|also)\b"),
    ]
    rule = F.lit(False)
    for tier in tiers[: TINY_MODES.index(mode)]:
        rule = rule | tier
    return (F.coalesce(word_count, F.lit(0)) < 5) & rule
