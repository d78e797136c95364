"""Cleaning, counting and splitting text, as column expressions.

White space follows Unicode; it is spelled out as classes, which are matched faster than a property. Every function
takes a string column and gives null for null unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a class of white space, with the four separators that Python's splitting takes for it too.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: [SPACE] and its complement for Java: a class tries its members one after the other, but single ones of Latin 1 at once,
#: so that those that most characters fall to come first.
_NARROW = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
WS = rf"[ {_NARROW}[[^\x00-\xff]&&[{_WIDE}]]]"
NOT_WS = rf"[[^ {_NARROW}]&&[[\x00-\xff][^{_WIDE}]]]"
CAP = "[A-Z]"
#: Where a sentence ends: after its mark, before a capital, quote or bracket. White space is looked for first: it is rare.
_END = """{0}(?<=[?!.]{0}){0}*(?=[("'A-Z])"""
SENTENCE_END = _END.format(f"[{SPACE}]")
LEVELS = tuple(f"level_{i}" for i in range(1, 7))

#: Words that a full stop follows within a sentence, alphabetically.
ABBREVIATIONS = """
Abp Apr Aug Bar Bl Bp Br Capt Chr Col Cor Dan Dec Deut Dr Eccl Eph Esth Ex Ezek Feb Fr Gal Gen Hab Hag Heb Hos Isa Jan
Jas Jdt Jer Jn Josh Jr Judg Jul Jun Kgs Lam Lev Lk Lt Macc Mal Mar Mic Mk Mr Mrs Ms Msgr Mt Nah Neh Nov Num Oct Pet
Phil Phlm Prof Prov Ps Rev Rom Sam Sep Sept Sgt Sir Sr St Thess Tim Tit Tob Ven Wis Zech Zeph al approx art cf ch cit
e.g ed etc ff i.e ibid infra loc n.b no op p pp pt sec supra trans viz vol vs
""".split()
#: Names of months as dates may have them: full, or short where that is usual.
MONTHS = "January|Jan|February|Feb|March|April|May|June|July|August|September|Sept\\.|October|November|December"


def _alternatives(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w)))


def _icu(method: str, c: Column, flag: bool) -> Column:
    """A normalisation of the ICU library that Spark has on its class path, so that no text leaves the JVM."""
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(flag))


def nfc(c: Column) -> Column:
    """Unicode NFC. Texts without a character from the first combining mark on are in that form as they are."""
    return F.when(c.rlike(r"[^\x00-\u02ff]"), _icu("compose", c, False)).otherwise(c)


def ascii_fold(c: Column) -> Column:
    """NFKD with everything beyond ASCII dropped."""
    beyond = r"[^\x00-\x7f]"
    return F.when(c.rlike(beyond), F.regexp_replace(_icu("decompose", c, True), beyond, "")).otherwise(c)


def fix_spaced_caps(c: Column) -> Column:
    """Capitals set apart by single spaces become words: three or more of them, or one before a word of capitals."""
    inner = rf"(?<=\b{CAP}) (?={CAP} {CAP}\b)|(?<=\b{CAP} {CAP}) (?={CAP}\b)"
    return F.regexp_replace(F.regexp_replace(c, inner, ""), rf"\b({CAP})\s(?={CAP}{{2,}}\b)", "$1")


_INVISIBLE = r"\u00ad\u200b-\u200d\u2060\ufeff"
#: What any step of tidy() begins at: a space, a digit or what is dropped or folded, so most characters fail at once.
_UNTIDY = "|".join(
    (
        rf""" (?:[ ,;:!?.\"')\]}}]|$|(?<=^ )|(?<=[(\[\"'] )|(?={CAP})(?<=\b{CAP} ))""",
        rf"[0-9](?={CAP})",
        rf"[<{_NARROW}\xad[[^\x00-\xff]&&[{_INVISIBLE}{_WIDE}]]]",
    )
)


def tidy(c: Column, spaced_caps: bool = True) -> Column:
    """clean_text() of a text that isn't null and is in NFC. Where no step would begin, the text is left as it is."""
    out = c
    for pattern, to in (
        (f"[{_INVISIBLE}]", ""),
        (r"<[^>]+>", ""),
        (WS + "+", " "),
        (None, None),
        (rf"(\b[0-9]+)({CAP}[a-z])", "$1 $2"),
        (r" +([,;:!?.\"')\]}])", "$1"),
        (r"([(\[\"']) +", "$1"),
    ):
        out = F.regexp_replace(out, pattern, to) if pattern else F.trim(out)
    return F.when(c.rlike(_UNTIDY), fix_spaced_caps(out) if spaced_caps else out).otherwise(c)


def clean_text(c: Column, spaced_caps: bool = True) -> Column:
    """NFC, invisible characters and tags dropped, white space folded, punctuation tightened and, unless spaced_caps is
    False, spaced capitals joined; null is ''."""
    return tidy(nfc(F.coalesce(c, F.lit(""))), spaced_caps)


def clean_code(c: Column) -> Column:
    """Invisible characters dropped and hard spaces softened; layout stays. Null is ''."""
    return F.translate(F.coalesce(c, F.lit("")), " ­​‌‍⁠﻿", " ")


def word_count(c: Column) -> Column:
    # each word with the space around becomes one character: regexp_count would make a string of each
    marks = F.regexp_replace(c, rf"{NOT_WS}+[ {_NARROW}{_WIDE}]*", "x")
    # space before the first word is still there
    return F.when(c.rlike(rf"\A{NOT_WS}"), F.length(marks)).when(c.rlike(NOT_WS), F.length(F.regexp_replace(marks, WS, ""))).otherwise(0)


def count_of(c: Column, chars: str) -> Column:
    """How many characters of a text are in a class of Java's; null for null."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{chars}+", ""))


def tidy_word_count(c: Column) -> Column:
    """word_count() of what tidy() gives: it has no white space but single spaces between words."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def strip(c: Column) -> Column:
    """The text without white space at its ends; null is ''."""
    c = F.coalesce(c, F.lit(""))
    at_end = F.substring(c, 1, 1).rlike(WS) | F.substring(c, -1, 1).rlike(WS)
    return F.when(at_end, F.regexp_replace(c, f"^{WS}+|{WS}+$", "")).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS + "+"), lambda w: w != "")


def clean_toc_title(c: Column, spaced_caps: bool = True) -> Column:
    """A cleaned title without its number: chapter, arabic, roman of two letters or more, or bare."""
    c = clean_text(c, spaced_caps)
    for p in (
        r"(?i)^\s*chap(?:ter|\.)?\s*[0-9]+\s*[–—:.\-]\s*",
        r"^\s*[0-9]+\s*[.)]",
        r"(?i)^\s*[CILVX]{2,}\s*[).]",
        r"^\s*[0-9]+\s+",
        r"^[\s.)\-–—]+",
    ):
        c = F.regexp_replace(c, p, "")
    return c


#: A full stop and a space after an abbreviation; the stop is looked for first.
_AFTER_ABBREVIATION = rf"\. (?<=\b(?:{_alternatives(ABBREVIATIONS)})\. )"


def sentences(c: Column) -> Column:
    """Sentences: ends of . ! ? before a capital, quote or bracket, but not after an abbreviation and one space."""
    held = F.regexp_replace(F.coalesce(c, F.lit("")), _AFTER_ABBREVIATION, ".\x00")
    parts = F.split(held, _END.format(WS))
    bare = F.transform(parts, lambda s: F.when(s.contains("\x00"), F.translate(s, "\x00", " ")).otherwise(s))
    return F.filter(F.transform(bare, lambda s: strip(s)), lambda s: s != "")


def estimate_tokens(n_words: Column) -> Column:
    """One and a half tokens a word, rounded down: what is used where no tokenizer is given."""
    return F.floor(n_words * 1.5).cast("int")


def no_hierarchy() -> Column:
    return F.struct(*[F.lit("").alias(x) for x in LEVELS])


def hierarchy(**levels: Column) -> Column:
    """A hierarchy of six levels; those not given and nulls are ''."""
    return F.struct(*[F.coalesce(levels[x], F.lit("")).alias(x) if x in levels else F.lit("").alias(x) for x in LEVELS])


def heading_path(h: Column) -> Column:
    return F.array_join(F.filter(F.array(*[h[x] for x in LEVELS]), lambda x: x != ""), " / ")


def hierarchy_depth(h: Column) -> Column:
    """The deepest level that is set, not how many are."""
    out = F.lit(0)
    for i, x in enumerate(LEVELS, 1):
        out = F.when(h[x] != "", F.lit(i)).otherwise(out)
    return out


def heading_level(tag: Column) -> Column:
    """1 to 9 for h1 to h9 as written, else 99."""
    n = F.regexp_extract(F.lower(tag), r"^h([0-9])", 1)
    return F.when(n != "", n.cast("int")).otherwise(F.lit(99))


def strip_heading_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^[0-9]+(\.[0-9]+)*\s+", "")


def slug(c: Column, most: int = 100) -> Column:
    """A file name of a title: lower case, words joined by underscores, at most so many characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s-]", ""), r"[-\s]+", "_")
    s = F.trim(F.substring(s, 1, most), F.lit("_"))
    return F.when(s == "", "untitled").otherwise(s)


def document_context(title: Column, author: Column, subjects: Column, most: int = 3) -> Column:
    """Lines on a document: title, author and its first subjects, as far as they are known."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    first = F.slice(F.coalesce(subjects, F.array().cast("array<string>")), 1, most)
    return F.concat_ws("\n", line("Title", title), line("Author", author), line("Subjects", F.array_join(first, ", ")))


def context_prefix(title: Column, author: Column, path: Column) -> Column:
    """What is put before a chunk's text so that it can be found alone."""
    who = F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit(" by "), author)).otherwise(F.lit(""))
    doc = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Document: "), title, who))
    sec = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("Section: "), path))
    return F.concat_ws("\n", doc, sec)
