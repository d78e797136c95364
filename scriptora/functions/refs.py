"""Dates, scripture and cross references found in text: sorted distinct arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptora.functions.text import CAP, MONTHS, clean_text

_NUM, _GAP, _MAYBE = "[0-9]+", r"\s+", r"\s*"
_DAY, _YEAR = "[0-9]{1,2}(?:th|st|rd|nd)?", "[0-9]{4}"
MONTH_DAY_YEAR = f"(?:{MONTHS}){_GAP}{_DAY},?{_GAP}{_YEAR}"
DATE_PATTERNS = (
    rf"(?i)\b{MONTH_DAY_YEAR}\b",
    rf"(?i)\b{_DAY}{_GAP}(?:{MONTHS}){_GAP}{_YEAR}\b",
    rf"\b{_YEAR}(?:-[0-9]{{2}}){{2}}\b",
    rf"\b(?:[0-9]{{1,2}}/){{2}}{_YEAR}\b",
)
#: Words before a number and colon that aren't books, alphabetically; then long and short names of books.
NOT_BOOKS = "Art|Article|Chapter|Class|Figure|Grade|Item|Level|Line|Note|Page|Part|Phase|Round|Rule|Section|Stage|Step|Table|Type|Verse|Version"
_LONG_BOOKS = "Chronicles?|Corinthians?|John|Kings?|Peter|Thessalonians?|Timothy"
_SHORT_BOOKS = """
Acts Amos Chr Col Cor Dan Deut Eccl Eph Esth Ex Ezek Ezra Gal Gen Hab Hag Heb Hos Isa Jas Jer Jn Job Joel Jonah Josh
Jude Judg Kgs Lam Lev Lk Mal Mic Mk Mt Nah Neh Num Obad Pet Phil Phlm Prov Ps Rev Rom Ruth Sam Song Thess Tim Tit Zech Zeph
""".split()
_NTH = rf"(?:[123]{_MAYBE})?"
_VERSE = f"{_GAP}{_NUM}:{_NUM}"
#: Any word with chapter and verse, also those of NOT_BOOKS.
ANY_BOOK = rf"\b{_NTH}{CAP}[a-z]+\.?{_VERSE}(?:-{_NUM}(?::{_NUM})?)?"
SCRIPTURE_PATTERNS = (
    rf"\b{_NTH}(?!(?:{NOT_BOOKS})\b){CAP}[a-z]+\.?{_VERSE}(?:-{_NUM}(?::{_NUM})?)?",
    rf"(?i)\b{_NTH}(?:{_LONG_BOOKS}){_VERSE}(?:-{_NUM})?",
    rf"(?i)\b(?:{'|'.join(_SHORT_BOOKS)})\.?{_VERSE}(?:-{_NUM})?",
)
_PARAGRAPH = f"(?:{_MAYBE}§{_MAYBE}{_NUM})?"
CROSS_PATTERNS = (
    rf"(?i)\b(?:see also|see|compare|cf\.){_GAP}(?:section|part|chapter|can\.?|art\.?|§){_GAP}[-A-Za-z0-9.:§]{{1,60}}",
    rf"(?i)\b(?:CCEO|CIC){_MAYBE}(?:/19(?:90|83))?{_MAYBE}(?:canon|can\.?){_MAYBE}{_NUM}{_PARAGRAPH}",
    rf"(?i)\b(?:can\.|canon){_MAYBE}{_NUM}{_PARAGRAPH}",
    rf"(?i)\b(?:Catechism(?: of the Catholic Church)?|CCC){_MAYBE}[0-9]{{1,4}}",
    r"(?i)\b(?:Catechism of (?:Trent|Pius V)|Roman Catechism)\b",
    rf"(?i)\b(?:Denz\.?|DS){_MAYBE}[0-9]{{3,5}}\b",
    rf"(?i)\b(?:GI(?:LH|RM)|[IO]GMR){_MAYBE}[0-9]{{1,4}}\b",
    rf"(?i)\b(?:Trent(?:,?{_MAYBE}Session)?{_MAYBE}[CILVX]+|Council of Trent)\b",
    rf"(?i)\bVatican{_MAYBE}(?:II|I)\b",
    rf"\b§§?{_MAYBE}[0-9]{{1,4}}\b",
    rf"(?i)\bAAS{_GAP}[0-9]{{1,3}}{_MAYBE}\({_YEAR}\){_MAYBE}{_NUM}",
)


#: What every match of some pattern holds: most texts have none of it, and then no pattern is tried. First characters are
#: looked for before words.
_ANY_DATE = r"[0-9](?<=[0-9]{4})"
_ANY_VERSE = "[0-9]:[0-9]"
_ANY_CROSS = (
    r"§|(?i)(?=[acdgirstvo])(?:see\s|compare\s|cf\.\s|see also\s|can(?:on|\.)?\s*[0-9]|c(?:ceo|ic)[\s/c]|(?:catechism(?: of the catholic church)?|ccc)\s*[0-9]"
    r"|catechism of (?:trent|pius v)|roman catechism|d(?:enz\.?|s)\s*[0-9]|gi(?:lh|rm)\s*[0-9]|[io]gmr\s*[0-9]|trent|vatican|aas\s)"
)


def _found(c: Column, patterns, some: str) -> Column:
    every = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns])
    return F.when(c.rlike(some), F.transform(every, lambda x: clean_text(x))).otherwise(F.array().cast("array<string>"))


def dates(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_found(F.coalesce(c, F.lit("")), DATE_PATTERNS, _ANY_DATE)))


def scripture_references(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_found(F.coalesce(c, F.lit("")), SCRIPTURE_PATTERNS, _ANY_VERSE)))


def cross_references(c: Column) -> Column:
    """Those of 4 to 140 characters."""
    found = F.filter(_found(F.coalesce(c, F.lit("")), CROSS_PATTERNS, _ANY_CROSS), lambda x: F.length(x).between(4, 140))
    return F.array_sort(F.array_distinct(found))


_CLOSE = r"\s*[\"'“”.)]*$"


def trailing_footnotes(c: Column, most: int = 999) -> Column:
    """Numbers that end a sentence as footnote marks, in brackets or bare; not verses (3:16) or decimals (3.14)."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    marks = [F.regexp_extract(c, p + _CLOSE, 1) for p in (r"[\[(]\s*([0-9]{1,4})\s*[\])]", r"[\s,;]([0-9]{1,4})")]
    numbers = F.array_distinct(F.transform(F.filter(F.array(*marks), lambda x: x != ""), lambda x: x.cast("int")))
    other = c.rlike(r":\s*[0-9]{1,4}" + _CLOSE) | c.rlike(r"\b[0-9]+\.[0-9]+" + _CLOSE)
    return F.when(other, F.array().cast("array<int>")).otherwise(F.filter(numbers, lambda x: x.between(1, most)))
