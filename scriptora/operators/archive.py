"""An archive of pages: its links, names, validity, images, tables of contents, hours, calendars and numbered paragraphs.

What needs a network (crawling, downloads, uploads) isn't here; its rules work on tables of links and pages.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptora.functions import text as T
from scriptora.functions.identity import object_path
from scriptora.operators import parsers

SECTIONS = {x.upper(): x for x in ("bible", "canon_law", "catechism", "councils", "magisterium")} | {"SOCIAL": "social_teaching"}


def section_folder(section: Column) -> Column:
    out = F.lit("other")
    for k, v in SECTIONS.items():
        out = F.when(section == k, v).otherwise(out)
    return out


def document_path(base: str, section: Column, title: Column, url: Column, suffix: str, most: int = 100) -> Column:
    return object_path(F.concat_ws("/", F.lit(base), section_folder(section)), T.slug(title, most), url, suffix)


def image_name(url: Column, alt: Column) -> Column:
    """A file name of the alternative text (30 characters of its slug) and 12 digits of the URL's MD5; .jpg if it has no ending."""
    ext = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"(\.\w{2,5})$", 1))
    name = F.when(F.coalesce(alt, F.lit("")) != "", T.slug(alt, 30))
    return F.concat(F.concat_ws("_", name, F.substring(F.md5(url.cast("binary")), 1, 12)), F.when(ext == "", ".jpg").otherwise(ext))


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as an absolute URL."""
    from urllib.parse import urljoin

    return pd.Series([None if x is None else urljoin(b or "", x) for b, x in zip(base, link)])


def links(pages: DataFrame, pattern: str, most_title: int = 150) -> DataFrame:
    """pages: url, html. src, url (without fragment), title of the links whose target has the pattern: the first of each URL."""
    p = r"(?is)<a\s[^>]*?href=[\"']([^\"'#]*)[^\"']*[\"'][^>]*>(.*?)</a>"
    hrefs, texts = (F.regexp_extract_all("html", F.lit(p), F.lit(k)) for k in (1, 2))
    e = pages.select(F.col("url").alias("src"), F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("title"))).alias("i", "a"))
    e = e.select("src", "i", F.trim("a.href").alias("href"), T.clean_text(F.col("a.title")).alias("title"))
    e = e.where((F.col("href") != "") & F.col("href").rlike(pattern) & (F.length("title") <= most_title))
    e = e.withColumn("url", resolve_url("src", "href"))
    w = Window.partitionBy("url").orderBy("src", "i")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").select("src", "url", "title")


def part_of(html: Column) -> Column:
    """The parts of a page's meta tag named part, as an array: "Books > Baruch > Chapter 3"."""
    piece = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""  # of a tag: quoted values may hold its end
    tag = rf"""(?is)<meta\b(?={piece}\bname\s*=\s*["']part["']){piece}?\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    content = parsers.unescape(F.concat(F.regexp_extract(html, tag, 1), F.regexp_extract(html, tag, 2)))
    return F.filter(F.transform(F.split(content, ">"), lambda x: F.trim(x)), lambda x: x != "")


def part_name(html: Column, title: Column) -> Column:
    """The name of a page's object: its book and chapter (two digits), or its book, or else a slug of its title."""
    parts = part_of(html)
    n = F.size(parts)
    book = F.regexp_replace(F.regexp_replace(F.lower(F.get(parts, n - 2)), r"[^\w\s-]", ""), r"[-\s]+", "_")
    chapter = F.when(n >= 3, F.regexp_extract(F.get(parts, n - 1), r"(?i)chapter\s+([0-9]+)", 1)).otherwise("")
    named = F.when(chapter == "", book).otherwise(F.concat(book, F.lit("_chapter_"), F.when(F.length(chapter) < 2, F.lpad(chapter, 2, "0")).otherwise(chapter)))
    return F.when(n >= 2, named).otherwise(T.slug(title))


def numeric_references(c: Column, least: int = 1, most: int = 2865) -> Column:
    """Numbers of paragraphs that a text refers to (cf. 12, see § 12, §§ 12), sorted and distinct."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(?i)cf\.\s*(?:§\s*)?([0-9]+)", r"(?i)see\s*(?:§\s*)?([0-9]+)", r"§§?\s*([0-9]+)")])
    numbers = F.transform(F.filter(found, lambda x: F.length(x) < 10), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(least, most))))


def plain_scripture_references(c: Column) -> Column:
    """Words with chapter and verse, without leaving out those that aren't books; sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(?:[1-3]\s*)?[A-Z][a-z]+\.?\s*[0-9]+:[0-9]+(?:-[0-9]+)?"), F.lit(0))))


_BOOK_STARTS = """Acts Am Bar Col Dn Dt Eccl Eph Est Ex Ez Gal Gn Hb Heb Hg Hos Is Jas Jb Jdt Jer Jl Jgs Jn Jon Jos Jude Lam Lk Lv
Mal Mi Mk Mt Na Neh Nm Ob Phil Phlm Prv Ps Pss Rom Ru Rv Sg Sir Ti Tb Wis Zec Zep""".split()


def is_reading_line(line: Column) -> Column:
    """Whether a line of a calendar gives readings: it begins with a time of day, an alternative or the name of a book."""
    s = F.trim(line)
    return (
        s.rlike(r"\A(?:Vigil|Night|Dawn|Day|Morning|Evening):")
        | s.rlike(r"\A(?:or any readings|or, for)")
        | s.rlike(rf"\A(?:{'|'.join(_BOOK_STARTS)})[ :]")
        | s.rlike(r"\A[0-9]\s+(?:Sm|Kgs|Chr|Mc|Cor|Thes|Tm|Jn|Pt)\s")
    )


def is_noise_line(line: Column, prefixes=()) -> Column:
    """Whether a line of a calendar says nothing: blank, a page's number, a footnote, a running head."""
    s = F.trim(F.coalesce(line, F.lit("")))
    out = s.rlike(r"\A(?:[0-9]{1,4})?\Z") | s.rlike(r"\A[0-9]+\s+(?:See|Cf\.)\s") | s.rlike(r"\A(?:designated by Pss|or, for the Optional Memorial of)")
    for p in prefixes:
        out = out | F.upper(s).startswith(p.upper())
    return out


def valid_download(html: Column) -> Column:
    """Not empty, and with a body."""
    return F.coalesce((F.length(html) > 0) & html.rlike("(?i)<body"), F.lit(False))


IMAGE_ENDINGS = ("bmp", "gif", "jpeg", "jpg", "png", "webp")


def valid_image_url(url: Column, ignore=("icon", "logo", "avatar", "pixel"), svg: bool = False) -> Column:
    """A URL with scheme and host whose path has an image's ending, also before more path, and no ignored word in that name."""
    ends = "|".join([*IMAGE_ENDINGS, *(["svg"] if svg else [])])
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    name = F.regexp_extract(path, rf"([^/]*\.(?:{ends}))", 1)
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""
    bad = F.lit(False)
    for word in ignore:
        bad = bad | name.contains(word)
    return host & (name != "") & ~bad


def images(pages: DataFrame, lazy=("data-src", "data-original", "data-lazy-src")) -> DataFrame:
    """pages: url, html. url, src (the first of src and the lazy attributes, made absolute), alt of each valid image."""

    def run(batches):
        for b in batches:
            out = []
            for url, source in zip(b["url"], b["html"]):
                for n in parsers.tree(source).walk():
                    if n.tag == "img":
                        src = next((n.attrs[a] for a in ("src", *lazy) if n.attrs.get(a)), None)
                        if src:
                            out.append((url, src, (n.attrs.get("alt") or "").strip()))
            yield pd.DataFrame(out, columns=["url", "src", "alt"])

    found = pages.select("url", "html").mapInPandas(run, "url string, src string, alt string")
    found = found.withColumn("src", resolve_url("url", "src"))
    return found.where(valid_image_url(F.col("src")))


def toc_maps(toc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """toc: doc_id, seq, href, title, depth. By file (first wins), by anchor (last wins), by lower-cased title (first wins)."""
    t = toc.select("doc_id", "seq", parsers.norm_href(F.col("href"), True).alias("full"), parsers.norm_href(F.col("href")).alias("base"), T.clean_toc_title(F.col("title")).alias("title"), "depth")
    t = t.where("title <> ''").withColumn("anchor", F.when(F.col("full").contains("#"), F.regexp_replace("full", r"\A[^#]*#", "")))

    def pick(rows: DataFrame, key: str, last: bool) -> DataFrame:
        by = F.max_by if last else F.min_by
        return rows.groupBy("doc_id", key).agg(by("title", "seq").alias("title"), by("depth", "seq").alias("depth"))

    files = pick(t.where("base <> ''"), "base", False)
    anchors = pick(t.where("anchor <> ''"), "anchor", True)
    return files, anchors, pick(t.withColumn("name", F.lower(F.trim("title"))), "name", False).drop("title")


_RED = re.compile("ff0000", re.I)


def office_paragraphs(pages: DataFrame) -> DataFrame:
    """pages: url, html of a day's hours. url, paragraph_id, hour, subsection, content_type, text: what red labels say what follows is."""

    def run(batches):
        for b in batches:
            out = []
            for url, source in zip(b["url"], b["html"]):
                root = parsers.tree(source)
                entries = [n for n in root.walk() if n.tag == "div" and "entry" in (n.attrs.get("class") or "")] or [root]
                n = 0
                for entry in entries:
                    hour = _hour(entry, url)
                    for sub, kind, text in _office(entry, hour):
                        n += 1
                        out.append((url, n, hour, sub, kind, text))
            yield pd.DataFrame(out, columns=["url", "paragraph_id", "hour", "subsection", "content_type", "text"])

    return pages.select("url", "html").mapInPandas(run, "url string, paragraph_id int, hour string, subsection string, content_type string, text string")


def _string(n) -> str:
    return " ".join(" ".join(s.strip() for s in n.strings() if s.strip()).split())


def _reds(n):
    return [k for k in n.walk() if k.tag == "span" and _RED.search(k.attrs.get("style") or "")]


def _hour(entry, url) -> str:
    labels = [_string(s) for s in _reds(entry)] + [_string(h) for h in entry.walk() if h.tag in ("h1", "h2", "h3", "h4")]
    for label in labels:
        for name, p in parsers._HOURS:
            if re.search(p, label, re.I):
                return name
    low = (url or "").lower()
    return next((name for name, _ in parsers._HOURS if name.lower().replace(" ", "-") in low), "Liturgy of the Hours")


#: What a label's word makes of what follows: subsection (None: the label itself) and type.
_LABELS = (
    ("RESPONSORY", "Responsory", "responsory"), ("INTERCESSION", "Intercessions", "intercession"), ("CANTICLE", None, "canticle"),
    ("CONCLUDING", "Concluding Prayer", "collect"), ("DISMISSAL", "Dismissal", "prose"), ("BLESSING", "Blessing", "collect"),
    ("EXAMINATION", "Examination of Conscience", "prose"), ("PSALMODY", "Psalmody", "prose"),
)
_NAMED = (
    (r"psalm\s+[:\d]+|revelation|luke|zechariah|isaiah|canticle", "psalm"),
    (r"(?:colossians|ephesians|isaiah|john|luke|philippians|revelation)\s+\d+", "reference"),
)


def _label_type(label: str) -> str:
    return next((kind for kind, p in parsers.LABEL_TYPES if re.search(p, label, re.I)), "prose")


def _office(entry, hour):
    sub, kind, skip = hour, "prose", False
    for p in [n for n in entry.walk() if n.tag == "p"]:
        if skip:
            skip = False
            continue
        reds = _reds(p)
        label = _string(reds[0]) if reds else None
        if label and "text-align" in (p.attrs.get("style") or "") and re.match(_NAMED[0][0], label, re.I):
            sub, kind = label, "psalm"
            continue
        if label and re.match(_NAMED[1][0], label, re.I):
            continue
        if label:
            new = _label_type(label)
            if new == "skip":
                skip = True
                continue
            if new == "antiphon":
                kind = "antiphon"
            elif new == "reading":
                place = label[len("reading") :].strip()
                sub, kind = f"Reading: {place}" if place else "Reading", "reading"
                continue
            elif new in ("psalm_prayer", "versicle"):
                kind = new
                continue
            elif new == "hymn":
                sub, kind = "Hymn", "hymn"
                continue
            elif new == "label":
                for word, name, what in _LABELS:
                    if word in label.upper():
                        sub, kind = name or label.title(), what
                        break
                continue
        text = _string(p)
        if text:
            yield sub, kind, text


_MONTHS = {m: i for i, m in enumerate("JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split(), 1)}


def calendar_days(lines: DataFrame) -> DataFrame:
    """lines: file, seq, line of a liturgical calendar. file, date, day_of_week, celebration, rank, color, season.

    Month headers and days that fall below the one before move the date on. One sort by file and line; a line belongs to
    the last day line before it, and months follow by running sums, so no file has to fit in memory.
    """
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.trim("line")
    month = "|".join(_MONTHS)
    head = rf"(?i)^({month})(?:\s*[-–/]\s*(?:{month}))?\s+(\d{{4}})$"
    m = F.upper(F.regexp_extract(t, head, 1))
    number = F.lit(None).cast("int")
    for name, i in _MONTHS.items():
        number = F.when(m == name, i).otherwise(number)
    day = r"^([0-9]{1,2})\s+(?i:(Fri|Mon|Sat|Sun|Thu|Tue|Wed)[a-z]*)\s+(.*)$"
    x = lines.select("file", "seq", t.alias("t"), F.when(number.isNotNull(), F.struct(number.alias("m"), F.regexp_extract(t, head, 2).cast("int").alias("y"))).alias("head"))
    x = x.withColumn("day", F.when(F.col("t").rlike(day), F.regexp_extract("t", day, 1).cast("int")))
    x = x.withColumns({"head_now": F.last("head", ignorenulls=True).over(w), "n_head": F.count("head").over(w), "n_day": F.count("day").over(w)})
    x = x.where("head_now is not null")
    # within a header's lines, every fall of the day number is a new month
    per = Window.partitionBy("file", "n_head").orderBy("seq")
    d = x.where("day is not null").withColumn("fall", F.coalesce((F.col("day") < F.lag("day").over(per)).cast("int"), F.lit(0)))
    d = d.withColumn("months", F.col("head_now.y") * 12 + F.col("head_now.m") - 1 + F.sum("fall").over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = F.trim(F.regexp_extract("t", day, 3))
    color = r"(?i)\b(white|red|green|violet|purple|rose|black)(?:\s+or\s+\w+)*\s*$"
    d = d.select(
        "file", "seq", "n_day",
        F.format_string("%d-%02d-%02d", F.floor(F.col("months") / 12), F.col("months") % 12 + 1, F.col("day")).alias("date"),
        F.initcap(F.lower(F.substring(F.regexp_extract("t", day, 2), 1, 3))).alias("day_of_week"),
        F.trim(F.regexp_replace(rest, color, "")).alias("celebration"), F.lower(F.regexp_extract(rest, color, 1)).alias("color"),
    )
    ranks = x.where("day is null and t rlike '^(?:Feast|Memorial|Solemnity)'").groupBy("file", "n_day").agg(F.array_sort(F.collect_list(F.struct("seq", F.trim(F.substring_index("t", "[", 1)).alias("r")))).alias("rs"))
    d = d.join(ranks, ["file", "n_day"], "left").withColumn("rank", F.coalesce(F.array_join("rs.r", "; "), F.lit("")))
    from scriptora.operators.corpus import fill_seasons

    d = d.withColumn("season", F.nullif(season_of(F.col("celebration")), F.lit("")))
    filled = fill_seasons(d.withColumn("year", F.col("file")))
    return filled.select("file", "date", "day_of_week", "celebration", "rank", "color", "season")


_SEASONS = (
    ("Advent", "ADVENT"), ("Christmas", "CHRISTMAS|NATIVITY|EPIPHANY|BAPTISM OF THE LORD"), ("Lent", "ASH WEDNESDAY|LENT|PALM SUNDAY"),
    ("Triduum", "HOLY THURSDAY|GOOD FRIDAY|HOLY SATURDAY"), ("Easter", "EASTER|PASCHAL|PENTECOST"), ("Ordinary Time", "ORDINARY TIME|^WEEKDAY$"),
)


def season_of(celebration: Column) -> Column:
    c, out = F.upper(celebration), F.lit("")
    for name, p in reversed(_SEASONS):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def numbered_paragraphs(lines: DataFrame, low: int = 1, high: int = 2865) -> DataFrame:
    """lines: doc_id, text. doc_id, number, text: the longest text of each paragraph number in the range."""
    p = r"(?s)^\s*(\d{1,4})\s+(\S.*)$"
    n = F.regexp_extract("text", p, 1)
    x = lines.where(n != "").select("doc_id", n.cast("int").alias("number"), F.trim(F.regexp_extract("text", p, 2)).alias("t")).where(F.col("number").between(low, high))
    return x.groupBy("doc_id", "number").agg(F.max_by("t", F.struct(F.length("t"), "t")).alias("text"))


def primary_hierarchy(sources: DataFrame, pieces: DataFrame) -> DataFrame:
    """sources: piece_id, seq, text, hierarchy; pieces: piece_id, text. The hierarchy that shares most distinct words with
    the piece (of equal ones the first), and whether the sources' hierarchies differ."""
    low = lambda c: F.array_distinct(F.transform(T.words(c), F.lower))
    j = sources.withColumn("__w", low(F.col("text"))).drop("text").join(pieces.select("piece_id", low(F.col("text")).alias("__p")), "piece_id")
    j = j.withColumn("n", F.size(F.array_intersect("__w", "__p")))
    return j.groupBy("piece_id").agg(
        F.max_by("hierarchy", F.struct("n", -F.col("seq"))).alias("hierarchy"), (F.size(F.collect_set(F.to_json("hierarchy"))) > 1).alias("crossed")
    )
