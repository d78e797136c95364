"""Documents of a format to paragraph rows: HTML, Markdown, and page predicates."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions import text as T
from scriptora.operators.headings import with_hierarchy

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_WANTED = frozenset("h1 h2 h3 h4 h5 h6 p div li blockquote pre code".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.kids, self.parent = tag, dict(attrs), [], parent

    def walk(self):
        for k in self.kids:
            if isinstance(k, _Node):
                yield k
                yield from k.walk()

    def strings(self):
        for k in self.kids:
            if not isinstance(k, _Node):
                yield k
            elif k.tag not in ("script", "style", "template"):
                yield from k.strings()

    def first(self, *tags):
        for t in tags:
            for n in self.walk():
                if n.tag == t:
                    return n
        return None


class _Tree(HTMLParser):
    """A lenient tree: an open p ends at a block, list items and cells at the next of their kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("")

    def _close(self, tags, stop=()):
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close({"p"}, {"td", "th", "button", "object"})
        if tag in _ENDS:
            self._close(_ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        node = _Node(tag, attrs, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag})

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(source: str) -> _Node:
    t = _Tree()
    t.feed(source or "")
    t.close()
    return t.root


_INVISIBLE = re.compile("[­​-‍⁠﻿]")


def _clean(s: str) -> str:
    """The cleaning rule for strings on the executors; same steps as functions.text.clean_text, with NFC first."""
    import unicodedata

    s = re.sub(r"<[^>]+>", "", _INVISIBLE.sub("", unicodedata.normalize("NFC", s)))
    s = re.sub(r"\s+", " ", s).strip()
    for pattern, to in ((rf"(\b[0-9]+)({T.CAP}[a-z])", r"\1 \2"), (r"(\b[0-9]+)\s+\.", r"\1."), (r"\s+([,;:!?])", r"\1"), (r"\s+([.\"')\]}])", r"\1"), (r"([(\[\"'])\s+", r"\1")):
        s = re.sub(pattern, to, s)
    s = re.sub(rf"\b(?:{T.CAP}\s){{2,}}{T.CAP}\b", lambda m: m[0].replace(" ", ""), s)
    return re.sub(rf"\b({T.CAP})\s(?={T.CAP}{{2,}}\b)", r"\1", s)


def html_items(source: str):
    """(seq, tag, level or None, text): headings with their level, and every block with a text, nested ones as well."""
    root = tree(source)
    at = root.first("main", "article", "body") or root
    seq = 0
    for n in at.walk():
        if n.tag not in _WANTED:
            continue
        heading = len(n.tag) == 2 and n.tag[0] == "h"
        if n.tag == "code":
            p = n.parent
            while p is not None and p.tag != "pre":
                p = p.parent
            if p is not None:
                continue
        raw = "".join(n.strings()) if heading else " ".join(s.strip() for s in n.strings() if s.strip())
        cleaned = _clean(raw)
        if cleaned:
            seq += 1
            yield seq, n.tag, int(n.tag[1]) if heading else None, cleaned


def html_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_words: int = 1) -> DataFrame:
    """doc_id, paragraph_id, text, source_tag, content_type, hierarchy of HTML pages.

    The walk is sequential by nature and runs in Arrow batches; heading state goes along with it, so there is no shuffle.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for i, source in zip(b["doc_id"], b["html"]):
                levels, n = [""] * 6, 0
                for _, tag, level, text in html_items(source):
                    if level is not None:
                        levels[level - 1 :] = [text[:100]] + [""] * (6 - level)
                    elif len(text.split()) >= least_words:
                        n += 1
                        kind = "code" if tag in ("pre", "code") else "list" if tag == "li" else "prose"
                        out.append((i, n, text, tag, kind, *levels))
            yield pd.DataFrame(out, columns=["doc_id", "paragraph_id", "text", "source_tag", "content_type", *T.LEVELS])

    flat = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(
        run, f"doc_id {kind}, paragraph_id int, text string, source_tag string, content_type string, " + ", ".join(f"{x} string" for x in T.LEVELS)
    )
    return flat.select("doc_id", "paragraph_id", "text", "source_tag", "content_type", F.struct(*T.LEVELS).alias("hierarchy"))


def html_metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id, title (else the first h1, else Untitled), lang, n_paragraphs, n_links, n_words by patterns alone."""
    h = F.col(html_col)
    bare = h
    for p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        bare = F.regexp_replace(bare, p, "")
    title = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)
    h1 = F.regexp_replace(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    found = F.coalesce(F.nullif(fold(title), F.lit("")), F.nullif(fold(h1), F.lit("")), F.lit("Untitled"))
    return pages.select(
        F.col(id_col).alias("doc_id"),
        unescape(found).alias("title"),
        F.lower(F.regexp_extract(h, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", 1)).alias("lang"),
        F.regexp_count(bare, F.lit(r"(?i)<p[\s>]")).alias("n_paragraphs"),
        F.regexp_count(bare, F.lit(r"(?i)<a[\s>]")).alias("n_links"),
        T.word_count(F.regexp_replace(bare, "<[^>]*>", "")).alias("n_words"),
    )


def unescape(c: Column) -> Column:
    """The five named entities of XML."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def is_document_page(n_paragraphs: Column, n_words: Column, n_links: Column) -> Column:
    return (n_paragraphs >= 3) & (n_words >= 100) & (n_links <= 3 * n_paragraphs)


def meta_language(html: Column) -> Column:
    """The content of a page's meta tags on its language, lower-cased and joined, or ''."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)(?:http-equiv\s*=\s*["']?content-language|name\s*=\s*["']?language)\b"""))
    return F.lower(F.array_join(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)\bcontent\s*=\s*["']?([^"'>]*)""", 1)), " "))


def is_english(url: Column, lang: Column, title: Column, html: Column | None = None) -> Column:
    """By URL, then the page's language, its meta tags, its title, and last a link to an English version."""
    html = F.lit("") if html is None else F.coalesce(html, F.lit(""))
    linked = F.lower(html).rlike(r"""(?s)<a\b[^>]*href\s*=\s*["']?[^"'>]*_en\.htm|<a\b[^>]*>[^<]*english""")
    return (
        F.when(url.rlike(r"(?i)/eng[0-9]+/|_en\.html?$|/en/|/english/"), True)
        .when(F.lower(F.coalesce(lang, F.lit(""))).startswith("en"), True)
        .when(F.coalesce(lang, F.lit("")) != "", False)
        .when(meta_language(html).contains("en"), True)
        .when(F.lower(F.coalesce(title, F.lit(""))).rlike("english|catechism|new american bible"), True)
        .otherwise(linked & F.lower(url).contains("_en.htm"))
    )


def format_of(path: Column) -> Column:
    """The format by a file's extension, null if it has none of ours."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for f, names in {"epub": ["epub"], "html": ["htm", "html"], "json": ["json"], "markdown": ["markdown", "md", "txt"], "pdf": ["pdf"]}.items():
        out = F.when(ext.isin(names), f).otherwise(out)
    return out


def front_matter(content: Column) -> tuple[Column, Column]:
    """(body, map of keys and values) of a text that may start with a block between --- lines."""
    bar = "-{3}" + r"\s*\n"
    p = rf"(?s)\A{bar}(.*?)\n{bar}"
    block = F.regexp_extract(content, p, 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    entry = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"\A[^:]*:", "")).alias("v")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda o: o["k"] == e["k"]))
    return F.regexp_replace(content, p, ""), F.map_from_entries(last)


def markdown_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, code: bool = True, spaced_caps: bool = True) -> DataFrame:
    """doc_id, paragraph_id, text, source_tag, content_type, hierarchy of Markdown: headings with #, fenced code, and
    paragraphs of adjacent lines. Windows over a document's lines, all on one partitioning and order."""
    body, _ = front_matter(F.coalesce(F.col(text_col), F.lit("")))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(body, "\n")).alias("ln", "line"))
    w = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bare = F.trim("line")
    fence = bare.startswith("```") if code else F.lit(False)
    lines = lines.withColumn("fence", fence)
    lines = lines.withColumn("n_fence", F.sum(F.col("fence").cast("int")).over(w))
    inside = (F.col("n_fence") % 2 == 1) & ~F.col("fence")
    lines = lines.withColumns({"inside": inside, "heading": ~inside & ~F.col("fence") & F.col("line").rlike(r"^#{1,6}\s+.")})
    starts = F.col("fence") | (~F.col("inside") & ((bare == "") | F.col("line").rlike(r"^#{1,6}\s")))
    # a run of code lines shares its fence's number, a paragraph that of the last line that broke one off
    lines = lines.withColumn("run", F.sum(starts.cast("int")).over(w))
    level = F.when(F.col("heading"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    title = F.trim(F.regexp_replace("line", r"^#+\s+", ""))
    lines = with_hierarchy(lines, ["doc_id"], "ln", level, title)
    parts = lines.where(~F.col("heading") & ~F.col("fence") & (F.col("inside") | (bare != "")))
    ordered = F.array_sort(F.collect_list(F.struct("ln", "line")))
    g = parts.groupBy("doc_id", "run", "inside").agg(F.min("ln").alias("ln"), F.min_by("hierarchy", "ln").alias("hierarchy"), ordered.alias("ls"))
    text = F.when(F.col("inside"), F.array_join("ls.line", "\n")).otherwise(T.clean_text(F.array_join("ls.line", " "), spaced_caps))
    g = g.withColumn("text", text).where((F.trim("text") != "") & (F.col("inside") | (T.word_count(F.col("text")) >= least_words)))
    return g.select(
        "doc_id",
        F.row_number().over(Window.partitionBy("doc_id").orderBy("ln")).alias("paragraph_id"),
        "text",
        F.when(F.col("inside"), "code_block").otherwise("p").alias("source_tag"),
        F.when(F.col("inside"), "code").otherwise("prose").alias("content_type"),
        "hierarchy",
    )


_HOURS = (
    ("Invitatory", "invitatory"), ("Office of Readings", r"office\s+of\s+readings?"), ("Morning Prayer", r"lauds|morning\s+prayer"),
    ("Midmorning Prayer", r"terce|midmorning\s+prayer"), ("Midday Prayer", r"sext|midday\s+prayer"),
    ("Midafternoon Prayer", r"none|midafternoon\s+prayer"), ("Evening Prayer", r"vespers|evening\s+prayer"), ("Night Prayer", r"compline|night\s+prayer"),
)


def hour_of(label: Column) -> Column:
    """The canonical hour that a label names first in the list, null if none."""
    out = F.lit(None).cast("string")
    for name, p in reversed(_HOURS):
        out = F.when(label.rlike("(?i)" + p), name).otherwise(out)
    return out


#: What a red label of an hour begins: the first pattern that it has, in any case.
LABEL_TYPES = (
    ("hymn", "^hymn$"), ("label", "^psalmody$"), ("antiphon", r"^ant\."), ("psalm_prayer", "^psalm.prayer$"), ("reading", r"^reading\b"),
    ("label", r"^sacred\s+silence"), ("label", r"^responsory$"), ("label", r"^canticle\b"), ("label", r"^intercessions?$"), ("label", r"^concluding\s+prayer"),
    ("label", r"^(?:dismissal|blessing)$"), ("label", r"^antiphon\s+or\s+song"), ("label", r"^examination\s+of\s+conscience"), ("versicle", r"^opening\s+verse"),
    ("skip", r"^ribbon\s+placement"), ("label", r"^(?:evening|invitatory|midafternoon|midday|midmorning|morning|night|office\s+of\s+readings?)\s+prayer\b"),
    ("label", r"\bprayer\s+for\s+"),
)


def red_label_type(label: Column) -> Column:
    """The type of what follows a red label of an hour."""
    out = F.lit("prose")
    for kind, p in reversed(LABEL_TYPES):
        out = F.when(label.rlike("(?i)" + p), kind).otherwise(out)
    return out


def norm_href(c: Column, keep_fragment: bool = False) -> Column:
    """A link without leading dots and slashes; its fragment goes unless kept."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[./]+", "")
    return c if keep_fragment else F.substring_index(c, "#", 1)
