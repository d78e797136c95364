"""EPUB books to paragraph rows: spine, table of contents, cleaned trees, headings, blocks.

A book is one row (path, content) and one unit of work: its walk is sequential by nature and runs in Arrow batches, a
book at a time, so there is no shuffle. A book that can't be read gives one row with its error and no text.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.functions import text as T
from scriptora.operators.parsers import _clean, _Node, tree


@dataclass(frozen=True)
class EpubConfig:
    """contents_level: the level of the first depth of the table of contents; headings of the text come below it."""

    contents_level: int = 1
    min_paragraph_words: int = 6
    min_block_words: int = 30
    keep_across_documents: bool = False
    reset_depth: int = 2
    visual_headings: bool = True
    font_threshold: float = 1.3
    denied_classes: str = r"^(?:calibre\d+|note|footnote)$"


@dataclass
class Contents:
    """Titles and depths of a table of contents by file and by title (first ones win) and by anchor (last ones win)."""

    files: dict[str, tuple[str, int]] = field(default_factory=dict)
    anchors: dict[str, tuple[str, int]] = field(default_factory=dict)
    titles: dict[str, int] = field(default_factory=dict)

    def add(self, href: str, title: str, depth: int) -> None:
        title = clean_title(_clean(title))
        if not title:
            return
        base, _, anchor = href.lstrip("./").partition("#")
        if base:
            self.files.setdefault(base, (title, depth))
        if anchor:
            self.anchors[anchor] = (title, depth)
        self.titles.setdefault(title.lower().strip(), depth)


_NUMBERS = (
    r"(?i)^\s*chap(?:ter|\.)?\s*[0-9]+\s*[–—:.\-]\s*", r"^\s*[0-9]+\s*[.)]", r"(?i)^\s*[CILVX]{2,}\s*[).]", r"^\s*[0-9]+\s+", r"^[\s.)\-–—]+",
)


def clean_title(s: str) -> str:
    """functions.text.clean_toc_title for cleaned strings on the executors."""
    for p in _NUMBERS:
        s = re.sub(p, "", s)
    return s


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


@dataclass
class Book:
    """An EPUB's package: its metadata, the documents of its spine as (order, name, source), its table of contents."""

    metadata: dict[str, list[str]]
    spine: list[tuple[int, str, str]]
    contents: Contents


def open_book(content: bytes) -> Book:
    """Raises ValueError for a book without a spine. Documents of navigation are left out of the spine."""
    z = zipfile.ZipFile(io.BytesIO(content))
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    package = ElementTree.fromstring(z.read(opf))
    folder = posixpath.dirname(opf)
    items = {e.get("id"): e for e in package.iter() if _local(e) == "item"}
    refs = [e.get("idref") for e in package.iter() if _local(e) == "itemref"]
    if not refs:
        raise ValueError("the EPUB has no spine")
    inside = lambda href: posixpath.normpath(posixpath.join(folder, href))
    metadata: dict[str, list[str]] = {}
    for e in package.iter():
        if _local(e) == "metadata":
            for m in e:
                if (m.text or "").strip():
                    metadata.setdefault(_local(m), []).append(m.text.strip())
    spine = []
    for k, ref in enumerate(refs):
        item = items.get(ref)
        if item is None or "nav" in (item.get("properties") or "").split():
            continue
        name = item.get("href").lstrip("./")
        if not re.search(r"(?:^|/)(?:contents|nav|toc)\.x?html?$", name, re.I):
            spine.append((k, name, z.read(inside(item.get("href"))).decode("utf-8", "replace")))
    return Book(metadata, spine, _contents(z, items, inside))


def _contents(z, items, inside) -> Contents:
    """From the NCX, or where there is none from the navigation document."""
    out = Contents()
    for item in items.values():
        if item.get("media-type") == "application/x-dtbncx+xml":
            points = ElementTree.fromstring(z.read(inside(item.get("href"))))
            for top in (e for e in points.iter() if _local(e) == "navMap"):
                _ncx(top, 1, out)
            return out
    for item in items.values():
        if "nav" in (item.get("properties") or "").split():
            root = tree(z.read(inside(item.get("href"))).decode("utf-8", "replace"))
            for nav in (n for n in root.walk() if n.tag == "nav" and n.attrs.get("epub:type", "toc") == "toc"):
                _nav(nav, 0, out)
            return out
    return out


def _ncx(node, depth: int, out: Contents) -> None:
    for p in node:
        if _local(p) == "navPoint":
            label = next((e for e in p if _local(e) == "navLabel"), None)
            target = next((e.get("src") or "" for e in p if _local(e) == "content"), "")
            out.add(target, "".join(label.itertext()) if label is not None else "", depth)
            _ncx(p, depth + 1, out)


def _nav(node, depth: int, out: Contents) -> None:
    """A list is one level deeper than what it is in."""
    for n in node.kids:
        if isinstance(n, _Node):
            deeper = depth + (n.tag == "ol")
            if n.tag == "a":
                out.add(n.attrs.get("href") or "", "".join(n.strings()), max(depth, 1))
            _nav(n, deeper, out)


_NOTE_CLASSES = {"sup": {"noteref", "footnote"}, "a": {"noteref", "footnote"}}
_SMALL_CAPS = {"smallcaps", "smcap", "sc", "caps"}
_DROP_CAPS = {"dropcap", "dropcaps", "drop-cap", "initial"}


def _classes(n: _Node) -> set[str]:
    return set((n.attrs.get("class") or "").split())


def sanitize(root: _Node) -> None:
    """Scripts, styles and references to notes go, line breaks are spaces, small capitals one string, drop capitals join
    the text after them."""
    for n in list(root.walk()):
        at = n.parent
        if at is None or n not in at.kids:
            continue
        i, cls = at.kids.index(n), _classes(n)
        note = n.tag == "a" and "noteref" in (n.attrs.get("epub:type") or "").split()
        if n.tag in ("script", "style") or note or cls & _NOTE_CLASSES.get(n.tag, set()):
            del at.kids[i]
        elif n.tag == "br":
            at.kids[i] = " "
        elif cls & _SMALL_CAPS or "small-caps" in (n.attrs.get("style") or ""):
            n.kids = ["".join(s.strip() for s in n.strings())]
        elif cls & _DROP_CAPS:
            letter, k = "".join(s.strip() for s in n.strings()), i + 1
            while k < len(at.kids) and isinstance(at.kids[k], str) and not at.kids[k].strip():
                k += 1
            if k < len(at.kids) and isinstance(at.kids[k], str):
                at.kids[i : k + 1] = [letter + at.kids[k].lstrip()]
            else:
                at.kids[i] = letter + " "


_CONTAINERS = frozenset("section article div aside header footer main span a em strong".split())
_INLINE = frozenset("span a em strong".split())
_PROSE = frozenset("p blockquote pre figure".split())
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_ALL = _CONTAINERS | _PROSE | _HEADINGS | {"li"}


def _em(style: str) -> tuple[float, str] | None:
    m = re.search(r"font-size\s*:\s*([0-9.]+)(em|rem|%|pt|px)", style or "", re.I)
    try:
        return (float(m[1]), m[2].lower()) if m else None
    except ValueError:
        return None


def is_large(style: str, threshold: float = 1.3) -> bool:
    size = _em(style)
    least = {"em": threshold, "rem": threshold, "%": 100 * threshold, "pt": 16, "px": 20}
    return size is not None and size[0] >= least[size[1]]


def heading_like(s: str) -> bool:
    """At most 15 words, all in capitals or over .7 of them with a capital."""
    w = s.split()
    return 0 < len(w) <= 15 and (s.isupper() or sum(x[0].isupper() for x in w) / len(w) > 0.7)


def visual_level(n: _Node, cfg: EpubConfig) -> int | None:
    """The level of an element that looks like a heading (two of: large font, emphasis, text like a heading), else None."""
    s, style = _clean("".join(n.strings())), n.attrs.get("style") or ""
    if not 0 < len(s.split()) <= 15:
        return None
    if is_large(style, cfg.font_threshold) + (n.first("strong", "b") is not None) + heading_like(s) < 2:
        return None
    size = _em(style)
    em = size[0] / {"%": 100, "pt": 12, "px": 16}.get(size[1], 1) if size else 0
    return 1 if em >= 2 else 2 if em >= 1.5 or em < 1.3 else 3


def blocks(source: str, name: str, levels: list[str], contents: Contents, cfg: EpubConfig) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(text, tag, six levels) of a document's paragraphs; levels is the state of the headings and goes on after it."""
    root = tree(source)
    sanitize(root)
    body = root.first("body") or root
    denied = re.compile(cfg.denied_classes, re.I)

    def heading(level: int, title: str) -> None:
        levels[level - 1 :] = [title] + [""] * (6 - level)

    section = contents.files.get(name, ("", 1))
    if section[0]:
        heading(min(cfg.contents_level + section[1] - 1, 6), section[0])
    now = section[0]

    def anchored(n: _Node) -> None:
        nonlocal now
        title, depth = contents.anchors.get(n.attrs.get("id") or n.attrs.get("name") or "", ("", 1))
        if title and title != now:
            now = title
            heading(min(cfg.contents_level + depth - 1, 6), title)

    taken = set()
    if cfg.visual_headings:
        for n in body.walk():
            if n.tag in ("p", "div", "span"):
                anchored(n)
                level = visual_level(n, cfg)
                if level is not None:
                    heading(level, _clean("".join(n.strings())))
                    taken.add(id(n))
    before = None
    for n in body.walk():
        if n.tag not in _ALL:
            continue
        anchored(n)
        raw = "".join(n.strings())
        if n.tag in _HEADINGS:
            title = _clean(raw)
            if title:
                known = contents.titles.get((clean_title(title) or title).lower().strip())
                level = min(cfg.contents_level + (known - 1 if known is not None else int(n.tag[1])), 6)
                if level > cfg.contents_level:
                    heading(level, title)
            continue
        if id(n) in taken or (n.tag in _INLINE and _within(n, _PROSE | {"li"})):
            continue
        cls = " ".join((n.attrs.get("class") or "").split())
        s = raw.strip("\n") if n.tag == "pre" else _clean(raw)
        if (cls and denied.search(cls)) or not s:
            continue
        if n.tag == "li":
            if n.first("p", "blockquote", "pre", "figure", "div") is not None:
                continue
            s = _clean("• " + s)
        elif n.tag in _CONTAINERS:
            if any(k.tag in _ALL for k in n.walk()) or len(s.split()) < max(2 * cfg.min_paragraph_words, cfg.min_block_words):
                continue
        if n.tag != "pre" and len(s.split()) < cfg.min_paragraph_words:
            continue
        if "NOTES" in levels:
            s = re.sub(r"^\s*(?:\d+|[IVXLC]+)\s*[.)]?\s*", "", s)
        # what the block before has as well isn't told again
        if before is None or s not in before:
            yield s, n.tag, tuple(levels)
            before = s


def _within(n: _Node, tags) -> bool:
    p = n.parent
    while p is not None:
        if p.tag in tags:
            return True
        p = p.parent
    return False


def windows_of(texts: list[str], size: int, overlap: int, least: int) -> Iterator[str]:
    """functions.windows.fixed_windows for strings on the executors."""
    w = " ".join(texts).split()
    for i in range(0, len(w), size - overlap):
        if len(w[i : i + size]) >= least:
            yield " ".join(w[i : i + size])


def book_paragraphs(content: bytes, cfg: EpubConfig = EpubConfig()) -> Iterator[tuple]:
    """(spine order, name, paragraph_id, text, tag, levels) of a book, each text (white space folded) once a hierarchy."""
    book, levels, n, seen = open_book(content), [""] * 6, 0, set()
    for k, name, source in book.spine:
        if not cfg.keep_across_documents:
            levels[cfg.reset_depth - 1 :] = [""] * (7 - cfg.reset_depth)
        found = list(blocks(source, name, levels, book.contents, cfg))
        if not found:
            # a document without a block of enough words is cut into windows
            root = tree(source)
            sanitize(root)
            if not any(_clean("".join(x.strings())) for x in (root.first("body") or root).walk() if x.tag in _ALL - _HEADINGS):
                found = [(t, "fallback_window", tuple(levels)) for t in windows_of([_clean("".join(root.strings()))], 100, 20, cfg.min_paragraph_words)]
        for s, tag, at in found:
            n += 1
            key = (" ".join(s.split()), at)
            if key not in seen:
                seen.add(key)
                yield k, name, n, s, tag, at


_SCHEMA = "path string, spine int, chapter_href string, paragraph_id int, text string, source_tag string, error string, " + ", ".join(f"{x} string" for x in T.LEVELS)


def epub_paragraphs(files: DataFrame, cfg: EpubConfig = EpubConfig()) -> DataFrame:
    """files: path, content (as the binaryFile source gives them). Paragraph rows with hierarchy in spine order."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 9]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    out = [(path, k, name, n, s, tag, None, *at) for k, name, n, s, tag, at in book_paragraphs(content.as_py(), cfg)]
                except Exception as e:  # noqa: BLE001 - any damaged file is its own row
                    out = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}", *[""] * 6)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    flat = files.select("path", "content").mapInArrow(run, _SCHEMA)
    kind = F.when(F.col("source_tag").isin("pre", "code"), "code").when(F.col("source_tag") == "li", "list").otherwise("prose")
    return flat.select(*[c for c in flat.columns if c not in T.LEVELS], kind.alias("content_type"), F.struct(*T.LEVELS).alias("hierarchy"))


def epub_metadata(files: DataFrame) -> DataFrame:
    """path, title, authors, language, publisher, identifier, description (cleaned), subjects; nulls for a book that can't be read."""
    schema = "path string, title string, authors array<string>, language string, publisher string, identifier string, description string, subjects array<string>"

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    m = open_book(content.as_py()).metadata
                except Exception:  # noqa: BLE001 - epub_paragraphs tells the error
                    m = None
                one = lambda k: (m.get(k) or [""])[0] if m is not None else None  # noqa: B023, E731
                many = lambda k: m.get(k, []) if m is not None else None  # noqa: B023, E731
                out.append((path, one("title"), many("creator"), one("language"), one("publisher"), one("identifier"), clean_description(one("description")), many("subject")))
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)


def clean_description(s: str | None) -> str | None:
    """A description without its tags; its pieces of text are joined by spaces."""
    return None if s is None else _clean(" ".join(x.strip() for x in tree(s).strings() if x.strip()))


def with_contents(paragraphs: DataFrame, toc: tuple[DataFrame, DataFrame, DataFrame], href: Column) -> DataFrame:
    """Paragraph rows of other sources with the title and depth that a table of contents has for their file.

    toc: what archive.toc_maps() gives. The maps are small and of unknown size: the planner broadcasts what fits.
    """
    files = toc[0].select(F.col("doc_id").alias("toc_doc"), "base", F.col("title").alias("toc_title"), F.col("depth").alias("toc_depth"))
    on = (paragraphs["doc_id"] == F.col("toc_doc")) & (href == F.col("base"))
    return paragraphs.join(files, on, "left").drop("toc_doc", "base")
