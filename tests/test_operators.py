"""Parsers, chunking, corpora, sinks and streams on small made-up rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptora.functions import text
from scriptora.operators import epub as epub_books
from scriptora.operators import chunking, code, corpus, headings, parsers, pdf
from scriptora.sources import readers, sinks


def test_html_walk(spark):
    page = """<html><head><title>T</title><script>x()</script></head><body><nav><a href=a>skip?</a></nav><article><h1>One</h1><p>First <b>bold</b> words
    <p>Second<ul><li>item a<li>item b</ul><h3>Deep</h3><div>outer <p>inner text</p></div><h2>Two</h2><pre><code>x = 1</code></pre><p> </p></article></body></html>"""
    p = parsers.html_paragraphs(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("paragraph_id").collect()
    assert [(r.text, r.source_tag, r.content_type) for r in p] == [
        ("First bold words", "p", "prose"), ("Second", "p", "prose"), ("item a", "li", "list"), ("item b", "li", "list"),
        ("outer inner text", "div", "prose"), ("inner text", "p", "prose"), ("x = 1", "pre", "code"),
    ]
    assert [text_of(r.hierarchy) for r in p[3:]] == [("One", "", ""), ("One", "", "Deep"), ("One", "", "Deep"), ("One", "Two", "")]


def text_of(h, n=3):
    return tuple(h[x] for x in text.LEVELS[:n])


def test_markdown(spark):
    md = "---\ntitle: A: b\nx: 1\n---\n# Top\nintro line\nnext line\n\n## Sub\nbody\n```py\ndef f():\n\n  # not a heading\n```\ntail\n#### Deep\nend\n# Other\nlast"
    d = spark.createDataFrame([("a", md), ("b", None), ("c", "plain\n\n\nmore")], "doc_id string, text string")
    rows = parsers.markdown_paragraphs(d).orderBy("doc_id", "paragraph_id").collect()
    assert [(r.text, r.content_type) for r in rows if r.doc_id == "a"] == [
        ("intro line next line", "prose"), ("body", "prose"), ("def f():\n\n  # not a heading", "code"), ("tail", "prose"), ("end", "prose"), ("last", "prose"),
    ]
    assert [text_of(r.hierarchy, 4) for r in rows if r.doc_id == "a"] == [
        ("Top", "", "", ""), ("Top", "Sub", "", ""), ("Top", "Sub", "", ""), ("Top", "Sub", "", ""), ("Top", "Sub", "", "Deep"), ("Other", "", "", ""),
    ]
    assert [r.paragraph_id for r in rows if r.doc_id == "c"] == [1, 2]
    front = d.where("doc_id = 'a'").select(parsers.front_matter(F.col("text"))[1].alias("m")).first().m
    assert front == {"title": "A: b", "x": "1"}


def test_pdf_pages_and_spans(spark):
    pages = spark.createDataFrame([(1, 1, "THE TITLE\n\nsome body text of it\n\nmore text here"), (1, 2, None), (1, 3, "still the same part")], "doc_id long, page_num int, text string")
    rows = pdf.page_paragraphs(pages).orderBy("paragraph_id").collect()
    assert [(r.text, r.hierarchy.level_1) for r in rows] == [("some body text of it", "THE TITLE"), ("more text here", "THE TITLE"), ("still the same part", "THE TITLE")]
    spans = [(1, 1, b, 0, 0, 20.0 if b % 2 == 0 else 10.0, False, False, False, f"Head {b}" if b % 2 == 0 else f"body text number {b} is longer") for b in range(12)]
    s = spark.createDataFrame(spans, "doc_id long, page_num int, block_idx int, line_idx int, span_idx int, font_size double, is_bold boolean, is_italic boolean, is_mono boolean, text string")
    assert pdf.body_font(s).first().body_size == 10.0
    assert [(r["size"], r.level) for r in pdf.heading_sizes(s).collect()] == [(20.0, 1)]
    rows = pdf.span_paragraphs(s).orderBy("paragraph_id").collect()
    assert len(rows) == 6 and rows[2].hierarchy.level_1 == "Head 4"


def test_visual_headings(spark):
    rows = [("font-size: 1.4em", True, "any text at all here"), ("font-size:20px", False, "ALL CAPS"), ("", True, "plain words of prose"), ("font-size: 150%", False, "plain words of prose"), ("", True, "x " * 20)]
    d = spark.createDataFrame(rows, "style string, b boolean, t string")
    got = d.select(headings.is_visual_heading(F.col("style"), F.col("b"), F.col("t"), text.words(F.col("t"))).alias("v"), headings.level_of_size(F.col("style")).alias("l")).collect()
    assert [r.v for r in got] == [True, True, False, False, False] and [r.l for r in got] == [3, 2, 2, 2, 2]  # 20 px are 1.25 em


def epub(spine=True):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = '<item id="n" href="nav.xhtml" properties="nav"/><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/>'
        refs = '<itemref idref="n"/><itemref idref="a"/><itemref idref="b"/>' if spine else ""
        z.writestr("O/c.opf", f'<package xmlns="v"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        z.writestr("O/nav.xhtml", "<body><p>nav</p></body>")
        z.writestr("O/a.xhtml", "<body><h1>A</h1><p>one two</p></body>")
        z.writestr("O/b.xhtml", "<body><p>three</p></body>")
    return b.getvalue()


def test_epub(spark):
    f = spark.createDataFrame([("x", epub()), ("bad", b"no zip"), ("empty", epub(False))], "path string, content binary")
    rows = epub_books.epub_paragraphs(f, epub_books.EpubConfig(min_paragraph_words=1)).orderBy("path", "paragraph_id").collect()
    assert [(r.text, r.hierarchy.level_1, r.chapter_href) for r in rows if r.path == "x"] == [("one two", "", "a.xhtml"), ("three", "", "b.xhtml")]
    assert [r.hierarchy.level_2 for r in rows if r.path == "x"] == ["A", ""]  # headings come below the contents' level
    assert all(r.text is None and r.error for r in rows if r.path != "x")


NCX = """<ncx xmlns="n"><navMap><navPoint><navLabel><text>1. First Part</text></navLabel><content src="a.xhtml"/>
<navPoint><navLabel><text>Inner Section</text></navLabel><content src="a.xhtml#in"/></navPoint></navPoint></navMap></ncx>"""


def book(*documents, toc=NCX, meta=""):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{n}" href="{n}.xhtml"/>' for n, _ in documents)
        z.writestr("c.opf", f'<package xmlns="v" xmlns:dc="d"><metadata>{meta}</metadata><manifest>{items}<item id="t" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{"".join(f"""<itemref idref="{n}"/>""" for n, _ in documents)}</spine></package>')
        z.writestr("t.ncx", toc)
        for n, body in documents:
            z.writestr(f"{n}.xhtml", f"<html><body>{body}</body></html>")
    return b.getvalue()


def told(content, **cfg):
    return [(s, tag, [x for x in at if x]) for _, _, _, s, tag, at in epub_books.book_paragraphs(content, epub_books.EpubConfig(**cfg))]


WORDS = "a paragraph of seven words or more"


def test_epub_contents_and_headings():
    body = f'<h1>First Part</h1><p>{WORDS} one</p><h2 id="in">Inner Section</h2><p>{WORDS} two</p><h3>Deep</h3><p>{WORDS} three</p>'
    assert told(book(("a", body), ("b", f"<p>{WORDS} four</p>"))) == [
        (f"{WORDS} one", "p", ["First Part"]), (f"{WORDS} two", "p", ["First Part", "Inner Section"]),
        (f"{WORDS} three", "p", ["First Part", "Inner Section", "Deep"]), (f"{WORDS} four", "p", ["First Part"]),
    ]


def test_epub_blocks():
    long = " ".join(f"w{i}" for i in range(30))
    body = f"""<div class="calibre1">{long} x</div><div>{long}</div><div>short one</div><div><p>{WORDS}</p></div><ul><li>{WORDS} li</li><li><p>{WORDS} in li</p></li></ul>
        <p><span>{WORDS} span</span></p><p>too few</p><pre>x = 1</pre><p class="note">{WORDS} note</p><p>{WORDS} <a epub:type="noteref" href="#n">9</a>end<br/>here</p>
        <p><span class="dropcap">O</span>nce {WORDS}</p><p>{WORDS} <span class="smallcaps">A <b>B</b></span></p><p>{WORDS} span</p>"""
    assert [(s, tag) for s, tag, _ in told(book(("a", body)))] == [
        (long, "div"), (WORDS, "p"), (f"• {WORDS} li", "li"), (f"{WORDS} in li", "p"), (f"{WORDS} span", "p"), ("x = 1", "pre"),
        (f"{WORDS} end here", "p"), (f"Once {WORDS}", "p"), (f"{WORDS} AB", "p"),
    ]


def test_epub_visual_headings_and_windows():
    body = f'<p style="font-size: 2em"><b>A Great Heading</b></p><p>{WORDS}</p>'
    assert [at for *_, at in told(book(("x", body)), visual_headings=True)] == [["A Great Heading"]]
    assert told(book(("x", " ".join(f"w{i}" for i in range(150)))))[1][0].startswith("w80 ")
    assert epub_books.clean_description("<p>One <b>two</b>.</p>") == "One two."


def test_epub_metadata(spark):
    meta = "<dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:description>&lt;p&gt;x&lt;/p&gt; y</dc:description><dc:subject>s</dc:subject>"
    f = spark.createDataFrame([("x", book(("a", "<p>x</p>"), meta=meta)), ("bad", b"")], "path string, content binary")
    r = {r.path: r for r in epub_books.epub_metadata(f).collect()}
    assert (r["x"].title, r["x"].authors, r["x"].description, r["x"].subjects) == ("T", ["A", "B"], "x y", ["s"]) and r["bad"].title is None


def para(i, n, levels=("A",), kind="prose", doc=1):
    t = " ".join(f"w{i}" for _ in range(n)) + "."
    h = tuple([*levels, *[""] * (6 - len(levels))])
    return doc, i, t, n, h, kind, [t]


PARA = "doc_id long, paragraph_id int, text string, word_count int, hierarchy struct<level_1:string,level_2:string,level_3:string,level_4:string,level_5:string,level_6:string>, content_type string, sentences array<string>"


def test_merge_by_words(spark):
    rows = [para(1, 60), para(2, 30), para(3, 20), para(4, 200), para(5, 10), para(6, 5, ("Index",)), para(7, 40, ("B",)), para(8, 10, ("A",))]
    cfg = chunking.ChunkConfig(min_words=30, max_words=100)
    p = spark.createDataFrame(rows, PARA)
    got = chunking.merge_by_words(p, cfg).orderBy("paragraph_id").collect()
    assert [(r.merged_paragraph_ids, bool(r.quality_flags)) for r in got] == [([1, 2], False), ([3], False), ([4], False), ([5, 8], True), ([7], False)]
    assert got[0].text == rows[0][2] + "\n\n" + rows[1][2] and got[0].source_tag == "merged_2_paragraphs"
    drop = chunking.merge_by_words(p, chunking.ChunkConfig(30, 100, keep_small=False))
    assert drop.count() == 4
    f = chunking.merge_by_words(p, cfg).orderBy("paragraph_id").collect()
    assert f[0].sentence_count == 2 and f[0].content_type == "prose"
    assert chunking.apply_strategy("nlp", p).count() == 8
    with pytest.raises(ValueError):
        chunking.apply_strategy("other", p)
    with pytest.raises(TypeError):
        chunking.apply_strategy("token_aware", p, cfg)


def test_token_packing():
    def ps(*sizes, kind="prose"):
        return [{"paragraph_id": i, "text": " ".join(["w"] * n), "sentences": [" ".join(["w"] * n)], "content_type": kind, "hierarchy": {"level_1": "A"}} for i, n in enumerate(sizes, 1)]

    words = lambda t: len(t.split())
    cfg = chunking.TokenConfig(target_tokens=10, max_tokens=12, min_tokens=5, overlap=0.3)
    got = list(chunking.pack_section(ps(6, 4, 3, 2), cfg, words))
    # the first overflows at the third paragraph; its last sentence (4 of at least 3 tokens) is carried over
    assert [(c["ids"], c["overlap"]) for c in got] == [([1, 2], 0), ([3, 4], 4)]
    assert got[1]["text"].split("\n\n")[0] == "w w w w"
    mixed = ps(3) + [{**ps(2, kind="code")[0], "paragraph_id": 2}] + [{**ps(4)[0], "paragraph_id": 3}]
    assert [(c["ids"], c["small"]) for c in chunking.pack_section(mixed, cfg, words)] == [([1], False), ([2], False), ([3], True)]
    assert list(chunking.pack_section(ps(2), chunking.TokenConfig(keep_small=False), words)) == []
    assert chunking.tail_overlap(["a b", "c d e"], 0.1, words) == ([], 0)


def test_tail_overlap():
    words = lambda t: len(t.split())
    assert chunking.tail_overlap(["a b", "c d e"], 0.9, words) == (["a b", "c d e"], 5)
    assert chunking.tail_overlap(["a b", "c d e"], 0.5, words) == (["c d e"], 3)
    assert chunking.tail_overlap([], 0.5, words) == ([], 0)


def test_small_to_big_and_rechunk(spark):
    rows = [para(i, 40) for i in range(1, 7)]
    p = spark.createDataFrame(rows, PARA)
    cfg = chunking.TokenConfig(max_tokens=130)
    got = chunking.parents_and_children(chunking.nest(p), cfg).orderBy("seq").collect()
    levels = [r.chunk_level for r in got]
    assert levels[0] == "parent" and levels.count("child") >= 2
    parent = got[0].stable_id
    assert all(r.parent_chunk_id == parent for r in got[1:3])
    c = spark.createDataFrame([(1, "s", "x", [f"one two three four {i}." for i in range(40)]), (2, "t", "short", None), (3, "u", None, [])], "doc_id long, stable_id string, text string, sentences array<string>")
    r = chunking.rechunk(c, chunking.TokenConfig(min_tokens=20, max_tokens=60, overlap=0.2)).collect()
    assert [x.is_overlap for x in r] == [False] + [True] * (len(r) - 1) and all(20 <= x.token_count <= 61 for x in r)
    assert {x.doc_id for x in r} == {1}
    assert chunking.rechunk_statistics(chunking.rechunk(c.limit(0))).first().total_chunks == 0


def test_split_code():
    words = lambda t: len(t.split())
    src = "import os\n\ndef a():\n    return 1\n\nclass B:\n    x = 1\n"
    assert code.split_code(src, "py", 5, words) == ["import os", "def a():\n    return 1", "class B:\n    x = 1"]
    js = "function a() {\n}\nexport const b = (x) => x\n"
    assert code.split_code(js, "js", 3, words)[1].startswith("export const")
    assert code.split_code("a b\n\nc d\n\ne f", "txt", 4, words) == ["a b\n\nc d", "e f"]
    assert code.split_code("  \n") == [] and code.split_code("x", "", 10, words) == ["x"]


def test_corpus(spark):
    chunks = spark.createDataFrame([("a", "ta", 0.95), ("b", "tb", 0.85), ("c", "tc", 0.90)], "chunk_id string, text string, quality_score double")
    notes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("z", 0), ("a2", None)], "chunk_id string, label int")
    edits = spark.createDataFrame([("a", 1, "e1", "r1"), ("a", 2, "e2", "r2")], "chunk_id string, version int, edited_text string, edit_reason string")
    got = {r.chunk_id: (r.text, r.edited) for r in corpus.build_corpus(chunks, notes, edits).collect()}
    assert got == {"a": ("e2", True), "c": ("tc", False)}
    assert corpus.build_corpus(chunks, notes, edits, 0.92).count() == 1
    bal = corpus.balance(chunks.join(notes, "chunk_id"))
    assert sorted((r.chunk_id, r.label) for r in bal.collect()) == [("a", 0), ("b", 1)]
    files = spark.createDataFrame([("S1", "x/S1", 0), ("s2", "x/s2", 0), ("S2", "x/d/S2", 1), ("s3", "x/d/s3", 1)], "stem string, path string, depth int")
    m = corpus.match_sources(spark.createDataFrame([("S1",), ("S2",), ("S3",), ("S4",)], "stem string"), files)
    assert {r.session: r.path for r in m.collect()} == {"S1": "x/S1", "S2": "x/s2", "S3": "x/d/s3"}
    labelled = spark.createDataFrame([(i, i % 3 == 0) for i in range(90)], "chunk_id int, label boolean")
    split = corpus.train_test_split(labelled).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in split} == {(True, "test"): 6, (True, "train"): 24, (False, "test"): 12, (False, "train"): 48}
    with pytest.raises(ValueError):
        corpus.train_classifier(corpus.features(chunks.withColumn("label", F.lit(0))))


def test_deduplicate_and_front_matter(spark):
    h = "struct<level_1:string>"
    p = spark.createDataFrame([(1, 1, "a  b", ("x",)), (1, 2, "a b", ("x",)), (1, 3, "a b", ("y",)), (2, 1, "a b", ("x",))], f"doc_id long, paragraph_id int, text string, hierarchy {h}")
    assert sorted((r.doc_id, r.paragraph_id) for r in corpus.deduplicate(p).collect()) == [(1, 1), (1, 3), (2, 1)]
    c = spark.createDataFrame([(1, "p", "parent", None, "fm"), (1, "k", "child", "p", "ok"), (1, "q", "standalone", None, "ok"), (2, "r", "standalone", None, "fm")], "doc_id long, stable_id string, chunk_level string, parent_chunk_id string, t string").withColumn("quality_flags", F.lit(None).cast("array<string>"))
    reason = F.when(F.col("t") == "fm", "dedication_phrase").otherwise("content")
    got = {r.stable_id: r.quality_flags for r in corpus.mark_front_matter(c, reason, remove=True).collect()}
    assert got == {"q": None, "r": ["likely_noncore_matter_dedication_phrase"]}
    assert corpus.mark_front_matter(c, reason, remove=False).where("size(quality_flags) > 0").count() == 2


def test_hierarchy_repair(spark):
    h = text.hierarchy(**{f"level_{i}": F.lit(x) for i, x in enumerate("abcdef", 1)})
    r = spark.range(1).select(headings.shift_down(h, 2).alias("s"), headings.reset_from(h, 3).alias("r")).first()
    assert tuple(r.s) == ("a", "d", "e", "f", "", "") and tuple(r.r) == ("a", "b", "", "", "", "")


def test_ranges_index_and_crawl(spark):
    b = spark.createDataFrame([(1, "x", 0, 10), (1, "y", 12, 30), (2, "z", 0, 5000)], "doc_id long, chunk_id string, start long, end long")
    s = spark.createDataFrame([(1, 1, 5, 13), (1, 2, 10, 12), (2, 3, 100, 4500)], "doc_id long, span_id long, s_start long, s_end long")
    got = {r.span_id: r.chunk_ids for r in corpus.overlapping_boundaries(s, b, 1000).collect()}
    assert got == {1: ["x", "y"], 3: ["z"]}
    i = spark.createDataFrame([("u1", "s", True, False), ("u2", "s", False, False)], "url string, section string, downloaded boolean, processed boolean")
    new = spark.createDataFrame([("u2", "t", False, False), ("u3", "t", False, False), ("u3", "t", False, False)], i.schema)
    assert corpus.add_to_index(i, new).count() == 3
    assert {(r.section, r.total, r.pending) for r in corpus.index_summary(i).collect()} == {("s", 2, 1), (None, 2, 1)}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "src string, dst string")
    assert {r.url: r.depth for r in corpus.crawl(spark.createDataFrame([("a",)], "url string"), links).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_sinks_and_readers(spark, tmp_path):
    chunks = spark.createDataFrame([("d", "c1", 1, "text one", ("A", "")), ("d", "c2", 2, "text two", ("A", "B"))], "doc_id string, stable_id string, paragraph_id int, text string, hierarchy struct<level_1:string,level_2:string>")
    meta = spark.createDataFrame([("d", "Title", ("d", "f.epub"))], "doc_id string, title string, provenance struct<doc_id:string,source_file:string>")
    sinks.write_documents(meta, chunks, str(tmp_path / "docs"))
    back = readers.read_chunk_documents(spark, str(tmp_path / "docs")).orderBy("paragraph_id").collect()
    assert [(r.doc_id, r.chunk_id, r.text, r.hierarchy.level_2, r.hierarchy.level_6) for r in back] == [("d", "c1", "text one", "", ""), ("d", "c2", "text two", "B", "")]
    sinks.write_ndjson(chunks.select("stable_id", "text"), str(tmp_path / "lines"))
    assert readers.read_chunk_lines(spark, str(tmp_path / "lines")).count() == 2
    full = chunks.withColumn("hierarchy", text.hierarchy(level_1=F.col("hierarchy.level_1"), level_2=F.col("hierarchy.level_2"))).withColumn("word_count", F.lit(2))
    report = sinks.report_lines(sinks.hierarchy_report(full)).first().text
    assert report == "A\n  [¶ 1-1, ~2 words]\n\nA\n  └─ B\n    [¶ 2-2, ~2 words]"
    notes = spark.createDataFrame([("a", 0, ["x", "y"]), ("b", 1, []), ("c", 7, ["x"]), ("d", None, ["x"])], "chunk_id string, label int, issues array<string>")
    assert sorted(r.label_name for r in sinks.by_label(notes).collect()) == ["bad", "good", "label_7"]
    assert sinks.by_issue(notes, ["x"]).count() == 3
    sinks.write_split(sinks.by_label(notes), str(tmp_path / "split"), "label_name")
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["label_name=bad", "label_name=good", "label_name=label_7"]
    days = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b")], "date string, v string")
    sinks.write_by_date(days, str(tmp_path / "days"))
    sinks.write_by_date(spark.createDataFrame([("2024-01-02", "c")], days.schema), str(tmp_path / "days"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "days")).collect()) == ["a", "c"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.json").write_text('{"annotations": {"c1": {"label": 0, "issues": ["x"]}, "c2": {"label": null}}}')
    got = {(r.session, r.chunk_id, r.label, r.annotator_id) for r in readers.read_sessions(spark, str(tmp_path / "s")).collect()}
    assert got == {("one", "c1", 0, "default"), ("one", "c2", None, "default")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text("# H\nbody text")
    (tmp_path / "m" / "b.html").write_text("<h1>T</h1><p>para</p>")
    (tmp_path / "m" / "c.epub").write_bytes(epub())
    assert readers.read_markdown(spark, str(tmp_path / "m")).first().text == "body text"
    assert readers.read_html(spark, str(tmp_path / "m")).first().hierarchy.level_1 == "T"
    assert readers.read_epub(spark, str(tmp_path / "m"), epub_books.EpubConfig(min_paragraph_words=1)).count() == 2
    assert {r.format for r in readers.files(spark, str(tmp_path / "m")).collect()} == {"markdown", "html", "epub"}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from scriptora.streaming import ingest

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, "one line\nsecond"), (2, None)], "doc_id long, text string").write.parquet(src)
    go = lambda: ingest.write(ingest.paragraphs(ingest.stream(spark, src, "doc_id long, text string")).drop("hierarchy"), out, cp).awaitTermination()
    go()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(3, "third")], "doc_id long, text string").write.mode("append").parquet(src)
    go()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one line", "second", "third"]


def test_global_rank_is_a_rank(spark):
    rows = [(i, "a" if i % 3 else None, i * 7919 % 1000) for i in range(500)]
    d = spark.createDataFrame(rows, "chunk_id int, label string, v int").withColumn("b", F.floor(F.col("v") / 100))
    for key in (["label"], []):
        got = {r.chunk_id: (r["__rank"], r["__size"]) for r in corpus.global_rank(d, key, ["b"], ["v", "chunk_id"]).collect()}
        want = {}
        for k in {r[1] if key else 0 for r in rows}:
            mine = sorted((r[2], r[0]) for r in rows if not key or r[1] == k)
            want.update({i: (n, len(mine)) for n, (_, i) in enumerate(mine, 1)})
        assert got == want
