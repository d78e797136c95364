"""Sessions, archives, calendars, hours and settings on small made-up rows."""

import pytest
from pyspark.sql import functions as F

from scriptora.config import ConfigError, Extraction, OrderError, load
from scriptora.operators import archive, sessions


def replay(events, most=50):
    labels, stack = {}, []
    for _, chunk, kind, label in events:
        if kind == "set":
            stack.append((chunk, labels.get(chunk, "none")))
            labels[chunk] = label
        elif stack:
            c, old = stack.pop()
            if old == "none":
                labels.pop(c)
            else:
                labels[c] = old
    return labels


def test_undo_is_a_bracket_match(spark):
    import random

    rng = random.Random(7)
    rows, want = [], {}
    for s in range(40):
        events = [(i, rng.randint(1, 4), "undo" if rng.random() < 0.4 else "set", rng.randint(0, 1)) for i in range(rng.randint(1, 25))]
        rows += [(s, i, c, k, v) for i, c, k, v in events]
        want.update({(s, c): v for c, v in replay(events).items()})
    e = spark.createDataFrame(rows, "session int, seq int, chunk_id int, kind string, label int")
    assert {(r.session, r.chunk_id): r.label for r in sessions.current_labels(e).collect()} == want


def test_edits(spark):
    chunks = spark.createDataFrame([("a", "ta"), ("b", "tb")], "chunk_id string, text string")
    none = spark.createDataFrame([], "chunk_id string, version int, edited_text string, edit_reason string")
    new = spark.createDataFrame([("a", "x", "r", 1), ("a", "y", "r", 2), ("b", "z", " ", 3), ("q", "z", "r", 4)], "chunk_id string, edited_text string, edit_reason string, at int")
    e = sessions.add_edits(none, new, chunks)
    assert sorted((r.chunk_id, r.version, r.edited_text, r.is_current_version) for r in e.collect()) == [("a", 1, "x", False), ("a", 2, "y", True)]
    back = sessions.restore(e.select(none.columns), spark.createDataFrame([("a", 1, "back", 9)], "chunk_id string, version int, edit_reason string, at int"), chunks)
    assert sorted((r.version, r.edited_text, r.is_current_version) for r in back.collect()) == [(1, "x", False), (2, "y", False), (3, "x", True)]
    p = sessions.progress(chunks, spark.createDataFrame([("a", 0), ("b", None)], "chunk_id string, label int")).first()
    assert (p.total, p.annotated, p.percent) == (2, 1, 50.0)
    assert sessions.progress(chunks.limit(0), e.select("chunk_id", F.lit(1).alias("label"))).first().percent == 0.0


def test_images_and_names(spark):
    html = '<img src="/a/b.PNG?x" alt=" Alt "><img data-src="c.jpg"><img src="site-logo.png"><img><img src="/f/foo.png/revision/latest"><img src="page.html">'
    got = [(r.src, r.alt) for r in archive.images(spark.createDataFrame([("http://h/p/", html)], "url string, html string")).collect()]
    assert got == [("http://h/a/b.PNG?x", "Alt"), ("http://h/p/c.jpg", ""), ("http://h/f/foo.png/revision/latest", "")]
    names = spark.createDataFrame([("http://h/a.webp", "Big Cat!"), ("http://h/a", None)], "u string, a string").select(archive.image_name(F.col("u"), F.col("a")).alias("n")).collect()
    assert names[0].n.startswith("big_cat_") and names[0].n.endswith(".webp") and names[1].n.endswith(".jpg")


def test_links(spark):
    html = '<a href="x/__P1.HTM#f">One</a> <a href="x/__P1.HTM">Again</a><a href="y.html">No</a>'
    got = archive.links(spark.createDataFrame([("http://h/d/", html)], "url string, html string"), r"__P\w+\.HTM").collect()
    assert [(r.url, r.title) for r in got] == [("http://h/d/x/__P1.HTM", "One")]


def test_toc(spark):
    t = spark.createDataFrame([(1, 1, "./a.html", "Chapter 1: Start", 1), (1, 2, "a.html#s", "Part", 2), (1, 3, "b.html#s", "Other", 3)], "doc_id long, seq int, href string, title string, depth int")
    files, anchors, titles = archive.toc_maps(t)
    assert {(r.base, r.title, r.depth) for r in files.collect()} == {("a.html", "Start", 1), ("b.html", "Other", 3)}
    assert [(r.anchor, r.title) for r in anchors.collect()] == [("s", "Other")]
    assert {(r.name, r.depth) for r in titles.collect()} == {("start", 1), ("part", 2), ("other", 3)}


def test_hours(spark):
    red = lambda s: f'<span style="color: #ff0000">{s}</span>'
    html = (
        f'<div class="entry"><p>{red("Morning Prayer")}</p><p>{red("HYMN")}</p><p>sing this</p><p>{red("Ribbon Placement")}</p><p>skipped</p>'
        f'<p style="text-align:center">{red("Psalm 63:2-9")}</p><p>O God</p><p>{red("Ant. 1")} I will praise</p><p>{red("READING Rom 8")}</p><p>we know</p>'
        f'<p>{red("CONCLUDING PRAYER")}</p><p>Father</p></div>'
    )
    got = archive.office_paragraphs(spark.createDataFrame([("http://h/", html)], "url string, html string")).collect()
    assert {r.hour for r in got} == {"Morning Prayer"}
    assert [(r.subsection, r.content_type, r.text) for r in got][-5:] == [
        ("Hymn", "hymn", "sing this"), ("Psalm 63:2-9", "psalm", "O God"), ("Psalm 63:2-9", "antiphon", "Ant. 1 I will praise"),
        ("Reading: Rom 8", "reading", "we know"), ("Concluding Prayer", "collect", "Father"),
    ]


def test_calendar(spark):
    lines = ["intro", "DECEMBER 2023 ", "30 Sat FIRST WEEK OF CHRISTMAS white", "31 Sun HOLY FAMILY white", "Feast [note]", "1 Mon MARY white", "Solemnity", "FEBRUARY 2024", "14 Wed ASH WEDNESDAY violet", "15 Thu Weekday after violet"]
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, seq int, line string")
    got = [(r.date, r.day_of_week, r.celebration, r["rank"], r.color, r.season) for r in archive.calendar_days(d).orderBy("date").collect()]
    assert got == [
        ("2023-12-30", "Sat", "FIRST WEEK OF CHRISTMAS", "", "white", "Christmas"), ("2023-12-31", "Sun", "HOLY FAMILY", "Feast", "white", "Christmas"),
        ("2024-01-01", "Mon", "MARY", "Solemnity", "white", "Christmas"), ("2024-02-14", "Wed", "ASH WEDNESDAY", "", "violet", "Lent"),
        ("2024-02-15", "Thu", "Weekday after", "", "violet", "Lent"),
    ]


def test_primary_hierarchy(spark):
    s = spark.createDataFrame([(1, 1, "a b", ("H",)), (1, 2, "c d e", ("I",)), (2, 1, "x", ("H",))], "piece_id int, seq int, text string, hierarchy struct<level_1:string>")
    p = spark.createDataFrame([(1, "C d a"), (2, "q")], "piece_id int, text string")
    got = {r.piece_id: (r.hierarchy.level_1, r.crossed) for r in archive.primary_hierarchy(s, p).collect()}
    assert got == {1: ("I", True), 2: ("H", False)}


def test_settings(tmp_path, spark):
    (tmp_path / "scriptora.toml").write_text("levels = 3\nnonsense = 1\n")
    (tmp_path / "pyproject.toml").write_text("[tool.scriptora]\nlevels = 2\nmin_chunk_words = 7\n")
    c = load({"max_chunk_words": 50}, tmp_path, tmp_path / "none.toml")
    assert (c["levels"], c["min_chunk_words"], c["max_chunk_words"]) == (3, 7, 50) and "nonsense" not in c
    with pytest.raises(ConfigError):
        load({"levels": 9}, tmp_path)
    with pytest.raises(OrderError):
        Extraction(spark).chunk()
