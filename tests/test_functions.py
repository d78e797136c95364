"""Text, reference, noise and quality functions on rows that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from scriptora.functions import identity, noise, quality, refs, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""), ("", ""), ("  a \u00a0 b\n c ", "a b c"), ("so\u00adft\u200b hyphen", "soft hyphen"), ("<b>bold</b> text", "bold text"),
        ("12The word", "12 The word"), ("12 . next", "12. next"), ("a , b ; c !", "a, b; c!"), ('( a "', '(a"'), ("S E C O N D", "SECOND"),
        ("A B", "A B"), ("A B C d", "ABC d"), ("T HE END", "THE END"), ("x A B CD", "x A BCD"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


def test_clean_text_is_the_executors_rule(spark):
    from scriptora.operators.parsers import _clean

    raws = ["A B C", "x  .", "3 . 4Ab [ q ]", "T HE “x ” S E C OND", "é <i>a</i> ,b", "“ a ”"]
    rows = spark.createDataFrame([(r,) for r in raws], "x string").select("x", text.clean_text(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows] == [(r, _clean(r)) for r in raws]


def test_clean_code_keeps_layout(spark):
    assert one(spark, "a\u00a0b\n\t\u200bc\u00ad", text.clean_code) == "a b\n\tc"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("One. Two! Three? four", ["One.", "Two!", "Three? four"]), ("See St. Paul. Then Fr. John came.", ["See St. Paul.", "Then Fr. John came."]),
        ("cf. Gen. 1:1 now. (Next)", ["cf. Gen. 1:1 now.", "(Next)"]), ("", []), ("Dr.  Who", ["Dr.  Who"]), ('He said. "Go."', ["He said.", '"Go."']),
    ],
)
def test_sentences(spark, raw, want):
    assert one(spark, raw, text.sentences) == want


@pytest.mark.parametrize("raw, want", [("Chapter 3: Faith", "Faith"), ("12) Hope", "Hope"), ("IV. Love", "Love"), ("I. Alone", "I. Alone"), ("7 Gifts", "Gifts"), (". x", "x")])
def test_toc_title(spark, raw, want):
    assert one(spark, raw, text.clean_toc_title) == want


def test_hierarchy(spark):
    h = text.hierarchy(level_1=F.lit("A"), level_3=F.lit("C"), level_2=F.lit(None).cast("string"))
    r = spark.range(1).select(text.heading_path(h).alias("p"), text.hierarchy_depth(h).alias("d"), text.hierarchy_depth(text.no_hierarchy()).alias("z")).first()
    assert (r.p, r.d, r.z) == ("A / C", 3, 0)
    assert [one(spark, t, text.heading_level) for t in ("h1", "H6", "p", None)] == [1, 6, 99, 99]


def test_references(spark):
    t = "On January 15, 2023 and 15th March 2024, 2023-01-15, 1/15/2023; John 3:16-17, 1 Corinthians 13:1, Mt 5:3, Chapter 2:1. See chapter 4; CCC 2309, Vatican II, canon 456, AAS 58 (1966) 10."
    assert one(spark, t, refs.dates) == ["1/15/2023", "15th March 2024", "2023-01-15", "January 15, 2023"]
    assert one(spark, t, refs.scripture_references) == ["1 Corinthians 13:1", "John 3:16-17", "Mt 5:3"]
    got = one(spark, t, refs.cross_references)
    assert {"CCC 2309", "Vatican II", "canon 456", "AAS 58 (1966) 10", "See chapter 4"} <= set(got) and got == sorted(got)
    assert one(spark, None, refs.dates) == []


@pytest.mark.parametrize("raw, want", [("Word. 10", [10]), ("Word.[10]", [10]), ("Word (10).", [10]), ("John 3:16", []), ("pi 3.14", []), ("x 1000", []), ("none", [])])
def test_footnotes(spark, raw, want):
    assert one(spark, raw, refs.trailing_footnotes) == want


def test_ids(spark):
    import hashlib

    r = spark.createDataFrame([("a", None)], "a string, b string").select(identity.stable_id(F.col("a"), F.col("b")).alias("x"), identity.edited_id(F.col("a")).alias("y")).first()
    assert r.x == hashlib.sha1(b"a||").hexdigest()[:16] and r.y == "ed_" + hashlib.sha256(b"a").hexdigest()[:16]


def noise_of(spark, raw, level_1="", words=None, tokens=None):
    d = spark.createDataFrame([(raw, level_1, words if words is not None else len((raw or "").split()), tokens)], "t string, l string, w int, k int")
    h = text.hierarchy(level_1=F.col("l"))
    return d.select(
        noise.is_index_page(F.col("t"), F.col("k")).alias("numbers"), noise.is_navigation(F.col("t"), F.col("w"), h).alias("nav"), noise.is_boilerplate(F.col("t"), F.col("w")).alias("legal"),
        noise.front_matter(F.col("t"), h).alias("front"), *[noise.tiny_chunk(F.col("t"), F.col("w"), h, m).alias(m) for m in noise.TINY_MODES],
    ).first()


def test_noise(spark):
    assert noise_of(spark, "109 24 8* 27 133* text").numbers and noise_of(spark, "a b c 1 2 3 4", tokens=30).numbers
    assert not noise_of(spark, "In 1962 the council of 2 parts met").numbers and not noise_of(spark, None).numbers
    assert noise_of(spark, "See 1, 2, 3, 4, 5, 6 end of it").numbers
    assert noise_of(spark, "Chapter 12").nav and noise_of(spark, " Next ").nav and noise_of(spark, "short row", "Table of Contents").nav
    assert not noise_of(spark, "long row", "Contents", words=20).nav
    assert noise_of(spark, "Copyright 2020 by X").legal and not noise_of(spark, "copyright law", words=50).legal and noise_of(spark, "ISBN 1", words=90).legal
    assert [noise_of(spark, *a).front for a in (("Dedicated to Ann",), ("For my mother",), ("x", "General Index"), ("x", "About Foo Press"), ("x", "About the Author"), ("x", "Indexing"), ("Praise for it",), ("x", "Notes"), ("x", "Outline of it"), ("x",))] == [
        "dedication_phrase", "dedication_phrase", "back_matter_toc_label", "front_matter_toc_label", "back_matter_toc_label", "content",
        "endorsement_section", "back_matter_toc_label", "front_matter_toc_label", "content",
    ]
    r = noise_of(spark, "Table 4 sizes")
    assert (r.off, r.conservative) == (False, True) and noise_of(spark, "• word").standard and not noise_of(spark, "• word").conservative
    assert noise_of(spark, "see also this").aggressive and not noise_of(spark, "see also this").standard
    with pytest.raises(ValueError):
        noise.tiny_chunk(F.lit(""), F.lit(1), text.no_hierarchy(), "none")


def test_reference_block(spark):
    t = "Prose before.\n1. Smith, Book (2001), 12-14.\n2. Ibid, 3.\n3. Jones, trans. Lee (1999).\n"
    r = one(spark, t, noise.reference_block)
    assert (r.found, r["count"]) == (True, 3) and r.start == t.index("\n1.")
    assert [one(spark, x, noise.reference_block).found for x in (None, "1. One\n2. Two\n3. Three", "2. Ab (2001) Ibid\n3. Cd\n4. Ef")] == [False] * 3


def test_quality(spark):
    s = one(spark, "", quality.signals)
    assert (s.garble_rate, s.mean_conf, s.line_len_std_norm) == (1.0, 0.0, 1.0)
    s = one(spark, "Dei Verbum\n\u4e00\u4e00 word word", quality.signals)
    assert s.lang_prob == pytest.approx(0.6) and s.garble_rate == pytest.approx(2 / 23) and s.lexical_density == pytest.approx(4 / 5) and s.short_line_ratio == 1.0

    def scored(*v):
        names = ("garble_rate", "mean_conf", "line_len_std_norm", "lang_prob")
        return spark.range(1).select(quality.score(F.struct(*[F.lit(x).alias(n) for x, n in zip(v, names)])).alias("s")).first().s

    assert scored(0.0, 1.0, 0.0, 1.0) == pytest.approx(1.0) and scored(float("nan"), 1.0, 0.0, 1.0) == 0.0 and scored(float("inf"), 1.0, 0.0, 1.0) == 0.0
    assert scored(-1.0, 2.0, 0.0, 1.0) == 1.0
    assert [one(spark, x, quality.route, "double") for x in (0.80, 0.79, 0.55, 0.54)] == ["A", "B", "B", "C"]
