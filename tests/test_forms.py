"""The fast forms of patterns, counts and hand-overs against the plain ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptora.functions import noise, refs, text
from scriptora.operators import chunking

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def texts(bits, n, most, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(bits) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_white_space(spark):
    near = [chr(c) for c in range(1, 0x3100)] + ["﻿", "\U0001f600"]
    one = lambda name, p: F.col("x").rlike(rf"\A(?:{p})\z").alias(name)
    r = spark.createDataFrame([(x,) for x in near], "x string").select("x", one("a", text.WS), one("b", text.NOT_WS), one("c", f"[{text.SPACE}]")).collect()
    assert [x.x for x in r if x.a == x.b or x.a != x.c] == [] and {x.x for x in r if x.c} >= set(SPACES)


def test_counts_of_tidied_texts(spark):
    raw = texts(["a", "B ", " ", "\n", "1", "(", " )", ".", '"', "<i>", "\u200b", "\u3000", "é", "C D E"], 2000, 9)
    r = spark.createDataFrame([(x,) for x in [*raw, None]], "x string").select(text.clean_text(F.col("x")).alias("x"))
    assert [(x.x, x.a) for x in r.select("x", text.tidy_word_count(F.col("x")).alias("a")).collect() if len(x.x.split()) != x.a] == []
    assert "replace" in str(text.tidy_word_count(F.col("x"))) and "regexp" not in str(text.tidy_word_count(F.col("x")))


def test_numbers_of_an_index(spark):
    raw = texts(["1", "23", ",", "a", " ", "\n", "\U0001f600", "-", "é"], 2000, 8, 2)
    want = {x: sum(bool(re.fullmatch(r"[0-9*,.\-:;]+", w)) for w in x.split()) for x in raw}
    r = spark.createDataFrame([(x,) for x in raw], "x string").select("x", F.regexp_count("x", F.lit(noise._NUMBERS)).alias("n")).collect()
    assert [x.x for x in r if x.n != want[x.x]] == []


@pytest.mark.parametrize("patterns, some", [(refs.DATE_PATTERNS, refs._ANY_DATE if hasattr(refs, "_ANY_DATE") else None), (refs.SCRIPTURE_PATTERNS, getattr(refs, "_ANY_VERSE", None)), (refs.CROSS_PATTERNS, getattr(refs, "_ANY_CROSS", None))])
def test_no_reference_without_its_sign(spark, patterns, some):
    bits = """see|SEE also|Compare|cf.|§|§§ 12|section|Part|chapter|can.|canon|CIC|CCEO|/1983|cic/1990|canon 12|catechism|Catechism of the Catholic Church|CCC 12|ccc12|Roman catechism|
    catechism of Pius V|Denz.|DS|ds 3004|GIRM|gilh 3|IGMR 4|ogmr12|Trent|trent, Session XI|VATICAN II|aas 58 (1966) 10|(1966)|January 5, 1993|1993-01-02|1/2/2001|3rd May 2010|12:3|John 3:4| |\n|x|12""".split("|")
    d = spark.createDataFrame([(x,) for x in texts(bits + [" "] * 8, 3000, 9, 3)], "x string")
    has = F.size(F.concat(*[F.regexp_extract_all("x", F.lit(p), F.lit(0)) for p in patterns])) > 0
    assert d.where(has).count() > 50 and d.where(has & ~F.col("x").rlike(some)).count() == 0


def test_handed_over_flat(spark):
    h = lambda a: tuple([a, None, *[""] * 4])
    ps = [(3, "a b", 2, h("A"), "prose", ["a", "b"], None, ["John 1:1"], None), (4, "c", 1, h("B"), "code", None, ["x"], None, None), (5, None, 0, None, None, [], None, None, None), (6, "d", 1, h("A"), "prose", ["d"], None, None, None)]
    d = spark.createDataFrame([(1, ps), (2, ps[:1]), (3, []), (4, None)], f"doc_id long, ps {chunking._NESTED}")
    flat = d.select("doc_id", *chunking._flat(True))
    assert not any("struct" in kind for _, kind in flat.dtypes)
    got = {r[0]: chunking._unflat(*r[1:]) for r in flat.collect()}
    some = lambda p: {k: tuple(x or "" for x in v.values()) if k == "hierarchy" else v for k, v in p.items()}
    want = [{"paragraph_id": i, "text": t, "hierarchy": tuple(x or "" for x in (hh or [""] * 6)), "content_type": k, "sentences": s or [], "cross_references": c or [], "scripture_references": v or []} for i, t, _, hh, k, s, c, v, _ in ps]
    assert [some(p) for p in got[1]] == want
    assert [p["content_type"] for p in got[2]] == ["prose"] and got[3] == [] and got[4] == []


def test_counts_of_any_text(spark):
    raw = [*texts(["a", "B\U0001f600", " ", "\n", "　", "\x1c", ",", "É"], 3000, 8, 4), " ", " \n", "x" * 5000 + " "]
    r = spark.createDataFrame([(x,) for x in [*raw, None]], "x string").select("x", text.word_count(F.col("x")).alias("n"), text.count_of(F.col("x"), r"[A-ZÉ]").alias("k")).collect()
    assert [x.x for x in r if x.n != len((x.x or "").split()) or x.k != (None if x.x is None else sum(c in "BÉ" for c in x.x))] == []


def test_features_of_long_words_are_linear(spark):
    import time

    from scriptora.operators import corpus

    # a word of so many characters took minutes where each of its characters was begun at
    d = spark.createDataFrame([(1, "x" * 400_000 + " 1 2"), (2, "a b c d e\nA, b!\n\n1 22 x3")], "chunk_id long, text string")
    corpus.features(d.limit(0)).collect()
    began = time.time()
    r = {x.chunk_id: x for x in corpus.features(d).collect()}
    assert time.time() - began < 30
    assert (r[1].short_line_ratio, r[2].short_line_ratio) == (1.0, 0.75) and r[1].number_token_ratio == 2 / 3 and r[2].number_token_ratio == 2 / 10


def test_classifier_reads_features_that_are_kept(spark, tmp_path):
    from scriptora import registry

    rows = [(i, f"{'Word, ' * (i % 7)}and {i} more. Next page\nof it", "en", "s") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    p = registry.queries()["ml_classifier"](spark, str(tmp_path))
    assert "documents.parquet" not in str(p._jdf.queryExecution().executedPlan()) and "FileScan" not in str(p._jdf.queryExecution().executedPlan())
    assert p.count() == 40
