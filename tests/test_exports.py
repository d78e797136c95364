"""Token counts, windows, exports, captures, plug-ins, saved classifiers and the progress of streams."""

import pytest
from pyspark.sql import functions as F

from scriptora.functions import text, tokens, windows
from scriptora.operators import archive, chunking, corpus, exports, plugins
from scriptora.sources import readers, sinks
from scriptora.streaming import ingest


def tokenizer():
    p = pytest.importorskip("public_tokenizers")
    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("byte_bpe_50k.json")


def test_exact_tokens(spark):
    ranks, pattern, json = tokenizer()
    texts = ["One two three.", "  ", "", None, "naïve 日本語 <|endoftext|>"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    count = tokens.load_counter(ranks, pattern)
    want = [count(t) if t and t.strip() else 0 for t in texts]
    assert want[0] == 4
    assert [r.n for r in d.select("i", tokens.count_tokens(F.col("t"), ranks, pattern).alias("n")).orderBy("i").collect()] == want
    assert tokens.counter(json)("One two three.") == 4
    assert [r.n for r in d.select("i", tokens.count_tokens(F.col("t")).alias("n")).orderBy("i").collect()] == [tokens.estimate(t) for t in texts]


def test_a_tokenizer_that_is_not_there_is_estimated():
    assert tokens.load_counter_safe("/no/such.json") is None and tokens.load_counter_safe("x.bin") is None
    assert tokens.counter("/no/such.json")("a b c d") == 6


def test_token_aware_by_a_tokenizer(spark):
    ranks, pattern, _ = tokenizer()
    h = ("A", "", "", "", "", "")
    rows = [(1, i, f"Sentence number {i} tells something.", 5, h) for i in range(1, 40)]
    p = spark.createDataFrame(rows, "doc_id long, paragraph_id int, text string, word_count int, hierarchy struct<level_1:string,level_2:string,level_3:string,level_4:string,level_5:string,level_6:string>")
    cfg = chunking.TokenConfig(target_tokens=30, max_tokens=40, min_tokens=1, overlap=0.0, tokenizer=ranks, pattern=pattern)
    count = tokens.counter(ranks, pattern)
    out = chunking.token_aware(chunking.nest(p), cfg).orderBy("seq").collect()
    assert all(r.tokens == count(r.text) for r in out) and all(sum(count(rows[i - 1][2]) for i in r.merged_paragraph_ids) <= 30 for r in out)
    assert [i for r in out for i in r.merged_paragraph_ids] == list(range(1, 40))


def test_children_keep_levels_and_their_own_references(spark):
    h = ("A", "B", "", "", "", "")
    s = ["First has Rom 1:2 in it.", "Second has art. 3 in it."]
    rows = [(1, 1, " ".join(s), 12, h, "prose", s, ["Rom 1:2"], ["art. 3"])]
    d = spark.createDataFrame(rows, "doc_id long, paragraph_id int, text string, word_count int, hierarchy struct<level_1:string,level_2:string,level_3:string,level_4:string,level_5:string,level_6:string>, content_type string, sentences array<string>, scripture_references array<string>, cross_references array<string>")
    out = chunking.parents_and_children(chunking.nest(d), chunking.TokenConfig(max_tokens=10)).orderBy("seq").collect()
    assert [(r.chunk_level, r.scripture_references, r.cross_references, r.hierarchy.level_2) for r in out] == [
        ("parent", ["Rom 1:2"], ["art. 3"], "B"), ("child", ["Rom 1:2"], [], "B"), ("child", [], ["art. 3"], "B"),
    ]


def test_windows(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(23)))), (2, "a b"), (3, None), (4, "")], "i int, t string")
    got = {r.i: r.w for r in d.select("i", windows.fixed_windows(F.col("t"), 10, 2, 3).alias("w")).collect()}
    assert [w.split()[0] for w in got[1]] == ["0", "8", "16"] and got[1][-1].split()[-1] == "22" and got[2] == got[3] == got[4] == []
    with pytest.raises(ValueError):
        windows.fixed_windows(F.col("t"), 5, 5)


def test_clean_text_composes(spark):
    r = spark.createDataFrame([("été  A B C <b>x</b> .", "résumé")], "a string, b string").select(text.clean_text(F.col("a")).alias("a"), text.ascii_fold(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == ("été ABC x.", "resume")


def test_captures_take_the_first_heading(spark):
    level = "hierarchy struct<level_1:string,level_2:string,level_3:string,level_4:string,level_5:string,level_6:string>"
    none, some = ("",) * 6, ("A", *[""] * 5)
    b = spark.createDataFrame([(1, "x", 0, 5, none), (1, "y", 7, 12, some), (1, "z", 14, 20, ("B", *[""] * 5))], f"doc_id int, chunk_id string, start int, end int, {level}")
    d = spark.createDataFrame([(1, "first  second  third!")], "doc_id int, text string")
    s = spark.createDataFrame([(1, 10, 0, 16, 1), (1, 11, 5, 7, 2)], "doc_id int, capture_id int, s_start int, s_end int, order int")
    c = exports.captures(s, d, b).orderBy("capture_id").collect()
    assert [(r.text, r.source_chunk_ids, r.hierarchy and r.hierarchy.level_1) for r in c] == [("first  second  t", ["x", "y", "z"], "A"), ("", None, None)]
    assert exports.capture_chunks(exports.captures(s, d, b)).where("quality_flags[0] = 'manually_captured'").count() == 2


def test_plugins():
    r = plugins.Registry("thing")
    r.register("a", "b")(len)
    assert r.get("b") is len and r.names() == ["a", "b"]
    with pytest.raises(ValueError):
        r.register("a")(max)
    with pytest.raises(ValueError):
        r.get("c")
    assert {"epub", "html", "md"} <= set(plugins.PARSERS.names()) and {"catholic", "generic"} <= set(plugins.ANALYZERS.names())


def test_saved_classifier(spark, tmp_path):
    rows = [(str(i), f"{'good words here ' * 5 if i % 2 else 'BAD 1 2 3'} {i}", 16 if i % 2 else 5, i % 2) for i in range(40)]
    f = corpus.features(spark.createDataFrame(rows, "chunk_id string, text string, word_count int, label int"))
    model = corpus.train_classifier(f)
    corpus.save_classifier(model, 0.4, str(tmp_path / "m"))
    again, threshold = corpus.load_classifier(spark, str(tmp_path / "m"))
    assert threshold == 0.4
    assert sorted(map(tuple, corpus.predict(again, f, threshold).collect())) == sorted(map(tuple, corpus.predict(model, f, 0.4).collect()))


def test_retraining():
    assert corpus.should_retrain(0, False) and corpus.should_retrain(600, True)
    assert not any(corpus.should_retrain(n, True) for n in (100, 99, 101, 599))


def test_document_set_and_chunk_files(spark, tmp_path):
    h = ("A", *[""] * 5)
    c = spark.createDataFrame([("d", 1, "t", 1, h), ("d", 2, "u", 1, h)], "doc_id string, paragraph_id int, text string, word_count int, hierarchy struct<level_1:string,level_2:string,level_3:string,level_4:string,level_5:string,level_6:string>")
    sinks.write_document_set(spark.createDataFrame([("d", "T")], "doc_id string, title string"), c, str(tmp_path / "o"), lines=True)
    assert spark.read.json(str(tmp_path / "o" / "data")).first().metadata.title == "T"
    assert "[¶ 1-2" in spark.read.json(str(tmp_path / "o" / "hierarchy_report")).first().text and spark.read.json(str(tmp_path / "o" / "chunks")).count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"text": "x", "chunk_id": "c1"}\n{"text": "y"}\n')
    (tmp_path / "in" / "b.json").write_text('{"metadata": {"provenance": {"source_file": "s"}}, "chunks": [{"text": "z"}, {"text": "w", "stable_id": "q"}]}')
    (tmp_path / "in" / "l.json").write_text('[{"text": "v"}]')
    got = {r.text: r.chunk_id for r in readers.read_chunks(spark, str(tmp_path / "in")).collect()}
    assert set(got) == set("xyzwv") and got["x"] == "c1" and got["q" if "q" in got else "w"] == "q" and got["z"] == "s_chunk_0" and got["v"] == "l.json_chunk_0"


def test_training_records_have_a_manifest(spark, tmp_path):
    m = sinks.write_training(spark.createDataFrame([("a", 0), ("bb", 1), ("c", 1)], "text string, label int"), str(tmp_path))
    assert {(r.label, r.rows, r.characters) for r in m.collect()} == {(0, 1, 1), (1, 2, 3)}


def test_names_of_parts(spark):
    d = spark.createDataFrame([("<META name='part' content='A &gt; B, c > Chapter 12'>", "T"), ("<p>", "My Title"), (None, "x y")], "h string, t string")
    assert [r[0] for r in d.select(archive.part_name(F.coalesce("h", F.lit("")), F.col("t"))).collect()] == ["b_c_chapter_12", "my_title", "x_y"]


def test_progress_of_streams(spark, tmp_path):
    p = ingest.Progress()
    spark.streams.addListener(p)
    try:
        spark.range(5).selectExpr("id as doc_id", "'a line' as text").write.parquet(str(tmp_path / "in"))
        s = ingest.stream(spark, str(tmp_path / "in"), "doc_id long, text string")
        ingest.write(ingest.paragraphs(s), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 5
        assert sum(n for _, _, n, _ in p.batches) in (0, 5) and not p.failed
    finally:
        spark.streams.removeListener(p)


def test_results_of_rows_with_one_url(spark, tmp_path):
    import duckdb

    from scriptora import registry

    pages = [(i, "http://h/a" if i < 7 else f"http://h/{i}", "<p>x</p>") for i in range(1, 10)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.queries()["rel_zip_by_url"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(registry.oracle_sql()["rel_zip_by_url"]).fetchall())
    index = spark.createDataFrame([(1, "u", "old"), (None, "u", "old"), (2, None, "old")], "n int, url string, status string")
    done = spark.createDataFrame([(None, "u", "new"), (2, None, "new")], "n int, url string, status string")
    assert {(r.n, r.url): r.status for r in exports.apply_results(index, done, "n").collect()} == {(1, "u"): "old", (None, "u"): "new", (2, None): "old"}
    assert {r.status for r in exports.apply_results(index, done).where("url = 'u'").collect()} == {"new"}
