"""The registered queries and the pipeline over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from scriptora.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_every_operator_has_its_query():
    names = sorted(queries.queries())
    assert sorted(n.split("_")[0] for n in names if n != "pipeline") == sorted(f"op{i}" for i in range(1, 11))
    assert set(names) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(names)


def test_op1_is_what_sql_gives(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()["op1_decontaminate"](spark, SF)
    want = c.sql(queries.oracle_sql()["op1_decontaminate"]).fetchall()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()) == sorted(want)


#: Overlapping kinds, characters beyond the first plane, short and long matches, repeats.
TRICKY = [
    "token: token: abcdefghij", "é token==abcdefgh secret='12345678\" x", "AKIA" + "AKIA" * 5 + " AKIAshort", "0" * 31 + " " + "f" * 32 + "g", None, "",
    "password=password=12345678 PASSWD : abc api_key=" + "k" * 9, "Token=ﬀabcdefgh token=abcdefgh" + "deadbeef" * 8, "👍 secret: 12345678", "👍 secret: 12345678",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-",
]


def test_op7_is_what_sql_gives(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TRICKY)] + [(10**6, TRICKY[0])], "doc_id long, text string")
    d.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.queries()["op7_secrets"](spark, str(tmp_path))
    want = c.sql(queries.oracle_sql()["op7_secrets"])
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall()) and sum(r[1] for r in rows) and sum(r[2] for r in rows) and sum(r[3] for r in rows)
    assert len({r[4] for r in rows}) > 5


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secrets", "bpe"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "token_ids"]
    n = out.count()
    assert 0.5 * docs.count() < n < docs.count() and out.select("doc_id").distinct().count() == n
    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns


def test_stages_take_odd_rows(spark, docs, empty):
    """Nulls, empty and very long texts, repeated rows, further columns and empty tables, stage by stage."""
    from scriptora.llm import simhash

    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, empty, SF)
        assert nothing.count() == 0
        if name != "bpe":
            assert nothing.columns == docs.columns
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    assert {r.doc_id for r in known.collect()} <= {r.doc_id for r in rows if r.text and any(map(str.isalpha, r.text))}
    classes = simhash.classes(simhash.fingerprints(docs)).select("root").distinct().count()
    one = stages["near_dedup"](spark, docs, SF).collect()
    assert len(one) == classes and {r.fp for r in one} == {7} and max(len(r.text or "") for r in one) > 100_000
    assert stages["decontaminate"](spark, docs, SF).count() == len(rows)
    out = stages["secrets"](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert [r.text.count("[SECRET]") for r in out.where("doc_id = 205").collect()] == [3]
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())
    ids = stages["bpe"](spark, docs, SF)
    assert ids.count() == len(rows) and ids.where("n_tokens = 0").count() == 2


def test_decontamination_takes_a_passage_of_one_item(spark):
    """Eight words of one item are enough for the pipeline, while the query's own rule asks for two items."""
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    passage = " ".join(item.split()[2:11])
    d = spark.createDataFrame([(1, f"before {passage} after"), (2, "clean words only")], "doc_id long, text string")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["decontaminate"](spark, d, SF).collect()] == [2]
