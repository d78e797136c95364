"""Lines of capitals set apart: queries with SQL leave them as the SQL does, the functions join them."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptora import registry
from scriptora.functions import text

TEXT = "Head\nA A A A A word and more\nB C D E plain\nA HE END ( x )\n12. S E C O N D\nOn January 5, 1993 X Y Z came."
NAMES = (
    "anl_church_metadata", "anl_counts", "str_paragraphs", "txt_clean_text", "txt_sentences", "txt_toc_title", "prs_heading_like", "prs_pdf_blocks", "rel_boundaries", "rel_range_join", "rel_rollup",
    "snk_captures", "snk_hierarchy_report", "txt_hierarchy", "ded_paragraphs", "chk_rag", "chk_rag_drop_small", "nse_flags", "nse_tiny", "nse_scan", "nse_front_matter", "anl_generic_metadata", "prs_markdown",
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("caps"))
    rows = [(i, "\n".join([TEXT] * i), "en", f"src{i}", len(TEXT) * i) for i in (1, 2, 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, "user", "A B C D said"), (1, 2, "bot", "T HE end")], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_as_sql(spark, tables, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, tables)
    want = c.sql(registry.oracle_sql()[name])
    cols = sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[x] for x in cols) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_functions_join(spark):
    r = spark.createDataFrame([("S E C O N D ( x )",)], "x string").select(text.clean_text(F.col("x")).alias("a"), text.clean_text(F.col("x"), spaced_caps=False).alias("b")).first()
    assert (r.a, r.b) == ("SECOND (x)", "S E C O N D (x)")
