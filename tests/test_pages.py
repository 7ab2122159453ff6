"""Operators over whole documents, and the registry."""

import pytest

from leafwright.dialect import SPARK
from leafwright.operators import boilerplate, pipelines, structure
from leafwright.plans import catalog
from leafwright.plans.run import apply
from leafwright.sources import pages as P


def frame(spark, docs):
    rows = [(i, k, t) for i, pages in enumerate(docs) for k, t in enumerate(pages)]
    return spark.createDataFrame(rows, "doc_id long, page_index long, text string")


def texts(df, column="text"):
    return [r[column] for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.page_index))]


def test_header_and_footer_go(spark):
    df = frame(spark, [["Header Line\nBody\nFooter Line", "Header Line\nBody two\nFooter Line"]])
    assert texts(apply(boilerplate.removed(SPARK, "a"), pages=df)) == ["Body", "Body two"]
    found = {r.key for r in apply(boilerplate.detected(SPARK, "a"), pages=df).collect()}
    assert found == {"Header Line", "Footer Line"}


def test_support_of_three_quarters(spark):
    df = frame(spark, [["WATERMARK\nuno", "WATERMARK\ndos", "WATERMARK\ntres", "cuatro"]])
    assert texts(apply(boilerplate.removed(SPARK, "g"), pages=df)) == ["uno", "dos", "tres", "cuatro"]


def test_seeded_watermark_goes_even_alone(spark):
    df = frame(spark, [["CV MAKER demo watermark page 1\nBody"]])
    assert texts(apply(boilerplate.removed(SPARK, "d"), pages=df)) == ["Body"]


@pytest.mark.parametrize("variant", boilerplate.POLICIES)
def test_one_page_and_empty_stay(spark, variant):
    df = frame(spark, [["only\nlines"], ["", ""], ["x"]])
    assert apply(boilerplate.removed(SPARK, variant), pages=df).count() == 4


def test_clean_documents_stay(spark):
    df = frame(spark, [["First page text here.", "Second page text there."]])
    for cleaner in (pipelines.postproc, pipelines.finish_v1, pipelines.finish_spec, pipelines.validated):
        assert texts(apply(cleaner(SPARK), pages=df)) == ["First page text here.", "Second page text there."]


def test_flagship(spark):
    df = frame(spark, [["Header\nThis is a line\nthat contin-\nues.\n- bullet", "Header\nhttp://a@b.com\nDone,\nagain"]])
    assert texts(apply(pipelines.postproc(SPARK), pages=df)) == ["This is a line that continues.\n• bullet", "Done, again"]


def test_form_feeds(spark):
    docs = spark.createDataFrame([(1, "a\fb\f "), (2, "x")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in apply(P.form_feed_pages(SPARK), docs=docs).collect())
    assert rows == [(1, 0, "a"), (1, 1, "b"), (2, 0, "x")]


def test_skills(spark):
    df = frame(spark, [["SKILLS\nProgramming\nPython, SQL; python\nDatabases:\nMySQL|Oracle"]])
    rows = {(r.category, r["items"]) for r in apply(structure.skills(SPARK), pages=df).collect()}
    assert rows == {("Programming", "Python, SQL"), ("Databases", "MySQL, Oracle")}


def test_every_query_has_its_sql_but_word_error_rates():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == catalog.NO_SQL
    assert len(catalog.queries()) >= 120


def test_entry_imports_without_the_language_model_folder():
    import __spark_entry__

    assert "postproc" in __spark_entry__.queries()
