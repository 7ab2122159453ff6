"""Rules of resumes on lines that a backtracking engine can take apart in very many ways, and equal patterns side by side."""

import random
import threading
import time

import pytest

from leafwright.dialect import SPARK
from leafwright.functions import text as T
from leafwright.operators import pipelines, resume
from leafwright.plans.run import apply

SHOUTED = "QWERTYUIOPASDF " * 7 + "QWERTYUIOPASDF x"  # eight upper-case words and what is no word


def soon(df, seconds=45):
    """Rows of a query that once took hours."""
    began = time.monotonic()
    timer = threading.Timer(seconds, df.sparkSession.sparkContext.cancelAllJobs)
    timer.start()
    try:
        rows = df.collect()
    finally:
        timer.cancel()
    assert time.monotonic() - began < seconds
    return rows


def agree(spark, pattern, steady, pieces, n=4000):
    """Both patterns on short random lines."""
    draw = random.Random(7)
    lines = sorted({"".join(draw.choice(pieces) for _ in range(draw.randint(1, 7))).strip() for _ in range(n)})
    df = spark.createDataFrame([(x,) for x in lines], "ln string")
    rows = df.selectExpr("ln", f"{SPARK.found('ln', pattern)} as a", f"{SPARK.found('ln', steady)} as b").collect()
    assert [r.ln for r in rows if r.a != r.b] == []
    assert {r.a for r in rows} == {True, False}


def test_institutions_are_told_in_one_pass(spark):  # F2
    df = spark.createDataFrame([(SHOUTED,), (SHOUTED[:-2],), ("  IIT Delhi\u00a0",), ("O'Neil-Smith College",), ("of Delhi",), ("",)], "ln string")
    assert [r[0] for r in soon(df.selectExpr(resume.institution(SPARK, "ln")))] == [False, True, True, False, False, False]


def test_strip_takes_every_blank(spark):  # F2
    lines = [chr(i) for i in range(1, 0x3100)]
    df = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in lines], "ln string")
    rows = df.selectExpr("ln", f"{T.strip(SPARK, 'ln')} as a", r"regexp_replace(ln, r'^[\s\p{Z}]+|[\s\p{Z}]+\z', '') as b").collect()
    assert [r.ln for r in rows if r.a != r.b] == []


def test_education_sentences_beside_shouted_lines(spark):  # F5
    text = f"{SHOUTED}\nCHRIST UNIVERSITY\nData Science Master of technology\nBangalore\nAugust 2024 - August 2026\n{SHOUTED}"
    rule = SPARK.join(f"({resume.education_sentences(SPARK, SPARK.split('text'))}).out")
    (row,) = soon(spark.createDataFrame([(text,)], "text string").selectExpr(rule))
    assert row[0] == f"{SHOUTED}\nCHRIST UNIVERSITY \u2014 Data Science, Master of Technology (Bangalore) \u2014 August 2024 - August 2026\n{SHOUTED}"


JOINED = ["2019", "1999", "20190", "-", "\u2013", " ", "jan", "May ", "present", "Present", "x", "\u00e9", "\U0001d400", "_", "m.tech", "MBA", "Master of Science", "be", "."]


@pytest.mark.parametrize("pattern, steady", [(resume.JOIN_RANGE, resume.STEADY_JOIN_RANGE), (resume.JOIN_DEGREE, resume.STEADY_JOIN_DEGREE)])
def test_join_patterns_agree(spark, pattern, steady):  # F5
    agree(spark, pattern, steady, JOINED)


def test_inline_education_on_long_lists(spark):  # F4
    place = "Ab" + ", Cd" * 40
    rule = SPARK.join(f"({resume.inline_education(SPARK, SPARK.split('text'))}).out")
    (row,) = soon(spark.createDataFrame([(f"one1\n{place}!\ntwo2",)], "text string").selectExpr(rule))
    assert row[0] == f"one1\n{place}!\ntwo2"


PLACED = ["Ab", "c d", ",", ", ", " ", "\t", ".", "-", "9", "\u00e9", "India", "pune", "BSc", "diploma", "Data Science", "\U0001d400", "_", "2019", "20190", "\u2014", "jan", "present"]


@pytest.mark.parametrize("pattern, steady", [(resume.PLACE_LIST, resume.STEADY_LIST), (resume.INLINE_RANGE, resume.STEADY_RANGE), (resume.INLINE_DEGREE, resume.STEADY_DEGREE), (resume.INLINE_PLACE, resume.STEADY_PLACE)])
def test_inline_patterns_agree(spark, pattern, steady):  # F4
    agree(spark, pattern, steady, PLACED)


def test_fix_resume_on_shouted_lines(spark):  # F1
    page = f"{SHOUTED}\n{SHOUTED} github, MASTER OF science  in\tKOKATA"
    (row,) = soon(apply(pipelines.fixed_resume(SPARK), pages=spark.createDataFrame([(1, 0, page)], "doc_id long, page_index long, text string")))
    assert row.text == f"{SHOUTED}\n{SHOUTED} GitHub, Master of Science in kolkata"


def test_fix_resume_with_sections_on_shouted_lines(spark):  # F3
    page = f"EDUCATION\nIIT Delhi\nM.Tech\nDelhi\n2019 - 2021\n{SHOUTED}\nSKILLS\nPython"
    (row,) = soon(apply(pipelines.fixed_resume(SPARK), pages=spark.createDataFrame([(1, 0, page)], "doc_id long, page_index long, text string")))
    assert row.text.split("\n")[-3:] == [SHOUTED, "SKILLS", "Python"]
