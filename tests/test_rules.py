"""Small inputs with the results that the rules must give."""

import random

import pytest

from leafwright.dialect import DUCK, SPARK
from leafwright.functions import dialogue as D
from leafwright.functions import recognition as R
from leafwright.functions import scores as S
from leafwright.functions import text as T
from leafwright.operators import heal
from leafwright.plans.run import apply


def value(spark, make, text=None):
    """An expression's value in Spark, the same as in the other engine."""
    import duckdb

    given = (lambda d: d.lit(text)) if text is not None else (lambda d: None)
    out = spark.sql(f"select {make(SPARK, given(SPARK))} as x").first().x
    other = duckdb.sql(f"select {make(DUCK, given(DUCK))} as x").fetchall()[0][0]
    assert out == other or out == pytest.approx(float(other))
    return out


def each(f):
    return lambda d, s: T.by_line(d, s, "ln", f(d, "ln"))


RULES = [
    (T.glyphs, "office ﬁle “test” and ‘ok’", "office file \"test\" and 'ok'"),
    (T.without_soft_hyphens, "soft hy­phen", "soft hyphen"),
    (T.dehyphen, "medi-\ncal", "medical"),
    (T.dehyphen, "é-\né", "éé"),
    (T.dehyphen, "Sree-Venkateswara", "Sree-Venkateswara"),
    (lambda d, s: T.dehyphen(d, s, "chained"), "a-\nb-\nc", "abc"),
    (lambda d, s: T.dehyphen(d, s, "ascii"), "é-\né", "é-\né"),
    (T.safe_clean, "Pulse &\nRespiration", "Pulse & Respiration"),
    (lambda d, s: T.bullets(d, s, "general"), "- one\n* two\n• three\n● four\n▪ five", "• one\n• two\n• three\n• four\n• five"),
    (T.bullets, "• • Skilled task\n- Another bullet", "• Skilled task\n• Another bullet"),
    (T.bullets, "•\nDisinfection of", "• Disinfection of"),
    (T.bullets, "-5 deg", "• 5 deg"),
    (T.joined_orphans, "PPE Usage,\n• Disinfection", "PPE Usage, Disinfection"),
    (T.joined_orphans, "PPE,\nViqué", "PPE,\nViqué"),
    (T.without_email_urls, "a\nhttp://user@domain.com/\nhttps://example.com/path", "a\nhttps://example.com/path"),
    (T.without_bare_emails, "a\nuser@domain.com\nb", "a\nb"),
    (T.email_tokens_dropped, "Contact: http://user@domain.com/ and email user@domain.com", "Contact: and email user@domain.com"),
    (T.emails_unwrapped, "Contact: http://user@domain.com/", "Contact: user@domain.com/"),
    (T.emails_unwrapped, "http://u@d.com/ab", "u@d.comab"),
    (T.emails_canonical, "Contact: http://user@domain.com/", "Contact: user@domain.com"),
    (T.label_colons, "Email:abc@example.com\nWebsite: https://example.com\nhttps://x.y", "Email: abc@example.com\nWebsite: https://example.com\nhttps://x.y"),
    (T.contact_line, "Email:deepa@x.com|Mobile:  7679 211817", "Email: deepa@x.com | Mobile: 7679 211817"),
    (T.section_case, "Topics: anatomy & physiology, fundamentals of nursing, PSYCHOLOGY & SOCIOLOGY", "Topics: Anatomy & Physiology, Fundamentals of Nursing, Psychology & Sociology"),
    (T.canonical_phrases, "FUNDAMENTALS of nursing", "Fundamentals of Nursing"),
    (T.typos, "Kokata,India", "Kolkata, India"),
    (lambda d, s: T.cities(d, s, T.LAYOUT_CITIES, keep_case=True), "KOKATA Manglore bangaluru", "KOLKATA Mangalore bengaluru"),
    (T.punctuation, "Kokata,India March 2024 - June 2024", "Kokata, India March 2024 – June 2024"),
    (each(T.paren_cloud), "Using AWS (S3 in project", "Using AWS (S3) in project"),
    (each(T.paren_acronym), "Using AWS (S3 in project", "Using AWS (S3) in project"),
    (each(T.paren_at_end), "AWS (S3\ndone (x)", "AWS (S3)\ndone (x)"),
    (each(T.paren_one_extra), "AWS (S3\nAWS (Lambda", "AWS (S3)\nAWS (Lambda"),
    (each(T.paren_known_token), "in AWS (BigQuery things", "in AWS (BigQuery things)"),
    (each(T.paren_short), "AWS (S3 in use\nAWS (Big Query)\nAWS (S3", "AWS (S3) in use\nAWS (Big Query)\nAWS (S3)"),
    (T.paren_brand, "AWS (S3 and (x) then AWS  (EC2 now\nGCP (SQL\nAzure (SQL", "AWS (S3 and (x) then AWS (EC2) now\nGCP (SQL)\nAzure (SQL"),
    (T.placeholders, "a (hi) b(bn)c (bn)", "a b(bn)c "),
    (T.pipes_before_url, "a|b http://x|y", "a | b http://x|y"),
    (T.one_blank_per_run, "a\n\n\nb", "a\n\nb"),
    (lambda d, s: d.join(heal.wrapped(d, d.split(s))), "This is a line\nthat continues.\nEnds with period.\nNext line", "This is a line that continues.\nEnds with period.\nNext line"),
    (lambda d, s: d.join(heal.pairwise(d, d.split(s))), "one two\nthree four\nfive.\n\n\n\nSix", "one two three four\nfive.\n\n\nSix"),
    (lambda d, s: d.join(f"({heal.deduped_headings(d, d.split(s))}).out"), "EDUCATION\nEDUCATION\nLine", "EDUCATION\nLine"),
    (lambda d, s: f"cast(({heal.label_rows(d, d.split(s))}).merges as bigint)", "Programming: Python\nFrameworks: Django\nTools: Git\nDatabases: MySQL\nEXPERIENCE", 3),
    (heal.tail_headings_cut, "body\nOBJECTIVE\nEDUCATION\nCREDENTIALS", "body"),
    (heal.tail_headings_cut, "body\nOBJECTIVE\nEDUCATION", "body\nOBJECTIVE\nEDUCATION"),
    (heal.by_newline, "a\nb.\nc\n- d", "a b.\nc\n- d"),
    (D.numbered, "- a\n\n b", "1. a\n2. b"),
    (D.json_block, "x ```json\n{\"a\": 1}\n``` y", '{"a": 1}'),
    (D.factual_risk, '{"factual_risk": 7}', 3),
    (D.factual_risk, "no json", 1),
    (D.factual_risk, "{}", 0),
    (D.violations, "this is dangerous", "jailbreak"),
    (D.debiased, "The Chairman told you guys", "The chair told you everyone"),
    (lambda d, s: D.truncated(d, s, 4), "abcdef", "abc…"),
    (D.sanitized, "how to make a bomb", "[redacted]"),
]


@pytest.mark.parametrize("rule, given, wanted", RULES, ids=range(len(RULES)))
def test_rule(spark, rule, given, wanted):
    assert value(spark, rule, given) == wanted


@pytest.mark.parametrize("w, h, lines, psm", [(1200, 1600, 2, 11), (2200, 1000, 20, 4), (1200, 1600, 30, 6), (1200, 1600, 5, 4)])
def test_psm(spark, w, h, lines, psm):
    assert value(spark, lambda d, _: R.auto_psm(str(w), str(h), str(lines), d)) == psm


@pytest.mark.parametrize("psm, conf, again", [(4, 65.0, True), (6, 69.9, True), (4, 80.0, False), (11, 40.0, False)])
def test_retry(spark, psm, conf, again):
    assert value(spark, lambda d, _: R.should_retry(str(psm), str(conf))) == again


@pytest.mark.parametrize("hint, packs, code", [("en", ["eng"], "eng+osd"), ("hi", ["hin"], "hin+osd"), ("hi", ["eng"], "eng+osd"), ("eng+hin", ["eng", "hin"], "eng+hin+osd"), ("osd", ["eng"], "eng+osd"), ("xx", ["eng"], "eng+osd")])
def test_language(spark, hint, packs, code):
    assert value(spark, lambda d, s: R.resolve_language(d, s, d.array(*map(d.lit, packs))), hint) == code


def test_word_error_rate(spark):
    assert value(spark, lambda d, _: S.word_error_rate(d, d.split("'patient assessment and care'", " "), d.split("'patient care'", " "))) == 0.5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_word_error_rate_of_many_distinct_words(spark):
    """More distinct words than chr() has values, against brute force."""
    rng = random.Random(3)
    pairs = [([f"a{i}" for i in range(256)], [f"b{i}" for i in range(256)])]
    for n in (300, 700):
        a = [f"w{rng.randrange(2 * n)}" for _ in range(n)]
        pairs.append((a, [f"w{rng.randrange(2 * n)}" if rng.random() < 0.2 else w for w in a if rng.random() > 0.1]))
    for a, b in pairs:
        df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        assert df.selectExpr(f"{S.word_error_rate(SPARK, 'a', 'b')} as x").first().x == edits(a, b) / len(a)


def test_wer_reads_whole_pages(spark, tmp_path):
    """Every fifth word is left out, so the rate is (n // 5) / n over all n words of a page."""
    from leafwright.plans import catalog

    text = "\n".join(" ".join(f"word{i}x{j}" for j in range(61)) for i in range(8))
    spark.createDataFrame([(2, text, "en", "web", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pages = apply(catalog.source(SPARK, "select * from @docs", "pages"), docs=spark.read.parquet(f"{tmp_path}/documents.parquet"))
    words = {(r.doc_id, r.page_index): len(r.text.split()) for r in pages.collect()}
    got = {(r.doc_id, r.page_index): r.wer for r in catalog.queries()["wer"](spark, str(tmp_path)).collect()}
    assert max(words.values()) > 223 and any(n % 5 for n in words.values()) and got.keys() == words.keys()
    for k, n in words.items():
        assert got[k] == pytest.approx(n // 5 / n)


def test_confidence_ranks(spark):
    numbers = lambda d: d.array(*(f"{x}.0" if d.name == "duck" else f"{x}D" for x in range(1, 41)))
    assert value(spark, lambda d, _: R.nearest_rank_p05(d, numbers(d))) == 0.02
    assert value(spark, lambda d, _: R.nearest_rank_p95(d, numbers(d))) == 39.0


@pytest.mark.parametrize("a, b, distance", [("abcd", "abcd", 0.0), ("abc", "xyz", 1.0), ("", "", 0.0)])
def test_trigram_distance(spark, a, b, distance):
    assert value(spark, lambda d, _: S.set_distance(d, S.trigrams(d, d.lit(a)), S.trigrams(d, d.lit(b)))) == distance
