"""Pages: documents cut into pages of lines, form-feed documents, gates for uploads, routing to text layer or recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.dialect import Spark
from leafwright.functions import text as T

MAX_BYTES, MAX_PAGES = 15 * 1024 * 1024, 10

# The closed set of error codes.
ERRORS = ["FILE_TOO_LARGE", "TOO_MANY_PAGES", "BAD_MIME", "PDF_DECODE_ERROR", "IMAGE_DECODE_ERROR"]


def files(spark: SparkSession, path: str, glob: str = "*.{pdf,png,jpg,jpeg,webp}") -> DataFrame:
    """Uploaded files with the error their size or type earns. Contents of files over the limit are never read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    mime = F.element_at(F.split("path", r"\."), -1)
    kind = F.when(F.lower(mime) == "pdf", "application/pdf").when(F.lower(mime).isin("png", "jpg", "jpeg", "webp"), F.concat(F.lit("image/"), F.lower(mime)))
    error = F.when(F.col("length") > MAX_BYTES, "FILE_TOO_LARGE").when(kind.isNull(), "BAD_MIME")
    return found.select("path", "length", kind.alias("mime"), error.alias("error_code"), F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))


def form_feed_pages(d: Spark) -> str:
    """@docs (doc_id, text) -> doc_id, page_index, text: cut at form feeds, a blank last page dropped."""
    a = d.split("text", "\f")
    last = f"{d.at(a, d.size(a))}"
    kept = f"case when {T.strip(d, last)} = '' then {d.part(a, '1', d.size(a) + ' - 1')} else {a} end"
    return f"select doc_id, cast(page_index as bigint) as page_index, text from ({d.explode('doc_id', 'pages', 'text', f'(select doc_id, {kept} as pages from @docs) q', 'page_index')}) r"


def paged(d: Spark, lines_per_page: int = 8) -> str:
    """@docs -> pages of a fixed number of lines."""
    return _pages(d, d.split("text"), lines_per_page, "")


def defective_pages(d: Spark, lines_per_page: int = 8) -> str:
    """@docs -> pages with the defects that the rules repair, decided by document, page and line numbers."""
    k = "((doc_id + i - 1) % 13)"
    cases = {
        0: "'- ' || ln",
        1: "'* ' || ln",
        2: "ln || ' AWS (S3'",
        3: "ln || ' http://user' || doc_id || '@mail.example.com/'",
        4: f"substring(ln, 1, 5) || '-' || {d.lit(chr(10))} || substring(ln, 6)",
        5: d.lit("\u201c") + " || ln || " + d.lit("\u201d of\ufb01ce"),
        6: "substring(ln, 1, 3) || " + d.lit("\u00ad") + " || substring(ln, 4)",
        7: "'EDUCATION'",
        8: "ln || " + d.lit("  \t"),
        9: d.lit("\n") + " || ln",
        11: f"'http://user' || doc_id || '@mail.example.com/' || {d.lit(chr(10))} || lower(ln)",
        12: f"'Skills: python,SQL | spark' || {d.lit(chr(10))} || 'Kokata,India 2019 - 2021,'",
    }
    body = "case " + k + " " + " ".join(f"when {n} then {x}" for n, x in cases.items()) + " else ln end"
    head = f"(case when doc_id % 5 = 0 or p % 4 = 3 then '' else 'CONFIDENTIAL ' || coalesce(source, '') || {d.lit(chr(10))} end)"
    foot = f"(case when doc_id % 5 = 0 then '' else {d.lit(chr(10))} || 'Page ' || (p + 1) end)"
    return _pages(d, d.enumerate(d.split("text"), "ln", "i", body), lines_per_page, head, foot)


def _pages(d: Spark, lines: str, n: int, head: str, foot: str = "") -> str:
    count = d.div(f"{d.size('lines')} + {n - 1}", str(n))
    part = d.join(d.part("lines", f"p * {n} + 1", str(n)))
    page = " || ".join(x for x in (head, part, foot) if x)
    pages = d.map(d.range(count), "p", page)
    return f"select doc_id, cast(page_index as bigint) as page_index, text from ({d.explode('doc_id', 'pages', 'text', f'(select doc_id, {pages} as pages from (select doc_id, source, {lines} as lines from @docs) q) r', 'page_index')}) s"


def meaningful(d: Spark, pages: str, least: int = 30) -> str:
    """Whether any page's stripped text has at least so many characters."""
    return d.any(pages, "pg", f"length({T.strip(d, 'pg')}) >= {least}")


def route(d: Spark, prefer: str, text: str) -> str:
    return f"case when {prefer} and length({T.strip(d, text)}) >= 30 then 'pdf_text' else 'ocr' end"


def error_code(mime: str, size: str, pages: str) -> str:
    return f"case when {size} > {MAX_BYTES} then 'FILE_TOO_LARGE' when {mime} not in ('application/pdf', 'image/png', 'image/jpeg', 'image/webp') then 'BAD_MIME' when {pages} > {MAX_PAGES} then 'TOO_MANY_PAGES' end"


def band(side: str, other: str, d: Spark, low: int = 1800, high: int = 3200) -> str:
    """A side after the long edge is brought into [low, high], truncated."""
    long = f"greatest({side}, {other})"
    scale = f"(case when {long} < {low} then {low} / {d.double(long)} when {long} > {high} then {high} / {d.double(long)} else {d.double('1')} end)"
    return f"cast(floor({side} * {scale}) as bigint)"
