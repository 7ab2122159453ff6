"""Structure of resumes: sections, skills, education, dates, contact lines."""

from __future__ import annotations

from leafwright.dialect import Spark
from leafwright.functions import text as T

# Patterns of dates, programmes, institutes, places and skill categories.
DASH = "[\u2013-]"
DATE = rf"(?i)\b{T.MONTH}\b.*?\b[0-9]{{4}}\b|\b[0-9]{{4}}\b\s*{DASH}\s*\b(?:[0-9]{{4}}|present)\b"
DATE_RANGE = rf"(?i)\b{T.MONTH}?\s*[0-9]{{4}}\s*{DASH}\s*{T.MONTH}?\s*(?:[0-9]{{4}}|present)\b"
EDGE = r"(?:^|\z|[^\p{L}\p{N}_])"
PROGRAM = rf"(?i){EDGE}(?:m\.?tech|b\.?tech|m\.?sc|b\.?sc|m\.?e|b\.?e|phd|mba|mca|bca|master|bachelor){EDGE}"
INSTITUTE = rf"(?i){EDGE}(?:university|college|institute|school|academy|iit|nit){EDGE}"
UPPER = r"^[A-Z][A-Z &/.'-]+$"
TITLE = r"^[A-Z][a-z]+(?:[ '-][A-Za-z]+)*$"
URL = r"(?i)\bhttps?://\S+"
SKILLS = {"Programming": r"(?i)^programming( languages)?\s*:?$", "Libraries/Frameworks": r"(?i)^libraries(/frameworks)?\s*:?$", "Tools/Platforms": r"(?i)^tools( / platforms)?\s*:?$", "Databases": r"(?i)^databases?\s*:?$"}


def lines(d: Spark) -> str:
    return d.explode("doc_id, page_index", d.split("text"), "line", "@pages")


def sections(d: Spark) -> str:
    """@pages -> doc_id, page_index, section, heading, body: lines under the last section heading above them."""
    head = T.heading(d, "line", "layout")
    numbered = f"select *, {head} as is_head, sum(case when {head} then 1 else 0 end) over (partition by doc_id, page_index order by nth rows unbounded preceding) as section from ({lines(d)}) q"
    return f"select doc_id, page_index, cast(section as bigint) as section, coalesce(max(case when is_head then {T.strip(d, 'line')} end), '') as heading, {d.gathered('line', 'nth', where='not is_head')} as body from ({numbered}) r group by doc_id, page_index, section"


def skills(d: Spark) -> str:
    """@pages -> doc_id, page_index, category, items: what follows a category line, split at marks, without repeats."""
    t = T.strip(d, "line")
    which = "case " + " ".join(f"when {d.found(t, p)} then '{c}'" for c, p in SKILLS.items()) + f" when {T.heading(d, 'line', 'layout')} then '' end"
    marked = f"select doc_id, page_index, nth, line, {which} as head from ({lines(d)}) q"
    blocks = f"select *, count(head) over (partition by doc_id, page_index order by nth rows unbounded preceding) as block from ({marked}) r"
    named = f"select *, max(head) over (partition by doc_id, page_index, block) as category from ({blocks}) s"
    parts = d.map(d.split(d.sub("line", "[\u2022;|,]", "\n")), "it", T.collapsed(d, T.strip(d, "it")))
    items = d.explode("doc_id, page_index, category, nth", parts, "item", f"(select * from ({named}) t where head is null and category <> '') u", "place")
    first = f"select *, row_number() over (partition by doc_id, page_index, category, lower(item) order by nth, place) as again from ({items}) v where item <> ''"
    return f"select doc_id, page_index, category, {d.gathered('item', d.struct(p='nth', k='place'), ', ')} as items from ({first}) w where again = 1 group by doc_id, page_index, category"


def rendered_skills(d: Spark) -> str:
    """One bullet per category, in the fixed order of categories."""
    order = "case category " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(SKILLS)) + " end"
    bullet = "'\u2022 ' || category || ': ' || items"
    return f"select doc_id, page_index, {d.gathered(bullet, order)} as result from ({skills(d)}) x group by doc_id, page_index"


def heading_dates(d: Spark, s: str) -> str:
    """An upper-case line takes the date on the line after it, over at most one blank line."""
    a = d.split(s)
    t = T.strip(d, "ln")
    nxt, after, before, earlier = (f"coalesce({d.at('al_', f'greatest(i {k}, 1)')}, '')" for k in ("+ 1", "+ 2", "- 1", "- 2"))
    dated = lambda e: d.found(e, DATE)
    upper = lambda e: d.found(T.strip(d, e), UPPER)
    blank = lambda e: f"{T.strip(d, e)} = ''"
    n = d.size("al_")
    own = f"case when {upper('ln')} and i < {n} and not ({blank(nxt)}) and {dated(nxt)} then {t} || ' \u2014 ' || {T.strip(d, nxt)} when {upper('ln')} and i + 1 < {n} and {blank(nxt)} and {dated(after)} then {t} || ' \u2014 ' || {T.strip(d, after)} else ln end"
    taken = f"(i > 1 and {upper(before)} and not ({blank('ln')}) and {dated('ln')}) or (i > 2 and {upper(earlier)} and {blank(before)} and {dated('ln')}) or (i > 1 and i < {n} and {upper(before)} and {blank('ln')} and {dated(nxt)})"
    kept = d.filter(d.enumerate("al_", "ln", "i", f"case when {taken} then null else {own} end"), "ln", "ln is not null")
    return d.at(d.map(d.array(a), "al_", d.join(kept)), "1")


def header_spacing(d: Spark, s: str) -> str:
    """Blank lines after a section heading become one."""
    return d.sub(s, r"(?mi)^([ \t]*(?:EDUCATION|ACADEMICS|EXPERIENCE|SKILLS|PROJECTS|CERTIFICATIONS|AWARDS)[ \t]*)\n(?:[ \t]*\n)+", "\\1\n\n")


def contact_block(d: Spark, s: str) -> str:
    """From the first line with text to the last of the six from there that looks like contact data."""
    a = d.filter(d.enumerate(d.split(s), "ln", "i", d.struct(i="cast(i as bigint)", ln="ln")), "r", f"{T.strip(d, 'r.ln')} <> ''")
    contact = d.found("lower(q_.ln)", "email|mobile|phone|[|]|,")
    picked = d.map(d.filter("nb_", "q_", f"q_.i < {d.at('nb_', '1')}.i + 6 and (q_.i = {d.at('nb_', '1')}.i or {contact})"), "q_", "q_.i")
    last = f"{d.at(f'({picked})', d.size(f'({picked})'))}"
    span = f"cast({d.at('nb_', '1')}.i - 1 as {d.text_type}) || '-' || cast({last} as {d.text_type})"
    return d.at(d.map(d.array(a), "nb_", f"case when {d.size('nb_')} = 0 then '' else {span} end"), "1")


def section_lines(d: Spark, *names: str) -> str:
    """@pages -> doc_id, page_index, section, nth, line: the lines under section headings of these names."""
    head = T.heading(d, "line", "layout")
    w = "over (partition by doc_id, page_index order by nth rows unbounded preceding)"
    numbered = f"select *, {head} as is_head, sum(case when {head} then 1 else 0 end) {w} as section from ({lines(d)}) sl0"
    named = f"select *, max(case when is_head then upper({T.strip(d, 'line')}) end) over (partition by doc_id, page_index, section) as heading from ({numbered}) sl1"
    return f"select doc_id, page_index, section, nth, line from ({named}) sl2 where not is_head and {T.one_of(d, 'heading', list(names))}"


def listed_links(d: Spark) -> str:
    """@pages -> each document's distinct URLs in the order of their first place."""
    urls = d.explode("doc_id, page_index", d.all("text", r"(?i)\bhttps?://[^\s)]+"), "url", "@pages", "place")
    first = f"select doc_id, url, min({d.struct(p='page_index', k='place')}) as place from ({urls}) q group by doc_id, url"
    return f"select doc_id, {d.gathered('url', 'place', ' ')} as urls from ({first}) r group by doc_id"
