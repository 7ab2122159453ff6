"""Resume sections: one-line education and skills, layout, contact links, headings in one case.

Rules on a page are folds over its lines (`sweep`); rules on a document are windows within it.
"""

from __future__ import annotations

from collections.abc import Callable

from leafwright.dialect import BEGIN, SPACE, Spark
from leafwright.functions import text as T
from leafwright.operators import structure as S

# What education and skill lines are told by.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december"
INNER = r"[^\p{L}\p{N}_]"  # no part of a word
YEAR, END = r"\p{Nd}{4}", rf"(?:{INNER}|\z)"
DASHES = "[-\u2014\u2013]"
INLINE_RANGE = rf"(?i)(?:^|{INNER})(?:{MONTHS})?\s*{YEAR}(?:{INNER}.*?)?{DASHES}(?:.*?{INNER})?(?:{MONTHS})?\s*(?:{YEAR}|present){END}"
INLINE_DEGREE = rf"(?i)(?:^|{INNER})(?:BA|BSc|B\.?(?:Tech|E|Sc|CA)|M\.?(?:Tech|E|Sc|CA)|Master|Bachelor|Diploma|Data Science){END}"
INLINE_PLACE = rf"(?i)(?:^|{INNER})(?:India|Bengaluru|Bangalore|Pune|Kolkata|Kokata|Maharashtra|Delhi|Mumbai){END}"
PLACE_LIST = r"^[A-Za-z][A-Za-z .-]+(?:,\s*[A-Za-z .-]+)*$"
# the same for an engine that backtracks: the first year, the first dash behind it, then a year; blanks after a comma
# belong to the comma unless nothing else follows
STEADY_RANGE = rf"(?i)^(?=[^\n\u2014\u2013-]*+{DASHES})(?>.*?(?:^|{INNER})(?:{MONTHS})?{YEAR}(?={INNER}))(?>[^\n\u2014\u2013-]*+{DASHES})(?>(?:.*?{INNER})?(?:{MONTHS})?(?:{YEAR}|present){END})"
STEADY_DEGREE = f"(?=[BMDbmd]){BEGIN}(?i:{INLINE_DEGREE[INLINE_DEGREE.index('(?:BA'):]})"
STEADY_PLACE = f"(?=[IBPKMDibpkmd]){BEGIN}(?i:{INLINE_PLACE[INLINE_PLACE.index('(?:India'):]})"
STEADY_LIST = r"^[A-Za-z][A-Za-z .-]++(?:,(?>\s*+[A-Za-z .-]++|\s*+(?<= )))*+$"
CATEGORY = rf"(?i)^(Programming Languages|Libraries/Frameworks|Tools ?/ ?Platforms|Databases){END}"
SECTION_LINE = r"^[A-Z][A-Z ]{3,}$"
CENTURY = r"(?:19|20)\p{Nd}{2}"
JOIN_RANGE = rf"(?i)(?:^|{INNER})(?:(?:{MONTHS})[\s-]*)?{CENTURY}\s*" + "[\u2013-]" + rf"\s*(?:(?:{MONTHS})[\s-]*)?{CENTURY}|present{END}"
DEGREES = r"(?:master|bachelor)\s+of\s+(?:technology|science|engineering)|m\.?tech|b\.?tech|m\.?sc|b\.?sc|m\.?e|b\.?e|phd|mba|mca|bca"
JOIN_DEGREE = rf"(?i)(?:^|{INNER})({DEGREES}){END}"
BEFORE_DEGREE = rf"(?i)^((?:.*?{INNER})?)(?:{DEGREES}){END}"
STEADY_JOIN_RANGE = rf"(?i)(?=[12Pp])(?:(?:{BEGIN}|(?<={BEGIN}(?:{MONTHS}))){CENTURY}\s*" + "[\u2013-]" + rf"\s*(?:(?:{MONTHS})[\s-]*)?{CENTURY}|present{END})"
STEADY_JOIN_DEGREE = f"(?i)(?=[MBPmbp]){BEGIN}(?:{DEGREES}){END}"
NO_CITY = r"(?i)university|college|institute|school|data|science|engineering|technology"
LINK_HINTS = {"github": "GitHub", "linkedin": "LinkedIn", "portfolio": "Portfolio"}

Lines = Callable[[Spark, str], str]


def sweep(d: Spark, lines: str, seed: dict[str, str], item: dict[str, str], body: str) -> str:
    """A left fold from a seed: acc is the state, x the next element, a struct of the same fields; item sees `ln`, its
    place `i` from 1 and all lines as `al_`."""
    start = d.concat(d.array(d.struct(**seed)), d.enumerate("al_", "ln", "i", d.struct(**item)))
    return d.bind(lines, "al_", d.fold(start, "acc", "x", body))


def stripped_lines(d: Spark, s: str) -> str:
    return d.filter(d.map(d.split(s), "ln", T.strip(d, "ln")), "ln", "ln <> ''")


# education and skills on one line -----------------------------------------------------------------------------------


def inline_education(d: Spark, lines: str) -> str:
    """Lines -> a struct of lines and how many entries were inlined. An entry is a line with up to four after it, of
    which the first degree, dates and place are taken; with none of them the line stands alone."""
    no = d.lit("")
    steady = d.name == "spark"  # what a line may be is asked once a line, not once for each line that it follows

    def kinds_of(e: str) -> dict[str, str]:
        place = f"({d.found(e, INLINE_PLACE, STEADY_PLACE)} or {d.found(e, PLACE_LIST, STEADY_LIST)})"
        return {"prog": d.found(e, INLINE_DEGREE, STEADY_DEGREE), "dates": d.found(e, INLINE_RANGE, STEADY_RANGE), "loc": place}

    kinds = {k: f"y.is_{k}" for k in ("prog", "dates", "loc")} if steady else kinds_of("y.prog")
    take = {"prog": f"st.prog = '' and {kinds['prog']}"}
    take["dates"] = f"not ({take['prog']}) and st.dates = '' and {kinds['dates']}"
    take["loc"] = f"not ({take['prog']}) and not ({take['dates']}) and st.loc = '' and {kinds['loc']}"
    known = {f"is_{k}": "false" for k in kinds} if steady else {}
    step = d.struct(**{k: f"case when {c} then y.prog else st.{k} end" for k, c in take.items()}, **known)
    start, typed = d.struct(prog=no, dates=no, loc=no, **known), d.struct(prog="nx", dates=no, loc=no, **{f"is_{k}": c for k, c in kinds_of("nx").items() if steady})
    after = d.concat(d.array(start), d.part("ty_", "i + 1", "4") if steady else d.map(d.part("al_", "i + 1", "4"), "nx", typed))
    found = d.fold(after, "st", "y", step)
    dashed = d.sub("en_.dates", "\\s*(?:-|\u2014)\\s*", " \u2013 ")
    parts = d.filter(d.array("ln", "en_.prog", dashed, "en_.loc"), "pt", "pt <> ''")
    row = d.sub(d.sub(d.join(parts, " \u2014 "), "^[ \u2014]+|[ \u2014]+\\z", ""), r"[ \t]{2,}", " ")
    entry = d.bind(found, "en_", f"case when en_.prog = '' and en_.dates = '' and en_.loc = '' then {no} else {row} end")
    seed = {"out": d.strings(), "n": "0", "skip": "0", "row": no}
    item = {"out": d.array("ln"), "n": "0", "skip": "0", "row": entry}
    body = (
        f"case when acc.skip > 0 then {d.struct(out='acc.out', n='acc.n', skip='acc.skip - 1', row=no)}"
        f" when x.row = '' then {d.struct(out=d.concat('acc.out', 'x.out'), n='acc.n', skip='0', row=no)}"
        f" else {d.struct(out=d.concat('acc.out', d.array('x.row')), n='acc.n + 1', skip='4', row=no)} end"
    )
    if steady:
        return d.bind(lines, "el_", d.bind(d.map("el_", "nx", typed), "ty_", sweep(d, "el_", seed, item, body)))
    return sweep(d, lines, seed, item, body)


def inline_skills(d: Spark, lines: str) -> str:
    """Lines -> a struct of lines and counts: a category line takes the lines after it, up to a blank line, heading or
    category, as one comma list; a missing parenthesis of tools is closed."""
    no, none = d.lit(""), d.strings()
    ln = d.at("x.out", "1")
    is_cat, blank, head = d.found(ln, CATEGORY), f"{T.strip(d, ln)} = ''", d.found(T.strip(d, ln), r"^[A-Z][A-Z /&-]{3,}$")
    listed = T.strip(d, d.sub(d.sub(d.sub(d.join("acc.items", ", "), r"\s*,\s*", ", "), r",\s*,+", ", "), r"[ \t]{2,}", " "))
    tools = f"({d.found('acc.cat', r'(?i)^Tools ?/ ?Platforms')} and {T.opens(d, 'it_')} > {T.closes(d, 'it_')})"
    made = d.bind(listed, "it_", f"case when it_ = '' then acc.cat else {d.first('acc.cat', CATEGORY, 1)} || ': ' || it_ || case when {tools} then ')' else '' end end")
    closed = d.bind(listed, "it_", f"case when {tools} then 1 else 0 end")
    flushed = f"case when acc.mode = 1 then {d.concat('acc.out', d.array(made))} else acc.out end"
    n = f"acc.n + case when acc.mode = 1 and {listed} <> '' then 1 else 0 end"
    p = f"acc.p + case when acc.mode = 1 then {closed} else 0 end"
    keep = {"n": n, "p": p}
    body = (
        f"case when acc.mode = 1 and not ({is_cat}) and not ({blank}) and not ({head}) then "
        f"{d.struct(out='acc.out', items=d.concat('acc.items', d.array(T.strip(d, ln))), cat='acc.cat', mode='1', n='acc.n', p='acc.p')}"
        f" when {is_cat} then {d.struct(out=flushed, items=none, cat=ln, mode='1', **keep)}"
        f" when acc.mode >= 1 and {blank} then {d.struct(out=flushed, items=none, cat=no, mode='2', **keep)}"
        f" else {d.struct(out=d.concat(f'({flushed})', 'x.out'), items=none, cat=no, mode='0', **keep)} end"
    )
    seed = {"out": none, "items": none, "cat": no, "mode": "0", "n": "0", "p": "0"}
    item = {"out": d.array(T.rstrip(d, "ln")), "items": none, "cat": no, "mode": "0", "n": "0", "p": "0"}
    swept = sweep(d, lines, seed, item, body)
    return d.bind(swept, "acc", d.struct(out=flushed, n=n, p=p))


def in_section(d: Spark, s: str, name: str, change: Lines, count: str) -> str:
    """A struct of a text and a count: change applied to the lines under each line that is exactly the name, up to the
    next upper-case line. Only a heading that is the text's first line is kept, as published."""
    none = d.strings()
    body_text = d.bind(change(d, "bo_.body"), "ch_", d.struct(lines=d.split(d.join("ch_.out")), n=f"cast({count} as bigint)"))
    ln = d.at("x.out", "1")
    bound = f"(acc.inside = 2 and {d.found(ln, SECTION_LINE)} and not x.last)"
    starts = f"((acc.inside = 0 or {bound}) and {ln} = {d.lit(name)} and not x.last)"
    done = d.bind("acc", "bo_", d.bind(body_text, "bt_", d.struct(out=d.concat("bo_.out", "bt_.lines"), n="bo_.n + bt_.n")))
    zero = "cast(0 as bigint)"
    same = d.struct(out="acc.out", n="acc.n")
    closed = f"case when acc.inside > 0 then {done} else {same} end"

    def state(out: str, body: str, inside: str, n: str) -> str:
        return d.struct(out=out, body=body, inside=inside, last="false", first="false", n=n)

    step = (
        f"case when {starts} then {d.bind(closed, 'cl_', state(f'case when x.first then {d.concat("cl_.out", "x.out")} else cl_.out end', none, '1', 'cl_.n'))}"
        f" when acc.inside > 0 and not {bound} then {state('acc.out', d.concat('acc.body', 'x.out'), '2', 'acc.n')}"
        f" else {d.bind(closed, 'cl_', state(d.concat('cl_.out', 'x.out'), none, '0', 'cl_.n'))} end"
    )
    seed = {"out": none, "body": none, "inside": "0", "last": "false", "first": "false", "n": zero}
    item = {"out": d.array("ln"), "body": none, "inside": "0", "last": f"i >= {d.size('al_')}", "first": "i = 1", "n": zero}
    swept = sweep(d, d.split(s), seed, item, step)
    return d.bind(swept, "acc", d.bind(closed, "cl_", d.struct(text=d.join("cl_.out"), n="cl_.n")))


def normalized_resume(d: Spark) -> str:
    """@pages -> doc_id, page_index, text and the counts of its edits: education and skills on one line each, blanks after
    commas, en dashes with blanks. A page is a text of its own."""
    education = in_section(d, "text", "EDUCATION", lambda d, x: inline_education(d, d.filter(d.map(x, "el", T.strip(d, "el")), "el", "el <> ''")), "ch_.n")
    skills = in_section(d, "ed.text", "SKILLS", inline_skills, "ch_.n * 1000000 + ch_.p")
    commas, dashes = d.count("sk.text", r",\S"), d.count(d.sub("sk.text", r",(\S)", r", \1"), "\\s*(?:-|\u2014)\\s*")
    base = f"select doc_id, page_index, {education} as ed from (select doc_id, page_index, {d.nfc('text')} as text from @pages) nr0"
    both = f"select doc_id, page_index, ed, {skills} as sk from ({base}) nr1"
    return f"""select doc_id, page_index, {T.punctuation(d, "sk.text")} as text, ed.n as education_inlined,
      {d.div("sk.n", "1000000")} as skills_inlined, sk.n % 1000000 as parentheses_balanced, {commas} as spaces_after_commas, {dashes} as dash_normalized
      from ({both}) nr2"""


# layout -------------------------------------------------------------------------------------------------------------


def role_dates(d: Spark, lines: str) -> str:
    """A single blank line between a line and a date goes."""
    gone = f"i > 1 and {d.at('al_', 'greatest(i - 1, 1)')} <> '' and {T.strip(d, 'ln')} = '' and i < {d.size('al_')} and {d.found(f'coalesce({d.at("al_", "i + 1")}, {d.lit("")})', S.DATE)}"
    seed = {"out": d.strings(), "gone": "false", "wait": "0"}
    item = {"out": d.array("ln"), "gone": gone, "wait": "0"}
    # a date that was taken begins no pair of its own
    body = (
        f"case when x.gone and acc.wait = 0 then {d.struct(out='acc.out', gone='false', wait='2')}"
        f" else {d.struct(out=d.concat('acc.out', 'x.out'), gone='false', wait='greatest(acc.wait - 1, 0)')} end"
    )
    return f"({sweep(d, lines, seed, item, body)}).out"


def clusters(d: Spark, source: str) -> str:
    """Lines of education sections, each with what it may be and its blank-separated cluster: a sub-query over
    doc_id, page_index, section, nth, line."""
    t = T.strip(d, "line")
    dated, url = d.found(t, S.DATE), d.found(t, S.URL)
    upper, title = d.found(t, S.UPPER), d.found(t, S.TITLE)
    program = f"({d.found(t, S.PROGRAM)} or {upper} or {title}) and not {dated} and not {url}"
    institute = f"({d.found(t, S.INSTITUTE)} or {upper}) and not {dated}"
    city = f"not {d.found(t, r'\p{Nd}')} and not {url} and ({title} or {upper} or {d.found(t, r'^[A-Za-z][A-Za-z .-]+(?:, [A-Za-z .-]+)?$')})"
    numbered = f"select *, {t} as t, sum(case when {t} = '' then 1 else 0 end) over (partition by doc_id, page_index, section order by nth rows unbounded preceding) as cluster from ({source}) cs0"
    typed = f"select *, {dated} as is_dates, {program} as is_program, {institute} as is_institute, {city} as is_city from ({numbered}) cs1 where t <> ''"
    w = "over (partition by doc_id, page_index, section, cluster)"
    one = f"select *, min(case when is_dates then nth end) {w} as at_dates, min(case when is_program then nth end) {w} as at_program from ({typed}) cs2"
    two = f"select *, min(case when is_institute and coalesce(nth <> at_dates, true) and coalesce(nth <> at_program, true) then nth end) {w} as at_institute from ({one}) cs3"
    free = " and ".join(f"coalesce(nth <> at_{k}, true)" for k in ("dates", "program", "institute"))
    return f"select *, min(case when is_city and {free} then nth end) {w} as at_city from ({two}) cs4"


KINDS = ("program", "institute", "city", "dates")


def education_rows(d: Spark, source: str) -> str:
    """A sub-query of lines -> doc_id, page_index, section, cluster, program, institute, city, dates, n_left, text: each
    cluster's parts by priority, and its folded lines: the parts as one line, then what is left."""
    pick = ", ".join(f"coalesce(max(case when nth = at_{k} then t end), '') as {k}" for k in KINDS)
    left = " and ".join(f"coalesce(nth <> at_{k}, true)" for k in KINDS)
    gathered = d.gathered("t", "nth", where=left)
    rows = f"select doc_id, page_index, section, cluster, min(nth) as first_nth, {pick}, {d.count_if(left)} as n_left, {gathered} as rest from ({clusters(d, source)}) er0 group by doc_id, page_index, section, cluster"
    joined = d.join(d.filter(d.array(*KINDS), "pt", "pt <> ''"), " ")
    folded = d.join(d.filter(d.array("jo_", "rest"), "pt", "pt <> ''"))
    return f"select doc_id, page_index, section, cluster, first_nth, program, institute, city, dates, n_left, {d.bind(joined, 'jo_', folded)} as text from ({rows}) er1"


def skills_lines(d: Spark, lines: str) -> str:
    """Lines of a skills section as a bullet a category, or, where those are long, in two columns of 40."""
    none, no = d.strings(), d.lit("")
    which = "case " + " ".join(f"when {d.found('ln', p)} then {d.lit(c)}" for c, p in S.SKILLS.items()) + f" else {no} end"
    marked = d.map(d.filter(d.map(lines, "ln", T.strip(d, "ln")), "ln", "ln <> ''"), "ln", d.struct(head=which, ln="ln"))
    values = d.filter(d.map(d.split(d.sub(d.sub("x.ln", "\\s*[\u2022;|]\\s*", "\n"), r",\s*", "\n")), "it", T.collapsed(d, T.strip(d, "it"))), "it", "it <> ''")
    pairs = d.map(values, "it", "acc.head || chr(1) || it")
    seed = {"out": none, "head": no, "ln": no}
    start = d.concat(d.array(d.struct(**seed)), d.map(marked, "mk", d.struct(out=none, head="mk.head", ln="mk.ln")))
    body = (
        f"case when x.head <> '' then {d.struct(out='acc.out', head='x.head', ln=no)}"
        f" when acc.head = '' then acc else {d.struct(out=d.concat('acc.out', pairs), head='acc.head', ln=no)} end"
    )
    every = f"({d.fold(start, 'acc', 'x', body)}).out"
    first = d.filter(d.enumerate("ev_", "pr", "i", f"case when i = 1 or not {d.has(d.map(d.part('ev_', '1', 'i - 1'), 'q', 'lower(q)'), 'lower(pr)')} then pr end"), "pr", "pr is not null")
    item = lambda c: d.join(d.map(d.filter("fi_", "pr", d.found("pr", f"^{c}\\x01")), "pr", d.sub("pr", "^[^\\x01]*\\x01", "")), ", ")
    rows = d.array(*(d.bind(item(c), "li_", f"case when li_ <> '' then {d.lit(c)} || ': ' || li_ else {no} end") for c in S.SKILLS))
    bullets = d.map(d.filter("ro_", "r", "r <> ''"), "r", "'\u2022 ' || r")

    def column(k: int) -> str:
        return d.filter(d.part("ro_", str(k), "2"), "r", "r <> ''")

    pad = f"rpad(coalesce({d.at('le_', 'i')}, ''), greatest(40, cast(length(coalesce({d.at('le_', 'i')}, '')) as int)), ' ')"
    both = d.map(d.filter(d.array("1", "2"), "i", f"i <= greatest({d.size('le_')}, {d.size('ri_')})"), "i", f"{pad} || case when coalesce({d.at('ri_', 'i')}, '') <> '' then '  ' || {d.at('ri_', 'i')} else '' end")
    two = d.bind(column(1), "le_", d.bind(column(3), "ri_", both))
    long = f"{d.total(d.map('bu_', 'b', d.double('length(b)')))} > 100 * {d.size('bu_')}"
    shown = d.bind(rows, "ro_", d.bind(bullets, "bu_", f"case when {d.size('bu_')} = 0 then or_ when {long} then {two} else bu_ end"))
    return d.bind(lines, "or_", d.bind(every.replace(f"({lines})", "(or_)"), "ev_", d.bind(first, "fi_", shown)))


def laid_out(d: Spark, cleaned: str) -> str:
    """Cleaned pages (a sub-query) -> doc_id, page_index, text: sections with education folded, skills formatted, and
    dates beside their headings."""
    from leafwright.operators.structure import heading_dates

    t = T.strip(d, "line")
    head = T.heading(d, "line", "layout")
    exploded = d.explode("doc_id, page_index", d.split("text"), "line", f"({cleaned}) lo0")
    numbered = f"select doc_id, page_index, nth, line, {head} as is_head, sum(case when {head} then 1 else 0 end) over (partition by doc_id, page_index order by nth rows unbounded preceding) as section from ({exploded}) lo1"
    named = f"select *, coalesce(upper(max(case when is_head then {t} end) over (partition by doc_id, page_index, section)), '') as heading from ({numbered}) lo2"
    bodies = f"""select doc_id, page_index, section, max(case when is_head then {t} else '' end) as head, max(heading) as heading,
      {d.gathered(t, 'nth', where='not is_head')} as body, sum(case when is_head then 0 else 1 end) as n from ({named}) lo3 group by doc_id, page_index, section"""
    education = "heading in ('EDUCATION', 'ACADEMICS')"
    joined = f"select *, case when n > 0 then {heading_dates(d, 'body')} else body end as dated from ({bodies}) lo4"
    edu_lines = d.explode("doc_id, page_index, section", d.split("dated"), "line", f"(select * from lo5 where {education} and n > 0) lo6")
    folded = f"select doc_id, page_index, section, {d.gathered('text', 'first_nth', chr(10) * 2)} as folded from ({education_rows(d, edu_lines)}) lo7 group by doc_id, page_index, section"
    skills = f"case when n > 0 then {d.join(skills_lines(d, d.split('body')))} else body end"
    done = f"""select a.doc_id, a.page_index, a.section, head, n,
      case when {education} then coalesce(folded, '') when heading = 'SKILLS' then {skills} when n > 0 then dated else body end as body
      from lo5 a left join lo8 f on a.doc_id = f.doc_id and a.page_index = f.page_index and a.section = f.section"""
    block = f"case when head <> '' and n > 0 then head || {d.lit(chr(10))} || body when head <> '' then head else body end || {d.lit(chr(10))}"
    pages = f"select doc_id, page_index, {d.gathered(block, 'section')} as text from ({done}) lo9 where head <> '' or n > 0 group by doc_id, page_index"
    tidy = d.sub(T.by_line(d, T.single_blank_lines(d, "text"), "ln", T.rstrip(d, "ln")), r"\n+\z", "")
    return f"with lo5 as ({joined}), lo8 as ({folded}) select doc_id, page_index, {tidy} as text from ({pages}) lo10"


# links, headings, education sentences -------------------------------------------------------------------------------


def lifted(d: Spark) -> str:
    """@pages -> doc_id, page_index, text, n_links, warnings: the first page's contact block gets the document's link for
    each label that it names without one; a label without any link in the document is a warning."""
    w = "over (partition by doc_id)"
    named = lambda e, hint: d.found(f"lower({e})", hint if hint == "portfolio" else f"{hint}[.]com")
    links = d.all("text", r"(?i)\bhttps?://[^\s)]+", steady=r"(?=[Hh])\b(?i:https?)://[^\s)]+")
    own = ", ".join(f"{d.at(d.filter('us', 'u', named('u', h)), '1')} as p_{h}, case when {d.any('us', 'u', d.found('lower(u)', h))} then 1 else 0 end as q_{h}" for h in LINK_HINTS)
    per_page = f"select *, {own}, {S.contact_block(d, 'text')} as sp from (select doc_id, page_index, text, {links} as us from @pages) lk0"
    pick = ", ".join(f"min(case when p_{h} is not null then {d.struct(p='page_index', url=f'p_{h}')} end) {w} as u_{h}, max(q_{h}) {w} as has_{h}" for h in LINK_HINTS)
    begin, end = f"cast({d.first('sp', '^([0-9]+)-', 1)} as int)", f"cast({d.first('sp', '-([0-9]+)$', 1)} as int)"
    block = f"case when sp = '' then '' else lower({d.join(d.part(d.split('text'), f'{begin} + 1', f'{end} - {begin}'))}) end"
    opened = f"select *, {block} as block, case when sp = '' then 0 else {end} end as until, min(page_index) {w} as first_page, {pick} from ({per_page}) lk1"

    def there(h: str, label: str) -> str:
        return d.any(d.split("text"), "ln", f"{d.found('ln', '(?i)https?://')} and ({d.found('lower(ln)', h)} or {d.found('lower(ln)', rf'^{SPACE}*{label.lower()}:')})")

    want = {h: f"page_index = first_page and {d.found('block', h)}" for h in LINK_HINTS}
    new = d.filter(d.array(*(f"case when {want[h]} and has_{h} = 1 and u_{h} is not null and not {there(h, label)} then {d.lit(label + ': ')} || u_{h}.url end" for h, label in LINK_HINTS.items())), "nl", "nl is not null")
    warn = d.join(d.filter(d.array(*(f"case when {want[h]} and has_{h} = 0 then 'missing_url_for_{h}' end" for h in LINK_HINTS)), "wn", "wn is not null"), ",")
    put = d.join(d.concat(d.part("ls_", "1", "until"), "new_lines", d.part("ls_", "until + 1", f"{d.size('ls_')} - until")))
    made = f"select *, {new} as new_lines, {warn} as warnings from ({opened}) lk3"
    return f"select doc_id, page_index, case when {d.size('new_lines')} = 0 then text else {d.bind(d.split('text'), 'ls_', put)} end as text, {d.size('new_lines')} as n_links, warnings from ({made}) lk4"


def heading_case(d: Spark, s: str) -> str:
    """Headings of a page in the case that at least half of them have; brands and degrees elsewhere."""
    head = T.heading(d, "ln", "resume")
    steady = d.name == "spark"
    is_head = d.at("hd_", "i") if steady else head  # asked once a line
    heads = d.filter(d.enumerate("al_", "ln", "i", f"case when {is_head} then ln end"), "ln", "ln is not null") if steady else d.filter("al_", "ln", head)
    upper = f"{d.size(d.filter('hs_', 'ln', T.is_upper(d, 'ln')))} >= greatest(1, {d.div(d.size('hs_'), '2')})"
    fixed = f"case when up_ then upper(ln) else {T.title_item(d, 'ln')} end"
    line = f"case when {is_head} then {fixed} else {T.degrees(d, T.brands(d, 'ln'))} end"
    lines = d.enumerate("al_", "ln", "i", line) if steady else d.map("al_", "ln", line)
    body = d.bind(heads, "hs_", d.bind(f"({upper})", "up_", d.join(lines)))
    return d.bind(d.split(s), "al_", d.bind(d.map("al_", "ln", head), "hd_", body) if steady else body)


def degree_and_field(d: Spark, line: str) -> str:
    """A struct of the canonical degree of a line and the field before it; the whole line where there is none."""
    raw = d.first(line, JOIN_DEGREE, 1)
    before = d.sub(d.first(line, BEFORE_DEGREE, 1), r"^[ ,/|-]+|[ ,/|-]+\z", "")
    canonical = "case lower(replace(dg_, '.', '')) " + " ".join(f"when {d.lit(x.lower())} then {d.lit(x)}" for x in T.DEGREES) + f" else {T.title_item(d, 'dg_')} end"
    return d.bind(raw, "dg_", f"case when dg_ = '' then {d.struct(degree=T.strip(d, line), field=d.lit(''))} else {d.struct(degree=canonical, field=f'case when {before} = {d.lit("")} then {d.lit("")} else {T.title_item(d, before)} end')} end")


def institution(d: Spark, line: str, strip: bool = True) -> str:
    """A line of two upper-case words or more, or of up to eight capitalised or upper-case words."""
    word = r"[A-Z][a-z]+(?:[-'][A-Za-z]+)?|[^\s\p{Ll}\p{Lt}]*\p{Lu}[^\s\p{Ll}\p{Lt}]*"
    # each word read one way: its first capital is the capital, and it ends where blanks or the line's end follow
    whole = r"(?:[A-Z][a-z]++(?:[-'][A-Za-z]++)?+|[^\s\p{Ll}\p{Lt}\p{Lu}]*+\p{Lu}[^\s\p{Ll}\p{Lt}]*+)(?!\S)"
    upper = r"""^[A-Z0-9][A-Z0-9 '&/.-]*[A-Z0-9)]$"""
    return d.once(T.strip(d, line) if strip else line, "li_", lambda t: f"(({d.found(t, upper)} and {T.words(d, t)} >= 2) or {d.found(t, rf'^(?:{word})(?:\s+(?:{word})){{0,7}}$', rf'^{whole}(?:\s++{whole}){{0,7}}+$')})")


def education_sentences(d: Spark, lines: str) -> str:
    """Lines -> a struct of lines and joins: an institution with a degree and dates among the five lines after it becomes
    `institution \u2014 field, degree (city) \u2014 dates`; the degree, city and date lines right behind it go."""
    no = d.lit("")
    t = "nx"
    degree = f"({d.found(t, JOIN_DEGREE, STEADY_JOIN_DEGREE)} or {d.found(t, '(?i)bachelor|master', '(?=[BMbm])(?i:bachelor|master)')})"
    city = f"{t} <> '' and not {d.found(t, r'\p{Nd}')} and {T.words(d, t)} <= 4 and not {d.found(t, S.URL)} and not {d.found(t, JOIN_DEGREE)} and not {d.found(t, NO_CITY)} and {d.found(t, '^[A-Z][a-z]+(?:[ -][A-Z][a-z]+){0,2}$')}"
    dates = d.found(t, JOIN_RANGE, STEADY_JOIN_RANGE)
    window = d.map(d.part("al_", "i + 1", "5"), "nx0", T.strip(d, "nx0"))

    def nth(cond: str, upto: str = "5") -> str:
        hits = d.filter(d.enumerate("wi_", "nx", "k", f"case when k <= {upto} and {cond} then cast(k as int) end"), "k", "k is not null")
        return f"coalesce({d.at(hits, '1')}, 0)"

    # the search ends with the line that brings degree and dates together
    stop = "case when de_ > 0 and da_ > 0 then greatest(de_, da_) else 5 end"
    field = f"case when df_.field <> '' then df_.field || ', ' || df_.degree else df_.degree end"
    at = lambda e: f"coalesce({d.at('wi_', e)}, '')"
    row = d.bind(degree_and_field(d, at("de_")), "df_", f"{T.collapsed(d, T.strip(d, 'ln'))} || ' \u2014 ' || {field} || case when ci_ > 0 then ' (' || {T.title_item(d, at('ci_'))} || ')' else '' end || ' \u2014 ' || {T.collapsed(d, at('da_'))}")
    run = "case when " + " when ".join(f"not (de_ = {k} or da_ = {k} or ci_ = {k}) then {k - 1}" for k in range(1, 6)) + " else 5 end"
    nobody = d.struct(row=no, skip="cast(0 as int)")
    steady = d.name == "spark"  # lines are stripped and asked once, and only those that an institution can reach
    both = "de_ > 0 and da_ > 0"
    where = {"de": degree, "da": dates}
    if steady:
        window = d.part("sl_", "i + 1", "5")
        reached = d.any(d.part("in_", "greatest(i - 5, 1)", "least(i - 1, 5)"), "b", "b")
        typed = d.enumerate("sl_", "nx", "i", f"case when {reached} then {d.struct(**where)} else {d.struct(de='false', da='false')} end")
        places = {k: f"array_position({d.map(d.part('ty_', 'i + 1', '5'), 'y', f'y.{k}')}, true)" for k in where}
        towns = f"case when {both} then {nth(city, f'({stop})')} else 0 end"
    else:
        places, towns = {k: nth(c) for k, c in where.items()}, nth(city, f"({stop})")
    entry = d.bind(window, "wi_", d.bind(places["de"], "de_", d.bind(places["da"], "da_", d.bind(towns, "ci_", f"case when {both} then {d.struct(row=row, skip=f'cast({run} as int)')} else {nobody} end"))))
    entry = f"case when {d.at('in_', 'i') if steady else institution(d, 'ln')} then {entry} else {nobody} end"
    seed = {"out": d.strings(), "n": "0", "skip": "cast(0 as int)", "row": d.struct(row=no, skip="cast(0 as int)")}
    item = {"out": d.array("ln"), "n": "0", "skip": "cast(0 as int)", "row": entry}
    nothing = seed["row"]
    body = (
        f"case when acc.skip > 0 then {d.struct(out='acc.out', n='acc.n', skip='cast(acc.skip - 1 as int)', row=nothing)}"
        f" when x.row.row = '' then {d.struct(out=d.concat('acc.out', 'x.out'), n='acc.n', skip='cast(0 as int)', row=nothing)}"
        f" else {d.struct(out=d.concat('acc.out', d.array('x.row.row')), n='acc.n + 1', skip='x.row.skip', row=nothing)} end"
    )
    if steady:
        swept = d.bind(typed, "ty_", sweep(d, "el_", seed, item, body))
        return d.bind(lines, "el_", d.bind(d.map("el_", "ln", T.strip(d, "ln")), "sl_", d.bind(d.map("sl_", "ln", institution(d, "ln", False)), "in_", swept)))
    return sweep(d, lines, seed, item, body)


# the single-string cleaner ------------------------------------------------------------------------------------------


def cleaned_text(d: Spark, s: str) -> str:
    """Headings on lines of their own, bullets at line starts only, lines healed two by two, known phrases."""
    s = T.safe_clean(d, s)
    for head in T.HEADINGS:
        s = d.sub(s, rf"{head}\s+", f"{head}\n")
    s = T.bullets(d, s)
    s = d.sub(d.sub(d.sub(s, "(?m)^(\\s*)\u2022", "\\1\x01"), "\u2022", " "), "\x01", "\u2022")
    s = d.sub(s, r"(Disinfection)\s+(Interpersonal Skills:)", "\\1\n\u2022 \\2")
    cur, nxt = T.rstrip(d, "ln"), T.lstrip(d, f"coalesce({d.at('al_', 'i + 1')}, '')")
    join = f"(i < {d.size('al_')} and {cur} <> '' and not {d.found(cur, '[.!?:;]\\z')} and not {d.found(nxt, '^\u2022 ')} and not {d.found(nxt, '^[A-Z][A-Z &]+$')} and not {T.one_of(d, T.strip(d, cur), T.HEADINGS)})"
    seed = {"out": d.strings(), "pair": "false", "both": d.lit("")}
    item = {"out": d.array(cur), "pair": join, "both": f"{cur} || ' ' || {nxt}"}
    body = (
        f"case when acc.pair then {d.struct(out='acc.out', pair='false', both=d.lit(''))}"
        f" when x.pair then {d.struct(out=d.concat('acc.out', d.array('x.both')), pair='true', both=d.lit(''))}"
        f" else {d.struct(out=d.concat('acc.out', 'x.out'), pair='false', both=d.lit(''))} end"
    )
    healed = f"({sweep(d, d.split(s), seed, item, body)}).out"
    return T.canonical_phrases(d, d.join(d.map(d.split(T.single_blank_lines(d, d.join(healed))), "ln", T.strip(d, "ln"))))


def validator_dates(d: Spark, lines: str) -> str:
    """Lines: a heading takes the first date range of the two lines after it; what stands between goes."""
    head = T.heading(d, "ln", "validator")
    ranged = lambda k: d.found(f"coalesce({d.at('al_', f'i + {k}')}, '')", S.DATE_RANGE)
    reach = f"case when not ({T.strip(d, 'ln')} <> '' and {head}) then 0 when {ranged(1)} then 1 when {ranged(2)} then 2 else 0 end"
    row = d.bind(reach, "re_", d.struct(k="cast(re_ as int)", row=f"case when re_ = 0 then ln else {T.strip(d, 'ln')} || ' \u2014 ' || {T.strip(d, f'coalesce({d.at("al_", "i + re_")}, {d.lit("")})')} end"))
    none = d.struct(k="cast(0 as int)", row=d.lit(""))
    seed = {"out": d.strings(), "hit": none}
    item = {"out": d.strings(), "hit": row}
    body = (
        f"case when acc.hit.k > 0 then {d.struct(out='acc.out', hit=d.struct(k='cast(acc.hit.k - 1 as int)', row=d.lit('')))}"
        f" else {d.struct(out=d.concat('acc.out', d.array('x.hit.row')), hit=d.struct(k='x.hit.k', row=d.lit('')))} end"
    )
    return f"({sweep(d, lines, seed, item, body)}).out"


def one_blank_after_headings(d: Spark, s: str) -> str:
    """Runs of blank lines right after a heading become one."""
    head = T.heading(d, "ln", "validator")
    seed = {"out": d.strings(), "state": "0", "is_head": "false"}
    item = {"out": d.array("ln"), "state": "0", "is_head": f"({T.strip(d, 'ln')} <> '' and {head})"}
    blank = f"{T.strip(d, d.at('x.out', '1'))} = ''"
    body = (
        f"case when acc.state = 2 and {blank} then acc when x.is_head then {d.struct(out=d.concat('acc.out', 'x.out'), state='1', is_head='false')}"
        f" when acc.state = 1 and {blank} then {d.struct(out=d.concat('acc.out', d.array(d.lit(''))), state='2', is_head='false')}"
        f" else {d.struct(out=d.concat('acc.out', 'x.out'), state='0', is_head='false')} end"
    )
    return d.join(f"({sweep(d, d.split(s), seed, item, body)}).out")
