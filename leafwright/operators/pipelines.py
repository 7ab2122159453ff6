"""Whole cleaners: chains of page rules around one removal of repeated edge lines.

Each takes and returns @pages (doc_id, page_index, text). Between the steps of a chain a page stays one row; the removal
is the only step that shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from leafwright.dialect import Spark
from leafwright.functions import recognition as R
from leafwright.functions import scores, text as T
from leafwright.operators import boilerplate, heal, resume, structure

Rule = Callable[[Spark, str], str]


def chain(d: Spark, source: str, *rules: Rule) -> str:
    """Applies page rules one after the other, each as a projection."""
    for n, rule in enumerate(rules):
        source = f"select doc_id, page_index, {rule(d, 'text')} as text from ({source}) c{n}"
    return source


def stripped(d: Spark, variant: str, source: str) -> str:
    """The removal applied to a sub-query."""
    body = boilerplate.removed(d, variant)
    return body.replace("@pages", "src_").replace("with dealt as", f"with src_ as ({source}), dealt as", 1)


def _lines(f: Rule) -> Rule:
    return lambda d, s: d.join(f(d, d.split(s)))


def _each(f: Rule) -> Rule:
    return lambda d, s: T.by_line(d, s, "ln", f(d, "ln"))


def _double_bullets(d: Spark, s: str) -> str:
    return d.sub(s, "(?m)^•\\s*•\\s*", "• ")


#: Page rules after the removal of edge lines.
PAGE_RULES: tuple[Rule, ...] = (
    T.safe_clean, T.merged_hanging, T.bullets, T.joined_orphans, T.blanked_bad_urls, T.without_bare_emails,
    _lines(heal.wrapped), T.one_blank_per_run, heal.tail_headings_cut, T.label_colons, T.single_blank_lines, _double_bullets, T.strip,
)


def postproc(d: Spark, fix_typos: bool = False) -> str:
    """The flagship: edge lines, page rules, phrases."""
    rules = (*PAGE_RULES, *((T.typos,) if fix_typos else ()), T.blanked_bad_urls, T.strip, T.canonical_phrases)
    return chain(d, stripped(d, "a", "select doc_id, page_index, text from @pages"), *rules)


def exact(d: Spark) -> str:
    return chain(d, "select doc_id, page_index, text from @pages", T.safe_clean)


def polished(d: Spark) -> str:
    """postproc with a blank line before known headings; pages that end up empty go."""
    def spaced(d: Spark, s: str) -> str:
        known = T.one_of(d, f"upper({T.strip(d, 'ln')})", T.HEADINGS)
        return T.strip(d, T.single_blank_lines(d, T.by_line(d, s, "ln", f"case when {known} then {d.lit(chr(10))} || {T.strip(d, 'ln')} else {T.strip(d, 'ln')} end")))

    return f"select * from ({chain(d, stripped(d, 'a', 'select doc_id, page_index, text from @pages'), *PAGE_RULES, spaced, T.canonical_phrases)}) z where text <> ''"


def six_rules_b(d: Spark) -> str:
    """Canonical lines, edge lines (policy d), wraps, quotes, short parentheses, capped healing, e-mail URLs."""
    canonical = lambda d, s: T.tidy_lines(d, d.nfc(T.unix_lines(d, s)))
    dehyphen = lambda d, s: T.dehyphen(d, T.without_soft_hyphens(d, s), "ascii")
    extended = lambda d, s: T.glyphs(d, s, "extended")
    healed = lambda d, s: d.join(f"({heal.capped(d, d.split(s))}).out")
    return chain(d, stripped(d, "d", chain(d, "select doc_id, page_index, text from @pages", canonical)), dehyphen, extended, _each(T.paren_short), healed, T.emails_unwrapped)


def finish_v1(d: Spark) -> str:
    """Edge lines (policy f), e-mail URL lines, wraps, glyphs and bullets, acronym parentheses, healing, headings."""
    def dehyphen(d: Spark, s: str) -> str:
        return T.dehyphen(d, T.without_zero_width(d, s))

    def marks(d: Spark, s: str) -> str:
        return T.tidy_lines(d, T.bullets(d, T.glyphs(d, s, "short"), "finisher"))

    return chain(d, stripped(d, "f", chain(d, "select doc_id, page_index, text from @pages", lambda d, s: T.unix_lines(d, d.nfc(s)))), T.without_email_urls, dehyphen, marks, _each(T.paren_acronym), _lines(heal.conservative), _lines(heal.spaced_headings))


def finish_spec(d: Spark) -> str:
    """Edge lines (policy g), e-mail URL tokens, brand parentheses, label rows, tidy."""
    def tidy(d: Spark, s: str) -> str:
        return T.single_blank_lines(d, T.glyphs(d, T.dehyphen(d, T.without_zero_width(d, s)), "short"))

    rows = lambda d, s: d.join(f"({heal.label_rows(d, d.split(s))}).out")
    return chain(d, stripped(d, "g", chain(d, "select doc_id, page_index, text from @pages", T.collapsed)), T.email_tokens_dropped, T.paren_brand, rows, tidy)


def canonical(d: Spark) -> str:
    """Tidy lines, edge lines (policy h), wraps, newline healing, e-mail URLs, parentheses, bullets, placeholders."""
    def healed(d: Spark, s: str) -> str:
        return T.single_blank_lines(d, heal.by_newline(d, s, "numbered"))

    def marks(d: Spark, s: str) -> str:
        return T.glyphs(d, T.bullets(d, s, "finisher"), "no_ff")

    tidy = lambda d, s: T.tidy_lines(d, T.unix_lines(d, d.nfc(s)))
    return chain(d, stripped(d, "h", chain(d, "select doc_id, page_index, text from @pages", tidy)), T.dehyphen, healed, T.emails_canonical, _each(T.paren_one_extra), marks, T.placeholders)


def cleaned(d: Spark) -> str:
    """Edge lines (policy c), e-mail URL lines, glyphs, wraps, cloud parentheses, doubled headings."""
    def wraps(d: Spark, s: str) -> str:
        return heal.by_newline(d, T.dehyphen(d, T.without_soft_hyphens(d, s)))

    def headings(d: Spark, s: str) -> str:
        return T.by_line(d, d.join(f"({heal.deduped_headings(d, d.split(s))}).out"), "ln", T.strip(d, T.collapsed(d, "ln")))

    return chain(d, stripped(d, "c", "select doc_id, page_index, text from @pages"), T.without_email_urls, lambda d, s: d.nfc(T.glyphs(d, s)), wraps, _each(T.paren_cloud), headings)


GENERAL_RULES: tuple[Rule, ...] = (
    lambda d, s: T.glyphs(d, T.without_soft_hyphens(d, d.nfc(T.unix_lines(d, s)))), T.email_wrappers_dropped, lambda d, s: T.dehyphen(d, s, "chained"),
    lambda d, s: T.bullets(d, T.tidy_lines(d, s), "general"), _lines(heal.pairwise), T.single_blank_lines, T.strip,
)


def general(d: Spark) -> str:
    """The page-local general cleaner: glyphs, e-mail wrappers, wraps, bullets, pairwise healing."""
    return chain(d, "select doc_id, page_index, text from @pages", *GENERAL_RULES)


def fused(d: Spark) -> str:
    """@first and @second (doc_id, page_index, text, confidences), two recognitions of pages -> the one that is kept, cleaned.
    A page that only one has is taken from there; a second one without text never wins."""
    clean = {t: chain(d, f"select doc_id, page_index, text from @{t}", *GENERAL_RULES) for t in ("first", "second")}
    side = lambda t: f"select c.doc_id, c.page_index, c.text, {R.mean(d, 'o.confidences')} / 100 as mean, o.text <> '' as has from ({clean[t]}) c join @{t} o on c.doc_id = o.doc_id and c.page_index = o.page_index"
    both = f"""select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.page_index, b.page_index) as page_index, a.doc_id is not null as has_a, b.doc_id is not null and (b.has or a.doc_id is null) as has_b,
      coalesce(a.text, '') as ta, coalesce(b.text, '') as tb, coalesce(a.mean, 0) as ma, coalesce(b.mean, 0) as mb from ({side('first')}) a full outer join ({side('second')}) b on a.doc_id = b.doc_id and a.page_index = b.page_index"""
    scored = f"select *, {scores.set_distance(d, 'xa', 'xb')} as dist, {scores.clarity(d, 'ta')} as ca, {scores.clarity(d, 'tb')} as cb from (select *, {scores.trigrams(d, 'ta')} as xa, {scores.trigrams(d, 'tb')} as xb from ({both}) fu0) fu1"
    choice = R.fusion_choice("ma", "mb", "dist", "length(ta)", "length(tb)", "ca", "cb", "has_a", "has_b", d)
    return f"select doc_id, page_index, choice, case when choice = 'b' then tb else ta end as text, case when choice = 'b' then mb else ma end as mean from (select *, {choice} as choice from ({scored}) fu2) fu3"


def _validated(d: Spark, source: str) -> str:
    bulleted = lambda d, s: T.bullets(d, s, "resume")
    lines = lambda d, s: T.by_line(d, s, "ln", T.pipes_before_url(d, T.collapsed(d, T.strip(d, "ln"))))
    spaced = lambda d, s: T.single_blank_lines(d, resume.one_blank_after_headings(d, s))
    return chain(d, stripped(d, "i", source), bulleted, _each(T.paren_at_end), T.cities, _lines(resume.validator_dates), lines, spaced)


def validated(d: Spark) -> str:
    """Base cleaning, edge lines (policy i), bullets, parentheses, cities, headings with their dates, blanks and pipes."""
    return _validated(d, chain(d, "select doc_id, page_index, text from @pages", T.base_clean))


def validated_twice(d: Spark) -> str:
    """validated, and its rules once more on the result: the fix-point that a second pass settles."""
    return f"with once_ as ({validated(d)}) {_validated(d, 'select doc_id, page_index, text from once_')}"


def fixed_resume(d: Spark) -> str:
    """Collapsed lines, edge lines (policy e), bullets, parentheses, education sentences, cities, links in the contact
    block, headings in one case, brands and degrees; with n_links and warnings of the links."""
    lines = lambda d, s: T.by_line(d, s, "ln", T.collapsed(d, T.strip(d, "ln")))
    bulleted = lambda d, s: T.bullets(d, s, "resume")
    joined = lambda d, s: d.join(f"({resume.education_sentences(d, d.split(s))}).out")
    body = chain(d, stripped(d, "e", chain(d, "select doc_id, page_index, text from @pages", lines)), bulleted, T.without_bare_emails, _each(T.paren_known_token), joined, T.cities)
    cased = d.sub(resume.heading_case(d, "text"), r"\n{3,}", "\n")
    return f"select doc_id, page_index, {cased} as text, n_links, warnings from ({resume.lifted(d).replace('@pages', f'({body}) fr0')}) fr1"


def laid_out(d: Spark) -> str:
    """Commas and pipes, parentheses, city names, blank lines; then sections with education folded, dates beside their
    headings and skills formatted."""
    cities = lambda d, s: d.sub(T.cities(d, s, T.LAYOUT_CITIES, keep_case=True), "([A-Za-z]),([A-Za-z])", r"\1, \2")
    collapsed = lambda d, s: T.by_line(d, d.nfc(T.unix_lines(d, s)), "ln", T.collapsed(d, T.strip(d, "ln")))
    cleaned = chain(d, "select doc_id, page_index, text from @pages", collapsed, _each(T.spaced_commas_and_pipes), _each(T.paren_unguarded), cities, T.single_blank_lines, structure.header_spacing, _lines(resume.role_dates))
    return resume.laid_out(d, cleaned)


def resume_v1(d: Spark) -> str:
    """The flagship followed by education and skills on one line each and punctuation, with counts."""
    return resume.normalized_resume(d).replace("@pages", f"({postproc(d)}) rv0")


def resume_text(d: Spark) -> str:
    return chain(d, "select doc_id, page_index, text from @pages", resume.cleaned_text)


POLICY_COUNTS = ("lines_in", "urls_removed", "labels_normalized", "bullets_normalized", "wraps_healed", "headers_detected", "blanks_collapsed")


def by_policy(d: Spark, list_casing: str = "title", symbol: str = "\u2022", spacious: bool = True) -> str:
    """A document under a policy, with its counts: glyphs, e-mail lines, pipes, labels and one phone label; wrapped lines
    healed unless a line ends a sentence; headings with blank lines around; the coursework list in one case."""
    dropped = lambda d, s: d.size(d.filter(d.split(s), "ln", T.is_bare_email(d, "ln")))
    tidy = lambda d, s: T.by_line(d, T.unified_phone(d, T.by_line(d, s, "ln", T.labels(d, d.sub("ln", r"\s*\|\s*", " | ")))), "ln", T.collapsed(d, T.rstrip(d, "ln")))
    bullet = lambda e: d.found(e, f"^\\s*[{symbol}] ")
    ended = lambda e: d.found(e, r"[.!?:;]\z")
    join = f"({d.size('acc.out')} > 0 and {d.at('x.out', '1')} <> '' and not {ended(d.at('acc.out', d.size('acc.out')))} and not {bullet(d.at('x.out', '1'))} and not {T.heading(d, d.at('x.out', '1'), 'document')})"
    merged = f"{T.rstrip(d, d.at('acc.out', d.size('acc.out')))} || ' ' || {T.lstrip(d, d.at('x.out', '1'))}"
    step = (
        f"case when {join} then {d.struct(out=d.concat(d.part('acc.out', '1', d.size('acc.out') + ' - 1'), d.array(merged)), n=f'acc.n + case when {bullet(d.at("acc.out", d.size("acc.out")))} then 1 else 0 end')}"
        f" else {d.struct(out=d.concat('acc.out', 'x.out'), n='acc.n')} end"
    )
    healed = lambda d, s: resume.sweep(d, d.split(s), {"out": d.strings(), "n": "0"}, {"out": d.array("ln"), "n": "0"}, step)
    head = T.heading(d, "ln", "document")
    heads = lambda d, s: d.size(d.filter(d.split(s), "ln", head))
    seed, item = {"out": d.strings(), "head": "false"}, {"out": d.array(f"case when {head} then {T.strip(d, 'ln')} else {T.rstrip(d, 'ln')} end"), "head": head}
    before = f"{d.size('acc.out')} > 0 and coalesce({d.at('acc.out', d.size('acc.out'))}, '') <> ''"
    blank, last = d.array("''"), d.array("''") if spacious else d.strings()
    spread = f"case when x.head then {d.struct(out=d.concat('acc.out', f'case when {before} then {blank} else {d.strings()} end', 'x.out', last), head='false')} else {d.struct(out=d.concat('acc.out', 'x.out'), head='false')} end"
    spaced = lambda d, s: d.join(f"({resume.sweep(d, d.split(s), seed, item, spread)}).out")
    line = r"(?i)^(Relevant Coursework)\s*:\s*(.+)$"
    items = d.filter(d.map(d.split(d.first("ln", line, 2), ","), "it", T.strip(d, "it")), "it", "it <> ''")
    case = T.title_item(d, "it") if list_casing == "title" else f"case when {T.is_upper(d, 'it')} then {d.upper('substring(it, 1, 1)')} || lower(substring(it, 2)) else it end"
    cased = lambda d, s: T.by_line(d, s, "ln", f"case when {d.found('ln', line)} then {d.first('ln', line, 1)} || ': ' || {d.join(d.map(items, 'it', case), ', ')} else ln end")
    cased = cased if list_casing in ("title", "sentence") else (lambda d, s: s)
    fewer = lambda d, s: T.strip(d, d.sub(s, r"\n{3,}", "\n\n" if spacious else "\n"))
    counts = {
        "lines_in": lambda d, s: d.size(d.split(s)),
        "urls_removed": dropped,
        "labels_normalized": lambda d, s: d.size(d.filter(d.split(T.without_bare_emails(d, s)), "ln", d.found("ln", r"(?i)^\s*(?:mobile|phone)\s*:"))),
    }
    marks = lambda d, s: f"case when {d.found(s, '(?m)^\\s*[-*\u2022\u00b7\u2014]\\s+')} then 1 else 0 end"
    heal_ = lambda d, s: d.bind(healed(d, s), "he_", d.join("he_.out"))
    merges = lambda d, s: d.bind(healed(d, s), "he_", "cast(he_.n as bigint)")
    steps = [
        (T.without_bare_emails, counts), (tidy, {}), (heal_, {"bullets_normalized": marks, "wraps_healed": merges}), (spaced, {"headers_detected": heads}),
        (cased, {}), (fewer, {"blanks_collapsed": lambda d, s: f"case when {d.found(s, '\\n{3,}')} then 1 else 0 end"}),
    ]
    from leafwright.operators import envelopes

    pages = envelopes.counted(d, chain(d, "select doc_id, page_index, text from @pages", T.base_clean), [], *steps)
    return f"select doc_id, page_index, text, {', '.join(POLICY_COUNTS)}, {d.size(d.split('text'))} as lines_out from ({pages}) bp"


def documents(d: Spark, pages: str) -> str:
    """Pages back to one text per document, form feeds between them."""
    return f"select doc_id, {d.gathered('text', 'page_index', chr(12))} as text from ({pages}) dp group by doc_id"
