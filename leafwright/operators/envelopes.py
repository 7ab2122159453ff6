"""What the cleaners report beside their text: counts, lists and flags, one row per document.

Each page carries its counts through the chain, each taken on the text that its rule sees; one aggregation by document
follows. Lists are distinct, sorted and joined by newlines.
"""

from __future__ import annotations

from collections.abc import Callable

from leafwright.dialect import Spark
from leafwright.functions import scores, text as T
from leafwright.operators import boilerplate, heal, pipelines
from leafwright.operators.pipelines import Rule

#: A rule and the counts (name -> expression over the text before the rule).
Step = tuple[Rule, dict[str, Rule]]


def counted(d: Spark, source: str, carried: list[str], *steps: Step) -> str:
    """Like pipelines.chain, with the columns `carried` and every step's counts."""
    for n, (rule, counts) in enumerate(steps):
        made = [f"{f(d, 'text')} as {k}" for k, f in counts.items()]
        source = f"select {', '.join(['doc_id', 'page_index', *carried, *made])}, {rule(d, 'text')} as text from ({source}) k{n}"
        carried = [*carried, *counts]
    return source


def stripped(d: Spark, variant: str, source: str) -> str:
    """The removal of edge lines with what it removed, as sub-query."""
    body = boilerplate.removed(d, variant)
    return body.replace("@pages", "src_").replace("with dealt as", f"with src_ as ({source}), dealt as", 1)


def _total(column: str) -> str:
    return f"cast(sum({column}) as bigint) as {column}"


def _listed(d: Spark, column: str) -> str:
    """Distinct entries of newline-joined page lists."""
    every = d.split(d.gathered(column, "page_index", where=f"{column} <> ''"))
    return f"{d.join(d.sorted(d.unique(d.filter(every, 'le', d.lit('') + ' <> le'))))} as {column}"


def _same(d: Spark, s: str) -> str:
    return s


def _changed_lines(rule: Rule) -> Rule:
    return lambda d, s: d.size(d.filter(d.split(s), "ln", f"{rule(d, 'ln')} <> ln"))


def _merges(fold: Callable[[Spark, str], str]) -> Rule:
    return lambda d, s: f"cast(({fold(d, d.split(s))}).merges as bigint)"


def six_rules(d: Spark) -> str:
    """The six-rule cleaner: its text and the count of each of its edits."""
    canonical = lambda d, s: T.tidy_lines(d, d.nfc(T.unix_lines(d, s)))
    source = stripped(d, "d", pipelines.chain(d, "select doc_id, page_index, text from @pages", canonical))
    pages = counted(
        d, source, ["n_removed"],
        (lambda d, s: T.dehyphen(d, s, "ascii"), {"dehyphen_wrap": lambda d, s: d.count(s, r"[A-Za-z0-9]-\n[A-Za-z0-9]")}),
        (lambda d, s: T.glyphs(d, s, "extended"), {"quotes_ligatures": lambda d, s: T.occurrences(d, s, [*T.LIGATURES, *T.QUOTES, *T.EXTENDED])}),
        (lambda d, s: T.by_line(d, s, "ln", T.paren_short(d, "ln")), {"paren_close": _changed_lines(T.paren_short)}),
        (lambda d, s: d.join(f"({heal.capped(d, d.split(s))}).out"), {"heal_merge": _merges(heal.capped)}),
        (T.emails_unwrapped, {"email_url_fix": lambda d, s: d.count(s, r"(?i)\bhttps?://[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b")}),
    )
    counts = ", ".join(map(_total, ["email_url_fix", "dehyphen_wrap", "quotes_ligatures", "paren_close", "heal_merge"]))
    return f"select doc_id, count(*) as pages, cast(sum(n_removed) as bigint) as header_footer_remove, {counts}, {d.gathered('text', 'page_index', chr(12))} as text_nfc from ({pages}) sx group by doc_id"


def finished_v1(d: Spark) -> str:
    """The first finisher: text, audit lists and counts, sizes, and whether no rule did anything."""
    unix = lambda d, s: T.unix_lines(d, d.nfc(s))
    source = stripped(d, "f", pipelines.chain(d, "select doc_id, page_index, text from @pages", unix))
    artifacts = lambda d, s: d.join(d.map(d.filter(d.split(s), "ln", T.is_email_url(d, "ln")), "ln", T.strip(d, "ln")))
    short = [*T.QUOTES, *(k for k, v in T.LIGATURES.items() if v in ("fi", "fl"))]
    healed = lambda d, s: d.join(heal.spaced_headings(d, heal.conservative(d, d.split(s))))
    marks = lambda d, s: T.tidy_lines(d, T.bullets(d, T.glyphs(d, s, "short"), "finisher"))
    pages = counted(
        d, source, ["removed"],
        (T.without_email_urls, {"email_urls": artifacts}),
        (T.without_zero_width, {}),
        (T.dehyphen, {"hyphen_joins": lambda d, s: d.count(s, r"[\p{L}\p{N}_]-\n[\p{L}\p{N}_]")}),
        (marks, {"glyphs": lambda d, s: T.occurrences(d, s, short)}),
        (lambda d, s: T.by_line(d, s, "ln", T.paren_acronym(d, "ln")), {"parens": _changed_lines(T.paren_acronym)}),
        (healed, {}),
    )
    sums = ", ".join(map(_total, ["hyphen_joins", "glyphs", "parens"]))
    by = f"""select doc_id, {d.gathered('text', 'page_index', chr(12))} as text, {_listed(d, 'removed')}, {_listed(d, 'email_urls')}, {sums},
      {d.gathered(f'cast(length(text) as {d.text_type})', 'page_index', ',')} as per_page_chars from ({pages}) fv0 group by doc_id"""
    raw = f"select doc_id as raw_id, {d.gathered('text', 'page_index', chr(12))} as raw from (select * from @pages) fv1 group by doc_id"
    idle = "removed = '' and email_urls = '' and parens = 0 and hyphen_joins = 0 and glyphs = 0 and text = raw"
    return f"select doc_id, text, removed, email_urls, hyphen_joins, glyphs, parens, per_page_chars, length(text) as length_chars, {T.words(d, 'text')} as length_tokens, {idle} as no_op from ({by}) fv2 join ({raw}) fv3 on doc_id = raw_id"


def finished_spec(d: Spark) -> str:
    """The second finisher: text, removed lines and e-mail URLs, patched parentheses, merged rows."""
    tidy = lambda d, s: T.single_blank_lines(d, T.glyphs(d, T.dehyphen(d, T.without_zero_width(d, s)), "short"))
    source = stripped(d, "g", pipelines.chain(d, "select doc_id, page_index, text from @pages", T.collapsed))
    pages = counted(
        d, source, ["removed"],
        (T.email_tokens_dropped, {"email_urls": lambda d, s: d.join(d.all(s, r"(?i)\b(?:https?|ftp)://[^/\s]*@[^/\s]*[^\s]*"))}),
        (T.paren_brand, {"patched": lambda d, s: f"case when {T.paren_brand(d, s)} <> {s} then 1 else 0 end"}),
        (lambda d, s: d.join(f"({heal.label_rows(d, d.split(s))}).out"), {"column_merges": _merges(heal.label_rows)}),
        (tidy, {}),
    )
    return f"select doc_id, {d.gathered('text', 'page_index', chr(12))} as text, {_listed(d, 'removed')}, {_listed(d, 'email_urls')}, {_total('patched')}, {_total('column_merges')} from ({pages}) fs group by doc_id"


def canonical(d: Spark) -> str:
    """The canonical cleaner: text, flags and metrics."""
    nfc = lambda d, s: T.unix_lines(d, d.nfc(s))
    base = f"select doc_id, page_index, length(text) as raw_chars, {d.size(d.split(T.unix_lines(d, 'text')))} as raw_lines, text from @pages"
    tidy = counted(d, base, ["raw_chars", "raw_lines"], (nfc, {}), (T.tidy_lines, {"ws_changes": _changed_lines(lambda d, ln: T.collapsed(d, T.rstrip(d, ln)))}))
    raw = f"select doc_id as raw_id, cast(sum(raw_chars) + count(*) - 1 as bigint) as raw_len, cast(sum(raw_lines) as bigint) as raw_total, {_total('ws_changes')} from ({tidy}) cn0 group by doc_id"
    source = stripped(d, "h", f"select doc_id, page_index, text from ({tidy}) cn1")
    marked = lambda d, s: T.glyphs(d, T.bullets(d, s, "finisher"), "no_ff")
    ligatures = [k for k, v in T.LIGATURES.items() if v != "ff"] + list(T.QUOTES)
    pages = counted(
        d, source, ["n_removed", "n_lines"],
        (T.dehyphen, {"joins": lambda d, s: d.count(s, r"[\p{L}\p{N}_]-\n[\p{L}\p{N}_]")}),
        (lambda d, s: T.single_blank_lines(d, heal.by_newline(d, s, "numbered")), {"healed": lambda d, s: heal.by_newline(d, s, "numbered", count=True)}),
        (T.emails_canonical, {"emails": lambda d, s: d.count(s, r"(?i)\b(?:https?|ftp)://[^/\s]*@")}),
        (lambda d, s: T.by_line(d, s, "ln", T.paren_one_extra(d, "ln")), {"parens": _changed_lines(T.paren_one_extra)}),
        (marked, {"ligatures": lambda d, s: T.occurrences(d, s, ligatures)}),
        (T.placeholders, {"placeholders": lambda d, s: f"case when {T.placeholders(d, s)} <> {d.sub(s, '[ ]{2,}', ' ')} then 1 else 0 end"}),
    )
    names = ["n_removed", "n_lines", "joins", "healed", "emails", "parens", "ligatures", "placeholders"]
    by = f"select doc_id, count(*) as pages, {', '.join(map(_total, names))}, {d.gathered('text', 'page_index', chr(12))} as text from ({pages}) cn2 group by doc_id"
    share = lambda a, b: d.round_even(f"100 * {d.double(a)} / greatest(1, {b})", 1)
    return f"""select doc_id, pages, text, n_removed > 0 as headers_removed, emails > 0 as email_url_fixed, parens as paren_balanced_lines, joins as dehyphenated_joins,
      ligatures > 0 as ligatures_replaced, placeholders as placeholder_pages, ws_changes, {share('n_removed', 'n_lines')} as pct_lines_removed, {share('healed', 'raw_total')} as pct_lines_healed,
      {share('length(text)', 'raw_len')} as length_ratio, {scores.readability(d, 'text', 'canonical')} as readability
      from ({by}) cn3 join ({raw}) cn4 on doc_id = raw_id"""


def page_cleaner(d: Spark) -> str:
    """The page cleaner: text, what it removed, doubled headings, sizes, whether hyphens may have been healed."""
    artifacts = lambda d, s: d.join(d.map(d.filter(d.split(s), "ln", T.is_email_url(d, "ln")), "ln", T.strip(d, "ln")))
    wraps = lambda d, s: heal.by_newline(d, T.dehyphen(d, T.without_soft_hyphens(d, s)))
    headings = lambda d, s: T.by_line(d, d.join(f"({heal.deduped_headings(d, d.split(s))}).out"), "ln", T.strip(d, T.collapsed(d, "ln")))
    source = stripped(d, "c", "select doc_id, page_index, text from @pages")
    pages = counted(
        d, source, ["removed"],
        (T.without_email_urls, {"email_urls": artifacts, "hyphens": lambda d, s: f"case when {d.found(s, '\u00ad|-\\n')} then 1 else 0 end"}),
        (lambda d, s: d.nfc(T.glyphs(d, s)), {}),
        (wraps, {}),
        (lambda d, s: T.by_line(d, s, "ln", T.paren_cloud(d, "ln")), {}),
        (headings, {"doubled": lambda d, s: f"cast(({heal.deduped_headings(d, d.split(s))}).gone as bigint)"}),
    )
    return f"""select doc_id, {d.gathered('text', 'page_index', chr(12))} as text, {_listed(d, 'removed')}, {_listed(d, 'email_urls')}, {_total('doubled')},
      cast(sum(length(text)) + count(*) - 1 as bigint) as chars, cast(sum({d.size(d.split('text'))}) as bigint) as lines, max(hyphens) > 0 as healed_hyphens from ({pages}) pc group by doc_id"""


def validation(d: Spark) -> str:
    """The validator: text of both passes, three scores in percent, flags."""
    text = pipelines.documents(d, f"select doc_id, page_index, text from ({pipelines.validated_twice(d)}) va0")
    raw = pipelines.documents(d, pipelines.chain(d, "select doc_id, page_index, text from @pages", T.base_clean))
    percent = lambda e: f"cast(greatest(0, least(100, {d.round_even(f'100 * ({e})')})) as bigint)"
    scored = f"""select n.doc_id, n.text, {percent(scores.readability(d, 'n.text', 'validator'))} as readability_pct, {scores.readability(d, 'n.text', 'validator')} as readability,
      {percent(scores.jaccard(d, 'r.text', 'n.text'))} as vocab_overlap_pct, r.text as raw from ({text}) n join ({raw}) r on n.doc_id = r.doc_id"""
    flags = [("readability < 0.9", "readability_below_target"), ("vocab_overlap_pct < 97", "vocab_overlap_below_97"), (f"{T.opens(d, 'text')} <> {T.closes(d, 'text')}", "unmatched_parentheses"), (d.found("text", r"(?m)[|]\s*$"), "hanging_pipe")]
    flagged = d.join(d.filter(d.array(*(f"case when {c} then '{n}' end" for c, n in sorted(flags, key=lambda x: x[1]))), "fl", "fl is not null"), ",")
    return f"select doc_id, text, readability_pct, vocab_overlap_pct, {flagged} as flags, raw from ({scored}) va1"


def content_match(d: Spark, source: str) -> str:
    """doc_id, text, raw (a sub-query) -> doc_id, content_match_pct: 100 less the word error rate over lower-case words."""
    match = f"100 * (1 - ({scores.word_error_rate(d, 'a', 'b')}))"
    return f"select doc_id, cast(greatest(0, least(100, {d.round_even(match)})) as bigint) as content_match_pct from (select doc_id, {scores.tokens(d, 'raw')} as a, {scores.tokens(d, 'text')} as b from ({source}) cm0) cm1"
