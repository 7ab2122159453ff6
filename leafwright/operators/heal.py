"""Paragraph healing: folds over the lines of a page."""

from __future__ import annotations

from leafwright.dialect import SPACE, Spark
from leafwright.functions import text as T


def _fold(d: Spark, lines: str, join: str, joined: str, alone: str = "cur_", drop: str = "false") -> str:
    """lines -> lines. join, joined, alone and drop see `prev_`, the last line made, and `cur_`."""
    start = d.map(lines, "ln", d.array(d.bind("ln", "cur_", alone)))
    put = d.concat(d.part("acc", "1", d.size("acc") + " - 1"), d.array(joined))
    body = f"case when {drop} then acc when {join} then {put} else {d.concat('acc', d.array('cur_'))} end"
    body = d.bind(d.at("acc", d.size("acc")), "prev_", d.bind(d.at("x", "1"), "cur_", body))
    return d.fold(start, "acc", "x", body)


def wrapped(d: Spark, lines: str) -> str:
    """A line goes on with the next one if it ends with a comma, if the next one begins in lower case, or if it is a
    single word that the next line, no bullet or heading, may belong to."""
    single = f"({d.found('pr_', rf'^{SPACE}*\p{{L}}[^\s\p{{Z}}]*\z')} and not {d.found('cl_', '^[-\u2022]')} and not {T.heading(d, 'cl_', 'document')})"
    join = (
        f"(pr_ <> '' and cl_ <> '' and not {d.found('cl_', '^\u2022')} and not {d.found('pr_', r'[.!?:]\z')} and not {T.is_upper(d, 'pr_')}"
        f" and ({d.found('pr_', r',\z')} or {d.found('cl_', r'^\p{Ll}')} or {single}))"
    )
    join = d.bind(T.rstrip(d, "prev_"), "pr_", d.bind(T.lstrip(d, "cur_"), "cl_", join))
    return _fold(d, lines, join, f"{T.rstrip(d, 'prev_')} || ' ' || {T.lstrip(d, 'cur_')}", T.strip(d, "cur_"))


def conservative(d: Spark, lines: str) -> str:
    """Joins lines that begin in lower case or with punctuation, never bullets, headings or after a full stop."""
    bullet = "^[ \\t]*[-*\u2022][ \\t]+"
    join = (
        f"(prev_ <> '' and cur_ <> '' and not {d.found('cur_', bullet)} and not {T.heading(d, 'cur_', 'finisher')} and not {T.heading(d, 'prev_', 'finisher')}"
        f" and not {d.found(T.rstrip(d, 'prev_'), r'[.!?:;]\z')} and {d.found(T.lstrip(d, 'cur_'), r'^[\p{Ll},.;:)\]}]')})"
    )
    return _fold(d, lines, join, f"{T.rstrip(d, 'prev_')} || ' ' || {T.lstrip(d, 'cur_')}")


def capped(d: Spark, lines: str, most: int = 30, longest: int = 2000) -> str:
    """A struct of lines and merges: like conservative, but for digits too, at most `most` merges a page; a merge that
    makes a line too long is taken back yet counted; a repeated upper-case line goes."""
    start = d.map(lines, "ln", d.struct(out=d.array("ln"), merges="0"))
    prev, cur = d.at("acc.out", d.size("acc.out")), d.at("x.out", "1")
    same = f"({T.is_upper(d, cur)} and {T.strip(d, prev)} = {T.strip(d, cur)})"
    t = T.strip(d, cur)
    join = f"(acc.merges < {most} and not {d.found(prev, r'[.;:!?)]\s*\z')} and not {d.found(cur, '^\\s*[*\u2022-]\\s*')} and ({t} = '' or {d.found(t, '^[a-z0-9]')}))"
    merged = f"{T.rstrip(d, prev)} || ' ' || {T.lstrip(d, cur)}"
    kept = d.concat("acc.out", d.array(cur))
    out = f"case when length({merged}) > {longest} then {kept} else {d.concat(d.part('acc.out', '1', d.size('acc.out') + ' - 1'), d.array(merged))} end"
    body = f"case when {same} then acc when {join} then {d.struct(out=out, merges='acc.merges + 1')} else {d.struct(out=kept, merges='acc.merges')} end"
    return d.fold(start, "acc", "x", body)


def pairwise(d: Spark, lines: str) -> str:
    """Two lines at a time: a plain line takes the next one unless it ends a sentence or the next is blank, a bullet, a
    number or a heading; runs of blanks keep two."""
    after = d.enumerate("al_", "ln", "i", d.struct(out=d.array("ln"), nxt=f"coalesce({d.at('al_', 'i + 1')}, '')", last=f"i >= {d.size('al_')}", skip="false"))
    seed = d.array(d.struct(out=d.strings(), nxt="''", last="false", skip="false"))
    mark = "^\\s*(?:[-*\u2022\u25cf\u25aa]\\s+|\\p{Nd}+[.)]\\s+)"
    cur = d.at("x.out", "1")
    size = d.size("acc.out")
    blank = f"{T.strip(d, cur)} = ''"
    full = f"({size} >= 2 and {d.at('acc.out', size)} = '' and {d.at('acc.out', f'greatest({size} - 1, 1)')} = '')"
    join = f"(not x.last and not {d.found(cur, mark)} and not {d.found(cur, r'[.:;?!]\z')} and {T.strip(d, 'x.nxt')} <> '' and not {d.found('x.nxt', mark)} and not {T.heading(d, 'x.nxt', 'general')})"

    def state(out: str, skip: str) -> str:
        return d.struct(out=out, nxt="''", last="false", skip=skip)

    body = (
        f"case when acc.skip then {state('acc.out', 'false')} when {blank} and {full} then {state('acc.out', 'false')}"
        f" when {blank} then {state(d.concat('acc.out', d.array("''")), 'false')}"
        f" when {join} then {state(d.concat('acc.out', d.array(f"{T.rstrip(d, cur)} || ' ' || {T.lstrip(d, 'x.nxt')}")), 'true')}"
        f" else {state(d.concat('acc.out', d.array(cur)), 'false')} end"
    )
    fold = d.fold(d.concat(seed, after), "acc", "x", body)
    # the array of lines is needed by name inside the lambda
    holder = d.map(d.array(lines), "al_", f"({fold}).out")
    return d.at(holder, "1")


#: What a newline may stand before, over any number of blank lines, and stay: a bullet; for `numbered` also a numbered line
#: and an upper-case line that closes the page.
MARKS = {"plain": "\\s*\\n\\s*[-*\u2022]", "numbered": "\\s*\\n\\s*(?:[-*\u2022]|\\p{Nd}+[.])|\\s*\\n\\s*[A-Z][A-Z ]{2,}\\n?\\z"}


def by_newline(d: Spark, s: str, marks: str = "plain", count: bool = False) -> str:
    """Every newline that follows no full stop and precedes no mark becomes a blank, or how many do. The text is cut into
    words, single blanks, and runs of blanks with the mark after them."""
    tokens = d.all(s, rf"{MARKS[marks]}|\S+|\s")
    kept = f"i > 1 and {d.found(d.at('tk_', 'greatest(i - 1, 1)'), r'[.!?:]\z')}"
    if count:
        return d.bind(tokens, "tk_", d.size(d.filter(d.enumerate("tk_", "tk", "i", f"case when tk = {d.lit(chr(10))} and not ({kept}) then 1 end"), "tk", "tk is not null")))
    whole = d.sub("tk", r"^(\s*\n\s*[A-Z][A-Z ]{2,})\n\z", r"\1 ")  # the newline after a closing line is no mark
    parts = d.enumerate("tk_", "tk", "i", f"case when tk = {d.lit(chr(10))} then (case when {kept} then tk else ' ' end) else {whole} end")
    return d.bind(tokens, "tk_", d.join(parts, ""))


def deduped_headings(d: Spark, lines: str) -> str:
    """Of two adjacent section headings the second goes; a struct of lines and how many went."""
    head = lambda e: T.heading(d, e, "cleaner")
    start = d.map(lines, "ln", d.struct(out=d.array("ln"), gone="0", single="true"))
    prev, cur = d.at("acc.out", d.size("acc.out")), d.at("x.out", "1")
    again = f"(acc.single and {head(prev)} and {head(cur)})"
    body = f"case when {again} then {d.struct(out='acc.out', gone='acc.gone + 1', single='false')} else {d.struct(out=d.concat('acc.out', d.array(cur)), gone='acc.gone', single='true')} end"
    return d.fold(start, "acc", "x", body)


def spaced_headings(d: Spark, lines: str) -> str:
    """A blank line before each heading, and after it unless one follows."""
    head = T.heading(d, "ln", "finisher")
    follows = T.strip(d, d.at("al_", f"least(i + 1, {d.size('al_')})"))
    after = f"case when i < {d.size('al_')} and {follows} <> '' then '' end"
    parts = d.enumerate("al_", "ln", "i", f"case when {head} then {d.array(T.strip(d, 'ln'), after)} else {d.array(T.rstrip(d, 'ln'), 'null')} end")
    kept = d.filter(f"flatten({parts})", "ln", "ln is not null")
    made = d.at(d.map(d.array(lines), "al_", kept), "1")
    start = d.map(made, "ln", d.array("ln"))
    prev, cur = d.at("acc", d.size("acc")), d.at("x", "1")
    body = f"case when {T.heading(d, cur, 'finisher')} and {prev} <> '' then {d.concat('acc', d.array("''", cur))} else {d.concat('acc', 'x')} end"
    return d.fold(start, "acc", "x", body)


def label_rows(d: Spark, lines: str) -> str:
    """A label row takes up to four rows after it that are labels or begin with a capital, a digit or a star; a struct
    of lines and merges. Marks and hyphens in merged rows become the delimiter."""
    start = d.map(lines, "ln", d.struct(out=d.array("ln"), merges="0", run="0"))
    prev, cur = d.at("acc.out", d.size("acc.out")), T.strip(d, d.at("x.out", "1"))
    fits = f"({cur} <> '' and not {T.heading(d, cur, 'spec')} and ({T.is_label(d, cur)} or {d.found(cur, '^[A-Z0-9*]')}))"
    join = f"({T.is_label(d, prev)} and acc.run < 4 and length({prev}) <= 2000 and {fits})"
    merged = d.sub(d.sub(f"{T.rstrip(d, prev)} || ' ' || {cur}", "\\s*[\u2022-]\\s*", " | "), r"\s*\|\s*", " | ")
    kept = d.concat("acc.out", d.array(d.sub(T.rstrip(d, d.at("x.out", "1")), r"\s*\|\s*\z", " | ")))
    body = f"case when {join} then {d.struct(out=d.concat(d.part('acc.out', '1', d.size('acc.out') + ' - 1'), d.array(merged)), merges='acc.merges + 1', run='acc.run + 1')} else {d.struct(out=kept, merges='acc.merges', run='0')} end"
    return d.fold(start, "acc", "x", body)


def tail_headings_cut(d: Spark, s: str) -> str:
    """Three headings or more at the end of a page go, and blank lines before them."""
    known = "|".join(T.HEADINGS)
    return d.sub(d.sub(s, rf"(?i)(?:(?:\n|^)\s*(?:{known})[ \t]*){{3,}}\z", ""), r"\s+\z", "")
