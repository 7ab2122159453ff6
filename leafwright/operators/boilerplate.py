"""Removal of lines that repeat at the edges of a document's pages.

One plan for all policies, one scan and one shuffle: pages are dealt by document, and everything after that is a window
within a document. Each line carries how many pages have its key at an edge, whether the key is chosen, and what the
guards of its page and document say.
"""

from __future__ import annotations

from dataclasses import dataclass

from leafwright.dialect import Spark
from leafwright.functions import text as T


@dataclass(frozen=True)
class Policy:
    key: str = "strip"  # strip, or counter: without digits and case
    candidate: str = "len80"
    support: str = "floor"  # floor: max(2, int(.6 n)); ceil; share: c / n >= .6
    most: int = 0  # distinct keys, 0 for all
    by_frequency: bool = False
    edges_only: bool = False
    drops: str = ""  # lines that go anyway: bare_email, everywhere
    guard: str = ""  # document30, page25, document20
    final_break: bool = True  # whether a newline at the end makes a last, empty line


# What each of the published behaviours asks for.
POLICIES = {
    "a": Policy(final_break=False, drops="bare_email"),
    "c": Policy(candidate="no_section", guard="document30", final_break=False),
    "d": Policy(key="counter", candidate="plain80", most=8, guard="few_single", final_break=False),
    "e": Policy(edges_only=True),
    "f": Policy(candidate="len120", support="ceil"),
    "g": Policy(key="counter", candidate="edge", support="share", most=8, by_frequency=True, guard="document20"),
    "h": Policy(key="counter", candidate="edge", support="share", most=8, guard="page25"),
    "i": Policy(edges_only=True, drops="bare_email_many"),
}
SEEDED = r"(?i)^.*(?:cv maker|footer).*page\s*\p{Nd}+.*$"


def _candidate(d: Spark, kind: str) -> str:
    t = T.strip(d, "line")
    return {
        "len80": f"{t} <> '' and length({t}) <= 80",
        "len120": f"{t} <> '' and length({t}) <= 120",
        "no_section": f"{t} <> '' and not {d.found(t, r'(?i)^(?:OBJECTIVE|EDUCATION|EXPERIENCE|SKILLS|PROJECTS|CREDENTIALS)\b')}",
        "plain80": f"{t} <> '' and length(line) <= 80 and ({d.found('line', SEEDED)} or not {d.found('lower(line)', 'http|@|linkedin[.]com|github[.]com')})",
        "edge": T.edge_candidate(d, "line"),
    }[kind]


def _support(d: Spark, kind: str) -> str:
    v = d.double
    return {
        "floor": f"c >= greatest(2, cast(floor({v('0.6')} * n_pages) as bigint)) and n_pages > 1",
        "ceil": f"c >= greatest(2, cast(floor({v('0.6')} * n_pages + {v('0.9999')}) as bigint)) and n_pages > 1",
        "share": f"{v('c')} / n_pages >= {v('0.6')} and n_pages > 1",
    }[kind]


def _tables(d: Spark, p: Policy) -> str:
    key = T.strip(d, "line") if p.key == "strip" else T.counter_key(d, "line")
    lines = d.split("text")
    if not p.final_break:
        last = d.at(lines, d.size(lines))
        lines = f"case when {last} = '' then {d.part(lines, '1', d.size(lines) + ' - 1')} else {lines} end"
    if p.drops == "bare_email":
        lines = d.filter(f"({lines})", "fl", f"not {T.is_bare_email(d, 'fl')}")
    hint = "/*+ REPARTITION(doc_id) */" if d.name == "spark" else ""
    rank = "c desc, first_seen" if p.by_frequency else "first_seen"
    most = f"rn <= {p.most}" if p.most else "true"
    few = "single_share <= 0.2" if p.guard == "few_single" else "true"
    always = d.found("line", SEEDED) if p.guard == "few_single" else f"n_pages > 1 and {T.is_bare_email(d, 'line')}" if p.drops == "bare_email_many" else "false"
    where = "(nth < 5 or nth >= n - 5)" if p.edges_only else "length(line) <= 80" if p.guard == "few_single" else "true"
    if p.guard == "document20":
        where = f"{d.found('line', '^[^<>]*$')} and not fenced"
    fence = f"(sum(case when {d.found(T.strip(d, 'line'), '^```')} then 1 else 0 end) over (partition by doc_id, page_index order by nth) % 2 = 1)" if p.guard == "document20" else "false"
    return f"""
with dealt as (select {hint} doc_id, page_index, text from @pages),
counted as (select doc_id, page_index, text, count(*) over (partition by doc_id) as n_pages from dealt),
cut as (select doc_id, page_index, n_pages, {lines} as ls0 from counted),
split_ as (select doc_id, page_index, n_pages, case when {d.size('ls0')} = 0 then {d.array("''")} else ls0 end as ls from cut),
exploded as ({d.explode(f"doc_id, page_index, n_pages, {d.size('ls')} as n", 'ls', 'line', 'split_')}),
keyed as (
  select *, {key} as k, {fence} as fenced, page_index * 16 + case when nth < 5 then nth else 5 + nth - greatest(n - 5, 0) end as place,
         (nth < 5 or nth >= n - 5) and {_candidate(d, p.candidate)} as edge
  from exploded),
once as (select *, edge and row_number() over (partition by doc_id, k, page_index order by edge desc, nth) = 1 as fresh from keyed),
support as (
  select *, sum(case when fresh then 1 else 0 end) over (partition by doc_id, k) as c,
         min(case when fresh then place end) over (partition by doc_id, k) as first_seen
  from once),
shares as (
  select *, avg(case when fresh and place = first_seen then {d.double('case when c = 1 then 1 else 0 end')} end) over (partition by doc_id) as single_share
  from support),
fit as (select *, c > 0 and {_support(d, p.support)} and {few} as fits from shares),
ranked as (select *, case when fits then dense_rank() over (partition by doc_id, fits order by {rank}) end as rn from fit),
chosen as (select *, coalesce(fits and {most}, false) as chosen from ranked),
flagged as (
  select *, coalesce(max(case when chosen then rn end) over (partition by doc_id), 0) as n_keys, (chosen and {where}) or ({always}) as gone
  from chosen)"""


def removed(d: Spark, variant: str) -> str:
    """@pages (doc_id, page_index, text) -> doc_id, page_index, text, n_removed, n_lines, removed (the lines, stripped)."""
    p = POLICIES[variant]
    full = T.strip(d, "line")
    keep = {
        "document30": f"sum(case when gone and {full} <> '' then 1 else 0 end) over (partition by doc_id) > 0.3 * sum(case when {full} <> '' then 1 else 0 end) over (partition by doc_id)",
        "document20": "max(n_keys) over (partition by doc_id) > 2 and sum(case when gone then 1 else 0 end) over (partition by doc_id) > greatest(1, floor(0.2 * count(*) over (partition by doc_id)))",
        "page25": "sum(case when gone then 1 else 0 end) over (partition by doc_id, page_index) > 0.25 * count(*) over (partition by doc_id, page_index)",
        "few_single": "n_keys = 0 and regex_pages < 0.6 * n_pages and n_pages > 1 and sum(case when gone then 1 else 0 end) over (partition by doc_id, page_index) > 0.25 * count(*) over (partition by doc_id, page_index)",
    }.get(p.guard, "false")
    out = d.gathered("line", "nth", where="not (gone and not reverted)")
    out = T.strip(d, out) if variant == "a" else out
    known = "flagged"
    if p.guard == "few_single":
        seeded = f"{d.found('line', SEEDED)} and (nth < 5 or nth >= n - 5) and length(line) <= 80"
        by_page = f"(select *, max(case when {seeded} then 1 else 0 end) over (partition by doc_id, page_index) as seeded_page from flagged) sp"
        known = f"(select *, sum(case when nth = 0 then seeded_page else 0 end) over (partition by doc_id) as regex_pages from {by_page})"
    return f"""{_tables(d, p)},
guarded as (select *, {keep} as reverted from {known} known_)
select doc_id, page_index, {out} as text, cast(sum(case when gone and not reverted then 1 else 0 end) as bigint) as n_removed,
       count(*) as n_lines, {d.gathered(full, "nth", where="gone and not reverted")} as removed
from guarded group by doc_id, page_index"""


def detected(d: Spark, policy: str | Policy = "a") -> str:
    """@pages -> doc_id, key, support of the lines that the policy chooses."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    return f"{_tables(d, p)} select doc_id, k as key, cast(c as bigint) as support from chosen where chosen and fresh and place = first_seen"


#: The detector alone: policy a on all lines of the pages, e-mail addresses too.
DETECTOR = Policy(final_break=False)
