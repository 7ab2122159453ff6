"""Removal of repeated runs of lines, by a suffix array over line identifiers.

The non-blank lines of all documents are sequences of identifiers. Their suffixes are sorted by prefix doubling: ranks at
depth 1 are the order of the identifiers; the rank at depth a + b of a suffix is the order of the pair (its rank at depth
a, the rank at depth b of the suffix a lines further on). A suffix whose prefix occurs once is settled and leaves the
table, so each round holds repeated text only, and rounds go on until no suffix is open: as many as the longest repeated
run has doublings. Pairs are counted with map-side combining before they are sorted, so a line or run with any share of
the rows is one row in the sort.

Suffixes of one rank at depth d are those of one interval of the suffix array in which neighbours share a prefix of d
lines or more. Each interval has a home, its first occurrence by (doc_id, line). A suffix that is not the home of its
deepest interval begins a later copy. `common_prefixes` then finds how many lines it shares with that home: from the
deepest rank down, the prefix grows by the depth of each level whose ranks agree there. These prefixes are the maximal
repeated runs; what they cover is removed, the first occurrence stays.

With `alone`, a line of so many words or more counts as a run by itself: the intervals of depth 1 remove its later
copies. A line's first occurrence is never removed.

Only DataFrame functions are used. Lines are compared by two 64-bit hashes.

Defined results: null and empty texts have no lines; blank lines (only spaces) are no part of any run, and only those
between two lines of one removed run go with it; rows that repeat a doc_id and its text count as one document; a run
never crosses documents; an empty table gives an empty table; other columns are kept by `line_dedup` and may have any
names, but one that is named like a result (n_lines, n_removed, n_runs) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.llm.runtime import dropped, looked_up, partitions_for, stored

_LAST = (1 << 63) - 1
PLACE = ["doc", "tie", "line"]


def text_lines(text: Column | str = "text") -> Column:
    """The non-blank lines of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def _identity() -> list[Column]:
    """doc and tie: a document is known by its doc_id (null as the largest) and its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("tie")]


def _named(rows: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    """doc, tie, line, rank, home of each row whose pair (a, b) occurs more than once. Ranks number the pairs in their
    order: one row per distinct pair is sorted, by ranges. home is the pair's first place."""
    often = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("home")).where("n > 1")
    ranks = stored(often.orderBy(a, b).select(F.col(a).alias("ra"), F.col(b).alias("rb"), F.monotonically_increasing_id().alias("rank"), "home", "n"))
    total = ranks.agg(F.sum("n").alias("n")).first().n or 0
    found = looked_up(rows.select(*PLACE, a, b, *more), [a, b], ranks, ["ra", "rb"], "n", total, PLACE)
    out = stored(found.select(*PLACE, "rank", "home", *more))
    dropped(ranks)
    return out


def _line_ranks(docs: DataFrame, alone: int | None = None) -> DataFrame:
    """The ranks of depth 1; with `alone`, long: whether the line has so many words."""
    lines = docs.select(*_identity(), text_lines().alias("lines")).where("size(lines) > 0")
    parts = {"h": lambda x: F.xxhash64(x), "g": lambda x: F.xxhash64(F.lit(1), x)}
    if alone is not None:
        parts["long"] = lambda x: (F.length(x) >= 2 * alone - 1) & (F.size(F.split(F.trim(x), r"\s+")) >= alone)
    keys = lines.select("doc", "tie", F.posexplode(F.transform("lines", lambda x: F.struct(*(f(x).alias(c) for c, f in parts.items())))).alias("line", "key"))
    keys = keys.select("doc", "tie", "line", "key.*")
    keys = keys.dropDuplicates(PLACE) if _repeats_ids(docs) else keys
    return _named(keys, "h", "g", *list(parts)[2:])


def _repeats_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _deeper(ranks: DataFrame, further: int) -> DataFrame:
    """Ranks at the depth of `ranks` plus `further`, which is at most that depth."""
    there = Window.partitionBy("doc", "tie").orderBy("line").rangeBetween(further, further)
    pairs = ranks.select(*PLACE, "rank").withColumn("next", F.first("rank").over(there)).where("next is not null")
    return _named(pairs, "rank", "next")


def suffix_ranks(docs: DataFrame, min_run: int, alone: int | None = None) -> dict[int, DataFrame]:
    """By depth, the ranks of all suffixes whose first so many lines occur more than once: 1, doublings up to min_run,
    and doublings of that until no suffix is open."""
    levels = {1: _line_ranks(docs, alone)}
    depth = 1
    while depth < min_run or not levels[depth].isEmpty():
        further = min(depth, min_run - depth) if depth < min_run else depth
        levels[depth + further] = _deeper(levels[depth], further)
        depth += further
    return levels


def later_copies(levels: dict[int, DataFrame], min_run: int) -> DataFrame:
    """doc, tie, line, depth and home, (doc, tie, line) of the first occurrence: each run of suffixes whose deepest
    interval has an earlier home, by the suffix that the run begins with. A suffix that follows another one into the
    same copy is part of that one's run."""
    each = None
    for depth, ranks in levels.items():
        if depth >= min_run:
            rows = ranks.where(F.col("home") < F.struct(*PLACE)).select(*PLACE, F.struct(F.lit(depth).alias("depth"), "home").alias("at"))
            each = rows if each is None else each.unionByName(rows)
    deepest = each.groupBy(*PLACE).agg(F.max_by("at", "at.depth").alias("at")).select(*PLACE, "at.*")
    w = Window.partitionBy("doc", "tie").orderBy("line")
    now = F.struct("line", "depth", F.col("home.doc").alias("hd"), F.col("home.tie").alias("ht"), F.col("home.line").alias("hl"))
    before = F.struct((F.col("line") - 1).alias("line"), "depth", F.col("home.doc").alias("hd"), F.col("home.tie").alias("ht"), (F.col("home.line") - 1).alias("hl"))
    return deepest.withColumn("goes_on", F.coalesce(F.lag(now).over(w) == before, F.lit(False))).where("not goes_on").drop("goes_on")


def common_prefixes(copies: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """copies with `shared`, the number of lines that each has in common with its home."""
    now = stored(copies.select(*PLACE, "home", "depth", F.col("depth").alias("shared")))
    before = now
    for nth, depth in enumerate(sorted(levels, reverse=True)):
        ranks = levels[depth].select("doc", "tie", "line", "rank")
        grows = F.col("depth") > depth
        for x, home in (("m", ""), ("t", "home.")):
            there = ranks.select(*(F.col(c).alias(f"{x}_{c}") for c in ranks.columns))
            line = F.col(f"{x}_line") == F.col(f"{home}line") + F.col("shared")
            now = now.join(there, grows & (F.col(f"{x}_doc") == F.col(f"{home}doc")) & (F.col(f"{x}_tie") == F.col(f"{home}tie")) & line, "left")
        more = F.when(F.col("m_rank") == F.col("t_rank"), depth).otherwise(0)
        now = now.select(*PLACE, "home", "depth", (F.col("shared") + more).alias("shared"))
        if nth % 3 == 2:
            now = stored(now)
            dropped(before)
            before = now
    out = stored(now)
    dropped(before)
    return out


def repeated_runs(docs: DataFrame, min_run: int = 2, alone: int | None = None) -> DataFrame:
    """doc, tie, first, until: the maximal runs of lines that are later copies."""
    levels = suffix_ranks(docs, min_run, alone)
    shared = common_prefixes(later_copies(levels, min_run), levels)
    later = shared.select(*PLACE, (F.col("line") + F.col("shared")).alias("end"))
    if alone is not None:
        later = later.unionByName(levels[1].where("long").where(F.col("home") < F.struct(*PLACE)).select(*PLACE, (F.col("line") + 1).cast("long").alias("end")))
    w = Window.partitionBy("doc", "tie").orderBy("line", "end")
    begins = F.coalesce(F.col("line") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = later.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = stored(islands.groupBy("doc", "tie", "island").agg(F.min("line").alias("first"), F.max("end").cast("int").alias("until")).drop("island"))
    dropped(shared, *levels.values())
    return out


def line_dedup(docs: DataFrame, min_run: int = 2, alone: int | None = None) -> DataFrame:
    """docs with later copies of runs of `min_run` lines or more, and of lines of `alone` words or more, removed from
    text, and n_lines, n_removed, n_runs."""
    runs = repeated_runs(docs, min_run, alone).groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("first", "until"))).alias("runs"))
    runs = runs.select(F.col("doc").alias("of_doc"), F.col("tie").alias("of_tie"), "runs")
    # a row travels as one struct, so that no name of its columns can meet ours
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "n_runs")]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *_identity()).repartition(partitions_for(docs), "doc", "tie")
    both = keyed.join(runs, (F.col("doc") == F.col("of_doc")) & (F.col("tie") == F.col("of_tie")), "left")
    both = both.withColumn("all_lines", F.coalesce(F.split("row.text", "\n"), F.array().cast("array<string>")))
    at = F.filter(F.transform("all_lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())  # of the non-blank lines
    both = both.withColumn("at", at)
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: F.get("at", r["until"] - 1) + 1))
    ends = F.concat(F.transform("runs", lambda r: F.get("at", r["first"])), F.array(F.size("all_lines")))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice("all_lines", a + 1, b - a)))
    gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["until"] - r["first"]), F.lit(0))
    left = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return both.select(
        *((left if c == "text" else F.col("row").getField(c)).alias(c) for c in names),
        F.size("at").cast("long").alias("n_lines"),
        gone.cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
    )


#: What is removed, in SQL, for min_run = 2.
LINE_SQL = r"""
with docs as (
  select doc_id, text, coalesce(string_split(text, chr(10)), []) as lines from documents),
every as (select doc_id, unnest(range(len(lines))) as place, unnest(lines) as line from docs),
l as (
  select doc_id, place, line, row_number() over (partition by doc_id order by place) - 1 as pos from every where trim(line) <> ''),
w as (select doc_id, pos, line, lead(line) over (partition by doc_id order by pos) as line2 from l),
later as (
  select doc_id, pos from w where line2 is not null
  qualify row_number() over (partition by line, line2 order by doc_id, pos) > 1),
gone as (select distinct doc_id, pos from (select doc_id, pos from later union all select doc_id, pos + 1 from later)),
flagged as (
  select l.*, g.pos is not null as removed from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos),
runs as (
  select *, removed and not coalesce(lag(removed) over (partition by doc_id order by pos), false) as begins from flagged),
placed as (
  select e.doc_id, e.place, e.line, r.pos, r.removed, r.begins,
         last_value(r.removed ignore nulls) over (partition by e.doc_id order by e.place rows between unbounded preceding and current row) as above,
         first_value(r.removed ignore nulls) over (partition by e.doc_id order by e.place rows between current row and unbounded following) as below
  from every e left join runs r on e.doc_id = r.doc_id and e.place = r.place),
per as (
  select doc_id, count(pos) as n_lines, count(*) filter (where removed) as n_removed, count(*) filter (where begins) as n_runs,
         string_agg(line, chr(10) order by place) filter (where not coalesce(above and below, false)) as kept
  from placed group by doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_runs, 0) as bigint) as n_runs,
       sha256(case when coalesce(n_removed, 0) = 0 then coalesce(d.text, '') else coalesce(kept, '') end) as kept_sha256
from docs d left join per on d.doc_id = per.doc_id
"""
