"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, all others
as named users, and spans that tell which characters are learned from. Only DataFrame functions are used.

A rendered dialogue is cut into parts of `turns_per_part` messages, counted over the conversation in its order, so that no
cell and no task grows with the longest conversation. Messages are numbered by a sort of all rows by ranges: a message's
number is its place in its range, less where its conversation begins there, plus the conversation's messages in earlier
ranges. So null or equal turns, repeated rows and one conversation of any share of the rows spread like all others. Who
takes part is found by a pre-aggregated distinct over the whole conversation, so every part is rendered for every
participant; speakers meet parts by stretches of PART_STRETCH parts.

Result, one row per conversation, participant and part:
conv_id, perspective, part, n_messages, n_learned, rendered, mask_spans
where mask_spans lists the learned characters of `rendered` as "from-to" (0-based, end excluded), comma-separated.

Defined results: a null text is empty; a null role is the speaker `unknown`; a null conv_id is a conversation of its
own; null turns come after all numbered turns; equal turns are ordered by role, then text; repeated rows are rendered as
often as they occur; texts of any length are rendered whole; context roles (system) are rendered as such in every perspective,
are never learned from and have no perspective, so a conversation of context alone yields no row; the template's
markers inside a text or name are broken by a space; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.llm.runtime import partitions_for, stored

#: Parts of a conversation that meet its speakers in one task.
PART_STRETCH = 16


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    marker: str = "<|"
    broken: str = "< |"


def _escaped(text: Column, template: Template) -> Column:
    return F.replace(text, F.lit(template.marker), F.lit(template.broken))


def numbered(said: DataFrame) -> DataFrame:
    """said with number, from 0, of each message in its conversation, by turn, role and text."""
    order = ["conv_id", "turn", "role", "text"]
    dealt = said.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions_for(said), *order, "tie")
    placed = stored(dealt.sortWithinPartitions(*order).drop("tie").withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", 33)))
    found = placed.groupBy("range", "conv_id").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    shift = found.select(F.col("range").alias("r"), F.col("conv_id").alias("c"), (F.coalesce(before, F.lit(0)) - F.col("begin")).alias("shift"))
    both = placed.join(shift, (F.col("range") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return both.select(*order, (F.col("place") + F.col("shift")).alias("number"))


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), turns_per_part: int = 256, template: Template = Template()) -> DataFrame:
    """turns: conv_id, turn, role, text."""
    said = numbered(
        turns.select(
            "conv_id",
            F.coalesce("turn", F.lit((1 << 63) - 1)).cast("long").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
    ).withColumn("part", F.floor(F.col("number") / turns_per_part).cast("long"))
    speakers = said.where(~F.col("role").isin(*context_roles)).groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("said"))
    lengths = said.groupBy("conv_id").agg(F.max("part").alias("last")).withColumnRenamed("conv_id", "c")
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / PART_STRETCH)))
    speakers = speakers.join(lengths, F.col("conv_id").eqNullSafe(F.col("c"))).select(F.col("conv_id").alias("speaker_of"), F.col("role").alias("perspective"), stretches.alias("of_stretch"))
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("speaker_of")) & (F.floor(F.col("part") / PART_STRETCH) == F.col("of_stretch")))

    def head(m: Column) -> Column:
        other = F.concat(F.lit("user name="), _escaped(m["role"], template))
        who = F.when(m["role"] == F.col("perspective"), F.lit("assistant")).when(m["role"].isin(*context_roles), m["role"]).otherwise(other)
        return F.concat(F.lit(template.opening), who, F.lit("\n"))

    def piece(m: Column) -> Column:
        return F.struct(head(m).alias("head"), _escaped(m["text"], template).alias("body"), (m["role"] == F.col("perspective")).alias("learned"))

    closing = len(template.closing)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"]) + closing
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(p["learned"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return seen.withColumn("pieces", F.transform("messages", piece)).select(
        "conv_id",
        "perspective",
        "part",
        F.size("pieces").cast("long").alias("n_messages"),
        F.size(F.filter("pieces", lambda p: p["learned"])).cast("long").alias("n_learned"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(template.closing))), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", zero, step)["spans"], ",").alias("mask_spans"),
    )


#: The same in SQL, for the default arguments.
ROTATE_SQL = r"""
with named as (
  select conv_id, coalesce(turn, 9223372036854775807) turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations),
said as (
  select *, cast((row_number() over (partition by conv_id order by turn, role, text) - 1) // 256 as bigint) as part from named),
speakers as (select distinct conv_id c, role perspective from said where role <> 'system'),
pieces as (
  select conv_id, perspective, part, turn, role, text, role = perspective as learned,
         '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then role
           else 'user name=' || replace(role, '<|', '< |') end || chr(10) as head,
         replace(text, '<|', '< |') as body,
         row_number() over (partition by conv_id, perspective, part order by turn, role, text) as nth
  from said join speakers on conv_id is not distinct from c),
placed as (
  select *, sum(length(head) + length(body) + 11) over (partition by conv_id, perspective, part order by nth) as until from pieces)
select conv_id, perspective, part, count(*) as n_messages, cast(count(*) filter (where learned) as bigint) as n_learned,
       string_agg(head || body || '<|im_end|>' || chr(10), '' order by nth) as rendered,
       coalesce(string_agg(case when learned then (until - 11 - length(body))::bigint::varchar || '-' || until::bigint::varchar end, ',' order by nth), '') as mask_spans
from placed group by all
"""
