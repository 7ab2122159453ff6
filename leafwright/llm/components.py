"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregation (with map-side combining) and one equi-join by vertex; no vertex's neighbours are
gathered. The table of links never grows, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.runtime import dropped, looked_up, stored


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """links (a, b), a > b. large: hang each vertex's larger neighbours on its smallest one; small: its smaller ones
    and itself. A vertex with very many links is met by broadcast (runtime.looked_up), so none fills a task."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("v"), F.least("v", "m").alias("m"), "n"))
    out = looked_up(both, ["a"], least, ["v"], "n", total, ["b"])
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
    made = stored(out.where("a > b").distinct())
    dropped(least)
    return made


def _settled(links: DataFrame) -> bool:
    """Whether each vertex hangs on one vertex that hangs on none."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("b").alias("v"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("x"))
    by = ends.select("x.*").groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by.where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: pairs (a, b) of longs, in any order. Result: (id, component) of every vertex that is not the smallest of
    its component; component is the smallest. The result is a stored table."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = now.count()  # it never grows
    while not _settled(now):
        hung = _star(now, True, 2 * total)
        before, now = now, _star(hung, False, total)
        dropped(before, hung)
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out.stored_at = now.stored_at
    return out
