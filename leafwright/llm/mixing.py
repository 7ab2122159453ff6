"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are counted in words. `source_targets` shares the size of the whole corpus among the sources. A source with
target T and size S copies each of its documents T/S times: the whole part for certain, the fraction by rounding.

The fractions are rounded by the pivotal method in its weighted form: two documents with probabilities p, q and sizes
v, w trade mass (p up by d/v, q down by d/w, or the reverse, with odds that keep both means) until one is 0 or 1. The
words of a pair stay exactly the same in each trade. Documents are dealt by hash into leaves of bounded size; a leaf
works through its documents in the order of size and leaves one fractional document; those residuals meet in a tree
of bounded fan-in until each source has one, which an unbiased draw settles. What a source then misses of its target
is less than one document; `settle` trades it away with documents near that size, a few per power of two. That last step
is deterministic: it moves a handful of documents a source, whose chances are then no longer exactly their fractions.

All draws come from hashes of (seed, doc_id), so reruns and other partitionings agree.

Defined results: a null text has size 0 and is taken 0 words; the null source is a source and sorts last; repeated
rows count as documents; null doc_ids are documents like others and come back as null; a source of size 0 takes nothing;
a text of any length is one document of that many words; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.llm.runtime import dropped, stored

WORD = r"[^\x20\x09-\x0D]+"

#: doc is doc_id, or 0 with unnamed = true: pandas would turn longs beside a null into floats.
NODE = "source string, leaf long, home long, doc long, nth int, size long, p double"
LEAF = "source string, leaf long, doc long, unnamed boolean, nth int, size long, rate double, copies long, p double"


def word_count(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh 1, 2, 3, 1, ...; no target is above `most`
    times its source's size, and what that cuts off is shared among the others by weight.

    One row per source; the ranking over them is the only step in one partition."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(nth) - 1) % len(weights) + 1).cast("int")).cast("long")
    # the cut sources are those with the smallest cap/weight: find how many by running sums over that order
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = (
        by.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", F.sum("source_size").over(everything) - F.col("capped_before"))
        .withColumn("fits", F.col("cap") * F.col("weight_left") >= F.col("weight") * F.col("left"))
        # the first source that fits under its cap sets the level for itself and all after it
        .withColumn("level", F.first(F.when(F.col("fits"), F.struct("left", "weight_left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.weight_left")
    return w.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def _draw(seed: int, ids: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each row, from a hash."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def pivot(p: list[float], size: list[int], draw: list[float]) -> int:
    """Rounds p in place until at most one is fractional; returns its place, or -1."""
    open_, eps = -1, 1e-12
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        j, v, w = open_, size[open_], size[i]
        up = min((1 - p[j]) * v, p[i] * w)  # words that can move to j
        down = min(p[j] * v, (1 - p[i]) * w)
        move = up if draw[i] * (up + down) < down else -down
        p[j] += move / v
        p[i] -= move / w
        rest = -1
        for k in (j, i):
            if p[k] <= 1e-9:
                p[k] = 0.0
            elif p[k] >= 1 - 1e-9:
                p[k] = 1.0
            else:
                rest = k
        open_ = rest
    return open_


def _node(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rounds the residuals that meet in one node; the root's own residual is drawn."""

    def node(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "home"], ascending=[False, True], kind="stable", ignore_index=True)
        draw = _draw(seed, rows["doc"].to_numpy(), rows["home"].to_numpy())
        p = rows["p"].tolist()
        rest = pivot(p, rows["size"].tolist(), draw.tolist())
        if last and rest >= 0:
            p[rest] = float(draw[rest] < p[rest])
        rows["p"] = p
        return rows[["source", "leaf", "home", "doc", "nth", "size", "p"]]

    return node


def mix(docs: DataFrame, seed: int = 20_240, leaf_rows: int = 4_000, fan_in: int = 64, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, source, target, copies and taken of every row of docs."""
    sized = stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count("text").alias("size")))
    targets = source_targets(sized, most=most)
    per_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    plan = targets.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("rows") / leaf_rows).cast("long").alias("leaves")
    )
    plan = stored(plan)
    rated = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "source",
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), "leaves").alias("leaf"),
        F.coalesce("doc_id", F.lit(0)).alias("doc"),
        F.col("doc_id").isNull().alias("unnamed"),
        "size",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"),
    )

    def leaf(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "unnamed", "doc"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rows["nth"] = np.arange(len(rows), dtype=np.int32)
        whole = np.floor(rows["rate"].to_numpy())
        p = np.where(rows["size"] > 0, rows["rate"] - whole, 0.0).tolist()
        rest = pivot(p, rows["size"].tolist(), _draw(seed, rows["doc"].to_numpy(), rows["nth"].to_numpy()).tolist())
        rows["copies"] = (whole + np.array([0 if i == rest else x for i, x in enumerate(p)])).astype(np.int64)
        rows["p"] = np.nan
        if rest >= 0:
            rows.loc[rest, "p"] = p[rest]
        return rows[["source", "leaf", "doc", "unnamed", "nth", "size", "rate", "copies", "p"]]

    leaves = stored(rated.groupBy("source", "leaf").applyInPandas(leaf, LEAF))
    nodes = leaves.where("p is not null and not isnan(p)").select("source", "leaf", F.col("leaf").alias("home"), "doc", "nth", "size", "p")
    decided = None
    height, written = 0, [sized]
    most_leaves = plan.agg(F.max("leaves")).first()[0] or 1
    while True:
        last = most_leaves <= fan_in ** (height + 1)
        nodes = nodes.withColumn("leaf", F.floor(F.col("leaf") / fan_in).cast("long"))
        out = stored(nodes.groupBy("source", "leaf").applyInPandas(_node(seed + 1 + height, last), NODE))
        written.append(out)
        done = out.where("p in (0.0, 1.0)")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        nodes, height = out.where("p not in (0.0, 1.0)"), height + 1
    settled = decided.select(F.col("source").alias("s"), "home", F.col("nth").alias("n"), F.col("p").cast("long").alias("extra"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("leaf") == F.col("home")) & (F.col("nth") == F.col("n"))
    taken = leaves.join(settled, same, "left").select("source", "doc", "unnamed", "leaf", "nth", "size", "rate", (F.col("copies") + F.coalesce("extra", F.lit(0))).alias("copies"))
    taken = stored(settle(taken, plan, most, seed))
    dropped(leaves, *written)
    out = taken.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return out.select(F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "size", "source_size", "source", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def settle(taken: DataFrame, plan: DataFrame, most: int, seed: int, offered: int = 4) -> DataFrame:
    """Trades a source's remaining gap away. Each source offers, for each power of two, a few documents that may take a
    copy more and a few that may take a copy less; from the largest down, those that narrow the gap are used."""
    up = F.col("copies") < F.least(F.ceil("rate"), F.lit(most))
    down = F.col("copies") > F.floor("rate")
    binned = taken.where((F.col("size") > 0) & (up | down)).select("source", "leaf", "nth", "size", F.floor(F.log2("size")).cast("int").alias("bin"), F.when(up, 1).otherwise(-1).alias("way"), F.xxhash64("doc", "nth", F.lit(seed)).alias("h"))
    nth = F.row_number().over(Window.partitionBy("source", "bin", "way").orderBy("h", "leaf", "nth"))  # a partial limit comes before the shuffle
    few = binned.withColumn("offer", nth).where(F.col("offer") <= offered)
    offers = few.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "way", "leaf", "nth")), asc=False).alias("offers"))
    gaps = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("has")).withColumnRenamed("source", "s")
    start = F.struct((F.col("target") - F.col("has")).alias("gap"), F.array().cast("array<struct<size:bigint,way:int,leaf:bigint,nth:int>>").alias("used"))

    def step(state: Column, o: Column) -> Column:
        after = state["gap"] - o["size"] * o["way"]
        use = F.abs(after) < F.abs(state["gap"])
        return F.struct(F.when(use, after).otherwise(state["gap"]).alias("gap"), F.when(use, F.array_append(state["used"], o)).otherwise(state["used"]).alias("used"))

    changes = (
        offers.join(plan, F.col("source").eqNullSafe(F.col("of")))
        .join(gaps, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("cs"), F.explode(F.aggregate("offers", start, step)["used"]).alias("u"))
        .select("cs", F.col("u.leaf").alias("cl"), F.col("u.nth").alias("cn"), F.col("u.way").alias("way"))
    )
    same = F.col("source").eqNullSafe(F.col("cs")) & (F.col("leaf") == F.col("cl")) & (F.col("nth") == F.col("cn"))
    return taken.join(changes, same, "left").withColumn("copies", F.col("copies") + F.coalesce("way", F.lit(0))).drop("cs", "cl", "cn", "way")
