"""The N best items of every group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch, nonblank

BINS = 4096
#: Hash slots of items that a group's histogram counts; they bound its size, however many rows the group has.
SLOTS = 64
#: Floors that are broadcast, those of the largest groups: one small row each. The others are joined.
MAX_FLOORS = 100_000


def top_n_per_group(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int = 5, low: float = 0.0, high: float = 1.000001, slots: int = SLOTS, max_floors: int = MAX_FLOORS) -> DataFrame:
    """``groups``, ``item``, ``score``, ``rank``: the ``n`` best distinct items of each group.

    An item stands once per group with its highest usable score; usable is not null, not NaN and
    from ``low`` to ``high``. Equal scores: the smaller item first. Rows whose item is null or
    blank don't count; a null in a group column is a value like any other. Groups with fewer than
    ``n`` items give what they have, an empty table gives none. Other columns of ``df`` play no
    role, whatever their names.

    Every group gets a score histogram from one partial aggregation. It counts hash slots of
    items, each by the best score in it: different slots hold different items, so at least ``n``
    slots at or above a bin prove ``n`` items there, repeated rows or not. Rows below that floor are
    dropped, the rest is reduced to distinct items and ranked exactly, ties by item. Groups with
    fewer than ``n`` slots have no floor and keep all their rows. Up to ``max_floors`` floors are
    broadcast, so their rows fall before the shuffle. Beyond that the largest groups' floors are;
    the others, each at most the ``max_floors``-th part of all rows, get theirs by a join on the
    group, whose partitioning the ranking uses again.
    """
    g = [f"_g{i}" for i in range(len(groups))]
    step = (high - low) / BINS
    rows = (
        df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(groups, g)], F.col(f"`{item}`").cast("string").alias("_item"), F.col(f"`{score}`").cast("double").alias("_score"))
        .filter(nonblank(F.col("_item")) & F.col("_score").isNotNull() & ~F.isnan("_score") & F.col("_score").between(low, high))
        .withColumn("_score", F.col("_score") + F.lit(0.0))
        .withColumn("_bin", F.floor((F.col("_score") - low) / step).cast("smallint"))
    )
    slot = F.pmod(F.xxhash64("_item"), F.lit(slots)).cast("smallint").alias("_slot")
    best = rows.groupBy(*g, slot).agg(F.max("_bin").alias("_bin"), F.count(F.lit(1)).alias("_n"))
    histogram = best.groupBy(*g).agg(F.sort_array(F.collect_list("_bin"), asc=False).alias("_bins"), F.sum("_n").alias("_n"))
    floors, seen = Scratch(df.sparkSession, "topn").save(histogram.filter(F.size("_bins") >= n).select(*g, F.element_at("_bins", n).alias("_floor"), "_n"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_f{k}"]) for k in g], F.lit(True))

    def floored(some: DataFrame, known: DataFrame, how: str) -> DataFrame:
        known = known.select(*[F.col(k).alias(f"_f{k}") for k in g], "_floor")
        return some.join(known, same(some, known), how).filter(F.col("_floor").isNull() | (F.col("_bin") >= F.col("_floor"))).select(*g, "_item", "_score")

    def ranked(some: DataFrame) -> DataFrame:
        items = some.groupBy(*g, "_item").agg(F.max("_score").alias("_score"))
        order = Window.partitionBy(*g).orderBy(F.desc("_score"), F.asc("_item"))
        return items.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)

    if seen["rows"] <= max_floors:
        out = ranked(floored(rows, F.broadcast(floors), "left"))
    else:
        large = floors.orderBy(F.desc("_n"), *g).limit(max_floors)
        named = F.broadcast(large.select(*[F.col(k).alias(f"_f{k}") for k in g]))
        out = ranked(floored(rows, F.broadcast(large), "inner")).unionByName(ranked(floored(rows.join(named, same(rows, named), "left_anti"), floors, "left")))
    return out.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], F.col("_item").alias(item), F.col("_score").alias(score), F.col("_rank").cast("bigint").alias("rank"))
