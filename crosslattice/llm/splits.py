"""Train, validation and test splits that keep connected records together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslattice.llm.components import frontier, number
from crosslattice.runtime import Scratch, lookup, nonblank

BUCKETS = 4096


def record_groups(spark: SparkSession, records: DataFrame, id: str, sides: Sequence[str]) -> DataFrame:
    """``id``, ``group_id``: each record with the smallest id among those that share an entity, directly or through others.

    ``sides`` are the columns that name entities; a null or blank one connects nothing. A record
    without any stands alone. Repeated ids are one record that has all their entities; rows with a
    null id don't count. An empty table gives no rows.
    """
    scratch = Scratch(spark, "splits")
    rows, n = scratch.save(records.filter(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").alias("rec"), *[F.when(nonblank(F.col(f"`{s}`")), F.col(f"`{s}`")).alias(f"s{i}") for i, s in enumerate(sides)]))
    names, _ = number(rows.select(F.explode(F.array(*[f"s{i}" for i in range(len(sides))])).alias("name")).filter("name is not null"), scratch)
    coded = rows
    for i in range(len(sides)):
        coded = lookup(coded, names.select(F.col("name").alias(f"s{i}"), F.col("id").alias(f"e{i}")), f"s{i}", "left", n["rows"])
        if n["rows"] > 100_000:
            coded = scratch.save(coded)[0]
    ends = F.array_compact(F.array(*[f"e{i}" for i in range(len(sides))]))
    held, h = scratch.save(coded.select("rec", ends.alias("ends")))
    links = held.filter(F.size("ends") > 1).select(F.get("ends", F.lit(0)).alias("u"), F.explode(F.slice("ends", 2, len(sides))).alias("v"))
    # repeated ids tie their entities together, too
    firsts = held.filter(F.size("ends") > 0).groupBy("rec").agg(F.min(F.get("ends", F.lit(0))).alias("u"), F.max(F.get("ends", F.lit(0))).alias("v")).filter("u <> v")
    more = firsts.select("rec", "u").join(held.filter(F.size("ends") > 0), "rec").select("u", F.get("ends", F.lit(0)).alias("v"))
    roots = frontier(spark, links.unionByName(more).filter("u <> v").distinct(), scratch)
    first = held.groupBy("rec").agg(F.min(F.get("ends", F.lit(0))).alias("id"))
    placed, p = scratch.save(lookup(first, roots, "id", "left", h["rows"]).select("rec", F.coalesce("root", "id").alias("root")))
    smallest = placed.filter("root is not null").groupBy("root").agg(F.min("rec").alias("group_id"))
    out = lookup(placed, smallest, "root", "left", p["rows"])
    return out.select(F.col("rec").alias(id), F.coalesce("group_id", "rec").alias("group_id"))


def grouped_split(spark: SparkSession, records: DataFrame, id: str, sides: Sequence[str], shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """``id``, ``group_id``, ``split``: whole groups dealt to the splits in hash order.

    Groups are put in the order of a seeded hash of their id, and the line of records is cut at
    the shares: a group goes to the split in which its middle record falls. So proportions hold as
    nearly as the group sizes allow. The running count goes over at most 4,096 hash buckets, then
    within each bucket: no task sees all groups.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    scratch = Scratch(spark, "splits")
    rows, n = scratch.save(record_groups(spark, records, id, sides))
    h = F.xxhash64(F.lit(seed), "group_id")
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 52))
    before = sizes.groupBy("bucket").agg(F.sum("n").alias("bn")).withColumn("before", F.sum("bn").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bn")).select("bucket", "before")
    run = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0))
    middle = (F.col("before") + run - F.col("n") / 2) / F.lit(max(1, n["rows"]))
    cut, pick = 0.0, None
    for name, share in shares.items():
        cut += share
        pick = F.when(F.col("_at") < cut, name) if pick is None else pick.when(F.col("_at") < cut, name)
    dealt = sizes.join(F.broadcast(before), "bucket").withColumn("_at", middle).select("group_id", pick.otherwise(name).alias("split"))
    return lookup(rows, dealt, "group_id", "inner", n["rows"]).select(id, "group_id", "split")
