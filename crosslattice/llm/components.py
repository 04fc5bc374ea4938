"""Connected components: by random contraction, and by breadth-first frontiers from many seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch, lookup, nonblank


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _order(c: str, turn: int) -> F.Column:
    """A fresh hash order of the vertices for each round; the id itself settles equal hashes."""
    return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))


def contract(spark: SparkSession, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id``, ``root`` for every vertex of ``pairs`` (``u``, ``v``, longs): the same root means connected.

    Each round every vertex hooks to the smallest of itself and its neighbours in a fresh hash
    order; edges are relabelled and deduplicated, and the rounds' mappings are composed at the
    end, last to first. Expected rounds grow with the logarithm of the largest component.
    """
    edges, n = scratch.save(pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps = []
    turn = 0
    while n["rows"]:
        turn += 1
        near = _both_ways(edges).groupBy("u").agg(F.min(_order("v", turn)).alias("m"))
        here = _order("u", turn)
        hooks, m = scratch.save(near.select(F.col("u").alias("id"), F.when(here < F.col("m"), here).otherwise(F.col("m")).getField("id").alias("root")))
        maps.append((hooks, m["rows"]))
        a = lookup(edges.withColumnRenamed("u", "id"), hooks, "id", "inner", n["rows"]).select(F.col("root").alias("u"), F.col("v").alias("id"))
        if n["rows"] > 100_000:
            a = scratch.save(a)[0]
        b = lookup(a, hooks, "id", "inner", n["rows"]).select("u", F.col("root").alias("v")).filter("u <> v")
        fresh, n = scratch.save(b.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        scratch.drop(edges)
        edges = fresh
    if not maps:
        return spark.createDataFrame([], "id bigint, root bigint")
    # a root that vanished from the later graph had nothing left to hook to: it stays as it is
    whole, rows = maps.pop()
    while maps:
        earlier, rows = maps.pop()
        step = lookup(earlier.withColumnRenamed("root", "mid"), whole.select(F.col("id").alias("mid"), "root"), "mid", "left", rows)
        joined, _ = scratch.save(step.select("id", F.coalesce("root", "mid").alias("root")))
        scratch.drop(earlier, whole)
        whole = joined
    return whole


def frontier(spark: SparkSession, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id``, ``root`` for every vertex of ``pairs`` (``u``, ``v``, longs), by breadth-first search.

    The adjacency lists are hashed by vertex. Seeds are the vertices that precede all their
    neighbours in a hash order, so every component has one, and each vertex is a few steps from
    one. All seeds expand at once; a vertex takes the smallest label that reaches it first. Edges
    whose ends carry different labels make a smaller graph of colliding labels, which is solved the
    same way until no labels collide. Mappings are composed last to first.
    """
    edges, n = scratch.save(pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps = []
    turn = 0
    while n["rows"]:
        turn += 1
        lists, a = scratch.save(_both_ways(edges))
        near = lists.groupBy("u").agg(F.min(_order("v", turn)).alias("m"))
        labels, got = scratch.save(near.select(F.col("u").alias("id"), F.when(_order("u", turn) < F.col("m"), F.col("u")).alias("root"), F.lit(0).alias("step")), seeds=F.count("root"))
        step, missing = 0, got["rows"] - got["seeds"]
        while missing:
            step += 1
            front = labels.filter((F.col("root").isNotNull()) & (F.col("step") == step - 1)).select(F.col("id").alias("u"), "root")
            hits = lookup(lists, front, "u", "inner", a["rows"]).groupBy(F.col("v").alias("id")).agg(F.min("root").alias("hit"))
            after = labels.join(hits, "id", "left").select("id", F.coalesce("root", "hit").alias("root"), F.when(F.col("root").isNull() & F.col("hit").isNotNull(), step).otherwise(F.col("step")).alias("step"))
            fresh, got = scratch.save(after, missing=F.count_if(F.col("root").isNull()))
            scratch.drop(labels)
            labels, missing = fresh, got["missing"]
        hooks = labels.select("id", "root")
        maps.append((labels, got["rows"]))
        b = lookup(edges.withColumnRenamed("u", "id"), hooks, "id", "inner", n["rows"]).select(F.col("root").alias("u"), F.col("v").alias("id"))
        if n["rows"] > 100_000:
            b = scratch.save(b)[0]
        c = lookup(b, hooks, "id", "inner", n["rows"]).select("u", F.col("root").alias("v")).filter("u <> v")
        fresh, n = scratch.save(c.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        scratch.drop(edges, lists)
        edges = fresh
    if not maps:
        return spark.createDataFrame([], "id bigint, root bigint")
    whole, rows = maps.pop()
    whole = whole.select("id", "root")
    while maps:
        earlier, rows = maps.pop()
        step = lookup(earlier.select("id", F.col("root").alias("mid")), whole.select(F.col("id").alias("mid"), "root"), "mid", "left", rows)
        whole, _ = scratch.save(step.select("id", F.coalesce("root", "mid").alias("root")))
    return whole


def number(names: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``name``, ``id``: a long for every distinct name, fixed by writing the table."""
    t, n = scratch.save(names.select("name").distinct().withColumn("id", F.monotonically_increasing_id()))
    return t, n["rows"]


def consolidate(spark: SparkSession, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node_id``, ``group_id``: every record of the pairs with the smallest id of its group.

    Records linked directly or through others share a group. A null or blank side links nothing;
    its other side still is a record, alone if nothing else links it. Repeated, turned and self
    pairs change nothing. No pairs give no rows. Other columns play no role.
    """
    scratch = Scratch(spark, "groups")
    links, n = scratch.save(pairs.select(F.when(nonblank(F.col(f"`{a}`")), F.col(f"`{a}`")).alias("a"), F.when(nonblank(F.col(f"`{b}`")), F.col(f"`{b}`")).alias("b")).distinct())
    names, _ = number(links.select(F.col("a").alias("name")).union(links.select(F.col("b").alias("name"))).filter("name is not null"), scratch)
    ends = names.select(F.col("name").alias("a"), F.col("id").alias("u"))
    ids = lookup(links.filter("a is not null and b is not null and a <> b"), ends, "a", "inner", n["rows"]).select("u", "b")
    if n["rows"] > 100_000:
        ids = scratch.save(ids)[0]
    ids = lookup(ids, names.select(F.col("name").alias("b"), F.col("id").alias("v")), "b", "inner", n["rows"]).select("u", "v")
    roots = contract(spark, ids, scratch)
    placed, p = scratch.save(names.join(roots, "id", "left").select("name", F.coalesce("root", "id").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("name").alias("group_id"))
    return lookup(placed, smallest, "root", "inner", p["rows"]).select(F.col("name").alias("node_id"), "group_id")
