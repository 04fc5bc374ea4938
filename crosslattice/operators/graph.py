"""Graph operators over ``nodes`` and ``edges``."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.operators.hierarchy import MAX_LOCAL, _split, _trees, all_descendants, node_states
from crosslattice.runtime import Scratch, tasks


def _known(nodes: DataFrame) -> DataFrame:
    return nodes.select("tax", "node_id").filter("node_id is not null").distinct()


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("tax", "child_id", "parent_id").filter("child_id is not null and parent_id is not null").distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that declare no parent; one with absent parents only is no root."""
    return _known(nodes).join(_links(edges).select("tax", F.col("child_id").alias("node_id")).distinct(), ["tax", "node_id"], "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``tax``, ``node_id``, ``parent_id``: declared parents that are no nodes of the taxonomy."""
    own = _known(nodes)
    links = _links(edges).join(own.select("tax", F.col("node_id").alias("child_id")), ["tax", "child_id"], "left_semi")
    return links.join(own.select("tax", F.col("node_id").alias("parent_id")), ["tax", "parent_id"], "left_anti").select("tax", F.col("child_id").alias("node_id"), "parent_id")


def ancestors(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """``tax``, ``node_id``, ``ancestor_id``: strict ancestors, absent parents included, the node itself left out."""
    pairs = all_descendants(spark, nodes, edges, max_local).select("tax", F.col("descendant_id").alias("node_id"), F.col("node_id").alias("ancestor_id"))
    gone = dangling(nodes, edges)
    above = pairs.join(gone.select("tax", F.col("node_id").alias("ancestor_id"), "parent_id"), ["tax", "ancestor_id"]).select("tax", "node_id", F.col("parent_id").alias("ancestor_id"))
    own = gone.select("tax", "node_id", F.col("parent_id").alias("ancestor_id"))
    return pairs.unionByName(above).unionByName(own).filter("node_id <> ancestor_id").distinct()


def reachable(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """Nodes that a chain of parents leads from a root to, roots included."""
    return node_states(spark, nodes, edges, max_local).filter("reached").select("tax", "node_id")


def orphans(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no chain of parents leads from a root to."""
    return node_states(spark, nodes, edges).filter("not reached").select("tax", "node_id")


def depths(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest way from a node without known parents; null in and under loops."""
    return node_states(spark, nodes, edges).select("tax", "node_id", "depth")


def cycle_nodes(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return node_states(spark, nodes, edges).filter("state = 'cycle'").select("tax", "node_id")


def shortest_chains(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """``tax``, ``node_id``, ``chain`` (ids, root first): a shortest way to a node without known parents, smaller ids first.

    Absent parents are ignored. A node that no such way leads to, in or under a loop, stands alone.
    """
    scratch = Scratch(spark, "chains")
    rows, own, links, many = _split(nodes, edges, scratch, max_local)
    schema = pa.schema([("tax", pa.string()), ("node_id", pa.string()), ("chain", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tax, t in _trees(batches):
            n = len(t.names)
            far, up = [None if t.parents[v] else 0 for v in range(n)], [None] * n
            queue = deque(v for v in range(n) if far[v] == 0)
            while queue:
                p = queue.popleft()
                for c in t.children[p]:
                    if far[c] is None:
                        far[c] = far[p] + 1
                        queue.append(c)
                    if c != p and far[c] == far[p] + 1 and (up[c] is None or p < up[c]):
                        up[c] = p
            for low in range(0, n, 2000):
                out = []
                for v in range(low, min(n, low + 2000)):
                    chain, x = [], v
                    while x is not None:
                        chain.append(t.names[x])
                        x = up[x]
                    out.append(chain[::-1])
                yield pa.RecordBatch.from_arrays([pa.array([tax] * len(out), pa.string()), pa.array(t.names[low : low + 2000], pa.string()), pa.array(out, pa.list_(pa.string()))], schema=schema)

    small = rows.repartition(tasks(rows.sparkSession), "tax").sortWithinPartitions("tax").mapInArrow(run, "tax string, node_id string, chain array<string>")
    if not many:
        return small
    known = links.join(own.select("tax", F.col("node_id").alias("parent_id")), ["tax", "parent_id"], "left_semi")
    level, k = scratch.save(own.join(known.select("tax", F.col("child_id").alias("node_id")), ["tax", "node_id"], "left_anti").select("tax", "node_id", F.array("node_id").alias("chain")))
    done = level
    while k["rows"]:
        step = known.join(level.select("tax", F.col("node_id").alias("parent_id"), "chain"), ["tax", "parent_id"]).groupBy("tax", F.col("child_id").alias("node_id")).agg(F.min_by("chain", "parent_id").alias("c"))
        level, k = scratch.save(step.join(done.select("tax", "node_id"), ["tax", "node_id"], "left_anti").select("tax", "node_id", F.array_append("c", F.col("node_id")).alias("chain")))
        done = done.unionByName(level)
    alone = own.join(done.select("tax", "node_id"), ["tax", "node_id"], "left_anti").select("tax", "node_id", F.array("node_id").alias("chain"))
    return small.unionByName(done).unionByName(alone)


def back_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``tax``, ``cycle``: the closed path of each back-edge that a depth-first walk over parents meets, from sorted starts.

    What such a walk meets depends on its order, so each taxonomy is one walk in one task;
    ``cycle_nodes`` tells what lies on loops at any size.
    """
    rows = _known(nodes).select("tax", F.col("node_id").alias("c"), F.lit(None).cast("string").alias("p")).unionByName(_links(edges).select("tax", F.col("child_id").alias("c"), F.col("parent_id").alias("p")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tax, t in _trees(batches):
            colour, out = [0] * len(t.names), []
            for start in range(len(t.names)):
                if colour[start]:
                    continue
                way, work = [start], [iter(sorted(t.parents[start]))]
                colour[start] = 1
                while work:
                    p = next(work[-1], None)
                    if p is None:
                        colour[way.pop()] = 2
                        work.pop()
                    elif colour[p] == 1:
                        out.append([t.names[x] for x in [*way[way.index(p) :], p]])
                    elif not colour[p]:
                        colour[p] = 1
                        way.append(p)
                        work.append(iter(sorted(t.parents[p])))
            yield pa.RecordBatch.from_arrays([pa.array([tax] * len(out), pa.string()), pa.array(out, pa.list_(pa.string()))], names=["tax", "cycle"])

    return rows.repartition(tasks(rows.sparkSession), "tax").sortWithinPartitions("tax").mapInArrow(run, "tax string, cycle array<string>")


def disjoint_pairs(nodes: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``tax``, ``x``, ``y``: unordered pairs, both known, none with itself."""
    own = _known(nodes)
    d = disjoint.select("tax", F.least("node_id", "other_id").alias("x"), F.greatest("node_id", "other_id").alias("y")).filter("x <> y").distinct()
    return d.join(own.select("tax", F.col("node_id").alias("x")), ["tax", "x"], "left_semi").join(own.select("tax", F.col("node_id").alias("y")), ["tax", "y"], "left_semi").select("tax", "x", "y")


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``tax``, ``i``, ``j``, ``w``: undirected links and self links, each weighted by one over the root of both degrees."""
    own = _known(nodes)
    known = _links(edges).join(own.select("tax", F.col("node_id").alias("child_id")), ["tax", "child_id"], "left_semi").join(own.select("tax", F.col("node_id").alias("parent_id")), ["tax", "parent_id"], "left_semi")
    both = known.select("tax", F.col("child_id").alias("i"), F.col("parent_id").alias("j")).unionByName(known.select("tax", F.col("parent_id").alias("i"), F.col("child_id").alias("j"))).unionByName(own.select("tax", F.col("node_id").alias("i"), F.col("node_id").alias("j"))).distinct()
    both, _ = Scratch(nodes.sparkSession, "adjacency").save(both)  # read three times
    degree = both.groupBy("tax", "i").agg(F.count(F.lit(1)).alias("d"))
    return both.join(degree.withColumnRenamed("d", "di"), ["tax", "i"]).join(degree.select("tax", F.col("i").alias("j"), F.col("d").alias("dj")), ["tax", "j"]).select("tax", "i", "j", (1 / F.sqrt(F.col("di").cast("double") * F.col("dj"))).alias("w"))


def neighbour_sum(adj: DataFrame, features: DataFrame) -> DataFrame:
    """``tax``, ``node_id``, ``value``: the weighted sum of each node's neighbours' ``value``."""
    return adj.join(features.select("tax", F.col("node_id").alias("j"), "value"), ["tax", "j"]).groupBy("tax", F.col("i").alias("node_id")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def promoted_leaf(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """``tax``, ``node_id``, ``parent_id``, ``grandparent_id``: one leaf per taxonomy to hang up a level higher, chosen by a seeded hash."""
    links = edges.select("tax", "child_id", "parent_id", "ord").filter("child_id is not null and parent_id is not null")
    leaf = links.join(links.select("tax", F.col("parent_id").alias("child_id")).distinct(), ["tax", "child_id"], "left_anti")
    first = links.groupBy("tax", F.col("child_id").alias("parent_id")).agg(F.min_by("parent_id", F.struct("ord", "parent_id")).alias("grandparent_id"))
    options = leaf.join(first, ["tax", "parent_id"]).filter("grandparent_id <> child_id")
    pick = F.struct(F.xxhash64(F.lit(seed), "child_id"), "child_id", "ord", "parent_id", "grandparent_id")
    return options.groupBy("tax").agg(F.min(pick).alias("p")).select("tax", F.col("p.child_id").alias("node_id"), "p.parent_id", "p.grandparent_id")
