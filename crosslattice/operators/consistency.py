"""Checks of taxonomies and of alignments between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.functions.numbers import ratio
from crosslattice.functions.text import collapsed, sample
from crosslattice.operators import graph

#: Kinds of findings and how grave they are, fixed values.
SEVERITY = {
    "cycle": "error", "duplicate-label": "warning", "disjoint-ancestor": "error", "dangling-parent": "error", "unreachable": "info",
    "cardinality": "error", "disjointness-violation": "error", "subsumption-violation": "warning",
}
ALIGNMENT_KINDS = ("cardinality", "disjointness-violation", "subsumption-violation")


def with_severity(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("kind")])


def duplicate_labels(nodes: DataFrame) -> DataFrame:
    """``tax``, ``label``, ``n``, ``first_id``: labels that several nodes share, case and white space aside; blank ones are no label."""
    each = nodes.select("tax", "node_id", collapsed(F.col("name")).alias("label")).filter("label <> ''")
    return each.groupBy("tax", "label").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("first_id")).filter("n > 1")


def disjoint_ancestors(pairs: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tax``, ``x``, ``y``, ``n``, ``first_id``: disjoint pairs that are both ancestor-or-self of some node."""
    own = nodes.select("tax", "node_id").distinct()
    scope = closure.select("tax", "node_id", "ancestor_id").unionByName(own.select("tax", "node_id", F.col("node_id").alias("ancestor_id")))
    a = pairs.join(scope.select("tax", F.col("ancestor_id").alias("x"), "node_id"), ["tax", "x"])
    both = a.join(scope.select("tax", F.col("ancestor_id").alias("y"), "node_id"), ["tax", "y", "node_id"], "left_semi")
    return both.groupBy("tax", "x", "y").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("first_id"))


def taxonomy_findings(spark: SparkSession, nodes: DataFrame, edges: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``tax``, ``kind``, ``source_id``, ``detail``, ``severity`` of every structural finding; unreachable nodes are one finding a taxonomy."""
    cycles = graph.back_edges(nodes, edges).select("tax", F.lit("cycle").alias("kind"), F.get("cycle", F.lit(0)).alias("source_id"), F.array_join("cycle", " -> ").alias("detail"))
    gone = graph.dangling(nodes, edges).groupBy("tax", "node_id").agg(F.collect_set("parent_id").alias("p")).select("tax", F.lit("dangling-parent").alias("kind"), F.col("node_id").alias("source_id"), sample(F.col("p")).alias("detail"))
    same = duplicate_labels(nodes).select("tax", F.lit("duplicate-label").alias("kind"), F.col("first_id").alias("source_id"), F.concat_ws(" ", "label", F.col("n").cast("string")).alias("detail"))
    closure = graph.ancestors(spark, nodes, edges)
    clash = disjoint_ancestors(graph.disjoint_pairs(nodes, disjoint), closure, nodes).select("tax", F.lit("disjoint-ancestor").alias("kind"), F.col("first_id").alias("source_id"), F.concat_ws(" ", "x", "y").alias("detail"))
    lost = graph.orphans(spark, nodes, edges).groupBy("tax").agg(F.min("node_id").alias("source_id"), F.count(F.lit(1)).alias("n")).select("tax", F.lit("unreachable").alias("kind"), "source_id", F.col("n").cast("string").alias("detail"))
    return with_severity(cycles.unionByName(gone).unionByName(same).unionByName(clash).unionByName(lost))


def taxonomy_summary(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``tax``, ``node_count``, ``root_count``, ``max_depth``."""
    top = graph.roots(nodes, edges).groupBy("tax").agg(F.count(F.lit(1)).alias("root_count"))
    deep = graph.depths(spark, nodes, edges).groupBy("tax").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("max_depth"))
    return deep.join(top, "tax", "left").select("tax", "node_count", F.coalesce("root_count", F.lit(0)).alias("root_count"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"))


def cardinality_groups(matches: DataFrame) -> DataFrame:
    """``pair``, ``side``, ``node_id``, ``n``: nodes matched with several others."""
    m = matches.select("pair", "source_id", "target_id").distinct()
    s = m.groupBy("pair", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("source"))
    t = m.groupBy("pair", F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("target"))
    return s.unionByName(t).filter("n > 1").select("pair", "side", "node_id", "n")


def disjointness_clashes(matches: DataFrame, pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """``pair``, ``x``, ``y``, ``mx``, ``my``: disjoint sources whose targets are equal or one above the other. Swap the columns of ``matches`` for the other side."""
    m = matches.select("pair", "source_id", "target_id").distinct()
    a = pairs.select("x", "y").distinct().join(m.select("pair", F.col("source_id").alias("x"), F.col("target_id").alias("mx")), "x")
    both = a.join(m.select("pair", F.col("source_id").alias("y"), F.col("target_id").alias("my")), ["pair", "y"])
    up = closure.select("node_id", "ancestor_id").distinct()
    related = up.unionByName(up.select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("ancestor_id"))).distinct()
    equal = both.filter("mx = my")
    over = both.filter("mx <> my").join(related.select(F.col("node_id").alias("mx"), F.col("ancestor_id").alias("my")), ["mx", "my"], "left_semi")
    return equal.select("pair", "x", "y", "mx", "my").unionByName(over.select("pair", "x", "y", "mx", "my"))


def subsumption_violations(matches: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """``pair``, ``source_id``, ``target_id``: matches that do not lie below a match of the source's parent; each once."""
    m = matches.select("pair", "source_id", "target_id").distinct()
    links = edges.select(F.col("child_id").alias("source_id"), "parent_id").filter("parent_id is not null").distinct()
    up = m.join(links, "source_id").join(m.select("pair", F.col("source_id").alias("parent_id"), F.col("target_id").alias("parent_target")), ["pair", "parent_id"]).filter("target_id <> parent_target")
    below = closure.select(F.col("node_id").alias("target_id"), F.col("ancestor_id").alias("parent_target")).distinct()
    return up.join(below, ["target_id", "parent_target"], "left_anti").select("pair", "source_id", "target_id").distinct()


def flags(matches: DataFrame, edges: DataFrame, pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """``pair``, ``source_id``, ``target_id``, ``kind``: every match with each kind of conflict it takes part in."""
    m = matches.select("pair", "source_id", "target_id").distinct()
    card = cardinality_groups(m)
    by_source = m.join(card.filter("side = 'source'").select("pair", F.col("node_id").alias("source_id")), ["pair", "source_id"], "left_semi")
    by_target = m.join(card.filter("side = 'target'").select("pair", F.col("node_id").alias("target_id")), ["pair", "target_id"], "left_semi")
    cols = ("pair", "source_id", "target_id")
    out = by_source.select(*cols).unionByName(by_target.select(*cols)).withColumn("kind", F.lit("cardinality"))
    turned = m.select("pair", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    for side, x in (("s", m), ("t", turned)):
        c = disjointness_clashes(x, pairs, closure)
        each = c.select("pair", F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("mx").alias("b")), F.struct(F.col("y").alias("a"), F.col("my").alias("b")))).alias("e"))
        a, b = F.col("e.a"), F.col("e.b")
        one = each.select("pair", (a if side == "s" else b).alias("source_id"), (b if side == "s" else a).alias("target_id"))
        out = out.unionByName(one.withColumn("kind", F.lit("disjointness-violation")))
    return out.unionByName(subsumption_violations(m, edges, closure).withColumn("kind", F.lit("subsumption-violation"))).distinct()


def kind_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def drop_flagged(matches: DataFrame, flagged: DataFrame, kinds: Sequence[str] = ALIGNMENT_KINDS) -> DataFrame:
    """Matches without those that carry one of the kinds."""
    bad = flagged.filter(F.col("kind").isin(list(kinds))).select("pair", "source_id", "target_id").distinct()
    return matches.join(bad, ["pair", "source_id", "target_id"], "left_anti")


def flag_quality(matches: DataFrame, flagged: DataFrame, gold: DataFrame, kinds: Sequence[str] = ALIGNMENT_KINDS) -> DataFrame:
    """By pair: how well flags tell wrong matches, against the share of wrong ones as such."""
    keys = ["pair", "source_id", "target_id"]
    bad = flagged.filter(F.col("kind").isin(list(kinds))).select(*keys).distinct().withColumn("f", F.lit(1))
    truth = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    j = matches.select(*keys).distinct().join(bad, keys, "left").join(truth, keys, "left")
    wrong = F.col("g").isNull()
    r = j.groupBy("pair").agg(F.count(F.lit(1)).alias("matches"), F.count("f").alias("flagged"), F.count_if(wrong & F.col("f").isNotNull()).alias("flagged_errors"), F.count_if(wrong).alias("errors"))
    p, base = ratio(F.col("flagged_errors"), F.col("flagged")), ratio(F.col("errors"), F.col("matches"))
    return r.select("*", p.alias("error_precision"), ratio(F.col("flagged_errors"), F.col("errors")).alias("error_recall"), base.alias("base_error_rate"), (p - base).alias("precision_lift"))
