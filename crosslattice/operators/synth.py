"""Variants of a taxonomy with a known mapping, for testing matchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslattice.functions.text import synonym_first
from crosslattice.operators.graph import promoted_leaf
from crosslattice.operators.hierarchy import node_states

#: Synonyms of conference terms in the order they are tried, fixed values.
SYNONYMS = [
    ("Author", "Writer"), ("Reviewer", "Evaluator"), ("Review", "Evaluation"), ("Paper", "Article"), ("Submission", "Contribution"), ("Conference", "Symposium"), ("Workshop", "Seminar"),
    ("Chair", "Head"), ("Committee", "Board"), ("Participant", "Attendee"), ("Organisation", "Organization"), ("Document", "Manuscript"), ("Person", "Individual"), ("Event", "Occasion"),
    ("Topic", "Subject"), ("Preference", "Priority"), ("Decision", "Verdict"), ("Assistant", "Aide"), ("Member", "Associate"), ("Regular", "Standard"), ("Program", "Schedule"),
    ("Meeting", "Gathering"), ("Session", "Panel"), ("Tutorial", "Workshop"), ("Presentation", "Talk"), ("Speaker", "Lecturer"), ("Building", "Facility"), ("Location", "Venue"),
    ("Hotel", "Lodging"), ("Room", "Chamber"), ("City", "Municipality"), ("Country", "Nation"), ("Address", "Location data"), ("Email", "Electronic mail"), ("Phone", "Telephone number"),
    ("Date", "Calendar date"), ("Time", "Timepoint"), ("Activity", "Function"), ("Administrator", "Manager"), ("User", "Operator"), ("Student", "Learner"), ("Professor", "Instructor"),
]
#: Attributes that a variant may add or rename to, fixed values.
ATTRIBUTES = [
    ("hasTitle", "title"), ("hasKeyword", "keywords"), ("contactEmail", "email_address"), ("location", "venue_location"), ("abstract", "summary"), ("defaultChoice", "default_option"),
    ("hasTime", "timestamp"), ("hasDuration", "duration_minutes"), ("hasCapacity", "max_capacity"), ("cost", "price"),
]


def _chance(seed: int, id: Column, what: str) -> Column:
    """A number from 0 to 1 that depends on seed, id and purpose only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), id), F.lit(1_000_003)) / F.lit(1_000_003.0)


def clone(nodes: DataFrame, edges: DataFrame, suffix: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under new ids and a new taxonomy name."""
    tax = F.concat("tax", F.lit(f"_{suffix}_s{seed}"))
    new = lambda c: F.concat(F.col(c), F.lit(f"_{suffix}"))
    return nodes.withColumn("base_id", F.col("node_id")).withColumn("node_id", new("node_id")).withColumn("tax", tax), edges.withColumn("child_id", new("child_id")).withColumn("parent_id", new("parent_id")).withColumn("tax", tax)


def gold(nodes: DataFrame) -> DataFrame:
    """``source_id``, ``target_id`` of a clone: every node with its copy."""
    return nodes.select(F.col("base_id").alias("source_id"), F.col("node_id").alias("target_id")).distinct()


def exact(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    return clone(nodes, edges, "V1", seed)


def synonym(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Names with the first known word replaced."""
    n, e = clone(nodes, edges, "SYN", seed)
    return n.withColumn("name", synonym_first(F.col("name"), SYNONYMS)), e


def structural(spark: SparkSession, nodes: DataFrame, edges: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One leaf per taxonomy hung up a level higher, all its parents replaced; depths are told anew."""
    moved = promoted_leaf(nodes, edges, seed).select("tax", F.col("node_id").alias("child_id"), "grandparent_id")
    kept = edges.join(moved.select("tax", "child_id"), ["tax", "child_id"], "left_anti")
    hung = moved.select("tax", "child_id", F.col("grandparent_id").alias("parent_id"), F.lit(0).alias("ord"))
    fresh = kept.select("tax", "child_id", "parent_id", "ord").unionByName(hung)
    deep = node_states(spark, nodes, fresh).select("tax", "node_id", F.col("depth").cast("int").alias("depth"))
    return clone(nodes.drop("depth").join(deep, ["tax", "node_id"], "left"), fresh, "STR", seed)


def attributes(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Nodes without attributes get one (the first of a taxonomy always, others by chance); others have keys renamed and may lose one."""
    n, e = clone(nodes, edges, "ATTR", seed)
    empty = F.coalesce(F.size(F.map_keys("attributes")), F.lit(0)) <= 0
    first = F.min(F.when(empty, F.col("base_id"))).over(Window.partitionBy("tax"))
    pick = (_chance(seed, F.col("base_id"), "pick") * len(ATTRIBUTES)).cast("int")
    pool = F.array(*[F.create_map(F.lit(k), F.lit(v)) for k, v in ATTRIBUTES])
    added = F.when((F.col("base_id") == F.col("_first")) | (_chance(seed, F.col("base_id"), "add") < 0.5), F.get(pool, pick)).otherwise(F.col("attributes"))
    key = lambda k: F.coalesce(*[F.when(F.lower(k).contains(a.lower()), F.lit(b)) for a, b in ATTRIBUTES], k)
    entries = F.transform(F.map_entries("attributes"), lambda x: F.struct(key(x["key"]).alias("key"), x["value"].alias("value")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, 1000), lambda y: y["key"] == x["key"]))
    lose = (F.size(last) >= 2) & (_chance(seed, F.col("base_id"), "drop") < 0.3)
    renamed = F.map_from_entries(F.when(lose, F.slice(last, 2, 1000)).otherwise(last))
    return n.withColumn("_first", first).withColumn("attributes", F.when(empty, added).otherwise(renamed)).drop("_first"), e


def scenarios(spark: SparkSession, nodes: DataFrame, edges: DataFrame, seed: int = 42) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """(nodes, edges, true mapping) of all four variants from one seed: V1 exact, SYN, STR, ATTR."""
    made = {"V1": exact(nodes, edges, seed), "SYN": synonym(nodes, edges, seed), "STR": structural(spark, nodes, edges, seed), "ATTR": attributes(nodes, edges, seed)}
    return {k: (n, e, gold(n)) for k, (n, e) in made.items()}


def checked(nodes: DataFrame, made: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """One row for each scenario: what differs from the base, how many pairs its true mapping has, and whether its ids are unique."""
    out = None
    for k, (n, _, g) in made.items():
        d = content_differences(nodes, n).crossJoin(g.agg(F.count(F.lit(1)).alias("gold"))).crossJoin(n.agg((F.countDistinct("tax", "node_id") == F.count(F.lit(1))).alias("unique_ids"))).withColumn("scenario", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


def content_differences(base: DataFrame, variant: DataFrame) -> DataFrame:
    """One row: of how many nodes name, comment, depth, or attributes differ between a taxonomy and its clone; how many are missing."""
    b = base.select(F.col("node_id").alias("base_id"), F.col("name").alias("n1"), F.col("comment").alias("c1"), F.col("depth").alias("d1"), F.array_sort(F.map_entries("attributes")).alias("a1"))
    v = variant.select("base_id", F.col("name").alias("n2"), F.col("comment").alias("c2"), F.col("depth").alias("d2"), F.array_sort(F.map_entries("attributes")).alias("a2"), F.lit(1).alias("there"))
    j = b.join(v, "base_id", "left")
    diff = lambda x, y: F.count_if(F.col("there").isNotNull() & ~F.col(x).eqNullSafe(F.col(y)))
    return j.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("there").isNull()).alias("missing"), diff("n1", "n2").alias("names"), diff("c1", "c2").alias("comments"), diff("d1", "d2").alias("depths"), diff("a1", "a2").alias("attributes"))
