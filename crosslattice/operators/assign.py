"""From scored candidates to mappings: best targets, deduplication, greedy one-to-one, votes.

All rules share one total order: score falling, then source id, then target id. Null scores and
null or blank ids don't count. ``pair`` separates independent problems.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch, nonblank, tasks

KEYS = ("pair", "source_id", "target_id")
#: Candidates of one pair that a task takes in the last step of the greedy rule.
MAX_LOCAL = 500_000


def clean(candidates: DataFrame) -> DataFrame:
    """``pair``, ``source_id``, ``target_id``, ``score``: usable rows only; a repeated candidate keeps its highest score."""
    ok = nonblank(F.col("source_id")) & nonblank(F.col("target_id")) & F.col("score").isNotNull() & ~F.isnan("score")
    return candidates.filter(ok).groupBy(*KEYS).agg(F.max("score").alias("score"))


def _first(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def per_source_best(candidates: DataFrame) -> DataFrame:
    """The best target of every source."""
    return _first(candidates, ("pair", "source_id"), (F.desc("score"), F.asc("target_id")))


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best targets of every source, with ``rank``."""
    return _first(candidates, ("pair", "source_id"), (F.desc("score"), F.asc("target_id")), k, "rank")


def dedupe_by_target(candidates: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Best target per source, then best source per target; scores below the threshold fall out between."""
    kept = per_source_best(candidates).filter(F.col("score") >= threshold)
    return _first(kept, ("pair", "target_id"), (F.desc("score"), F.asc("source_id")))


def above(alignment: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Cut after selection, inclusive."""
    return alignment.filter(F.col(score) >= threshold)


def strictly_above(candidates: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Cut before selection, exclusive."""
    return candidates.filter(F.col(score) > threshold)


def _local(rows: DataFrame) -> DataFrame:
    """One pass over each pair's candidates in order, taking what joins two free ids."""
    schema = pa.schema([("pair", pa.string()), ("source_id", pa.string()), ("target_id", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, (set(), set())
        for b in batches:
            take = []
            for i, (p, s, t) in enumerate(zip(*[b.column(k).to_pylist() for k in range(3)])):
                if p != now:
                    now, used = p, (set(), set())
                if s not in used[0] and t not in used[1]:
                    used[0].add(s)
                    used[1].add(t)
                    take.append(i)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(take, pa.int64())) for k in range(4)], schema=schema)

    ordered = rows.select(*KEYS, "score").repartition(tasks(rows.sparkSession), "pair").sortWithinPartitions("pair", F.desc("score"), "source_id", "target_id")
    return ordered.mapInArrow(run, "pair string, source_id string, target_id string, score double")


def greedy_injective(spark: SparkSession, candidates: DataFrame, threshold: float = 0.0, max_local: int = MAX_LOCAL) -> DataFrame:
    """Global greedy one-to-one per pair: candidates in total order, each taken if both its ids are free.

    As the order is total, that is the same as taking mutually best candidates again and again.
    Pairs of more than ``max_local`` candidates go through such rounds, spread over the cluster,
    until what is left of them is small enough; the rest is one ordered pass in a task.
    """
    scratch = Scratch(spark, "greedy")
    rows, n = scratch.save(clean(candidates).filter(F.col("score") >= threshold))
    sizes = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_local).select("pair")
    large, k = scratch.save(sizes)
    if not k["rows"]:
        return _local(rows)
    left, m = scratch.save(rows.join(large, "pair", "left_semi"))
    done = _local(rows.join(large, "pair", "left_anti"))
    while m["rows"]:
        ws = Window.partitionBy("pair", "source_id").orderBy(F.desc("score"), F.asc("target_id"))
        wt = Window.partitionBy("pair", "target_id").orderBy(F.desc("score"), F.asc("source_id"))
        s = left.withColumn("_r", F.row_number().over(ws)).filter("_r = 1").select(*KEYS, "score")
        t = left.withColumn("_r", F.row_number().over(wt)).filter("_r = 1").select(*KEYS)
        taken, _ = scratch.save(s.join(t, list(KEYS)).select(*KEYS, "score"))
        done = done.unionByName(taken)
        rest = left.join(taken.select("pair", "source_id"), ["pair", "source_id"], "left_anti").join(taken.select("pair", "target_id"), ["pair", "target_id"], "left_anti")
        fresh, m = scratch.save(rest)
        scratch.drop(left)
        left = fresh
        still, k = scratch.save(left.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_local).select("pair"))
        done = done.unionByName(_local(left.join(still, "pair", "left_anti")))
        left, m = scratch.save(left.join(still, "pair", "left_semi"))
    return done


def uncertain(candidates: DataFrame, threshold: float = 0.7, margin: float = 0.1, weak: float = 0.3) -> DataFrame:
    """Each source's best and second score where the choice is doubtful: low, or close to a second that is not weak.

    ``alternatives`` are the targets of ranks 2 to 4 above ``weak``. A source with one candidate
    has a second score of 0.
    """
    top = top_k(candidates, 4)
    entry = F.struct("rank", "target_id", "score")
    rows = top.groupBy("pair", "source_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    best, second = F.col("c")[0]["score"], F.coalesce(F.get("c", F.lit(1))["score"], F.lit(0.0))
    others = F.filter(F.slice("c", 2, 3), lambda x: x["score"] > weak)
    out = rows.select("pair", "source_id", F.col("c")[0]["target_id"].alias("target_id"), best.alias("best"), second.alias("second"), F.transform(others, lambda x: x["target_id"]).alias("alternatives"))
    return out.filter((F.col("best") < threshold) | ((F.col("best") - F.col("second") < margin) & (F.col("second") > weak)))


def votes(candidates: DataFrame, min_votes: int = 2) -> DataFrame:
    """Matches that at least ``min_votes`` modes have, with the voters' mean score. ``candidates`` has a ``mode``."""
    once = candidates.groupBy(*KEYS, "mode").agg(F.max("score").alias("score"))
    return once.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("votes"), F.avg("score").alias("score")).filter(F.col("votes") >= min_votes)


def plurality(candidates: DataFrame, modes: Sequence[str]) -> DataFrame:
    """The target most modes gave each source; of equal ones the one named first in mode order; not one-to-one."""
    place = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m in enumerate(modes)])
    counted = candidates.withColumn("place", place).filter("place is not null").groupBy(*KEYS).agg(F.countDistinct("mode").alias("votes"), F.min("place").alias("place"))
    best = _first(counted, ("pair", "source_id"), (F.desc("votes"), F.asc("place"), F.asc("target_id")))
    return best.select(*KEYS, "votes", (F.col("votes") / len(modes)).alias("score"))


def judged(spark: SparkSession, judgements: DataFrame, cut: float = 0.7) -> DataFrame:
    """Classifier judgements to a mapping: matches strictly above the cut, one-to-one; every source is kept, an unmatched one with ''."""
    c = judgements.select("pair", "source_id", F.col("candidate_id").alias("target_id"), F.col("confidence").alias("score"), "is_match")
    good = greedy_injective(spark, c.filter((F.col("is_match")) & (F.col("score") > cut) & (F.col("score") <= 1.000001)).drop("is_match"))
    sources = judgements.select("pair", "source_id").filter("source_id is not null").distinct()
    return sources.join(good, ["pair", "source_id"], "left").select("pair", "source_id", F.coalesce("target_id", F.lit("")).alias("target_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def mapping_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources whose target differs between two mappings; '' stands for none."""
    a = old.select("pair", "source_id", F.col("target_id").alias("old_target"))
    b = new.select("pair", "source_id", F.col("target_id").alias("new_target"))
    j = a.join(b, ["pair", "source_id"], "full_outer").withColumn("old_target", F.coalesce("old_target", F.lit(""))).withColumn("new_target", F.coalesce("new_target", F.lit("")))
    return j.filter("old_target <> new_target")
