"""Measures of mappings against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslattice.functions.numbers import f1_ceiling, f1_of, ratio
from crosslattice.operators.assign import KEYS, per_source_best

THRESHOLDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


def _scores(df: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("gold"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def evaluate(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """``pair``, ``gold``, ``predicted``, ``tp``, precision, recall, F1: each source's best match counts; no division by zero."""
    best = per_source_best(predictions).select(*KEYS)
    truth = gold.select(*KEYS).distinct()
    hit = best.join(truth.withColumn("_hit", F.lit(1)), list(KEYS), "left")
    p = hit.groupBy("pair").agg(F.count(F.lit(1)).alias("predicted"), F.count("_hit").alias("tp"))
    g = truth.groupBy("pair").agg(F.count(F.lit(1)).alias("gold"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gold", "predicted", "tp")]
    return _scores(g.join(p, "pair", "full_outer").select("pair", *zero))


def summarise(per_pair: DataFrame, *by: str) -> DataFrame:
    """Means over pairs, and pooled figures from the sums; one row for each of ``by``, or for all."""
    t, p, g = F.sum("tp"), F.sum("predicted"), F.sum("gold")
    return per_pair.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        t.alias("tp"), p.alias("predicted"), g.alias("gold"), ratio(t, p).alias("pooled_precision"), ratio(t, g).alias("pooled_recall"), ratio(2 * t, p + g).alias("pooled_f1"),
    )


def pooled_from_records(records: DataFrame) -> DataFrame:
    """Pooled F1 of each approach from stored precision, predicted and reference counts; hits are rounded half to even."""
    hits = F.bround(F.col("precision") * F.col("predicted"))
    t, p, g = F.sum(hits), F.sum("predicted"), F.sum("gold")
    return records.groupBy("approach").agg(t.cast("bigint").alias("tp"), p.alias("predicted"), g.alias("gold"), ratio(2 * t, p + g).alias("pooled_f1"))


def threshold_sweep(predictions: DataFrame, gold: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """``pair``, ``threshold`` and scores of the predictions at or above it; thresholds that nothing reaches are kept.

    One pass: each match is counted at the highest threshold it reaches, and the counts are summed
    up from the top, so no row is multiplied.
    """
    best = per_source_best(predictions)
    truth = gold.select(*KEYS).distinct()
    hit = best.join(truth.withColumn("_hit", F.lit(1)), list(KEYS), "left")
    reach = F.lit(-1)
    for i, t in enumerate(thresholds):
        reach = F.when(F.col("score") >= t, i).otherwise(reach)
    counted = hit.withColumn("reach", reach).groupBy("pair").agg(*[F.count_if(F.col("reach") >= i).alias(f"p{i}") for i in range(len(thresholds))], *[F.count_if((F.col("reach") >= i) & F.col("_hit").isNotNull()).alias(f"t{i}") for i in range(len(thresholds))])
    g = truth.groupBy("pair").agg(F.count(F.lit(1)).alias("gold"))
    wide = g.join(counted, "pair", "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(f"p{i}", F.lit(0)).cast("bigint").alias("predicted"), F.coalesce(f"t{i}", F.lit(0)).cast("bigint").alias("tp")) for i, t in enumerate(thresholds)]))
    return _scores(wide.select("pair", F.coalesce("gold", F.lit(0)).cast("bigint").alias("gold"), each.alias("e")).select("pair", "gold", "e.*"))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """``k``, ``hits``, ``gold``, ``recall``, ``ceiling``, ``uncovered``: how much of the reference the first ``k`` candidates hold."""
    truth = gold.select(*KEYS).distinct()
    found = truth.join(ranked.select(*KEYS, "rank"), list(KEYS), "left").groupBy(*KEYS).agg(F.min("rank").alias("rank"))
    n = F.count(F.lit(1))
    wide = found.agg(n.alias("gold"), F.count_if(F.col("rank").isNull()).alias("missing"), *[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"k{k}").alias("hits")) for k in ks]))
    r = ratio(F.col("hits"), F.col("gold"))
    return wide.select("gold", "missing", each.alias("e")).select("e.k", "e.hits", "gold", r.alias("recall"), f1_ceiling(r).alias("ceiling"), ratio(F.col("missing"), F.col("gold")).alias("uncovered"))


def reliability_bins(scored: DataFrame, probability: str, label: str) -> DataFrame:
    """Ten bins: count, positives, mean probability and share of positives (null if empty); probability 1 is in the last."""
    p = F.col(probability)
    usable = scored.filter(p.isNotNull() & ~F.isnan(p) & p.between(0, 1)).select(F.least(F.floor(p * 10), F.lit(9)).cast("bigint").alias("bin"), p.alias("p"), F.col(label).cast("int").alias("y"))
    got = usable.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.sum("y").alias("positives"), F.avg("p").alias("mean_probability"), F.avg("y").alias("positive_fraction"))
    bins = scored.sparkSession.range(10).withColumnRenamed("id", "bin")
    return bins.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("positives", F.lit(0)).alias("positives"), "mean_probability", "positive_fraction")


def calibration(scored: DataFrame, probability: str, label: str) -> DataFrame:
    """One row: count, positives, prevalence, Brier score and expected calibration error over ten bins."""
    p, y = F.col(probability), F.col(label).cast("int")
    usable = scored.filter(p.isNotNull() & ~F.isnan(p) & p.between(0, 1))
    parts = usable.groupBy(F.least(F.floor(p * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"), F.sum(p).alias("sp"), F.sum((p - y) * (p - y)).alias("sq"))
    n = F.sum("n")
    return parts.agg(n.alias("count"), F.sum("pos").alias("positives"), (F.sum("pos") / n).alias("prevalence"), (F.sum("sq") / n).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("pos"))) / n).alias("ece"))


def target_collisions(matches: DataFrame) -> DataFrame:
    """Matches beyond the first of each target, by pair."""
    return matches.groupBy("pair").agg((F.count(F.lit(1)) - F.countDistinct("target_id")).alias("collisions"))
