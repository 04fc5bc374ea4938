"""Choosing thresholds and modes without looking at the pair they are used on.

Means are rounded to 12 places before any choice, so equal vectors tie whatever the order of summing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _others_mean(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``others``: the mean F1 of the same choice over all other pairs, from the sums of all less the own."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("others", F.round(F.when(n > 1, (F.sum("f1").over(w) - F.col("f1")) / F.when(n > 1, n - 1)), 12))


def loo_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``pair``, ``threshold`` and the pair's own scores at it: the best mean F1 of the other pairs, the lowest of equal ones.

    ``sweep`` has one row for each pair and threshold; ``by`` names the columns, as the
    approach, that tell separate problems apart. A single pair has no others and gives no row.
    """
    rated = _others_mean(sweep, [*by, "threshold"]).filter("others is not null")
    w = Window.partitionBy(*by, "pair").orderBy(F.desc("others"), F.asc("threshold"))
    return rated.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "others")


def loo_mode(scores: DataFrame, modes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``pair``, ``mode``, ``f1``: each pair with the mode that is best on the others; of equal ones the first of ``modes``."""
    rated = _others_mean(scores.filter(F.col("mode").isin(list(modes))), [*by, "mode"]).filter("others is not null")
    place = F.array_position(F.lit(list(modes)), F.col("mode"))
    w = Window.partitionBy(*by, "pair").orderBy(F.desc("others"), place)
    return rated.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "pair", "mode", "f1")


def loo_joint(sweep: DataFrame, modes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``pair``, ``mode``, ``threshold``, ``f1``: mode and threshold chosen together on the other pairs; lowest threshold, then mode order."""
    rated = _others_mean(sweep.filter(F.col("mode").isin(list(modes))), [*by, "mode", "threshold"]).filter("others is not null")
    w = Window.partitionBy(*by, "pair").orderBy(F.desc("others"), F.asc("threshold"), F.array_position(F.lit(list(modes)), F.col("mode")))
    return rated.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "pair", "mode", "threshold", "f1")


def mode_aggregates(scores: DataFrame, modes: Sequence[str], by: Sequence[str] = ("approach",)) -> DataFrame:
    """One row for each of ``by``: mean over modes then pairs, mean with the mode chosen on the others, and the best mode of each pair (an oracle)."""
    core = scores.filter(F.col("mode").isin(list(modes)))
    per = core.groupBy(*by, "pair").agg(F.avg("f1").alias("m"), F.max("f1").alias("o"))
    loo = loo_mode(scores, modes, by).groupBy(*by).agg(F.avg("f1").alias("loo_f1"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean_f1"), F.avg("o").alias("oracle_f1"), F.count(F.lit(1)).alias("pairs")).join(loo, list(by))


def configurations(scores: DataFrame, modes: Sequence[str]) -> DataFrame:
    """``approach``, ``variant``, ``pair``, ``f1``: raw, oracle and ensemble variants of every approach.

    ``scores`` has approach, pair, mode (null for approaches without modes), f1.
    """
    core = scores.filter(F.col("mode").isin(list(modes)) | F.col("mode").isNull())
    both = core.groupBy("approach", "pair").agg(F.avg("f1").alias("raw"), F.max("f1").alias("oracle"), F.count("mode").alias("k"))
    raw = both.select("approach", F.lit("raw").alias("variant"), "pair", F.col("raw").alias("f1"))
    best = both.filter("k > 0").select("approach", F.lit("oracle").alias("variant"), "pair", F.col("oracle").alias("f1"))
    ens = scores.filter("mode = 'ensemble'").select("approach", F.lit("ensemble").alias("variant"), "pair", "f1")
    return raw.unionByName(best).unionByName(ens)


def best_cells(values: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Adds ``is_best``: the highest value of each row, all of equal ones."""
    return values.withColumn("is_best", F.col(value) == F.max(value).over(Window.partitionBy(row)))


def worst(values: DataFrame, group: str, key: str, value: str, n: int = 3) -> DataFrame:
    """The ``n`` lowest of each group, ties by key."""
    w = Window.partitionBy(group).orderBy(F.asc(value), F.asc(key))
    return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def spread(values: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), least, most and range of repeated runs."""
    v = F.col(value)
    return values.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("range"))
