"""Paired comparisons of configurations over the pairs they share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch, tasks

#: Constants of the linear congruential index of the bootstrap, fixed values.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648


def paired(scores: DataFrame, comparisons: DataFrame, strict: bool = False) -> DataFrame:
    """``label``, ``pair``, ``a``, ``b``, ``diff`` for each comparison (label, first, second); ``scores`` has config, pair, f1.

    Pairs that only one side has are left out; with ``strict`` they raise an error when read.
    """
    a = comparisons.join(scores.select(F.col("config").alias("first"), "pair", F.col("f1").alias("a")), "first").select("label", "pair", "a")
    b = comparisons.join(scores.select(F.col("config").alias("second"), "pair", F.col("f1").alias("b")), "second").select("label", "pair", "b")
    both = a.join(b, ["label", "pair"], "full_outer" if strict else "inner")
    if strict:
        ok = F.col("a").isNotNull() & F.col("b").isNotNull()
        both = both.filter(F.coalesce(F.assert_true(ok, F.concat(F.lit("one side has no "), F.col("pair"), F.lit(" in "), F.col("label"))).cast("boolean"), F.lit(True)))
    return both.select("label", "pair", "a", "b", (F.col("a") - F.col("b")).alias("diff"))


def wins_ties_losses(diffs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    d = F.col("diff")
    return diffs.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.avg("a").alias("first_mean"), F.avg("b").alias("second_mean"), F.avg(d).alias("mean_difference"), F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"))


def signed_ranks(diffs: DataFrame) -> DataFrame:
    """``label``, ``n``, ``w_plus``, ``w_minus``, ``statistic``: ranks of the absolute non-zero differences, means for equal ones."""
    d = diffs.filter(F.abs("diff") > 1e-12).withColumn("size", F.round(F.abs("diff"), 12))
    order, same = Window.partitionBy("label").orderBy("size"), Window.partitionBy("label", "size")
    r = d.withColumn("rank", F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0))
    g = r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("diff") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    return g.withColumn("statistic", F.least("w_plus", "w_minus"))


def signed_rank_p(n: int, statistic: float, sizes: list[float]) -> float:
    """Two-sided p: exact over all sign patterns of the given ranks up to 50 differences, else by the normal curve with tie correction."""
    if n < 2:
        return 1.0
    if n <= 50:
        ranks = [round(2 * r) for r in sizes]
        ways = {0: 1}
        for r in ranks:
            fresh = dict(ways)
            for s, k in ways.items():
                fresh[s + r] = fresh.get(s + r, 0) + k
            ways = fresh
        low = sum(k for s, k in ways.items() if s <= round(2 * statistic))
        return min(1.0, 2 * low / 2**n)
    mean = n * (n + 1) / 4
    ties: dict[float, int] = {}
    for r in sizes:
        ties[r] = ties.get(r, 0) + 1
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties.values()) / 48
    z = (statistic - mean) / math.sqrt(var) if var > 0 else 0.0
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """``label``, ``statistic``, ``p_value``: signed-rank test; fewer than two differences give p 1. A label's pairs are few, one group each."""
    d = diffs.filter(F.abs("diff") > 1e-12).select("label", F.round("diff", 12).alias("diff"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        r = f["diff"].abs().rank(method="average")
        plus, minus = float(r[f["diff"] > 0].sum()), float(r[f["diff"] < 0].sum())
        s = min(plus, minus)
        return pd.DataFrame({"label": [f["label"].iloc[0]], "statistic": [s], "p_value": [signed_rank_p(len(f), s, r.tolist())]})

    tested = d.groupBy("label").applyInPandas(run, "label string, statistic double, p_value double")
    return diffs.select("label").distinct().join(tested, "label", "left").select("label", "statistic", F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def adjusted(tests: DataFrame) -> DataFrame:
    """Adds ``p_holm`` and ``p_bonferroni`` over all comparisons (a short list)."""
    m = tests.agg(F.count(F.lit(1)).alias("m"))
    order = Window.orderBy("p_value", "label")
    t = tests.crossJoin(F.broadcast(m)).withColumn("_i", F.row_number().over(order) - 1)
    step = F.least(F.lit(1.0), F.col("p_value") * (F.col("m") - F.col("_i")))
    return t.withColumn("p_holm", F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * F.col("m"))).drop("_i", "m")


def bootstrap(diffs: DataFrame, rounds: int = 10_000, seed: int = 20260601) -> DataFrame:
    """``label``, ``ci_low``, ``ci_high``: 2.5 and 97.5 percentiles of the mean of resampled differences.

    The index of each draw comes from arithmetic on round and place, so every engine draws alike.
    A comparison's differences are one array of doubles, of which each task that runs some of its
    rounds has a copy; a round's draws are summed as they are made, no draw is a row.
    """
    scratch = Scratch(diffs.sparkSession, "bootstrap")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[bytes]] = {}
        for b in batches:
            for label, part in b.to_pandas().groupby("label", sort=False)["diff"]:
                held.setdefault(label, []).append(part.to_numpy(np.float64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([b"".join(x) for x in held.values()], pa.binary())], names=["label", "d"])

    ordered = diffs.filter("label is not null").select("label", "pair", F.col("diff").cast("double").alias("diff")).repartition("label").sortWithinPartitions("label", "pair", "diff")
    each, k = scratch.save(ordered.select("label", "diff").mapInArrow(pack, "label string, d binary"))
    n = tasks(diffs.sparkSession)
    step = max(1, -(-rounds // max(1, -(-2 * n // max(1, k["rows"])))))
    low = F.explode(F.array(*[F.lit(x) for x in range(0, rounds, step)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, low, d in zip(*[b.column(i).to_pylist() for i in range(3)]):
                d = np.frombuffer(d, np.float64)
                high, many = min(rounds, low + step), max(1, (1 << 18) // len(d))
                place = (np.arange(len(d), dtype=np.uint64) * np.uint64(104729)).astype(np.uint32)
                means = np.empty(high - low)
                for at in range(low, high, many):
                    # the modulus is a power of two, so 32 bits hold all that counts
                    r = np.arange(at, min(high, at + many), dtype=np.uint64) * np.uint64(7919) + np.uint64(seed)
                    x = r.astype(np.uint32)[:, None] + place
                    for _ in range(2):
                        x *= np.uint32(LCG_A)
                        x += np.uint32(LCG_C)
                    x &= np.uint32(LCG_M - 1)
                    x >>= np.uint32(8)
                    x %= np.uint32(len(d))
                    means[at - low : at - low + len(x)] = d[x].sum(1) / len(d)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(means), pa.string()), pa.array(means, from_pandas=True)], names=["label", "m"])

    means = each.select("label", low.alias("low"), "d").repartition(n, "label", "low").mapInArrow(run, "label string, m double")
    return means.groupBy("label").agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], bins: int = 4096) -> DataFrame:
    """``by``, ``p``, ``x``: percentiles of ``value``, interpolated, exact at any size.

    Counts in ``bins`` equal bins tell in which of them the wanted ranks lie; only the rows of those
    are ordered, once for each distinct value. Null and NaN values don't count; a null in ``by`` is a
    group like any other.
    """
    scratch = Scratch(df.sparkSession, "percentiles")
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    ends, k = scratch.save(rows.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n")))

    def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"_b{c}") if c in keys else c for c in b.columns])
        on = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_b{c}"]) for c in keys])
        return a.join(F.broadcast(b) if small else b, on).drop(*[f"_b{c}" for c in keys])

    few = k["rows"] <= 10_000  # measured: one row for each group
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    cut = joined(rows, ends, by, few).select(*by, "_x", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("_bin"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    counted = cut.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", upto)
    h = (F.col("_n") - 1) * F.col("p")
    wanted = ends.select(*by, "_n", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")).select(*by, "p", (h - F.floor(h)).alias("_part"), F.explode(F.array(F.floor(h), F.ceil(h))).alias("_rank"))
    placed, _ = scratch.save(joined(wanted.distinct(), counted, by, False).filter((F.col("_rank") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_upto"))).select(*by, "p", "_part", "_rank", "_bin", (F.col("_upto") - F.col("_c")).alias("_before")))
    inside = joined(cut, placed.select(*by, "_bin").distinct(), [*by, "_bin"], few).groupBy(*by, "_bin", "_x").agg(F.count(F.lit(1)).alias("_c"))
    inside = inside.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    found = joined(placed, inside, [*by, "_bin"], False).filter((F.col("_rank") - F.col("_before") >= F.col("_end") - F.col("_c")) & (F.col("_rank") - F.col("_before") < F.col("_end")))
    return found.groupBy(*by, "p").agg((F.min("_x") + F.first("_part") * (F.max("_x") - F.min("_x"))).alias("x"))
