"""Studies over whole sets of mappings: approach summaries, end-to-end evaluation of scored candidates, rule grids, coverage checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.functions.numbers import ratio
from crosslattice.operators import assign, evaluate, selection

JOIN = "\u0001"
PAIR_MARK = re.compile(r"\s*[-:↔/]\s*")


def approach_summary(per_pair: DataFrame, sweep: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row for each ``approach``: means, pooled figures, the best and the left-out thresholds, and how well flags tell wrong matches.

    ``per_pair`` is an evaluation (approach, pair, gold, predicted, tp, precision, recall, f1),
    ``sweep`` one by thresholds, ``flagged`` the result of ``flag_quality`` with its approach. Approaches
    without flags have nulls there. Means that decide are rounded to 12 places; of equal ones the
    lowest threshold is taken.
    """
    t, p, g = F.sum("tp"), F.sum("predicted"), F.sum("gold")
    base = per_pair.groupBy("approach").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"), F.min("f1").alias("least_f1"), F.max("f1").alias("most_f1"),
        F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("stdev_f1"), F.count_if(F.col("f1") == 0).alias("zero_pairs"), t.alias("tp"), p.alias("predicted"), g.alias("gold"),
        ratio(t, p).alias("pooled_precision"), ratio(t, g).alias("pooled_recall"), ratio(2 * t, p + g).alias("pooled_f1"),
        F.count_if(F.abs(F.col("f1") - ratio(2 * F.col("tp"), F.col("predicted") + F.col("gold"))) > 1e-6).alias("mismatches"),
    )
    at = sweep.groupBy("approach", "threshold").agg(F.round(F.avg("f1"), 12).alias("m"), F.sum("tp").alias("t"), F.sum("predicted").alias("p"), F.sum("gold").alias("g"))
    best = at.groupBy("approach").agg(F.min(F.struct((-F.col("m")).alias("m"), "threshold", "t", "p", "g")).alias("b"))
    best = best.select("approach", F.col("b.threshold").alias("best_threshold"), (-F.col("b.m")).alias("best_threshold_f1"), ratio(F.col("b.t"), F.col("b.p")).alias("best_pooled_precision"), ratio(F.col("b.t"), F.col("b.g")).alias("best_pooled_recall"))
    left = selection.loo_threshold(sweep, ["approach"]).select("approach", "pair", "threshold", F.col("f1").alias("loo"))
    diff = F.col("loo") - F.col("f1")
    both = left.join(per_pair.select("approach", "pair", "f1"), ["approach", "pair"])
    chosen = left.groupBy("approach", "threshold").agg(F.count(F.lit(1)).alias("k")).groupBy("approach").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("threshold", "k"))), lambda x: F.concat(F.format_string("%.2f", x["threshold"]), F.lit(":"), x["k"].cast("string"))), " ").alias("loo_thresholds"))
    loo = both.groupBy("approach").agg(F.avg("loo").alias("loo_f1"), F.count_if(diff > 1e-9).alias("loo_wins"), F.count_if(F.abs(diff) <= 1e-9).alias("loo_ties"), F.count_if(diff < -1e-9).alias("loo_losses"))
    m, f, fe, e = (F.sum(c) for c in ("matches", "flagged", "flagged_errors", "errors"))
    flags = flagged.groupBy("approach").agg(ratio(f, m).alias("flag_coverage"), ratio(fe, f).alias("flag_precision"), ratio(fe, e).alias("flag_recall"), (ratio(fe, f) - ratio(e, m)).alias("flag_lift"))
    return base.join(best, "approach", "left").join(loo, "approach", "left").join(chosen, "approach", "left").join(flags, "approach", "left")


def oracle_of_all_modes(scores: DataFrame) -> DataFrame:
    """``approach``, ``pairs``, ``oracle_f1``: mean over pairs of the best mode, ensembles among them."""
    return scores.groupBy("approach", "pair").agg(F.max("f1").alias("b")).groupBy("approach").agg(F.count(F.lit(1)).alias("pairs"), F.avg("b").alias("oracle_f1"))


def left_out_configurations(scores: DataFrame, sweep: DataFrame, modes: Sequence[str]) -> DataFrame:
    """``approach``, ``variant``, ``pair``, ``f1`` of all variants: raw, thr (threshold chosen on the other pairs), loo (mode chosen on them), oracle, ensemble."""
    thr = selection.loo_threshold(sweep, ["approach"]).select("approach", F.lit("thr").alias("variant"), "pair", "f1")
    loo = selection.loo_mode(scores, modes, ["approach"]).select("approach", F.lit("loo").alias("variant"), "pair", "f1")
    return selection.configurations(scores, modes).unionByName(thr).unionByName(loo)


def retrieval_recall(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: reference matches, those among the retrieved candidates, pooled recall, and the mean number of candidates of a source."""
    keys = ["pair", "source_id", "target_id"]
    truth, found = gold.select(*keys).distinct(), retrieved.select(*keys).distinct()
    hits = truth.intersect(found).agg(F.count(F.lit(1)).alias("hits"))
    per = found.groupBy("pair", "source_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("sources"), F.avg("n").alias("mean_candidates"))
    return truth.agg(F.count(F.lit(1)).alias("gold")).crossJoin(hits).crossJoin(per).select("gold", "hits", ratio(F.col("hits"), F.col("gold")).alias("recall"), "sources", "mean_candidates")


def end_to_end(spark: SparkSession, candidates: DataFrame, gold: DataFrame, modes: Sequence[str], thresholds: Sequence[float] = evaluate.THRESHOLDS, fixed: Sequence[float] = (0.5, 0.7), min_votes: int = 2) -> DataFrame:
    """``kind``, ``mode``, ``pair``, ``threshold``, ``predicted``, ``tp``, ``gold``, ``f1``: the whole evaluation of scored candidates.

    ``candidates`` has pair, mode, source_id, target_id, score. Kinds: ``sweep`` (every threshold
    of every mode), ``fixed`` (the stated ones), ``loo`` (a mode's threshold chosen on the other
    pairs), ``joint`` (mode and threshold chosen together), ``mean`` (of the modes' loo F1),
    ``ensemble`` (matches of at least ``min_votes`` modes, at one threshold for all, chosen on the
    other pairs). A threshold is exclusive and comes before the one-to-one rule; as that rule
    takes candidates in falling order, one run gives the mapping of every threshold.
    """
    keys = ["pair", "source_id", "target_id"]
    keyed = candidates.filter(F.col("mode").isin(list(modes))).withColumn("pair", F.concat_ws(JOIN, "mode", "pair"))
    taken = assign.greedy_injective(spark, keyed)
    truth = gold.select(*keys).distinct()
    wide = truth.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).select(F.concat_ws(JOIN, "mode", "pair").alias("pair"), "source_id", "target_id")

    def swept(mapping: DataFrame, reference: DataFrame) -> DataFrame:
        hit = mapping.join(reference.withColumn("h", F.lit(1)), keys, "left")
        at = hit.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("score") > t)))
        n = at.groupBy("pair", "threshold").agg(F.count(F.lit(1)).alias("predicted"), F.count("h").alias("tp"))
        g = reference.groupBy("pair").agg(F.count(F.lit(1)).alias("gold"))
        every = g.select("pair").union(mapping.select("pair")).distinct().withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
        s = every.join(n, ["pair", "threshold"], "left").join(g, "pair", "left").select("pair", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("predicted", "tp", "gold")])
        return s.withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("gold")))

    def split(df: DataFrame) -> DataFrame:
        parts = F.split("pair", JOIN)
        return df.withColumn("mode", parts[0]).withColumn("pair", parts[1])

    single = split(swept(taken, wide))
    votes = split(taken).withColumn("t", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("score") > t)))
    votes = votes.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("k"), F.avg("score").alias("score")).filter(F.col("k") >= min_votes)
    agreed = assign.greedy_injective(spark, votes.select(F.concat_ws(JOIN, F.col("t").cast("string"), "pair").alias("pair"), "source_id", "target_id", "score"))
    agreed = agreed.select(F.split("pair", JOIN)[1].alias("pair"), "source_id", "target_id", F.split("pair", JOIN)[0].cast("double").alias("threshold"))
    hit = agreed.join(truth.withColumn("h", F.lit(1)), keys, "left").groupBy("pair", "threshold").agg(F.count(F.lit(1)).alias("predicted"), F.count("h").alias("tp"))
    g = truth.groupBy("pair").agg(F.count(F.lit(1)).alias("gold"))
    every = single.select("pair", "threshold").distinct()
    ens = every.join(hit, ["pair", "threshold"], "left").join(g, "pair", "left").select("pair", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("predicted", "tp", "gold")]).withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("gold")))

    columns = ["kind", "mode", "pair", "threshold", "predicted", "tp", "gold", "f1"]
    loo = selection.loo_threshold(single, ["mode"])
    joint = selection.loo_joint(single, modes).join(single.drop("f1"), ["pair", "mode", "threshold"])
    mean = loo.groupBy("pair").agg(F.avg("f1").alias("f1"))
    out = single.withColumn("kind", F.lit("sweep")).select(*columns)
    out = out.unionByName(single.filter(F.col("threshold").isin([float(x) for x in fixed])).withColumn("kind", F.lit("fixed")).select(*columns))
    out = out.unionByName(loo.withColumn("kind", F.lit("loo")).select(*columns)).unionByName(joint.withColumn("kind", F.lit("joint")).select(*columns))
    out = out.unionByName(mean.select(F.lit("mean").alias("kind"), F.lit("").alias("mode"), "pair", *[F.lit(None).cast(k).alias(c) for c, k in (("threshold", "double"), ("predicted", "bigint"), ("tp", "bigint"), ("gold", "bigint"))], "f1"))
    return out.unionByName(selection.loo_threshold(ens).withColumn("kind", F.lit("ensemble")).withColumn("mode", F.lit("")).select(*columns))


def rule_grid(spark: SparkSession, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """``rule``, ``pairs``, ``mean_f1``, ``mean_predictions`` of the assignment rules: argmax, dedupe, greedy, greedy at 0.5 and at 0.7."""
    clean = assign.clean(candidates)
    made = {
        "argmax": assign.per_source_best(clean), "dedupe": assign.dedupe_by_target(clean), "greedy": assign.greedy_injective(spark, clean),
        "greedy@0.5": assign.greedy_injective(spark, clean, 0.5), "greedy@0.7": assign.greedy_injective(spark, clean, 0.7),
    }
    out = None
    for rule, m in made.items():
        one = evaluate.evaluate(m, gold).agg(F.count(F.lit(1)).alias("pairs"), F.avg("f1").alias("mean_f1"), F.avg("predicted").alias("mean_predictions")).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out.select("rule", "pairs", "mean_f1", "mean_predictions")


def select_pairs(known: DataFrame, spec: str | None = None, stale: DataFrame | None = None) -> DataFrame:
    """``pair``, ``source``, ``target`` of the catalogue that are wanted: those of a spec, else the stale ones, else all; in the catalogue's direction.

    A spec lists pairs with commas, their names joined by -, :, ↔ or /, either way round. Names
    that the catalogue does not pair are left out.
    """
    if spec is not None:
        asked = [tuple(p.strip() for p in PAIR_MARK.split(x.strip(), maxsplit=1)) for x in spec.split(",") if PAIR_MARK.search(x)]
        wanted = known.sparkSession.createDataFrame([p for a in asked for p in (a, a[::-1])] or [("", "")], "source string, target string").distinct()
        return known.join(F.broadcast(wanted), ["source", "target"], "left_semi").select("pair", "source", "target")  # as many as the spec names
    if stale is not None:
        return known.join(stale.select("pair").distinct(), "pair", "left_semi").select("pair", "source", "target")
    return known.select("pair", "source", "target")


def first_folds(folds: DataFrame, n: int) -> DataFrame:
    """The first ``n`` folds by name, whole."""
    names = folds.select("fold").distinct().orderBy("fold").limit(n)
    return folds.join(names, "fold", "left_semi")


def training_union(real: DataFrame, *synthetic: DataFrame) -> DataFrame:
    """``origin``, ``source_id``, ``target_id``: labelled pairs and those of generated variants, each once, the real ones first."""
    out = real.select(F.lit(0).alias("origin"), "source_id", "target_id")
    for i, s in enumerate(synthetic):
        out = out.unionByName(s.select(F.lit(i + 1).alias("origin"), "source_id", "target_id"))
    return out.groupBy("source_id", "target_id").agg(F.min("origin").alias("origin")).select("origin", "source_id", "target_id")


def coverage(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: rows only the first has, rows only the second has, and whether they are equal or one holds the other (repeated rows count)."""
    a, b = first.exceptAll(second).agg(F.count(F.lit(1)).alias("only_first")), second.exceptAll(first).agg(F.count(F.lit(1)).alias("only_second"))
    x, y = F.col("only_first") == 0, F.col("only_second") == 0
    return a.crossJoin(b).select("only_first", "only_second", (x & y).alias("equal"), x.alias("first_in_second"), y.alias("second_in_first"))


def line_colour(confidence: Column) -> Column:
    """Hexadecimal colour of a mapping line: from red at 0 to green at 1."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))
    part = lambda x: F.lpad(F.hex(F.floor(x * 255).cast("bigint")), 2, "0")
    return F.concat(F.lit("#"), part(1 - c), part(c), F.lit("00"))


def sizes(nodes: DataFrame) -> DataFrame:
    """``tax``, ``nodes``: how many different nodes each taxonomy has."""
    return nodes.groupBy("tax").agg(F.countDistinct("node_id").alias("nodes"))


def request_counts(candidates: DataFrame) -> DataFrame:
    """``pair``, ``requests``: one for each source with a candidate."""
    return candidates.groupBy("pair").agg(F.countDistinct("source_id").alias("requests"))


def cached_means(records: DataFrame, *by: str) -> DataFrame:
    """Mean F1 and number of pairs by the given columns, the best first."""
    return records.groupBy(*by).agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("mean_f1"), *by)
