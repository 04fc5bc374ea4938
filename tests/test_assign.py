import random

import pytest
from conftest import rows

from crosslattice.operators import assign, evaluate

C = "pair string, source_id string, target_id string, score double"


def cand(spark, items, pair="p"):
    return spark.createDataFrame([(pair, *x) for x in items], C)


def ids(df):
    return sorted((r.source_id, r.target_id) for r in df.collect())


FOUR = [("s0", "t0", 0.9), ("s0", "t1", 0.8), ("s2", "t2", 0.95), ("s2", "t3", 0.85)]


def test_greedy_takes_in_order(spark):
    assert ids(assign.greedy_injective(spark, cand(spark, FOUR))) == [("s0", "t0"), ("s2", "t2")]


def test_greedy_ties_do_not_depend_on_input_order(spark):
    items = [(s, t, 0.9) for s in ("s0", "s1") for t in ("t0", "t1")]
    for seed in range(3):
        random.Random(seed).shuffle(items)
        assert ids(assign.greedy_injective(spark, cand(spark, items))) == [("s0", "t0"), ("s1", "t1")]


def test_greedy_threshold(spark):
    assert ids(assign.greedy_injective(spark, cand(spark, [("s0", "t0", 0.4), ("s1", "t1", 0.8)]), 0.5)) == [("s1", "t1")]


def test_best_dedupe_greedy_differ(spark):
    c = cand(spark, [("s0", "t0", 0.9), ("s1", "t0", 0.85), ("s1", "t1", 0.84)])
    assert ids(assign.dedupe_by_target(c)) == [("s0", "t0")]
    assert ids(assign.greedy_injective(spark, c)) == [("s0", "t0"), ("s1", "t1")]
    assert ids(assign.per_source_best(c)) == [("s0", "t0"), ("s1", "t0")]


def brute(items):
    used_s, used_t, out = set(), set(), set()
    for p, s, t, _ in sorted(items, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (p, s) not in used_s and (p, t) not in used_t:
            used_s.add((p, s))
            used_t.add((p, t))
            out.add((p, s, t))
    return out


@pytest.mark.parametrize("limit", [1, 10_000])
def test_greedy_rounds_equal_one_pass(spark, limit):
    r = random.Random(5)
    items = list({(p, f"s{r.randrange(9)}", f"t{r.randrange(9)}"): r.choice([0.5, 0.7, 0.9]) for p in ("a", "b") for _ in range(50)}.items())
    items = [(*k, v) for k, v in items]
    got = assign.greedy_injective(spark, spark.createDataFrame(items, C), 0.0, limit)
    assert {(x.pair, x.source_id, x.target_id) for x in got.collect()} == brute(items)


def test_null_blank_nan_candidates_do_not_count(spark):
    items = [("s0", None, 0.9), (None, "t", 0.9), ("s1", " ", 0.9), ("s2", "t2", None), ("s3", "t3", float("nan")), ("s4", "t4", 0.1)]
    assert ids(assign.greedy_injective(spark, cand(spark, items))) == [("s4", "t4")]
    assert ids(assign.greedy_injective(spark, cand(spark, []))) == []


def test_votes_and_means(spark):
    C1 = [("s0", "t0", 0.9), ("s0", "t1", 0.8), ("s1", "t2", 0.95)]
    CP, CC = [("s0", "t0", 0.7), ("s1", "t3", 0.6)], [("s0", "t0", 0.5), ("s1", "t2", 0.4)]
    df = spark.createDataFrame([("p", *x, m) for m, xs in (("C", C1), ("CP", CP), ("CC", CC)) for x in xs], C + ", mode string")
    got = {(r.source_id, r.target_id): round(r.score, 6) for r in assign.votes(df).collect()}
    assert got == {("s0", "t0"): 0.7, ("s1", "t2"): 0.675}
    assert [(r.source_id, r.target_id) for r in assign.votes(df, 3).collect()] == [("s0", "t0")]


def test_judged_cut_is_strict_and_keeps_sources(spark):
    j = spark.createDataFrame([("p", "s0", "t0", 0.9, True), ("p", "s1", "t1", 0.7, True), ("p", "s2", "t2", 0.99, False), ("p", "s3", None, None, None)], "pair string, source_id string, candidate_id string, confidence double, is_match boolean")
    assert {(r.source_id, r.target_id) for r in assign.judged(spark, j).collect()} == {("s0", "t0"), ("s1", ""), ("s2", ""), ("s3", "")}


G = "pair string, source_id string, target_id string"


def test_evaluate_example(spark):
    gold = spark.createDataFrame([("p", f"s{i}", f"t{i}") for i in range(4)], G)
    pred = cand(spark, [("s0", "t0", 0.9), ("s1", "t1", 0.8), ("s2", "tX", 0.7), ("sX", "t3", 0.6)])
    r = evaluate.evaluate(pred, gold).collect()[0]
    assert (r.tp, r.precision, r.recall, r.f1) == (2, 0.5, 0.5, 0.5)


def test_evaluate_zero_cases(spark):
    gold = spark.createDataFrame([("p", "s0", "t0")], G)
    r = evaluate.evaluate(cand(spark, []), gold).collect()[0]
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    r = evaluate.evaluate(cand(spark, [("s0", "t0", 0.9)]), spark.createDataFrame([], G)).collect()[0]
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_pooled_sweep_example(spark):
    gold = spark.createDataFrame([("a", "s0", "t0")] + [("b", f"s{i}", f"t{i}") for i in range(4)], G)
    pred = spark.createDataFrame([("a", "s0", "t0", 0.9), ("a", "sX", "tX", 0.6), ("b", "s0", "t0", 0.9), ("b", "s1", "t1", 0.6)], C)
    sweep = evaluate.threshold_sweep(pred, gold)
    at = {t: evaluate.summarise(sweep.filter(f"threshold = {t}")).collect()[0] for t in (0.0, 0.7, 0.99)}
    assert (at[0.0].pooled_precision, at[0.0].pooled_recall) == (0.75, 0.6)
    assert (at[0.7].pooled_precision, at[0.7].pooled_recall) == (1.0, 0.4)
    assert (at[0.99].pooled_precision, at[0.99].pooled_recall) == (0.0, 0.0)


def test_calibration_example(spark):
    s = spark.createDataFrame([(1.0, True), (0.5, False), (0.0, False)], "p double, y boolean")
    r = evaluate.calibration(s, "p", "y").collect()[0]
    assert (round(r.brier, 6), round(r.ece, 6), round(r.prevalence, 6)) == (round(1 / 12, 6), round(1 / 6, 6), round(1 / 3, 6))
    bins = {b.bin: b for b in evaluate.reliability_bins(s, "p", "y").collect()}
    assert bins[9].mean_probability == 1 and bins[5].positives == 0 and bins[1].mean_probability is None


def test_mapping_changes_full_outer(spark):
    a = spark.createDataFrame([("p", "s0", "t0"), ("p", "s1", "t1")], G)
    b = spark.createDataFrame([("p", "s0", "t0"), ("p", "s2", "t2")], G)
    assert rows(assign.mapping_changes(a, b).select("source_id", "old_target", "new_target")) == [("s1", "t1", ""), ("s2", "", "t2")]
