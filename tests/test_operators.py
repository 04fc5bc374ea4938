import math

import pytest
from conftest import rows

from crosslattice.functions import numbers, text
from crosslattice.operators import journal, neural, retrieval, selection, statistics, synth
from crosslattice.operators.identifiers import resolve_nodes, resolve_taxonomy
from crosslattice.runtime import lookup
from crosslattice.sources import owl, records
from pyspark.sql import functions as F


def test_bm25_against_plain_formula(spark):
    docs = {"d1": "a b a c", "d2": "b b d", "d3": "", "d4": "e f g h i j"}
    q = {"q1": "a b b", "q2": "zzz"}
    w = {k: v.lower().split() for k, v in docs.items()}
    n, mean = len(w), sum(map(len, w.values())) / len(w)
    df = {t: sum(t in x for x in w.values()) for x in w.values() for t in x}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * avg for t, v in idf.items()}
    want = {}
    for s, x in q.items():
        for d, y in w.items():
            v = sum(idf.get(t, 0) * y.count(t) * 2.5 / (y.count(t) + 1.5 * (0.25 + 0.75 * len(y) / mean)) for t in x.split() if t in y)
            if v > 0:
                want[s, d] = round(v, 6)
    got = retrieval.bm25_top_k(spark.createDataFrame(list(q.items()), "source_id string, text string"), spark.createDataFrame([*docs.items(), ("d5", None)][:4], "target_id string, text string"), 9)
    assert {(r.source_id, r.target_id): round(r.score, 6) for r in got.collect()} == want


def test_similarity_blocks_equal_one_block(spark):
    import random

    r = random.Random(3)
    v = [("p" if i % 3 else "q", f"v{i}", [r.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [("p", "nul", None), ("p", "zero", [0.0] * 4)]
    q = spark.createDataFrame(v[:10], "pair string, source_id string, vector array<double>")
    t = spark.createDataFrame(v[10:], "pair string, target_id string, vector array<double>")
    a, b = (rows(retrieval.similarity_top_k(q, t, 3, k).select("pair", "source_id", "target_id", "rank")) for k in (4, 4096))
    assert a == b and len(a) == 30


def test_hybrid_keeps_first_list_first(spark):
    s = "pair string, source_id string, target_id string, score double, rank int"
    a, b = spark.createDataFrame([("p", "s", "t1", 0.1, 1)], s), spark.createDataFrame([("p", "s", "t1", 9.0, 1), ("p", "s", "t2", 8.0, 2), ("p", "s", "t3", 7.0, 3)], s)
    assert rows(retrieval.hybrid_union(a, b, 2).select("target_id", "score", "rank")) == [("t1", 0.1, 1), ("t2", 8.0, 2)]


def test_label_matches_take_smallest_target(spark):
    s = spark.createDataFrame([("p", "s0", " Author"), ("p", "s1", ""), ("p", "s2", None)], "pair string, source_id string, name string")
    t = spark.createDataFrame([("p", "t2", "author"), ("p", "t1", "AUTHOR "), ("p", "t0", "")], "pair string, target_id string, name string")
    assert rows(retrieval.label_matches(s, t)) == [("p", "s0", "t1", 1.0)]


def test_description_blocks(spark):
    df = spark.createDataFrame([("N", ["a", "N"], {"k": "v", "b": None}, ["d"], "c"), ("M", ["M"], {}, [], "")], "n string, c array<string>, a map<string,string>, d array<string>, t string")
    full = text.description("full", F.col("n"), F.col("c"), F.col("a"), F.col("d"), F.col("t"))
    assert [r[0] for r in df.select(full).collect()] == ["Name: N\nPath: a -> N\nAttributes: b: , k: v\nDisjoint with: d\nComment: c", "Name: M"]
    c = text.concept_text("concept-parent", F.col("n"), F.col("c"), F.col("d"), F.col("a"), F.col("d"), F.col("t"))
    assert df.select(c).collect()[1][0] == "name m" and "parent chain a  n" in df.select(c).collect()[0][0]
    with pytest.raises(ValueError):
        text.description("other", *[F.col(x) for x in "ncadt"])


def test_number_predicate(spark):
    df = spark.createDataFrame([("1",), ("true",), ("null",), ('"0.9"',), ("-0.01",), ("1.01",), ("0.5",), ("{}",), ("x",)], "j string")
    assert [r[0] for r in df.select(numbers.finite_number(F.try_parse_json("j"), 0, 1)).collect()] == [True, False, False, False, False, False, True, False, False]


def test_loo_threshold_ignores_own_pair_and_takes_lowest(spark):
    d = [(p, t, f) for p, fs in {"a": (0.1, 0.9), "b": (0.5, 0.4), "c": (0.5, 0.5)}.items() for t, f in zip((0.0, 0.5), fs)]
    got = {r.pair: r.threshold for r in selection.loo_threshold(spark.createDataFrame(d, "pair string, threshold double, f1 double")).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.5}
    assert selection.loo_threshold(spark.createDataFrame(d[:2], "pair string, threshold double, f1 double")).count() == 0


def test_wilcoxon_and_holm(spark):
    diffs = spark.createDataFrame([("x", f"p{i}", 0.0, 0.0, d) for i, d in enumerate([0.1, 0.2, 0.3, 0.4, 0.5, -0.05])] + [("y", "p", 0.0, 0.0, 0.0)], "label string, pair string, a double, b double, diff double")
    w = {r.label: r for r in statistics.wilcoxon(diffs).collect()}
    assert w["x"].statistic == 1.0 and w["x"].p_value == 4 / 64 and w["y"].p_value == 1.0
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "label string, p_value double")
    assert {r.label: (round(r.p_holm, 6), round(r.p_bonferroni, 6)) for r in statistics.adjusted(t).collect()} == {"a": (0.03, 0.03), "c": (0.06, 0.09), "b": (0.06, 0.12)}


def test_responses(spark):
    good = '{"model": "m-1", "answers": {"candidate_0": {"type": "probability", "probability": %s}}, "usage": {"cost": %s}}'
    cases = [(good % ("0.5", "0"), None), (good % ("true", "0"), "invalid probability"), (good % ("1.01", "0"), "invalid probability"), (good % ('"0.9"', "0"), "invalid probability"), (good % ("0.5", "-1"), "no valid cost"), (good % ("0.5", "true"), "no valid cost"), ("[]", "not an object"), ('{"model": "z"}', "unexpected model"), ('{"model": "m", "answers": {}}', "answers do not cover the candidates"), (None, "not an object")]
    df = spark.createDataFrame([(c[0], ["t"]) for c in cases], "r string, c array<string>")
    assert [r[0] for r in df.select(journal.response_error(F.col("r"), F.col("c"), "m")).collect()] == [c[1] for c in cases]


def test_requests_and_resume(spark):
    c = spark.createDataFrame([("p", "s", "t1", 2), ("p", "s", "t0", 1)], "pair string, source_id string, target_id string, rank int")
    t = spark.createDataFrame([("s", "S"), ("t0", "T0"), ("t1", "T1")], "node_id string, text string")
    r = journal.requests(c, t, "m").collect()[0]
    assert r.candidate_ids == ["t0", "t1"] and '"source":"S"' in r.request and '"candidate_1"' in r.request
    expected = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c")], "key string, request string")
    j = spark.createDataFrame([("k1", "a", 200, None), ("k1", "a", 200, None), ("k2", "x", 200, None), ("k3", "c", 500, "down")], "key string, request string, status_code int, error string")
    assert rows(journal.missing(expected, j)) == [("k3",)]
    assert rows(journal.integrity_errors(expected, j)) == [("k1", "repeated success"), ("k2", "request changed")]
    done = journal.collect(expected, lambda q: (200, q.upper(), None) if q != "b" else 1 / 0, 2)
    assert {(x.key, x.response, x.error is None) for x in done.collect()} == {("k1", "A", True), ("k2", None, False), ("k3", "C", True)}


def test_budget_stops_in_order(spark):
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate([1.0, None, 2.0, 3.0])], "p string, i int, c double")
    assert [r.i for r in journal.within_budget(df, "p", ["i"], "c", 3.0).orderBy("i").collect()] == [0, 1, 2]


def test_identifiers(spark):
    tax = spark.createDataFrame([("Abc", "abc", "http://ABC.invalid")], "tax string, short string, namespace string")
    refs = spark.createDataFrame([(x,) for x in (" ABC\t", "data/abc.OWL", "http://abc.invalid#", "<http://abc.invalid>", "other", None, " ")], "x string")
    assert [r.y for r in resolve_taxonomy(refs, "x", tax, "y").collect()].count("abc") == 4
    ids = spark.createDataFrame([(x,) for x in (" abc#N\n", "<http://abc.invalid#N>", "http://ABC.invalid/N", "http://abc.invalid#N", "", None)], "x string")
    assert sorted(str(r.y) for r in resolve_nodes(ids, "x", tax, "y").collect()) == ["None", "None", "abc#N", "abc#N", "abc#N", "abc#N"]


def test_lookup_of_hot_keys_equals_a_join(spark):
    left = spark.createDataFrame([(k, i) for k in ("hot", "cold", None, "gone") for i in range(30 if k == "hot" else 3)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    for how in ("left", "inner"):
        assert rows(lookup(left, right, "k", how, hot_rows=10)) == rows(left.join(right, "k", how))


OWL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://x">
<owl:Class rdf:ID="Top_node"><rdfs:label>Top</rdfs:label></owl:Class>
<owl:Class rdf:about="#Low_node"><rdfs:subClassOf><owl:Class rdf:ID="Mid"><rdfs:subClassOf rdf:resource="#Top_node"/></owl:Class></rdfs:subClassOf><owl:disjointWith rdf:resource="#Top_node"/>
<owl:equivalentClass><owl:Restriction><owl:onProperty rdf:resource="#has"/><owl:hasValue>3</owl:hasValue></owl:Restriction></owl:equivalentClass></owl:Class></rdf:RDF>"""
RDFX = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://a#"><Alignment>
<map><Cell><entity1 rdf:resource="http://x#Mid"/><entity2 rdf:resource="http://y#A"/><measure>1.0</measure><relation>=</relation></Cell></map>
<map><Cell><entity1 rdf:resource="http://x#Mid"/><entity2 rdf:resource="http://y#B"/><measure>1.0</measure><relation>=</relation></Cell></map>
<map><Cell><entity1 rdf:resource="http://x#prop"/><entity2 rdf:resource="http://y#q"/><measure>1.0</measure><relation>=</relation></Cell></map></Alignment></rdf:RDF>"""


def test_owl_and_alignment_files(spark, tmp_path):
    (tmp_path / "x.owl").write_text(OWL)
    (tmp_path / "bad.owl").write_text("<no")
    got = owl.read_owl(spark, str(tmp_path / "*.owl"))
    assert rows(got["nodes"].select("node_id", "name", "attributes")) == [("x#Low_node", "Low node", {"has": "3"}), ("x#Mid", "Mid", {}), ("x#Top_node", "Top", {})]
    assert rows(got["edges"].select("child_id", "parent_id")) == [("x#Low_node", "x#Mid"), ("x#Mid", "x#Top_node")]
    assert rows(got["disjoint"].select("node_id", "other_id")) == [("x#Low_node", "x#Top_node")]
    (tmp_path / "x-y.rdf").write_text(RDFX)
    cells = owl.read_alignment(spark, str(tmp_path / "*.rdf"))
    other = spark.createDataFrame([("y", "y#A", 0), ("y", "y#B", 1)], "tax string, node_id string, ord int")
    nodes = got["nodes"].select("tax", "node_id", "ord").unionByName(other)
    assert rows(owl.build_alignment(cells, nodes, "x", "y").select("source_id", "target_id")) == [("x#Mid", "y#B")]


def test_json_files_and_orientation(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"name": "x", "nodes": {"x#a": {"id": "x#a", "name": "A", "parents": ["x#b"]}, "x#b": {"id": "x#b", "name": "B"}}}')
    t = records.read_taxonomies(spark, str(tmp_path / "t.json"))
    assert t["nodes"].count() == 2 and rows(t["edges"].select("child_id", "parent_id")) == [("x#a", "x#b")]
    (tmp_path / "al.json").write_text('[{"source": "x", "target": "a", "matches": [{"source_id": "x#a", "target_id": "a#z"}]}]')
    a = records.read_alignments(spark, str(tmp_path / "al.json"))
    assert rows(a.select("pair", "confidence")) == [("a↔x", 1.0)]
    want = spark.createDataFrame([("a", "x")], "source string, target string")
    assert rows(records.find_gold(want, a).select("source_id", "target_id")) == [("a#z", "x#a")]
    (tmp_path / "gnn").mkdir()
    (tmp_path / "gnn" / "r.json").write_text('{"approach": "other", "pair": "a↔x", "source": "x", "target": "a", "f1": 0.5, "match_pairs": [{"source_id": "x#a", "target_id": "a#z"}]}')
    r = records.read_records(spark, str(tmp_path / "gnn"))
    assert r.collect()[0].approach == "gnn" and records.record_matches(r).count() == 1
    canon = spark.createDataFrame([("a↔x", "a", "x")], "pair string, source string, target string")
    assert records.misoriented(r, canon).count() == 1
    with pytest.raises(Exception, match="turned"):
        records.assert_oriented(r, canon).collect()
    records.write_records(r, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_synthetic_variants_change_what_they_must(spark):
    n = spark.createDataFrame([("x", "x#r", "Root", "", 0, {}), ("x", "x#m", "Paper", "", 1, {"hasTime": "1", "k": "2"}), ("x", "x#l", "Regular Author", "", 2, {})], "tax string, node_id string, name string, comment string, depth int, attributes map<string,string>")
    e = spark.createDataFrame([("x", "x#m", "x#r", 0), ("x", "x#l", "x#m", 0)], "tax string, child_id string, parent_id string, ord int")
    d = lambda v: synth.content_differences(n, v).collect()[0]
    assert d(synth.exact(n, e)[0])[1:] == (0, 0, 0, 0, 0)
    v, _ = synth.synonym(n, e)
    assert d(v).names == 2 and sorted(r.name for r in v.collect()) == ["Article", "Regular Writer", "Root"]
    v, edges = synth.structural(spark, n, e)
    assert d(v).depths == 1 and rows(edges.select("child_id", "parent_id")) == [("x#l_STR", "x#r_STR"), ("x#m_STR", "x#r_STR")]
    assert d(synth.attributes(n, e)[0]).attributes >= 2
    assert synth.gold(v).count() == 3


def test_network_learns_to_tell_pairs(spark):
    import numpy as np

    r = np.random.default_rng(0)
    a = r.standard_normal((40, 8))
    pairs = spark.createDataFrame([(x.tolist(), (x + 0.05 * r.standard_normal(8)).tolist()) for x in a], "a array<double>, b array<double>")
    w = neural.train_linear(pairs, 8)
    p = (a @ w) / np.linalg.norm(a @ w, axis=1, keepdims=True)
    s = p @ p.T
    assert s.diagonal().min() > 0.99 and abs(s[~np.eye(40, dtype=bool)]).mean() < 0.5
    f = neural.folds(spark.createDataFrame([("a↔b", "a", "b"), ("a↔c", "a", "c"), ("b↔c", "b", "c")], "pair string, source string, target string"), "taxonomy")
    assert f.filter("role = 'test'").count() == 6


def test_folds_of_many_pairs_are_whole_and_small_once_written(spark, tmp_path):
    n = 2500
    name = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20)
    neural.folds(spark.range(n).select(name.alias("pair"), F.lit("a").alias("source"), F.lit("b").alias("target"))).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    per = f.groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("pair").alias("pairs"), F.count_if(F.expr("role = 'test' and pair = fold")).alias("held"), F.count_if(F.expr("role = 'train'")).alias("kept"))
    assert per.count() == n and per.filter(f"rows <> {n} or pairs <> {n} or held <> 1 or kept <> {n - 1}").count() == 0
    assert sum(x.stat().st_size for x in (tmp_path / "f").glob("*.parquet")) < 0.4 * n * n


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 40])
def test_folds_at_the_edges_of_tasks(spark, monkeypatch, n):
    for k, v in (("FOLDS", 4), ("PAIRS", 6), ("RUN", 3)):
        monkeypatch.setattr(neural, k, v)
    names = [None, *(f"p{i}" for i in range(n))][:n]
    f = neural.folds(spark.createDataFrame([(x, "a", "b") for x in names], "pair string, source string, target string"))
    assert rows(f) == sorted([(a, b, "test" if a and a == b else "train") for a in names for b in names], key=repr)
    assert all(r.folds <= 4 and r.pairs <= 6 for r in f.groupBy(F.spark_partition_id()).agg(F.count_distinct("fold").alias("folds"), F.count_distinct("pair").alias("pairs")).collect())


def test_stream_drops_repeats_and_resumes(spark, tmp_path):
    from crosslattice.streaming import journal as s

    schema = "key string, ts timestamp, v double"
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 2, 2.0)], "key string, s int, v double").select("key", F.timestamp_seconds("s").alias("ts"), "v")
    df.write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: s.run_available(s.deduplicated(s.read_stream(spark, str(tmp_path / "in"), schema), "key", "ts", "1 day").select("key"), str(tmp_path / "out"), str(tmp_path / "ck"))
    go()
    df.withColumn("key", F.concat("key", F.lit("2"))).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a",), ("a2",), ("b",), ("b2",)]
    batch = s.windowed_accounting(df, "ts", "1 day", "1 hour", "key", "v")
    assert rows(batch.select("key", "n", "total")) == [("a", 2, 2.0), ("b", 1, 2.0)]


def test_bootstrap_runs_ten_thousand_rounds(spark):
    import numpy as np

    from crosslattice.operators import statistics

    diffs = [0.1, -0.3, 0.25, 0.4, -0.05, 0.7, 0.02]
    got = statistics.bootstrap(spark.createDataFrame([("m", f"p{i}", x) for i, x in enumerate(diffs)], "label string, pair string, diff double")).first()
    means = []
    for round_ in range(10_000):
        draws = []
        for j in range(len(diffs)):
            x = (20260601 + round_ * 7919 + j * 104729) % statistics.LCG_M
            for _ in range(2):
                x = (x * statistics.LCG_A + statistics.LCG_C) % statistics.LCG_M
            draws.append(diffs[(x >> 8) % len(diffs)])
        means.append(sum(draws) / len(diffs))
    assert np.allclose([got.ci_low, got.ci_high], np.percentile(means, [2.5, 97.5]), atol=1e-9)


def test_bootstrap_does_not_copy_the_differences_for_each_round(spark):
    import numpy as np

    r = np.random.default_rng(2)
    made = {"a": r.standard_normal(3000), "b": r.standard_normal(1)}
    df = spark.createDataFrame([(k, f"p{i:05d}", float(x)) for k, v in made.items() for i, x in enumerate(v)], "label string, pair string, diff double")
    got = statistics.bootstrap(df, 500)
    plan = got._jdf.queryExecution().toString()
    assert "sequence(0, 499" not in plan and "MapInArrow" in plan
    j = np.arange(3000)
    for row in got.collect():
        d, means = made[row.label], []
        for round_ in range(500):
            x = (20260601 + round_ * 7919 + j[: len(d)] * 104729) % statistics.LCG_M
            for _ in range(2):
                x = (x * statistics.LCG_A + statistics.LCG_C) % statistics.LCG_M
            means.append(d[(x >> 8) % len(d)].mean())
        assert np.allclose([row.ci_low, row.ci_high], np.percentile(means, [2.5, 97.5]), atol=1e-9)
