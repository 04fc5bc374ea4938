"""Percentiles, strict pairs, resumable collection, sources written and read back, search in blocks, the trained network."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from crosslattice.operators import graph, journal, neural, retrieval, statistics, study, synth
from crosslattice.sources import owl, records


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_exact_percentiles(spark, bins):
    r = random.Random(bins)
    data = [(g, r.choice([r.random() * 9, 3.0, None, float("nan")])) for g in ("a", "b", None) for _ in range(200)] + [("one", 5.0), ("none", None)]
    got = {(x.g, x.p): x.x for x in statistics.exact_percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", (0.0, 0.5, 0.9, 1.0), bins).collect()}
    for g in ("a", "b", None, "one"):
        v = [x for k, x in data if k == g and x is not None and x == x]
        for p in (0.0, 0.5, 0.9, 1.0):
            assert got[g, p] == pytest.approx(np.quantile(v, p))
    assert len(got) == 16


def test_strict_pairs_raise(spark):
    s = spark.createDataFrame([("x", "p", 0.5), ("y", "p", 0.25), ("x", "q", 0.5)], "config string, pair string, f1 double")
    c = spark.createDataFrame([("l", "x", "y")], "label string, first string, second string")
    assert rows(statistics.paired(s, c).select("pair", "diff")) == [("p", 0.25)]
    assert rows(statistics.paired(s.filter("pair = 'p'"), c, True).select("pair", "diff")) == [("p", 0.25)]
    with pytest.raises(Exception, match="one side has no q"):
        statistics.paired(s, c, True).collect()


def test_unknown_costs_are_charged_at_the_most(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([1.0, None, float("nan"), -3.0, 0.5])], "i int, c double")
    got = journal.within_budget(df.withColumn("p", F.lit(1)), "p", ["i"], "c", 7.0, 2.0).orderBy("i").collect()
    assert [(r.i, r.spent) for r in got] == [(0, 1.0), (1, 3.0), (2, 5.0), (3, 7.0)]


def test_collection_goes_on_where_it_stopped(spark, tmp_path):
    expected = spark.createDataFrame([(f"k{i}", f"r{i}") for i in range(9)], "key string, request string")
    good = lambda r: (200, '{"cost": 0.5}', None)
    cost = lambda c: F.get_json_object(c, "$.cost").cast("double")
    path = str(tmp_path / "journal")
    out = journal.collect_all(spark, path, expected, good, cost, 1.0, 3.0, batch=2)
    assert out == {"done": 4, "left": 5, "charged": 2.0, "stopped": "budget"}
    out = journal.collect_all(spark, path, expected, lambda r: (500, None, "broken") if r == "r5" else good(r), cost, 1.0, 100.0, batch=3)
    assert out["stopped"] == "error" and out["done"] == 6 and out["left"] == 3
    assert journal.collect_all(spark, path, expected, good, cost, 1.0, 100.0)["left"] == 0
    with pytest.raises(ValueError, match="request changed"):
        journal.replay(spark, path, expected.withColumn("request", F.lit("x")))
    assert journal.collect_all(spark, str(tmp_path / "none"), expected.limit(0), good, cost, 1.0, 1.0)["done"] == 0


def test_frozen_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    read = lambda: journal.fingerprints(spark.read.format("binaryFile").load(str(tmp_path / "in")))
    expected = spark.createDataFrame([("k", "r")], "key string, request string")
    at = str(tmp_path / "frozen")
    assert journal.frozen(spark, expected, read(), at).count() == 1 == journal.frozen(spark, expected, read(), at).count()
    with pytest.raises(ValueError, match="other requests"):
        journal.frozen(spark, expected.limit(0), read(), at)
    (tmp_path / "in" / "a.txt").write_text("two")
    with pytest.raises(ValueError, match="inputs have changed"):
        journal.frozen(spark, expected, read(), at)


def test_ten_alignments_written_are_ten_read(spark, tmp_path):
    m = spark.createDataFrame([(f"s{i}", f"t{i}", f"a{j}", f"b{j}", 0.5) for i in range(10) for j in range(2)], "source string, target string, source_id string, target_id string, confidence double")
    records.write_alignments(m.repartition(1), str(tmp_path / "al"))
    back = records.read_alignments(spark, str(tmp_path / "al"))
    assert back.select("source").distinct().count() == 10 and back.count() == 20
    (tmp_path / "list.json").write_text(json.dumps([{"source": "x", "target": "y", "matches": [{"source_id": "1", "target_id": "2"}]}] * 3, indent=1))
    assert records.read_alignments(spark, str(tmp_path / "list.json")).count() == 3


def test_records_and_scan(spark, tmp_path):
    r = spark.createDataFrame([("a", f"p{i}", "m", i / 10) for i in range(5)] + [("b", "p0", None, 0.5)], "approach string, pair string, mode string, f1 double")
    records.write_records_json(r.repartition(1), str(tmp_path / "r"))
    assert rows(records.read_records(spark, str(tmp_path / "r")).select("approach", "pair", "mode", "f1")) == rows(r)
    assert records.read_records(spark, str(tmp_path / "r"), "p0").count() == 2
    scan = {x.folder: (x.files, list(x["values"])) for x in records.disk_scan(spark, str(tmp_path / "r"), "pair").collect()}
    assert scan == {"approach=a": (1, ["p0", "p1", "p2", "p3", "p4"]), "approach=b": (1, ["p0"])}


def test_track_with_missing_files(spark, tmp_path):
    head = '<rdf:RDF xml:base="http://t" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    for t in ("a", "b"):
        (tmp_path / f"{t}.owl").write_text(head + '<owl:Class rdf:ID="x"/><owl:Class rdf:ID="y"/></rdf:RDF>')
    cells = "".join(f'<map><Cell><entity1 rdf:resource="http://b#{x}"/><entity2 rdf:resource="http://a#{y}"/><measure>1.0</measure></Cell></map>' for x, y in (("x", "y"), ("y", "gone")))
    (tmp_path / "b-a.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><Alignment>' + cells + "</Alignment></rdf:RDF>")
    found, reference, gone = owl.read_track(spark, str(tmp_path), ["a", "b", "c"])
    assert found["nodes"].count() == 4 and rows(gone) == [("a-c.rdf",), ("b-c.rdf",), ("c.owl",)]
    assert rows(reference.select("source", "target", "source_id", "target_id")) == [("b", "a", "b#x", "a#y")]


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_against_brute_force(spark, block):
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (60, 5)).astype(float)
    df = spark.createDataFrame([("p" if i % 3 else "q", f"{i:02}", v[i].tolist()) for i in range(60)] + [("p", "99", None)], "pair string, id string, vector array<double>").repartition(4)
    got = retrieval.similarity_top_k(df.filter("id % 5 = 0").withColumnRenamed("id", "source_id"), df.withColumnRenamed("id", "target_id"), 3, block)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = set()
    for i in range(0, 60, 5):
        near = sorted((-round(float(unit[i] @ unit[j]), 9) + 0.0, f"{j:02}") for j in range(60) if j != i and (j % 3 == 0) == (i % 3 == 0))
        want |= {(f"{i:02}", t, k + 1) for k, (_, t) in enumerate(near[:3])}
    assert {(x.source_id, x.target_id, x["rank"]) for x in got.collect()} == want
    assert retrieval.similarity_top_k(df.limit(0).withColumnRenamed("id", "source_id"), df.withColumnRenamed("id", "target_id"), 3).count() == 0


def test_no_cross_join_in_the_search(spark):
    df = spark.createDataFrame([("p", "a", [1.0, 0.0])], "pair string, id string, vector array<double>")
    plan = retrieval.similarity_top_k(df.withColumnRenamed("id", "source_id"), df.withColumnRenamed("id", "target_id"), 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bm25_in_blocks_is_the_same(spark):
    r = random.Random(2)
    q = spark.createDataFrame([(f"q{i}", " ".join(r.choices("abcdefgh", k=4))) for i in range(9)] + [("e", ""), ("n", None)], "source_id string, text string")
    d = spark.createDataFrame([(f"d{i}", " ".join(r.choices("abcdefghij", k=r.randrange(1, 12)))) for i in range(40)] + [("n", None)], "target_id string, text string")
    a, b = (rows(retrieval.bm25_top_k(q, d, 3, block)) for block in (2, 4096))
    assert a == b and len(a) > 9
    assert retrieval.bm25_top_k(q.limit(0), d, 3).count() == 0


def test_pairs_are_selected(spark):
    known = spark.createDataFrame([("a↔b", "b", "a"), ("c↔d", "c", "d"), ("e↔f", "e", "f")], "pair string, source string, target string")
    assert rows(study.select_pairs(known, "a-b, d / c, x:y").select("pair")) == [("a↔b",), ("c↔d",)]
    assert study.select_pairs(known).count() == 3 and study.select_pairs(known, "").count() == 0
    assert rows(study.select_pairs(known, stale=known.filter("pair = 'e↔f'")).select("pair")) == [("e↔f",)]


def test_variants_check_themselves(spark):
    n = spark.createDataFrame([("t", "t#a", "Paper author", "c", 0, {"hasTitle": "x"}, 0), ("t", "t#b", "thing", "", 1, {}, 1), ("t", "t#c", "leaf", "", 2, {}, 2)], "tax string, node_id string, name string, comment string, depth int, attributes map<string,string>, ord int")
    e = spark.createDataFrame([("t", "t#b", "t#a", 0), ("t", "t#c", "t#b", 0)], "tax string, child_id string, parent_id string, ord int")
    got = {r.scenario: r for r in synth.checked(n, synth.scenarios(spark, n, e)).collect()}
    assert all(r.gold == 3 and r.missing == 0 and r.unique_ids for r in got.values())
    assert (got["V1"].names, got["SYN"].names, got["STR"].depths) == (0, 1, 1) and got["ATTR"].attributes >= 1


def test_network_learns_and_is_kept(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.standard_normal((80, 12))
    noise = 0.6 * r.standard_normal((80, 12))
    one = lambda v: {"vector": v.tolist(), "around": v[::-1].tolist()}
    kind = "struct<vector:array<double>,around:array<double>>"
    pairs = spark.createDataFrame([(one(a), one(a + b)) for a, b in zip(x, noise)], f"a {kind}, b {kind}")

    def gap(net):
        layer, out = net
        p, q = ((lambda y: y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12))(layer(v, v[:, ::-1]) @ out) for v in (x, x + noise))
        c = p @ q.T
        return float(np.diag(c).mean() - (c.sum() - np.trace(c)) / (80 * 79))

    before, after = (neural.train_network(pairs, 8, 6, epochs=k) for k in (0, 150))
    assert gap(after) > gap(before) + 0.1
    neural.save_network(str(tmp_path / "n.npz"), after)
    assert np.array_equal(neural.load_network(str(tmp_path / "n.npz"))[1], after[1])
    assert neural.train_network(pairs.limit(0))[1].shape == (32, 16)


def test_orphans_and_reachable(spark):
    n = spark.createDataFrame([("t", x) for x in "abxyq"], "tax string, node_id string")
    e = spark.createDataFrame([("t", "b", "a"), ("t", "x", "y"), ("t", "y", "x"), ("t", "q", "gone")], "tax string, child_id string, parent_id string")
    assert [r.node_id for r in graph.orphans(spark, n, e).orderBy("node_id").collect()] == ["q", "x", "y"]


def test_network_trains_on_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neural, "MAX_PAIRS", 5)
    r = np.random.default_rng(4)
    x = r.standard_normal((40, 6))
    one = lambda v: {"vector": v.tolist(), "around": v[::-1].tolist()}
    kind = "struct<vector:array<double>,around:array<double>>"
    df = lambda at: spark.createDataFrame([(one(x[i]), one(x[i] + 0.1)) for i in at], f"a {kind}, b {kind}")
    whole = neural.train_network(df(range(40)), 4, 3, epochs=3)
    again = neural.train_network(df(reversed(range(40))).repartition(7), 4, 3, epochs=3)
    assert np.array_equal(whole[1], again[1])
    for i in (0, 17, 39):  # every pair counts
        assert not np.array_equal(whole[1], neural.train_network(df([j for j in range(40) if j != i]), 4, 3, epochs=3)[1])
    b = [pa.RecordBatch.from_arrays([pa.array([0] * 3 + [1] * 9), *[pa.array(r.standard_normal((12, 2)).tolist())] * 4], names=["part", "av", "an", "bv", "bn"])]
    monkeypatch.setattr(neural, "BLOCK", 4)
    assert [(int(p), k, len(m[0])) for p, k, m in neural._blocks(b)] == [(0, 0, 3), (1, 0, 4), (1, 1, 4), (1, 2, 1)]


def test_neighbour_vectors_sum_places(spark):
    adj = spark.createDataFrame([("t", "x", "x", 0.5), ("t", "x", "y", 2.0), ("t", "y", "y", 1.0)], "tax string, i string, j string, w double")
    f = spark.createDataFrame([("t", "x", [1.0, 2.0]), ("t", "y", [3.0, -1.0])], "tax string, node_id string, vector array<double>")
    got = neural.neighbour_vectors(adj, f)
    assert {r.node_id: (r.vector, r.around) for r in got.collect()} == {"x": ([1.0, 2.0], [6.5, -1.0]), "y": ([3.0, -1.0], [3.0, -1.0])}
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_similarity_within_pairs(spark):
    r = np.random.default_rng(5)
    v = np.round(r.standard_normal((60, 3)))  # many equal scores
    q = spark.createDataFrame([(f"p{i % 2}", f"s{i}", x.tolist()) for i, x in enumerate(v)], "pair string, source_id string, vector array<double>")
    t = spark.createDataFrame([(f"p{i % 2}", f"t{i}", x.tolist()) for i, x in enumerate(v[::-1])], "pair string, target_id string, vector array<double>")
    want = sorted(map(tuple, retrieval.similarity_top_k(q, t, 4).select("pair", "source_id", "target_id", "score", "rank").collect()))
    for block in (1000, 7):
        assert sorted(map(tuple, retrieval.similarity_within(q, t, 4, block).select("pair", "source_id", "target_id", "score", "rank").collect())) == want
