import json

from conftest import rows

from crosslattice.operators import drift

R = "row_id bigint, stream string, batch bigint, payload string, field string"


def table(spark, batches, stream="s"):
    out = []
    for b, recs in batches.items():
        out += [(len(out) + i, stream, b, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for i, r in enumerate(recs)]
    return spark.createDataFrame(out, R)


def changes(spark, batches):
    df = drift.schema_changes(table(spark, batches), "stream", "batch", "payload")
    return rows(df.select("batch", "field", "change"))


def test_each_kind(spark):
    one = [{"source": f"abcd{chr(97 + i)}xyz", "f1": 0.1 * i + 0.013, "rule": ["greedy", "sort"][i % 2], "n": i} for i in range(8)]
    two = [{"src": f"qrst{chr(97 + i)}uvw", "f1": str(0.1 * i + 0.013), "rule": ["sort", "greedy"][i % 2], "extra": {"a": 1}} for i in range(8)]
    assert changes(spark, {1: one, 5: two}) == [(5, "extra", "added"), (5, "f1", "retyped"), (5, "n", "removed"), (5, "src", "renamed")]


def test_unlike_content_is_no_renaming(spark):
    one, two = [{"model": x} for x in ("base", "large", "base", "mini")], [{"score": x / 7} for x in range(4)]
    assert changes(spark, {1: one, 2: two}) == [(2, "model", "removed"), (2, "score", "added")]


def test_dirty_payloads(spark):
    ok = [{"a": 1}, {"a": 2}, {"a": "odd"}, {"a": None}]
    assert changes(spark, {1: [*ok, "HTTP 502", "", None, "null", "[1]", '{"a": 1'], 2: ok, 3: ["x"], 4: ok}) == [(3, "a", "removed"), (4, "a", "added")]
    assert changes(spark, {1: [None]}) == []


def test_sides_are_not_mixed_up(spark):
    one = [{"source": f"abc{i}d", "target": f"xyz{i}d"} for i in "abcdefgh"]
    two = [{"tgt": f"kkk{i}d"} for i in "abcdefgh"]
    assert changes(spark, {1: one, 2: two}) == [(2, "source", "removed"), (2, "tgt", "renamed")]


def test_steady_table(spark):
    df = table(spark, {1: [{"f1": 0.5, "source": "a", "wall": 3}], 2: [{"F1": "0.25", "source": {"name": "b", "file": "b.owl"}, "wall": "1.5 s"}], 3: ["junk", {"F1": {"value": 0.75, "n": 3}, "source": ["c"]}]})
    t = drift.steady_table(spark, df, "row_id", "stream", "batch", "payload", {"f1": "double", "source": "string", "wall": "double"}, {"F1": "f1", "f1": "f1"})
    assert sorted((r.row_id, r.f1, r.source, r.wall) for r in t.collect()) == [(0, 0.5, "a", 3.0), (1, 0.25, "b", 1.5), (2, None, None, None), (3, 0.75, "c", None)]


def field(name, words, shapes=(1,), **more):
    w = [{"h": h, "n": n} for h, n in words]
    total = sum(n for _, n in words)
    return {"field": name, "type": "string", "words": w, "distinct": len(w), "word_count": total, "pairs": float(sum(n * (n - 1) for _, n in words)), "shapes": [{"h": x, "n": 1} for x in shapes], "parts": 1.0, "length": 8.0, **more}


def test_flooding_prefers_the_like_pair():
    codes = [(1, 5), (2, 5)]
    s = drift.flood([field("rule", codes)], [field("match_rule", codes), field("colour", codes, (2,))])
    assert s["rule", "match_rule"] > s["rule", "colour"] and 0 <= min(s.values()) <= max(s.values()) <= 1
    assert drift.flood([field("rule", codes)], [field("match_rule", codes)], [("match_rule", "rule")])["rule", "match_rule"] == 0
    assert drift.flood([], []) == {}


def test_names():
    assert drift.name_likeness("tgt", "target") == 0.8 == drift.name_likeness("src", "source_tax") and drift.name_likeness("from", "to") == 0
    assert drift.name_likeness("F1", "f1") == 1.0 and drift.name_likeness("tgt", "source") == 0.0


def test_full_sketches_compare_a_sample_of_both():
    a, b = ([{"h": h * 7919 % 1_000_003, "n": 1} for h in range(lo, hi)] for lo, hi in ((0, 60_000), (30_000, 90_000)))
    a, b = (sorted(x, key=lambda r: r["h"])[: drift.SKETCH] for x in (a, b))
    jaccard, contained, _ = drift.shared(a, b)
    assert abs(jaccard - 1 / 3) < 0.1 and abs(contained - 1 / 2) < 0.13
    assert drift.shared(a, a) == (1.0, 1.0, 1.0) and drift.shared(None, a) == (0.0, 0.0, 0.0)


def test_names_that_stand_together_are_two_fields(spark):
    side = {b: [{"alpha": f"kx{i}", "beta": f"ky{i}"} for i in range(5)] for b in range(4)}
    both = table(spark, side, "other").unionByName(table(spark, {1: [{"alpha": f"zz{i}", "gamma": 1} for i in range(8)], 2: [{"beta": f"zz{i}", "gamma": 1} for i in range(8)]}))
    df = drift.schema_changes(both, "stream", "batch", "payload").filter("stream = 's'")
    assert rows(df.select("field", "change")) == [("alpha", "removed"), ("beta", "added")]
    assert changes(spark, {1: [{"alpha": f"zz{i}", "gamma": 1} for i in range(8)], 2: [{"beta": f"zz{i}", "gamma": 1} for i in range(8)]}) == [(2, "beta", "renamed")]


def test_batches_of_any_size_change_alike(spark):
    """Ten to 100,000 records a batch: unlike texts stay two fields, codes, ids and numbers under new names stay one."""
    code = lambda c, k: f"element_at(array({', '.join(repr(c + x) for x in k)}), cast(pmod(xxhash64(id, '{c}'), {len(k)}) + 1 as int))"
    words = lambda c, n: f"array_join(transform(sequence(1, 5 + cast(pmod(xxhash64(id), 3) as int)), x -> concat('{c}', char(97 + pmod(xxhash64(id, x), {n})), char(97 + pmod(xxhash64(x, id, 7), {n})))), ' ')"
    old = f"named_struct('note', concat({words('a', 9)}, '.'), 'memo', {words('c', 9)}, 'rule', {code('r', 'abcd')}, 'source', concat('x', hex(xxhash64(id))), 'f1', round(pmod(xxhash64(id), 1000) / 1000, 3))"
    new = f"named_struct('log', concat(id, '|', id * 7, '|', {code('q', 'ab')}), 'text', {words('k', 9)}, 'match_rule', {code('r', 'abcd')}, 'src', concat('x', hex(xxhash64(id, 1))), 'F1', round(pmod(xxhash64(id, 2), 1000) / 1000, 3))"
    df = None
    for n in (12, 1_000, 100_000):
        for b, x in ((1, old), (2, new)):
            one = spark.range(n).selectExpr(f"'s{n}' as stream", f"cast({b} as bigint) as batch", f"to_json({x}) as payload")
            df = one if df is None else df.unionByName(one)
    got = rows(drift.schema_changes(df, "stream", "batch", "payload").select("stream", "field", "change"))
    want = [("F1", "renamed"), ("log", "added"), ("match_rule", "renamed"), ("memo", "removed"), ("note", "removed"), ("src", "renamed"), ("text", "added")]
    assert got == sorted((f"s{n}", *c) for n in (12, 1_000, 100_000) for c in want)


def test_each_batch_follows_the_one_before(spark):
    df = spark.createDataFrame([("a", b) for b in (1, 3, 9, 10, 25, 26)] + [("b", 5)], "stream string, batch bigint")
    for stretch in (1, 5, 4096):
        assert rows(drift._followed(df, stretch)) == [("a", 10, 9), ("a", 25, 10), ("a", 26, 25), ("a", 3, 1), ("a", 9, 3)]
