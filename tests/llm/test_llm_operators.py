"""The subpackage's operators against brute force, on dirty, empty, tied and repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosslattice.llm import components, leakage, matching, packing, quality, splits
from crosslattice.llm.topn import top_n_per_group
from crosslattice.runtime import Scratch

J = "pair string, source_id string, candidate_id string, confidence double, _g0 int, rank int"


def best(items, n):
    seen = {}
    for p, s, c, x in items:
        if c is None or not c.strip() or x is None or x != x or not 0 <= x <= 1.000001:
            continue
        seen[p, s, c] = max(x, seen.get((p, s, c), -1))
    groups = {}
    for (p, s, c), x in seen.items():
        groups.setdefault((p, s), []).append((-x, c))
    return {(p, s, c, i + 1) for (p, s), v in groups.items() for i, (_, c) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("floors,slots", [(0, 16), (1, 64), (3, 5), (100_000, 16)])
def test_top_n_equals_brute_force(spark, floors, slots):
    r = random.Random(floors)
    items = [(r.choice(["p", "q", None]), "hot" if r.random() < 0.4 else f"s{r.randrange(9)}", r.choice([f"c{r.randrange(60)}", None, " ", ""]), r.choice([None, float("nan"), -1.0, 5.0, float("inf"), 1.0000001192092896, 0.9, 0.9, r.random(), 0.0, -0.0])) for _ in range(900)]
    df = spark.createDataFrame([(*x, 1, 2) for x in items + items[:50]], J)
    got = top_n_per_group(df, ["pair", "source_id"], "candidate_id", "confidence", 5, slots=slots, max_floors=floors)
    assert {(x.pair, x.source_id, x.candidate_id, x["rank"]) for x in got.collect()} == best(items, 5)


def test_top_n_of_nothing(spark):
    assert top_n_per_group(spark.createDataFrame([], J), ["pair", "source_id"], "candidate_id", "confidence").count() == 0


def unite(pairs):
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None and str(x).strip():
                find(x)
        if a is not None and b is not None and str(a).strip() and str(b).strip():
            a, b = find(a), find(b)
            if a != b:
                head[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(head)}


def shapes():
    r = random.Random(2)
    chain = [(f"a{i:03}", f"a{i + 1:03}") for i in range(120)]
    star = [("hub", f"b{i:03}") for i in range(150)]
    dirty = [("x", None), (None, "y"), ("", "z"), ("w", "w"), ("u", "t"), ("t", "u"), ("u", "t"), (None, None)]
    noise = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(40)]
    return chain + star + dirty + noise


def test_consolidate_equals_union_find(spark):
    pairs = shapes()
    df = spark.createDataFrame([(*p, "clash") for p in pairs], "a string, b string, root string")
    got = components.consolidate(spark, df, "a", "b")
    assert {tuple(x) for x in got.collect()} == unite(pairs)
    assert components.consolidate(spark, df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("solve", [components.contract, components.frontier])
def test_component_methods_agree(spark, solve):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(80)] + [(r.randrange(3000, 3100), r.randrange(3000, 3100)) for _ in range(60)]
    got = solve(spark, spark.createDataFrame(pairs, "u bigint, v bigint"), Scratch(spark, "t")).collect()
    root = {x.id: x.root for x in got}
    want = dict(unite([(f"{a:05}", f"{b:05}") for a, b in pairs if a != b]))
    groups = {}
    for k, v in want.items():
        groups.setdefault(v, set()).add(root[int(k)])
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_record_groups_and_splits(spark):
    recs = [(1, "a", "b"), (2, "b", "c"), (3, "x", None), (4, None, None), (5, "", "x"), (6, "q", "q"), (7, "a", " "), (9, "m", "n"), (9, "o", "p"), (10, "p", None), (None, "a", "x")]
    df = spark.createDataFrame([(*r, "c") for r in recs], "id bigint, s string, t string, group_id string")
    got = {(r.id, r.group_id) for r in splits.record_groups(spark, df, "id", ["s", "t"]).collect()}
    assert got == {(1, 1), (2, 1), (7, 1), (3, 3), (5, 3), (4, 4), (6, 6), (9, 9), (10, 9)}
    assert splits.record_groups(spark, df.limit(0), "id", ["s", "t"]).count() == 0


def test_split_shares_hold_and_groups_stay_whole(spark):
    df = spark.createDataFrame([(i, f"e{i // 3}", None) for i in range(3000)], "id bigint, s string, t string")
    rows = splits.grouped_split(spark, df, "id", ["s", "t"]).collect()
    assert len(rows) == 3000
    by = {}
    for r in rows:
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    share = {s: sum(r.split == s for r in rows) / 3000 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert rows == splits.grouped_split(spark, df.repartition(7), "id", ["s", "t"]).collect() or set(rows) == set(splits.grouped_split(spark, df.repartition(7), "id", ["s", "t"]).collect())


@pytest.mark.parametrize("capacity,top", [(100, 60), (100, 99), (2048, 700)])
def test_packing_fits_and_fills(capacity, top):
    r = np.random.default_rng(top)
    sizes = r.integers(1, top, 500)
    where = packing.fit(sizes, capacity)
    load = np.bincount(where, weights=sizes)
    assert load.max() <= capacity and (load > 0).all()
    assert len(load) <= max(np.ceil(sizes.sum() / capacity) * 1.02 + 1, (2 * sizes > capacity).sum() * 1.25)
    _, sums = packing.differencing(sizes, 7)
    assert sums.sum() == sizes.sum() and (sums.max() - sums.min()) <= top


def test_packing_keeps_every_token(spark):
    texts = ["short text", "", None, "word " * 300, "x", "x", "long text here " * 150]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, container string")
    got = packing.pack(spark, df, "doc_id", "text", 100).collect()
    counts = {r.doc_id: r.tokens for r in packing.token_counts(df, "doc_id", "text", packing.tokenizer_path()).collect()}
    held, load = {}, {}
    for r in got:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.tokens
        load[r.container] = load.get(r.container, 0) + r.tokens
        assert r.start == r.piece * 100
    assert held == {k: v for k, v in counts.items() if v} and max(load.values()) <= 100
    assert sum(r.doc_id == 4 for r in got) == 1 and sum(r.doc_id == 3 for r in got) == -(-counts[3] // 100)
    assert packing.pack(spark, df.limit(0), "doc_id", "text").count() == 0


ITEM = [f"w{i}" for i in range(40)]


def spans(text, items=None, least=15, ends=None):
    auto = leakage.Automaton(items or {1: ITEM})
    ends = ends or {}
    return {s[0]: s[1:3] for s in leakage.leaked(auto, {i: len(x) - ends.get(i, 0) for i, x in auto.items.items()}, leakage.normal_words(text), least, 6)}


def test_leak_of_whole_and_of_changed_passages():
    assert spans("before " + " ".join(ITEM) + " after") == {1: (40, 0)}
    assert spans(" ".join(ITEM[5:19])) == {}
    assert spans(" ".join(ITEM[5:20])) == {1: (15, 0)}
    assert spans(" ".join(["zz" if i % 7 == 6 else w for i, w in enumerate(ITEM)])) == {1: (40, 5)}
    assert spans(" ".join(["zz" if i % 4 == 3 else w for i, w in enumerate(ITEM)])) == {}
    put_in = [x for i, w in enumerate(ITEM[:20]) for x in ([w, "zz"] if i in (6, 13) else [w])]
    assert spans(" ".join(put_in)) == {1: (20, 2)}
    left_out = [w for i, w in enumerate(ITEM[:24]) if i not in (7, 15)]
    assert spans(" ".join(left_out)) == {1: (24, 2)}


def test_leak_ignores_markup_case_and_hidden_characters():
    text = "<p>" + " ".join(f"**{w.upper()}**" if i % 3 else f"{w[0]}­{w[1:]}," for i, w in enumerate(ITEM[:18])) + "</p>"
    assert spans(text) == {1: (18, 0)}
    assert leakage.normal_words("<b>Seventy</b>-se­ven &amp; x​y") == ["seventyseven", "xy"]


def test_stock_closing_alone_is_no_leak():
    end = [f"e{i}" for i in range(18)]
    items = {i: [f"i{i}x{k}" for k in range(30)] + end for i in range(4)}
    assert spans(" ".join(end), items, ends=dict.fromkeys(items, 18)) == {}
    assert set(spans(" ".join(items[2]), items, ends=dict.fromkeys(items, 18))) == {2}
    texts = ["One two. Say yes or no.", "Three four. Say yes or no!", "Three four. Say yes or no!", "Say yes or no.", "Five. Six."]
    assert leakage.stock_closings(texts, 2) == {("say", "yes", "or", "no")} and leakage.stock_closings(texts, 3) == set()
    assert leakage.stock_closings([], 2) == set() and leakage.closing("no end") == []


def test_automaton_tells_longest_matches():
    r = random.Random(1)
    items = {i: [r.choice("abc") for _ in range(r.randrange(1, 12))] for i in range(6)}
    auto = leakage.Automaton(items)
    text = [r.choice("abcd") for _ in range(200)]
    longest = {}
    for item, end, at, n in auto.runs([auto.words.get(w) for w in text], 1):
        assert items[item][end - n + 1 : end + 1] == text[at - n + 1 : at + 1]
        longest[at] = max(longest.get(at, 0), n)
    for at, n in longest.items():
        assert n == max(k for k in range(1, at + 2) if any(text[at - k + 1 : at + 1] == x[e - k + 1 : e + 1] for x in items.values() for e in range(k - 1, len(x))))


def test_leak_of_an_item_that_is_part_of_another_and_of_shared_passages():
    inner = [f"p{k}" for k in range(20)]
    items = {1: [f"a{k}" for k in range(10)] + inner + [f"b{k}" for k in range(10)], 2: inner, 3: ["c", *inner, "d"]}
    assert spans(" ".join(items[1]), items) == {1: (40, 0), 2: (20, 0), 3: (20, 0)}
    assert spans(" ".join(["zz", *inner, "b0", "b1"]), items) == {1: (22, 0), 2: (20, 0), 3: (20, 0)}
    r = random.Random(5)
    items = {i: [r.choice("abc") for _ in range(r.randrange(1, 14))] for i in range(8)}
    text = [r.choice("abcd") for _ in range(150)]
    auto = leakage.Automaton(items)
    ends = {(i, e, at) for i, e, at, _ in auto.runs([auto.words.get(w) for w in text], 3)}
    for i, x in items.items():
        for e in range(2, len(x)):
            for at in range(2, len(text)):
                if x[e - 2 : e + 1] == text[at - 2 : at + 1] and (e + 1 == len(x) or at + 1 == len(text) or x[e + 1] != text[at + 1]):
                    assert (i, e, at) in ends


def test_leak_query_on_dirty_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM), 0), (2, None, 0), (3, "", 0), (4, "x " * 200_000 + " ".join(ITEM[:20]), 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, " ".join(ITEM)), (7, " ".join(ITEM)), (8, None), (9, "")], "item_id bigint, text string")
    got = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text")
    assert {(r.doc_id, r.item_id, r.words, r["first"]) for r in got.collect()} == {(1, 7, 40, 0), (4, 7, 20, 200_000)}
    assert leakage.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_closing_of_two_items_and_several_texts_of_one(spark):
    end = "Now say in one word which of these many concepts is the parent of all the others here or is none of them."
    items = spark.createDataFrame([(1, "a1 b1 c1. " + end), (2, "a2 b2 c2 d2. " + end), (3, " ".join(ITEM)), (3, " ".join(f"v{i}" for i in range(30)))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, end), (2, " ".join(f"v{i}" for i in range(20))), (3, " ".join(ITEM[10:40]) + " x " + " ".join(f"v{i}" for i in range(30)))], "doc_id bigint, text string")
    got = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id, r.words) for r in got) == [(2, 3, 20), (3, 3, 30)]


def test_words_and_their_places_agree():
    r = random.Random(8)
    parts = ["<p>", "</p>", "Alpha-beta", "caf\u00e9", "e\u0301clair", "\ufb01ne", "x\u00ady", "&amp;", "&eacute;t\u00e9", "[a link](http://x.y)", "**bold**", "word-\n  broken", "<b>in", "</b>", "\u200b", "ISO-9001", "\n", "\u0130stanbul", "&unknown", "a<b"]
    for _ in range(300):
        t = " ".join(r.choice(parts) for _ in range(r.randrange(1, 25))) if r.random() < 0.7 else "".join(r.choice(parts) for _ in range(12))
        placed = leakage.placed_words(t)
        assert [w for w, _, _ in placed] == leakage.normal_words(t)
        assert all(0 <= a <= b < len(t) for _, a, b in placed) and [a for _, a, _ in placed] == sorted(a for _, a, _ in placed)


def test_passages_over_a_limit_are_removed(spark):
    item, half = " ".join(ITEM), " ".join(ITEM[:20])
    changed = " ".join("<b>ZZ</b>" if i % 7 == 6 else w.upper() for i, w in enumerate(ITEM))
    rows = [(1, f"Before, {item}; after {item}."), (2, f"Keep {half} this"), (3, None), (4, ""), (5, f"<p>A {changed}! B</p>"), (6, "nothing here")]
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.removed) for r in leakage.remove_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got[1] == ("Before, ; after .", 80) and got[2] == (rows[1][1], 0) and got[3] == (None, 0) and got[4] == ("", 0) and got[6] == (rows[5][1], 0)
    assert got[5][1] == 40 and got[5][0].startswith("<p>A ") and got[5][0].endswith("! B</p>")
    got = {r.doc_id: r.removed for r in leakage.remove_leaks(docs, "doc_id", "text", items, "item_id", "text", cover=0.4).collect()}
    assert got[2] == 20
    assert {r.removed for r in leakage.remove_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").collect()} == {0}


def test_items_beyond_one_automaton(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_ITEM_WORDS", 60)
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(40))) for k in range(4)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(5, 30))) for k in range(4)], "doc_id bigint, text string")
    got = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id, r.words) for r in got) == [(k, k, 25) for k in range(4)]


PROSE = "The panel has read the list of terms. It was not clear to us, and so the team will look at it again when the others are back."
COMMON = ["the", "of", "it", "was", "not", "to", "us", "and", "so", "at", "when", "are", "has"]


def kinds(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.kind for r in quality.quality_statistics(df, "doc_id", "text", COMMON, **kw).orderBy("doc_id").collect()]


def test_kinds(spark):
    table = "name | score | rank\n" + "\n".join(f"item {i} | 0.{i} | {i}" for i in range(6))
    listed = "\n".join(f"- late badge {i}" for i in range(6))
    keys = "\n".join("Name: full chair\nPath: top -> low" for _ in range(4))
    html = "<ul>" + "".join(f"<li>social paper {i}</li>" for i in range(5)) + "</ul>"
    junk = ["{}~+-*/ =[]$ <|> ^%", "null, " * 30, "9f 3c 11 a0 5e 77 " * 9, "xq zvk qqz wrt kkj " * 9, "<div></div class=\"x\"><td></td>", "c2FtZQ9zZWxm+vX0bGtqaGdmZHNh/ZXdxcXdl"]
    assert kinds(spark, [PROSE, table, listed, keys, html, *junk]) == ["prose", "table", "list", "list", "list"] + ["junk"] * 6


def test_mainly_prose_stays_prose(spark):
    assert kinds(spark, [PROSE + "\n" + PROSE + "\n- one\n- two\na | b | c\n" + PROSE, PROSE.replace(". ", ".\n").replace(" to ", "\nto "), PROSE.upper(), "> " + PROSE.replace(", ", ",\n> ")]) == ["prose"] * 4


def test_null_blank_and_repeated_texts(spark):
    assert kinds(spark, [None, "", " \n\t", PROSE]) == [None, None, None, "prose"]
    df = spark.createDataFrame([(1, PROSE)] * 3, "doc_id bigint, text string")
    r = quality.quality_statistics(df, "doc_id", "text", COMMON).collect()
    assert len(r) == 1 and r[0].words == len(PROSE.split())
    assert quality.quality_statistics(df.limit(0), "doc_id", "text", COMMON).count() == 0


@pytest.mark.parametrize("size", [64, 300])
def test_pieces_give_the_same_figures_as_the_whole(spark, size):
    r = random.Random(7)
    table = "name | score | rank\n" + "\n".join(f"item {i} | 0.{i} | {i}" for i in range(60))
    html = "<table>" + "".join(f"<tr><td class='a b'>paper {i}</td><td>0.{i}</td><td>{i}</td></tr>" for i in range(60)) + "</table>"
    listed = "<ul>" + "".join(f"<li>social paper {i}</li>" for i in range(60)) + "</ul>"
    numbers = "\n".join(f"{i}; {i * 7}; {i / 8}" for i in range(90))
    texts = ["".join(r.choice("ab cd.\n ") for _ in range(700)), "word " * 300, "unbroken" * 90, PROSE * 12, "line one.\nline two\n" * 40, table, html, listed, numbers, (PROSE + "\n") * 9 + table[:90], "- late badge\n" * 50, "null,null,the,of," * 60, "9f 3c 11 a0 " * 90, "> " + PROSE.replace(", ", ",\n> ") * 6, "\r\n".join([PROSE] * 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    a = quality.quality_statistics(df, "doc_id", "text", COMMON).orderBy("doc_id").collect()
    b = quality.quality_statistics(df, "doc_id", "text", COMMON, size=size).orderBy("doc_id").collect()
    for x, y in zip(a, b):
        if x.doc_id:  # in the random text lines of blanks are cut
            x, y = x.asDict(), y.asDict()
            for k in ("row_ratio", "entry_ratio"):  # which row a line break belongs to may change
                assert abs((x.pop(k) or 0) - (y.pop(k) or 0)) < 0.03
            assert x == y
    p = df.select("doc_id", F.explode(quality.pieces(F.col("text"), size)).alias("p")).select("doc_id", "p.*").collect()
    for i, t in enumerate(texts):
        assert "".join(x.s for x in sorted((x for x in p if x.doc_id == i), key=lambda x: x["at"])) == t


def test_documents_of_several_megabytes(spark):
    """Texts beyond the usual piece, among them one without a line break, give what they give uncut."""
    row = "".join(f"item {i} | 0.{i} | {i}\n" for i in range(100_000))
    texts = [(PROSE + " ") * 25_000, (PROSE + "\n") * 25_000, row, "<ul>" + "".join(f"<li>social paper {i}</li>" for i in range(100_000)) + "</ul>", "null " * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    a, b = (quality.quality_statistics(df, "doc_id", "text", COMMON, size=x).orderBy("doc_id").collect() for x in (10**8, 32_768))
    assert [x.kind for x in b] == ["prose", "prose", "table", "list", "junk"] and min(map(len, texts)) > 2_000_000
    for x, y in zip(a, b):
        assert (x.words, x.lines, x.visible_chars, x.common_ratio, x.line_end_ratio, x.kind) == (y.words, y.lines, y.visible_chars, y.common_ratio, y.line_end_ratio, y.kind)


def test_statistics_by_hand(spark):
    r = quality.quality_statistics(spark.createDataFrame([(1, "The cat's ok!\nNo end")], "doc_id bigint, text string"), "doc_id", "text", COMMON).collect()[0]
    assert (r.words, r.lines, r.line_end_ratio, r.common_ratio) == (5, 2, 0.5, 0.2)
    assert round(r.symbol_ratio, 6) == round(2 / 16, 6) and round(r.mean_word_length, 6) == 2.8


def entities(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "tax string, node_id string, name string, comment string, attributes map<string,string>, loaded_at int")


def test_matching_uses_names_facts_and_attributes(spark):
    groups = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u"), ("d", None)], "tax string, track string")
    n = entities(
        spark,
        [
            ("a", "a#1", "LateChair", "A late chair that costs 12 euros and lies in room forty-one.", {"k": "5"}),
            ("b", "b#1", "chair, late", "It lies in room 41. It costs twelve euros.", None),
            ("a", "a#2", "Social paper", "A social paper that costs 9 euros and has 8 pages.", None),
            ("b", "b#2", "social-paper", "A social paper that costs 77 euros and has 6 pages.", None),
            ("a", "a#3", "Draft_topic", None, {"k": "311", "l": "58"}),
            ("b", "b#3", "topic (draft)", "A draft topic that has 3 pages and 4 figures.", {"m": "311.0", "n": "58"}),
            ("a", "a#4", None, None, None),
            ("b", "b#4", " ", "", {}),
            ("c", "c#1", "LateChair", "A late chair that costs 12 euros and lies in room forty-one.", None),
            ("d", "d#1", "LateChair", None, None),
            ("a", "a#1", "LateChair", "A late chair that costs 12 euros and lies in room forty-one.", {"k": "5"}),
        ],
    )
    got = {(r.node_id_a, r.node_id_b) for r in matching.match_entities(spark, n, groups).collect()}
    assert got == {("a#1", "b#1"), ("a#3", "b#3")}
    assert matching.match_entities(spark, n.limit(0), groups).count() == 0


def test_names_and_numbers_are_read():
    assert matching.words_of("OfficeOf_late-Chair (x)") == ["office", "late", "chair", "x"] and matching.words_of("C_76312") == ["c"]
    lexicon = matching.Lexicon([("c", 9, 0, 9), ("late", 40, 30, 0), ("chair", 50, 40, 0), ("costs", 0, 60, 0)])
    assert lexicon.name(["c"], True, ["late", "chair", "costs"]) == ("chair", "late") and lexicon.name(["c"], False, []) == ("c",)
    assert matching.record("x", None, ["73.0", "Yes", None, " ", "seventy_three"])[4:] == ([73.0], ["true"])
    assert [matching.number(x) for x in ("seventy-three", "73.0", "seventy_three", "nine", "teal", "")] == [73.0, 73.0, 73.0, 9.0, None, None]
    w = matching.Words({"attendee": 400, "delayed": 90, "atendee": 3, "dela": 4})
    assert w.plain("atendee") == "attendee" and w.plain("dela") == "delayed" and w.plain("attendee") == "attendee"


def test_vectors_bring_words_of_like_use_together():
    r = random.Random(0)
    pairs = {}
    for _ in range(3000):
        a, b = r.choice([("x1", "c1"), ("x2", "c1"), ("x1", "c2"), ("x2", "c2"), ("y1", "d1"), ("y2", "d1"), ("y1", "d2"), ("y2", "d2")])
        for k in ((a, b), (b, a)):
            pairs[k] = pairs.get(k, 0) + 1
    v = matching.train([(a, b, n) for (a, b), n in pairs.items()])
    c = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    assert c("x1", "x2") > c("x1", "y1") + 0.3


def test_large_blocks_are_cut_without_losing_pairs(spark):
    n = entities(spark, [(t, f"{t}#{i:03}", "same name", f"It costs {i} euros and has {i + 1} pages.", None) for t in "ab" for i in range(40)])
    groups = spark.createDataFrame([("a", "t"), ("b", "t")], "tax string, track string")
    want = {(f"a#{i:03}", f"b#{i:03}") for i in range(40)}
    for cell in (8, 1500):
        assert {(r.node_id_a, r.node_id_b) for r in matching.match_entities(spark, n, groups, cell=cell).collect()} == want


def test_recall_on_held_out_truth(spark):
    """Pairs built from a known concept list, disguised in style, order and numbers."""
    r = random.Random(9)
    mods, heads = ["late", "social", "draft", "joint", "annual", "private"], ["chair", "paper", "topic", "badge", "review", "venue"]
    concepts = [(m, h, r.randrange(2, 99), r.randrange(2, 99)) for m in mods for h in heads]
    rows, truth = [], set()
    for i, (m, h, x, y) in enumerate(concepts):
        rows += [("a", f"a#{i:02}", f"{m.title()}{h.title()}", f"A {m} {h} that costs {x} euros and has {y} pages.", {"round": str(100 + i)}), ("b", f"b#{i:02}", f"{h} ({m})" if i % 4 else "", f"It has {y} pages. It costs {x} euros.", {"rounds": f"{100 + i}.0"})]
        truth.add((f"a#{i:02}", f"b#{i:02}"))
    got = {(p.node_id_a, p.node_id_b) for p in matching.match_entities(spark, entities(spark, rows), spark.createDataFrame([("a", "t"), ("b", "t")], "tax string, track string")).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.05 * len(truth)


@pytest.mark.parametrize("size", [100, 1000, 4000])
def test_blocking_recall_against_brute_force(spark, size):
    """Pairs of like names that share a hyperplane table, against all pairs; the share holds at any size."""
    r = np.random.default_rng(size)
    base = r.standard_normal((size // 2, matching.DIM))
    v = np.concatenate([base, base + 0.6 * r.standard_normal(base.shape)]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cosine = v @ v.T
    i, j = np.nonzero(np.triu(cosine >= matching.NEAR, 1))
    bits, tables = matching.tables_of(size)
    met = np.zeros(len(i), bool)
    largest = 0
    for t in range(tables):
        c = matching.codes(v, bits, t)
        met |= c[i] == c[j]
        largest = max(largest, np.bincount(np.unique(c, return_inverse=True)[1]).max())
    assert len(i) > size // 4 and met.mean() >= 0.9 and largest < 15 * matching.BLOCK


def test_all_pairs_of_shared_numbers_meet(spark):
    """Two of three attribute numbers in common, or equal told numbers: every pair, against brute force, however blocks are cut."""
    r = random.Random(3)
    recs = [(t, f"{t}#{i:04}", sorted(r.sample(range(2, 60), 3))) for t in "ab" for i in range(400)]
    rows = [("t", t, i, 800, "", 0, None, ",".join(map(str, n[:1])), 1, [], [float(x) for x in n], []) for t, i, n in recs]
    shown = spark.createDataFrame(rows, matching._SHOWN)
    idf = spark.sparkContext.broadcast(np.ones(1, np.float32))
    want = {(p[1], q[1]) for p in recs for q in recs if p[0] == "a" and q[0] == "b" and (len(set(p[2]) & set(q[2])) >= 2 or p[2][0] == q[2][0])}
    for cell in (7, 300):
        got = matching._compared(spark, matching._cells(matching._coded(shown), cell), idf, None).select("a", "b").collect()
        assert {(x.a, x.b) for x in got} == want


def test_training_finds_other_words_for_the_same(spark):
    """Synonyms are only known from the walks: without training the pairs named by them are lost."""
    r = random.Random(12)
    mods = [("late", "delayed"), ("social", "convivial"), ("draft", "tentative"), ("joint", "shared"), ("annual", "yearly"), ("private", "closed"), ("paid", "billed"), ("printed", "hardcopy"), ("free", "gratis"), ("full", "entire")]
    heads = ["chair", "paper", "topic", "badge", "review", "venue", "dinner", "poster", "speaker", "archive", "tutorial", "fee"]
    rows, silent = [], set()
    for i, (m, h) in enumerate((m, h) for m in mods for h in heads):
        x, y = r.sample(range(2, 99), 2)
        rows.append(("a", f"a#{i:03}", f"{m[0]} {h}", f"It costs {x} euros and has {y} pages.", None))
        if i % 4:
            rows.append(("b", f"b#{i:03}", f"{m[1]} {h}", f"It has {y} pages. It costs {x} euros.", None))
        else:
            rows.append(("b", f"b#{i:03}", f"{m[1]} {h}", None, None))
            silent.add((f"a#{i:03}", f"b#{i:03}"))
    groups = spark.createDataFrame([("a", "t"), ("b", "t")], "tax string, track string")
    n = entities(spark, rows)
    got = [{(p.node_id_a, p.node_id_b) for p in matching.match_entities(spark, n, groups, trained=x).collect()} for x in (True, False)]
    assert len(got[0] & silent) >= 0.4 * len(silent) and len(got[1] & silent) <= 0.1 * len(silent)


def test_every_free_accepted_pair_is_taken(spark):
    rows = [(a, b, a[0], b[0], 0.9) for a in ("x1", "x2") for b in ("y1", "y2")] + [("x3", "y3", "x", "y", 0.8), ("x1", "z1", "x", "z", 0.6), ("w1", "x1", "y", "x", 0.7)]
    rated = spark.createDataFrame(rows, "a string, b string, tax_a string, tax_b string, confidence double")
    got = {(r.a, r.b) for r in matching._one_to_one(spark, rated).collect()}
    assert got == {("x1", "y1"), ("x2", "y2"), ("x3", "y3"), ("x1", "z1")}


def test_equal_records_all_find_a_partner(spark):
    n = entities(spark, [(t, f"{t}#{i}", "LateChair", None, None) for t in "ab" for i in range(3)])
    groups = spark.createDataFrame([("a", "t"), ("b", "t")], "tax string, track string")
    assert {(r.node_id_a, r.node_id_b) for r in matching.match_entities(spark, n, groups).collect()} == {(f"a#{i}", f"b#{i}") for i in range(3)}
