"""Every query of the engine's own operators, and the SQL each is held against.

Tables stand for the engine's roles as follows: ``matches`` are mappings of several approaches
(one of them, string-equiv, serves as the reference), ``judgements`` are scored candidates in three
modes, ``nodes`` and ``edges`` the taxonomies, ``events`` the journal of outside calls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.functions.text import collapsed, concept_text, description, label_key, pair_key, safe_id, synonym_first
from crosslattice.operators import assign, consistency, evaluate, graph, journal, neural, retrieval, selection, statistics, synth
from crosslattice.operators.identifiers import resolve_nodes, resolve_taxonomy
from crosslattice.plans import reports
from crosslattice.runtime import Scratch, nonblank
from crosslattice.sources.tables import table
from crosslattice.streaming import journal as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODES = ["concept", "concept-parent", "concept-children"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _matches(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "taxonomies")
    m = resolve_nodes(resolve_nodes(table(spark, d, "matches"), "source_id", known, "s"), "target_id", known, "t")
    return m.filter("s is not null and t is not null").select("pair", "approach", "mode", F.col("s").alias("source_id"), F.col("t").alias("target_id"), "confidence")


_M = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT x, regexp_replace(x, '^[\s<]+|[\s>]+$', '', 'g') AS y
  FROM (SELECT source_id AS x FROM matches UNION ALL SELECT target_id FROM matches) WHERE x IS NOT NULL AND regexp_matches(x, '\S')),
canon AS (
  SELECT x, CASE WHEN t.short IS NOT NULL THEN t.short || '#' || regexp_extract(y, '([^#/]+)$', 1) ELSE y END AS z
  FROM ids LEFT JOIN taxonomies t ON y LIKE '%://%' AND lower(t.namespace) = regexp_replace(lower(regexp_extract(y, '^(.*)[#/][^#/]+$', 1)), '[#/]+$', '')),
m AS (SELECT pair, approach, mode, a.z AS source_id, b.z AS target_id, confidence FROM matches JOIN canon a ON a.x = source_id JOIN canon b ON b.x = target_id),
"""


REFERENCE = "string-equiv"


def _keyed_pair(pair: str = "pair") -> Column:
    """Each approach is a problem of its own: its name stands before the pair's."""
    return F.concat(F.col("approach"), F.lit("|"), F.col(pair))


def _approach() -> Column:
    return F.split("pair", r"\|")[0]


def _audited(spark: SparkSession, d: str) -> DataFrame:
    """All mappings but the reference, every approach."""
    return _matches(spark, d).filter(F.col("approach") != REFERENCE)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return assign.clean(_audited(spark, d).withColumn("pair", _keyed_pair()).withColumn("score", F.col("confidence")))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).filter(F.col("approach") == REFERENCE).select("pair", "source_id", "target_id").distinct()


def _gold_for_all(spark: SparkSession, d: str) -> DataFrame:
    """The reference once for each approach; approaches are a short list."""
    names = sorted(r[0] for r in table(spark, d, "matches").select("approach").distinct().collect() if r[0] not in (None, REFERENCE))
    return _gold(spark, d).withColumn("approach", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))).select(_keyed_pair().alias("pair"), "source_id", "target_id")


_PRED = (
    _M
    + """
pred AS (SELECT approach || '|' || pair AS pair, source_id, target_id, max(confidence) AS score FROM m WHERE approach <> 'string-equiv' AND confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL),
gold AS (SELECT DISTINCT a.approach || '|' || pair AS pair, source_id, target_id FROM m, (SELECT DISTINCT approach FROM matches WHERE approach <> 'string-equiv') a WHERE m.approach = 'string-equiv'),
best AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY pair, source_id ORDER BY score DESC, target_id) = 1),
hits AS (SELECT b.*, g.pair IS NOT NULL AS hit FROM best b LEFT JOIN gold g ON g.pair = b.pair AND g.source_id = b.source_id AND g.target_id = b.target_id),
counts AS (SELECT COALESCE(p.pair, g.pair) AS pair, COALESCE(g.gold, 0) AS gold, COALESCE(p.predicted, 0) AS predicted, COALESCE(p.tp, 0) AS tp
  FROM (SELECT pair, count(*) AS predicted, count(*) FILTER (hit) AS tp FROM hits GROUP BY pair) p
  FULL JOIN (SELECT pair, count(*) AS gold FROM gold GROUP BY pair) g ON g.pair = p.pair),
"""
)
_PRF = "CASE WHEN predicted = 0 THEN 0.0 ELSE tp * 1.0::DOUBLE / predicted END AS precision, CASE WHEN gold = 0 THEN 0.0 ELSE tp * 1.0::DOUBLE / gold END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (predicted + gold) END AS f1"


# -- evaluation -------------------------------------------------------------------------------


@query(_PRED + f"x AS (SELECT 1) SELECT pair, gold, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_PRF} FROM counts)")
def prf_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.evaluate(_predictions(spark, d), _gold_for_all(spark, d)))


@query(
    _PRED
    + f"""s AS (SELECT *, {_PRF} FROM counts)
SELECT split_part(pair, '|', 1) AS approach, count(*) AS pairs, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
 CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(gold) AS BIGINT) AS gold, round(sum(tp) / sum(predicted), 6) AS pooled_precision, round(sum(tp) / sum(gold), 6) AS pooled_recall, round(2 * sum(tp) / (sum(predicted) + sum(gold)), 6) AS pooled_f1 FROM s GROUP BY ALL"""
)
def prf_macro_pooled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.summarise(evaluate.evaluate(_predictions(spark, d), _gold_for_all(spark, d)).withColumn("approach", _approach()), "approach"))


_SWEEP = (
    _PRED
    + f"""th AS (SELECT unnest({list(evaluate.THRESHOLDS)})::DOUBLE AS threshold),
pairs AS (SELECT pair FROM counts),
swept AS (SELECT p.pair, t.threshold, ANY_VALUE(c.gold) AS gold, count(h.pair) AS predicted, count(*) FILTER (h.hit) AS tp
  FROM pairs p CROSS JOIN th t JOIN counts c ON c.pair = p.pair LEFT JOIN hits h ON h.pair = p.pair AND h.score >= t.threshold GROUP BY p.pair, t.threshold),
sweep AS (SELECT *, {_PRF} FROM swept)
"""
)


@query(_SWEEP + "SELECT pair, threshold, gold, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.threshold_sweep(_predictions(spark, d), _gold_for_all(spark, d)))


@query(
    _SWEEP
    + """, o AS (SELECT a.pair, a.threshold, a.f1, (SELECT round((sum(b.f1) - a.f1) / (count(*) - 1), 12) FROM sweep b WHERE b.threshold = a.threshold AND split_part(b.pair, '|', 1) = split_part(a.pair, '|', 1)) AS others FROM sweep a)
SELECT pair, threshold, round(f1, 6) AS f1 FROM o QUALIFY row_number() OVER (PARTITION BY pair ORDER BY others DESC, threshold) = 1"""
)
def loo_threshold(spark: SparkSession, d: str) -> DataFrame:
    sweep, _ = Scratch(spark, "sweep").save(evaluate.threshold_sweep(_predictions(spark, d), _gold_for_all(spark, d)))
    return rounded(selection.loo_threshold(sweep.withColumn("approach", _approach()), ["approach"]).select("pair", "threshold", "f1"))


_CAND = """
WITH c AS (SELECT pair, source_id, candidate_id AS target_id, max(confidence) AS score FROM judgements
  WHERE regexp_matches(candidate_id, '\\S') AND confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1.000001 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair, source_id ORDER BY score DESC, target_id) AS rank FROM c),
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements").select("pair", "source_id", F.col("candidate_id").alias("target_id"), F.col("confidence").alias("score"))
    return assign.clean(j.filter(F.col("score").between(0, 1.000001)))


@query(
    _CAND
    + """k AS (SELECT unnest([1, 2, 3, 5, 10])::BIGINT AS k), gold AS (SELECT DISTINCT pair, source_id, candidate_id AS target_id FROM judgements WHERE is_match AND regexp_matches(candidate_id, '\\S')),
f AS (SELECT g.*, r.rank FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (pair, source_id, target_id))
SELECT k, count(*) FILTER (rank <= k) AS hits, count(*) AS gold, round(count(*) FILTER (rank <= k) / count(*), 6) AS recall,
 round(CASE WHEN count(*) FILTER (rank <= k) = 0 THEN 0 ELSE 2 * (count(*) FILTER (rank <= k) / count(*)) / (1 + count(*) FILTER (rank <= k) / count(*)) END, 6) AS ceiling, round(count(*) FILTER (rank IS NULL) / count(*), 6) AS uncovered FROM f, k GROUP BY k"""
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "judgements").filter("is_match").filter(nonblank(F.col("candidate_id"))).select("pair", "source_id", F.col("candidate_id").alias("target_id"))
    return rounded(evaluate.recall_at(assign.top_k(_candidates(spark, d), 10), gold))


_SCORED = "u AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, confidence AS p, is_match::INT AS y FROM judgements WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 AND is_match IS NOT NULL)"


@query(f"WITH {_SCORED}, g AS (SELECT bin, count(*) AS n, sum(y)::BIGINT AS pos, avg(p) AS mp, avg(y) AS pf FROM u GROUP BY bin) SELECT b.bin, COALESCE(n, 0) AS count, COALESCE(pos, 0) AS positives, round(mp, 6) AS mean_probability, round(pf, 6) AS positive_fraction FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN g ON g.bin = b.bin")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.reliability_bins(table(spark, d, "judgements").filter("is_match is not null"), "confidence", "is_match"))


@query(f"WITH {_SCORED}, g AS (SELECT bin, count(*) AS n, sum(y) AS pos, sum(p) AS sp, sum((p - y) * (p - y)) AS sq FROM u GROUP BY bin) SELECT sum(n)::BIGINT AS count, sum(pos)::BIGINT AS positives, round(sum(pos) / sum(n), 6) AS prevalence, round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(sp - pos)) / sum(n), 6) AS ece FROM g")
def calibration_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.calibration(table(spark, d, "judgements").filter("is_match is not null"), "confidence", "is_match"))


@query(_M + "x AS (SELECT 1) SELECT approach || '|' || pair AS pair, count(*) - count(DISTINCT target_id) AS collisions FROM m GROUP BY approach, pair")
def target_collisions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.target_collisions(_matches(spark, d).withColumn("pair", _keyed_pair()))


# -- assignment -------------------------------------------------------------------------------


@query(_CAND + "x AS (SELECT 1) SELECT pair, source_id, target_id, round(score, 6) AS score FROM ranked WHERE rank = 1")
def per_source_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.per_source_best(_candidates(spark, d)))


@query(_CAND + "x AS (SELECT 1) SELECT pair, source_id, target_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def candidates_top_k(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.top_k(_candidates(spark, d), 10)).withColumn("rank", F.col("rank").cast("bigint"))


@query(_CAND + "x AS (SELECT 1) SELECT pair, source_id, target_id, round(score, 6) AS score FROM ranked WHERE rank = 1 AND score >= 0.5 QUALIFY row_number() OVER (PARTITION BY pair, target_id ORDER BY score DESC, source_id) = 1")
def dedupe_by_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.dedupe_by_target(_candidates(spark, d), 0.5))


@query()
def greedy_injective(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.greedy_injective(spark, _candidates(spark, d), 0.5))


@query()
def judged_mapping(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.judged(spark, table(spark, d, "judgements")))


@query(_CAND + "a AS (SELECT count(*) AS n FROM c WHERE score >= 0.7), b AS (SELECT count(*) AS n FROM c WHERE score > 0.7) SELECT a.n AS inclusive, b.n AS exclusive FROM a, b")
def filter_strict_vs_inclusive(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    n = F.count(F.lit(1))
    return assign.above(c, 0.7).agg(n.alias("inclusive")).crossJoin(assign.strictly_above(c, 0.7).agg(n.alias("exclusive")))


@query(
    _CAND
    + """t AS (SELECT pair, source_id, max(target_id) FILTER (rank = 1) AS target_id, max(score) FILTER (rank = 1) AS best, COALESCE(max(score) FILTER (rank = 2), 0) AS second,
 string_agg(target_id, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4 AND score > 0.3) AS alternatives FROM ranked WHERE rank <= 4 GROUP BY ALL)
SELECT pair, source_id, target_id, round(best, 6) AS best, round(second, 6) AS second, COALESCE(alternatives, '') AS alternatives FROM t WHERE best < 0.7 OR (best - second < 0.1 AND second > 0.3)"""
)
def uncertain_margin(spark: SparkSession, d: str) -> DataFrame:
    u = assign.uncertain(_candidates(spark, d))
    return rounded(u.withColumn("alternatives", F.array_join("alternatives", ",")))


_VOTES = "v AS (SELECT pair, source_id, candidate_id AS target_id, mode, max(confidence) AS score FROM judgements WHERE is_match AND regexp_matches(candidate_id, '\\S') AND confidence > 0.7 AND confidence <= 1.000001 AND NOT isnan(confidence) AND mode IN ('concept', 'concept-parent', 'concept-children') GROUP BY ALL)"


def _voters(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements").filter("is_match and confidence > 0.7 and confidence <= 1.000001").filter(F.col("mode").isin(MODES) & nonblank(F.col("candidate_id")))
    return j.select("pair", "source_id", F.col("candidate_id").alias("target_id"), "mode", F.col("confidence").alias("score"))


@query(f"WITH {_VOTES} SELECT pair, source_id, target_id, count(*) AS votes, round(avg(score), 6) AS score FROM v GROUP BY pair, source_id, target_id HAVING count(*) >= 2")
def vote_two_of_three(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.votes(_voters(spark, d)))


@query()
def ensemble_mapping(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.greedy_injective(spark, assign.votes(_voters(spark, d))))


_PLURALITY = f"WITH {_VOTES}, p AS (SELECT pair, source_id, target_id, count(DISTINCT mode) AS votes, min(CASE mode WHEN 'concept' THEN 0 WHEN 'concept-parent' THEN 1 ELSE 2 END) AS place FROM v GROUP BY pair, source_id, target_id), q AS (SELECT *, row_number() OVER (PARTITION BY pair, source_id ORDER BY votes DESC, place, target_id) AS r FROM p)"


@query(_PLURALITY + " SELECT pair, source_id, target_id, votes, round(votes / 3, 6) AS score FROM q WHERE r = 1")
def plurality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.plurality(_voters(spark, d), MODES))


@query(
    _PLURALITY
    + """, b AS (SELECT pair, source_id, candidate_id AS target_id, max(confidence) AS score FROM judgements WHERE mode = 'concept' AND is_match AND regexp_matches(candidate_id, '\\S') AND confidence > 0.7 AND confidence <= 1.000001 AND NOT isnan(confidence) GROUP BY pair, source_id, candidate_id QUALIFY row_number() OVER (PARTITION BY pair, source_id ORDER BY max(confidence) DESC, candidate_id) = 1)
SELECT COALESCE(a.pair, b.pair) AS pair, COALESCE(a.source_id, b.source_id) AS source_id, COALESCE(a.target_id, '') AS old_target, COALESCE(b.target_id, '') AS new_target
FROM (SELECT * FROM q WHERE r = 1) a FULL JOIN b ON a.pair = b.pair AND a.source_id = b.source_id WHERE COALESCE(a.target_id, '') <> COALESCE(b.target_id, '')"""
)
def mapping_changes(spark: SparkSession, d: str) -> DataFrame:
    v = _voters(spark, d)
    one = assign.per_source_best(assign.clean(v.filter("mode = 'concept'")))
    return assign.mapping_changes(assign.plurality(v, MODES), one)


# -- retrieval --------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT p_partkey::VARCHAR AS id, p_partkey % 2 AS side, lower(trim(p_name)) AS k FROM part)
SELECT 'part' AS pair, s.id AS source_id, min(t.id) AS target_id, 1.0::DOUBLE AS score FROM p s JOIN p t ON s.k = t.k AND s.side = 0 AND t.side = 1 AND s.k <> '' GROUP BY s.id"""
)
def string_equiv_min_target(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.lit("part").alias("pair"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), "p_partkey")
    return retrieval.label_matches(p.filter("p_partkey % 2 = 0").withColumnRenamed("id", "source_id"), p.filter("p_partkey % 2 = 1").withColumnRenamed("id", "target_id"))


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.lit("all").alias("pair"), "vec_id", F.col("embedding").alias("vector"))
    q = e.filter("vec_id % 50 = 0").select("pair", F.col("vec_id").cast("string").alias("source_id"), "vector")
    return retrieval.similarity_top_k(q, e.select("pair", F.col("vec_id").cast("string").alias("target_id"), "vector"), k)


_NEAR = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id::VARCHAR AS source_id, t.vec_id::VARCHAR AS target_id, round(list_dot_product(q.v, t.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(t.v, t.v))), 9) AS score FROM e q JOIN e t ON q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM s)"""


@query(_NEAR + " SELECT 'all' AS pair, source_id, target_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_nearest(spark, d, 10)).withColumn("rank", F.col("rank").cast("bigint"))


@query(_NEAR + " SELECT 'all' AS pair, source_id, target_id, round(score, 6) AS score FROM r WHERE rank = 1 AND score >= 0.2")
def cosine_argmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.above(_nearest(spark, d, 1), 0.2).drop("rank"))


@query(_NEAR + " SELECT 'all' AS pair, source_id, target_id, round(score, 6) AS score FROM r WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id) = 1")
def cosine_dedupe_by_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assign.dedupe_by_target(_nearest(spark, d, 1).drop("rank"), -1.0))


_BM25 = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(COALESCE(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), tf AS (SELECT doc_id, len(w) AS size, unnest(w) AS t FROM d), tfc AS (SELECT doc_id, size, t, count(*) AS f FROM tf GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tfc GROUP BY t), idf AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, s), av AS (SELECT avg(i) AS a FROM idf),
q AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS t FROM eval_items), qc AS (SELECT item_id, t, count(*) AS k FROM q GROUP BY ALL),
sc AS (SELECT qc.item_id::VARCHAR AS source_id, tfc.doc_id::VARCHAR AS target_id, round(sum(k * (CASE WHEN i < 0 THEN 0.25 * a ELSE i END) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / mean))), 9) AS score FROM qc JOIN tfc ON tfc.t = qc.t JOIN idf ON idf.t = qc.t, av, s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM sc WHERE score > 0)"""


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("source_id"), "text")
    return retrieval.bm25_top_k(q, table(spark, d, "documents").select(F.col("doc_id").alias("target_id"), "text"), k)


@query(_BM25 + " SELECT source_id, target_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_bm25(spark, d, 5)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    _CAND
    + """a AS (SELECT pair, source_id, target_id, score, 0 AS list, rank FROM ranked WHERE rank <= 3),
b0 AS (SELECT pair, source_id, candidate_id AS target_id, max(confidence) AS score FROM judgements WHERE approach LIKE 'llm-%' AND regexp_matches(candidate_id, '\\S') AND confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1.000001 GROUP BY ALL),
b AS (SELECT pair, source_id, target_id, score, 1 AS list, row_number() OVER (PARTITION BY pair, source_id ORDER BY score DESC, target_id) AS rank FROM b0 QUALIFY rank <= 5),
u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY pair, source_id, target_id ORDER BY list, rank) = 1)
SELECT pair, source_id, target_id, round(score, 6) AS score, list, row_number() OVER (PARTITION BY pair, source_id ORDER BY list, u.rank, target_id) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY pair, source_id ORDER BY list, u.rank, target_id) <= 5"""
)
def hybrid_union(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "judgements").filter("approach like 'llm-%'").filter(F.col("confidence").between(0, 1.000001)).select("pair", "source_id", F.col("candidate_id").alias("target_id"), F.col("confidence").alias("score"))
    u = retrieval.hybrid_union(assign.top_k(_candidates(spark, d), 3), assign.top_k(assign.clean(b), 5), 5)
    return rounded(u).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def encoded_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = retrieval.encode(table(spark, d, "eval_items").select("item_id", "suite", "text"), "text")
    q = e.filter("item_id % 50 = 0").select("suite", F.col("item_id").cast("string").alias("source_id"), "vector").withColumnRenamed("suite", "pair")
    return rounded(retrieval.similarity_top_k(q, e.select(F.col("suite").alias("pair"), F.col("item_id").cast("string").alias("target_id"), "vector"), 1))


# -- graphs -----------------------------------------------------------------------------------

_G = """WITH RECURSIVE n AS (SELECT DISTINCT tax, node_id FROM nodes WHERE node_id IS NOT NULL), l AS (SELECT DISTINCT tax, child_id, parent_id FROM edges WHERE child_id IS NOT NULL AND parent_id IS NOT NULL),
e AS (SELECT l.* FROM l JOIN n c ON c.tax = l.tax AND c.node_id = l.child_id JOIN n p ON p.tax = l.tax AND p.node_id = l.parent_id),
lc AS (SELECT l.* FROM l JOIN n c ON c.tax = l.tax AND c.node_id = l.child_id),
up AS (SELECT tax, child_id AS node_id, parent_id AS anc FROM lc UNION SELECT up.tax, up.node_id, lc.parent_id FROM up JOIN lc ON lc.tax = up.tax AND lc.child_id = up.anc),
top AS (SELECT n.* FROM n ANTI JOIN l ON l.tax = n.tax AND l.child_id = n.node_id),
closure AS (SELECT * FROM up WHERE node_id <> anc),
"""


def _ne(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "nodes"), table(spark, d, "edges")


@query(_G + "x AS (SELECT 1) SELECT tax, node_id FROM top")
def roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(*_ne(spark, d))


@query(_G + "x AS (SELECT 1) SELECT lc.tax, child_id AS node_id, parent_id FROM lc ANTI JOIN n ON n.tax = lc.tax AND n.node_id = lc.parent_id")
def dangling_parent(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(*_ne(spark, d))


@query(_G + "x AS (SELECT 1) SELECT tax, node_id, anc AS ancestor_id FROM closure")
def closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(spark, *_ne(spark, d))


@query(_G + "down AS (SELECT tax, node_id FROM top UNION SELECT e.tax, e.child_id FROM down JOIN e ON e.tax = down.tax AND e.parent_id = down.node_id) SELECT tax, node_id FROM down")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(spark, *_ne(spark, d))


@query(_G + "x AS (SELECT 1) SELECT DISTINCT tax, node_id FROM up WHERE node_id = anc")
def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_nodes(spark, *_ne(spark, d))


_WALK = """bad AS (SELECT DISTINCT up.tax, up.node_id FROM up JOIN (SELECT DISTINCT tax, node_id FROM up WHERE node_id = anc) c ON c.tax = up.tax AND (c.node_id = up.anc OR c.node_id = up.node_id)),
walk AS (SELECT n.tax, n.node_id, 0::BIGINT AS k FROM n ANTI JOIN e ON e.tax = n.tax AND e.child_id = n.node_id UNION SELECT e.tax, e.child_id, walk.k + 1 FROM walk JOIN e ON e.tax = walk.tax AND e.parent_id = walk.node_id ANTI JOIN bad ON bad.tax = e.tax AND bad.node_id = e.child_id),
deep AS (SELECT tax, node_id, max(k) AS depth FROM walk GROUP BY ALL)"""


@query(_G + _WALK + " SELECT n.tax, n.node_id, d.depth FROM n LEFT JOIN deep d ON d.tax = n.tax AND d.node_id = n.node_id")
def depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.depths(spark, *_ne(spark, d))


@query(_G + _WALK + ", r AS (SELECT tax, count(*) AS root_count FROM top GROUP BY tax) SELECT n.tax, count(*) AS node_count, COALESCE(ANY_VALUE(r.root_count), 0) AS root_count, COALESCE(max(d.depth), 0) AS max_depth FROM n LEFT JOIN deep d ON d.tax = n.tax AND d.node_id = n.node_id LEFT JOIN r ON r.tax = n.tax GROUP BY n.tax")
def taxonomy_summary(spark: SparkSession, d: str) -> DataFrame:
    return consistency.taxonomy_summary(spark, *_ne(spark, d))


@query(
    _G
    + """far AS (SELECT tax, node_id, 0 AS k FROM (SELECT n.* FROM n ANTI JOIN e ON e.tax = n.tax AND e.child_id = n.node_id) UNION SELECT e.tax, e.child_id, far.k + 1 FROM far JOIN e ON e.tax = far.tax AND e.parent_id = far.node_id WHERE far.k < 400),
near AS (SELECT tax, node_id, min(k) AS k FROM far GROUP BY ALL),
pick AS (SELECT e.tax, e.child_id AS node_id, min(e.parent_id) AS p FROM e JOIN near a ON a.tax = e.tax AND a.node_id = e.child_id JOIN near b ON b.tax = e.tax AND b.node_id = e.parent_id AND b.k = a.k - 1 GROUP BY ALL),
chain AS (SELECT tax, node_id, node_id AS at, node_id AS chain FROM n UNION ALL SELECT c.tax, c.node_id, p.p, p.p || ' > ' || c.chain FROM chain c JOIN pick p ON p.tax = c.tax AND p.node_id = c.at)
SELECT c.tax, c.node_id, c.chain FROM chain c ANTI JOIN pick p ON p.tax = c.tax AND p.node_id = c.at"""
)
def shortest_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_chains(spark, *_ne(spark, d)).withColumn("chain", F.array_join("chain", " > "))


@query()
def dfs_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.back_edges(*_ne(spark, d)).withColumn("cycle", F.array_join("cycle", " > "))


_ADJ = """b AS (SELECT tax, child_id AS i, parent_id AS j FROM e UNION SELECT tax, parent_id, child_id FROM e UNION SELECT tax, node_id, node_id FROM n), g AS (SELECT tax, i, count(*) AS d FROM b GROUP BY ALL),
adj AS (SELECT b.tax, b.i, b.j, 1 / sqrt(x.d::DOUBLE * y.d) AS w FROM b JOIN g x ON x.tax = b.tax AND x.i = b.i JOIN g y ON y.tax = b.tax AND y.i = b.j)"""


@query(_G + _ADJ + " SELECT tax, i, j, round(w, 6) AS w FROM adj")
def sym_norm_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.adjacency(*_ne(spark, d)))


@query(_G + _ADJ + ", v AS (SELECT tax, node_id, COALESCE(max(depth), 0)::DOUBLE AS value FROM nodes GROUP BY ALL) SELECT adj.tax, i AS node_id, round(sum(w * value), 6) AS value FROM adj JOIN v ON v.tax = adj.tax AND v.node_id = adj.j GROUP BY ALL")
def neighbour_sum(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    v = n.groupBy("tax", "node_id").agg(F.coalesce(F.max("depth"), F.lit(0)).cast("double").alias("value"))
    return rounded(graph.neighbour_sum(graph.adjacency(n, e), v))


# -- consistency ------------------------------------------------------------------------------


@query(r"WITH x AS (SELECT tax, node_id, regexp_replace(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS label FROM nodes WHERE name IS NOT NULL) SELECT tax, label, count(DISTINCT node_id) AS n, min(node_id) AS first_id FROM x WHERE label <> '' GROUP BY tax, label HAVING count(DISTINCT node_id) > 1")
def duplicate_label(spark: SparkSession, d: str) -> DataFrame:
    return consistency.duplicate_labels(table(spark, d, "nodes"))


def _disjoint(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last child of every parent, declared disjoint."""
    e = table(spark, d, "edges").groupBy("tax", "parent_id").agg(F.min("child_id").alias("node_id"), F.max("child_id").alias("other_id"))
    return e.select("tax", "node_id", "other_id")


_DIS = "dd AS (SELECT DISTINCT tax, min(child_id) AS x, max(child_id) AS y FROM edges GROUP BY tax, parent_id HAVING min(child_id) <> max(child_id)), dp AS (SELECT dd.* FROM dd JOIN n a ON a.tax = dd.tax AND a.node_id = dd.x JOIN n b ON b.tax = dd.tax AND b.node_id = dd.y)"


@query(_G + _DIS + ", sc AS (SELECT tax, node_id, anc FROM closure UNION SELECT tax, node_id, node_id FROM n) SELECT dp.tax, dp.x, dp.y, count(DISTINCT a.node_id) AS n, min(a.node_id) AS first_id FROM dp JOIN sc a ON a.tax = dp.tax AND a.anc = dp.x JOIN sc b ON b.tax = dp.tax AND b.anc = dp.y AND b.node_id = a.node_id GROUP BY ALL")
def disjoint_common_descendant(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return consistency.disjoint_ancestors(graph.disjoint_pairs(n, _disjoint(spark, d)), graph.ancestors(spark, n, e), n)


@query()
def taxonomy_findings(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return consistency.taxonomy_findings(spark, n, e, _disjoint(spark, d))


_MX = _M + _G.replace("WITH RECURSIVE ", "") + _DIS + ", mm AS (SELECT DISTINCT approach || '|' || pair AS pair, source_id, target_id FROM m WHERE approach <> 'string-equiv'), "
_CARD = "card AS (SELECT pair, 'source' AS side, source_id AS node_id, count(*) AS n FROM mm GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT pair, 'target', target_id, count(*) FROM mm GROUP BY ALL HAVING count(*) > 1)"
_REL = "rel AS (SELECT DISTINCT node_id AS a, anc AS b FROM closure UNION SELECT DISTINCT anc, node_id FROM closure), dxy AS (SELECT DISTINCT x, y FROM dp)"
_CLASH = "cl AS (SELECT a.pair, d.x, d.y, a.target_id AS mx, b.target_id AS my FROM dxy d JOIN mm a ON a.source_id = d.x JOIN mm b ON b.pair = a.pair AND b.source_id = d.y LEFT JOIN rel r ON r.a = a.target_id AND r.b = b.target_id WHERE a.target_id = b.target_id OR r.a IS NOT NULL), ct AS (SELECT a.pair, d.x, d.y, a.source_id AS mx, b.source_id AS my FROM dxy d JOIN mm a ON a.target_id = d.x JOIN mm b ON b.pair = a.pair AND b.target_id = d.y LEFT JOIN rel r ON r.a = a.source_id AND r.b = b.source_id WHERE a.source_id = b.source_id OR r.a IS NOT NULL)"
_SUB = "pl AS (SELECT DISTINCT child_id, parent_id FROM edges WHERE parent_id IS NOT NULL), dc AS (SELECT DISTINCT node_id, anc FROM closure), sub AS (SELECT DISTINCT a.pair, a.source_id, a.target_id FROM mm a JOIN pl ON pl.child_id = a.source_id JOIN mm p ON p.pair = a.pair AND p.source_id = pl.parent_id AND p.target_id <> a.target_id ANTI JOIN dc ON dc.node_id = a.target_id AND dc.anc = p.target_id)"
_FLAGS = "fl AS (SELECT mm.*, 'cardinality' AS kind FROM mm JOIN card ON card.pair = mm.pair AND (side = 'source' AND card.node_id = source_id OR side = 'target' AND card.node_id = target_id) UNION SELECT pair, x, mx, 'disjointness-violation' FROM cl UNION SELECT pair, y, my, 'disjointness-violation' FROM cl UNION SELECT pair, mx, x, 'disjointness-violation' FROM ct UNION SELECT pair, my, y, 'disjointness-violation' FROM ct UNION SELECT *, 'subsumption-violation' FROM sub)"
_ALL = _MX + ", ".join((_CARD, _REL, _CLASH, _SUB, _FLAGS))


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).select(_keyed_pair().alias("pair"), "source_id", "target_id").distinct()


def _flags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = _ne(spark, d)
    s = Scratch(spark, "audit")
    m, _ = s.save(_mapping(spark, d))
    c, _ = s.save(graph.ancestors(spark, n, e))
    return m, s.save(consistency.flags(m, e, graph.disjoint_pairs(n, _disjoint(spark, d)), c))[0]


@query(_MX + _CARD + " SELECT pair, side, node_id, n FROM card")
def cardinality_groups(spark: SparkSession, d: str) -> DataFrame:
    return consistency.cardinality_groups(_mapping(spark, d))


@query(_MX + ", ".join((_REL, _CLASH)) + " SELECT pair, x, y, mx, my FROM cl")
def disjointness_clash(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return consistency.disjointness_clashes(_mapping(spark, d), graph.disjoint_pairs(n, _disjoint(spark, d)), graph.ancestors(spark, n, e))


@query(_MX + _SUB + " SELECT pair, source_id, target_id FROM sub")
def subsumption_violation(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    return consistency.subsumption_violations(_mapping(spark, d), e, graph.ancestors(spark, n, e))


@query(_ALL + " SELECT kind, count(*) AS n FROM fl GROUP BY kind")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return consistency.kind_counts(_flags(spark, d)[1])


@query(_ALL + " SELECT pair, source_id, target_id FROM mm ANTI JOIN (SELECT * FROM fl WHERE kind <> 'subsumption-violation') f USING (pair, source_id, target_id)")
def filter_flagged(spark: SparkSession, d: str) -> DataFrame:
    m, f = _flags(spark, d)
    return consistency.drop_flagged(m, f, ("cardinality", "disjointness-violation"))


@query(
    _ALL
    + """, gd AS (SELECT DISTINCT a.approach || '|' || pair AS pair, source_id, target_id FROM m, (SELECT DISTINCT approach FROM matches WHERE approach <> 'string-equiv') a WHERE m.approach = 'string-equiv'), ff AS (SELECT DISTINCT pair, source_id, target_id FROM fl),
j AS (SELECT mm.pair, f.pair IS NOT NULL AS f, g.pair IS NULL AS wrong FROM mm LEFT JOIN ff f USING (pair, source_id, target_id) LEFT JOIN gd g USING (pair, source_id, target_id)),
c AS (SELECT pair, count(*) AS matches, count(*) FILTER (f) AS flagged, count(*) FILTER (f AND wrong) AS flagged_errors, count(*) FILTER (wrong) AS errors FROM j GROUP BY pair)
SELECT *, round(CASE WHEN flagged = 0 THEN 0 ELSE flagged_errors / flagged END, 6) AS error_precision, round(CASE WHEN errors = 0 THEN 0 ELSE flagged_errors / errors END, 6) AS error_recall, round(errors / matches, 6) AS base_error_rate,
 round(CASE WHEN flagged = 0 THEN 0 ELSE flagged_errors / flagged END - errors / matches, 6) AS precision_lift FROM c"""
)
def flag_quality(spark: SparkSession, d: str) -> DataFrame:
    m, f = _flags(spark, d)
    return rounded(consistency.flag_quality(m, f, _gold_for_all(spark, d)))


# -- selection and statistics -----------------------------------------------------------------

_F1 = (
    _M
    + """
gold AS (SELECT DISTINCT pair, source_id, target_id FROM m WHERE approach = 'string-equiv'),
pr AS (SELECT approach, mode, pair, source_id, target_id, max(confidence) AS score FROM m WHERE confidence IS NOT NULL AND approach <> 'string-equiv' AND mode IS NOT NULL GROUP BY ALL),
bp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY approach, mode, pair, source_id ORDER BY score DESC, target_id) = 1),
gc AS (SELECT pair, count(*) AS g FROM gold GROUP BY pair),
sc AS (SELECT approach, mode, b.pair, 2.0::DOUBLE * count(gold.pair) / (count(*) + COALESCE(ANY_VALUE(gc.g), 0)) AS f1 FROM bp b LEFT JOIN gold USING (pair, source_id, target_id) LEFT JOIN gc ON gc.pair = b.pair GROUP BY ALL)
"""
)


def _mode_scores(spark: SparkSession, d: str) -> DataFrame:
    """``approach``, ``mode``, ``pair``, ``f1`` of every mapping against the reference."""
    m = _matches(spark, d).filter("approach <> 'string-equiv' and mode is not null and confidence is not null").withColumn("score", F.col("confidence"))
    key = F.concat_ws("\u0001", "approach", "mode", "pair")
    best = assign.per_source_best(assign.clean(m.withColumn("pair", key))).select(*[F.split("pair", "\u0001")[i].alias(c) for i, c in enumerate(("approach", "mode", "pair"))], "source_id", "target_id")
    gold = _gold(spark, d)
    size = gold.groupBy("pair").agg(F.count(F.lit(1)).alias("g"))
    hit = best.join(gold.withColumn("h", F.lit(1)), ["pair", "source_id", "target_id"], "left").groupBy("approach", "mode", "pair").agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("tp"))
    f1 = 2.0 * F.col("tp") / (F.col("n") + F.coalesce("g", F.lit(0)))
    return Scratch(spark, "scores").save(hit.join(size, "pair", "left").select("approach", "mode", "pair", f1.alias("f1")))[0]


@query(_F1 + "SELECT approach, mode, pair, round(f1, 6) AS f1 FROM sc")
def mode_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_mode_scores(spark, d))


@query(
    _F1
    + """, o AS (SELECT a.*, round((sum(f1) OVER (PARTITION BY approach, mode) - f1) / (count(*) OVER (PARTITION BY approach, mode) - 1), 12) AS others FROM sc a WHERE mode IN ('concept', 'concept-parent', 'concept-children'))
SELECT approach, pair, mode, round(f1, 6) AS f1 FROM o QUALIFY row_number() OVER (PARTITION BY approach, pair ORDER BY others DESC, CASE mode WHEN 'concept' THEN 0 WHEN 'concept-parent' THEN 1 ELSE 2 END) = 1"""
)
def loo_mode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.loo_mode(_mode_scores(spark, d), MODES, ["approach"]))


_CONF = _F1 + ", pm AS (SELECT approach, pair, avg(f1) AS raw, max(f1) AS best FROM sc WHERE mode IN ('concept', 'concept-parent', 'concept-children') GROUP BY ALL), cf AS (SELECT approach, 'raw' AS variant, pair, raw AS f1 FROM pm UNION ALL SELECT approach, 'oracle', pair, best FROM pm UNION ALL SELECT approach, 'ensemble', pair, f1 FROM sc WHERE mode = 'ensemble')"


def _configs(spark: SparkSession, d: str) -> DataFrame:
    return selection.configurations(_mode_scores(spark, d), MODES)


@query(_CONF + " SELECT approach, variant, pair, round(f1, 6) AS f1 FROM cf")
def configurations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_configs(spark, d))


#: (label, first, second): each approach's variants against each other, and the approaches' raw scores.
COMPARISONS = [(f"{a}: {x} - {y}", f"{a} {x}", f"{a} {y}") for a in ("embedding-a", "llm-alpha", "llm-beta") for x, y in (("ensemble", "raw"), ("oracle", "raw"), ("oracle", "ensemble"))] + [(f"{x} - {y}", f"{x} raw", f"{y} raw") for x, y in (("embedding-a", "llm-alpha"), ("embedding-a", "llm-beta"), ("llm-alpha", "llm-beta"))]
_DIFF = _CONF + f", w AS (SELECT approach || ' ' || variant AS config, pair, f1 FROM cf), cm AS (SELECT * FROM (VALUES {', '.join(map(str, COMPARISONS))}) v(label, first, second)), df AS (SELECT label, x.pair, x.f1 AS a, y.f1 AS b, x.f1 - y.f1 AS diff FROM cm JOIN w x ON x.config = cm.first JOIN w y ON y.config = cm.second AND y.pair = x.pair)"


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame(COMPARISONS, "label string, first string, second string")
    both = statistics.paired(_configs(spark, d).select(F.concat_ws(" ", "approach", "variant").alias("config"), "pair", "f1"), c)
    return Scratch(spark, "diffs").save(both)[0]


@query(_DIFF + " SELECT label, count(*) AS pairs, round(avg(a), 6) AS first_mean, round(avg(b), 6) AS second_mean, round(avg(diff), 6) AS mean_difference, count(*) FILTER (diff > 1e-9) AS wins, count(*) FILTER (abs(diff) <= 1e-9) AS ties, count(*) FILTER (diff < -1e-9) AS losses FROM df GROUP BY label")
def wtl_paired(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.wins_ties_losses(_diffs(spark, d)))


@query(_DIFF + ", z AS (SELECT label, diff, round(abs(diff), 12) AS size FROM df WHERE abs(diff) > 1e-12), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY size) + (count(*) OVER (PARTITION BY label, size) - 1) / 2.0::DOUBLE AS rk FROM z), g AS (SELECT label, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN rk ELSE 0 END) AS w_minus FROM r GROUP BY label) SELECT label, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic FROM g")
def signed_rank_w(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.signed_ranks(_diffs(spark, d)))


@query()
def wilcoxon_holm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.adjusted(statistics.wilcoxon(_diffs(spark, d))))


@query("WITH t AS (SELECT event_type AS label, least(1.0, round(avg(value) / 1000, 6)) AS p_value FROM events GROUP BY event_type), r AS (SELECT *, row_number() OVER (ORDER BY p_value, label) - 1 AS i, count(*) OVER () AS m FROM t) SELECT label, p_value, round(max(least(1.0, p_value * (m - i))) OVER (ORDER BY p_value, label ROWS UNBOUNDED PRECEDING), 6) AS p_holm, round(least(1.0, p_value * m), 6) AS p_bonferroni FROM r")
def holm_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.least(F.lit(1.0), F.round(F.avg("value") / 1000, 6)).alias("p_value"))
    return rounded(statistics.adjusted(t))


@query(
    _DIFF
    + """, i AS (SELECT label, diff, row_number() OVER (PARTITION BY label ORDER BY pair) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM df), dr AS (SELECT label, n, i AS j, unnest(range(10000)) AS round FROM i),
x0 AS (SELECT *, (20260601 + round * 7919 + j * 104729) % 2147483648 AS x FROM dr), x1 AS (SELECT *, (x * 1103515245 + 12345) % 2147483648 AS y FROM x0), x2 AS (SELECT *, (y * 1103515245 + 12345) % 2147483648 AS z FROM x1),
mn AS (SELECT x2.label, x2.round, avg(i.diff) AS mean FROM x2 JOIN i ON i.label = x2.label AND i.i = (z >> 8) % x2.n GROUP BY ALL)
SELECT label, round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high FROM mn GROUP BY label"""
)
def bootstrap_lcg_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.bootstrap(_diffs(spark, d)))


@query("SELECT user_id, count(*) AS runs, round(avg(value), 6) AS mean, round(COALESCE(stddev_samp(value), 0), 6) AS stdev, round(min(value), 6) AS low, round(max(value), 6) AS high, round(max(value) - min(value), 6) AS range FROM events GROUP BY user_id")
def repeat_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.spread(table(spark, d, "events"), "user_id", "value"))


# -- journal ----------------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT event_type AS mode, event_type = 'error' AS failed, json_extract_string(props, '$.k')::DOUBLE AS cost, CASE WHEN event_type <> 'error' THEN value END AS latency FROM events)
SELECT mode, count(*) AS attempts, count(*) FILTER (NOT failed) AS successes, round(sum(cost), 6) AS cost, count(cost) AS cost_known, count(*) - count(cost) AS cost_missing, round(min(latency), 6) AS latency_min, round(avg(latency), 6) AS latency_mean, round(max(latency), 6) AS latency_max,
 round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.9), 6) AS p90, round(quantile_cont(latency, 0.95), 6) AS p95 FROM b GROUP BY GROUPING SETS ((mode), ())"""
)
def request_accounting(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cost", F.expr("try_cast(get_json_object(props, '$.k') AS double)"))
    return rounded(journal.accounting(e, "event_type", "value", "cost", F.col("event_type") == "error").drop("whole"))


@query("WITH r AS (SELECT user_id, event_id, sum(CASE WHEN value >= 0 AND NOT isnan(value) THEN value ELSE 100 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT user_id, event_id, round(spent, 6) AS spent FROM r WHERE spent <= 500")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(journal.within_budget(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 500.0, 100.0).select("user_id", "event_id", "spent"))


def _keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    types = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type")
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    expected = e.select("user_id").distinct().join(types).select(key.alias("key"))
    return expected, e.select(key.alias("key"), F.when(F.col("event_type") == "error", "failed").alias("error"))


@query("WITH x AS (SELECT DISTINCT user_id || '/' || t.event_type AS key FROM events, (SELECT DISTINCT event_type FROM events) t) SELECT key FROM x WHERE key NOT IN (SELECT user_id || '/' || event_type FROM events WHERE event_type <> 'error')")
def journal_missing(spark: SparkSession, d: str) -> DataFrame:
    return journal.missing(*_keyed(spark, d))


@query("SELECT user_id || '/' || event_type AS key, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) > 1")
def journal_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return journal.duplicates(_keyed(spark, d)[1])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def journal_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = stream.windowed_accounting(e, "ts", "1 hour", "1 hour", "event_type", "value")
    return rounded(w.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("SELECT DISTINCT event_id FROM events")
def journal_stream(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    raw = stream.read_stream(spark, f"{d}/events.parquet*", schema)
    out = stream.deduplicated(raw.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", "365 days")
    stream.run_available(out.select("event_id"), f"{s.root}/out", f"{s.root}/state")
    return spark.read.schema("event_id bigint").parquet(f"{s.root}/out")


# -- text and reports -------------------------------------------------------------------------

_NODE = "nd AS (SELECT tax, node_id, arg_max(COALESCE(name, ''), loaded_at) AS name, arg_max(COALESCE(comment, ''), loaded_at) AS comment, arg_max(COALESCE(attributes, MAP {}), loaded_at) AS attributes FROM nodes GROUP BY tax, node_id), txt AS (SELECT tax, node_id, string_agg(k || ': ' || COALESCE(v, ''), ', ' ORDER BY k) AS s, string_agg(k || ': ' || COALESCE(v, ''), '; ' ORDER BY k) AS s2 FROM (SELECT tax, node_id, e.key AS k, e.value AS v FROM (SELECT tax, node_id, unnest(map_entries(attributes)) AS e FROM nd)) GROUP BY tax, node_id)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return n.groupBy("tax", "node_id").agg(*[F.max_by(F.coalesce(c, x), "loaded_at").alias(c) for c, x in (("name", F.lit("")), ("comment", F.lit("")), ("attributes", empty))])


@query(f"WITH {_NODE} SELECT nd.tax, nd.node_id, 'Name: ' || name || COALESCE(chr(10) || 'Attributes: ' || s, '') || CASE WHEN comment <> '' THEN chr(10) || 'Comment: ' || comment ELSE '' END AS text FROM nd LEFT JOIN txt USING (tax, node_id)")
def description_text(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return _texts(spark, d).select("tax", "node_id", description("name+disjoint+comment", F.col("name"), none, F.col("attributes"), none, F.col("comment")).alias("text"))


@query(f"WITH {_NODE} SELECT nd.tax, nd.node_id, translate(lower('Name: ' || name || COALESCE(chr(10) || 'Attributes: ' || s2, '') || CASE WHEN comment <> '' THEN chr(10) || 'Comment: ' || comment ELSE '' END), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '') AS text FROM nd LEFT JOIN txt USING (tax, node_id)")
def concept_texts(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return _texts(spark, d).select("tax", "node_id", concept_text("concept", F.col("name"), none, none, F.col("attributes"), none, F.col("comment")).alias("text"))


@query(r"SELECT DISTINCT p_name, lower(trim(p_name)) AS k, regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g') AS c, translate(p_name, '#. ', '___') AS safe FROM part")
def label_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_name", label_key(n).alias("k"), collapsed(n).alias("c"), safe_id(n).alias("safe")).distinct()


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\bsmall\b') THEN regexp_replace(p_name, '(?i)\bsmall\b', 'little', 'g') WHEN regexp_matches(p_name, '(?i)\bred\b') THEN regexp_replace(p_name, '(?i)\bred\b', 'crimson', 'g') WHEN regexp_matches(p_name, '(?i)\bbox\b') THEN regexp_replace(p_name, '(?i)\bbox\b', 'case', 'g') ELSE p_name END AS name FROM part")
def synonym_first_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", synonym_first(F.col("p_name"), [("small", "little"), ("red", "crimson"), ("box", "case")]).alias("name"))


@query("SELECT count(*) AS nodes, 0::BIGINT AS missing, 0::BIGINT AS names, 0::BIGINT AS comments, 0::BIGINT AS depths, 0::BIGINT AS attributes FROM (SELECT DISTINCT tax, node_id FROM nodes)")
def content_diff_exact(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    n = n.groupBy("tax", "node_id").agg(*[F.max_by(c, "loaded_at").alias(c) for c in ("name", "comment", "depth", "attributes")])
    return synth.content_differences(n, synth.exact(n, e)[0])


@query()
def synthetic_variants(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    n, _ = Scratch(spark, "base").save(n.groupBy("tax", "node_id").agg(*[F.max_by(c, "loaded_at").alias(c) for c in ("name", "comment", "depth", "attributes")]))
    made = {"SYN": synth.synonym(n, e), "STR": synth.structural(spark, n, e), "ATTR": synth.attributes(n, e)}
    out = None
    for k, (v, _) in made.items():
        x = synth.content_differences(n, v).withColumn("scenario", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


_CELLS = "WITH x AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, avg(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.avg("o_totalprice").alias("v"))


@query(_CELLS + " SELECT segment, priority, round(v, 4) AS v, v = max(v) OVER (PARTITION BY segment) AS is_best FROM x")
def pivot_best_cell(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.best_cells(_cells(spark, d), "segment", "priority", "v"), 4)


@query(_CELLS + " SELECT segment, priority, round(v, 4) AS v, row_number() OVER (PARTITION BY segment ORDER BY v, priority) AS rank FROM x QUALIFY rank <= 3")
def worst_cells(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.worst(_cells(spark, d), "segment", "priority", "v"), 4).withColumn("rank", F.col("rank").cast("bigint"))


_AL = r"""WITH k AS (SELECT align_id, source, target, regexp_replace(lower(regexp_replace(source, '^[\s<]+|[\s>]+$', '', 'g')), '[#/]+$', '') AS s, regexp_replace(lower(regexp_replace(target, '^[\s<]+|[\s>]+$', '', 'g')), '[#/]+$', '') AS t FROM alignments WHERE regexp_matches(source, '\S') AND regexp_matches(target, '\S')),
f AS (SELECT align_id, CASE WHEN s LIKE '%://%' THEN s ELSE regexp_replace(regexp_extract(s, '([^/]*)$', 1), '\.(owl|rdf|ttl|xml)$', '') END AS s, CASE WHEN t LIKE '%://%' THEN t ELSE regexp_replace(regexp_extract(t, '([^/]*)$', 1), '\.(owl|rdf|ttl|xml)$', '') END AS t FROM k),
nm AS (SELECT lower(tax) AS key, lower(tax) AS canon FROM taxonomies UNION SELECT lower(short), lower(tax) FROM taxonomies UNION SELECT regexp_replace(lower(namespace), '[#/]+$', ''), lower(tax) FROM taxonomies),
r AS (SELECT align_id, COALESCE(a.canon, s) AS source, COALESCE(b.canon, t) AS target FROM f LEFT JOIN nm a ON a.key = s LEFT JOIN nm b ON b.key = t)"""


def _directed(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "taxonomies")
    a = resolve_taxonomy(resolve_taxonomy(table(spark, d, "alignments").select("align_id", "source", "target"), "source", known, "s"), "target", known, "t")
    return a.filter("s is not null and t is not null").select("align_id", F.col("s").alias("source"), F.col("t").alias("target"), pair_key(F.col("s"), F.col("t")).alias("pair"))


@query(_AL + " SELECT least(source, target) || '↔' || greatest(source, target) AS pair, count(*) AS n FROM r GROUP BY ALL")
def canonical_pair_key(spark: SparkSession, d: str) -> DataFrame:
    return _directed(spark, d).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query(_AL + ", p AS (SELECT *, least(source, target) || '↔' || greatest(source, target) AS pair FROM r), c AS (SELECT pair, arg_min(source, align_id) AS ws, arg_min(target, align_id) AS wt FROM p GROUP BY pair) SELECT align_id, p.pair FROM p JOIN c ON c.pair = p.pair WHERE source <> ws OR target <> wt")
def misoriented(spark: SparkSession, d: str) -> DataFrame:
    from crosslattice.sources.records import misoriented as turned

    a = _directed(spark, d)
    c = a.groupBy("pair").agg(F.min_by("source", "align_id").alias("source"), F.min_by("target", "align_id").alias("target"))
    return turned(a, c).select("align_id", "pair")


@query()
def dot_graph(spark: SparkSession, d: str) -> DataFrame:
    return reports.dot_lines(*_ne(spark, d))


@query()
def gnn_forward(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ne(spark, d)
    own = retrieval.encode(n.groupBy("tax", "node_id").agg(F.coalesce(F.max("name"), F.lit("")).alias("name")), "name", lambda t: retrieval.hashed_vector(t, 32))
    rng = np.random.default_rng(42)
    out = neural.forward(graph.adjacency(n, e), own.select("tax", "node_id", "vector"), [neural.Layer(32, 32, rng)], rng.standard_normal((32, 16)))
    return out.select("tax", "node_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


_CORE = "core AS (SELECT * FROM sc WHERE mode IN ('concept', 'concept-parent', 'concept-children'))"


@query(
    _F1
    + f""", {_CORE}, per AS (SELECT approach, pair, avg(f1) AS m, max(f1) AS o FROM core GROUP BY ALL),
o AS (SELECT *, round((sum(f1) OVER (PARTITION BY approach, mode) - f1) / (count(*) OVER (PARTITION BY approach, mode) - 1), 12) AS others FROM core), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY approach, pair ORDER BY others DESC, CASE mode WHEN 'concept' THEN 0 WHEN 'concept-parent' THEN 1 ELSE 2 END) = 1)
SELECT approach, round(avg(m), 6) AS mean_f1, round(avg(o), 6) AS oracle_f1, count(*) AS pairs, round(ANY_VALUE(x.f1), 6) AS loo_f1 FROM per JOIN (SELECT approach, avg(f1) AS f1 FROM l GROUP BY ALL) x USING (approach) GROUP BY approach"""
)
def mode_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.mode_aggregates(_mode_scores(spark, d), MODES, ["approach"]))


@query(_PRED + f"s AS (SELECT *, {_PRF} FROM counts) SELECT split_part(pair, '|', 1) AS approach, sum(round_even(precision * predicted, 0))::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(gold)::BIGINT AS gold, round(2 * sum(round_even(precision * predicted, 0)) / (sum(predicted) + sum(gold)), 6) AS pooled_f1 FROM s GROUP BY ALL")
def pooled_from_records(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.evaluate(_predictions(spark, d), _gold_for_all(spark, d)).withColumn("approach", _approach())
    return rounded(evaluate.pooled_from_records(r))


@query(_CELLS + " SELECT segment, round(max(v) FILTER (priority = '1-URGENT'), 4) AS \"1-URGENT\", round(max(v) FILTER (priority = '5-LOW'), 4) AS \"5-LOW\" FROM x GROUP BY segment")
def pivot_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.pivoted(_cells(spark, d), "segment", "priority", "v", ["1-URGENT", "5-LOW"]), 4)


@query(
    _F1
    + """, th AS (SELECT unnest([0.0, 0.5, 0.7, 0.9])::DOUBLE AS threshold), pm AS (SELECT DISTINCT approach, mode, pair FROM bp WHERE mode IN ('concept', 'concept-parent', 'concept-children')),
hs AS (SELECT b.*, gold.pair IS NOT NULL AS hit FROM bp b LEFT JOIN gold USING (pair, source_id, target_id)),
sw AS (SELECT pm.approach, pm.mode, pm.pair, th.threshold, count(hs.pair) AS n, count(*) FILTER (hs.hit) AS tp, COALESCE(ANY_VALUE(gc.g), 0) AS g FROM pm CROSS JOIN th LEFT JOIN hs ON hs.approach = pm.approach AND hs.mode = pm.mode AND hs.pair = pm.pair AND hs.score >= th.threshold LEFT JOIN gc ON gc.pair = pm.pair GROUP BY ALL),
sf AS (SELECT approach, mode, pair, threshold, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (n + g) END AS f1 FROM sw),
o AS (SELECT *, round((sum(f1) OVER (PARTITION BY approach, mode, threshold) - f1) / (count(*) OVER (PARTITION BY approach, mode, threshold) - 1), 12) AS others FROM sf)
SELECT approach, pair, mode, threshold, round(f1, 6) AS f1 FROM o QUALIFY row_number() OVER (PARTITION BY approach, pair ORDER BY others DESC, threshold, CASE mode WHEN 'concept' THEN 0 WHEN 'concept-parent' THEN 1 ELSE 2 END) = 1"""
)
def loo_mode_and_threshold(spark: SparkSession, d: str) -> DataFrame:
    m = _audited(spark, d).filter("confidence is not null").filter(F.col("mode").isin(MODES)).withColumn("score", F.col("confidence"))
    both = F.concat_ws("\u0001", "approach", "mode", "pair")
    gold = _gold(spark, d)
    wide = m.select("approach", "mode", "pair").distinct().join(gold, "pair").select(both.alias("pair"), "source_id", "target_id")
    s = evaluate.threshold_sweep(assign.clean(m.withColumn("pair", both)), wide, (0.0, 0.5, 0.7, 0.9))
    s, _ = Scratch(spark, "joint").save(s.select(*[F.split("pair", "\u0001")[i].alias(c) for i, c in enumerate(("approach", "mode", "pair"))], "threshold", "f1"))
    return rounded(selection.loo_joint(s, MODES, ["approach"]))
