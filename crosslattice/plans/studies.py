"""Queries that put operators together: whole evaluations, summaries, and sources written and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.functions.text import retryable, sweep_key
from crosslattice.operators import assign, consistency, evaluate, graph, neural, retrieval, study, synth
from crosslattice.plans import catalogue as base
from crosslattice.plans.catalogue import MODES, rounded
from crosslattice.runtime import Scratch, nonblank
from crosslattice.sources import owl, records
from crosslattice.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def greedy_sql(rows: str, name: str = "taken") -> str:
    """Common tables that fold the rows (pair, source_id, target_id, score) in order, taking each that joins two free ids."""
    return f"""ord_{name} AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, source_id, target_id) AS i FROM {rows}),
fold_{name} AS (SELECT DISTINCT pair, 0::BIGINT AS i, []::VARCHAR[] AS us, []::VARCHAR[] AS ut, NULL::VARCHAR AS source_id, NULL::VARCHAR AS target_id, NULL::DOUBLE AS score, false AS ok FROM {rows}
  UNION ALL SELECT pair, i, CASE WHEN free THEN list_append(us, source_id) ELSE us END, CASE WHEN free THEN list_append(ut, target_id) ELSE ut END, source_id, target_id, score, free
  FROM (SELECT o.pair, o.i, f.us, f.ut, o.source_id, o.target_id, o.score, NOT list_contains(f.us, o.source_id) AND NOT list_contains(f.ut, o.target_id) AS free FROM fold_{name} f JOIN ord_{name} o ON o.pair = f.pair AND o.i = f.i + 1)),
{name} AS (SELECT pair, source_id, target_id, score FROM fold_{name} WHERE ok)"""


_CAND = base._CAND.replace("WITH c AS", "WITH RECURSIVE c AS")
base.SQL["greedy_injective"] = _CAND + "hi AS (SELECT pair, source_id, target_id, score FROM c WHERE score >= 0.5), " + greedy_sql("hi") + " SELECT pair, source_id, target_id, round(score, 6) AS score FROM taken"
base.SQL["judged_mapping"] = (
    "WITH RECURSIVE hi AS (SELECT pair, source_id, candidate_id AS target_id, max(confidence) AS score FROM judgements WHERE is_match AND regexp_matches(candidate_id, '\\S') AND regexp_matches(source_id, '\\S') AND confidence > 0.7 AND confidence <= 1.000001 AND NOT isnan(confidence) GROUP BY ALL), "
    + greedy_sql("hi")
    + ", s AS (SELECT DISTINCT pair, source_id FROM judgements WHERE source_id IS NOT NULL) SELECT pair, source_id, COALESCE(target_id, '') AS target_id, round(COALESCE(score, 0), 6) AS score FROM s LEFT JOIN taken USING (pair, source_id)"
)
base.SQL["ensemble_mapping"] = f"WITH RECURSIVE {base._VOTES}, hi AS (SELECT pair, source_id, target_id, avg(score) AS score FROM v GROUP BY pair, source_id, target_id HAVING count(*) >= 2), " + greedy_sql("hi") + " SELECT pair, source_id, target_id, round(score, 6) AS score FROM taken"


# -- evaluation -------------------------------------------------------------------------------

_SWEPT = base._SWEEP[len(base._M) :]
_AT = """, sp AS (SELECT split_part(pair, '|', 1) AS approach, split_part(pair, '|', 2) AS p, pair, threshold, gold, predicted, tp, f1 FROM sweep),
o AS (SELECT *, round((sum(f1) OVER (PARTITION BY approach, threshold) - f1) / (count(*) OVER (PARTITION BY approach, threshold) - 1), 12) AS others FROM sp),
lx AS (SELECT approach, p, pair, threshold, f1 AS loo FROM o QUALIFY row_number() OVER (PARTITION BY pair ORDER BY others DESC, threshold) = 1)"""


def _per_pair(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(base._predictions(spark, d), base._gold_for_all(spark, d)).withColumn("approach", base._approach())


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.threshold_sweep(base._predictions(spark, d), base._gold_for_all(spark, d)).withColumn("approach", base._approach())
    return Scratch(spark, "sweep").save(s)[0]


@query(
    base._ALL
    + ", "
    + _SWEPT
    + _AT
    + f""", s AS (SELECT split_part(pair, '|', 1) AS approach, *, {base._PRF} FROM counts),
a AS (SELECT approach, count(*) AS pairs, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, min(f1) AS least_f1, max(f1) AS most_f1, COALESCE(stddev_samp(f1), 0) AS stdev_f1, count(*) FILTER (f1 = 0) AS zero_pairs,
 sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(gold)::BIGINT AS gold, sum(tp) / sum(predicted) AS pooled_precision, sum(tp) / sum(gold) AS pooled_recall, 2 * sum(tp) / (sum(predicted) + sum(gold)) AS pooled_f1, 0::BIGINT AS mismatches FROM s GROUP BY approach),
bt AS (SELECT approach, threshold AS best_threshold, m AS best_threshold_f1, t / p AS best_pooled_precision, t / g AS best_pooled_recall FROM (SELECT approach, threshold, round(avg(f1), 12) AS m, sum(tp) AS t, sum(predicted) AS p, sum(gold) AS g FROM sp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY approach ORDER BY m DESC, threshold) = 1),
lo AS (SELECT lx.approach, avg(loo) AS loo_f1, count(*) FILTER (loo - s.f1 > 1e-9) AS loo_wins, count(*) FILTER (abs(loo - s.f1) <= 1e-9) AS loo_ties, count(*) FILTER (loo - s.f1 < -1e-9) AS loo_losses FROM lx JOIN s ON s.pair = lx.pair GROUP BY lx.approach),
lt AS (SELECT approach, string_agg(printf('%.2f', threshold) || ':' || k, ' ' ORDER BY threshold) AS loo_thresholds FROM (SELECT approach, threshold, count(*) AS k FROM lx GROUP BY ALL) GROUP BY approach),
gd AS (SELECT DISTINCT x.approach || '|' || pair AS pair, source_id, target_id FROM m, (SELECT DISTINCT approach FROM matches WHERE approach <> 'string-equiv') x WHERE m.approach = 'string-equiv'), ff AS (SELECT DISTINCT pair, source_id, target_id FROM fl),
fj AS (SELECT split_part(mm.pair, '|', 1) AS approach, f.pair IS NOT NULL AS f, g.pair IS NULL AS wrong FROM mm LEFT JOIN ff f USING (pair, source_id, target_id) LEFT JOIN gd g USING (pair, source_id, target_id)),
fq AS (SELECT approach, count(*) FILTER (f) / count(*) AS flag_coverage, count(*) FILTER (f AND wrong) / count(*) FILTER (f) AS flag_precision, count(*) FILTER (f AND wrong) / count(*) FILTER (wrong) AS flag_recall, count(*) FILTER (f AND wrong) / count(*) FILTER (f) - count(*) FILTER (wrong) / count(*) AS flag_lift FROM fj GROUP BY approach)
SELECT approach, pairs, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_precision', 'mean_recall', 'mean_f1', 'least_f1', 'most_f1', 'stdev_f1'))}, zero_pairs, tp, predicted, gold, {', '.join(f'round({c}, 6) AS {c}' for c in ('pooled_precision', 'pooled_recall', 'pooled_f1'))}, mismatches,
 best_threshold, {', '.join(f'round({c}, 6) AS {c}' for c in ('best_threshold_f1', 'best_pooled_precision', 'best_pooled_recall', 'loo_f1'))}, loo_wins, loo_ties, loo_losses, loo_thresholds, {', '.join(f'round({c}, 6) AS {c}' for c in ('flag_coverage', 'flag_precision', 'flag_recall', 'flag_lift'))}
FROM a LEFT JOIN bt USING (approach) LEFT JOIN lo USING (approach) LEFT JOIN lt USING (approach) LEFT JOIN fq USING (approach)"""
)
def approach_summary(spark: SparkSession, d: str) -> DataFrame:
    m, f = base._flags(spark, d)
    quality = consistency.flag_quality(m, f, base._gold_for_all(spark, d)).withColumn("approach", base._approach())
    return rounded(study.approach_summary(_per_pair(spark, d), _sweep(spark, d), quality))


@query(base._F1 + "b AS (SELECT approach, pair, max(f1) AS f FROM sc GROUP BY ALL) SELECT approach, count(*) AS pairs, round(avg(f), 6) AS oracle_f1 FROM b GROUP BY approach".replace("b AS", ", b AS", 1))
def oracle_with_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.oracle_of_all_modes(base._mode_scores(spark, d)))


@query(
    base._CONF
    + ", "
    + base._SWEEP[len(base._M) :].replace("gold AS", "gold_all AS", 1).replace("FROM gold GROUP BY pair) g ON", "FROM gold_all GROUP BY pair) g ON").replace("LEFT JOIN gold g ON", "LEFT JOIN gold_all g ON")
    + _AT
    + """, lm AS (SELECT a.*, round((sum(f1) OVER (PARTITION BY approach, mode) - f1) / (count(*) OVER (PARTITION BY approach, mode) - 1), 12) AS others FROM sc a WHERE mode IN ('concept', 'concept-parent', 'concept-children')),
ll AS (SELECT approach, pair, f1 FROM lm QUALIFY row_number() OVER (PARTITION BY approach, pair ORDER BY others DESC, CASE mode WHEN 'concept' THEN 0 WHEN 'concept-parent' THEN 1 ELSE 2 END) = 1)
SELECT approach, variant, pair, round(f1, 6) AS f1 FROM cf UNION ALL SELECT approach, 'thr', p, round(loo, 6) FROM lx UNION ALL SELECT approach, 'loo', pair, round(f1, 6) FROM ll"""
)
def configurations_left_out(spark: SparkSession, d: str) -> DataFrame:
    sweep = _sweep(spark, d).withColumn("pair", F.split("pair", r"\|")[1])
    return rounded(study.left_out_configurations(base._mode_scores(spark, d), sweep, MODES))


_MODE_CAND = "cm AS (SELECT mode, pair, source_id, candidate_id AS target_id, max(confidence) AS score FROM judgements WHERE mode IN ('concept', 'concept-parent', 'concept-children') AND regexp_matches(candidate_id, '\\S') AND regexp_matches(source_id, '\\S') AND confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1.000001 GROUP BY ALL), kc AS (SELECT mode || chr(1) || pair AS pair, source_id, target_id, score FROM cm)"
_JGOLD = "gold AS (SELECT DISTINCT pair, source_id, candidate_id AS target_id FROM judgements WHERE is_match AND regexp_matches(candidate_id, '\\S') AND approach = 'llm-alpha')"


def _judged_gold(spark: SparkSession, d: str) -> DataFrame:
    """What one classifier, taken as the reference here, calls a match."""
    return table(spark, d, "judgements").filter("is_match and approach = 'llm-alpha'").filter(nonblank(F.col("candidate_id"))).select("pair", "source_id", F.col("candidate_id").alias("target_id")).distinct()


def _mode_candidates(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements").filter(F.col("confidence").between(0, 1.000001)).filter(F.col("mode").isin(MODES))
    return j.select("mode", "pair", "source_id", F.col("candidate_id").alias("target_id"), F.col("confidence").alias("score"))


_ORDER = "CASE mode WHEN 'concept' THEN 0 WHEN 'concept-parent' THEN 1 ELSE 2 END"


@query(
    f"WITH RECURSIVE {_MODE_CAND}, {_JGOLD}, {greedy_sql('kc')}, th AS (SELECT unnest({list(evaluate.THRESHOLDS)})::DOUBLE AS threshold),"
    + """ tk AS (SELECT split_part(pair, chr(1), 1) AS mode, split_part(pair, chr(1), 2) AS pair, source_id, target_id, score FROM taken), ht AS (SELECT tk.*, g.pair IS NOT NULL AS hit FROM tk LEFT JOIN gold g USING (pair, source_id, target_id)),
gc AS (SELECT pair, count(*) AS gold FROM gold GROUP BY pair), keys AS (SELECT DISTINCT mode, pair FROM tk UNION SELECT m.mode, gc.pair FROM gc, (SELECT unnest(['concept', 'concept-parent', 'concept-children']) AS mode) m),
sw AS (SELECT k.mode, k.pair, th.threshold, count(ht.pair) AS predicted, count(*) FILTER (ht.hit) AS tp, COALESCE(ANY_VALUE(gc.gold), 0) AS gold FROM keys k CROSS JOIN th LEFT JOIN ht ON ht.mode = k.mode AND ht.pair = k.pair AND ht.score > th.threshold LEFT JOIN gc ON gc.pair = k.pair GROUP BY ALL),
sg AS (SELECT *, CASE WHEN predicted + gold = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (predicted + gold) END AS f1 FROM sw),
lo AS (SELECT *, round((sum(f1) OVER (PARTITION BY mode, threshold) - f1) / (count(*) OVER (PARTITION BY mode, threshold) - 1), 12) AS others FROM sg), l AS (SELECT * EXCLUDE (others) FROM lo QUALIFY row_number() OVER (PARTITION BY mode, pair ORDER BY others DESC, threshold) = 1),
"""
    + f"jt AS (SELECT * EXCLUDE (others) FROM lo QUALIFY row_number() OVER (PARTITION BY pair ORDER BY others DESC, threshold, {_ORDER}) = 1),"
    + """ vt AS (SELECT pair, source_id, target_id, threshold, avg(score) AS score FROM tk JOIN th ON tk.score > th.threshold GROUP BY pair, source_id, target_id, threshold HAVING count(*) >= 2), ev AS (SELECT threshold || chr(1) || pair AS pair, source_id, target_id, score FROM vt),
"""
    + greedy_sql("ev", "agreed")
    + """, eh AS (SELECT split_part(a.pair, chr(1), 1)::DOUBLE AS threshold, split_part(a.pair, chr(1), 2) AS pair, count(*) AS predicted, count(g.pair) AS tp FROM agreed a LEFT JOIN gold g ON g.pair = split_part(a.pair, chr(1), 2) AND g.source_id = a.source_id AND g.target_id = a.target_id GROUP BY ALL),
es AS (SELECT k.pair, k.threshold, COALESCE(predicted, 0) AS predicted, COALESCE(tp, 0) AS tp, COALESCE(gold, 0) AS gold FROM (SELECT DISTINCT pair, threshold FROM sg) k LEFT JOIN eh USING (pair, threshold) LEFT JOIN gc USING (pair)),
ef AS (SELECT *, CASE WHEN predicted + gold = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (predicted + gold) END AS f1 FROM es), eo AS (SELECT *, round((sum(f1) OVER (PARTITION BY threshold) - f1) / (count(*) OVER (PARTITION BY threshold) - 1), 12) AS others FROM ef), el AS (SELECT * EXCLUDE (others) FROM eo QUALIFY row_number() OVER (PARTITION BY pair ORDER BY others DESC, threshold) = 1),
u AS (SELECT 'sweep' AS kind, mode, pair, threshold, predicted, tp, gold, f1 FROM sg UNION ALL SELECT 'fixed', mode, pair, threshold, predicted, tp, gold, f1 FROM sg WHERE threshold IN (0.5, 0.7) UNION ALL SELECT 'loo', mode, pair, threshold, predicted, tp, gold, f1 FROM l
 UNION ALL SELECT 'joint', mode, pair, threshold, predicted, tp, gold, f1 FROM jt UNION ALL SELECT 'mean', '', pair, NULL, NULL, NULL, NULL, avg(f1) FROM l GROUP BY pair UNION ALL SELECT 'ensemble', '', pair, threshold, predicted, tp, gold, f1 FROM el)
SELECT kind, mode, pair, threshold, predicted, tp, gold, round(f1, 6) AS f1 FROM u"""
)
def end_to_end(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.end_to_end(spark, _mode_candidates(spark, d), _judged_gold(spark, d), MODES))


@query(
    _CAND
    + "hi AS (SELECT pair, source_id, target_id, score FROM c), "
    + greedy_sql("hi")
    + f""", {_JGOLD}, ar AS (SELECT pair, source_id, target_id, score FROM ranked WHERE rank = 1), dd AS (SELECT pair, source_id, target_id, score FROM ar QUALIFY row_number() OVER (PARTITION BY pair, target_id ORDER BY score DESC, source_id) = 1),
al AS (SELECT 'argmax' AS rule, * FROM ar UNION ALL SELECT 'dedupe', * FROM dd UNION ALL SELECT 'greedy', * FROM taken UNION ALL SELECT 'greedy@0.5', * FROM taken WHERE score >= 0.5 UNION ALL SELECT 'greedy@0.7', * FROM taken WHERE score >= 0.7),
gc AS (SELECT pair, count(*) AS gold FROM gold GROUP BY pair), pc AS (SELECT rule, pair, count(*) AS predicted, count(g.pair) AS tp FROM al LEFT JOIN gold g USING (pair, source_id, target_id) GROUP BY ALL),
k AS (SELECT rule, pair FROM pc UNION SELECT r.rule, gc.pair FROM gc, (SELECT DISTINCT rule FROM al) r), j AS (SELECT rule, pair, COALESCE(predicted, 0) AS predicted, COALESCE(tp, 0) AS tp, COALESCE(gold, 0) AS gold FROM k LEFT JOIN pc USING (rule, pair) LEFT JOIN gc USING (pair))
SELECT rule, count(*) AS pairs, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (predicted + gold) END), 6) AS mean_f1, round(avg(predicted), 6) AS mean_predictions FROM j GROUP BY rule"""
)
def rule_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.rule_grid(spark, base._candidates(spark, d), _judged_gold(spark, d)))


@query(_CAND + f"{_JGOLD}, f AS (SELECT DISTINCT pair, source_id, target_id FROM ranked WHERE rank <= 5), h AS (SELECT count(*) AS hits FROM (SELECT * FROM gold INTERSECT SELECT * FROM f)) SELECT (SELECT count(*) FROM gold) AS gold, hits, round(hits / (SELECT count(*) FROM gold), 6) AS recall, count(DISTINCT pair || chr(1) || source_id) AS sources, round(count(*) / count(DISTINCT pair || chr(1) || source_id), 6) AS mean_candidates FROM f, h GROUP BY hits")
def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.retrieval_recall(assign.top_k(base._candidates(spark, d), 5), _judged_gold(spark, d)))


@query(base._F1 + ", x AS (SELECT 1) SELECT approach, mode, round(avg(f1), 6) AS mean_f1, count(*) AS pairs FROM sc GROUP BY ALL")
def cached_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.cached_means(base._mode_scores(spark, d), "approach", "mode"))


@query("SELECT tax, count(DISTINCT node_id) AS nodes FROM nodes GROUP BY tax")
def taxonomy_sizes(spark: SparkSession, d: str) -> DataFrame:
    return study.sizes(table(spark, d, "nodes"))


@query(base._CAND + "x AS (SELECT 1) SELECT pair, count(DISTINCT source_id) AS requests FROM c GROUP BY pair")
def request_counts(spark: SparkSession, d: str) -> DataFrame:
    return study.request_counts(base._candidates(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = base._directed(spark, d).groupBy("pair").agg(F.min_by(F.struct("source", "target"), "align_id").alias("x"))
    return a.select("pair", "x.source", "x.target")


_PAIRS = base._AL + ", p AS (SELECT least(source, target) || '↔' || greatest(source, target) AS pair, arg_min(source, align_id) AS source, arg_min(target, align_id) AS target FROM r GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY least(source, target) || '↔' || greatest(source, target)")


@query(_PAIRS + ", s AS (SELECT least(source, target) || '↔' || greatest(source, target) AS pair FROM alignments JOIN r USING (align_id) WHERE tool IS NULL)".replace("alignments JOIN r USING (align_id)", "r JOIN (SELECT align_id, tool FROM alignments) z USING (align_id)") + " SELECT pair, source, target FROM p WHERE pair IN (SELECT pair FROM s)")
def stale_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which some alignment names no tool count as stale here."""
    stale = base._directed(spark, d).join(table(spark, d, "alignments").filter("tool is null").select("align_id"), "align_id").select("pair")
    return study.select_pairs(_pairs(spark, d), stale=stale)


@query(_PAIRS + ", t AS (SELECT source AS fold FROM p UNION SELECT target FROM p), few AS (SELECT fold FROM t ORDER BY fold LIMIT 3) SELECT fold, pair, CASE WHEN fold IN (source, target) THEN 'test' ELSE 'train' END AS role FROM few, p")
def folds_first(spark: SparkSession, d: str) -> DataFrame:
    return study.first_folds(neural.folds(_pairs(spark, d), "taxonomy"), 3)


@query(_PAIRS + " SELECT f.pair AS fold, p.pair, CASE WHEN f.pair = p.pair THEN 'test' ELSE 'train' END AS role FROM p f, p")
def folds_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return neural.folds(_pairs(spark, d))


@query(base._M + ", q AS (SELECT DISTINCT source_id, target_id FROM m WHERE approach = 'string-equiv'), z AS (SELECT 0 AS origin, source_id, target_id FROM q UNION ALL SELECT DISTINCT 1, node_id, node_id || '_V1' FROM nodes WHERE node_id IS NOT NULL UNION ALL SELECT DISTINCT 2, node_id, node_id || '_SYN' FROM nodes WHERE node_id IS NOT NULL) SELECT min(origin) AS origin, source_id, target_id FROM z GROUP BY source_id, target_id".replace(", q AS", "q AS", 1))
def training_union(spark: SparkSession, d: str) -> DataFrame:
    n, e = base._ne(spark, d)
    n = n.filter("node_id is not null")
    return study.training_union(base._gold(spark, d), synth.gold(synth.exact(n, e)[0]), synth.gold(synth.synonym(n, e)[0]))


@query("SELECT count(*) AS nominal, CAST(sum(label) AS BIGINT) AS positives, count(DISTINCT source_id || chr(1) || COALESCE(candidate_id, chr(2)) || chr(1) || label) AS distinct_rows, (SELECT count(*) FROM (SELECT DISTINCT source_id, candidate_id FROM judgements WHERE is_match)) AS distinct_positives FROM (SELECT source_id, candidate_id, is_match::INT AS label FROM judgements)")
def training_report(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements").select("source_id", F.col("candidate_id").alias("target_id"), F.col("is_match").cast("int").alias("label"))
    return neural.training_report(j)


@query("WITH a AS (SELECT tax, child_id FROM edges), b AS (SELECT tax, node_id FROM nodes), x AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), y AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT x.n AS only_first, y.n AS only_second, x.n = 0 AND y.n = 0 AS equal, x.n = 0 AS first_in_second, y.n = 0 AS second_in_first FROM x, y")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    return study.coverage(table(spark, d, "edges").select("tax", "child_id"), table(spark, d, "nodes").select("tax", F.col("node_id").alias("child_id")))


@query("SELECT DISTINCT confidence, '#' || printf('%02X', floor((1 - c) * 255)::INT) || printf('%02X', floor(c * 255)::INT) || '00' AS colour, CASE WHEN confidence IS NULL THEN NULL ELSE printf('%.2f', floor(confidence * 100) / 100) END AS key FROM (SELECT confidence, least(1.0, greatest(0.0, COALESCE(confidence, 0)))::DOUBLE AS c FROM matches WHERE confidence IS NULL OR NOT isnan(confidence))")
def line_colours(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "matches").filter("confidence is null or not isnan(confidence)").select("confidence").distinct()
    return m.select("confidence", study.line_colour(F.col("confidence")).alias("colour"), F.when(F.col("confidence").isNotNull(), sweep_key(F.floor(F.col("confidence") * 100) / 100)).alias("key"))


@query("SELECT doc_id, regexp_matches(lower(text), '429|rate|connection|timeout|timed out') AS passing FROM documents WHERE text IS NOT NULL")
def retryable_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", retryable(F.col("text")).alias("passing"))


@query(base._F1 + ", x AS (SELECT mode, pair, avg(f1) AS mean, stddev_samp(f1) AS sd, min(f1) AS low, max(f1) AS high, count(*) AS runs FROM sc GROUP BY ALL) SELECT mode, pair, runs, round(mean, 6) AS mean, round(COALESCE(sd, 0), 6) AS stdev, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS range FROM x")
def repeated_runs(spark: SparkSession, d: str) -> DataFrame:
    """The approaches stand for repeated runs of one mode on one pair."""
    from crosslattice.operators.selection import spread

    s = base._mode_scores(spark, d).withColumn("k", F.concat_ws("\u0001", "mode", "pair"))
    parts = F.split("k", "\u0001")
    return rounded(spread(s, "k", "f1").select(parts[0].alias("mode"), parts[1].alias("pair"), "runs", "mean", "stdev", "low", "high", "range"))


# -- sources, written and read back -----------------------------------------------------------


def _latest(spark: SparkSession, d: str) -> DataFrame:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    picks = (("name", F.lit("")), ("comment", F.lit("")), ("depth", F.lit(0)), ("ord", F.lit(0)), ("attributes", empty))
    return table(spark, d, "nodes").filter("node_id is not null").groupBy("tax", "node_id").agg(*[F.max_by(F.coalesce(c, x), "loaded_at").alias(c) for c, x in picks])


@query("SELECT tax, node_id, arg_max(COALESCE(name, ''), loaded_at) AS name, arg_max(COALESCE(comment, ''), loaded_at) AS comment, arg_max(COALESCE(depth, 0), loaded_at)::INT AS depth, COALESCE(ANY_VALUE(p.parents), '') AS parents FROM nodes LEFT JOIN (SELECT tax, child_id AS node_id, string_agg(parent_id, ',' ORDER BY ord, parent_id) AS parents FROM (SELECT DISTINCT tax, child_id, parent_id, ord FROM edges WHERE parent_id IS NOT NULL) GROUP BY ALL) p USING (tax, node_id) WHERE node_id IS NOT NULL GROUP BY tax, node_id")
def taxonomy_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "taxonomies")
    e = table(spark, d, "edges").filter("parent_id is not null").select("tax", "child_id", "parent_id", "ord").distinct()
    none = spark.createDataFrame([], "tax string, node_id string, other_id string, ord int")
    records.write_taxonomies(_latest(spark, d), e, none, f"{s.root}/json")
    t = records.read_taxonomies(spark, f"{s.root}/json")
    up = t["edges"].groupBy("tax", F.col("child_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "parent_id"))), lambda x: x["parent_id"]), ",").alias("parents"))
    return t["nodes"].join(up, ["tax", "node_id"], "left").select("tax", "node_id", "name", "comment", "depth", F.coalesce("parents", F.lit("")).alias("parents"))


@query(_PAIRS + ", q AS (SELECT pair, source, target, align_id AS a FROM r JOIN p USING (source, target)) SELECT q.pair, q.source, q.target, 's' || a AS source_id, 't' || a AS target_id, 1.0::DOUBLE AS confidence FROM q".replace("align_id AS a FROM r JOIN p USING (source, target)", "r.align_id AS a FROM r JOIN p USING (source, target)"))
def alignment_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "alignments")
    m = base._directed(spark, d).join(_pairs(spark, d), ["pair", "source", "target"])
    records.write_alignments(m.select("source", "target", F.concat(F.lit("s"), "align_id").alias("source_id"), F.concat(F.lit("t"), "align_id").alias("target_id"), F.lit(1.0).alias("confidence")), f"{s.root}/json")
    return records.read_alignments(spark, f"{s.root}/json").select("pair", "source", "target", "source_id", "target_id", "confidence")


@query(base._F1 + ", x AS (SELECT 1) SELECT approach, pair, mode, round(f1, 6) AS f1 FROM sc")
def record_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "records")
    records.write_records_json(base._mode_scores(spark, d), f"{s.root}/json")
    return rounded(records.read_records(spark, f"{s.root}/json").select("approach", "pair", "mode", "f1"))


@query(base._F1 + ", x AS (SELECT 1) SELECT approach AS folder, string_agg(DISTINCT mode, ',' ORDER BY mode) AS values FROM sc WHERE mode <= (SELECT max(m) FROM (SELECT DISTINCT mode AS m FROM sc ORDER BY m LIMIT 6)) GROUP BY approach")
def record_disk_scan(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "records")
    records.write_records_json(base._mode_scores(spark, d), f"{s.root}/json")
    return records.disk_scan(spark, f"{s.root}/json", "mode").select(F.regexp_replace("folder", "^approach=", "").alias("folder"), F.array_join("values", ",").alias("values"))


@query(_PAIRS + ", q AS (SELECT DISTINCT r.source, r.target, r.source || '>' AS s, r.target || '<' AS t FROM r), g AS (SELECT source, target, 's' || align_id AS source_id, 't' || align_id AS target_id FROM r JOIN p USING (source, target)) SELECT DISTINCT q.source, q.target, g.source_id, g.target_id FROM q JOIN (SELECT * FROM g UNION SELECT target, source, target_id, source_id FROM g) g USING (source, target)")
def gold_both_ways(spark: SparkSession, d: str) -> DataFrame:
    a = base._directed(spark, d)
    gold = a.join(_pairs(spark, d), ["pair", "source", "target"]).select("source", "target", F.concat(F.lit("s"), "align_id").alias("source_id"), F.concat(F.lit("t"), "align_id").alias("target_id"), F.lit(1.0).alias("confidence"))
    return records.find_gold(a, gold).select("source", "target", "source_id", "target_id").distinct()


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_HEAD = '<?xml version="1.0"?><rdf:RDF xml:base="http://t" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'


def _owl(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every taxonomy as an OWL file, and read again."""
    local = lambda c: F.regexp_extract(c, r"([^#/]*)$", 1)
    n = _latest(spark, d)
    up = table(spark, d, "edges").filter("parent_id is not null").groupBy("tax", F.col("child_id").alias("node_id")).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_set("parent_id")), lambda p: F.concat(F.lit('<rdfs:subClassOf rdf:resource="#'), _xml(F.regexp_extract(p, r"([^#/]*)$", 1)), F.lit('"/>')))).alias("links"))
    one = F.concat(F.lit('<owl:Class rdf:ID="'), _xml(local(F.col("node_id"))), F.lit('"><rdfs:label>'), _xml(F.col("name")), F.lit("</rdfs:label><rdfs:comment>"), _xml(F.col("comment")), F.lit("</rdfs:comment>"), F.coalesce("links", F.lit("")), F.lit("</owl:Class>"))
    text = n.join(up, ["tax", "node_id"], "left").groupBy("tax").agg(F.concat(F.lit(_HEAD), F.concat_ws("", F.array_sort(F.collect_list(one))), F.lit("</rdf:RDF>")).alias("x"))
    return owl.read_owl(spark, text.select(F.concat("tax", F.lit(".owl")).alias("path"), F.encode("x", "UTF-8").alias("content")))


_LOCAL = "regexp_extract({}, '([^#/]*)$', 1)"


@query(f"WITH n AS (SELECT tax, node_id, arg_max(COALESCE(name, ''), loaded_at) AS name, arg_max(COALESCE(comment, ''), loaded_at) AS comment FROM nodes WHERE node_id IS NOT NULL GROUP BY ALL) SELECT tax, tax || '#' || {_LOCAL.format('node_id')} AS node_id, CASE WHEN name = '' THEN replace({_LOCAL.format('node_id')}, '_', ' ') ELSE name END AS name, comment FROM n")
def owl_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _owl(spark, d)["nodes"].select("tax", "node_id", "name", "comment")


@query(f"WITH n AS (SELECT DISTINCT tax, {_LOCAL.format('node_id')} AS x FROM nodes WHERE node_id IS NOT NULL), e AS (SELECT DISTINCT tax, {_LOCAL.format('child_id')} AS c, {_LOCAL.format('parent_id')} AS p FROM edges WHERE parent_id IS NOT NULL AND child_id IS NOT NULL) SELECT e.tax, e.tax || '#' || c AS child_id, e.tax || '#' || p AS parent_id FROM e JOIN n a ON a.tax = e.tax AND a.x = c JOIN n b ON b.tax = e.tax AND b.x = p")
def owl_edges(spark: SparkSession, d: str) -> DataFrame:
    return _owl(spark, d)["edges"].select("tax", "child_id", "parent_id")


@query(base._M + ", g AS (SELECT DISTINCT pair, source_id, target_id FROM m WHERE approach = 'string-equiv') SELECT pair, source_id, max(target_id) AS target_id, 1.0::DOUBLE AS measure FROM g GROUP BY pair, source_id".replace(", g AS", "g AS", 1))
def alignment_cells(spark: SparkSession, d: str) -> DataFrame:
    """The reference as alignment files, and read again: of a source's cells the last counts."""
    cell = F.concat(F.lit('<map><Cell><entity1 rdf:resource="'), _xml(F.col("source_id")), F.lit('"/><entity2 rdf:resource="'), _xml(F.col("target_id")), F.lit('"/><measure>1.0</measure><relation>=</relation></Cell></map>'))
    text = base._gold(spark, d).groupBy("pair").agg(F.concat(F.lit('<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><Alignment>'), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("source_id", "target_id", cell.alias("c")))), lambda x: x["c"])), F.lit("</Alignment></rdf:RDF>")).alias("x"))
    cells = owl.read_alignment(spark, text.select(F.col("pair").alias("path"), F.encode("x", "UTF-8").alias("content")))
    return cells.select(F.col("path").alias("pair"), F.col("entity1").alias("source_id"), F.col("entity2").alias("target_id"), "measure")


# -- graphs -----------------------------------------------------------------------------------


@query("WITH l AS (SELECT * FROM edges WHERE child_id IS NOT NULL AND parent_id IS NOT NULL), leaf AS (SELECT l.* FROM l ANTI JOIN (SELECT DISTINCT tax, parent_id FROM l) p ON p.tax = l.tax AND p.parent_id = l.child_id), up AS (SELECT tax, child_id AS parent_id, arg_min(parent_id, printf('%012d', ord) || parent_id) AS g FROM l GROUP BY ALL) SELECT tax, count(*) > 0 AS moved FROM leaf JOIN up USING (tax, parent_id) WHERE g <> child_id GROUP BY tax")
def promoted_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Which leaf is promoted depends on a seeded hash; that each taxonomy with a choice has one does not."""
    n, e = base._ne(spark, d)
    p = graph.promoted_leaf(n, e)
    real = p.join(e.select("tax", F.col("child_id").alias("node_id"), "parent_id").distinct(), ["tax", "node_id", "parent_id"], "left_semi")
    return real.groupBy("tax").agg((F.count(F.lit(1)) == 1).alias("moved"))


@query("WITH n AS (SELECT tax, node_id, arg_max(COALESCE(name, ''), loaded_at) AS name FROM nodes WHERE node_id IS NOT NULL GROUP BY ALL) SELECT scenario, count(*) AS nodes, count(*) AS gold, 0::BIGINT AS missing, CASE WHEN scenario = 'SYN' THEN count(*) FILTER (regexp_matches(name, '(?i)\\b(" + "|".join(w for w, _ in synth.SYNONYMS) + ")\\b')) ELSE 0 END AS names, true AS unique_ids FROM n, (SELECT unnest(['V1', 'SYN', 'STR', 'ATTR']) AS scenario) GROUP BY scenario")
def scenario_checks(spark: SparkSession, d: str) -> DataFrame:
    n, _ = Scratch(spark, "scenarios").save(_latest(spark, d))
    return synth.checked(n, synth.scenarios(spark, n, table(spark, d, "edges"))).select("scenario", "nodes", "gold", "missing", "names", "unique_ids")


# -- learned matching -------------------------------------------------------------------------

_NEAR = """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.label::VARCHAR AS pair, q.vec_id::VARCHAR AS source_id, t.vec_id::VARCHAR AS target_id, round(list_dot_product(q.v, t.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(t.v, t.v))), 9) AS score FROM e q JOIN e t ON q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id AND q.label = t.label),
hi AS (SELECT pair, source_id, target_id, score FROM s QUALIFY row_number() OVER (PARTITION BY pair, source_id ORDER BY score DESC, target_id) <= 10), """


@query(_NEAR + greedy_sql("hi") + " SELECT pair, source_id, target_id, round(score, 6) AS score FROM taken")
def raw_feature_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the features as they are, the ten nearest of each query, one to one."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("pair"), "vec_id", F.col("embedding").alias("vector"))
    q = e.filter("vec_id % 50 = 0").select("pair", F.col("vec_id").cast("string").alias("source_id"), "vector")
    near = retrieval.similarity_top_k(q, e.select("pair", F.col("vec_id").cast("string").alias("target_id"), "vector"), 10)
    return rounded(assign.greedy_injective(spark, near, -1.0))


@query()
def network_matches(spark: SparkSession, d: str) -> DataFrame:
    """The graph network trained on all nodes and their variants with other words, then matching these: cosine, one to one, 0.5 and up.

    A variant has the links of its taxonomy, so both sides' neighbours are summed at once.
    """
    s = Scratch(spark, "network")
    n, _ = s.save(_latest(spark, d).select("tax", "node_id", "name"))
    hashed = lambda t: retrieval.hashed_vector(t, 32)
    words = synth.synonym(n.withColumn("other", F.col("name")), table(spark, d, "edges"))[0].select(F.regexp_replace("tax", "_SYN_s42$", "").alias("tax"), F.col("base_id").alias("node_id"), F.col("other"), "name")
    x = retrieval.encode(retrieval.encode(words, "other", hashed, "v"), "name", hashed, "w").select("tax", "node_id", F.concat("v", "w").alias("vector"))
    x = neural.neighbour_vectors(graph.adjacency(n, table(spark, d, "edges")), x)
    side = lambda i: F.struct(*[F.slice(c, i, 32).alias(c) for c in ("vector", "around")])
    both, _ = s.save(x.select("tax", "node_id", side(1).alias("a"), side(33).alias("b")))
    net = neural.train_network(both.withColumn("key", F.struct("tax", "node_id")), epochs=20)
    out = {c: neural.applied(both.select("tax", "node_id", f"{c}.vector", f"{c}.around"), net).withColumnRenamed("tax", "pair") for c in "ab"}
    q = out["a"].select("pair", F.col("node_id").alias("source_id"), "vector")
    near = retrieval.similarity_within(q, out["b"].select("pair", F.concat("node_id", F.lit("_SYN")).alias("target_id"), "vector"), 10)
    return rounded(assign.greedy_injective(spark, near, 0.5))
