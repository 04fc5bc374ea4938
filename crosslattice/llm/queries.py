"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosslattice.llm.components import consolidate
from crosslattice.llm.leakage import find_leaks, remove_leaks
from crosslattice.llm.matching import match_entities
from crosslattice.llm.packing import pack
from crosslattice.llm.quality import quality_statistics
from crosslattice.llm.splits import grouped_split, record_groups
from crosslattice.llm.topn import top_n_per_group
from crosslattice.operators.identifiers import resolve_nodes, resolve_taxonomy
from crosslattice.plans import catalogue as base
from crosslattice.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n_per_group(table(spark, d, "judgements"), ["pair", "source_id"], "candidate_id", "confidence", 5)
    return best.select("pair", "source_id", "candidate_id")


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "judgements"), ["pair", "source_id"], "candidate_id", "confidence", 5).withColumnRenamed("confidence", "best")


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "taxonomies")
    a = table(spark, d, "alignments").select("align_id", "source", "target")
    return resolve_taxonomy(resolve_taxonomy(a, "source", known, "source_tax"), "target", known, "target_tax")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return record_groups(spark, _alignments(spark, d), "align_id", ["source_tax", "target_tax"])


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split(spark, _alignments(spark, d), "align_id", ["source_tax", "target_tax"])


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_entities(spark, table(spark, d, "nodes"), table(spark, d, "taxonomies"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("node_id_a", "node_id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "taxonomies")
    m = table(spark, d, "matches").select("source_id", "target_id")
    clean = resolve_nodes(resolve_nodes(m, "source_id", known, "source_node"), "target_id", known, "target_node")
    return consolidate(spark, clean, "source_node", "target_node")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(spark, table(spark, d, "documents"), "doc_id", "text")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    clean = remove_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return clean.filter("removed > 0")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    common = [r.word for r in table(spark, d, "common_words").select("word").collect()]  # a fixed list, 225 words
    return quality_statistics(table(spark, d, "documents"), "doc_id", "text", common)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).filter("kind <> 'prose'").select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_ranked": p1_ranked, "p3_found": p3_found, "p3_split": p3_split,
    "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found, "p8_spans": p8_spans, "p8_removed": p8_removed,
    "p9_found": p9_found, "p9_statistics": p9_statistics,
}

_TOP = """
WITH usable AS (
  SELECT pair, source_id, candidate_id, max(confidence + 0.0) AS best FROM judgements
  WHERE candidate_id IS NOT NULL AND regexp_matches(candidate_id, '\\S')
    AND confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1.000001
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair, source_id ORDER BY best DESC, candidate_id) AS rank FROM usable)
"""

_REACHED = """, b AS (SELECT x, y FROM link UNION SELECT y, x FROM link), reach AS (SELECT x AS a, x AS z FROM vertex UNION SELECT reach.a, b.y FROM reach JOIN b ON b.x = reach.z)"""
#: Vertices are alignments and taxonomies, told apart by a letter.
_GROUPS = (
    base._AL.replace("WITH k AS", "WITH RECURSIVE k AS")
    + """, side AS (SELECT align_id, source AS raw FROM alignments UNION ALL SELECT align_id, target FROM alignments),
sk AS (SELECT align_id, regexp_replace(lower(regexp_replace(raw, '^[\\s<]+|[\\s>]+$', '', 'g')), '[#/]+$', '') AS s FROM side WHERE regexp_matches(raw, '\\S')),
sf AS (SELECT align_id, CASE WHEN s LIKE '%://%' THEN s ELSE regexp_replace(regexp_extract(s, '([^/]*)$', 1), '\\.(owl|rdf|ttl|xml)$', '') END AS s FROM sk),
link AS (SELECT 'a' || align_id AS x, 't' || COALESCE(nm.canon, s) AS y FROM sf LEFT JOIN nm ON nm.key = s), vertex AS (SELECT DISTINCT 'a' || align_id AS x FROM alignments WHERE align_id IS NOT NULL)"""
    + _REACHED
    + " SELECT substr(a, 2)::BIGINT AS align_id, min(substr(z, 2)::BIGINT) AS group_id FROM reach WHERE z[1] = 'a' GROUP BY a"
)
_NODE_GROUPS = base._M + "link AS (SELECT source_id AS x, target_id AS y FROM m), vertex AS (SELECT DISTINCT z AS x FROM canon)" + _REACHED + " SELECT a AS node_id, min(z) AS group_id FROM reach GROUP BY a"

SQL: dict[str, str] = {
    "p3_found": _GROUPS, "p5_found": _NODE_GROUPS,
    "p1_found": _TOP + "SELECT pair, source_id, candidate_id FROM ranked WHERE rank <= 5",
    "p1_ranked": _TOP + "SELECT pair, source_id, candidate_id, best, rank FROM ranked WHERE rank <= 5",
}
