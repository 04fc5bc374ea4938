"""Queries of the general data-preparation operators: hierarchies and drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosslattice.operators.drift import schema_changes, steady_table
from crosslattice.operators.hierarchy import all_descendants, depth_findings, hierarchies
from crosslattice.sources.tables import table

#: The steady columns of the result records.
RESULT_COLUMNS = {"approach": "string", "source": "string", "target": "string", "rule": "string", "model": "string", "f1": "double", "precision": "double", "recall": "double", "wall_time": "double", "requests": "bigint"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return depth_findings(spark, table(spark, d, "nodes"), table(spark, d, "edges"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    h = hierarchies(spark, table(spark, d, "nodes"), table(spark, d, "edges"))
    return h.withColumn("path", F.array_join("path", " > "))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return all_descendants(spark, table(spark, d, "nodes"), table(spark, d, "edges"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "result_files"), "stream", "batch", "payload").select("stream", "batch", "field", "change")


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    return steady_table(spark, table(spark, d, "result_files"), "row_id", "stream", "batch", "payload", RESULT_COLUMNS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants, "p6_found": p6_found, "p6_table": p6_table,
}

_REACH = """
WITH RECURSIVE n AS (SELECT DISTINCT tax, node_id FROM nodes),
e AS (SELECT DISTINCT x.tax, x.child_id, x.parent_id FROM edges x
  JOIN n c ON c.tax = x.tax AND c.node_id = x.child_id JOIN n p ON p.tax = x.tax AND p.node_id = x.parent_id),
up AS (
  SELECT tax, child_id AS node_id, parent_id AS anc FROM e
  UNION SELECT up.tax, up.node_id, e.parent_id FROM up JOIN e ON e.tax = up.tax AND e.child_id = up.anc)
"""

SQL: dict[str, str] = {
    "p2_found": _REACH
    + """,
loops AS (SELECT DISTINCT tax, node_id FROM up WHERE node_id = anc),
under AS (SELECT DISTINCT up.tax, up.node_id FROM up JOIN loops l ON l.tax = up.tax AND l.node_id = up.anc),
walk AS (
  SELECT n.tax, n.node_id, CAST(0 AS BIGINT) AS k FROM n ANTI JOIN e ON e.tax = n.tax AND e.child_id = n.node_id
  UNION SELECT e.tax, e.child_id, walk.k + 1 FROM walk JOIN e ON e.tax = walk.tax AND e.parent_id = walk.node_id
    ANTI JOIN under u ON u.tax = e.tax AND u.node_id = e.child_id),
deep AS (SELECT tax, node_id, max(k) AS k FROM walk GROUP BY ALL),
stored AS (SELECT tax, node_id, arg_max(COALESCE(depth, -999999), loaded_at) AS depth FROM nodes GROUP BY ALL)
SELECT n.tax, n.node_id, CASE WHEN l.node_id IS NOT NULL THEN 'cycle' WHEN u.node_id IS NOT NULL THEN 'below_cycle' ELSE 'depth' END AS finding
FROM n JOIN stored s ON s.tax = n.tax AND s.node_id = n.node_id
LEFT JOIN loops l ON l.tax = n.tax AND l.node_id = n.node_id LEFT JOIN under u ON u.tax = n.tax AND u.node_id = n.node_id
LEFT JOIN deep d ON d.tax = n.tax AND d.node_id = n.node_id
WHERE l.node_id IS NOT NULL OR u.node_id IS NOT NULL OR s.depth <> d.k
""",
    "p2_hierarchy": _REACH
    + """,
loops AS (SELECT DISTINCT tax, node_id FROM up WHERE node_id = anc),
under AS (SELECT DISTINCT up.tax, up.node_id FROM up JOIN loops l ON l.tax = up.tax AND l.node_id = up.anc),
walk AS (
  SELECT n.tax, n.node_id, CAST(0 AS BIGINT) AS k FROM n ANTI JOIN e ON e.tax = n.tax AND e.child_id = n.node_id
  UNION SELECT e.tax, e.child_id, walk.k + 1 FROM walk JOIN e ON e.tax = walk.tax AND e.parent_id = walk.node_id
    ANTI JOIN (SELECT * FROM under UNION SELECT * FROM loops) u ON u.tax = e.tax AND u.node_id = e.child_id),
deep AS (SELECT tax, node_id, max(k) AS depth FROM walk GROUP BY ALL),
pick AS (SELECT e.tax, e.child_id AS node_id, min(e.parent_id) AS p FROM e JOIN deep a ON a.tax = e.tax AND a.node_id = e.child_id JOIN deep b ON b.tax = e.tax AND b.node_id = e.parent_id AND b.depth = a.depth - 1 GROUP BY ALL),
chain AS (SELECT tax, node_id, node_id AS at, node_id AS path FROM deep UNION ALL SELECT c.tax, c.node_id, p.p, p.p || ' > ' || c.path FROM chain c JOIN pick p ON p.tax = c.tax AND p.node_id = c.at),
whole AS (SELECT c.* FROM chain c ANTI JOIN pick p ON p.tax = c.tax AND p.node_id = c.at),
many AS (SELECT tax, anc AS node_id, count(*) AS k FROM up GROUP BY ALL)
SELECT n.tax, n.node_id, CASE WHEN l.node_id IS NOT NULL THEN 'cycle' WHEN u.node_id IS NOT NULL THEN 'below_cycle' END AS state, d.depth, w.at AS root_id, w.path, COALESCE(m.k, 0) AS descendants
FROM n LEFT JOIN loops l ON l.tax = n.tax AND l.node_id = n.node_id LEFT JOIN under u ON u.tax = n.tax AND u.node_id = n.node_id
LEFT JOIN deep d ON d.tax = n.tax AND d.node_id = n.node_id LEFT JOIN whole w ON w.tax = n.tax AND w.node_id = n.node_id LEFT JOIN many m ON m.tax = n.tax AND m.node_id = n.node_id
""",
    "p2_descendants": _REACH + "SELECT tax, anc AS node_id, node_id AS descendant_id FROM up",
}
