"""Tables and texts for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslattice.functions.text import safe_id


def pivoted(scores: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One column for each of the named approaches."""
    return scores.groupBy(row).pivot(column, columns).agg(F.first(value))


def markdown_rows(df: DataFrame) -> DataFrame:
    """``line``: each row as a line of a Markdown table."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def dot_lines(nodes: DataFrame, edges: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """``tax``, ``part``, ``line``: the statements of a DOT graph of each taxonomy, matched nodes filled; write them by tax, in order."""
    n = nodes.select("tax", "node_id", "name").dropDuplicates(["tax", "node_id"])
    n = n.join(matched.select("node_id").distinct().withColumn("m", F.lit(1)), "node_id", "left") if matched is not None else n.withColumn("m", F.lit(None).cast("int"))
    quoted = F.regexp_replace(F.coalesce("name", F.lit("")), '"', "'")
    a = n.select("tax", F.lit(0).alias("part"), F.concat(F.lit('"'), safe_id(F.col("node_id")), F.lit('" [label="'), quoted, F.when(F.col("m") == 1, F.lit('", style=filled];')).otherwise(F.lit('"];'))).alias("line"))
    b = edges.select("tax", "child_id", "parent_id").distinct().select("tax", F.lit(1).alias("part"), F.concat(F.lit('"'), safe_id(F.col("parent_id")), F.lit('" -> "'), safe_id(F.col("child_id")), F.lit('";')).alias("line"))
    return a.unionByName(b)
