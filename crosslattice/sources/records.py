"""Result records, taxonomies and alignments as files, and what they are checked by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.functions.text import pair_key
from crosslattice.schema import JOURNAL, RECORDS


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file``, ``o``: every object of JSON files below ``path``: one to a file, however it is laid out, or one a line."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", r"\n(?=\{)")).alias("text"))
    return whole.filter(F.col("text").rlike(r"\S")).select("file", F.from_json("text", schema).alias("o"))


def read_records(spark: SparkSession, path: str, pair: str | None = None) -> DataFrame:
    """Result records from JSON files; the folder is the approach, whatever the record says of itself. With ``pair`` that pair's records only."""
    r = json_objects(spark, path, RECORDS).select("o.*", "file").withColumn("approach", F.regexp_replace(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1), "^approach=", "")).drop("file")
    return r if pair is None else r.filter(F.col("pair") == pair)


def write_records_json(records: DataFrame, path: str) -> None:
    """JSON by approach, as ``read_records`` reads it; approaches that are written again are replaced, others stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("approach").json(path)


def write_records(records: DataFrame, path: str) -> None:
    """Parquet by approach; approaches that are written again are replaced, others stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("approach").parquet(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).json(path)


_TAXONOMY_NODE = "struct<id:string,name:string,parents:array<string>,children:array<string>,attributes:map<string,string>,disjoint_with:array<string>,comment:string,depth:int>"


def write_taxonomies(nodes: DataFrame, edges: DataFrame, disjoint: DataFrame, path: str) -> None:
    """Taxonomies in JSON, one object a line: name, and nodes by id with parents, children and disjoint nodes in order."""

    def listed(df: DataFrame, of: str, what: str, out: str) -> DataFrame:
        return df.groupBy("tax", F.col(of).alias("node_id")).agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", what))), lambda x: x[what]).alias(out))

    none = F.array().cast("array<string>")
    n = nodes.join(listed(edges, "child_id", "parent_id", "parents"), ["tax", "node_id"], "left").join(listed(edges, "parent_id", "child_id", "children"), ["tax", "node_id"], "left").join(listed(disjoint, "node_id", "other_id", "disjoint_with"), ["tax", "node_id"], "left")
    one = F.struct(F.col("node_id").alias("id"), "name", *[F.coalesce(c, none).alias(c) for c in ("parents", "children")], "attributes", F.coalesce("disjoint_with", none).alias("disjoint_with"), "comment", F.col("depth").cast("int").alias("depth"))

    def in_order(x: Column, y: Column) -> Column:
        a, b = (F.struct(z["ord"].alias("ord"), z["node_id"].alias("node_id")) for z in (x, y))
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)

    n.groupBy("tax").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", one.alias("n"))), in_order), lambda x: F.struct(x["node_id"].alias("key"), x["n"].alias("value")))).alias("nodes")).select(F.col("tax").alias("name"), "nodes").write.mode("overwrite").json(path)


def read_taxonomies(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``nodes`` and ``edges`` from taxonomy JSON files: an object with name and nodes, a map from ids to nodes."""
    raw = json_objects(spark, path, f"name string, namespace string, root_id string, nodes map<string,{_TAXONOMY_NODE}>")
    each = raw.select("o.*").select(F.col("name").alias("tax"), F.posexplode("nodes").alias("ord", "node_id", "n"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    nodes = each.select("tax", "node_id", "n.name", F.coalesce("n.comment", F.lit("")).alias("comment"), F.coalesce("n.depth", F.lit(0)).alias("depth"), F.coalesce("n.attributes", empty).alias("attributes"), "ord")
    return {"nodes": nodes, "edges": each.select("tax", F.col("node_id").alias("child_id"), F.posexplode("n.parents").alias("ord", "parent_id")), "disjoint": each.select("tax", "node_id", F.posexplode("n.disjoint_with").alias("ord", "other_id"))}


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """``source``, ``target``, ``pair``, ``source_id``, ``target_id``, ``confidence`` (1 if unsaid) from alignments in JSON.

    A file is either a list of alignments, read as a whole, or one alignment a line, as
    ``write_alignments`` makes it; files that begin with a bracket are lists.
    """
    shape = "struct<source:string,target:string,matches:array<struct<source_id:string,target_id:string,confidence:double>>>"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lists = lines.filter(F.col("value").rlike(r"^\s*\[")).select("f").distinct()
    single = lines.join(lists, "f", "left_anti").filter(F.col("value").rlike(r"\S")).select(F.from_json("value", shape).alias("a"))
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("f")).join(lists, "f", "left_semi").select(F.explode(F.from_json("value", f"array<{shape}>")).alias("a"))
    raw = single.unionByName(whole).select("a.*")
    return raw.select("source", "target", F.explode("matches").alias("m")).select("source", "target", pair_key(F.col("source"), F.col("target")).alias("pair"), "m.source_id", "m.target_id", F.coalesce("m.confidence", F.lit(1.0)).alias("confidence"))


def write_alignments(matches: DataFrame, path: str) -> None:
    """JSON lines, one alignment each; its matches are gathered per pair of taxonomies."""
    m = F.array_sort(F.collect_list(F.struct("source_id", "target_id", "confidence")))
    matches.groupBy("source", "target").agg(m.alias("matches")).write.mode("overwrite").json(path)


def record_matches(records: DataFrame) -> DataFrame:
    """A record's own matches in its own direction; one without matches gives no rows."""
    return records.select("approach", "pair", "mode", "source", "target", F.explode("match_pairs").alias("m")).select("approach", "pair", "mode", "source", "target", "m.source_id", "m.target_id", F.coalesce("m.confidence", F.lit(1.0)).alias("confidence"))


def find_gold(requested: DataFrame, gold: DataFrame) -> DataFrame:
    """The reference of each requested direction, turned round where it is stored the other way."""
    turned = gold.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "confidence")
    both = gold.select("source", "target", "source_id", "target_id", "confidence").unionByName(turned).dropDuplicates(["source", "target", "source_id", "target_id"])
    return requested.select("source", "target").distinct().join(both, ["source", "target"])


def misoriented(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """Records whose direction is not the canonical one of their pair; those without ends are left out."""
    c = canonical.select("pair", F.col("source").alias("want_source"), F.col("target").alias("want_target")).distinct()
    return records.join(c, "pair").filter("source is not null and target is not null and (source <> want_source or target <> want_target)")


def assert_oriented(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """The records, with an error raised when a turned one is read."""
    c = canonical.select("pair", F.col("source").alias("_ws"), F.col("target").alias("_wt")).distinct()
    ok = F.col("_ws").isNull() | (F.col("source").eqNullSafe(F.col("_ws")) & F.col("target").eqNullSafe(F.col("_wt")))
    return records.join(c, "pair", "left").filter(F.coalesce(F.assert_true(ok, F.concat(F.lit("record turned: "), F.col("pair"))).cast("boolean"), F.lit(True))).drop("_ws", "_wt")


def disk_scan(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``files``, ``newest``, ``oldest`` and up to six values of a field, by folder."""
    r = json_objects(spark, path, RECORDS).select(F.col(f"o.{field}").alias(field), F.col("file").alias("file_path"))
    times = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_path"), F.col("modificationTime").alias("file_modification_time"))
    r = r.join(times.withColumn("k", F.regexp_replace("file_path", "^[a-z]+:/*", "/")).drop("file_path"), F.regexp_replace("file_path", "^[a-z]+:/*", "/") == F.col("k"))
    folder = F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)
    six = F.slice(F.array_sort(F.collect_set(F.col(field).cast("string"))), 1, 6)
    return r.groupBy(folder.alias("folder")).agg(F.countDistinct("file_path").alias("files"), F.max("file_modification_time").alias("newest"), F.min("file_modification_time").alias("oldest"), six.alias("values"))


def catalogue_pairs(names: DataFrame) -> DataFrame:
    """Pairs of a short ordered catalogue (``ord``, ``name``), the earlier first."""
    a, b = names.select(F.col("ord").alias("i"), F.col("name").alias("source")), names.select(F.col("ord").alias("j"), F.col("name").alias("target"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("source", "target")
