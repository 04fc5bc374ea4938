"""Taxonomies and reference alignments from RDF/XML files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF, RDFS, OWL, XML = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}", "{http://www.w3.org/2002/07/owl#}", "{http://www.w3.org/XML/1998/namespace}"
THING = "http://www.w3.org/2002/07/owl#Thing"
_TRIPLE = "path string, s string, p string, o string, ord int"


def _triples(content: bytes) -> list[tuple[str, str, str, int]]:
    """Statements about classes: type, label, comment, parent, disjoint, and direct restrictions of equivalent classes."""
    out: list[tuple[str, str, str, int]] = []
    root = ET.fromstring(content)
    base = (root.get(f"{XML}base") or "").rstrip("#")

    def iri(e: ET.Element) -> str | None:
        if (x := e.get(f"{RDF}ID")) is not None:
            return f"{base}#{x}"
        x = e.get(f"{RDF}about") or e.get(f"{RDF}resource")
        return f"{base}{x}" if x is not None and x.startswith("#") else x

    def add(s: str, p: str, o: str) -> None:
        out.append((s, p, o, len(out)))

    out_base = next((e for e in root if e.tag == f"{OWL}Ontology"), None)
    if out_base is not None and (iri(out_base) or base):
        add("", "ontology", iri(out_base) or base)

    def visit(e: ET.Element) -> None:
        if e.tag == f"{OWL}Class" and (s := iri(e)) is not None:
            add(s, "type", "class")
            for c in e:
                inner = next(iter(c), None)
                o = iri(c) or (iri(inner) if inner is not None else None)
                if c.tag == f"{RDFS}label":
                    add(s, "label", c.text or "")
                elif c.tag == f"{RDFS}comment":
                    add(s, "comment", c.text or "")
                elif c.tag == f"{RDFS}subClassOf" and o and (inner is None or inner.tag == f"{OWL}Class"):
                    add(s, "parent", o)
                elif c.tag == f"{OWL}disjointWith" and o:
                    add(s, "disjoint", o)
                elif c.tag == f"{OWL}equivalentClass" and inner is not None and inner.tag == f"{OWL}Restriction":
                    prop = inner.find(f"{OWL}onProperty")
                    name = None if prop is None else iri(prop) or next((iri(x) for x in prop), None)
                    value = next((x for x in inner if x.tag != f"{OWL}onProperty"), None)
                    if name and value is not None:
                        v = iri(value) or next((iri(x) for x in value), None) or (value.text or "")
                        add(s, f"attribute:{name}", v)
        elif e.tag.endswith("Property") and (s := iri(e)) is not None:
            for c in e:
                if c.tag == f"{RDFS}label":
                    add(s, "property-label", c.text or "")
        elif e.tag == f"{OWL}AllDisjointClasses":
            members = [m for x in e.iter(f"{OWL}members") for y in x if (m := iri(y))]
            for i, a in enumerate(members):
                for b in members[:i] + members[i + 1 :]:
                    add(a, "disjoint", b)
        for c in e:
            visit(c)

    visit(root)
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``content`` of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def owl_triples(found: DataFrame) -> DataFrame:
    """``path``, ``s``, ``p``, ``o``, ``ord`` of every file (``path``, ``content``); one that is no XML gives none."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"]):
                try:
                    rows += [(p, *t) for t in _triples(bytes(content))]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "s", "p", "o", "ord"])

    return found.select("path", "content").mapInPandas(run, _TRIPLE)


def local_name(iri):
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def read_owl(spark: SparkSession, path: str | DataFrame) -> dict[str, DataFrame]:
    """``nodes``, ``edges``, ``disjoint`` of OWL files (a path, or a table of path and content); the file's name is the taxonomy and the prefix of its ids.

    Names are first labels, else local names with blanks for underscores. Parents are named classes
    declared in the same file. Of repeated attributes the last counts, of repeated links the first.
    """
    t = owl_triples(files(spark, path) if isinstance(path, str) else path).filter(F.col("s") != THING).withColumn("tax", F.regexp_extract("path", r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1))
    id = lambda c: F.concat("tax", F.lit("#"), local_name(F.col(c)))
    known = t.filter("p = 'type'").groupBy("tax", "s").agg(F.min("ord").alias("ord"))
    pick = lambda p: t.filter(F.col("p") == p).groupBy("tax", "s").agg(F.min_by("o", "ord").alias(p))
    props = t.filter("p = 'property-label'").groupBy("tax", F.col("s").alias("prop")).agg(F.min_by("o", "ord").alias("prop_label"))
    held = t.filter(F.col("p").startswith("attribute:")).withColumn("prop", F.substring("p", 11, 100_000)).join(props, ["tax", "prop"], "left")
    held = held.withColumn("k", F.coalesce(F.nullif("prop_label", F.lit("")), local_name(F.col("prop")))).groupBy("tax", "s", "k").agg(F.max_by("o", "ord").alias("v"))
    held = held.groupBy("tax", "s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("v").contains("://"), local_name(F.col("v"))).otherwise(F.col("v")).alias("v"))))).alias("attributes"))
    nodes = known.join(pick("label"), ["tax", "s"], "left").join(pick("comment"), ["tax", "s"], "left").join(held, ["tax", "s"], "left")
    nodes = nodes.select("tax", id("s").alias("node_id"), F.coalesce(F.nullif("label", F.lit("")), F.regexp_replace(local_name(F.col("s")), "_", " ")).alias("name"), F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes"), "ord")

    def links(p: str, a: str, b: str) -> DataFrame:
        there = known.select("tax", F.col("s").alias("o"))
        return t.filter(F.col("p") == p).join(there, ["tax", "o"], "left_semi").groupBy("tax", id("s").alias(a), id("o").alias(b)).agg(F.min("ord").alias("ord"))

    return {"nodes": nodes, "edges": links("parent", "child_id", "parent_id"), "disjoint": links("disjoint", "node_id", "other_id").filter("node_id <> other_id")}


def read_alignment(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``path``, ``entity1``, ``entity2``, ``measure``, ``relation``: cells of alignment files, the last of each first entity."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"]):
                try:
                    cells = [e for e in ET.fromstring(bytes(content)).iter() if e.tag.rpartition("}")[2] == "Cell"]
                except ET.ParseError:
                    continue
                for i, cell in enumerate(cells):
                    x = {e.tag.rpartition("}")[2]: (e.get(f"{RDF}resource") or e.text or "").strip() for e in cell}
                    rows.append((p, x.get("entity1"), x.get("entity2"), x.get("measure"), x.get("relation"), i))
            yield pd.DataFrame(rows, columns=["path", "entity1", "entity2", "measure", "relation", "ord"])

    found = files(spark, path) if isinstance(path, str) else path
    cells = found.select("path", "content").mapInPandas(run, "path string, entity1 string, entity2 string, measure string, relation string, ord int")
    last = cells.filter("entity1 <> '' and entity2 <> ''").groupBy("path", "entity1").agg(F.max_by(F.struct("entity2", "measure", "relation"), "ord").alias("x"))
    return last.select("path", "entity1", "x.entity2", F.expr("try_cast(x.measure AS double)").alias("measure"), "x.relation")


def build_alignment(cells: DataFrame, nodes: DataFrame, source: str, target: str) -> DataFrame:
    """``pair``, ``source_id``, ``target_id``, ``confidence`` of cells whose both ends are nodes of the two taxonomies."""
    own = nodes.withColumn("local", F.regexp_extract("node_id", r"([^#/]*)$", 1))
    s = own.filter(F.col("tax") == source).groupBy("local").agg(F.min_by("node_id", "ord").alias("source_id"))
    t = own.filter(F.col("tax") == target).groupBy("local").agg(F.min_by("node_id", "ord").alias("target_id"))
    j = cells.join(s, local_name(F.col("entity1")) == s["local"]).drop("local").join(t, local_name(F.col("entity2")) == t["local"])
    return j.select(F.lit("↔".join(sorted((source, target)))).alias("pair"), "source_id", "target_id", F.lit(1.0).alias("confidence"))


def read_track(spark: SparkSession, folder: str, names: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(taxonomies, reference, missing) of a track: ``<name>.owl`` for each name, ``<a>-<b>.rdf`` for each two.

    ``reference`` has pair, source, target, source_id, target_id, confidence for cells whose both
    ends are classes; ``missing`` names the files that are not there. A pair may be stored either way round.
    """
    there = {r[0].rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").load(folder).select("path").collect()}  # a short list of files
    found = read_owl(spark, files(spark, f"{folder}/*.owl").filter(F.regexp_extract("path", r"([^/]*)\.owl$", 1).isin(list(names))))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    stored = [(a, b) if f"{a}-{b}.rdf" in there else (b, a) for a, b in pairs if f"{a}-{b}.rdf" in there or f"{b}-{a}.rdf" in there]
    gone = [f"{a}.owl" for a in names if f"{a}.owl" not in there] + [f"{a}-{b}.rdf" for a, b in pairs if f"{a}-{b}.rdf" not in there and f"{b}-{a}.rdf" not in there]
    reference = None
    for a, b in stored:
        one = build_alignment(read_alignment(spark, f"{folder}/{a}-{b}.rdf"), found["nodes"], a, b).select("pair", F.lit(a).alias("source"), F.lit(b).alias("target"), "source_id", "target_id", "confidence")
        reference = one if reference is None else reference.unionByName(one)
    if reference is None:
        reference = spark.createDataFrame([], "pair string, source string, target string, source_id string, target_id string, confidence double")
    return found, reference, spark.createDataFrame([(x,) for x in gone], "file string")
