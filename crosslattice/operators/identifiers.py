"""Identifiers written in several ways, led back to one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslattice.runtime import lookup, nonblank


def _bare(c: Column) -> Column:
    """Without surrounding white space and angle brackets."""
    return F.regexp_replace(c, r"^[\s<]+|[\s>]+$", "")


def taxonomy_key(c: Column) -> Column:
    """What a reference to a taxonomy is joined by: lower case, no padding, path, file ending or final # or /."""
    s = F.regexp_replace(F.lower(_bare(c)), r"[#/]+$", "")
    file = F.regexp_replace(F.regexp_extract(s, r"([^/\\]*)$", 1), r"\.(owl|rdf|ttl|xml)$", "")
    return F.when(nonblank(c), F.when(s.rlike(r"^[a-z][a-z0-9+.-]*://"), s).otherwise(file))


def taxonomy_names(taxonomies: DataFrame) -> DataFrame:
    """``key``, ``canon``: every way of naming a taxonomy, with its lower-case ``tax``; the smallest if two claim a key."""
    each = F.array(*[taxonomy_key(F.col(c)) for c in ("tax", "short", "namespace")])
    return taxonomies.select(F.explode(each).alias("key"), taxonomy_key(F.col("tax")).alias("canon")).filter("key is not null").groupBy("key").agg(F.min("canon").alias("canon"))


def resolve_taxonomy(df: DataFrame, column: str, taxonomies: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the taxonomy that ``column`` names, null where blank; a name no taxonomy bears stands for itself."""
    keyed = df.withColumn("key", taxonomy_key(F.col(f"`{column}`")))
    return lookup(keyed, taxonomy_names(taxonomies), "key").withColumn(out, F.coalesce("canon", "key")).drop("key", "canon")


def node_iri_parts(c: Column) -> tuple[Column, Column]:
    """(namespace key, local name) of an id written as an IRI; both null for any other id."""
    s = _bare(c)
    iri = s.rlike(r"^(?i)[a-z][a-z0-9+.-]*://[^#]*[#/][^#/]+$")
    space = F.regexp_replace(F.lower(F.regexp_extract(s, r"^(.*)[#/][^#/]+$", 1)), r"[#/]+$", "")
    return F.when(iri, space), F.when(iri, F.regexp_extract(s, r"([^#/]+)$", 1))


def resolve_nodes(df: DataFrame, column: str, taxonomies: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the node id that ``column`` means, ``short#local``; null where blank.

    IRIs are led back by the taxonomies' namespaces; padding is taken off. An IRI of an unknown
    namespace stands for itself.
    """
    c = F.col(f"`{column}`")
    space, local = node_iri_parts(c)
    keyed = df.withColumn("key", space).withColumn("_local", local)
    names = taxonomies.select(taxonomy_key(F.col("namespace")).alias("key"), F.regexp_replace("short", r"^\s+|\s+$", "").alias("_short")).filter("key is not null").groupBy("key").agg(F.min("_short").alias("_short"))
    found = F.when(F.col("_short").isNotNull(), F.concat("_short", F.lit("#"), "_local")).otherwise(_bare(c))
    return lookup(keyed, names, "key").withColumn(out, F.when(nonblank(c), found)).drop("key", "_local", "_short")
