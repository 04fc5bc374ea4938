"""Schemas that drift between files: what changed from batch to batch, and one steady table."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch

#: Words and shapes that a field's sketch keeps, those of the smallest hashes with their counts; whatever the number of records.
SKETCH = 256
#: Batches of a stream that one window orders; longer streams are ordered stretch by stretch.
STRETCH = 4096
#: The flooded score from which a pair of fields is one field under two names.
ACCEPT = 0.47


def json_values(records: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """``keys``, ``field``, ``type``, ``value`` (as text): one row for each non-null value of each JSON object; anything else gives none."""
    v = F.try_parse_json(F.col(f"`{payload}`"))
    rows = records.select(*keys, v.alias("_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    each = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keys, F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"), F.col("value").alias("v"))
    kind = F.col("kind")
    type_ = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    text = F.when(type_.isin("object", "array"), F.to_json("v")).otherwise(F.col("v").cast("string"))
    return each.filter(kind != "VOID").select(*keys, "field", type_.alias("type"), F.when(type_ == "object", kind).alias("members"), text.alias("value"))


def _shape(c: Column) -> Column:
    """Digits as one 9, words as one a, and several words in a row as one, so that longer texts have no other shape."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\d+", "9"), r"\p{L}+", "a")
    return F.regexp_replace(plain, r"a(?:[\s,;.]{1,2}a)+", "a a")


def profiles(records: DataFrame, stream: str, batch: str, payload: str) -> DataFrame:
    """``stream``, ``batch``, ``fields``: for each batch the sketches of its fields, in their most frequent type.

    All parts are associative and bounded, so a batch of any size is summed up in partial
    aggregates: counts, numeric ranges, and of words and shapes the ``SKETCH`` ones of the smallest
    hashes, with how often they occur. Two such sketches hold the same sample of what they share.
    Records are read once: everything comes from the distinct values of each field.
    """
    keys = ["stream", "batch"]
    of = [*keys, "field", "type"]
    base = records.select(F.col(f"`{stream}`").alias("stream"), F.col(f"`{batch}`").alias("batch"), F.col(f"`{payload}`").alias("payload"))
    values = json_values(base, keys, "payload").groupBy(*of, "members", "value").agg(F.count(F.lit(1)).alias("n"))
    values, _ = Scratch(records.sparkSession, "values").save(values)
    # numbers stand for themselves where the value is one; inside texts only words do
    words = F.filter(F.split(F.lower("value"), r"[^\p{L}\p{N}._-]+"), lambda x: (x != "") & ((F.col("type") == "number") | x.rlike(r"\p{L}")))
    values = values.withColumn("x", F.expr("try_cast(value AS double)")).withColumn("tokens", F.transform(words, lambda x: F.xxhash64(x)))
    n, known = F.col("n"), F.sum(F.when(F.col("x").isNotNull(), F.col("n")))
    by_type = values.groupBy(*of).agg(
        F.sum(n).alias("n"), (F.sum(F.log10(F.abs("x") + 1) * n) / known).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), (F.sum((F.col("x") == F.floor("x")).cast("double") * n) / known).alias("whole"),
        (F.sum(F.length("value") * n) / F.sum(n)).alias("length"), (F.sum(F.size("tokens") * n) / F.sum(n)).alias("parts"),
    )
    shape = F.struct(F.lit(True).alias("shape"), F.xxhash64(_shape(F.coalesce("members", "value"))).alias("h"))
    marks = values.select(*of, "n", F.explode(F.concat(F.array(shape), F.transform("tokens", lambda h: F.struct(F.lit(False).alias("shape"), h.alias("h"))))).alias("m"))
    counted = marks.groupBy(*of, "m.shape", "m.h").agg(F.sum("n").alias("n"))
    word = F.when(~F.col("shape"), F.col("n"))  # no filter: it would make another plan of what is counted, and count it twice
    totals = counted.groupBy(*of).agg(F.count(word).alias("distinct"), F.sum(word).alias("word_count"), F.sum(word.cast("double") * (word - 1)).alias("pairs"))
    least = counted.withColumn("_r", F.row_number().over(Window.partitionBy(*of, "shape").orderBy("h"))).filter(F.col("_r") <= SKETCH)
    pick = F.struct("h", "n")
    sketches = least.groupBy(*of).agg(F.sort_array(F.collect_list(F.when(F.col("shape"), pick))).alias("shapes"), F.sort_array(F.collect_list(F.when(~F.col("shape"), pick))).alias("words"))
    best = by_type.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "field").orderBy(F.desc("n"), "type"))).filter("rank = 1").drop("rank")
    whole = best.join(totals, of, "left").join(sketches, of, "left")
    field = F.struct("field", "type", "n", "mean", "low", "high", "whole", "length", "shapes", "parts", "words", "distinct", "word_count", "pairs")
    found = whole.groupBy(*keys).agg(F.sort_array(F.collect_list(field)).alias("fields"))
    there = base.select(*keys).filter("stream is not null and batch is not null").distinct()
    return there.join(found, keys, "left")


def shared(a: Sequence[dict] | None, b: Sequence[dict] | None) -> tuple[float, float, float]:
    """(share of all that both have, share of the smaller that the larger has, how alike the frequencies are) of two sketches.

    Below the smaller of both largest hashes each sketch holds all there is, so what is compared
    there is a sample of both by the same rule; sketches that are not full hold everything.
    """
    x, y = ({r["h"]: r["n"] for r in (() if z is None else z)} for z in (a, b))
    if not x or not y:
        return 0.0, 0.0, 0.0
    ends = [max(z) for z in (x, y) if len(z) >= SKETCH]
    if ends:
        x, y = ({h: n for h, n in z.items() if h <= min(ends)} for z in (x, y))
    both = x.keys() & y.keys()
    p, q = sum(x.values()), sum(y.values())
    cross = sum(x[h] / p * y[h] / q for h in both) if both else 0.0
    own = sum((n / p) ** 2 for n in x.values()) + sum((n / q) ** 2 for n in y.values()) if p and q else 1.0
    return len(both) / max(1, len(x.keys() | y.keys())), len(both) / max(1, min(len(x), len(y))), 2 * cross / own


def _again(f: dict) -> float:
    """The chance that two words of a field are the same: it does not depend on how many records were read."""
    n = f["word_count"] or 0
    return f["pairs"] / (n * (n - 1)) if n > 1 else 0.0


def content_likeness(p: dict, q: dict) -> float:
    """0 to 1: how far two fields hold the same kind of content. All parts are shares and means, so more records of the same kind give the same value."""
    if p["type"] != q["type"]:
        return 0.0
    if p["type"] == "boolean":
        return 0.6
    if p["type"] == "object":
        return shared(p["shapes"], q["shapes"])[1]
    few = [_again(f) >= 0.025 for f in (p, q) if f["word_count"]]
    if p["type"] == "number":
        if p["mean"] is None or q["mean"] is None or math.isnan(p["mean"]) or math.isnan(q["mean"]) or (p["whole"] > 0.7) != (q["whole"] > 0.7):
            return 0.0
        near = max(0.0, 1 - abs(p["mean"] - q["mean"]))
        unit = [f["low"] >= 0 and f["high"] <= 1.0001 for f in (p, q)]
        if unit[0] != unit[1] and p["whole"] <= 0.7:
            return 0.2 * near
        return near * (0.3 + 0.7 * shared(p["words"], q["words"])[0] if p["whole"] > 0.7 and all(few) else 1.0)
    same_parts = 1.0 if abs((p["parts"] or 0) - (q["parts"] or 0)) < 0.6 else 0.4
    _, contained, alike = shared(p["words"], q["words"])
    if len(few) == 2 and all(few):
        return same_parts * contained
    if any(few):
        return 0.3 * same_parts * contained
    # where words of one source would have met at least ten times, they must have met
    met = (p["word_count"] or 0) * (q["word_count"] or 0) * (_again(p) + _again(q)) / 2
    lengths = min(p["length"], q["length"]) / max(p["length"], q["length"], 1)
    return same_parts * lengths * shared(p["shapes"], q["shapes"])[1] * (1.0 if met < 10 else min(1.0, 2 * alike))


def _tokens(name: str) -> list[str]:
    return [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)]


def _short_for(a: str, b: str) -> bool:
    """Begins alike, and all letters of the shorter come in order in the longer, which is at least twice as long."""
    a, b = sorted((a, b), key=len)
    rest = iter(b)
    return len(a) >= 2 and 2 * len(a) <= len(b) and a[0] == b[0] and all(x in rest for x in a)


def name_likeness(a: str, b: str) -> float:
    """0 to 1: letter pairs and words that two names share, or one being short for the other."""
    x, y = a.lower(), b.lower()
    if x == y:
        return 1.0
    grams = [{z[i : i + 2] for i in range(len(z) - 1)} for z in (x, y)]
    s, t = set(_tokens(a)), set(_tokens(b))
    words = len(s & t) / max(1, len(s | t))
    short = max((0.8 for u in s for v in t if _short_for(u, v)), default=0.0)
    dice = 2 * len(grams[0] & grams[1]) / max(1, len(grams[0]) + len(grams[1]))
    return max(words, dice, short)


def flood(old: list[dict], new: list[dict], apart: Iterable[tuple[str, str]] = (), rounds: int = 60, close: float = 1e-4, pull: float = 0.25) -> dict[tuple[str, str], float]:
    """Similarity flooding over two schema graphs: scores of pairs of fields, 0 to 1.

    Nodes are fields, their names, types and parts (shapes of values, members of objects); a pair of
    nodes takes its score from its own likeness and, by the weight ``pull``, from the mean of the
    pairs it is linked to, until no score moves by more than ``close``. Pairs ``apart``, names that
    are known to stand side by side, score 0.
    """
    start: dict[tuple, float] = {}
    links: dict[tuple, list[tuple]] = {}
    never = set(apart)

    def tie(a: tuple, b: tuple) -> None:
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)

    for p in old:
        for q in new:
            pair = ("field", p["field"], q["field"])
            if (p["field"], q["field"]) in never or (q["field"], p["field"]) in never:
                start[pair] = 0.0
                continue
            start[pair] = 0.65 * content_likeness(p, q) + 0.35 * name_likeness(p["field"], q["field"])
            kinds = ("type", p["type"], q["type"])
            start.setdefault(kinds, 1.0 if p["type"] == q["type"] else 0.0)
            tie(pair, kinds)
            parts = ("parts", p["field"], q["field"])
            start[parts] = shared(p["shapes"], q["shapes"])[1]
            tie(pair, parts)
    score = dict(start)
    for _ in range(rounds):
        fresh = {k: (start[k] + pull * sum(score[e] for e in links[k]) / len(links[k])) / (1 + pull) if k in links else start[k] for k in score}
        moved = max((abs(fresh[k] - score[k]) for k in score), default=0.0)
        score = fresh
        if moved < close:
            break
    return {(k[1], k[2]): v for k, v in score.items() if k[0] == "field"}


def changes_between(old: list[dict], new: list[dict], apart: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str, str | None, str | None, str | None]]:
    """(field, change, former name, former type, type) from one batch's fields to the next one's.

    Fields that went and fields that came are one field renamed if their flooded score is at least
    ``ACCEPT``; each takes part once, the highest scores first.
    """
    a, b = {p["field"]: p for p in old}, {q["field"]: q for q in new}
    gone, come = [p for k, p in a.items() if k not in b], [q for k, q in b.items() if k not in a]
    out = [(k, "retyped", k, a[k]["type"], b[k]["type"]) for k in b if k in a and a[k]["type"] != b[k]["type"]]
    renamed: dict[str, str] = {}
    if gone and come:
        for (x, y), score in sorted(flood(gone, come, apart).items(), key=lambda kv: (-kv[1], kv[0])):
            if score >= ACCEPT and x not in renamed.values() and y not in renamed:
                renamed[y] = x
    out += [(y, "renamed", x, a[x]["type"], b[y]["type"]) for y, x in renamed.items()]
    out += [(q["field"], "added", None, None, q["type"]) for q in come if q["field"] not in renamed]
    out += [(p["field"], "removed", p["field"], p["type"], None) for p in gone if p["field"] not in renamed.values()]
    return sorted(out, key=lambda r: (r[0], r[1]))


def _followed(batches: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``stream``, ``batch``, ``former``: each batch with the one before it, whatever the number of a stream's batches.

    Batches are ordered within stretches of their numbers; the first of a stretch follows the last
    of the stretch before.
    """
    cut = batches.select("stream", "batch", F.floor(F.col("batch") / stretch).alias("s"))
    inner = F.lag("batch").over(Window.partitionBy("stream", "s").orderBy("batch"))
    last = cut.groupBy("stream", "s").agg(F.max("batch").alias("last"))
    before = last.select("stream", "s", F.lag("last").over(Window.partitionBy("stream").orderBy("s")).alias("before"))
    return cut.withColumn("inner", inner).join(before, ["stream", "s"]).select("stream", "batch", F.coalesce("inner", "before").alias("former")).filter("former is not null")


def _apart(batches: DataFrame, pairs: DataFrame) -> DataFrame:
    """``x``, ``y`` of the given pairs of names that stand in one batch too often to be two names of one field, in any stream.

    Only distinct schemas are taken apart into pairs.
    """
    schemas = batches.groupBy("names").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode("names").alias("x"), "names").select("n", "x", F.explode("names").alias("y")).filter("x <= y")
    together = schemas.groupBy("x", "y").agg(F.sum("n").alias("t"))
    own = together.filter("x = y").select("x", F.col("t").alias("n"))
    met = pairs.join(together, ["x", "y"]).join(own.withColumnRenamed("n", "nx"), "x").join(own.select(F.col("x").alias("y"), F.col("n").alias("ny")), "y")
    return met.filter((F.col("t") >= 2) & (F.col("t") >= 0.05 * F.least("nx", "ny"))).select("x", "y")


_CHANGES = "stream string, batch bigint, field string, change string, former string, former_type string, type string"


def schema_changes(records: DataFrame, stream: str, batch: str, payload: str) -> DataFrame:
    """``stream``, ``batch``, ``field``, ``change``, ``former``, ``former_type``, ``type``: each change of a batch against the stream's previous one.

    ``change`` is added, removed, renamed or retyped. A batch has a field if any record has a
    non-null value there; the type is that of most values (the first by name if equal). Payloads
    that are no JSON object count for nothing; a batch of such only has no fields. Two names that
    stand side by side in batches of any stream are two fields. Rows whose
    stream or batch is null don't count; repeated rows only add weight; other columns play no role.
    """
    known, _ = Scratch(records.sparkSession, "drift").save(profiles(records, stream, batch, payload))
    named = known.select("stream", "batch", F.coalesce(F.transform("fields", lambda f: f["field"]), F.array().cast("array<string>")).alias("names"))
    former = named.select("stream", F.col("batch").alias("former"), F.col("names").alias("names_before"))
    steps, _ = Scratch(records.sparkSession, "steps").save(_followed(named).join(named, ["stream", "batch"]).join(former, ["stream", "former"]))
    gone, come = F.array_except("names_before", "names"), F.array_except("names", "names_before")
    each = steps.select("stream", "batch", F.explode(gone).alias("x"), come.alias("come")).select("stream", "batch", "x", F.explode("come").alias("y"))
    ordered, _ = Scratch(records.sparkSession, "pairs").save(each.select("stream", "batch", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    apart = ordered.join(_apart(named, ordered.select("x", "y").distinct()), ["x", "y"]).groupBy("stream", "batch").agg(F.collect_list(F.struct("x", "y")).alias("apart"))
    pairs = steps.select("stream", "batch", "former").join(known, ["stream", "batch"]).join(known.select("stream", F.col("batch").alias("former"), F.col("fields").alias("before")), ["stream", "former"]).join(apart, ["stream", "batch"], "left").select("stream", "batch", "before", "fields", "apart")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, b, old, new, never in zip(f["stream"], f["batch"], f["before"], f["fields"], f["apart"]):
                old, new, never = ([] if x is None else [dict(r) if isinstance(r, dict) else r.asDict() for r in x] for x in (old, new, never))
                rows += [(s, b, *c) for c in changes_between(old, new, [(r["x"], r["y"]) for r in never])]
            yield pd.DataFrame(rows, columns=["stream", "batch", "field", "change", "former", "former_type", "type"])

    return pairs.withColumn("stream", F.col("stream").cast("string")).withColumn("batch", F.col("batch").cast("bigint")).mapInPandas(run, _CHANGES)


def steady_names(changes: DataFrame) -> dict[str, str]:
    """Each field name with its steady name: the one that most renamings across all streams lead back to.

    Renamings seen once only, against a name's usual one, are taken for accidents. The pairs are
    as many as the schemas' names have renamings, not as the records or batches.
    """
    pairs = changes.filter("change = 'renamed'").groupBy("former", "field").count().orderBy(F.desc("count"), "former", "field").collect()
    out: dict[str, int] = {}
    into: dict[str, int] = {}
    near: dict[str, dict[str, int]] = {}
    for r in pairs:
        a, b, n = r["former"], r["field"], r["count"]
        out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0) + n
    steady: dict[str, str] = {}
    for x in sorted(near, key=lambda k: (into.get(k, 0) - out.get(k, 0), k)):  # names renamed away most come first
        if x in steady:
            continue
        steady[x], work = x, [x]
        while work:
            y = work.pop()
            for z, n in near[y].items():
                usual = max(near[z].values())
                if z not in steady and n * 4 >= usual:
                    steady[z] = x
                    work.append(z)
    return steady


def steady_table(spark: SparkSession, records: DataFrame, id: str, stream: str, batch: str, payload: str, columns: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    """``id``, ``stream``, ``batch`` and ``columns`` (steady name to SQL type): every record cast into one table.

    Fields are led to their steady names. A value of another type is cast: objects give their
    ``name`` or ``value`` member, arrays of one element give it and longer ones are joined, texts
    with a unit give their number. What can't be cast is null. Payloads that are no JSON object
    give a row of nulls. Repeated rows stay repeated.
    """
    names = steady_names(schema_changes(records, stream, batch, payload)) if names is None else names
    v = F.try_parse_json(F.col(f"`{payload}`"))
    rows = records.select(id, stream, batch, F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("_v"))

    def text(name: str) -> Column:
        path = "$['" + name.replace("\\", "").replace("'", "") + "']"
        x = F.try_variant_get("_v", path, "variant")
        kind = F.schema_of_variant(x)
        whole = F.try_variant_get("_v", path, "string")
        member = F.coalesce(F.try_variant_get("_v", path + ".name", "string"), F.try_variant_get("_v", path + ".value", "string"))
        return F.when(x.isNull() | (kind == "VOID"), None).when(kind.startswith("OBJECT"), F.coalesce(member, whole)).when(kind.startswith("ARRAY"), F.array_join(F.from_json(whole, "array<string>"), ",")).otherwise(whole)

    out = []
    for column, kind in columns.items():
        same = [column, *sorted(k for k, s in names.items() if (s == names.get(column, column)) and k != column)]
        x = F.coalesce(*[text(k) for k in same])
        if kind in ("double", "bigint", "int", "float"):
            x = F.regexp_extract(x, r"^\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*[a-zA-Z%]*\s*$", 1)
            x = F.when(x != "", x).cast("double").cast(kind)
        out.append(x.alias(column))
    return rows.select(id, stream, batch, *out)
