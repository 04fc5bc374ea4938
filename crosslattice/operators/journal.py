"""An append-only journal of outside calls: requests, validation, resuming, accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslattice.functions.numbers import finite_number
from crosslattice.operators.statistics import exact_percentiles


def requests(candidates: DataFrame, texts: DataFrame, model: str, instructions: str = "Candidate {index}") -> DataFrame:
    """``pair``, ``source_id``, ``candidate_ids``, ``request``: one JSON request per source with its candidates in rank order.

    ``texts`` gives each node_id its description; sources without candidates get no request.
    """
    t = texts.select("node_id", F.col("text"))
    c = candidates.join(t.select(F.col("node_id").alias("target_id"), F.col("text").alias("target_text")), "target_id")
    per = c.groupBy("pair", "source_id").agg(F.array_sort(F.collect_list(F.struct("rank", "target_id", "target_text"))).alias("c"))
    per = per.join(t.select(F.col("node_id").alias("source_id"), F.col("text").alias("source_text")), "source_id")
    head, _, tail = instructions.partition("{index}")
    items = F.transform("c", lambda x, i: F.struct(i.alias("index"), x["target_text"].alias("description")))
    asked = F.map_from_entries(F.transform("c", lambda x, i: F.struct(F.concat(F.lit("candidate_"), i.cast("string")), F.struct(F.lit("probability").alias("type"), F.concat(F.lit(head), i.cast("string"), F.lit(tail)).alias("instructions")))))
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.struct(F.col("source_text").alias("source"), items.alias("candidates")).alias("state"), asked.alias("questions")))
    return per.select("pair", "source_id", F.transform("c", lambda x: x["target_id"]).alias("candidate_ids"), body.alias("request"))


def response_error(response: Column, candidates: Column, model: str, answer: str = "probability") -> Column:
    """What is wrong with a response, null if nothing: model, answer keys, answer type, probability, usage cost."""
    v = F.try_parse_json(response)
    name = F.try_variant_get(v, "$.model", "string")
    answers = F.try_variant_get(v, "$.answers", "map<string,variant>")
    wanted = F.transform(F.sequence(F.lit(1), F.greatest(F.size(candidates), F.lit(1))), lambda i: F.concat(F.lit("candidate_"), (i - 1).cast("string")))
    keys = F.array_sort(F.map_keys(answers))
    types = F.forall(F.map_values(answers), lambda a: F.coalesce(F.try_variant_get(a, "$.type", "string") == answer, F.lit(False)))
    good = F.forall(F.map_values(answers), lambda a: F.coalesce(finite_number(F.try_variant_get(a, f"$.{answer}", "variant"), 0, 1), F.lit(False)))
    cost = F.coalesce(finite_number(F.try_variant_get(v, "$.usage.cost", "variant"), 0), F.lit(False))
    return (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
        .when(name.isNull() | ~((name == model) | name.startswith(model + "-")), "unexpected model")
        .when(answers.isNull() | ~F.coalesce(keys == F.array_sort(wanted), F.lit(False)), "answers do not cover the candidates")
        .when(~types, "wrong answer type").when(~good, "invalid probability").when(~cost, "no valid cost")
    )


def probabilities(journal: DataFrame, answer: str = "probability") -> DataFrame:
    """``pair``, ``mode``, ``source_id``, ``target_id``, ``score`` from valid responses with ``candidate_ids``."""
    each = journal.select("pair", "mode", "source_id", F.posexplode("candidate_ids").alias("i", "target_id"), F.try_parse_json("response").alias("v"))
    answers = F.try_variant_get("v", "$.answers", "map<string,variant>")
    score = F.try_variant_get(F.try_element_at(answers, F.concat(F.lit("candidate_"), F.col("i").cast("string"))), f"$.{answer}", "double")
    return each.select("pair", "mode", "source_id", "target_id", score.alias("score"))


def missing(expected: DataFrame, journal: DataFrame) -> DataFrame:
    """Keys of expected requests without a success."""
    return expected.select("key").distinct().join(journal.filter("error is null").select("key"), "key", "left_anti")


def duplicates(journal: DataFrame) -> DataFrame:
    """``key``, ``n``: requests with several successes."""
    return journal.filter("error is null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def integrity_errors(expected: DataFrame, journal: DataFrame) -> DataFrame:
    """``key``, ``problem``: successes of unknown requests, changed requests, other status than 200, and repeated successes."""
    ok = journal.filter("error is null")
    j = ok.join(expected.select("key", F.col("request").alias("wanted")), "key", "left")
    problem = F.when(F.col("wanted").isNull(), "unexpected request").when(~F.col("wanted").eqNullSafe(F.col("request")), "request changed").when(~F.col("status_code").eqNullSafe(F.lit(200)), "status is not 200")
    return j.select("key", problem.alias("problem")).filter("problem is not null").unionByName(duplicates(journal).select("key", F.lit("repeated success").alias("problem")))


def charge(cost: Column, most: float) -> Column:
    """What a call counts against a budget: its cost if that is a finite number of at least 0, else the most a call can cost."""
    return F.when(cost.isNotNull() & ~F.isnan(cost) & (cost >= 0) & (cost < float("inf")), cost).otherwise(F.lit(most))


def within_budget(pending: DataFrame, part: str, order: list[str], cost: str, budget: float, most: float = 0.0) -> DataFrame:
    """The rows of each part, in order, whose running cost stays within the budget; a cost that is unknown counts as ``most``. Adds ``spent``."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return pending.withColumn("spent", F.sum(charge(F.col(cost).cast("double"), most)).over(w)).filter(F.col("spent") <= budget)


def collect(pending: DataFrame, call: Callable[[str], tuple[int, str | None, str | None]], partitions: int = 8) -> DataFrame:
    """Runs ``call`` (request to status, response, error) for each ``key`` and ``request``; partitions bound how many run at once."""
    from collections.abc import Iterable, Iterator
    from time import perf_counter

    import pandas as pd

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, request in zip(f["key"], f["request"]):
                t = perf_counter()
                try:
                    status, response, error = call(request)
                except Exception as e:  # a failed call is a row of the journal, too
                    status, response, error = 0, None, str(e)
                rows.append((key, request, status, response, error, perf_counter() - t))
            yield pd.DataFrame(rows, columns=["key", "request", "status_code", "response", "error", "latency_seconds"])

    return pending.select("key", "request").repartition(partitions).mapInPandas(run, "key string, request string, status_code int, response string, error string, latency_seconds double")


def accounting(journal: DataFrame, mode: str, latency: str, cost: str, failed: Column) -> DataFrame:
    """By mode and in all (``whole`` true, mode null): attempts, successes, cost with how often it is known, latency of successes with exact percentiles."""
    x = F.when(~failed, F.col(latency))
    base = journal.select(F.col(mode).alias("mode"), failed.alias("failed"), F.col(cost).cast("double").alias("cost"), x.alias("latency"))
    n = F.count(F.lit(1))
    figures = base.cube("mode").agg(
        (F.grouping("mode") == 1).alias("whole"), n.alias("attempts"), F.count_if(~F.col("failed")).alias("successes"), F.sum("cost").alias("cost"), F.count("cost").alias("cost_known"), (n - F.count("cost")).alias("cost_missing"),
        F.min("latency").alias("latency_min"), F.avg("latency").alias("latency_mean"), F.max("latency").alias("latency_max"),
    )
    both = base.select(F.explode(F.array(F.struct("mode", F.lit(False).alias("whole")), F.struct(F.lit(None).cast("string").alias("mode"), F.lit(True).alias("whole")))).alias("k"), "latency").select("k.mode", "k.whole", "latency")
    p = exact_percentiles(both, ["mode", "whole"], "latency", (0.5, 0.9, 0.95)).groupBy("mode", "whole").agg(*[F.max(F.when(F.col("p") == v, F.col("x"))).alias(c) for c, v in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))])
    p = p.withColumnsRenamed({"mode": "_m", "whole": "_w"})
    return figures.join(p, F.col("mode").eqNullSafe(F.col("_m")) & (F.col("whole") == F.col("_w")), "left").drop("_m", "_w")


def frozen(spark: SparkSession, expected: DataFrame, inputs: DataFrame, path: str) -> DataFrame:
    """The expected requests as first written to ``path``, with the fingerprints of their inputs (``path``, ``sha256``).

    The first call writes both; a later one raises if an input's fingerprint has changed or is gone,
    or if other requests are expected now.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/inputs/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        expected.select("key", "request").write.mode("overwrite").parquet(f"{path}/expected")
        inputs.select("path", "sha256").write.mode("overwrite").parquet(f"{path}/inputs")
    was, now = spark.read.parquet(f"{path}/inputs"), inputs.select("path", "sha256")
    kept = spark.read.parquet(f"{path}/expected")
    if not was.exceptAll(now).isEmpty() or not now.exceptAll(was).isEmpty():
        raise ValueError("the inputs have changed since the experiment was frozen")
    if not kept.exceptAll(expected.select("key", "request")).isEmpty() or not expected.select("key", "request").exceptAll(kept).isEmpty():
        raise ValueError("other requests are expected than were frozen")
    return kept


_ROWS = "key string, request string, status_code int, response string, error string, latency_seconds double"


def replay(spark: SparkSession, path: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journal so far, requests without a success) of the journal at ``path``; one that breaks a rule of ``integrity_errors`` raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(_ROWS).json(path) if there else spark.createDataFrame([], _ROWS)
    bad = integrity_errors(expected, rows).limit(1).collect()
    if bad:
        raise ValueError(f"journal at {path}: {bad[0].problem} ({bad[0].key})")
    return rows, expected.join(missing(expected, rows), "key", "left_semi")


def collect_all(spark: SparkSession, path: str, expected: DataFrame, call: Callable[[str], tuple[int, str | None, str | None]], cost: Callable[[Column], Column], most: float, budget: float, batch: int = 1000, partitions: int = 8) -> dict:
    """Collects what the journal at ``path`` does not hold yet, batch by batch, each appended before the next begins.

    Stops before a batch whose calls, at ``most`` each, could overrun the budget together with what
    is charged so far, and after a batch with an error; the next call goes on from there. Gives how
    many requests are done and left, what is charged, and why it stopped.
    """
    while True:
        rows, left = replay(spark, path, expected)
        spent = float(rows.agg(F.sum(charge(cost(F.col("response")), most))).collect()[0][0] or 0.0)
        n, done = left.count(), rows.filter("error is null").count()
        if not n:
            return {"done": done, "left": 0, "charged": spent, "stopped": ""}
        take = min(batch, n)
        if spent + take * most > budget:
            return {"done": done, "left": n, "charged": spent, "stopped": "budget"}
        before = rows.filter("error is not null").count()
        collect(left.orderBy("key").limit(take), call, partitions).write.mode("append").json(path)
        if spark.read.schema(_ROWS).json(path).filter("error is not null").count() > before:
            rows, left = replay(spark, path, expected)
            spent = float(rows.agg(F.sum(charge(cost(F.col("response")), most))).collect()[0][0] or 0.0)
            return {"done": rows.filter("error is null").count(), "left": left.count(), "charged": spent, "stopped": "error"}


def fingerprints(df: DataFrame) -> DataFrame:
    """``path``, ``sha256`` of files read with the ``binaryFile`` format."""
    return df.select("path", F.sha2("content", 256).alias("sha256"))
