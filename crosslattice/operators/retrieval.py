"""Candidate generation: equal labels, nearest vectors, BM25, and their union."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslattice.functions.text import label_key, tokens
from crosslattice.operators.assign import top_k
from crosslattice.runtime import Scratch, tasks

#: Queries that every task holds at once; a larger query set goes over the rows block by block.
BLOCK = 4096
#: Okapi constants, fixed values: term saturation, length weight, floor of negative idf as a share of the mean.
K1, B, EPSILON = 1.5, 0.75, 0.25


def label_matches(source: DataFrame, target: DataFrame, label: str = "name") -> DataFrame:
    """Equal labels, case and padding aside: the smallest target id of each source, confidence 1; blank labels match nothing."""
    s = source.select("pair", "source_id", label_key(F.col(label)).alias("_k")).filter("_k <> ''")
    t = target.select("pair", "target_id", label_key(F.col(label)).alias("_k")).filter("_k <> ''")
    least = t.groupBy("pair", "_k").agg(F.min("target_id").alias("target_id"))  # one row a label: no label multiplies the join
    return s.join(least, ["pair", "_k"]).groupBy("pair", "source_id").agg(F.min("target_id").alias("target_id")).withColumn("score", F.lit(1.0))


_FOUND = pa.schema([("pair", pa.string()), ("source_id", pa.string()), ("target_id", pa.string()), ("score", pa.float64())])
_FOUND_SQL = "pair string, source_id string, target_id string, score double"


class _Best:
    """The ``k`` best targets so far of each of some queries: scores falling, then ids rising."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.name = k, np.full((queries, 0), -np.inf), np.zeros((queries, 0), object)

    def add(self, score: np.ndarray, names: np.ndarray) -> None:
        """``score`` has a row for each query and a column for each of ``names``; minus infinity is no candidate."""
        order = np.argsort(names, kind="stable")
        score, names = score[:, order], names[order]
        top = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        s = np.concatenate([self.score, np.take_along_axis(score, top, 1)], 1)
        n = np.concatenate([self.name, names[top]], 1)
        by_name = np.argsort(n, axis=1, kind="stable")
        s, n = np.take_along_axis(s, by_name, 1), np.take_along_axis(n, by_name, 1)
        top = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
        self.score, self.name = np.take_along_axis(s, top, 1), np.take_along_axis(n, top, 1)

    def batch(self, pair: str, queries: list[str]) -> pa.RecordBatch:
        r, c = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array([pair] * len(r), pa.string()), pa.array([queries[i] for i in r], pa.string()), pa.array(self.name[r, c].tolist(), pa.string()), pa.array(self.score[r, c])], schema=_FOUND)


def _portions(queries: DataFrame, order: Sequence[str], block: int) -> Iterator[list]:
    """A query set in blocks of at most ``block`` rows, each small enough for every task; one pass over the rows for each."""
    saved, n = Scratch(queries.sparkSession, "queries").save(queries.withColumn("_at", F.pmod(F.xxhash64(*order), F.lit(1 << 30))))
    parts = max(1, -(-n["rows"] // block) * 2 if n["rows"] > block else 1)
    for p in range(parts):
        got = saved.filter(F.floor(F.col("_at") * parts / (1 << 30)) == p).drop("_at").collect() if n["rows"] else []
        if got:
            yield got


def _union(found: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.sparkSession.createDataFrame([], _FOUND_SQL) if not found else found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def similarity_top_k(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, others: bool = True) -> DataFrame:
    """The ``k`` nearest targets by cosine of every query of the same pair, with ``rank``.

    ``queries`` has pair, source_id, vector; ``rows`` pair, target_id, vector. A stated query set
    is held against all rows: it is broadcast in blocks of at most ``block`` queries, the rows
    stream past as matrices, each task keeps the best of each query and only those are ranked. With
    ``others`` a query does not find itself, the target of its own id. Null vectors don't count;
    scores are rounded to 9 places so that equal vectors tie.
    """
    q = queries.filter("vector is not null").select("pair", F.col("source_id").cast("string").alias("source_id"), F.col("vector").cast("array<double>").alias("vector"))
    t = rows.filter("vector is not null").select("pair", F.col("target_id").cast("string").alias("target_id"), F.col("vector").cast("array<double>").alias("vector"))

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def search(held):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets, best = held.value, {}
            for b in batches:
                if not b.num_rows:
                    continue
                pairs, names = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), object)
                v = b.column(2)
                whole = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if len({*np.diff(v.offsets.to_numpy()).tolist()}) == 1 else None
                for pair in set(pairs) & set(sets):
                    at = np.flatnonzero(pairs == pair)
                    m = unit(whole[at] if whole is not None else np.array(v.take(pa.array(at)).to_pylist(), np.float64))
                    ids, own = sets[pair]
                    s = np.round(own @ m.T, 9)
                    if others:
                        place = {x: i for i, x in enumerate(ids)}
                        for j, x in enumerate(names[at]):
                            if x in place:
                                s[place[x], j] = -np.inf
                    best.setdefault(pair, _Best(len(ids), k)).add(s, names[at])
            for pair, x in best.items():
                yield x.batch(pair, sets[pair][0])

        return run

    found = []
    for part in _portions(q, ["pair", "source_id"], block):
        sets: dict = {}
        for r in part:
            sets.setdefault(r.pair, ([], []))
            sets[r.pair][0].append(r.source_id)
            sets[r.pair][1].append(r.vector)
        held = q.sparkSession.sparkContext.broadcast({p: (i, unit(np.array(v, np.float64))) for p, (i, v) in sets.items()})
        found.append(t.mapInArrow(search(held), _FOUND_SQL))
    return top_k(_union(found, q), k)


def similarity_within(queries: DataFrame, rows: DataFrame, k: int, block: int = 2 * BLOCK) -> DataFrame:
    """The ``k`` nearest targets by cosine of every query, where all rows of a pair are queries: with ``rank``, scores rounded to 9 places.

    Queries and rows as for ``similarity_top_k``; vectors are of one length, none null. Both go to the
    task of their pair, a pair's rows once for each ``block`` of its queries, and stream past the block;
    nothing passes through the driver.
    """
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    sizes, _ = Scratch(queries.sparkSession, "sizes").save(queries.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).select("pair", cut("n").alias("parts")))
    named = lambda df, c: df.select("pair", F.col(c).cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    q = named(queries, "source_id").join(sizes, "pair").select("pair", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "vector")
    t = named(rows, "target_id").join(sizes, "pair").select("pair", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "vector")

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def merged(top: tuple[np.ndarray, np.ndarray], own: np.ndarray, m: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best so far and those of more targets, whose ids follow all earlier ones: of equal scores the earlier stay."""
        s = own @ m.T
        least = top[0][:, -1]
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        r, c = np.nonzero(s >= least[:, None] - 1e-8)  # the rest can't be among the best, rounded or not
        score, name = np.round(s[r, c], 9), names[c]
        kept = top[0] > -np.inf
        r, score, name = np.concatenate([np.nonzero(kept)[0], r]), np.concatenate([top[0][kept], score]), np.concatenate([top[1][kept], name])
        order = np.lexsort((np.arange(len(r)), -score, r))
        r, score, name = r[order], score[order], name[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best = np.full(top[0].shape, -np.inf), np.full(top[0].shape, None, object)
        fit = place < k
        best[0][r[fit], place[fit]], best[1][r[fit], place[fit]] = score[fit], name[fit]
        return best

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, own, top = None, [], [], None, None

        def out() -> pa.RecordBatch:
            r, c = np.nonzero(top[0] > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(r), pa.string()), pa.array([ids[i] for i in r], pa.string()), pa.array(top[1][r, c].tolist(), pa.string()), pa.array(top[0][r, c])], schema=_FOUND)

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            keys = list(zip(*[b.column(i).to_pylist() for i in range(3)]))
            names = np.array(b.column(3).to_pylist(), object)
            low = 0
            while low < len(keys):
                high = low + 1
                while high < len(keys) and keys[high] == keys[low] and high - low < 1024:
                    high += 1
                if keys[low][:2] != now:
                    if top is not None:
                        yield out()
                    now, ids, held, own, top = keys[low][:2], [], [], None, None
                if keys[low][2] == 0:
                    ids.extend(names[low:high])
                    held.append(v[low:high])
                elif ids:
                    if own is None:
                        own = unit(np.concatenate(held))
                        top = np.full((len(ids), k), -np.inf), np.full((len(ids), k), None, object)
                    top = merged(top, own, unit(v[low:high]), names[low:high])
                low = high
        if top is not None:
            yield out()

    n = tasks(queries.sparkSession)
    found = q.unionByName(t).repartition(n, "pair", "part").sortWithinPartitions("pair", "part", "side", "id").mapInArrow(run, _FOUND_SQL)
    return top_k(found, k)


def hashed_vector(text: list[str | None], dim: int = 256) -> np.ndarray:
    """Unit vectors of texts by hashed letter triples: a deterministic stand-in for a trained encoder."""
    import xxhash

    out = np.zeros((len(text), dim))
    for i, t in enumerate(text):
        s = f"  {(t or '').lower()} "
        for j in range(len(s) - 2):
            h = xxhash.xxh64_intdigest(s[j : j + 3])
            out[i, h % dim] += 1 if h >> 63 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def encode(df: DataFrame, text: str, encoder=hashed_vector, out: str = "vector") -> DataFrame:
    """Adds a vector of ``text``; ``encoder`` takes a list of texts and gives a matrix. It runs on Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(s.tolist())))

    return df.withColumn(out, run(F.col(text)))


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents of each query by Okapi BM25, with ``rank``; only positive scores.

    ``queries`` has source_id, text (a stated set); ``docs`` has target_id, text. A word's idf is
    ln(N - df + 0.5) - ln(df + 0.5), a negative one is replaced by a quarter of the mean over all
    words of the documents; repeated query words count each time. Statistics cover all documents.

    The queries form an inverted index, words to the queries that hold them, broadcast in blocks of
    at most ``block`` queries. Documents stream past it; each adds to the queries its own words lead to, each
    task keeps the best of each query, and only those are ranked: no pairs are shuffled.
    """
    d = docs.select(F.col("target_id").cast("string").alias("target_id"), tokens(F.col("text")).alias("w"))
    q = queries.select(F.col("source_id").cast("string").alias("source_id"), tokens(F.col("text")).alias("w"))
    df = d.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    df, _ = Scratch(d.sparkSession, "bm25").save(df)
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean")).collect()[0]
    n, mean = stats["n"], float(stats["mean"] or 1.0) or 1.0
    idf = F.log(n - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    average = float(df.agg(F.avg(idf)).collect()[0][0] or 0.0)

    def score(held):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, index, queries_, weights = held.value
            best = _Best(len(names), k)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for low in range(0, len(ids), 256):
                    part = texts[low : low + 256]
                    s = np.zeros((len(part), len(names)))
                    for i, x in enumerate(part):
                        at = Counter(c for w in x if (c := index.get(w)) is not None)
                        if at:
                            room = K1 * (1 - B + B * len(x) / mean)
                            for c, f in sorted(at.items()):
                                s[i, queries_[c]] += weights[c] * (f * (K1 + 1) / (f + room))
                    s = np.round(s.T, 9)
                    best.add(np.where(s > 0, s, -np.inf), np.array(ids[low : low + 256], object))
            yield best.batch("", names)

        return run

    found = []
    for part in _portions(q, ["source_id"], block):
        words = sorted({w for r in part for w in r.w})
        asked = d.sparkSession.createDataFrame([(w,) for w in words] or [("",)], "t string")
        known = {r.t: float(r.idf) for r in df.join(F.broadcast(asked), "t").select("t", idf.alias("idf")).collect()}  # at most the words of one block
        held: dict[str, dict[int, float]] = {}
        part = sorted(part, key=lambda r: r.source_id)
        for j, r in enumerate(part):
            for w in r.w:
                if w in known:
                    of = held.setdefault(w, {})
                    of[j] = of.get(j, 0.0) + (known[w] if known[w] >= 0 else EPSILON * average)
        terms = sorted(held)
        index = {w: i for i, w in enumerate(terms)}
        sent = d.sparkSession.sparkContext.broadcast(([r.source_id for r in part], index, [np.array(list(held[w]), np.int64) for w in terms], [np.array(list(held[w].values())) for w in terms]))
        found.append(d.mapInArrow(score(sent), _FOUND_SQL))
    return top_k(_union(found, d), k).drop("pair")


def hybrid_union(first: DataFrame, second: DataFrame, total: int) -> DataFrame:
    """The first list, then what only the second has, cut at ``total`` per source; scores stay on their own scales."""
    a = first.select("pair", "source_id", "target_id", "score", F.lit(0).alias("list"), "rank")
    b = second.select("pair", "source_id", "target_id", "score", F.lit(1).alias("list"), "rank")
    one = Window.partitionBy("pair", "source_id", "target_id").orderBy("list", "rank")
    each = a.unionByName(b).withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r")
    place = Window.partitionBy("pair", "source_id").orderBy("list", "rank", "target_id")
    return each.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= total).select("pair", "source_id", "target_id", "score", "list", F.col("place").alias("rank"))
