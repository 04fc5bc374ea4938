"""A two-armed graph network over taxonomies: shared weights, neighbour sums, cosine of the outputs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch

#: Labelled pairs that training of the linear arm takes, a bounded sample.
MAX_PAIRS = 200_000
#: Labelled pairs whose gradient is one step in a task; negatives are drawn among them.
BLOCK = 8192
#: Folds and pairs that one task puts side by side: both fit a file's dictionaries.
FOLDS, PAIRS = 2048, 4096
#: Pairs that follow one fold before the same pairs follow the next.
RUN = 256


class Layer:
    """relu(self x) beside relu(neighbours x), mixed by a linear step, with the input added where sizes agree."""

    def __init__(self, size_in: int, size_out: int, rng: np.random.Generator):
        scale = 1 / np.sqrt(size_in)
        self.own = rng.uniform(-scale, scale, (size_in, size_out))
        self.near = rng.uniform(-scale, scale, (size_in, size_out))
        self.mix = rng.uniform(-1, 1, (2 * size_out, size_out)) / np.sqrt(2 * size_out)

    def __call__(self, x: np.ndarray, around: np.ndarray) -> np.ndarray:
        h = np.concatenate([np.maximum(x @ self.own, 0), np.maximum(around @ self.near, 0)], 1)
        y = np.maximum(h @ self.mix, 0)
        return y + x if y.shape == x.shape else y


def _vectors(df: DataFrame, run, out: str = "vector") -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ("around",))

    def apply(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, a = np.stack(f["vector"].to_numpy()), np.stack(f["around"].to_numpy())
            yield f.drop(columns=["around"]).assign(**{out: list(run(x, a))})

    return df.mapInPandas(apply, kinds)


def neighbour_vectors(adjacency: DataFrame, features: DataFrame) -> DataFrame:
    """``tax``, ``node_id``, ``vector``, ``around``: each node with the weighted sum of its neighbours' vectors.

    Vectors are of one length and travel whole; places are summed side by side, no place is a row.
    """
    x, k = Scratch(features.sparkSession, "vectors").save(features.select("tax", "node_id", F.col("vector").cast("array<double>").alias("vector")), dim=F.max(F.size("vector")))
    near = adjacency.join(x.select("tax", F.col("node_id").alias("j"), "vector"), ["tax", "j"])
    dim = max(1, k["dim"] or 0)
    s = near.groupBy("tax", F.col("i").alias("node_id")).agg(*[F.sum(F.col("w") * F.get("vector", F.lit(c))).alias(f"x{c}") for c in range(dim)])
    return x.join(s, ["tax", "node_id"]).select("tax", "node_id", "vector", F.array(*[f"x{c}" for c in range(dim)]).alias("around"))


def forward(adjacency: DataFrame, features: DataFrame, layers: list[Layer], output: np.ndarray) -> DataFrame:
    """``tax``, ``node_id``, ``vector``: unit outputs of the network. Neighbour sums are joins; dense steps run on Arrow batches."""
    x = features.select("tax", "node_id", "vector")
    for layer in layers:
        x = _vectors(neighbour_vectors(adjacency, x), layer)

    def last(v: np.ndarray, _: np.ndarray) -> np.ndarray:
        y = v @ output
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    return _vectors(x.withColumn("around", F.array(F.lit(0.0))), last)


def train_linear(pairs: DataFrame, dim_out: int = 32, epochs: int = 60, negatives: int = 3, rate: float = 0.01, seed: int = 42) -> np.ndarray:
    """Weights of the linear arm: cosine to 1 on pairs (``a``, ``b`` vectors), to 0 on drawn negatives; Adam steps on a bounded sample."""
    rows = pairs.select("a", "b").orderBy(F.xxhash64("a", "b")).limit(MAX_PAIRS).toPandas()
    a, b = np.stack(rows["a"].to_numpy()).astype(float), np.stack(rows["b"].to_numpy()).astype(float)
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((a.shape[1], dim_out)) / np.sqrt(a.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        other = rng.integers(len(b), size=(negatives, len(b)))
        x = np.concatenate([a] * (1 + negatives))
        y = np.concatenate([b, *[b[o] for o in other]])
        want = np.concatenate([np.ones(len(a)), np.zeros(negatives * len(a))])
        p, q = x @ w, y @ w
        np_, nq = np.linalg.norm(p, axis=1, keepdims=True) + 1e-9, np.linalg.norm(q, axis=1, keepdims=True) + 1e-9
        u, z = p / np_, q / nq
        c = (u * z).sum(1)
        g = (2 * (c - want) / len(want))[:, None]
        grad = x.T @ (g * (z - c[:, None] * u) / np_) + y.T @ (g * (u - c[:, None] * z) / nq)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _matrix(c: pa.Array) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(part, number, matrices) of at most ``BLOCK`` rows; the parts (first column) stand together."""
    part, no, held = None, 0, []

    def cut() -> tuple[int, int, list[np.ndarray]]:
        return part, no, [np.concatenate([h[i] for h in held]) for i in range(4)]

    for b in batches:
        if not b.num_rows:
            continue
        parts, columns = b.column(0).to_numpy(), [_matrix(b.column(i)) for i in range(1, 5)]
        low = 0
        while low < len(parts):
            if held and (parts[low] != part or sum(len(h[0]) for h in held) == BLOCK):
                yield cut()
                no, held = no + 1, []
            if parts[low] != part:
                part, no = parts[low], 0
            room = BLOCK - sum(len(h[0]) for h in held)
            same = np.flatnonzero(parts[low : low + room] != part)
            high = low + (int(same[0]) if len(same) else min(room, len(parts) - low))
            held.append([c[low:high] for c in columns])
            low = high
    if held:
        yield cut()


def train_network(pairs: DataFrame, dim_hidden: int = 32, dim_out: int = 16, epochs: int = 60, negatives: int = 3, rate: float = 0.01, seed: int = 42) -> tuple[Layer, np.ndarray]:
    """One layer and the output step, trained: cosine to 1 on pairs, to 0 on drawn negatives, squared error, Adam.

    ``pairs`` has ``a`` and ``b``, each a struct of vector and around (a node with its neighbours'
    sum). Every epoch takes all pairs: each task sums the gradients of its blocks of at most
    ``BLOCK`` pairs, the driver holds nothing but weights. Pairs come to blocks by the hash of
    ``key``, or of their vectors if they have none, and negatives are drawn within a block. Sums are of whole numbers (32 binary places), so their order does not
    matter. No pairs give the starting weights.
    """
    rng = np.random.default_rng(seed)
    own = ["key"] if "key" in pairs.columns else []
    rows = pairs.select(F.col("a.vector").alias("av"), F.col("a.around").alias("an"), F.col("b.vector").alias("bv"), F.col("b.around").alias("bn"), *own)
    rows = rows.select(*[F.col(c).cast("array<double>").alias(c) for c in ("av", "an", "bv", "bn")], *own).withColumn("h", F.xxhash64(*own or ("av", "an", "bv", "bn")))
    count = pairs.count()
    if not count:
        return Layer(32, dim_hidden, rng), rng.standard_normal((dim_hidden, dim_out))
    parts = -(-count // (2 * BLOCK))
    scratch = Scratch(pairs.sparkSession, "training")
    # a file is a part: read again, its rows stand as they were written
    placed = rows.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "h", *own, "av", "an", "bv", "bn")
    saved, k = scratch.save(placed.select("part", "av", "an", "bv", "bn"), dim=F.max(F.size("av")))
    layer = Layer(k["dim"], dim_hidden, rng)
    weights = [layer.own, layer.near, layer.mix, rng.standard_normal((dim_hidden, dim_out)) / np.sqrt(dim_hidden)]
    skip = k["dim"] == dim_hidden
    m, v = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def up(w: list[np.ndarray], x: np.ndarray, around: np.ndarray) -> tuple:
        h = np.concatenate([np.maximum(x @ w[0], 0), np.maximum(around @ w[1], 0)], 1)
        y = np.maximum(h @ w[2], 0)
        z = (y + x if skip else y) @ w[3]
        return x, around, h, y, z, np.linalg.norm(z, axis=1, keepdims=True) + 1e-9

    def down(w: list[np.ndarray], state: tuple, dz: np.ndarray, out: list[np.ndarray]) -> None:
        x, around, h, y, _, _ = state
        out[3] += (y + x if skip else y).T @ dz
        dy = (dz @ w[3].T) * (y > 0)
        out[2] += h.T @ dy
        dh = (dy @ w[2].T) * (h > 0)
        cut = w[0].shape[1]
        out[0] += x.T @ dh[:, :cut]
        out[1] += around.T @ dh[:, cut:]

    def gradient(w: list[np.ndarray], t: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(x.shape, np.int64) for x in w]
            for part, no, (av, an, bv, bn) in _blocks(batches):
                draw = np.random.default_rng([seed, t, int(part), no])
                grad = [np.zeros_like(x) for x in w]
                first, second = up(w, av, an), up(w, bv, bn)
                p, q = first[4] / first[5], second[4] / second[5]
                dp, dq = np.zeros_like(p), np.zeros_like(q)
                for i in range(1 + negatives):
                    at = draw.permutation(len(bv)) if i else np.arange(len(bv))
                    c = (p * q[at]).sum(1, keepdims=True)
                    g = 2 * (c - (0 if i else 1))
                    dp += g * (q[at] - c * p) / first[5]
                    dq[at] += g * (p - c * q[at]) / second[5][at]  # no place twice in a permutation
                down(w, first, dp, grad)
                down(w, second, dq, grad)
                for x, y in zip(total, grad):
                    x += np.rint(np.ldexp(y, 32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(x.tobytes() for x in total)], pa.binary())], names=["g"])

        return run

    for t in range(1, epochs + 1):
        whole = sum(np.frombuffer(r.g, np.int64) for r in saved.mapInArrow(gradient(weights, t), "g binary").collect())
        grad = np.split(np.ldexp(whole.astype(float), -32) / (count * (1 + negatives)), np.cumsum([w.size for w in weights])[:-1])
        for i, w in enumerate(weights):
            g = grad[i].reshape(w.shape)
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
            w -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    scratch.drop(saved)
    layer.own, layer.near, layer.mix = weights[:3]
    return layer, weights[3]


def applied(prepared: DataFrame, network: tuple[Layer, np.ndarray]) -> DataFrame:
    """``tax``, ``node_id``, ``vector``: unit outputs of a trained network for nodes with their neighbours' sums."""
    layer, output = network

    def run(x: np.ndarray, around: np.ndarray) -> np.ndarray:
        y = layer(x, around) @ output
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    return _vectors(prepared.select("tax", "node_id", "vector", "around"), run)


def save_network(path: str, network: tuple[Layer, np.ndarray]) -> None:
    """A trained network as one file of arrays."""
    layer, output = network
    np.savez(path, own=layer.own, near=layer.near, mix=layer.mix, output=output)


def load_network(path: str) -> tuple[Layer, np.ndarray]:
    with np.load(path) as f:
        layer = Layer(f["own"].shape[0], f["own"].shape[1], np.random.default_rng(0))
        layer.own, layer.near, layer.mix = f["own"], f["near"], f["mix"]
        return layer, f["output"]


def _square(p: DataFrame) -> DataFrame:
    """``fold``, ``pair``: every pair beside every pair, in an order that stays small once it is written.

    A task has FOLDS folds and PAIRS pairs. It lists RUN pairs with the first fold, the same with
    the next, and so on: a file's folds are long runs and its pairs repeat within every page.
    """
    spark = p.sparkSession
    p, seen = Scratch(spark, "folds").save(p.select("pair", (F.row_number().over(Window.orderBy("pair")) - 1).cast("long").alias("i")))
    n = max(1, seen["rows"])
    down, across = -(-n // FOLDS), -(-n // PAIRS)
    high, wide = -(-n // down), -(-n // (across * RUN))
    runs = p.groupBy(F.expr(f"i * {across * wide} div {n}").alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pair"))), lambda x: x["pair"]).alias("pairs"))
    at = spark.range(0, down * across * wide * high, 1, down * across)  # a partition has the runs and folds of one task, folds rising fastest
    at = at.select(F.expr(f"id div {across * wide * high} * {high} + id % {high}").alias("i"), F.expr(f"id div {high} % {across * wide}").alias("run"))
    f = p.select("i", F.col("pair").alias("fold"))
    return at.join(F.broadcast(f), "i").join(F.broadcast(runs), "run").select("fold", F.explode("pairs").alias("pair"))


def folds(pairs: DataFrame, by: str = "pair") -> DataFrame:
    """``fold``, ``pair``, ``role``: each pair held out once, or each taxonomy with all pairs it is in.

    ``pairs`` is a short list with pair, source, target.
    """
    p = pairs.select("pair", "source", "target").distinct()
    if by == "pair":
        f = _square(p)
        held = F.col("fold") == F.col("pair")
    else:
        f = p.select(F.col("source").alias("fold")).union(p.select("target")).distinct().join(F.broadcast(p))
        held = (F.col("fold") == F.col("source")) | (F.col("fold") == F.col("target"))
    return f.select("fold", "pair", F.when(held, "test").otherwise("train").alias("role"))


def training_report(rows: DataFrame) -> DataFrame:
    """Nominal and distinct training triples (source_id, target_id, label) and positives."""
    d = rows.select("source_id", "target_id", "label").distinct()
    return rows.agg(F.count(F.lit(1)).alias("nominal"), F.sum("label").alias("positives")).crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("distinct_rows"), F.sum("label").alias("distinct_positives"))))
