"""Items of varying length put into containers of fixed capacity."""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch, tasks

#: Pattern by which the byte-level vocabularies cut text before merging, a fixed value of the public tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items that one task packs at a time.
GROUP = 4096


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_LOADED: dict[str, object] = {}


def _encoder(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(docs: DataFrame, id: str, text: str, path: str) -> DataFrame:
    """``id``, ``tokens`` of each row; null and empty texts have none."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["id", "tokens"])

    return docs.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"id {kind}, tokens bigint").withColumnRenamed("id", id)


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway differencing: the window of each item, and the windows' sums.

    Every item starts as a partition with one full window. The two partitions of the largest
    spread are merged, the fuller windows of one onto the emptier ones of the other, until one is
    left. Which items a window holds is kept as a forest of merges.
    """
    n = len(sizes)
    left, right = np.full(2 * n + 1, -1, np.int64), np.full(2 * n + 1, -1, np.int64)
    used = n
    heap = []
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, s in enumerate(sizes):
        sums, nodes = np.array([s], np.int64), np.array([i], np.int64)
        parts[i] = (sums, nodes)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = parts.pop(a), parts.pop(b)  # full windows in falling order; the rest are empty
        if len(sa) < len(sb):
            sa, na, sb, nb = sb, nb, sa, na
        over = max(0, len(sa) + len(sb) - windows)
        keep = len(sa) - over
        joined_s = sa[keep:] + sb[::-1][:over] if over else sa[:0]
        if over:
            ids = np.arange(used, used + over)
            left[ids], right[ids] = na[keep:], nb[::-1][:over]
            used += over
        else:
            ids = na[:0]
        sums = np.concatenate([sa[:keep], joined_s, sb[: len(sb) - over]])
        nodes = np.concatenate([na[:keep], ids, nb[: len(nb) - over]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts[fresh] = (sums, nodes)
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, fresh))
        fresh += 1
    sums, nodes = parts[heap[0][1]]
    where = np.empty(n, np.int64)
    for w, root in enumerate(nodes):
        work = [int(root)]
        while work:
            x = work.pop()
            if x < n:
                where[x] = w
            else:
                work += (int(left[x]), int(right[x]))
    return where, sums


def repaired(sizes: np.ndarray, where: np.ndarray, windows: int, capacity: int, partners: int = 64) -> np.ndarray | None:
    """Near-equal windows of which some overflow a little, mended by swaps: null if no swap helps.

    The fullest window gives an item to one with room, or changes it for a smaller one there: the
    swap that takes off just enough, else the one that takes off most.
    """
    load = np.bincount(where, weights=sizes, minlength=windows).astype(np.int64).tolist()
    inside: list[list[int]] = [[] for _ in range(windows)]
    for i, w in enumerate(where.tolist()):
        inside[w].append(i)
    size = sizes.tolist()
    over = [(capacity - x, w) for w, x in enumerate(load) if x > capacity]
    heapq.heapify(over)
    rooms = sorted((capacity - x, w) for w, x in enumerate(load) if x < capacity)
    while over:
        lack, w = heapq.heappop(over)
        need, best = -lack, None
        for room, u in rooms[: -partners - 1 : -1]:
            for a in inside[w]:
                for b in (-1, *inside[u]):
                    d = size[a] - (size[b] if b >= 0 else 0)
                    if 0 < d <= room:
                        rank = (0, d) if d >= need else (1, -d)
                        if best is None or rank < best[0]:
                            best = (rank, d, a, b, room, u)
            if best and best[0] == (0, need):
                break
        if best is None:
            return None
        _, d, a, b, room, u = best
        inside[w].remove(a)
        inside[u].append(a)
        if b >= 0:
            inside[u].remove(b)
            inside[w].append(b)
        load[w] -= d
        load[u] += d
        rooms.remove((room, u))
        if load[u] < capacity:
            bisect.insort(rooms, (capacity - load[u], u))
        if load[w] > capacity:
            heapq.heappush(over, (capacity - load[w], w))
        elif load[w] < capacity:
            bisect.insort(rooms, (capacity - load[w], w))
    out = np.empty(len(sizes), np.int64)
    for w, x in enumerate(inside):
        out[x] = w
    return out


def fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, in as few windows of ``capacity`` as differencing and repair fill: their number rises while one overflows."""

    def tried(windows: int) -> np.ndarray | None:
        where, sums = differencing(sizes, windows)
        return where if sums[0] <= capacity else repaired(sizes, where, windows, capacity)

    least = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    low, k = least - 1, least
    while (where := tried(k)) is None:
        low = k
        k += max(1, k // 100)
    while k - low > 1:  # between the last number that overflowed and the first that fitted
        mid = (k + low) // 2
        if (w := tried(mid)) is None:
            low = mid
        else:
            k, where = mid, w
    return where


def pack(spark: SparkSession, docs: DataFrame, id: str, text: str, capacity: int = 2048, path: str | None = None, group: int = GROUP) -> DataFrame:
    """``id``, ``piece``, ``start``, ``tokens``, ``container``: where each text, or each piece of a long one, goes.

    Lengths are tokens of the vocabulary file ``path``. Only a text longer than ``capacity`` is
    split: into full containers and a rest that is packed like any text. Null and empty texts
    take no room and give no row; repeated rows are items of their own; other columns play no role.

    Items are dealt to groups of about ``group`` by a hash, so that every group has lengths of all
    kinds; each group is packed by itself, at the cost of at most one part-filled container more.
    """
    scratch = Scratch(spark, "packing")
    counted = token_counts(docs, id, text, path or tokenizer_path()).filter("tokens > 0")
    pieces = counted.select(F.col(f"`{id}`").alias("id"), "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity))).alias("piece")).select("id", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * capacity).cast("bigint").alias("start"), F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("tokens"))
    rows, n = scratch.save(pieces, rest=F.count_if(F.col("tokens") < capacity))
    groups = max(1, round(n["rest"] / group))
    full = rows.filter(F.col("tokens") == capacity).withColumn("container", F.concat(F.lit("f-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("-"), F.col("piece")))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held = None, 0, []

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            where = fit(t["tokens"].to_numpy(), capacity)
            t = t.drop(["g"]).append_column("container", pa.array([f"g-{now}-{part}-{w}" for w in where.tolist()]))
            return t.to_batches()[0]

        for b in batches:
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for x, y in zip(cuts, cuts[1:]):
                if y == x:
                    continue
                if g[x] != now and held:
                    yield flush(held)
                    held = []
                if g[x] != now:
                    now, part = g[x], 0
                while x < y:
                    room = 2 * group - sum(r.num_rows for r in held)
                    if room == 0:
                        yield flush(held)
                        held, part = [], part + 1
                        continue
                    held.append(b.slice(x, min(room, y - x)))
                    x += min(room, y - x)
        if held:
            yield flush(held)

    parts = rows.filter(F.col("tokens") < capacity).select(F.pmod(F.xxhash64("id", "tokens"), F.lit(groups)).alias("g"), "id", "piece", "start", "tokens")
    packed = parts.repartition(min(groups, max(tasks(spark), groups // 64)), "g").sortWithinPartitions("g", "tokens", "id").mapInArrow(run, f"id {kind}, piece bigint, start bigint, tokens bigint, container string")
    return packed.unionByName(full).withColumnRenamed("id", id)
