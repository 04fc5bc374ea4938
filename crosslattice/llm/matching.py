"""Entities matched across sources that share no key."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslattice.operators.assign import greedy_injective
from crosslattice.runtime import Scratch, lookup, nonblank, tasks

#: Words that are kept as vocabulary, most frequent first: bounds what every worker holds.
VOCABULARY = 30_000
#: Pairs of words trained on: bounded by the vocabulary, not by the records.
MAX_TRAINED_PAIRS = 300_000
#: Pairs each calibration is fitted on, a bounded sample of the blocks.
MAX_LABELLED = 60_000
#: Records in a stretch of random walks, and rows of a block compared within one task; larger ones are split.
STRETCH, CELL = 20_000, 1_500
#: Mean records of a hyperplane block; chance that two names of cosine ``NEAR`` share one of the tables.
BLOCK, MEET, NEAR = 8, 0.9, 0.85
DIM = 48

#: Number words, fixed values.
ONES = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))

_TENS, _UNITS = "|".join(TENS), "|".join(k for k, v in ONES.items() if 0 < v < 10)
_NUMBER = re.compile(rf"\d+(?:\.\d+)?|\b(?:(?:{_TENS})(?:[- ](?:{_UNITS}))?|{'|'.join(ONES)})\b", re.I)
_SPLIT = re.compile(r"(?<=[^\W\d_])(?<![A-Z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_FILLER = frozenset("of the a an and for in".split())


def number(text: str) -> float | None:
    """The number that a text is, in digits or words."""
    s = re.sub(r"[\s_-]+", " ", text.strip().lower())
    if re.fullmatch(r"-?\d+(?:\.\d+)?", s):
        return float(s)
    w = s.split(" ")
    if w[0] in TENS and (len(w) == 1 or len(w) == 2 and 0 < ONES.get(w[1], 0) < 10):
        return float(TENS[w[0]] + (ONES[w[1]] if len(w) == 2 else 0))
    return float(ONES[s]) if s in ONES else None


def facts(text: str) -> tuple[list[float], list[str]]:
    """The numbers in a text, sorted, and the other words in order."""
    found = sorted(n for m in _NUMBER.findall(text) if (n := number(m)) is not None)
    return found, [w for w in _WORD.findall(_NUMBER.sub(" ", text.lower())) if w not in _FILLER]


def words_of(name: str) -> list[str]:
    """Words of a name in any style: camel case, hyphens, underscores, brackets."""
    return [w for w in _WORD.findall(_SPLIT.sub(" ", name).lower()) if w not in _FILLER]


def record(name: str | None, comment: str | None, attributes: list | None) -> tuple[list[str], bool, list[float], list[str], list[float], list[str]]:
    """(name words, whether a long number stands beside them, numbers told, words told, attribute numbers, other attribute values)."""
    told, said = facts(comment) if comment else ([], [])
    numbers, values = [], []
    for v in attributes or []:
        if v is None or not v.strip():
            continue
        n = number(v)
        plain = re.sub(r"[\s_-]+", " ", v.strip().lower())
        plain = {"yes": "true", "1": "true", "1.0": "true", "no": "false", "0": "false", "0.0": "false"}.get(plain, plain)
        if n is not None and n > 1:
            numbers.append(n)
        else:
            values.append(plain)
    return words_of(name or ""), bool(re.search(r"\d{3}", name or "")), told, list(dict.fromkeys(said)), sorted(set(numbers)), sorted(set(values))


def near_words(word: str) -> set[str]:
    """The word and each form of it with one letter left out."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Words:
    """Plain spellings: rare words are led to frequent ones that differ by one slip, short cuts to what they begin."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.memory = counts, {}
        self.forms: dict[str, list[str]] = {}
        self.starts: dict[str, list[str]] = {}
        for w in counts:
            if len(w) >= 4:
                for f in near_words(w):
                    self.forms.setdefault(f, []).append(w)
            for k in range(2, min(len(w), 7)):
                self.starts.setdefault(w[:k], []).append(w)

    def plain(self, w: str) -> str:
        if w not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[w] = self._find(w)
        return self.memory[w]

    def _find(self, w: str) -> str:
        own = self.counts.get(w, 0)
        if len(w) <= 6:
            longer = [x for x in self.starts.get(w, ()) if len(x) >= len(w) + 2 and self.counts[x] >= 5 * own]
            if longer and len(w) >= 3:
                return max(longer, key=lambda x: (self.counts[x], x))
        if len(w) >= 4:
            close = {x for f in near_words(w) for x in self.forms.get(f, ()) if x != w and self.counts[x] >= 15 * max(own, 1) and _one_slip(w, x)}
            if close:
                return max(close, key=lambda x: (self.counts[x], x))
        return w


def _one_slip(a: str, b: str) -> bool:
    """One letter put in, left out, changed or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


class Lexicon:
    """What the whole table says of words: how often names and descriptions use them, and which only introduce serial numbers."""

    def __init__(self, used: list[tuple[str, int, int, int]]):
        self.names = {w: n for w, n, _, _ in used if n}
        self.place = {w: i for i, (w, _, _, _) in enumerate(used)}
        total = max(1, sum(n + c for _, n, c, _ in used))
        self.idf = np.array([np.log(1 + total / (1 + n + c)) for _, n, c, _ in used] or [1.0], np.float32)
        self.serial = {w for w, n, _, s in used if n >= 5 and s >= 0.9 * n}
        self.naming = {w for w, n, c, _ in used if n > 0.3 * (n + c)} - self.serial
        self.words = Words(self.names)

    def name(self, words: list[str], coded: bool, said: list[str]) -> tuple[str, ...]:
        """The plain words of a record's name, sorted; of a nameless one those words of its description that names are made of."""
        own = [w for w in words if not coded or w not in self.serial]
        plain = {self.words.plain(w) for w in own} if own else {w for w in said if w in self.naming}
        return tuple(sorted(plain))

    def rarity(self, word: str) -> float:
        i = self.place.get(word)
        return float(self.idf.max() if i is None else self.idf[i])


def seeded(token: str, dim: int = DIM) -> np.ndarray:
    """A token's starting vector: the same in every worker."""
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(token)).standard_normal(dim).astype(np.float32)


def train(pairs: list[tuple[str, str, int]], dim: int = DIM, steps: int = 600, batch: int = 4096, negatives: int = 5, rate: float = 0.15) -> dict[str, np.ndarray]:
    """Skip-gram vectors with negative samples, from how often words met on the walks; a word's vector is the sum of its two roles."""
    pairs = telling(pairs)
    words = sorted({w for a, b, _ in pairs for w in (a, b)})
    if not words:
        return {}
    at = {w: i for i, w in enumerate(words)}
    rng = np.random.default_rng(7)
    a = np.array([at[x] for x, _, _ in pairs])
    b = np.array([at[y] for _, y, _ in pairs])
    n = np.array([k for _, _, k in pairs], dtype=np.float64)
    noise = np.bincount(b, weights=n, minlength=len(words)) ** 0.75
    noise, chance = np.cumsum(noise / noise.sum()), np.cumsum(n / n.sum())
    left = np.stack([seeded(w, dim) for w in words]) * (0.5 / np.sqrt(dim))
    right = np.zeros_like(left)
    slow = [np.full(len(words), 1e-6, np.float32), np.full(len(words), 1e-6, np.float32)]

    def move(table: np.ndarray, scale: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        """One step per word for all its samples, shortened by what it has moved so far."""
        order = np.argsort(rows, kind="stable")
        own, first = np.unique(rows[order], return_index=True)
        total = np.add.reduceat(grad[order], first, axis=0)
        scale[own] += (total**2).mean(1)
        table[own] += rate * total / np.sqrt(scale[own])[:, None]

    for _ in range(steps):
        k = np.searchsorted(chance, rng.random(batch)).clip(0, len(n) - 1)
        i, pos = a[k], b[k]
        j = np.concatenate([pos[:, None], np.searchsorted(noise, rng.random((batch, negatives))).clip(0, len(words) - 1)], 1)
        x, y = left[i], right[j]
        g = -1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", x, y), -30, 30)))
        g[:, 0] += 1
        move(left, slow[0], i, np.einsum("bk,bkd->bd", g, y))
        move(right, slow[1], j.ravel(), (g[:, :, None] * x[:, None, :]).reshape(-1, dim))
    return dict(zip(words, spread(left + right, np.bincount(a, weights=n, minlength=len(words)))))


def telling(pairs: list[tuple[str, str, int]], times: float = 2.0) -> list[tuple[str, str, int]]:
    """Pairs that met more than ``times`` as often as their words' own frequencies make them meet by chance."""
    left, right = Counter(), Counter()
    for a, b, n in pairs:
        left[a] += n
        right[b] += n
    total = sum(left.values())
    return [(a, b, n) for a, b, n in pairs if n * total > times * left[a] * right[b]]


def spread(vectors: np.ndarray, counts: np.ndarray, directions: int = 2) -> np.ndarray:
    """Unit vectors without what all of them share: the mean and the main directions of the most frequent words."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if len(unit) < 4 * directions + 2:
        return unit
    common = unit[np.argsort(-counts, kind="stable")[:1000]]
    mean = common.mean(0)
    main = np.linalg.svd(common - mean, full_matrices=False)[2][:directions]
    out = unit - mean
    out = out - (out @ main.T) @ main
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


_RECORD = "track string, tax string, id string, words array<string>, coded boolean, told array<double>, said array<string>, numbers array<double>, others array<string>"
_RECORD_SCHEMA = pa.schema([("track", pa.string()), ("tax", pa.string()), ("id", pa.string()), ("words", pa.list_(pa.string())), ("coded", pa.bool_()), ("told", pa.list_(pa.float64())), ("said", pa.list_(pa.string())), ("numbers", pa.list_(pa.float64())), ("others", pa.list_(pa.string()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)


def _parsed(records: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(t, x, i, *record(n, m, a)) for t, x, i, n, m, a in zip(*[b.column(k).to_pylist() for k in range(6)])], _RECORD_SCHEMA)

    return records.select("track", "tax", "id", "name", "comment", F.map_values("attributes").alias("attributes")).mapInArrow(run, _RECORD)


def _lexicon(rows: DataFrame) -> list[tuple[str, int, int, int]]:
    """(word, uses in names, uses in descriptions, uses in names with a long number) of the most frequent words."""
    named = rows.select(F.explode("words").alias("w"), F.lit(1).alias("n"), F.lit(0).alias("c"), F.col("coded").cast("int").alias("s"))
    told = rows.select(F.explode("said").alias("w"), F.lit(0).alias("n"), F.lit(1).alias("c"), F.lit(0).alias("s"))
    used = named.unionByName(told).groupBy("w").agg(*[F.sum(k).alias(k) for k in "ncs"])
    return [tuple(r) for r in used.orderBy(F.desc(F.col("n") + F.col("c")), "w").limit(VOCABULARY).collect()]


def _walk_pairs(rows: DataFrame, know, walks: int, length: int) -> DataFrame:
    """``a``, ``b``, ``n``: how often words meet on random walks over records, their attributes and their tokens.

    A walk goes from a record by one of its attributes (name, description, attribute values) to a
    token there, the rarer the likelier, from the token to a record of the same track that has it,
    too, and so on. Where two records of a walk show different words, these
    meet. A task walks over one stretch of a track at a time; each round of walks cuts
    large tracks into other stretches, by another hash, so any two records can meet.
    """

    def walk(records: list[tuple], lexicon: Lexicon, met: Counter, rng: np.random.Generator) -> None:
        shown = [set(lexicon.name(w, c, s)) for w, c, _, s, _, _ in records]
        if not records:
            return
        # the attributes of a record, name, description and values, with their tokens
        place: dict[str, int] = {}
        tokens = [[place.setdefault(y, len(place)) for y in {*[f"w:{x}" for x in shown[k]], *[f"f:{x:g}" for x in told], *[f"n:{x:g}" for x in numbers], *[f"v:{x}" for x in others]}] for k, (_, _, told, _, numbers, others) in enumerate(records)]
        size = np.array([len(x) for x in tokens])
        flat = np.array([y for x in tokens for y in sorted(x)], np.int64)
        owner = np.repeat(np.arange(len(tokens)), size)
        holders, many = owner[np.argsort(flat, kind="stable")], np.bincount(flat, minlength=len(place))
        first = np.cumsum(many) - many
        weight = np.cumsum(np.append(0.0, np.where(many[flat] > 1, np.maximum(many[flat] - 1.0, 1) ** -1.5, 0.0)))
        low, high = weight[np.cumsum(size) - size], weight[np.cumsum(size)]
        at, seen = np.arange(len(records)), []
        for u, v in rng.random((length, 2, len(records))):
            seen.append(at)
            on = np.flatnonzero((at >= 0) & (high[at] > low[at]))
            k = np.minimum(np.searchsorted(weight, low[at[on]] + u[on] * (high[at[on]] - low[at[on]]), side="right") - 1, len(flat) - 1)
            at = np.full(len(records), -1)
            at[on] = holders[first[flat[k]] + (v[on] * many[flat[k]]).astype(np.int64)]
        for d in (1, 2):
            i, j = np.concatenate(seen[:-d]), np.concatenate(seen[d:])
            ok = (i >= 0) & (j >= 0) & (i != j)
            pair, times = np.unique(np.minimum(i[ok], j[ok]) * len(records) + np.maximum(i[ok], j[ok]), return_counts=True)
            for p, q, n in zip((pair // len(records)).tolist(), (pair % len(records)).tolist(), times.tolist()):
                left, right = shown[p] - shown[q], shown[q] - shown[p]
                for x in left:
                    for y in right:
                        met[x, y] += n
                        met[y, x] += n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rng, met, now, some = Lexicon(know.value), np.random.default_rng(11), Counter(), None, []
        for b in batches:
            for key, *r in zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in ("stretch", "words", "coded", "told", "said", "numbers", "others")]):
                if key != now:
                    walk(some, lexicon, met, rng)
                    now, some = key, []
                some.append(tuple(r))
            if len(met) > 500_000:
                yield _met(met)
                met = Counter()
        walk(some, lexicon, met, rng)
        yield _met(met)

    rounds = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(walks))))
    cut = rounds.withColumn("stretch", F.xxhash64("track", "round", F.pmod(F.xxhash64("id", "round"), F.ceil(F.col("n") / STRETCH))))
    walked = cut.repartition(tasks(rows.sparkSession), "stretch").sortWithinPartitions("stretch", "id").mapInArrow(run, "a string, b string, n bigint")
    return walked.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _met(met: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in met], pa.string()), pa.array([k[1] for k in met], pa.string()), pa.array(list(met.values()), pa.int64())], names=["a", "b", "n"])


_SHOWN = "track string, tax string, id string, n bigint, name string, size int, vec array<float>, told string, known int, said array<int>, numbers array<double>, others array<bigint>"
_SHOWN_SCHEMA = pa.schema([("track", pa.string()), ("tax", pa.string()), ("id", pa.string()), ("n", pa.int64()), ("name", pa.string()), ("size", pa.int32()), ("vec", pa.list_(pa.float32())), ("told", pa.string()), ("known", pa.int32()), ("said", pa.list_(pa.int32())), ("numbers", pa.list_(pa.float64())), ("others", pa.list_(pa.int64()))])


def name_vector(name: tuple[str, ...], lexicon: Lexicon, vectors: dict[str, np.ndarray], cache: dict[str, np.ndarray]) -> np.ndarray | None:
    """Unit vector of a name: its words' trained vectors, each kept apart by a share of its own, by rarity."""
    if not name:
        return None
    out = np.zeros(DIM, np.float32)
    for w in name:
        if w not in cache:
            if len(cache) > 100_000:
                cache.clear()
            own = seeded(w) / np.sqrt(DIM)
            v = 0.9 * vectors[w] + 0.1 * own if w in vectors else own
            cache[w] = lexicon.rarity(w) * v / max(1e-9, float(np.linalg.norm(v)))
        out += cache[w]
    return out / max(1e-9, float(np.linalg.norm(out)))


def _shown(rows: DataFrame, know, learned) -> DataFrame:
    """Each record once with its name, the name's vector, and its other evidence in a form that compares fast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lexicon, vectors, cache = Lexicon(know.value), learned.value, {}
        for b in batches:
            out = []
            for track, tax, id, words, coded, told, said, numbers, others, n in zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in (*_RECORD_SCHEMA.names, "n")]):
                name = lexicon.name(words, coded, said)
                vec = name_vector(name, lexicon, vectors, cache)
                context = [lexicon.place[w] for w in said if w in lexicon.place and w not in lexicon.naming]
                out.append((track, tax, id, n, " ".join(name), len(name), vec, ",".join(f"{x:g}" for x in told), len(told), context, numbers, [xxhash.xxh64_intdigest(x) - 2**63 for x in others]))
            yield _batch(out, _SHOWN_SCHEMA)

    return rows.mapInArrow(run, _SHOWN)


def tables_of(n: int) -> tuple[int, int]:
    """(bits of a code, number of tables) for ``n`` records: blocks stay about ``BLOCK`` records, and names of cosine ``NEAR`` share a table with chance ``MEET`` at any size."""
    bits = max(2, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    p = (1 - np.arccos(NEAR) / np.pi) ** bits
    return bits, int(np.ceil(np.log(1 - MEET) / np.log(1 - p)))


def codes(vectors: np.ndarray, bits: int, table: int) -> np.ndarray:
    """Codes of one table: on which side of each of its random hyperplanes a vector lies."""
    planes = np.random.default_rng([17, table]).standard_normal((vectors.shape[1], bits)).astype(np.float32)
    return ((vectors @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))


#: Boards of blocks: told numbers, pairs of attribute numbers, then one for each hyperplane table of names.
_TOLD, _NUMBERS, _NAMES = 0, 1, 2


def _coded(rows: DataFrame, tables: int | None = None) -> DataFrame:
    """Each record once for each block it belongs to: ``board``, ``code``.

    Records meet in a block of a hyperplane table over their names' vectors (at most ``tables`` of
    them), if they tell the same numbers, or if they have two attribute numbers in common.
    """
    schema = pa.schema([*_SHOWN_SCHEMA, ("board", pa.int32()), ("code", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        key = lambda x: xxhash.xxh64_intdigest(x) - 2**63
        for b in batches:
            at: list[np.ndarray] = []
            board: list[np.ndarray] = []
            code: list[np.ndarray] = []

            def add(rows_: list[int] | np.ndarray, board_: int, codes_: list[int] | np.ndarray) -> None:
                at.append(np.asarray(rows_, np.int64))
                board.append(np.full(len(rows_), board_, np.int32))
                code.append(np.asarray(codes_, np.int64))

            told, numbers = b.column(b.schema.get_field_index("told")).to_pylist(), b.column(b.schema.get_field_index("numbers")).to_pylist()
            some = [i for i, x in enumerate(told) if x]
            add(some, _TOLD, [key(told[i]) for i in some])
            two = [(i, key(f"{x:g} {y:g}")) for i, v in enumerate(numbers) for k, x in enumerate(v) for y in v[k + 1 :]]
            add([i for i, _ in two], _NUMBERS, [c for _, c in two])
            n = b.column(b.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
            named = np.flatnonzero(b.column(b.schema.get_field_index("size")).to_numpy(zero_copy_only=False) > 0)
            vec = b.column(b.schema.get_field_index("vec")).take(pa.array(named)).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            for size in np.unique(n[named]):
                own = n[named] == size
                bits, count = tables_of(int(size))
                for t in range(count if tables is None else min(count, tables)):
                    add(named[own], _NAMES + t, codes(vec[own], bits, t))
            order, boards, codes_ = np.concatenate(at), np.concatenate(board), np.concatenate(code)
            for k in range(0, len(order), 20_000):
                part = b.take(pa.array(order[k : k + 20_000]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(boards[k : k + 20_000]), pa.array(codes_[k : k + 20_000])], schema=schema)

    return rows.select(*_SHOWN_SCHEMA.names).mapInArrow(run, _SHOWN + ", board int, code bigint")


def _cells(coded: DataFrame, cell: int) -> DataFrame:
    """Adds ``ci``, ``cj``, ``part``: blocks beyond ``cell`` rows are cut into parts, and each pair of parts is a cell of its own.

    So every pair of a block is compared once, and no task holds more than two parts.
    """
    keys = ["track", "board", "code"]
    large = coded.groupBy(*keys).count().filter(F.col("count") > cell).select(*keys, F.ceil(F.col("count") / (cell / 2)).cast("int").alias("parts"))
    known = coded.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    known = known.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return known.withColumn("ci", F.least("part", "other")).withColumn("cj", F.greatest("part", "other")).drop("other", "parts")


class Block:
    """Columns of rows sorted by block, as arrays, and the evidence of pairs of them."""

    def __init__(self, t: pa.Table, idf: np.ndarray):
        get = lambda k: t.column(k).combine_chunks()
        self.idf = np.append(idf, np.float32(0))
        self.block, self.part = get("block").to_numpy(), get("part").to_numpy()
        self.within = get("ci").to_numpy() == get("cj").to_numpy()
        self.board, self.size, self.known = get("board").to_numpy(), get("size").to_numpy(), get("known").to_numpy()
        self.id, self.tax, self.told = (np.array(get(k).to_pylist(), object) for k in ("id", "tax", "told"))
        self.place = {k: np.unique(np.array(get(k).to_pylist(), str), return_inverse=True)[1] for k in ("track", "tax", "name", "told", "id")}
        self.vec = np.zeros((len(self.id), DIM), np.float32)
        has = self.size > 0
        self.vec[has] = get("vec").take(pa.array(np.flatnonzero(has))).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
        self.numbers, self.others, self.said = self._padded(get("numbers"), np.nan, float), self._padded(get("others"), 0, np.int64), self._padded(get("said"), -1, np.int64)
        self.count = {"numbers": (~np.isnan(self.numbers)).sum(1), "others": (self.others != 0).sum(1)}

    @staticmethod
    def _padded(lists: pa.Array, empty: float, kind: type) -> np.ndarray:
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.full((len(lists), max(1, int(sizes.max(initial=0)))), empty, kind)
        row = np.repeat(np.arange(len(lists)), sizes)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def pairs(self, most: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the rows of all pairs to compare, in bounded portions."""
        ends = np.searchsorted(self.block, self.block, side="right")
        left = ends - np.arange(len(ends)) - 1
        begin = 0
        while begin < len(left):
            done = np.cumsum(left[begin:])
            stop = begin + max(1, int(np.searchsorted(done, most, side="right")))
            n = left[begin:stop]
            i = np.repeat(np.arange(begin, stop), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            ok = (self.place["tax"][i] != self.place["tax"][j]) & (self.place["track"][i] == self.place["track"][j]) & (self.board[i] == self.board[j]) & (self.within[i] | (self.part[i] != self.part[j]))
            ok &= (self.board[i] <= _NAMES) | (self.place["name"][i] != self.place["name"][j])  # equal names have met in the first table
            yield i[ok], j[ok]
            begin = stop

    def evidence(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns of view X: names and attributes, columns of view Z: descriptions, 1 if told numbers agree, -1 if they differ, else 0)."""
        named = (self.size[i] > 0) & (self.size[j] > 0)
        equal = named & (self.place["name"][i] == self.place["name"][j])
        cosine = np.where(named, np.einsum("nd,nd->n", self.vec[i], self.vec[j]), 0.0)
        short = named & (np.minimum(self.size[i], self.size[j]) < 2)
        shared = (self.numbers[i][:, :, None] == self.numbers[j][:, None, :]).any(2).sum(1)
        clash = (self.count["numbers"][i] > 0) & (self.count["numbers"][j] > 0) & (shared == 0)
        both = (self.others[i][:, :, None] == self.others[j][:, None, :]).any(2) & (self.others[i] != 0)
        union = self.count["others"][i] + self.count["others"][j] - both.sum(1)
        alike = np.where(union > 0, both.sum(1) / np.maximum(union, 1), 0.0)
        unlike = (self.count["others"][i] > 0) & (self.count["others"][j] > 0) & (both.sum(1) == 0)
        x = np.stack([named & (cosine < 0.4), *[named & (cosine >= c) for c in STEPS], equal, short, shared >= 1, shared >= 2, clash, alike, unlike], 1).astype(float)
        si, sj = self.said[i], self.said[j]
        hit = (si[:, :, None] == sj[:, None, :]).any(2) & (si >= 0)
        weight = np.where(hit, self.idf[si], 0).sum(1)
        least = np.minimum(np.where(si >= 0, self.idf[si], 0).sum(1), np.where(sj >= 0, self.idf[sj], 0).sum(1))
        k = np.minimum(self.known[i], self.known[j])
        z = np.stack([np.where(least > 0, weight / np.maximum(least, 1e-6), 0), np.minimum(weight, 20) / 10, k >= 2], 1).astype(float)
        told = np.where(k == 0, 0, np.where(self.place["told"][i] == self.place["told"][j], 1, -1))
        return x, z, told


#: Lower ends of the steps of a cosine's calibration.
STEPS = (0.5, 0.6, 0.7, 0.8, 0.9)
_X = ["far", *[f"cos{c}" for c in STEPS], "equal", "short", "shared1", "shared2", "clash", "alike", "unlike"]
#: Columns whose weight has a known sign: more of it can't speak the other way.
_OF_NAMES = {"far", *[f"cos{c}" for c in STEPS], "equal", "short"}
_RISING, _FALLING = {*[f"cos{c}" for c in STEPS], "equal", "shared1", "shared2", "alike"}, {"far", "short", "clash", "unlike"}


def _compared(spark: SparkSession, cells: DataFrame, idf, weights: dict | None, accept: float = 0.5, some: int = 1) -> DataFrame:
    """Pairs of records from different sources that share a cell: those accepted, with their confidence; without weights one in ``some``, with its evidence."""
    sample = weights is None
    kind = "told int, board int, a string, b string, " + ", ".join(f"x{k} double" for k in range(len(_X))) + ", z0 double, z1 double, z2 double" if sample else "a string, b string, tax_a string, tax_b string, told_a string, told_b string, confidence double"

    def rate(b: Block) -> Iterator[pa.RecordBatch]:
        for i, j in b.pairs():
            if sample and some > 1:
                keep = (b.place["id"][i] * 31 + b.place["id"][j] * 17) % some == 0
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            x, z, told = b.evidence(i, j)
            swap = b.id[i] > b.id[j]
            p, q = np.where(swap, j, i), np.where(swap, i, j)
            if sample:
                yield pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(b.board[i].astype(np.int32)), pa.array(b.id[p], pa.string()), pa.array(b.id[q], pa.string()), *[pa.array(x[:, k]) for k in range(x.shape[1])], *[pa.array(z[:, k]) for k in range(3)]], names=[f.split()[0] for f in kind.split(", ")])
                continue
            c = confidence(weights, x, z, told)
            ok = c >= accept
            p, q, c = p[ok], q[ok], c[ok]
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.string()) for v in (b.id[p], b.id[q], b.tax[p], b.tax[q], b.told[p], b.told[q])], pa.array(c)], names=[f.split()[0] for f in kind.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 20_000:
                continue
            t = pa.Table.from_batches(held)
            block = t.column("block").to_numpy()
            end = int(np.searchsorted(block, block[-1]))  # the last block may go on
            if end:
                yield from rate(Block(t.slice(0, end), idf.value))
            held = t.slice(end).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from rate(Block(t, idf.value))

    rows = cells.withColumn("block", F.xxhash64("track", "board", "code", "ci", "cj")).drop("n")
    return rows.repartition(tasks(spark), "block").sortWithinPartitions("block").mapInArrow(run, kind)


def logistic(x: np.ndarray, y: np.ndarray, names: list[str], ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the constant, by Newton steps; a weight of the wrong sign is taken out and the rest fitted again."""
    out = np.zeros(len(names) + 1)
    use = list(range(len(names)))
    while True:
        a = np.concatenate([x[:, use], np.ones((len(x), 1))], 1)
        w = np.zeros(a.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
            w -= np.linalg.solve(h, a.T @ (p - y) + ridge * np.append(w[:-1], 0.0))
        wrong = [k for k, v in zip(use, w) if names[k] in _RISING and v < 0 or names[k] in _FALLING and v > 0]
        if not wrong:
            out[use], out[-1] = w[:-1], w[-1]
            return out
        use = [k for k in use if k not in wrong]


def calibrate(sample: DataFrame) -> dict:
    """Weights that turn cosines and other evidence into a confidence, from a bounded sample of compared pairs, hopeless ones included.

    Each view is calibrated by the other. Names and attributes: on pairs that both tell numbers, by
    whether these agree; once on pairs that met by name, whose attributes are as they come, and once
    on pairs that met by attribute numbers, whose names are. Descriptions: on pairs that tell the same
    numbers, by whether names or attributes plainly agree or plainly don't.
    """
    once = sample.dropDuplicates(["a", "b"])
    columns, at = [f"x{k}" for k in range(len(_X))], {k: i for i, k in enumerate(_X)}
    named = np.array([k in _OF_NAMES for k in _X])

    def taken(condition: str):
        return once.filter(condition).orderBy(F.xxhash64("a", "b")).limit(MAX_LABELLED).toPandas()

    def fit(rows, use: np.ndarray, prior: list[float]) -> np.ndarray:
        x, y = rows[columns].to_numpy(float) * use, (rows["told"] == 1).to_numpy(float)
        return logistic(x, y, _X) if len(rows) >= 50 and 0 < y.mean() < 1 else np.array(prior) * np.append(use, True)

    by_name, by_number, same = taken(f"told <> 0 and board >= {_NAMES}"), taken(f"told <> 0 and board = {_NUMBERS}"), taken("told = 1")
    w = fit(by_name, np.ones(len(_X), bool), [0, 0.3, 0.5, 0.7, 0.7, 0.5, 0.5, -1.0, 1.5, 1.5, -2.0, 0.5, -1.0, -2.0])
    v = fit(by_number, named, [-1.0, 0.5, 1.0, 1.0, 1.0, 0.5, 0.5, -1.0, 0, 0, 0, 0, 0, -2.0])
    x = by_name[columns].to_numpy(float)
    sure, agree = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), (by_name["told"] == 1).to_numpy(float)
    high, low = agree[sure > 0.9], agree[sure < 0.1]
    m, u = (high.sum() + 1.0) / (len(high) + 1.05), (low.sum() + 1.0) / (len(low) + 100.0)
    x, z = same[columns].to_numpy(float), same[["z0", "z1", "z2"]].to_numpy(float)
    yes = (x[:, at["equal"]] > 0) & (x[:, at["short"]] == 0) | (x[:, at["shared2"]] > 0)
    no = (x[:, at["far"]] > 0) & (x[:, at["shared1"]] == 0)
    decided = yes | no
    f = logistic(z[decided], yes[decided].astype(float), ["share", "weight", "several"]) if decided.sum() >= 50 and yes.any() and no.any() else np.array([2.0, 2.0, 1.0, -2.0])
    return {"name": w, "number": v, "told": f, "both": np.where(named, v[:-1], w[:-1]), "differ": float(np.log((1 - m) / (1 - u)))}


def confidence(k: dict, x: np.ndarray, z: np.ndarray, told: np.ndarray) -> np.ndarray:
    """0 to 1. Evidence of the views adds up; what a pair does not show adds nothing.

    Where told numbers agree, that of descriptions, names and attributes; else the better of what is
    calibrated for pairs that meet by name and for those that meet by attribute numbers.
    """
    at = {c: i for i, c in enumerate(_X)}
    by_name = np.where(x[:, at[f"cos{STEPS[0]}"]] > 0, x @ k["name"][:-1] + k["name"][-1], -30.0)
    by_number = np.where(x[:, at["shared2"]] > 0, x @ k["number"][:-1] + k["number"][-1], -30.0)
    other = np.maximum(by_name, by_number) + np.where(told == -1, k["differ"], 0.0)
    score = np.where(told == 1, z @ k["told"][:-1] + k["told"][-1] + x @ k["both"], other)
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def match_entities(spark: SparkSession, nodes: DataFrame, groups: DataFrame, accept: float = 0.5, walks: int = 4, length: int = 4, cell: int = CELL, trained: bool = True) -> DataFrame:
    """``node_id_a``, ``node_id_b``, ``confidence``: records of different sources of one track that mean the same, the smaller id first.

    ``nodes`` has ``tax``, ``node_id``, ``name``, ``comment``, ``attributes``, ``loaded_at``;
    ``groups`` gives each ``tax`` its ``track``. Of repeated rows of an id the latest counts. Null
    or blank names, descriptions and attributes are missing evidence: a record without any is
    matched with nothing. Records whose source has no track, or the only source of its track,
    match nothing. A record matches at most one record of another source: pairs are taken by falling
    confidence, of equal ones the smaller ids first, as long as both records are free.

    Random walks over records, attributes and tokens give the counts on which skip-gram vectors of
    words are trained. Records of a track meet in blocks of several hyperplane tables over their
    names' vectors, of equal told numbers, and of two shared attribute numbers; they are compared
    exactly, and their cosine and other evidence is calibrated to a confidence on a bounded
    sample. ``trained`` False leaves the training out, to show what it gives.
    """
    scratch = Scratch(spark, "matching")
    track = groups.filter(nonblank(F.col("track"))).groupBy("tax").agg(F.min("track").alias("track"))
    several = track.groupBy("track").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("track")
    wanted = track.join(several, "track")
    latest = nodes.filter("node_id is not null and tax is not null").join(wanted.select("tax"), "tax", "left_semi").groupBy("tax", F.col("node_id").alias("id")).agg(*[F.max_by(c, F.struct("loaded_at", F.xxhash64("name", "comment"))).alias(c) for c in ("name", "comment", "attributes")])
    parsed, n = scratch.save(_parsed(lookup(latest, wanted, "tax", "inner")))
    empty = spark.createDataFrame([], "node_id_a string, node_id_b string, confidence double")
    if not n["rows"]:
        return empty
    rows = lookup(parsed, parsed.groupBy("track").agg(F.count(F.lit(1)).alias("n")), "track", "inner", n["rows"])
    know = spark.sparkContext.broadcast(_lexicon(parsed))
    met = _walk_pairs(rows, know, walks, length)
    learned = spark.sparkContext.broadcast(train([tuple(r) for r in met.orderBy(F.desc("n"), "a", "b").limit(MAX_TRAINED_PAIRS).collect()]) if trained else {})
    idf = spark.sparkContext.broadcast(Lexicon(know.value).idf)
    shown, _ = scratch.save(_shown(rows, know, learned))
    some = max(1, n["rows"] // MAX_LABELLED)
    part = _coded(shown, 1).filter(F.pmod(F.xxhash64("track", "board", "code"), F.lit(some)) == 0)
    weights = calibrate(scratch.save(_compared(spark, _cells(part, cell), idf, None))[0])
    found = _compared(spark, _cells(_coded(shown), cell), idf, weights, accept).groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("tax_a", "tax_b", "told_a", "told_b", "confidence")])
    rated, _ = scratch.save(found)
    return _consistent(_one_to_one(spark, rated)).select(F.col("a").alias("node_id_a"), F.col("b").alias("node_id_b"), "confidence")


def _one_to_one(spark: SparkSession, rated: DataFrame) -> DataFrame:
    """Mutually best partners of each two sources again and again, until no pair of two free records is left."""
    turned = F.col("tax_a") > F.col("tax_b")
    pair = F.to_json(F.array(F.least("tax_a", "tax_b"), F.greatest("tax_a", "tax_b"))).alias("pair")
    ends = F.when(turned, F.col("b")).otherwise(F.col("a")).alias("source_id"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target_id")
    taken = greedy_injective(spark, rated.select(pair, *ends, F.col("confidence").alias("score")))
    return rated.join(taken.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")), ["a", "b"], "left_semi")


def _consistent(rated: DataFrame) -> DataFrame:
    """A record that tells no numbers can't mean two things: of partners that tell different numbers, those with the most confidence stay."""
    for one, key, own in (("a", "told_b", "told_a"), ("b", "told_a", "told_b")):
        weight = F.sum("confidence").over(Window.partitionBy(one, key))
        best = F.max(F.when((F.col(own) == "") & (F.col(key) != ""), F.struct("w", F.col(key)))).over(Window.partitionBy(one))
        rated = rated.withColumn("w", weight).withColumn("best", best).filter(f"{own} <> '' or {key} = '' or best.{key} = {key}").drop("w", "best")
    return rated
