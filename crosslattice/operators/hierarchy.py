"""Parent-child links to full hierarchies: paths, depths, roots, descendants, and what hangs on loops."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslattice.runtime import Scratch, lookup, tasks

#: Trees of at most so many rows (nodes and links) are peeled within one task; larger ones in distributed rounds.
MAX_LOCAL = 1_000_000
_BATCH = 20_000


class Tree:
    """One graph of bounded size, peeled from its leaves.

    ``units`` are its nodes in an order in which each follows all its children: first what leaf peeling
    takes, then the loops it leaves and what lies above them, a loop being one unit. Lists of descendants
    and their sizes go up in that order; depths, roots and paths come down in the reverse one.
    """

    def __init__(self, names: list[str], links: Iterable[tuple[str, str]]):
        self.names = sorted(set(names))
        at = {x: i for i, x in enumerate(self.names)}
        n = len(self.names)
        self.parents: list[list[int]] = [[] for _ in range(n)]
        self.children: list[list[int]] = [[] for _ in range(n)]
        loops, declared, known = set(), set(), set()
        for c, p in links:
            if c in at:
                declared.add(at[c])
                if p in at:
                    known.add((at[c], at[p]))
        for c, p in known:
            if c == p:
                loops.add(c)
            self.parents[c].append(p)
            self.children[p].append(c)
        peeled = self._peel()
        done = set(peeled)
        self.units = [[v] for v in peeled] + self._components([v for v in range(n) if v not in done])[::-1]
        self.unit = [0] * n
        for u, members in enumerate(self.units):
            for v in members:
                self.unit[v] = u
        self.cyclic = {v for members in self.units if len(members) > 1 for v in members} | loops
        self.depth: list[int | None] = [None] * n
        self.chosen: list[int | None] = [None] * n
        self.root: list[int | None] = [None] * n
        self.reached = [False] * n
        for members in reversed(self.units):
            if any(v not in declared or any(self.reached[p] for p in self.parents[v]) for v in members):
                for v in members:
                    self.reached[v] = True
            v = members[0]
            if v in self.cyclic or any(self.depth[p] is None for p in self.parents[v]):
                continue
            if self.parents[v]:
                best = min(self.parents[v], key=lambda p: (-self.depth[p], p))
                self.depth[v], self.chosen[v], self.root[v] = self.depth[best] + 1, best, self.root[best]
            else:
                self.depth[v], self.root[v] = 0, v

    def _peel(self) -> list[int]:
        """Nodes that leaf peeling takes, each behind its children; those on or above loops stay."""
        left = [len(x) for x in self.children]
        order = [v for v, k in enumerate(left) if not k]
        for v in order:
            for p in self.parents[v]:
                left[p] -= 1
                if not left[p]:
                    order.append(p)
        return order

    def _components(self, core: list[int]) -> list[list[int]]:
        """Strong components of what peeling left, ancestors first: Tarjan's algorithm, without recursion."""
        inside, index, low, on, stack, out, count = set(core), {}, {}, set(), [], [], 0
        for start in core:
            if start in index:
                continue
            work = [(start, iter(self.parents[start]))]
            index[start] = low[start] = count
            count += 1
            stack.append(start)
            on.add(start)
            while work:
                v, it = work[-1]
                for p in it:
                    if p not in inside:
                        continue
                    if p not in index:
                        index[p] = low[p] = count
                        count += 1
                        stack.append(p)
                        on.add(p)
                        work.append((p, iter(self.parents[p])))
                        break
                    if p in on:
                        low[v] = min(low[v], index[p])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        group = []
                        while not group or group[-1] != v:
                            w = stack.pop()
                            on.discard(w)
                            group.append(w)
                        out.append(group)
        return out

    def state(self, v: int) -> str | None:
        return "cycle" if v in self.cyclic else "below_cycle" if self.depth[v] is None else None

    def path(self, v: int) -> list[str]:
        out = []
        while v is not None:
            out.append(self.names[v])
            v = self.chosen[v]
        return out[::-1]

    def _numbered(self) -> tuple[list[int], list[int]]:
        """(nodes by number, first number of each unit): along a forest, so that what lies below a node is one stretch, or a few."""
        below: list[list[int]] = [[] for _ in self.units]
        tops = []
        for u, members in enumerate(self.units):
            above = min((self.unit[p] for v in members for p in self.parents[v] if self.unit[p] != u), default=None)
            (tops if above is None else below[above]).append(u)
        order, first = [], [0] * len(self.units)
        while tops:
            u = tops.pop()
            first[u] = len(order)
            order += self.units[u]
            tops += below[u]
        return order, first

    def lists(self) -> Iterator[tuple[list[int], list[tuple[int, int]], list[int]]]:
        """(nodes of a unit, stretches of numbers below it, nodes by number), sent up from unit to unit.

        A node on a loop is below itself. A list is dropped once all units above have it.
        """
        order, first = self._numbered()
        above = [{self.unit[p] for v in members for p in self.parents[v]} - {u} for u, members in enumerate(self.units)]
        got: dict[int, list[tuple[int, int]]] = {}
        for u, members in enumerate(self.units):
            mine: list[tuple[int, int]] = []
            for lo, hi in sorted(got.pop(u, [])):
                if mine and lo <= mine[-1][1]:
                    if hi > mine[-1][1]:
                        mine[-1] = (mine[-1][0], hi)
                else:
                    mine.append((lo, hi))
            own = (first[u], first[u] + len(members))
            yield members, _joined(mine, own) if members[0] in self.cyclic else mine, order
            if above[u]:
                sent = _joined(mine, own)
                for p in above[u]:
                    got.setdefault(p, []).extend(sent)


def _joined(stretches: list[tuple[int, int]], own: tuple[int, int]) -> list[tuple[int, int]]:
    """Sorted stretches with one more, which touches at most its neighbours."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*stretches, own]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _inputs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = nodes.select("tax", "node_id").filter("node_id is not null").distinct()
    links = edges.select("tax", F.col("child_id"), F.col("parent_id")).filter("child_id is not null and parent_id is not null").distinct()
    return own, links


def _trees(rows: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, Tree]]:
    """Trees from batches of (tax, child, parent) sorted by tax; a null parent marks a node."""
    now: object = ...
    names: list[str] = []
    links: list[tuple[str, str]] = []
    for b in rows:
        for tax, c, p in zip(*[b.column(k).to_pylist() for k in range(3)]):
            if tax != now:
                if names:
                    yield now, Tree(names, links)
                now, names, links = tax, [], []
            if p is None:
                names.append(c)
            else:
                links.append((c, p))
    if names:
        yield now, Tree(names, links)


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


_NODE = pa.schema([("tax", pa.string()), ("node_id", pa.string()), ("state", pa.string()), ("depth", pa.int64()), ("reached", pa.bool_()), ("root_id", pa.string()), ("path", pa.list_(pa.string())), ("descendants", pa.int64())])
_NODE_SQL = "tax string, node_id string, state string, depth bigint, reached boolean, root_id string, path array<string>, descendants bigint"
_PAIR = pa.schema([("tax", pa.string()), ("node_id", pa.string()), ("descendant_id", pa.string())])


def _local(rows: DataFrame, full: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        cells = 0
        for tax, t in _trees(batches):
            size = [None] * len(t.names)
            for members, stretches, _ in t.lists() if full else ():
                for v in members:
                    size[v] = sum(hi - lo for lo, hi in stretches)
            for v, name in enumerate(t.names):
                good = t.depth[v] is not None
                out.append((tax, name, t.state(v), t.depth[v], t.reached[v], t.names[t.root[v]] if good else None, t.path(v) if full and good else None, size[v]))
                cells += 1 + (t.depth[v] + 1 if full and good else 0)
                if cells >= 10 * _BATCH:
                    yield _flush(out, _NODE)
                    out, cells = [], 0
        if out:
            yield _flush(out, _NODE)

    return rows.repartition(tasks(rows.sparkSession), "tax").sortWithinPartitions("tax").mapInArrow(run, _NODE_SQL)


def _local_pairs(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for tax, t in _trees(batches):
            for members, stretches, order in t.lists():
                for v in members:
                    for lo, hi in stretches:
                        for k in range(lo, hi, _BATCH):
                            out += [(tax, t.names[v], t.names[d]) for d in order[k : min(hi, k + _BATCH)]]
                            if len(out) >= _BATCH:
                                yield _flush(out, _PAIR)
                                out = []
        if out:
            yield _flush(out, _PAIR)

    return rows.repartition(tasks(rows.sparkSession), "tax").sortWithinPartitions("tax").mapInArrow(run, "tax string, node_id string, descendant_id string")


def _split(nodes: DataFrame, edges: DataFrame, scratch: Scratch, max_local: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Tagged rows of the trees that fit one task; nodes and links of the others; how many the others are."""
    own, links = _inputs(nodes, edges)
    sizes = own.groupBy("tax").agg(F.count(F.lit(1)).alias("n")).unionByName(links.groupBy("tax").agg(F.count(F.lit(1)).alias("n"))).groupBy("tax").agg(F.sum("n").alias("n"))
    large, k = scratch.save(sizes.filter(F.col("n") > max_local).select(F.col("tax").alias("large_tax")))
    rows = own.select("tax", F.col("node_id").alias("c"), F.lit(None).cast("string").alias("p")).unionByName(links.select("tax", F.col("child_id").alias("c"), F.col("parent_id").alias("p")))
    if not k["rows"]:
        return rows, own.limit(0), links.limit(0), 0
    same = F.col("tax").eqNullSafe(F.col("large_tax"))
    return rows.join(large, same, "left_anti"), own.join(large, same, "left_semi"), links.join(large, same, "left_semi"), k["rows"]


class _Rounds:
    """The same for graphs beyond ``max_local``, in distributed rounds: as many up and as many down as the longest chain of units.

    Each round takes the units that wait for no child, sends what they hold to their parents, and
    writes what still waits. Where none is left but on or above loops, the loops become units and
    the rounds go on.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, links: DataFrame, scratch: Scratch):
        self.spark, self.scratch = spark, scratch
        named = nodes.select("tax", "node_id").withColumn("id", F.monotonically_increasing_id())
        rooted = named.join(links.select("tax", F.col("child_id").alias("node_id")).distinct().withColumn("declared", F.lit(True)), ["tax", "node_id"], "left")
        self.names, self.n = scratch.save(rooted.select("tax", "node_id", "id", F.coalesce("declared", F.lit(False)).alias("declared")))
        up = self.names.select("tax", F.col("node_id").alias("child_id"), F.col("id").alias("c"))
        ends = self.names.select("tax", F.col("node_id").alias("parent_id"), F.col("id").alias("p"))
        half = links.join(up, ["tax", "child_id"]).select("tax", "c", "parent_id")
        self.links, self.m = scratch.save(half.join(ends, ["tax", "parent_id"]).select("c", "p"))
        self.loops = self._loops()
        self.members, _ = scratch.save(self.names.select("id").join(self.loops, "id", "left").select("id", F.coalesce("rep", "id").alias("unit"), F.col("rep").isNotNull().alias("loop")))
        c, p = (self.members.select(F.col("id").alias(k), F.col("unit").alias(f"{k}u")) for k in "cp")
        joined = lookup(lookup(self.links, c, "c", "inner", self.m["rows"]), p, "p", "inner", self.m["rows"])
        self.up, self.k = scratch.save(joined.filter("cu <> pu").select(F.col("cu").alias("c"), F.col("pu").alias("p")).distinct())

    def _waves(self, links: DataFrame, ids: DataFrame) -> Iterator[DataFrame]:
        """``id`` of what each round of leaf peeling takes."""
        waits = links.groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("left"))
        state, s = self.scratch.save(ids.join(waits, "id", "left").select("id", F.coalesce("left", F.lit(0)).alias("left")))
        while s["rows"]:
            ready, r = self.scratch.save(state.filter("left = 0").select("id"))
            if not r["rows"]:
                return
            yield ready
            told = links.join(ready.withColumnRenamed("id", "c"), "c", "left_semi").groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("k"))
            fresh, s = self.scratch.save(state.filter("left > 0").join(told, "id", "left").select("id", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left")))
            self.scratch.drop(state)
            state = fresh

    def _loops(self) -> DataFrame:
        """``id``, ``rep``: nodes on loops, by the largest node of their loop. Only what leaf peeling leaves is searched."""
        taken = self.scratch.gather(list(self._waves(self.links, self.names.select("id"))))
        left = self.names.select("id") if taken is None else self.names.select("id").join(taken, "id", "left_anti")
        return self._cyclic(left)

    def _cyclic(self, core: DataFrame) -> DataFrame:
        """``id``, ``rep`` of the core's nodes that lie on loops: colours of the largest node that reaches each, then the way back.

        Components that are found leave the core; the rest is coloured again.
        """
        inside = core.select("id")
        links, k = self.scratch.save(self.links.join(inside.withColumnRenamed("id", "c"), "c", "left_semi").join(inside.withColumnRenamed("id", "p"), "p", "left_semi").select("c", "p"))
        found = self.scratch.save(links.filter("c = p").select(F.col("c").alias("id"), F.col("c").alias("rep")).distinct())[0]
        links, k = self.scratch.save(links.filter("c <> p"))
        while k["rows"]:
            ids = links.select(F.col("c").alias("id")).union(links.select("p")).distinct()
            colour, _ = self.scratch.save(ids.withColumn("colour", F.col("id")))
            while True:  # the largest ancestor-or-self
                told = links.join(colour.withColumnRenamed("id", "p"), "p").groupBy(F.col("c").alias("id")).agg(F.max("colour").alias("t"))
                after, a = self.scratch.save(colour.join(told, "id", "left").select("id", F.greatest("colour", F.coalesce("t", "colour")).alias("colour"), (F.coalesce("t", "colour") > F.col("colour")).alias("new")), new=F.count_if("new"))
                colour = after.select("id", "colour")
                if not a["new"]:
                    break
            same = links.join(colour.select(F.col("id").alias("c"), F.col("colour").alias("cc")), "c").join(colour.select(F.col("id").alias("p"), F.col("colour").alias("pc")), "p").filter("cc = pc").select("c", "p")
            same, _ = self.scratch.save(same)
            back, b = self.scratch.save(colour.filter("id = colour").select("id"))
            front = back
            while b["rows"]:  # what leads up to the colour's own node: from it, parents within the colour
                fresh = same.join(front.withColumnRenamed("id", "c"), "c", "left_semi").select(F.col("p").alias("id")).distinct().join(back, "id", "left_anti")
                front, b = self.scratch.save(fresh)
                back = self.scratch.save(back.unionByName(front))[0]
            loops = back.join(colour, "id").groupBy("colour").count().filter("count > 1").select("colour")
            found = self.scratch.save(found.unionByName(back.join(colour, "id").join(loops, "colour", "left_semi").select("id", F.col("colour").alias("rep"))))[0]
            links, k = self.scratch.save(links.join(back.withColumnRenamed("id", "c"), "c", "left_anti").join(back.withColumnRenamed("id", "p"), "p", "left_anti"))
        return found.groupBy("id").agg(F.max("rep").alias("rep"))

    def states(self) -> DataFrame:
        """``tax``, ``node_id``, ``state``, ``depth``, ``via``, ``reached``: down the waves of the peeling, last to first."""
        units = self.members.groupBy(F.col("unit").alias("id")).agg(F.max("loop").alias("loop"))
        first = self.members.join(self.names.select("id", "declared", "node_id"), "id").groupBy(F.col("unit").alias("id")).agg(F.max(~F.col("declared")).alias("top"), F.min("node_id").alias("name"))
        known, _ = self.scratch.save(units.join(first, "id").select("id", "loop", "top", "name"))
        inbox = self.spark.createDataFrame([], "id bigint, d bigint, via string, bad boolean, reached boolean")
        done = []
        for wave in reversed(list(self._waves(self.up, known.select("id")))):
            now = known.join(wave, "id", "left_semi").join(inbox, "id", "left")
            bad = F.col("loop") | F.coalesce("bad", F.lit(False))
            now, _ = self.scratch.save(now.select("id", "name", "loop", F.when(~bad, F.coalesce(F.col("d") + 1, F.lit(0).cast("bigint"))).alias("depth"), F.when(~bad, F.col("via")).alias("via"), (F.col("top") | F.coalesce("reached", F.lit(False))).alias("reached")))
            done.append(now)
            sent = lookup(self.up, now.select(F.col("id").alias("p"), "name", "depth", "reached"), "p", "inner", self.k["rows"])
            sent = sent.select(F.col("c").alias("id"), F.col("depth").alias("d"), F.col("name").alias("via"), F.col("depth").isNull().alias("bad"), "reached")
            waiting = inbox.join(wave, "id", "left_anti").unionByName(sent).groupBy("id")
            best = F.min(F.when(F.col("d").isNotNull(), F.struct((-F.col("d")).alias("d"), "via")))
            fresh, _ = self.scratch.save(waiting.agg(best.alias("b"), F.max("bad").alias("bad"), F.max("reached").alias("reached")).select("id", (-F.col("b.d")).alias("d"), F.col("b.via").alias("via"), "bad", "reached"))
            self.scratch.drop(inbox)
            inbox = fresh
        state = F.when(F.col("loop"), "cycle").when(F.col("depth").isNull(), "below_cycle")
        whole = self.members.drop("loop").join(self.scratch.gather(done).withColumnRenamed("id", "unit").drop("name"), "unit").join(self.names, "id")
        return whole.select("tax", "node_id", state.alias("state"), "depth", "via", "reached")

    def closure(self) -> DataFrame:
        """``tax``, ``node_id``, ``descendant_id``: lists of descendants sent up wave by wave."""
        parents, _ = self.scratch.save(self.up.groupBy(F.col("c").alias("id")).agg(F.collect_list("p").alias("to")))
        inbox, i = self.scratch.save(self.spark.createDataFrame([], "id bigint, d bigint"))
        done = []
        for wave in self._waves(self.up, self.members.select(F.col("unit").alias("id")).distinct()):
            own, o = self.scratch.save(inbox.join(wave, "id", "left_semi"))
            done.append(own)
            sent = lookup(own.unionByName(wave.withColumn("d", F.col("id"))), parents, "id", "inner").select(F.explode("to").alias("id"), "d")
            fresh, i = self.scratch.save(inbox.join(wave, "id", "left_anti").unionByName(sent).distinct())
            self.scratch.drop(inbox)
            inbox = fresh
        loops = self.members.filter("loop")
        pairs = self.scratch.gather(done).unionByName(loops.select(F.col("unit").alias("id"), F.col("unit").alias("d")).distinct())
        a = self.members.join(self.names, "id").select(F.col("unit").alias("id"), "tax", "node_id")
        d = self.members.join(self.names, "id").select(F.col("unit").alias("d"), F.col("node_id").alias("descendant_id"))
        return pairs.join(a, "id").join(d, "d").select("tax", "node_id", "descendant_id")


def node_states(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """``tax``, ``node_id``, ``state``, ``depth``, ``reached``: each node once.

    ``state`` is ``cycle`` for a node that can be reached from itself going up, ``below_cycle``
    for one with such an ancestor, else null; ``depth`` is the longest way up to a node without
    parents, null where there is a state; ``reached`` tells whether a chain of parents leads up to a
    node that declares none. Parents that are no nodes of the same ``tax`` don't
    count; repeated nodes and links count once; null ids don't count; a null ``tax`` is a tree of
    its own in the local way and matches no links in the rounds. Without nodes there are no rows.

    Trees up to ``max_local`` rows, a proven bound on a task, are peeled whole, bottom-up from the
    leaves; larger ones by the same peeling in distributed rounds.
    """
    scratch = Scratch(spark, "hierarchy")
    columns = ["tax", "node_id", "state", "depth", "reached"]
    rows, own, links, many = _split(nodes, edges, scratch, max_local)
    small = _local(rows, False).select(*columns)
    return small.unionByName(_Rounds(spark, own, links, scratch).states().select(*columns)) if many else small


def hierarchies(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """``tax``, ``node_id``, ``state``, ``depth``, ``root_id``, ``path``, ``descendants`` (their number).

    The path is the longest one from a root, the smallest parent id where several are as long.
    Nodes in or under loops have no depth, root or path. A node on a loop is below itself. See
    ``node_states`` for the rest.
    """
    scratch = Scratch(spark, "hierarchy")
    rows, own, links, many = _split(nodes, edges, scratch, max_local)
    small = _local(rows, True).drop("reached")
    if not many:
        return small
    r = _Rounds(spark, own, links, scratch)
    states, _ = scratch.save(r.states())
    level, k = scratch.save(states.filter("depth = 0").select("tax", "node_id", F.array("node_id").alias("path")))
    paths, d = [level], 0
    while k["rows"]:
        d += 1
        step = states.filter(F.col("depth") == d).select("tax", "node_id", "via").join(level.select("tax", F.col("node_id").alias("via"), F.col("path").alias("above")), ["tax", "via"])
        level, k = scratch.save(step.select("tax", "node_id", F.array_append("above", F.col("node_id")).alias("path")))
        paths.append(level)
    counts = r.closure().groupBy("tax", "node_id").agg(F.count(F.lit(1)).alias("descendants"))
    large = states.join(scratch.gather(paths), ["tax", "node_id"], "left").join(counts, ["tax", "node_id"], "left")
    return small.unionByName(large.select("tax", "node_id", "state", "depth", F.get("path", F.lit(0)).alias("root_id"), "path", F.coalesce("descendants", F.lit(0)).alias("descendants")))


def all_descendants(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """``tax``, ``node_id``, ``descendant_id``: each node with everything below it, itself only through a loop."""
    scratch = Scratch(spark, "hierarchy")
    rows, own, links, many = _split(nodes, edges, scratch, max_local)
    small = _local_pairs(rows)
    return small.unionByName(_Rounds(spark, own, links, scratch).closure()) if many else small


def depth_findings(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_local: int = MAX_LOCAL) -> DataFrame:
    """``tax``, ``node_id``, ``finding``: nodes on loops, under loops, or whose stored ``depth`` is null or not the true one.

    Of repeated rows of a node the latest ``loaded_at`` counts.
    """
    stored = nodes.filter("node_id is not null").groupBy("tax", "node_id").agg(F.max(F.struct("loaded_at", "depth")).getField("depth").alias("stored"))
    states = node_states(spark, nodes, edges, max_local).drop("reached")
    wrong = ~F.col("stored").eqNullSafe(F.col("depth"))
    found = states.join(stored, ["tax", "node_id"]).withColumn("finding", F.coalesce("state", F.when(wrong, "depth")))
    return found.filter("finding is not null").select("tax", "node_id", "finding")
