"""Evaluation texts that leak into a corpus."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of items in one automaton, which every Python worker holds (some 0.5 GB at most); more items make several, each with its own pass over the corpus.
MAX_ITEM_WORDS = 500_000

_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: What joins the parts of a word, or marks emphasis in it.
_JOINTS = dict.fromkeys(map(ord, "-‐‑'’*_~`"))
_BLOCK = re.compile(r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|h[1-6]|blockquote|pre|section|article)\b[^<>]{0,200}>")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->")
_LINK = re.compile(r"!?\[([^\]\n]{1,200})\]\([^()\s]{1,300}\)")
_BREAK = re.compile(r"[-‐]\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_SENTENCE = re.compile(r"[.!?…。][\"”»)]*\s+(?=\S)")
_CLUSTER = re.compile(r"(?s).[\u0300-\u036f]*")


def normal_words(text: str) -> list[str]:
    """Words by their letters and digits alone, lower case; markup, emphasis and hidden characters aside."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_HIDDEN))
    if "&" in text and ";" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "-\n" in text or "‐\n" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(text.translate(_JOINTS).lower())


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The words of ``normal_words``, each with the first and the last place of it in the text as it stands."""
    at = list(range(len(text)))

    def sub(pattern: re.Pattern, new) -> None:
        nonlocal text, at
        out, places, last = [], [], 0
        for m in pattern.finditer(text):
            r = new(m)
            if r == m.group():
                continue
            out += [text[last : m.start()], r]
            places += at[last : m.start()]
            # what stays of the match keeps its places; what is new stands where the match began
            keep = m.group(1) if pattern is _LINK else None
            places += at[m.start(1) : m.end(1)] if keep == r and keep is not None else [at[m.start()]] * len(r)
            last = m.end()
        text, at = "".join([*out, text[last:]]), places + at[last:]

    if not text.isascii():
        sub(re.compile(f"[{''.join(map(chr, _HIDDEN))}]"), lambda m: "")
        sub(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m.group()))
    if "&" in text and ";" in text:
        sub(_ENTITY, lambda m: html.unescape(m.group()))
    if "<" in text:
        sub(_BLOCK, lambda m: " ")
        sub(_TAG, lambda m: "")
    if "](" in text:
        sub(_LINK, lambda m: m.group(1))
    sub(_BREAK, lambda m: "")
    sub(re.compile(f"[{re.escape(''.join(map(chr, _JOINTS)))}]"), lambda m: "")
    sub(re.compile(r"(?s)."), lambda m: m.group().lower())
    return [(m.group(), at[m.start()], at[m.end() - 1]) for m in _WORD.finditer(text)]


class Automaton:
    """Generalised suffix automaton over the items' words: states, suffix links, and where each state ends."""

    def __init__(self, items: dict[int, list[str]]):
        self.words: dict[str, int] = {}
        self.items = {i: [self.words.setdefault(w, len(self.words)) for w in x] for i, x in items.items()}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, own = [-1], [0], {}
        for item, x in self.items.items():
            last = 0
            for at, c in enumerate(x):
                last = self._extend(last, c)
                own.setdefault(last, []).append((item, at))
        # every state ends where it or the states below it in the tree of suffix links end: a stretch of one list
        below: list[list[int]] = [[] for _ in self.next]
        for t in range(1, len(self.next)):
            below[self.link[t]].append(t)
        self.places: list[tuple[int, int]] = []
        self.low, self.high = [0] * len(self.next), [0] * len(self.next)
        work = [0]
        while work:
            t = work.pop()
            if t < 0:
                self.high[~t] = len(self.places)
                continue
            self.low[t] = len(self.places)
            self.places += own.get(t, ())
            work.append(~t)
            work += below[t]

    def ends(self, s: int) -> list[tuple[int, int]]:
        """(item, place of its last word) wherever the state's words stand."""
        return self.places[self.low[s] : self.high[s]]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        r = self._state(self.length[p] + 1)
        self.next[r], self.link[r] = dict(self.next[q]), self.link[q]
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # a prefix that an earlier item has, too
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        s, p = self._state(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = s
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[s] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return s

    def runs(self, words: list[int | None], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(item, end in the item, end in the text, length) of the longest matches of each place of an item, where that place's own match stops growing.

        A place stops where its item's next word is not the text's: others may run on, so it is asked
        of every place on the suffix links, not of the state alone.
        """
        state, length, n = 0, 0, len(words)
        nxt, link, lengths, items = self.next, self.link, self.length, self.items
        for at, c in enumerate(words):
            if c is None:
                state = length = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                length = lengths[state]
            if c in nxt[state]:
                state, length = nxt[state][c], length + 1
            if length < least:
                continue
            after = words[at + 1] if at + 1 < n else None
            s, ell, seen, told = state, length, -1, False
            while ell >= least:
                # where no more places end here than in the longer state, or all of them go on, there is nothing new to tell
                many = self.high[s] - self.low[s]
                if many > seen and (after is None or many != self._going(s, after)):
                    for item, end in self.ends(s):
                        x = items[item]
                        if after is None or end + 1 == len(x) or x[end + 1] != after:
                            told = told or s == state
                            if not told:  # the place's longest match is told with it
                                told = True
                                yield from ((i, e, at, length) for i, e in self.ends(state))
                            yield item, end, at, ell
                seen = many
                s = link[s]
                ell = lengths[s]

    def _going(self, s: int, after: int) -> int:
        """How many of a state's places can take the word: as many as the state it leads to has."""
        t = self.next[s].get(after)
        return 0 if t is None else self.high[t] - self.low[t]


def closing(text: str) -> list[str]:
    """The words of a text's last sentence, if it has others."""
    breaks = list(_SENTENCE.finditer(text.strip()))
    return normal_words(text.strip()[breaks[-1].end() :]) if breaks else []


def stock_closings(texts: Iterable[str], shared: int) -> set[tuple[str, ...]]:
    """Closing sentences that at least ``shared`` different texts have."""
    count: dict[tuple[str, ...], int] = {}
    for t in set(texts):
        c = tuple(closing(t))
        count[c] = count.get(c, 0) + 1
    return {c for c, n in count.items() if c and n >= shared}


def _path(item: list[int], text: list[int | None], anchors: list[tuple[int, int, int]], reach: int) -> list[list[tuple[int, int, int]]]:
    """Chains of anchors (item start, text start, length) as steps (item words, text place, 1 if changed)."""
    left = sorted(set(anchors), key=lambda a: (a[1], a[0]))
    chains: list[list[tuple[int, int, int]]] = []
    for a in left:
        best = None
        for chain in chains:
            i, t, n = chain[-1]
            gi, gt = a[0] - i - n, a[1] - t - n
            over = max(0, -gi, -gt)
            far = max(reach, (sum(x[2] for x in chain[-50:]) + a[2]) // 5)  # a long passage has room for more changes
            if over < a[2] and a[0] > i and a[1] > t and max(gi, gt) + over <= far and abs(gi - gt) <= far // 2:
                gap = max(gi, gt)
                if best is None or gap < best[0]:
                    best = (gap, chain, over)
        if best is None:
            chains.append([a])
        elif a[0] + a[2] > best[1][-1][0] + best[1][-1][2] and a[1] + a[2] > best[1][-1][1] + best[1][-1][2]:
            best[1].append((a[0] + best[2], a[1] + best[2], a[2] - best[2]))
    out = []
    for chain in chains:
        i, t, _ = chain[0]
        steps = []
        room = max(60, sum(x[2] for x in chain))
        k = min(i, t, room)
        for x in range(k, 0, -1):
            steps.append((1, t - x, int(item[i - x] != text[t - x])))
        for j, (i, t, n) in enumerate(chain):
            if j:
                pi, pt, pn = chain[j - 1]
                gi, gt = i - pi - pn, t - pt - pn
                both = min(gi, gt)
                front = [int(item[pi + pn + x] != text[pt + pn + x]) for x in range(both)]
                back = [int(item[i - both + x] != text[t - both + x]) for x in range(both)]
                if sum(back) < sum(front):
                    steps += [(1, pt + pn, 1)] * (gi - both) + [(0, pt + pn, 1)] * (gt - both) + [(1, t - both + x, back[x]) for x in range(both)]
                else:
                    steps += [(1, pt + pn + x, front[x]) for x in range(both)] + [(1, t - 1, 1)] * (gi - both) + [(0, t - 1, 1)] * (gt - both)
            steps += [(1, t + x, 0) for x in range(n)]
        i, t, n = chain[-1]
        for x in range(min(len(item) - i - n, len(text) - t - n, room)):
            steps.append((1, t + n + x, int(item[i + n + x] != text[t + n + x])))
        out.append(steps)
    return out


def _span(steps: list[tuple[int, int, int]], least: int, rate: int) -> tuple[int, int, int, int] | None:
    """The longest stretch of at least ``least`` item words with at most one in ``rate`` changed: (words, changed, first, last)."""
    hit = [k for k, s in enumerate(steps) if not s[2]]
    words, changed = [0], [0]
    for w, _, c in steps:
        words.append(words[-1] + w)
        changed.append(changed[-1] + c)
    best = None
    for a in hit:
        if words[-1] - words[a] < max(least, best[0] + 1 if best else 0):
            break
        for b in reversed(hit):
            n = words[b + 1] - words[a]
            if n < least or best and n <= best[0]:
                break
            if rate * (changed[b + 1] - changed[a]) <= n:
                best = (n, changed[b + 1] - changed[a], steps[a][1], steps[b][1])
                break
    return best


def leaked(auto: Automaton, stock: dict[int, int], found: list[str], least: int, rate: int) -> list[tuple[int, int, int, int, int]]:
    """(item, item words, changed, first word, last word) of the longest passage of each item in a text's words; ``stock`` tells where items' closings begin."""
    get = auto.words.get
    words = [get(w) for w in found]
    anchors: dict[int, dict[tuple[int, int], int]] = {}
    seed = max(2, -(-(least - least // rate) // (least // rate + 1)) - 1)
    for item, end, at, n in auto.runs(words, seed):
        start = end - n + 1
        if start < stock[item]:
            of, key = anchors.setdefault(item, {}), (start, at - n + 1)
            of[key] = max(n, of.get(key, 0))
    out = []
    for item, of in anchors.items():
        a = [(*k, n) for k, n in of.items()]
        spans = [s for steps in _path(auto.items[item], words, a, 2 * rate) if (s := _span(steps, least, rate))]
        if spans:
            out.append((item, *max(spans)))
    return out


def cleaned(auto: Automaton, stock: dict[int, int], text: str, least: int, rate: int, most: int, cover: float) -> tuple[str, int]:
    """The text without passages of more than ``most`` words or more than the share ``cover`` of their item, and how many words went."""
    gone = 0
    while leaks := leaked(auto, stock, normal_words(text), least, rate):
        places = placed_words(text)
        leaks = leaked(auto, stock, [w for w, _, _ in places], least, rate)
        bad = sorted((first, last) for item, n, _, first, last in leaks if n > most or n > cover * len(auto.items[item]))
        if not bad:
            break
        kept, at, seen = [], 0, -1
        for first, last in bad:
            if last > seen:
                gone += last - max(first, seen + 1) + 1
                kept.append(text[at : max(at, places[first][1])])
                at, seen = max(at, places[last][2] + 1), last
        text = "".join([*kept, text[at:]])
    return text, gone


#: Automata of the worker, by the name of their items: built once a worker, not once a task.
_BUILT: dict[tuple[str, int], tuple] = {}


class _Items:
    """The evaluation items, broadcast once; cut into sets whose automata fit a worker."""

    def __init__(self, items: DataFrame, item_id: str, item_text: str, shared: int):
        rows = [(r[0], r[1], normal_words(r[1])) for r in items.select(f"`{item_id}`", f"`{item_text}`").dropna().distinct().collect()]
        rows = sorted(((i, t, w) for i, t, w in rows if w), key=lambda r: (str(r[0]), r[1]))
        stock = stock_closings((t for _, t, _ in rows), shared)
        self.name, self.sets, size = uuid.uuid4().hex, [], MAX_ITEM_WORDS + 1
        for i, t, w in rows:
            if size + len(w) > MAX_ITEM_WORDS:
                self.sets.append([])
                size = 0
            size += len(w)
            end = closing(t)
            self.sets[-1].append((i, w, len(w) - len(end) if tuple(end) in stock and len(end) < len(w) else len(w)))
        self.held = items.sparkSession.sparkContext.broadcast(self.sets)

    def get(self) -> dict:
        return {"name": self.name, "held": self.held}


def _automaton(known: dict, k: int) -> tuple[Automaton, dict[int, int], list]:
    key = (known["name"], k)
    if key not in _BUILT:
        for old in [x for x in _BUILT if x[0] != known["name"]]:
            del _BUILT[old]
        some = known["held"].value[k]
        # several texts of one item are items of their own here, under one id
        _BUILT[key] = (Automaton({n: w for n, (_, w, _) in enumerate(some)}), {n: c for n, (_, _, c) in enumerate(some)}, [i for i, _, _ in some])
    return _BUILT[key]


def find_leaks(docs: DataFrame, id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 15, rate: int = 6, shared: int = 2) -> DataFrame:
    """``id``, ``item_id``, ``words``, ``changed``, ``first``, ``last``: each document with each item of which it holds a passage.

    A passage is at least ``least`` words in sequence of the item, of which at most one in ``rate``
    is changed, left out or put in. Words are compared by letters and digits alone. A closing
    sentence that at least ``shared`` items of different texts end in never makes a passage by
    itself. ``first`` and ``last`` are the passage's word places in the document; of several
    passages of an item the longest is given. Null or blank texts and items hold nothing; repeated
    rows give repeated results; a repeated item is one item, and several texts under one
    ``item_id`` are all searched, the longest passage of any of them is given. Other columns play no role.

    The items are a fixed set and broadcast: they form a generalised suffix automaton in every
    worker, built once (beyond ``MAX_ITEM_WORDS`` words several, one after the other). The corpus
    streams through it, whole texts, partition by partition, without a shuffle.
    """
    items_ = _Items(items, item_id, item_text, shared)
    known, shown, kind = items_.get(), items.schema[item_id].dataType.simpleString(), docs.schema[id].dataType.simpleString()
    shown = "string" if shown == "string" else "bigint"

    def search(k: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto, stock, ids = _automaton(known, k)
            for b in batches:
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    best: dict = {}
                    for n, *leak in leaked(auto, stock, normal_words(t), least, rate) if t else ():
                        best[ids[n]] = max(best.get(ids[n], leak), leak, key=lambda x: (x[0], -x[1], -x[2]))
                    rows += [(i, item, *leak) for item, leak in best.items()]
                types = [b.schema.field(0).type, pa.string() if shown == "string" else pa.int64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=x) for c, x in enumerate(types)], names=["id", "item", "words", "changed", "first", "last"])

        return run

    columns = f"id {kind}, item {shown}, words bigint, changed bigint, first bigint, last bigint"
    found = None if items_.sets else docs.sparkSession.createDataFrame([], columns)
    for k in range(len(items_.sets)):
        part = docs.select(f"`{id}`", f"`{text}`").mapInArrow(search(k), columns)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id).withColumnRenamed("item", item_id)


def remove_leaks(docs: DataFrame, id: str, text: str, items: DataFrame, item_id: str, item_text: str, most: int = 30, cover: float = 0.5, least: int = 15, rate: int = 6, shared: int = 2) -> DataFrame:
    """``id``, ``text``, ``removed``: every document without the passages of items that exceed a limit, and how many words went.

    A passage (see ``find_leaks``) goes if it has more than ``most`` words or more than the share
    ``cover`` of its item's words; this is repeated until none is left, so several passages of one
    item go, too. All else stays letter by letter. Null and blank texts stay as they are. Repeated
    rows stay repeated; other columns are left out.
    """
    items_ = _Items(items, item_id, item_text, shared)
    known, sets, kind = items_.get(), len(items_.sets), docs.schema[id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for t in b.column(1).to_pylist():
                n = 0
                for k in range(sets if t else 0):
                    auto, stock, _ = _automaton(known, k)
                    t, less = cleaned(auto, stock, t, least, rate, most, cover)
                    n += less
                texts.append(t)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=["id", "text", "removed"])

    return docs.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"id {kind}, text string, removed bigint").withColumnsRenamed({"id": id, "text": text})
