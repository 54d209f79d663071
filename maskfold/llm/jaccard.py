"""N-gram Jaccard join by T-occurrence search.

Texts become sets of word shingles. Equal sets are folded; a set in which too many shingles occur in no other
set can link with nothing and leaves. The others are led together by the inverted lists of their rarest shingles
(the short lists; the long ones need not be merged, since a result is still met in a short one). Within such
a group a set looks for partners with DivideSkip: a heap merges the short lists, the long ones are probed by
binary search until the required overlap is reached or out of reach.

Only links that can change a component are looked for. In a small group sets form stars around pivots; since Jaccard
distance is a metric, a set farther than twice the distance threshold from a pivot links with nobody in its star. In a
larger one blocks of sets are searched at once in arrays, and sets of its largest component need not meet each other.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise

from . import arrays, exchange
from .components import components
from .text import free_name

GROUP_ITEMS = 4_000_000
#: groups of more sets are searched in arrays, by a table of so many cells at most; so many sets are compared with all others first
ARRAY_SETS, CELLS, FIRST = 12, 16_000_000, 64


@dataclass(frozen=True)
class Rule:
    """Sets of `words`-word shingles link when 100 * |A and B| >= percent * |A or B|."""

    words: int = 5
    percent: int = 80

    def links(self, overlap: int, a: int, b: int) -> bool:
        return overlap > 0 and 100 * overlap >= self.percent * (a + b - overlap)

    def needed(self, a: int) -> int:
        """The least overlap with any partner at all of a set of size a."""
        return max(1, -(-self.percent * a // 100))

    @property
    def wide(self) -> Rule:
        """The rule at twice the distance."""
        return Rule(self.words, max(1, 2 * self.percent - 100))


def shingles(p: arrays.Piece, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, ascending; a text of fewer words is one shingle."""
    h = p.hash
    run = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        run = arrays.mix(run * np.uint64(3) + h[k : k + len(run)])
    for a, b in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(run[a : b - words + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = arrays.mix(np.array([short], np.uint64) * np.uint64(3) + x)[0]
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _prints(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one = int(arrays.mix(s).sum(dtype=np.uint64))
    two = int(np.bitwise_xor.reduce(arrays.mix(s + np.uint64(0x51ED270B0929))) if len(s) else 0)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (one, two))


def _sketches(rule: Rule, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in arrays.pieces(batch.column(1), lower=True):
                rows = [(len(s), *_prints(s)) for s in shingles(p, rule.words)]
                n, f1, f2 = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, p.rows), n, f1, f2, pa.array(np.diff(p.offsets))], [key, "n", "f1", "f2", "bytes"])

    return run


def _batch_sets(texts: pa.Table, wanted: set[int], rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """(set id, shingles) of the sets that this batch stands for, each once, in order of the rows."""
    seen: set[int] = set()
    for p in arrays.pieces(texts.column("text"), lower=True):
        for s in shingles(p, rule.words):
            if len(s) and (sid := _prints(s)[0]) in wanted and sid not in seen:
                seen.add(sid)
                yield sid, s


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("id", "ascending"), ("text", "ascending")])


def _alive(docs: DataFrame, classes: DataFrame, layout: exchange.Layout, rule: Rule) -> DataFrame:
    """Sets of which enough shingles occur elsewhere: (sid, n, alone, items), items by (sets that hold it, hash)."""
    texts = docs.select(exchange.batch_of(layout, "id").alias("batch"), "id", "text")
    reps = classes.select(exchange.batch_of(layout, "least").alias("batch"), F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("answer"), "sid")

    def out(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        wanted = set(r.column("sid").to_pylist())
        got = [s for _, s in _batch_sets(_ordered(t), wanted, rule)]
        items = np.concatenate([np.zeros(0, np.uint64), *got])
        return exchange.send(layout, key[0].as_py(), items, np.ones((len(items), 1)))

    def back(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        sid = r.column("sid").to_pylist()
        got = list(_batch_sets(_ordered(t), {s for s in sid if s is not None}, rule))
        _, _, place = layout.ordered(np.concatenate([np.zeros(0, np.uint64), *[s for _, s in got]]))
        known = r.filter(pc.greater_equal(r.column("bucket"), 0))
        df = exchange.answers(known, "u1", 1)[place, 0]
        rows, at = [], 0
        for i, s in got:
            d = df[at : at + len(s)]
            at += len(s)
            alone = int((d < 2).sum())
            if len(s) - alone >= rule.needed(len(s)):
                order = np.lexsort((s, d))
                rows.append((i, len(s), alone, s[order].tobytes()))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({k: pa.array(list(c), kind) for k, c, kind in zip(("sid", "n", "alone", "items"), cols, kinds, strict=True)})

    sent = texts.groupBy("batch").cogroup(reps.groupBy("batch")).applyInArrow(out, exchange.SENT)
    told = sent.groupBy("bucket").applyInArrow(exchange.answer(layout, 1, lambda total: np.minimum(total, 255).astype(np.uint8)), exchange.ANSWER)
    both = told.select("batch", "bucket", "answer", F.lit(None).cast("long").alias("sid")).unionByName(reps)
    return texts.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(back, "sid long, n int, alone int, items binary")


def _prefixes(rule: Rule):
    """(item, sid) of the shared shingles in each set's prefix: two sets that link share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n, alone, items = (batch.column(c).to_pylist() for c in ("sid", "n", "alone", "items"))
            taken = [np.frombuffer(x, "<u8")[u : m - rule.needed(m) + 1].astype(np.int64) for m, u, x in zip(n, alone, items, strict=True)]
            lens = [len(x) for x in taken]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *taken])), pa.array(np.repeat(np.array(sid, np.int64), lens))], ["item", "sid"])

    return run


def divide_skip(lists: list[list[int]], need: int, holds) -> list[int]:
    """Numbers that occur in at least `need` of the ascending lists; `holds(number, places)` counts by binary search
    in how many of the lists at these places a number is.

    Of the lists, by length, up to need - 1 long ones are not merged: what reaches `need` is still met in a short one.
    """
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    longest = len(lists[order[-1]]) if order else 0
    if not longest:
        return []
    skip = min(need - 1, int(need / (0.0085 * np.log2(longest + 1) + 1)))
    short, long_ = order[: len(order) - skip], order[len(order) - skip :]
    heap = [(lists[i][0], i, 0) for i in short if lists[i]]
    heapify(heap)
    found = []
    while heap:
        top, seen = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, i, k = heap[0]
            seen += 1
            if k + 1 < len(lists[i]):
                heapreplace(heap, (lists[i][k + 1], i, k + 1))
            else:
                heappop(heap)
        if seen + len(long_) >= need and seen + holds(top, long_) >= need:
            found.append(top)
    return found


def _hold(of: np.ndarray, items: np.ndarray) -> int:
    """How many of `items` are in the ascending array `of`."""
    at = np.searchsorted(of, items)
    at[at == len(of)] = 0
    return int((of[at] == items).sum()) if len(of) else 0


class Stars:
    """Sets around pivots, with a union-find over all; finds every link that joins two components."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.wide = rule, rule.wide
        self.sets: list[np.ndarray] = []  # ascending
        self.root: list[int] = []
        self.pivots: list[int] = []  # numbers of the sets
        self.members: list[list[tuple[int, float]]] = []  # of each pivot: set, distance
        self.lists: dict[int, list[int]] = {}  # shingle -> places in `pivots`
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[a] = b
            self.edges.append((i, j))

    def add(self, s: np.ndarray, group: int | None = None) -> int:
        """Take in a set; `group` is a set that is known to be in its component already."""
        me = len(self.sets)
        self.sets.append(s)
        self.root.append(me)
        if group is not None:
            self.root[me] = self.find(group)
        lists = [self.lists.get(x, []) for x in s.tolist()]
        need = self.wide.needed(len(s))
        star = None
        near: list[tuple[float, int]] = []
        for p in divide_skip(lists, need, lambda p, places: _hold(self.sets[self.pivots[p]], s[places]) if places else 0):
            other = self.sets[self.pivots[p]]
            overlap = _hold(other, s)
            distance = 1 - overlap / (len(s) + len(other) - overlap)
            if self.rule.links(overlap, len(s), len(other)):
                self.join(me, self.pivots[p])
                if star is None:
                    star = p
                    self.members[p].append((me, distance))
            else:
                near.append((distance, p))
        reach = 1 - self.rule.percent / 100
        for distance, p in sorted(near):
            if self.find(self.pivots[p]) == self.find(me):
                continue  # a star is one component
            for m, d in self.members[p]:
                other = self.sets[m]
                if d >= distance - reach - 1e-9 and self.rule.links(_hold(other, s), len(s), len(other)):
                    self.join(me, m)
                    break
        if star is None:
            for x in s.tolist():
                self.lists.setdefault(x, []).append(len(self.pivots))
            self.pivots.append(me)
            self.members.append([])
        return me


class Lists:
    """The inverted lists of a group's shingles, divided at one length: the long ones are columns of a 0/1 matrix, the short
    ones are merged by counting."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.k = k = len(sets)
        self.n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(k), self.n)
        _, code, self.length = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        long_ = np.argsort(-self.length, kind="stable")[: min(int((self.length > max(1, k // 16)).sum()), CELLS // k)]
        column = np.full(len(self.length), -1)
        column[long_] = np.arange(len(long_))
        at = column[code]
        self.matrix = np.zeros((k, len(long_)), np.float32)
        self.matrix[owner[at >= 0], at[at >= 0]] = 1
        self.n_long = np.bincount(owner[at >= 0], minlength=k)
        short = (at < 0) & (self.length[code] > 1)
        self.code, owner = code[short], owner[short]
        self.first = np.searchsorted(owner, np.arange(k + 1))
        self.posted = owner[np.argsort(self.code, kind="stable")]
        self.start = np.cumsum(counts := np.bincount(self.code, minlength=len(self.length))) - counts
        self.work = np.bincount(owner, self.length[self.code], minlength=k)

    def blocks(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Stretches of `rows` whose counts fit into the cells."""
        total = np.cumsum(self.work[rows] + self.k) // (CELLS // 16)
        yield from np.split(rows, np.flatnonzero(np.diff(total)) + 1)

    def links(self, rows: np.ndarray, rule: Rule) -> np.ndarray:
        """Which sets each of `rows` links with."""
        first, last = self.first[rows], self.first[rows + 1]
        code = self.code[_ranges(first, last - first)]
        n = self.length[code]
        row = np.repeat(np.repeat(np.arange(len(rows)), last - first), n)
        over = np.bincount(row * self.k + self.posted[_ranges(self.start[code], n)], minlength=len(rows) * self.k).reshape(len(rows), self.k)
        mine = self.n[rows][:, None]
        # what the long lists may still add decides who is looked up in them
        reach = ((over + np.minimum(self.n_long[rows][:, None], self.n_long)) * 100 >= rule.percent * mine).any(axis=0)
        open_ = np.flatnonzero(reach)
        over[:, open_] += (self.matrix[rows] @ self.matrix[open_].T).astype(over.dtype)
        return (over > 0) & (100 * over >= rule.percent * (mine + self.n - over))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of n[i] numbers each, one after the other."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def array_search(rule: Rule, sets: list[np.ndarray], known: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that make up the components of `sets`, and sets that stand for them. `known[i]` is a set that is in the component of i."""
    lists, root = Lists(sets), list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for i, j in enumerate(known):
        root[find(i)] = find(j)
    label = np.array([find(i) for i in range(len(sets))])

    def meet(rows: np.ndarray) -> None:
        nonlocal label
        for block in lists.blocks(rows):
            r, c = np.nonzero(lists.links(block, rule) & (label[block][:, None] != label))
            _, one = np.unique(r * lists.k + label[c], return_index=True)
            for i, j in zip(block[r[one]].tolist(), c[one].tolist(), strict=True):
                if (a := find(i)) != (b := find(j)):
                    root[a] = b
                    edges.append((i, j))
            label = np.array([find(i) for i in range(len(sets))])

    some = np.arange(0, lists.k, -(-lists.k // FIRST))
    for i in range(0, len(some), 16):
        meet(some[i : i + 16])
    # two sets of the largest component need not meet, all others meet everyone
    meet(np.flatnonzero(label != np.bincount(label).argmax()))
    return edges, list(dict.fromkeys([*some.tolist(), *np.unique(label, return_index=True)[1].tolist()]))


EDGES = "a long, b long, pivot boolean"


def _search(rule: Rule):
    """Group function: rows (sid, items, known, budget) -> edges that join components, and as (sid, sid, true) the pivots
    up to `budget` shingles."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("sid", "ascending")])
        sids, known = t.column("sid").to_pylist(), t.column("known").to_pylist()
        sets, first = [np.sort(np.frombuffer(x.as_py(), "<u8")) for x in t.column("items")], {}
        same = [first.setdefault(g, i) if g is not None else i for i, g in enumerate(known)]
        if len(sets) > ARRAY_SETS:
            edges, pivots = array_search(rule, sets, same)
        else:
            stars = Stars(rule)
            for i, (x, j) in enumerate(zip(sets, same, strict=True)):
                stars.add(x, j if j < i else None)
            edges, pivots = stars.edges, stars.pivots
        before = np.cumsum([0, *[len(sets[i]) for i in pivots]])[:-1]
        rows = [(sids[i], sids[j], False) for i, j in edges] + [(sids[i], sids[i], True) for i in np.array(pivots)[before < t.column("budget")[0].as_py()]]
        a, b, p = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "pivot": pa.array(p, pa.bool_())})

    return run


def _find_links(alive: DataFrame, groups: DataFrame, rule: Rule, limit: int) -> DataFrame:
    """Edges (a, b) between sets of a candidate group that make up its components.

    A group of up to `limit` shingles is one task. A larger one is cut into chunks; then its pivots meet, and
    sets outside the group's largest known component meet every chunk in blocks, so that no link is lost and the
    work is that of these sets times the group, not of the group squared.
    """
    rows = alive.join(groups.select(F.col("node").alias("sid"), F.col("component").alias("grp")), "sid")
    size = rows.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1")
    size = size.select("grp", F.ceil(F.col("total") / limit).cast("int").alias("chunks"))
    rows = rows.join(size, "grp").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    rows = materialise(rows.select("grp", "chunk", "chunks", "sid", "n", "items"), "groups")
    search = lambda df: df.groupBy("grp", "chunk", "block").applyInArrow(_search(rule), EDGES)
    no = F.lit(None).cast("long")
    whole = F.lit(limit).cast("long").alias("budget")
    share = F.ceil(F.lit(limit) / F.col("chunks")).alias("budget")
    found = materialise(search(rows.select("grp", "chunk", F.lit(0).alias("block"), "sid", "items", no.alias("known"), share)), "links")
    edges = found.where("not pivot").select("a", "b")
    large = rows.where("chunks > 1")
    if not large.limit(1).count():
        return edges

    # pivots of the chunks of one group, each chunk's share of the limit: this joins what belongs together, nothing relies on it
    some = large.join(found.where("pivot").select(F.col("a").alias("sid")), "sid", "left_semi")
    more = search(some.select("grp", F.lit(0).alias("chunk"), F.lit(1).alias("block"), "sid", "items", no.alias("known"), whole))
    edges = materialise(edges.union(more.where("not pivot").select("a", "b")), "links")

    label = components(edges, "a", "b").select(F.col("node").alias("sid"), "component")
    known = large.join(label, "sid", "left").withColumn("known", F.coalesce("component", "sid"))
    counts = known.groupBy("grp", "known").count()
    top = counts.groupBy("grp").agg(F.max_by("known", F.struct("count", "known")).alias("top"))
    known = materialise(known.join(top, "grp").select("grp", "chunk", "chunks", "sid", "n", "items", "known", (F.col("known") != F.col("top")).alias("out")), "known")
    outer = known.where("out")
    blocks = outer.groupBy("grp").agg(F.ceil(F.sum("n") / limit).cast("int").alias("blocks"))
    outer = outer.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int"))
    sent = outer.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meet = known.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["grp", "chunk", "block", "sid", "items", "known"]
    pairs = meet.select(*cols).union(sent.select(*cols)).dropDuplicates(["grp", "chunk", "block", "sid"])
    last = materialise(search(pairs.withColumn("budget", whole)).where("not pivot").select("a", "b"), "links")
    return edges.union(last)


def join(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", limit: int = GROUP_ITEMS) -> DataFrame:
    """(key, n_shingles, component_id) for each row of `docs`.

    A-Z count as lower case; words are what lies between ASCII blanks. Null and blank texts have no shingles and
    link with nothing: their component is their own id. Equal sets always link, repeated rows too. A null
    key takes part only through a set equal to that of a row with a key; alone its component is null.
    An empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sketch = base.mapInArrow(_sketches(rule, "id"), f"id {kind}, n long, f1 long, f2 long, bytes long")
    sketch = materialise(sketch, "sketch")
    classes = sketch.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("least"), F.max("bytes").alias("bytes"))
    classes = materialise(classes.withColumnRenamed("f1", "sid"), "classes")
    totals = sketch.agg(F.sum("bytes")).first()[0] or 0, classes.agg(F.sum("n")).first()[0] or 0
    layout = exchange.Layout.of(int(totals[0]), int(totals[1]), 4)

    alive = materialise(_alive(base.where("id is not null"), classes.where("least is not null"), layout, rule), "alive")
    lists = materialise(alive.mapInArrow(_prefixes(rule), "item long, sid long"), "prefix")
    hubs = lists.groupBy("item").agg(F.min("sid").alias("hub"), F.count("*").alias("c")).where("c > 1").select("item", "hub")
    together = lists.join(hubs, "item").where("sid <> hub").select("sid", "hub").distinct()
    groups = materialise(components(together, "sid", "hub"), "candidates")

    edges = _find_links(alive, groups, rule, limit)
    label = components(edges, "a", "b").select(F.col("node").alias("sid"), "component")
    named = classes.select("n", "sid", "f2", "least").join(label, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("n", F.col("sid").alias("f1"), "f2", "component_id")
    filled = sketch.where("n > 0").join(named, ["n", "f1", "f2"]).select("id", "n", "component_id")
    empty = sketch.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = reduce(DataFrame.unionAll, [filled, empty])
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with one row of each group, that of the smallest key and, of this, the first by text.

    Each row counts for itself: rows that share a key but are not linked both stay. Of rows without shingles
    one of each key stays. Rows without a key stay unless a row with a key has the same set.
    """
    name, label, blank = (free_name(docs, n) for n in ("row", "group", "blank"))
    keyed = docs.where(F.col(key).isNotNull())
    keyed = materialise(keyed.withColumn(name, F.monotonically_increasing_id()), "rows")
    found = join(keyed, rule, name, text)
    found = found.join(keyed.select(name, F.col(key).alias("__k")), name)
    empty = F.col("n_shingles") == 0
    found = found.select(name, "__k", F.when(~empty, F.col("component_id")).alias(label), F.when(empty, F.col("__k")).alias(blank))
    found = materialise(found, "found")
    # the smallest key of each group first, so that only its rows bring their texts
    least = found.where(F.col(label).isNotNull()).groupBy(label).agg(F.min("__k").alias("__k"))
    chosen = found.where(F.col(label).isNotNull()).join(least, [label, "__k"]).select(name, label, blank)
    chosen = chosen.unionByName(found.where(F.col(label).isNull()).select(name, label, blank))
    mine = Window.partitionBy(label, blank).orderBy(text, name)
    order = free_name(docs, "place")
    kept = keyed.join(chosen, name).withColumn(order, F.row_number().over(mine)).where(F.col(order) == 1).select(*docs.columns)
    nameless = docs.where(F.col(key).isNull())
    if nameless.limit(1).count():
        # the same sets again, by their prints: few rows, since keys are rarely null
        has = docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(_sketches(rule, key), _sketch_type(docs, key)).where("n > 0").select("n", "f1", "f2").distinct()
        numbered = materialise(nameless.withColumn(name, F.monotonically_increasing_id()), "nameless")
        prints = numbered.select(F.col(name), text).mapInArrow(_sketches(rule, name), f"`{name}` long, n long, f1 long, f2 long, bytes long")
        stay = prints.join(has, ["n", "f1", "f2"], "left_anti").select(name)
        kept = kept.unionByName(numbered.join(stay, name, "left_semi").drop(name))
    return kept.select(*docs.columns)


def _sketch_type(docs: DataFrame, key: str) -> str:
    return f"`{key}` {dict(docs.dtypes)[key]}, n long, f1 long, f2 long, bytes long"
