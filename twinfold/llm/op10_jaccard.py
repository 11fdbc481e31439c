"""N-gram Jaccard join by T-occurrence search.

A document's set holds its distinct ``size``-word shingles of ASCII lower-cased
words (with fewer words, the whole sequence as one).  Two documents link when
100 * intersection >= 80 * union, that is when at least T = 4/9 of the sum of
the set sizes is shared.

1. Every set is written down as its size and a 128-bit hash.  Equal sets form a
   class; from here on a class counts once.
2. Likely classes.  Of a set of n, the 40 % of shingles with the least hashes hold
   at least 16 % of n that any partner's hold, too (a prefix filter that asks for
   more than one).  Shingles meet by hash range, packed, and each class is told how
   many of its own another class has; most classes end here.
3. The shingles of likely classes are taken from the texts and written down, after
   a bit table sized by their number has left out most others.
4. Candidate components.  The shingles of likely classes are counted by hash range,
   and each slice of classes is told the logarithms of its shingles' counts.  In the
   order of (logarithm, hash), the first n - ceil(0.8 n) + 1 shingles of a set hold
   one at least that its partner's have, too (a prefix filter; any order that all
   share will do).  With rare shingles first, a passage that many texts quote is in
   the prefix only of texts that have little else.  What no other class has is left
   out.  The keys that stay are exchanged in two rounds.  First FEW of each class:
   stars around the least class of each key join nearly all that belong together.
   Then all, under the number of the class's component, so a key only makes an edge
   between different components, and a task sends a tree's edges at most.  The
   components hold all links; edges grow with the classes, not with the pairs or the
   tasks.

   In all exchanges a chunk sends what it holds more than once a single time, so a
   group of very many copies doesn't gather anywhere.
5. Inside a component, DivideSkip: the inverted lists of the query's shingles
   are cut to the sizes that can link; short lists are merged through a heap with
   skips, long ones are probed by binary search for those that can still reach T.
   Sets already connected to the query are skipped, and the sets of the largest tree
   need no queries.  Small components share a task by hash.  A large one is cut into
   blocks with some pivots in common, searched one by one; after that only the sets
   outside its largest tree ask the other blocks.  The memory of a task stays bounded.
6. Links found are joined into components over all blocks.

Edge cases: a null text, or one without words, has size 0 and links with
nothing, its component is its own id; copies are linked through their class;
rows that repeat an id appear as often as in the input; null ids are ignored in
the least id of a component unless it has no other; very long texts count in
full; only id and text are read, so other columns may clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions.ship import ship
from twinfold.functions.storage import checkpoint, release
from twinfold.llm import sketch
from twinfold.llm.graph import components
from twinfold.llm.kernels import Words, chunks, mix, stream

SHINGLE = 5
#: Keys in one hash range.
KEYS = 2_000_000
#: Classes in one task, and in one block of a large component.
BLOCK = 1500
#: Keys of a class in the first exchange, and classes (on average) that all blocks of a large component hold.
FEW, PIVOTS = 6, 16
#: Classes that a task remembers before it starts afresh.
CLASSES = 500_000
#: Classes (as bits of their number) that ask together how frequent their shingles are.
SLICE_BITS = 10
#: DivideSkip: weight of the logarithm of the longest list in the number of long lists.
MU = 0.01
#: Cells of a set's parities.
BITS = 2048


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least number of shared shingles of a set of n with any partner."""
    return (4 * n + 4) // 5


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where those of each text begin."""
    hashes = words.hashes(31)
    at = words.windows(size)
    owner = np.searchsorted(words.ptr, at, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    starts = np.concatenate([at, words.ptr[short]])
    ends = np.concatenate([at + size, words.ptr[short + 1]])
    owner = np.concatenate([owner, short])
    h = stream(32).spans(hashes, starts, ends)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(words.counts) + 1))


def _hashed(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their bounds, and both hashes of each set."""
    h, at = shingles(words, size)
    total = lambda x: np.diff(np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])[at])
    return h, at, total(mix(h)).view(np.int64), total(mix(h ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


def _sets(docs: DataFrame, size: int, keys: list[Column]) -> DataFrame:
    """doc_id, the keys, n, h1, h2 (hashes of the set)."""
    own = docs.select("doc_id", *keys)
    names = own.columns
    schema = docs.select("doc_id", *keys).schema.add("n", "long").add("h1", "long").add("h2", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            _, at, h1, h2 = _hashed(Words(part.column("text"), lower=True), size)
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(np.diff(at), pa.int64()), pa.array(h1), pa.array(h2)], names=[*names, "n", "h1", "h2"])

    return checkpoint(docs.select("doc_id", *keys, "text").mapInArrow(run, schema))


def _stars(nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the order of (key, node): which are the first of their key, and for the others node and first node."""
    order = np.lexsort((nodes, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    hub = nodes[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    edge = ~new & (nodes[order] != hub)
    pairs = np.unique(np.stack([nodes[order][edge], hub[edge]], 1), axis=0) if edge.any() else np.zeros((0, 2), np.int64)
    return order[new], pairs[:, 0], pairs[:, 1]


def prefix_tokens(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that each set sends, and their sets."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    sent = np.arange(len(h)) - at[owner] < (n - needed(n) + (n + 4) // 5)[owner]
    return h[sent], owner[sent]


#: Owner of a packed key that only bears witness.
WITNESS = 65535


def _pack(keys: np.ndarray, place: np.ndarray, nodes: np.ndarray, ranges: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Keys in ascending order by range: low halves, places in the range's list of nodes (or WITNESS), the list."""
    to = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    out = []
    for p, a, z in zip(*(x := np.unique(to, return_index=True)), np.append(x[1][1:], len(to))):
        own = place[a:z]
        who, back = np.unique(own[own != WITNESS], return_inverse=True)
        packed = np.full(z - a, WITNESS, "<u2")
        packed[own != WITNESS] = back
        out.append((int(p), keys[a:z].astype("<u4").tobytes(), packed.tobytes(), nodes[who].astype("<i8").tobytes()))
    return out


_PACKED = "p int, keys binary, place binary, nodes binary"


def _batch(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]], names=["p", "keys", "place", "nodes"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k, p, n in zip(batch.column("keys"), batch.column("place"), batch.column("nodes")):
            yield np.frombuffer(k.as_buffer(), "<u4"), np.frombuffer(p.as_buffer(), "<u2"), np.frombuffer(n.as_buffer(), "<i8")


def _likely(docs: DataFrame, size: int, ranges: int) -> DataFrame:
    """(node, r): how many of the shingles that a class sent another class has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, rows=50_000):
            h, at, h1, _ = _hashed(Words(part.column("text"), lower=True), size)
            keys, owner = prefix_tokens(h, at)
            if not len(keys):
                continue
            order = np.lexsort((h1[owner], keys))
            keys, owner, node = keys[order], owner[order], h1[owner[order]]
            new, other = np.ones(len(keys), bool), np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            other[1:] = new[1:] | (node[1:] != node[:-1])  # copies in the chunk count once
            keys, owner, new = keys[other], owner[other], new[other]
            first = np.flatnonzero(new)
            often = np.diff(np.append(first, len(keys))) > 1
            place = np.where(often, WITNESS, owner[first])
            rows = _pack(keys[first], place, h1, ranges)
            settled = np.bincount(owner[np.repeat(often, np.diff(np.append(first, len(keys))))], minlength=len(h1))
            if (who := np.flatnonzero(settled)).size:  # any task may pass them on
                rows.append((-1 - int(who[0]) % ranges, b"", b"", np.stack([h1[who], settled[who]], 1).astype("<i8").tobytes()))
            yield _batch(rows)

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, seen = [], [], []
        for k, p, n in _unpacked(batches):
            if key[0].as_py() < 0:
                yield pa.RecordBatch.from_arrays([pa.array(n[::2]), pa.array(n[1::2])], names=["node", "r"])
            else:
                keys.append(k)
                seen.append(p == WITNESS)
                nodes.append(np.append(n, 0)[np.where(p == WITNESS, len(n), p)])
        if keys:
            k, n, w = np.concatenate(keys), np.concatenate(nodes), np.concatenate(seen)
            order = np.lexsort((n, k))
            k, n, w = k[order], n[order], w[order]
            group = np.cumsum(np.append(True, k[1:] != k[:-1])) - 1
            other = np.append(True, (group[1:] != group[:-1]) | (n[1:] != n[:-1]) | w[1:] | w[:-1])
            several = (np.bincount(group, other) + 2 * np.bincount(group, w) > 1)[group] & other & ~w
            who, r = np.unique(n[several], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(r.astype(np.int64))], names=["node", "r"])

    return docs.select("text").mapInArrow(send, _PACKED).groupBy("p").applyInArrow(meet, "node long, r long").groupBy("node").agg(F.sum("r").alias("r"))


def _node_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column("node").to_numpy().view(np.uint64)


def _wide(docs: DataFrame, size: int, likely: DataFrame) -> DataFrame:
    """node (a number of the class), h1, h2, shingles (in ascending order) of the classes that are likely."""
    among = sketch.members(likely, _node_keys, likely.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for part in chunks(batches):
            h, at, h1, h2 = _hashed(Words(part.column("text"), lower=True), size)
            if len(met) > CLASSES:
                met.clear()
            who = []
            for i in np.flatnonzero(among(h1.view(np.uint64)) & (np.diff(at) > 0)).tolist():
                if (key := (int(h1[i]), int(h2[i]))) not in met:
                    met.add(key)
                    who.append(i)
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(h1[who]), pa.array(h2[who]), pa.array([h[at[i] : at[i + 1]].tobytes() for i in who], pa.binary())], names=["h1", "h2", "shingles"])

    found = docs.select("text").mapInArrow(run, "h1 long, h2 long, shingles binary").join(likely.withColumnRenamed("node", "h1"), "h1")
    return checkpoint(found.groupBy("h1", "h2").agg(F.any_value("shingles").alias("shingles")).withColumn("node", F.monotonically_increasing_id()))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a binary column, and where those of each row begin."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    at = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] // 8
    return np.frombuffer(data, np.uint64, int(at[-1]))[at[0] :], at - at[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The slices of classes in the batches, in the order of the rows, with all their shingles."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        h, at = _flat(batch.column("shingles"))
        own = batch.column("slice").to_numpy()
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for a, z in zip(first, np.append(first[1:], len(own))):
            if last is not None and own[a] != last:
                yield last, np.concatenate(held)
                held = []
            last = int(own[a])
            held.append(h[at[a] : at[z]])
    if held:
        yield last, np.concatenate(held)


def _prefixes(wide: DataFrame, ranges: int) -> DataFrame:
    """(node, keys): the shingles in each class's prefix that another class has, rare ones first."""
    sliced = wide.select(F.shiftright("node", SLICE_BITS).alias("slice"), "node", "shingles")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, h in _slices(batches):
            keys, count = np.unique(h, return_counts=True)
            to = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            p, first = np.unique(to, return_index=True)
            cut = list(zip(first, np.append(first[1:], len(to))))
            packed = [pa.array([x[a:z].tobytes() for a, z in cut], pa.binary()) for x in (keys.astype("<u4"), np.minimum(count, 65535).astype("<u2"))]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(np.full(len(p), own)), *packed], names=["p", "slice", "keys", "counts"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, keys, counts = [], [], []
        for batch in batches:
            slices += batch.column("slice").to_pylist()
            keys += [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("keys")]
            counts += [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("counts")]
        _, group = np.unique(np.concatenate(keys), return_inverse=True)
        level = np.log2(np.bincount(group, np.concatenate(counts))).astype(np.uint8)[group]
        ends = np.cumsum([len(k) for k in keys])
        packed = [level[z - len(k) : z].tobytes() for k, z in zip(keys, ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([key[0].as_py()] * len(slices), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "p", "levels"])

    def pick(sets: pa.Table, answers: pa.Table) -> pa.Table:
        sets = sets.combine_chunks()
        h, at = _flat(sets.column("shingles").combine_chunks())
        answers = answers.sort_by("p")
        level = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in answers.column("levels")])[np.unique(h, return_inverse=True)[1]]
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, level, owner))
        sent = (np.arange(len(h)) - at[owner] < (n - needed(n) + 1)[owner]) & (level[order] > 0)
        keys, ends = h[order[sent]], np.cumsum(np.bincount(owner[sent], minlength=len(n)))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        packed = [keys[a:z].tobytes() for a, z in zip(np.append(0, ends)[some], ends[some])]
        return pa.table({"node": sets.column("node").combine_chunks().take(pa.array(some)), "keys": pa.array(packed, pa.binary())})

    answers = sliced.select("slice", "shingles").mapInArrow(send, "p int, slice long, keys binary, counts binary").groupBy("p").applyInArrow(meet, "slice long, p int, levels binary")
    return checkpoint(sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(pick, "node long, keys binary"))


def _keys_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of slices of the batches; their rows, the values of a column there, and which are in the first round."""
    for part in chunks(batches, "keys", rows=50_000):
        keys, at = _flat(part.column("keys"))
        owner = np.repeat(np.arange(len(part)), np.diff(at))
        yield keys, owner, part.column(column).to_numpy(), np.arange(len(keys)) >= at[owner + 1] - FEW


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _first_edges(prefixes: DataFrame) -> DataFrame:
    """(a, b): stars of the classes around FEW keys of each, the most frequent of its prefix."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owner, nodes, few in _keys_of(batches, "node"):
            keys, nodes = keys[few], nodes[owner[few]]
            first, a, b = _stars(nodes, keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(keys[first].view(np.int64), np.zeros(len(a), np.int64))), pa.array(np.append(nodes[first], a)), pa.array([None] * len(first) + b.tolist(), pa.int64())],
                names=["key", "node", "hub"],
            )

    # A key that classes of one slice share is sent once by it; the others are tied to its least class at once.
    sent = checkpoint(prefixes.mapInArrow(send, "key long, node long, hub long"))
    keyed = sent.where("hub is null").select("key", "node")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    met = keyed.join(hubs, "key").where("node <> hub").select("node", "hub")
    return met.unionByName(sent.where("hub is not null").select("node", "hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def _other_edges(prefixes: DataFrame, roots: DataFrame, ranges: int) -> DataFrame:
    """(a, b): roots of classes that share a key and aren't yet in one component."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All keys: one of the first round of a class may be another's only in this one.
        for keys, owner, roots, _ in _keys_of(batches, "root"):
            own, place = np.unique(roots, return_inverse=True)
            place = place[owner]
            first, a, b = _stars(own[place], keys)
            rows = _pack(keys[first], np.searchsorted(own, own[place][first]), own, ranges)
            if len(a):
                rows.append((-1 - int(a[0]) % ranges, b"", b"", np.stack(_forest(a, b), 1).astype("<i8").tobytes()))
            yield _batch(rows)

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        for k, p, n in _unpacked(batches):
            if key[0].as_py() < 0:
                yield _edges(n[::2], n[1::2])
            else:
                keys.append(k)
                nodes.append(n[p])
        if keys:
            _, a, b = _stars(np.concatenate(nodes), np.concatenate(keys))
            yield _edges(*_forest(a, b))

    sent = prefixes.join(roots, "node").select("root", "keys").mapInArrow(send, _PACKED)
    return sent.groupBy("p").applyInArrow(meet, "a long, b long").distinct()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges connect, one for each node but a root."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        forest.join(x, y)
    roots = forest.roots()
    below = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[below], nodes[roots[below]]


def _candidates(wide: DataFrame, ranges: int) -> DataFrame:
    """(node, root, members) of the classes in candidate components of several; these hold all links."""
    prefixes = _prefixes(wide, ranges)
    first = components(_first_edges(prefixes))
    roots = checkpoint(prefixes.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    other = components(_other_edges(prefixes, roots, ranges)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    both = roots.join(other, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    near = checkpoint(both.join(both.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "root").select("node", "root", "members"))
    release(prefixes, roots)
    return near


class Forest:
    """Union-find; a root is the least number of its tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while (up := self.up[self.up]) is not None and (up != self.up).any():
            self.up = up
        return self.up


def merge_skip(lists: list[list[int]], t: int) -> list[tuple[int, int]]:
    """(number, count) of those that occur in t or more of the ascending lists, by a heap over the lists' heads.

    Where the least head comes in fewer lists, t - 1 lists in all are taken from the heap: nothing below the next head can
    reach t, so they go on from there by binary search."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= t:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap))
        if len(taken) >= t:
            out.append((top, len(taken)))
            ahead = [(i, at + 1) for _, i, at in taken]
        else:
            while heap and len(taken) < t - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            to = heap[0][0]
            ahead = [(i, bisect.bisect_left(lists[i], to, at)) for _, i, at in taken]
        for i, at in ahead:
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return out


class Index:
    """Inverted lists of sets in the order of their sizes, and the forest of what is known to be connected."""

    def __init__(self, sets: list[np.ndarray], held: np.ndarray, trees: np.ndarray):
        """held: the sets in the lists; trees: equal for sets that are connected."""
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size, held = size[self.order], held[self.order]
        self.n = len(sets)
        self.ids = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True)[1]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        owner = np.repeat(np.arange(self.n), self.size)
        on = held[owner]
        # In the order of (list, set); a set is found in a list by binary search.
        self.key = np.sort(self.ids[on] * self.n + owner[on])
        # Parities of the shingles by BITS cells: where two sets differ in k cells, they differ in k shingles at least.
        cell = np.concatenate([sets[i] for i in self.order]) % np.uint64(BITS)
        odd = np.bincount(owner * BITS + cell.astype(np.int64), minlength=self.n * BITS) & 1
        self.parity = np.packbits(odd.astype(bool).reshape(self.n, BITS), axis=1).view(np.uint64)
        self.forest = Forest(self.n)
        first, back = np.unique(trees[self.order], return_index=True, return_inverse=True)[1:]
        self.forest.up[:] = first[back]

    def links(self, q: int) -> Iterator[tuple[int, int]]:
        """Links of q to sets of other trees, one for each tree at least; joins them."""
        n, own_size, forest = self.n, int(self.size[q]), self.forest
        lo = int(np.searchsorted(self.size, needed(own_size), "left"))
        hi = int(np.searchsorted(self.size, 5 * own_size // 4, "right"))
        # 2 I = |A| + |B| - |A xor B|, so parities leave out only sets that can't link.
        most = own_size + self.size[lo:hi] - np.bitwise_count(self.parity[lo:hi] ^ self.parity[q]).sum(1).astype(np.int64)
        able = (9 * most >= 8 * (own_size + self.size[lo:hi])) & (forest.roots()[lo:hi] != forest.root(q))
        if not able.any():
            return
        own = self.ids[self.at[q] : self.at[q + 1]]
        first, last = np.searchsorted(self.key, own * n + lo), np.searchsorted(self.key, own * n + hi)
        # The lists, cut to the sets that can link.
        ends = np.cumsum(last - first)
        place = np.repeat(first - ends + last - first, last - first) + np.arange(ends[-1])
        post = self.key[place] - np.repeat(own * n, last - first)
        kept = able[post - lo]
        post, ends = post[kept], np.concatenate([[0], np.cumsum(kept)])[ends]
        first = np.append(0, ends[:-1])
        length = ends - first
        # T-occurrence: no set in reach links with fewer shared shingles.
        least = -(-4 * (own_size + int(self.size[lo])) // 9)
        if int((length > 0).sum()) < least:
            return
        by_length = np.argsort(length, kind="stable")
        # DivideSkip: the longest lists are only probed.
        n_long = min(least - 1, int(least / (MU * np.log2(max(2, int(length.max()))) + 1)))
        short, long = by_length[: len(own) - n_long], by_length[len(own) - n_long :]
        merged = merge_skip([post[a:z].tolist() for a, z in zip(first[short].tolist(), ends[short].tolist()) if z > a], max(1, least - n_long))
        if not merged:
            return
        found, count = np.array(merged).T
        while True:
            apart = forest.roots()[found] != forest.root(q)
            found, count = found[apart], count[apart]
            if not len(found):
                return
            # A few at a time: once one links, its tree needs no more probes.
            some, share = found[:32], count[:32]
            want = own[long][:, None] * n + some[None, :]
            place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            share = share + (self.key[place] == want).sum(0)
            found, count = found[32:], count[32:]
            for d in some[100 * share >= 80 * (own_size + self.size[some] - share)].tolist():
                if forest.join(q, d):
                    yield int(self.order[q]), int(self.order[d])


def links(sets: list[np.ndarray], groups: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect what links connect: pairs of numbers of sets, a spanning forest.

    groups: links are sought only inside a group.  Of each group one tree, the largest, needs no queries of its own: a link
    between it and another tree is found by the query of the other's set."""
    index = Index(sets, np.ones(len(sets), bool), np.arange(len(sets)))
    group = np.zeros(len(sets), np.int64) if groups is None else groups[index.order]
    by = np.argsort(group, kind="stable")
    for members in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
        done: set[int] = set()
        while True:
            roots = {m: index.forest.root(m) for m in members.tolist()}
            most = Counter(roots.values()).most_common(1)[0][0]
            pending = [m for m, r in roots.items() if r != most and m not in done]
            if not pending:
                break
            for q in pending:
                if index.forest.root(q) != index.forest.root(most):
                    done.add(q)
                    yield from index.links(q)


def _read(batches: Iterator[pa.RecordBatch], columns: list[str]) -> tuple[list[np.ndarray], ...]:
    held: list[list] = [[] for _ in columns]
    sets: list[np.ndarray] = []
    for batch in batches:
        sets += [np.frombuffer(bytes(x.as_buffer()), np.uint64) for x in batch.column("shingles")]
        for own, c in zip(held, columns):
            own.append(batch.column(c).to_numpy(zero_copy_only=False))
    return sets, *(np.concatenate(x) for x in held)


def _search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the components, or the block of one, that share a task."""
    sets, nodes, roots = _read(batches, ["node", "root"])
    pairs = np.array(list(links(sets, roots)), np.int64).reshape(-1, 2)
    yield _edges(nodes[pairs[:, 0]], nodes[pairs[:, 1]])


def _ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the queries and the block of a component that share a task."""
    sets, nodes, trees, asks = _read(batches, ["node", "tree", "asks"])
    index = Index(sets, ~asks, trees)
    pairs = np.array([p for q in np.flatnonzero(asks[index.order]).tolist() for p in index.links(q)], np.int64).reshape(-1, 2)
    yield _edges(nodes[pairs[:, 0]], nodes[pairs[:, 1]])


def _linked(wide: DataFrame, near: DataFrame, block: int) -> DataFrame:
    """(node, root) of all classes with links, by links."""
    bins = max(1, -(-near.count() // block))
    placed = wide.select("node", "shingles").join(near, "node").withColumn("cuts", F.ceil(F.col("members") / block))
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("node"), "cuts"))
    # A small component whole, in a task with others; a large one in blocks, to each of which a few pivots are added.
    small = placed.where("cuts = 1").withColumn("task", F.pmod(F.xxhash64("root"), F.lit(bins))).withColumn("i", F.lit(-1).cast("long"))
    large = placed.where("cuts > 1")
    pivot = F.pmod(F.xxhash64(F.lit(1), "node"), "members") < PIVOTS
    large_at = large.withColumn("i", F.explode(F.when(pivot, F.expr("sequence(0L, cuts - 1)")).otherwise(F.array("cut")))).withColumn("task", F.col("root"))
    columns = ["node", "shingles", "root", "task", "i"]
    found = checkpoint(small.select(columns).unionByName(large_at.select(columns)).groupBy("task", "i").applyInArrow(_search, "a long, b long"))
    linked = components(found)
    if not near.where(F.col("members") > block).limit(1).count():
        return linked
    # Of a large component all outside its largest tree asks every block.
    big = near.where(F.col("members") > block).join(linked.withColumnRenamed("root", "tree"), "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    trees = big.groupBy("root", "tree").agg(F.count(F.lit(1)).alias("n"))
    main = trees.groupBy("root").agg(F.max_by("tree", F.struct("n", "tree")).alias("main"), (F.sum("n") - F.max("n")).alias("asking")).where("asking > 0")
    big = big.join(main, "root").withColumn("asks", F.col("tree") != F.col("main")).withColumn("parts", F.ceil(F.col("asking") / block)).select("node", "tree", "asks", "parts")
    large = large.join(big, "node").withColumn("part", F.pmod(F.xxhash64(F.lit(2), "node"), "parts"))
    held = large.withColumn("i", F.col("cut")).withColumn("j", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("asks", F.lit(False))
    asked = large.where("asks").withColumn("i", F.explode(F.expr("sequence(0L, cuts - 1)"))).withColumn("j", F.col("part"))
    columns = ["node", "shingles", "tree", "asks", "root", "i", "j"]
    more = held.select(columns).unionByName(asked.select(columns)).groupBy("root", "i", "j").applyInArrow(_ask, "a long, b long")
    return components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _components(docs: DataFrame, size: int, block: int, keys: list[Column]) -> DataFrame:
    """doc_id, the keys, n_shingles, component_id; one row per row of docs."""
    ship(docs.sparkSession)
    sets = _sets(docs, size, keys)
    names = sets.columns[1:-3]
    classes = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    likely = _likely(docs, size, int(0.4 * total) // KEYS + 1).join(classes.select(F.col("h1").alias("node"), "n"), "node")
    likely = checkpoint(likely.where("r >= greatest(1, ceil(0.16 * n))").select("node").distinct())
    wide = _wide(docs, size, likely)
    release(likely)
    shingles_held = wide.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    near = _candidates(wide, int(shingles_held / 8) // KEYS + 1)
    linked = checkpoint(_linked(wide, near, block).join(wide.select("node", "h1", "h2"), "node").select("h1", "h2", "root"))
    release(wide, near)
    least = linked.join(classes, ["h1", "h2"]).groupBy("root").agg(F.min("rep").alias("least"))
    ids = classes.select("h1", "h2", "rep").join(linked.join(least, "root").select("h1", "h2", "least"), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("least", "rep").alias("component"))
    return sets.join(ids, ["h1", "h2"], "left").select("doc_id", *names, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of docs."""
    return _components(docs, size, block, [])


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs whose id is the least of its component; rows without an id stay.

    Of rows that repeat an id, those whose text's component has no lesser id count, and of these the first by text, then by
    a hash of all columns, stays."""
    text = F.xxhash64("text")
    least = _components(docs.where("doc_id is not null"), size, BLOCK, [text.alias("_text")]).where("doc_id = component_id").select(F.col("doc_id").alias("_id"), "_text").distinct()
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    kept = rows.join(least, (F.col(own["doc_id"]) == F.col("_id")) & (F.xxhash64(own["text"]) == F.col("_text")), "left_semi")
    rank = F.row_number().over(Window.partitionBy(own["doc_id"]).orderBy(own["text"], F.xxhash64(*names)))
    kept = kept.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return kept.unionByName(rows.where(F.col(own["doc_id"]).isNull())).toDF(*docs.columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Shingles and sets are told apart by MD5 here.
SQL = r"""WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT rid, md5(array_to_string(words[pos + 1 : pos + 5], ' ')) AS s FROM (SELECT rid, words, unnest(range(greatest(len(words) - 4, 1))) AS pos FROM w WHERE len(words) > 0)),
sets AS (SELECT rid, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS class FROM sh GROUP BY rid),
cls AS (SELECT class, min(rid) AS rid, any_value(n) AS n, min(doc_id) AS least FROM sets JOIN w USING (rid) GROUP BY class),
own AS (SELECT class, n, s FROM cls JOIN sh USING (rid)),
link AS (
  SELECT a.class AS a, b.class AS b FROM own a JOIN own b ON a.s = b.s AND a.class < b.class AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT class, class AS other FROM cls UNION SELECT edge.b, reach.other FROM reach JOIN edge ON edge.a = reach.class),
top AS (SELECT reach.class, min(cls.least) AS least FROM reach JOIN cls ON cls.class = reach.other GROUP BY reach.class)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id)::BIGINT AS component_id FROM w LEFT JOIN sets USING (rid) LEFT JOIN top USING (class)"""
