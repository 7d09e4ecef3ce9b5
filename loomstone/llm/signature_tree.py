"""N-gram Jaccard join: shingle sets in signature trees, nodes pruned in pairs by the overlap they can have at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import components, give_back, packed, scratch, small_batches, stored, text_key, unpacked

LEAF = 8  # sets under the lowest nodes
BLOCK = 64  # sets of one tree
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ODD = np.uint64(1 << 16)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordNumbers(dict):
    """64-bit numbers of words; remembers those it has met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def shingle_set(text: str | None, size: int, numbers: dict) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words as 64-bit numbers; fewer words are one shingle, none are none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only the six blanks part
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    width = min(size, len(w))
    total = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total * _MIX[2] + w[i : len(w) - width + 1 + i])
    return np.unique(total)


class Levels:
    """Size classes and, for every level, into how many parts sets are cut so that linked sets share a whole part.

    Linked sets of a and b elements differ in at most (a + b) (1 - j) / (1 + j)
    elements. A class ends where the next may begin to hold partners, so partners
    lie in one class or in neighbours; level l serves classes l and l + 1. With
    k differences at most and k + 1 + spare parts dealt by hash, 1 + spare parts
    are the same in both. ``spare`` parts may be empty; a set with more empty
    parts also shows those, so the guarantee holds without exception. The spare
    parts let a set leave out some of the parts it shares with very many others.
    """

    def __init__(self, percent: int):
        self.percent, self.ends = percent, [1]

    def class_of(self, n: int) -> int:
        while self.ends[-1] < n:
            self.ends.append(max(self.ends[-1] + 1, self.ends[-1] * 100 // self.percent))
        return int(np.searchsorted(self.ends, n))

    def parts(self, level: int) -> tuple[int, int]:
        a = self.ends[level]
        k = self.differences(a, max(a, a * 100 // self.percent))
        spare = 1 + k // 2
        return (k + 1 + spare, spare) if k else (0, 0)

    def differences(self, a: int, b: int) -> int:
        """In how many elements linked sets of a and b elements differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def shared(self, n: int, own: int, level: int) -> int:
        """How many parts a set of n elements and class ``own`` shares at least with any that links to it at this level."""
        partner = n * 100 // self.percent if level == own else self.ends[level]
        return self.parts(level)[0] - self.differences(n, partner)


def part_keys(tokens: np.ndarray, levels: Levels) -> tuple[np.ndarray, list[int]]:
    """A key for every part of a set at the two levels it belongs to, and how many of them a linked set shares at least, for even and odd levels.

    Bit 16 of a key tells whether its level is odd. No keys where only equal sets can link.
    """
    out, shared = [], [0, 0]
    own = levels.class_of(len(tokens))
    for level in (own, own - 1):
        if level < 0:
            continue
        m, spare = levels.parts(level)
        if not m:
            continue
        part = (mix(tokens ^ _MIX[4]) % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, mixed = part[order], mix(tokens[order] + _MIX[3])
        starts = np.nonzero(np.diff(part, prepend=-1))[0]
        sums = np.add.reduceat(mixed, starts)
        tag = np.uint64((level * 2 + 1) * int(_MIX[2]) & 0xFFFFFFFFFFFFFFFF)
        keys = [mix(sums + mix(part[starts].astype(np.uint64) + tag))]
        hidden = m - len(starts)
        if hidden > spare:
            empty = np.setdiff1d(np.arange(m), part[starts]).astype(np.uint64)
            keys.append(mix(_MIX[4] + mix(empty + tag)))
            hidden = 0
        shared[level % 2] = levels.shared(len(tokens), own, level) - hidden
        out += [k & ~_ODD | _ODD * np.uint64(level % 2) for k in keys]
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), shared


def digest_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def bitmap_of(tokens: np.ndarray) -> bytes:
    """The token bitmap of a set: at least two bits a token, a power of two wide, so that wide ones fold onto narrow ones."""
    width = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _sets_of(batch: pa.RecordBatch, size: int, numbers: dict) -> list[np.ndarray]:
    sets = [shingle_set(text.as_py(), size, numbers) for text in batch.column("text")]
    if len(numbers) > 100_000:
        numbers.clear()
    return sets


def _described(size: int, percent: int):
    """Texts -> per document its set's size, digest, bitmap, part keys, and how many of those a linked set shares at even and odd levels.

    Keys have 48 bits and stand in one binary value, six bytes each: what they
    bring together is compared later, so a rare chance meeting costs a look.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, levels = WordNumbers(), Levels(percent)
        for batch in batches:
            sets = _sets_of(batch, size, numbers)
            digest = [digest_of(s) if len(s) else None for s in sets]
            bits = [bitmap_of(s) if len(s) else None for s in sets]
            parts = [part_keys(s, levels) for s in sets]
            keys = [np.unique(k >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for k, _ in parts]
            columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in (digest, bits, keys))]
            columns += [pa.array([shared[odd] for _, shared in parts], pa.int32()) for odd in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns], ["doc_id", "th", "n", "digest", "bits", "keys", "even", "odd"])
        numbers.clear()
        give_back()

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, keys) -> a row (key, node) per key."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            raw = part.column("keys").to_pylist()
            six = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
            keys = np.zeros((len(six), 8), np.uint8)
            keys[:, :6] = six
            nodes = np.array([int.from_bytes(d[:8], "big", signed=True) for d in part.column("digest").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(nodes, [len(r) // 6 for r in raw]))], ["key", "node"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node) -> an edge from the first node of every key to each node of it.

    kind 0: an edge (a, b), a = b for the first node itself. kind 1: the nodes of
    the part's first key, which may have begun in the part before (a is its first
    node here). kind 2: the part's last key with its first node.
    """
    key, hub, before, opening = None, None, None, True
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["kind", "key", "a", "b"]
    for batch in batches:
        if not batch.num_rows:
            continue
        k, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (node[1:] != node[:-1])
        fresh[0] = (k[0], node[0]) != (key, before)
        if not fresh.any():
            continue
        k, node = k[fresh], node[fresh]
        new = np.append(True, k[1:] != k[:-1])
        new[0] = k[0] != key
        begins = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        hubs = np.where(begins < 0, node[0] if hub is None else hub, node[np.maximum(begins, 0)])
        turns = np.nonzero(new)[0]
        if key is None:
            first_end = int(turns[1]) if len(turns) > 1 else len(k)
        elif opening:
            first_end = int(turns[0]) if len(turns) else len(k)
        else:
            first_end = 0
        edge = np.arange(len(k)) < first_end
        # A key with one node here says nothing; the hub's own row goes out with the key's second node.
        second = np.zeros(len(k), bool)
        second[1:] = ~new[1:] & new[:-1]
        second[0] = not new[0] and before is not None and hub == before and key == k[0]
        more = ~new & ~edge
        own = second & ~edge
        kind = np.concatenate([np.ones(first_end, np.int32), np.zeros(int(more.sum() + own.sum()), np.int32)])
        rows = [np.concatenate([k[edge], k[more], k[own]]), np.concatenate([hubs[edge], hubs[more], hubs[own]]), np.concatenate([node[edge], node[more], hubs[own]])]
        yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, rows)], names)
        opening = opening and first_end == len(k)
        key, hub, before = int(k[-1]), int(hubs[-1]), int(node[-1])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((2, key, hub, hub), kinds)], names)


def node_of(digest) -> Column:
    """The first half of a digest as a number; what two sets share it with each other is compared, not assumed."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def candidate_groups(described: DataFrame) -> DataFrame:
    """(key, hub, node): the nodes of every part that at least two sets share; the hub is the smallest of them.

    A star per part, one row a member: no pairs. Rows are dealt by range of
    (key, node), so a part that very many sets share lies across as many tasks as
    it needs; a task's first key may have begun in the one before, which one row
    per task settles.
    """
    rows = described.where("digest IS NOT NULL").select("digest", "keys").mapInArrow(_keyed, "key long, node long")
    dealt = rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    marks = stored(dealt.mapInArrow(_stars, "kind int, key long, a long, b long").withColumn("part", F.spark_partition_id()), "stars")
    edges = marks.where("kind = 2").groupBy("key").agg(F.min_by("a", "part").alias("hub"), F.min("part").alias("first_part"))
    first = marks.where("kind = 1").join(F.broadcast(edges), "key", "left")  # a row per part at most
    first = first.select("key", F.when(F.col("first_part") < F.col("part"), F.col("hub")).otherwise(F.col("a")).alias("hub"), F.col("b").alias("node"))
    # A last key that goes on elsewhere: its hub's own row may stand in no other.
    last = marks.where("kind = 2").select("key", F.col("a").alias("hub"), F.col("a").alias("node")).join(edges.select("key", F.col("hub").alias("top")), "key")
    last = last.select("key", F.col("top").alias("hub"), "node")
    every = marks.where("kind = 0").select("key", F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(first).unionByName(last)
    return every.distinct()


class Tree:
    """A signature tree over a block of sets, laid out level by level.

    A node has the OR of its sets' bitmaps, their smallest and largest size, and
    how many tokens a set under it can lose to shared bits. Two sets overlap in
    at most the common bits plus the smaller of these losses.
    """

    def __init__(self, bitmaps: list[np.ndarray], sizes: list[int], order: list[int]):
        words = min(len(b) for b in bitmaps)
        self.bits = np.stack([folded(b, words) for b in bitmaps])
        self.size = np.array(sizes)
        self.loss = self.size - np.bitwise_count(self.bits).sum(1)
        nodes = [order[lo : lo + LEAF] for lo in range(0, len(order), LEAF)]
        self.nodes = [self._node(members, None) for members in nodes]
        level = list(range(len(nodes)))
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = []
            for pair in pairs:
                members = [m for p in pair for m in self.nodes[p]["members"]]
                self.nodes.append(self._node(members, pair))
                level.append(len(self.nodes) - 1)
        self.root = level[0]

    def leaf(self, i: int) -> dict:
        n = int(self.size[i])
        return {"bits": self.bits[i], "low": n, "high": n, "loss": int(self.loss[i])}

    def _node(self, members: list[int], children: list[int] | None) -> dict:
        return {
            "members": members, "children": children if children and len(children) > 1 else (self.nodes[children[0]]["children"] if children else None),
            "bits": np.bitwise_or.reduce(self.bits[members], axis=0), "low": int(self.size[members].min()), "high": int(self.size[members].max()), "loss": int(self.loss[members].max()),
        }


class Linker:
    """Finds links between sets of one or two trees until every two that can be joined by links are; without sets, what may link.

    A pair of nodes goes if their sizes are too far apart, if the overlap they
    can have at most is below what their smallest sizes need, or if all their
    sets are connected already: what counts is which sets hang together.
    """

    def __init__(self, sizes: list[int], percent: int, sets: list[np.ndarray] | None = None):
        self.sizes, self.percent, self.sets = sizes, percent, sets
        self.parent = list(range(len(sizes)))
        self.links: list[tuple[int, int]] = []
        self.open: set[int] = set()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if min(len(a), len(b)) * 100 < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def possible(self, a: dict, b: dict) -> bool:
        if a["high"] * 100 < self.percent * b["low"] or b["high"] * 100 < self.percent * a["low"]:
            return False
        need = -(-self.percent * (a["low"] + b["low"]) // (100 + self.percent))
        if min(a["high"], b["high"]) < need:
            return False
        words = min(len(a["bits"]), len(b["bits"]))
        x, y, lost = a["bits"], b["bits"], min(a["loss"], b["loss"])
        if len(x) != len(y):  # the wider one folds; it can lose more tokens then, the narrower one as many as before
            x, y = folded(x, words), folded(y, words)
            lost = a["loss"] if len(a["bits"]) == words else b["loss"]
        return int(np.bitwise_count(x & y).sum()) + lost >= need

    def traverse(self, one: Tree, two: Tree, of_one: list[int], of_two: list[int]) -> None:
        """of_one, of_two: the numbers here of the trees' sets. One tree against itself meets every pair once."""
        same = one is two
        stack = [(one.root, two.root)]
        while stack:
            p, q = stack.pop()
            a, b = one.nodes[p], two.nodes[q]
            if not self.possible(a, b):
                continue
            roots = {self.find(of_one[i]) for i in a["members"]} | {self.find(of_two[i]) for i in b["members"]}
            if len(roots) == 1:
                continue
            if a["children"] and (not b["children"] or len(a["members"]) >= len(b["members"])):
                if same and p == q:
                    x, y = a["children"]
                    stack += [(x, y), (y, y), (x, x)]
                else:
                    stack += [(c, q) for c in a["children"]]
            elif b["children"]:
                stack += [(p, c) for c in b["children"]]
            else:
                for at, i in enumerate(a["members"]):
                    for j in b["members"][at + 1 :] if same and p == q else b["members"]:
                        self.meet(of_one[i], of_two[j], one, i, two, j)

    def meet(self, x: int, y: int, one: Tree, i: int, two: Tree, j: int) -> None:
        """Two sets: with the sets at hand they are linked or not; with bitmaps alone they stay open unless the bound parts them."""
        if self.find(x) == self.find(y) or (self.sets is None and x in self.open and y in self.open):
            return
        if not self.possible(one.leaf(i), two.leaf(j)):
            return
        if self.sets is None:
            self.open |= {x, y}
        elif self.linked(x, y):
            self.links.append((x, y))
            self.join(x, y)


def _grouped(names: list[str], work, out_names: list[str], out_types: list):
    """Run ``work`` on the rows of each (cluster, left, right) of a sorted stream; a group is a few blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(out_names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out_types)], out_names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                columns = [part.column(n).to_pylist() if n != "tokens" else [np.array(t, np.int64).view(np.uint64) for t in _arrays(part.column(n))] for n in names]
                for row in zip(*columns):
                    if row[:3] != at:
                        out += work(at, rows) if len(rows) > 1 else []
                        at, rows = row[:3], []
                    rows.append(row[3:])
            yield batch_of()
            out.clear()
        out += work(at, rows) if len(rows) > 1 else []
        yield batch_of()

    return run


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def _linker(rows: list[tuple], sizes: list[int], bitmaps: list[np.ndarray], percent: int, sets=None) -> Linker:
    """Traverse the trees of a group: side 1 with side 0 and, unless the group is a pair of blocks, side 0 with itself.

    ``rows`` are (side, digest, mark, across); sets of one mark hang together already.
    """
    linker, marks = Linker(sizes, percent, sets), {}
    for i, (_, _, mark, _) in enumerate(rows):
        if mark is not None:
            linker.join(marks.setdefault(mark, i), i)
    sides, trees = [[i for i, r in enumerate(rows) if r[0] == side] for side in (0, 1)], []
    for own in sides:
        key = (lambda i: (int(sets[own[i]][0]), sizes[own[i]])) if sets else (lambda i: sizes[own[i]])  # noqa: B023  near copies tend to share their least token
        trees.append(Tree([bitmaps[i] for i in own], [sizes[i] for i in own], sorted(range(len(own)), key=key)) if own else None)
    if trees[0] and trees[1]:
        linker.traverse(trees[1], trees[0], sides[1], sides[0])
    if trees[0] and not any(r[3] for r in rows):
        linker.traverse(trees[0], trees[0], sides[0], sides[0])
    return linker


def _prune(percent: int):
    """Rows (side, digest, mark, across, n, bits) -> those that may link with another row of their group, by bitmaps alone."""

    def work(at, rows):
        linker = _linker([r[:4] for r in rows], [r[4] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], percent)
        return [(*at, *rows[i][:4]) for i in sorted(linker.open)]

    return work


def _join(percent: int):
    """Rows (side, digest, mark, across, tokens) -> (a, b): each set that found a link, with the smallest of what it hangs together with."""

    def work(at, rows):
        sets = [r[4] for r in rows]
        bitmaps = [np.frombuffer(bitmap_of(s), np.uint64) for s in sets]
        linker = _linker([r[:4] for r in rows], [len(s) for s in sets], bitmaps, percent, sets)
        linked = {linker.find(i) for i, _ in linker.links}
        least: dict[int, bytes] = {}
        for i, r in enumerate(rows):
            root = linker.find(i)
            if root in linked:
                least[root] = min(r[1], least.get(root, r[1]))
        return [(least[root], r[1]) for i, r in enumerate(rows) if (root := linker.find(i)) in linked and r[1] != least[root]]

    return work


_GROUP = ["cluster", "left", "right"]
_ROW = [*_GROUP, "side", "digest", "mark", "across"]


def _links(rows: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Links among the rows of each group.

    Bitmaps (a quarter byte a token) go first; sets, made from the texts again,
    follow only for what the bitmaps leave open.
    """
    kinds = "cluster long, left int, right int, side int, digest binary, mark binary, across boolean"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
    known = rows.select(*_ROW).join(classes.select("digest", "n", "bits"), "digest")
    # A fixed number of parts: groups are few bytes and much work, so they must not be put together by size.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.select(*_ROW, "n", "bits").repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)
    left = stored(dealt.mapInArrow(_grouped([*_ROW, "n", "bits"], _prune(percent), _ROW, types), kinds), f"{name}_open")
    wanted = left.select("digest").distinct().join(classes.select("digest", F.col("doc_id").alias("_doc")), "digest")
    met = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_doc"])).select("digest", "text")
    sets = met.mapInArrow(_token_rows(size), "digest binary, found binary, tokens array<long>").where("found = digest").drop("found")
    sets = stored(sets.groupBy("digest").agg(F.first("tokens").alias("tokens")), f"{name}_sets")  # rows of one id: one is enough
    dealt = left.join(sets, "digest").select(*_ROW, "tokens").repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)
    return stored(dealt.mapInArrow(_grouped([*_ROW, "tokens"], _join(percent), ["a", "b"], [pa.binary(), pa.binary()]), "a binary, b binary"), name, keep=True)


def _token_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = _sets_of(part, size, numbers)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                digest = pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("digest"), digest, pa.ListArray.from_arrays(offsets, pa.array(values))], ["digest", "found", "tokens"])
        numbers.clear()
        give_back()

    return run


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text).

    Sets of ``size``-word shingles link when their Jaccard similarity is at
    least ``percent`` %; component_id is the smallest doc_id reachable by links.

    1. Every set is cut into parts such that linked sets share one (``Levels``);
       the sets that share a part are a group. Equal sets are one from here on.
    2. Every set meets the hub of the star it shares most parts with, in blocks
       of about ``block`` sets: signature trees, joined with the hub's and with
       themselves. Near copies are connected now, at work that is linear in them.
    3. Groups that are not connected whole are compared, tree against tree. A
       set leaves those of more than ``block`` sets if it shares more parts with
       any partner than it has in such groups (``_rest_rows``). So any two sets
       that could link are compared, bounded away, or connected.

    Sets are numbers of 64 bits a shingle, and equal where their 128-bit digests
    are.

    Empty and null texts have no shingles and are their own component; a null
    doc_id takes part and never is a component's name unless nothing else is in
    it; rows repeated whole link like any equal sets.
    """
    return _grouped_documents(docs, size, percent, block).select("doc_id", "n_shingles", "component_id")


def _grouped_documents(docs: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """``near_duplicates`` with th, the key of a row's text, and component_th, that of the document the component is named by."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = given.withColumn("th", text_key(F.col("text")))
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark):
        with scratch(spark):
            kinds = "doc_id long, th long, n long, digest binary, bits binary, keys binary, even int, odd int"
            described = stored(keyed.mapInArrow(_described(size, percent), kinds), "described")
            groups = stored(candidate_groups(described), "groups", keep=True)
            own = stored(described.select("doc_id", "th", "n", "digest"), "documents", keep=True)
            classes = described.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "bits", "even", "odd")])
            classes = classes.withColumn("node", node_of("digest")).join(groups.select("node").distinct(), "node", "left_semi")
            classes = stored(classes, "classes", keep=True)
        digests = classes.select("node", "digest")
        with scratch(spark):
            links = _links(_stars_rows(groups, digests, block), given, classes, size, percent, "links")
        with scratch(spark):
            rows = _rest_rows(groups, classes, components(links), block)
            if rows is not None:
                links = links.unionByName(_links(rows, given, classes, size, percent, "rest"))
        return stored(_named(own, links), "named", keep=True)


def _stars_rows(groups: DataFrame, digests: DataFrame, block: int) -> DataFrame:
    """Blocks of the sets that meet one hub, and the hub in each of them."""
    weights = groups.where("hub <> node").groupBy("hub", "node").agg(F.count("*").alias("weight"))
    best = weights.groupBy("node").agg(F.max(F.struct("weight", (-F.col("hub")).alias("h"), "hub"))["hub"].alias("cluster"))
    best = stored(best, "best")
    sizes = stored(best.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")), "stars_of")
    none, inside = F.lit(None).cast("binary").alias("mark"), F.lit(False).alias("across")
    place = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("left")
    members = best.join(sizes, "cluster").join(digests, "node").select("cluster", place, F.lit(-1).alias("right"), F.lit(0).alias("side"), "digest", none, inside)
    hubs = sizes.join(digests.withColumnRenamed("node", "cluster"), "cluster").withColumn("left", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hubs = hubs.select("cluster", "left", F.lit(-1).alias("right"), F.lit(1).alias("side"), "digest", none, inside)
    return members.unionByName(hubs)


def _rest_rows(groups: DataFrame, classes: DataFrame, marks: DataFrame, block: int) -> DataFrame | None:
    """Of what is not connected whole: the sets outside the main component (side 1) and all blocks (side 0).

    A group of at most ``block`` sets is compared as it is, and groups with the
    same sets once. A larger one, such as the many documents that hold one
    passage, matters only to sets that have too many such parts: linked sets
    share a known number of parts, so a set with fewer parts in large groups
    shares one with its partner in a small group too, and leaves the large ones.
    What stays is put together where groups have the same main component.
    """
    held = groups.join(classes.select("node", "digest"), "node").select("key", "digest").distinct().join(marks.select(F.col("node").alias("digest"), "component"), "digest", "left")
    held = stored(held.withColumn("mark", F.coalesce("component", "digest")).select("key", "digest", "mark"), "held")
    ends = [F.min("mark").alias("m1"), F.max("mark").alias("m2"), F.count("*").alias("n")]
    sums = [F.sum(F.xxhash64("digest", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    apart = stored(held.groupBy("key").agg(*ends, *sums).where("m1 <> m2").select("key", "n", "s1", "s2"), "apart")
    if apart.isEmpty():
        return None
    once = lambda groups: groups.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key", "n")
    none, inside = F.lit(-1).alias("right"), F.lit(False).alias("across")
    small = held.join(once(apart.where(F.col("n") <= block)).select("key"), "key")
    rows = small.select(F.col("key").alias("cluster"), F.lit(0).alias("left"), none, F.lit(0).alias("side"), "digest", "mark", inside)
    large = stored(held.join(apart.where(F.col("n") > block).select("key"), "key"), "large")
    crowded = None if large.isEmpty() else _crowded(large, classes)
    return rows if crowded is None or crowded.isEmpty() else rows.unionByName(_block_pairs(crowded, block))


def _crowded(large: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster, main, digest, mark): of the large groups (key, digest, mark) the sets that cannot leave them."""
    level = F.pmod("key", F.lit(2)).alias("level")
    often = large.groupBy("digest", level).agg(F.count("*").alias("often")).join(classes.select("digest", "even", "odd"), "digest")
    full = often.where(F.col("often") >= F.when(F.col("level") == 0, F.col("even")).otherwise(F.col("odd"))).select("digest", "level")
    left = stored(large.withColumn("level", level).join(full, ["digest", "level"]).drop("level"), "left")
    first = F.min(F.struct("n", "mark"))["mark"].alias("main")  # the component with most sets, the smallest of equals
    main = left.groupBy("key", "mark").agg((-F.count("*")).alias("n")).groupBy("key").agg(first, F.count("*").alias("marks")).where("marks > 1")
    return stored(left.join(main, "key").select(F.xxhash64("main").alias("cluster"), "main", "digest", "mark").distinct(), "crowded")


def _block_pairs(crowded: DataFrame, block: int) -> DataFrame:
    """The blocks of what is outside a cluster's main component against all of the cluster's blocks."""
    sizes = stored(crowded.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("mark") != F.col("main")) / F.lit(block)).cast("int").alias("lefts")), "clusters")
    rows, across = crowded.join(sizes, "cluster"), F.lit(True).alias("across")
    place = lambda salt, n: F.pmod(F.xxhash64("digest", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where("mark <> main").withColumn("left", place(1, "lefts")).withColumn("right", every("blocks")).select("cluster", "left", "right", F.lit(1).alias("side"), "digest", "mark", across)
    two = rows.withColumn("right", place(0, "blocks")).withColumn("left", every("lefts")).select("cluster", "left", "right", F.lit(0).alias("side"), "digest", "mark", across)
    return one.unionByName(two)


def _named(described: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the digests, then the smallest (id, text key) of each component's documents."""
    groups = components(links).withColumnRenamed("node", "digest")
    of = described.select("doc_id", "th", "n", "digest")
    document = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))
    named = stored(of.where("digest IS NOT NULL").groupBy("digest").agg(F.min(document).alias("least")).join(groups, "digest", "left").select("digest", "least", F.coalesce("component", "digest").alias("component")), "classes")
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    ids = stored(named.join(least, "component").select(F.col("digest").alias("_digest"), "first"), "ids")
    joined = of.join(ids, of["digest"] == ids["_digest"], "left")
    own = F.col("digest").isNull()
    return joined.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.when(own, F.col("th")).otherwise(F.col("first.th")).alias("component_th"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The documents without near duplicates: of each component the smallest document by (doc_id, text key) stays.

    A document is a distinct (doc_id, text): an id with several texts loses
    those that another document stands for, and no others. Null ids, empty and
    null texts stay, and so do all rows of a document that stays.
    """
    with scratch(docs.sparkSession):
        found = _grouped_documents(docs, size, percent, block)
        gone = found.where("doc_id IS NOT NULL AND component_id IS NOT NULL AND (doc_id <> component_id OR th <> component_th)")
        gone = stored(gone.select(F.col("doc_id").alias("_gone"), F.col("th").alias("_text")).distinct(), "gone", keep=True)
    agrees = (F.col("_row.doc_id").cast("long") == F.col("_gone")) & (text_key(F.col("_row.text")) == F.col("_text"))
    return packed(docs).join(gone, agrees, "left_anti").select(*unpacked(docs.columns))
