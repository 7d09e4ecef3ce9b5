"""Conversation prefix trie: range-partitioned paths, nodes finished in sorted shards, a broadcast skeleton for those that cross shards."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import WORD, stored

TOKEN = 16  # bytes that stand for a turn in a path
SHARD = 4096  # conversations of a shard, as long as there are no more than MOST shards
MOST = 2000  # shards, and so splitters, whatever the input holds
SAMPLE = 10  # conversations looked at for every splitter
DEEPEST = 256  # turns of a splitter
CHUNK = 65_536  # ids of members that one row carries

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its twenty."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def paths(conversations: DataFrame, group: int = 20) -> DataFrame:
    """(conv_id, path, words) of every rebuilt conversation: 16 bytes and a word count for each of its turns, no text.

    Turns go by number, null first; turns of one number by role and then by
    digest, so repeated rows are turns of their own. Null roles and texts are
    empty; rows without a conversation take no part. The digest is one of role
    and text together (the first half of a SHA-256); what it is equal for counts
    as equal. A conversation is one row of 16 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TOKEN)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), token.alias("token"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t")
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["token"], t["words"])))
    own = stored(own, "turns")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 3).alias("_head"))
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).join(first, "_base", "left").withColumn("_h", heads(F.col("conv_id")))
    head = F.when(F.col("_head").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    rebuilt = F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns")))
    made = joined.select("conv_id", rebuilt.alias("turns"))
    return made.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["token"]), "")).alias("path"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words"))


def splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Where one shard ends and the next begins, as (path, conv_id): quantiles of a bounded sample.

    A long path is cut, to a splitter before all that begins with it; copies of
    one conversation are parted by their ids.
    """
    if shards < 2:
        return []
    some = rows.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * shards).select(F.substring("path", 1, DEEPEST * TOKEN).alias("path"), "conv_id", F.length("path").alias("n")).collect()
    cut = sorted({(bytes(r["path"]), r["conv_id"] if r["n"] <= DEEPEST * TOKEN else -(1 << 63)) for r in some})
    return sorted({cut[len(cut) * i // shards] for i in range(1, shards)})


class Skeleton:
    """The trie of the splitter paths. Only its nodes can have members on both sides of a splitter, as such a node's path begins the splitter's.

    Node 0 is the root, and a parent's number is below its children's.
    """

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.parent, self.depth, self.of = [-1], [0], {}
        for path, _ in cuts:
            at = 0
            for lo in range(0, len(path), TOKEN):
                step = (at, path[lo : lo + TOKEN])
                if step not in self.of:
                    self.of[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.of[step]

    def child(self, at: int, token: bytes) -> int:
        return self.of.get((at, token), -1) if at >= 0 else -1


class Node:
    """A node that is open: its path begins the one just read."""

    __slots__ = ("children", "chunk", "conv", "convs", "ended", "ends", "kids", "leaves", "saved", "sk", "words")

    def __init__(self, sk: int, words: int):
        self.sk, self.words = sk, words
        self.conv: int | None = None
        self.convs = self.ended = self.children = self.leaves = self.saved = 0
        self.kids: list[tuple] = []  # finished children, which wait for this node's smallest member
        self.ends, self.chunk = None, []

    def member(self, conv: int) -> None:
        self.conv = conv if self.conv is None else min(conv, self.conv)


COLUMNS = ["kind", "sk", "seq", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "words", "ids"]
KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.string()]
SCHEMA = f"kind int, sk int, seq long, {NODE}, words long, ids string"


class Shard:
    """One pass over a shard's conversations in order of (path, id).

    Rows it gives: kind 0, a finished node; ``sk`` is its parent's number in the
    skeleton, or -1 if parent_conv_id is known. kind 1: what a skeleton node has
    in this shard. kind 2: ids, in order, of members that end at a skeleton node.
    """

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.path, self.out, self.seq = skeleton, b"", [], 0
        self.open = [Node(0, 0)]

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        keep = len(path) if path == self.path else self.common(path)
        while len(self.open) > keep // TOKEN + 1:
            self.close()
        for lo in range(keep, len(path), TOKEN):
            self.open.append(Node(self.skeleton.child(self.open[-1].sk, path[lo : lo + TOKEN]), words[lo // TOKEN]))
        self.path, last = path, self.open[-1]
        last.member(conv)
        last.ended += 1
        if last.sk >= 0:
            last.chunk.append(str(conv))
            if len(last.chunk) == CHUNK:
                self.write(last)
        elif last.ends is None:
            last.ends = sha256(str(conv).encode())
        else:
            last.ends.update(b",%d" % conv)

    def common(self, path: bytes) -> int:
        at, most = 0, min(len(path), len(self.path))
        while at < most and path[at : at + TOKEN] == self.path[at : at + TOKEN]:
            at += TOKEN
        return at

    def write(self, node: Node) -> None:
        if node.chunk:
            self.out.append((2, node.sk, self.seq, *[None] * 9, ",".join(node.chunk)))
            self.seq += 1
            node.chunk = []

    def close(self) -> None:
        depth, node = len(self.open) - 1, self.open.pop()
        above = self.open[-1] if self.open else None
        if node.sk >= 0:  # its children in the skeleton are added when all shards' sums are known
            self.write(node)
            self.out.append((1, node.sk, None, node.conv, depth, None, node.convs + node.ended, node.children, node.leaves, node.saved, None, node.words, None))
            return
        convs = node.convs + node.ended
        leaves, saved = node.leaves if node.children else 1, node.saved + (convs - 1) * node.words
        self.out += [(0, -1, None, *kid[:2], node.conv, *kid[2:], None, None) for kid in node.kids]
        above.member(node.conv)
        above.convs += convs
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        ends = (node.ends or sha256()).hexdigest()
        if above.sk >= 0:
            self.out.append((0, above.sk, None, node.conv, depth, None, convs, node.children, leaves, saved, ends, None, None))
        else:
            above.kids.append((node.conv, depth, convs, node.children, leaves, saved, ends))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [[]] * len(COLUMNS)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], COLUMNS)


def _dealt(cuts):
    """Rows -> the same rows with the number of their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = cuts.value
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(ends, k) for k in keys], pa.int32())], [*batch.schema.names, "shard"])

    return run


def _walked(cuts):
    """Sorted rows of one shard -> its nodes. A task may hold no shard, or exactly one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(Skeleton(cuts.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                for row in zip(*(part.column(c).to_pylist() for c in ("conv_id", "path", "words"))):
                    shard.add(*row)
                yield shard.batch()
        while shard.open:
            shard.close()
        yield shard.batch()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids sorted by (node, shard, place) -> a digest per node. SHA-256 takes its input in order, so a node's chunks pass one task, one at a time."""
    at, state = None, sha256()
    for batch in batches:
        for sk, ids in zip(batch.column("sk").to_pylist(), batch.column("ids")):
            if sk != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([state.hexdigest()])], ["sk", "ends_sha256"])
                at, state = sk, sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([state.hexdigest()])], ["sk", "ends_sha256"])


def rolled_up(skeleton: Skeleton, parts: dict[int, dict]) -> list[tuple]:
    """(sk, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of the skeleton's nodes from the sums of their parts, children first."""
    n = len(skeleton.parent)
    zero = {"conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "words": 0}
    own = [dict(parts.get(i, zero)) for i in range(n)]
    for i in range(n - 1, -1, -1):
        node = own[i]
        if not node["n_children"]:
            node["n_leaves"] = 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        if i and node["n_convs"]:
            above = own[skeleton.parent[i]]
            above["n_children"] += 1
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                above[c] += node[c]
            above["conv_id"] = node["conv_id"] if above["conv_id"] is None else min(above["conv_id"], node["conv_id"])
    parent = lambda i: own[skeleton.parent[i]]["conv_id"] if i else None
    return [(i, x["conv_id"], skeleton.depth[i], parent(i), *(x[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))) for i, x in enumerate(own) if x["n_convs"]]


def trie(rows: DataFrame, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """A row for every node of the trie of ``rows`` (conv_id, path, words); see ``prefix_trie``.

    Conversations are dealt by range of (path, conv_id), so copies of one may
    fill several shards, and each shard reads its own in order. A node whose
    members all lie in one shard is finished there, on a stack of open nodes.
    The rest begin the path of a splitter: the trie of at most ``most`` splitter
    paths of at most 256 turns goes to every task, the shards give sums for its
    nodes, the sums meet in one aggregation, and the driver adds them up the
    skeleton, whose size does not follow the data.
    """
    spark = rows.sparkSession
    rows = stored(rows, "paths")
    shards = max(1, min(most, -(-rows.count() // shard)))
    found = splitters(rows, shards)
    cuts, skeleton = spark.sparkContext.broadcast(found), Skeleton(found)
    dealt = rows.mapInArrow(_dealt(cuts), "conv_id long, path binary, words array<int>, shard int")
    sorted_ = dealt.repartitionById(len(found) + 1, "shard").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "words")
    walked = stored(sorted_.mapInArrow(_walked(cuts), SCHEMA).withColumn("part", F.spark_partition_id()), "walked")

    sums = walked.where("kind = 1").groupBy("sk").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"))
    top = rolled_up(skeleton, {r["sk"]: r.asDict() for r in sums.collect()})
    top = spark.createDataFrame(top, "sk int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    chunks = walked.where("kind = 2").select("sk", "part", "seq", "ids").repartition("sk").sortWithinPartitions("sk", "part", "seq").select("sk", "ids")
    ends = chunks.mapInArrow(_hashed, "sk int, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = F.lit(sha256().hexdigest())
    above = top.join(ends, "sk", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(*columns)
    done = walked.where("kind = 0 AND sk = -1").select(*columns)
    below = walked.where("kind = 0 AND sk >= 0").drop("parent_conv_id").join(top.select("sk", F.col("conv_id").alias("parent_conv_id")), "sk").select(*columns)
    return done.unionByName(below).unionByName(above)


def prefix_trie(conversations: DataFrame, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """The prefix trie of all rebuilt conversations of (conv_id, turn, role, text), a row per node.

    conv_id (the smallest member), depth, parent_conv_id (null for the root),
    n_convs (members), n_children, n_leaves (childless nodes below it, or
    itself), saved_tokens (over its subtree, words of a node's last text that
    its members but one repeat), ends_sha256 (of the ids of members that end
    here, by number, joined by commas). Other columns are not read. See
    ``paths`` for nulls, ties and repeated rows; a conversation without turns is
    a member of the root alone; without conversations there is no node.
    """
    return trie(paths(conversations.select("conv_id", "turn", "role", "text")), shard, most)
