"""The prefix trie against one built whole in a dictionary."""

import random
import zlib
from hashlib import sha256

import pytest

from loomstone.llm import prefix_trie
from loomstone.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, PATH string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []

    def sums(p):
        words = len(p[-1][1].encode().split()) if p else 0
        leaves, saved = 0, (len(members[p]) - 1) * words
        for q in kids[p]:
            below = sums(q)
            leaves, saved = leaves + below[0], saved + below[1]
        leaves = leaves or 1
        ends = ",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        sums(())
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **options).collect()), key=str)


def corpus():
    rng = random.Random(4)
    say = ["", None, "a", "a b", "one two\tthree", "yes", "no no"]
    rows = []
    for c in [*range(-45, 130), *range(200, 420, 3)]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(say)))
    rows += [(c, t, "user", "copy") for c in range(1000, 1200) for t in range(4)]  # a hot group of copies
    rows += [(c, 0, "system", f"own {c}") for c in range(2000, 2100)]
    rows += [(7, None, None, None), (7, None, "user", "z"), (8, 0, "user", "twice"), (8, 0, "user", "twice"), (None, 0, "user", "nobody")]
    rows += [(3000, t, "user", f"long {t % 3}") for t in range(400)] + [(c, t, "user", f"long {t % 3}") for c in range(3020, 3200, 20) for t in range(399)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard": 20}, {"shard": 3, "most": 60}])
def test_equals_a_whole_trie(spark, options):
    rows = corpus()
    assert run(spark, rows, **options) == brute(rows)


def test_none_and_one(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []
    assert run(spark, [(20, 0, "user", "x")]) == brute([(20, 0, "user", "x")])
    no_turns = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "x") for c in no_turns]  # they give their turn for those of a conversation that is not there
    assert run(spark, rows, shard=1) == brute(rows)
    assert run(spark, rows, shard=1)[0][1] == 0


def test_long_splitters_are_cut(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEEPEST", 2)
    rows = corpus()
    assert run(spark, rows, shard=10) == brute(rows)


def test_digests_of_members_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    shard = prefix_trie.Shard(prefix_trie.Skeleton([(b"x" * 16, 5)]))
    for c in range(10):
        shard.add(c, b"x" * 16, [1])
    while shard.open:
        shard.close()
    assert [r[-1] for r in shard.out if r[0] == 2] == ["0,1,2", "3,4,5", "6,7,8", "9"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, sf).collect()), key=str) == brute(rows)
