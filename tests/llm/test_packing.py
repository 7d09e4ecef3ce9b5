"""Best-fit packing: whole pieces, gapless sequences, fewer sequences than best fit alone, ids of the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomstone.llm import packing
from loomstone.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


def filled(rows, capacity):
    """Checks that sequences are gapless and not above capacity; their fills."""
    by = {}
    for r in rows:
        if r["sequence_id"] is not None:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in m) for m in by.values()]


def slow_ids(texts):
    t = Tokenizer.from_file(tokenizer()[0])
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_query_against_the_tokenizer(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = dict(zip(docs, slow_ids(list(docs.values()))))
    rows = QUERIES["op13_best_fit_packing"](spark, SF).collect()
    own = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        own.setdefault(r["doc_id"], []).append(r)
    assert set(own) == set(docs)
    for doc, pieces in own.items():
        whole = np.array([*ids[doc], 2], dtype="<u4")
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(whole[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(whole)
        assert len(pieces) == 1 or all(p["length"] == 1024 for p in pieces[1:])
        assert len(pieces) == -(-len(whole) // 1024)
    fills = filled(rows, 1024)
    assert len(fills) <= 1.02 * sum(fills) / 1024 + 1


def test_rows_of_all_kinds(spark):
    blanks = " " * 6000 + "end" + "\n" * 3000
    texts = [None, "", "One.", "One.", "<|endoftext|> stays text", blanks, "wort " * 3000, "ä" * 5000, "a" * 20_000]
    rows = [(None if i == 3 else i, t, 7, "x") for i, t in enumerate(texts)] + [(2, "One.", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, extra string")
    cut = packing.pieces(docs, *tokenizer(), capacity=64).collect()
    assert cut[0].asDict().keys() == {"doc_id", "extra", "piece", "start", "length", "ids"}
    found = {}
    for r in sorted((r for r in cut if r["doc_id"] not in (None, 2)), key=lambda r: (r["doc_id"], r["piece"])):
        found.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    want = slow_ids([t or "" for t in texts])
    assert found == {i: [*ids, 2] for i, ids in enumerate(want) if i not in (2, 3)}
    assert sum(r["doc_id"] == 2 for r in cut) == 2 and sum(r["doc_id"] is None for r in cut) == 1
    placed = packing.pack(spark.createDataFrame(cut), capacity=64)
    assert placed.columns == ["doc_id", "extra", "piece", "start", "length", "ids", "sequence_id", "offset"]
    kept = placed.collect()
    assert len(kept) == len(cut)
    fills = filled(kept, 64)
    whole = packing.sequences(placed).collect()
    assert sorted(len(r["ids"]) // 4 for r in whole) == sorted(fills)
    assert sorted(x for r in whole for x in np.frombuffer(r["ids"], "<u4")) == sorted(x for r in cut for x in np.frombuffer(r["ids"], "<u4"))


def test_empty_table_and_odd_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(none, *tokenizer())).collect() == []
    odd = spark.createDataFrame([(1, None, "a"), (2, 0, "a"), (3, 9, "a"), (4, -1, "a"), (5, 8, "a"), (6, 3, "a")], "doc_id long, length long, Sequence_ID string")
    placed = packing.pack(odd, capacity=8)
    assert placed.columns == ["doc_id", "length", "sequence_id", "offset"]
    rows = {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in placed.collect()}
    assert {d for d, place in rows.items() if place == (None, None)} == {1, 2, 3, 4}
    assert rows[5][1] == rows[6][1] == 0 and rows[5][0] != rows[6][0]


def test_several_shards_and_rounds(spark):
    rng = random.Random(5)
    lengths = [rng.randint(20, 60) for _ in range(6000)] + [37] * 3000  # a third of all rows alike
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(7)
    kept = packing.pack(rows, capacity=100, shard=500).collect()
    assert sorted((r["doc_id"], r["length"]) for r in kept) == list(enumerate(lengths))
    fills = filled(kept, 100)
    alone = packing.best_fit(lengths, 100)
    assert len(fills) <= 1.02 * len(alone)
    again = packing.pack(rows, capacity=100, shard=500)
    assert len({r["sequence_id"] for r in again.collect()}) == len(fills)


def square(bins, sizes):
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


@pytest.mark.parametrize("low, high", [(1, 99), (20, 60), (30, 40), (51, 70), (1, 3)])
def test_local_search_only_gains(low, high):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(700)]
    bins = packing.best_fit(sizes, 100)
    better = packing.improve([list(b) for b in bins], sizes, 100)
    assert sorted(i for b in better for i in b) == list(range(700)) and all(sum(sizes[i] for i in b) <= 100 for b in better)
    assert len(better) <= len(bins) and square(better, sizes) >= square(bins, sizes)


def test_exchanges():
    one = lambda bins, sizes: sorted(sorted(sizes[i] for i in b) for b in packing.improve(bins, sizes, 10))
    assert one([[0], [1]], [4, 6]) == [[4, 6]]  # a move empties a bin
    assert one([[0, 1], [2, 3]], [6, 3, 4, 2]) == [[2, 3], [4, 6]]  # one for one
    assert one([[0, 1], [2, 3]], [6, 3, 2, 2]) == [[2, 2, 6], [3]]  # two for one
