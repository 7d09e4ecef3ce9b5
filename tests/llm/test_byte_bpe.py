"""Byte-level BPE against the tiktoken library, and back to the bytes."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import byte_bpe
from loomstone.llm.queries import QUERIES, vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def texts():
    rng = random.Random(4)
    out = ["", None, " ", "\n\n  \n", "Hello world, it's 2024!!  don't", "日本語 text 💡💡", "<|endoftext|>", "a" * 700, "ab" * 400, "    \t x", "é" * 300, "=" * 900]
    out += ["".join(rng.choice("abcdefgh \n0123.,'!äß日") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    return out + ["word and more " * 20_000, out[4]]


def test_equals_tiktoken(spark, reference):
    rows = [(None if i == 7 else i, t, 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int").repartition(3)
    got = byte_bpe.encode(docs, *vocabulary())
    found = {r["doc_id"]: r for r in got.collect()}
    for i, text, _ in rows:
        assert list(found[i]["ids"]) == reference.encode_ordinary(text or ""), text
        assert bytes(found[i]["decoded"]) == (text or "").encode()
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(got, vocabulary()[0]).collect()}
    assert back == {r[0]: (r[1] or "").encode() for r in rows}


def test_query_digests(spark, reference):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, sf).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_empty_table_and_small_memory(spark, reference, monkeypatch):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), *vocabulary()).count() == 0
    merger = byte_bpe.Merger(byte_bpe.read_ranks(vocabulary()[0]))
    words = [b"z" * 300, b"hello", b" the", bytes(range(256))]
    ids = merger.merge(words)
    one = lambda i: ids.take(np.array([i]))
    assert [one(i).tolist() for i in range(3)] == [reference.encode_ordinary(w.decode()) for w in words[:3]]
    assert merger.spell(ids.values, ids.sizes) == words
    monkeypatch.setattr(byte_bpe, "ROWS", 5)  # several aggregations, and one of a row that is longer
    assert merger.spell(np.concatenate([ids.values, ids.values]), np.concatenate([[0], ids.sizes, [0], ids.sizes, [0, 0]])) == [b"", *words, b"", *words, b"", b""]


def test_decoded_comes_from_the_emitted_ids(reference, monkeypatch):
    """Lists put together wrongly must show: decoded follows the ids, not the words."""
    path, pattern = vocabulary()
    text = "Hello world, it's 2024 zzzzqqq"
    take = byte_bpe.Pieces.take
    monkeypatch.setattr(byte_bpe.Pieces, "take", lambda self, words: take(self, words)[::-1] if self.values.dtype == np.int32 else take(self, words))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([text, ""])], ["doc_id", "text"])
    (out,) = byte_bpe._encoded(SimpleNamespace(value=byte_bpe.read_ranks(path)), pattern, ["doc_id"])(iter([batch]))
    ids, decoded = out.column("ids").to_pylist(), out.column("decoded").to_pylist()
    assert ids == [reference.encode_ordinary(text)[::-1], []]
    assert decoded == [reference.decode_bytes(ids[0]), b""] and decoded[0] != text.encode()


def test_a_task_holds_a_bounded_part(monkeypatch):
    path, pattern = vocabulary()

    class Ranks:
        value = byte_bpe.read_ranks(path)

    held, rows = [], []
    merge, spell = byte_bpe.Merger.merge, byte_bpe.Merger.spell
    monkeypatch.setattr(byte_bpe.Merger, "merge", lambda self, words: held.append(sum(map(len, words))) or merge(self, words))
    monkeypatch.setattr(byte_bpe.Merger, "spell", lambda self, tokens, sizes: rows.append(len(tokens)) or spell(self, tokens, sizes))
    texts = [" ".join(f"w{i * 7919 + j}" for j in range(3000)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(byte_bpe._encoded(Ranks, pattern, ["doc_id"])(iter([batch])))
    assert [d.decode() for o in out for d in o.column("decoded").to_pylist()] == texts
    assert max(held) <= 260_000 and max(rows) <= 500_000 and sum(held) > 300_000


def test_words_met_often_are_not_forgotten(reference, monkeypatch):
    """New words push out those met once, not those of every text."""
    path, pattern = vocabulary()
    learned = []
    merge = byte_bpe.Merger.merge
    monkeypatch.setattr(byte_bpe, "KNOWN", 20)
    monkeypatch.setattr(byte_bpe, "CHUNK", 1)
    monkeypatch.setattr(byte_bpe.Merger, "merge", lambda self, words: learned.extend(words) or merge(self, words))
    texts = ["zqzq" + "".join(f" zqzq qxqx w{i * 7919 + j}v" for j in range(4)) for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(byte_bpe._encoded(SimpleNamespace(value=byte_bpe.read_ranks(path)), pattern, ["doc_id"])(iter([batch])))
    assert [i for o in out for i in o.column("ids").to_pylist()] == [reference.encode_ordinary(t) for t in texts]
    assert [d.decode() for o in out for d in o.column("decoded").to_pylist()] == texts
    assert learned.count(b" zqzq") == 1 and learned.count(b" qxqx") == 1
