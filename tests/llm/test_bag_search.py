"""Ranked lexical search against scores of every document by itself."""

import math
import random
import re

import numpy as np

from loomstone.llm import bag_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(d, terms_of(t)) for d, t in docs]
    bags = [(d, t) for d, t in bags if t]
    n_docs, total = len(bags), sum(len(t) for _, t in bags)
    df = {}
    for _, own in bags:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, own in bags:
            m = 10 + (90 * len(own) * n_docs) // total
            score = 0
            for t in set(terms_of(text)) & set(own):
                tf = own.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, m int, bag string").repartition(5)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in bag_search.search(d, i, **options).collect()), key=str)


def corpus():
    rng = random.Random(8)
    words = ["the", "The", "of", "quay", "lamp", "Ärger", "ärger", "x1", "seven", "日本", "harbour", "tide", "rope", "mole"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    docs += [(1000 + i, "Lamp, rope; (quay) the") for i in range(200)]  # copies: a hot class, ties by id
    docs += [(2000 + i, "quay-rope the\tlamp") for i in range(5)]  # another text of the same bag
    docs += [(3000, None), (3001, ""), (3002, "., ;"), (None, "rope rope mole"), (3003, "elsewhere entirely"), (5, "rope tide"), (5, "rope tide"), (6, "rope lamp lamp")]
    items = [(0, "the rope"), (1, "Lamp of the quay, the LAMP"), (2, "Ärger 日本"), (3, None), (4, ""), (5, "nowhere to be found"), (0, "the rope"), (6, "mole"), (6, "tide"), (None, "x1 seven")]
    return docs, items


def test_equals_every_document_scored(spark):
    docs, items = corpus()
    for k in (10, 3):
        assert run(spark, docs, items, k=k) == brute(docs, items, k)
    assert run(spark, docs, items, k=10, vocabulary=3) == brute(docs, items, 10)  # several blocks


def test_small_cells_and_long_texts(spark, monkeypatch):
    docs, items = corpus()
    docs.append((9000, "tide " * 400_000 + "mole"))
    assert run(spark, docs, items, k=10) == brute(docs, items, 10)
    monkeypatch.setattr(bag_search, "PIECE", 7)
    long = "ab cdefghijklmnop, q " * 50
    assert [t for piece in bag_search.terms(long) for t in piece] == [t.encode() for t in terms_of(long)]


def test_none(spark):
    docs, items = corpus()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
    assert run(spark, [(1, None)], items) == []
    assert run(spark, [(1, "rope")], [(1, "rope")]) == brute([(1, "rope")], [(1, "rope")], 10)


def test_classes_are_few_where_bags_repeat(spark):
    docs, items = corpus()
    block = next(bag_search.blocks(spark.createDataFrame(items, "item_id long, text string"), 1000))

    class Sent:
        value = block.number

    rows = spark.createDataFrame(docs, "doc_id long, text string").where("doc_id BETWEEN 1000 AND 2999")
    bags = rows.mapInArrow(bag_search._bags(Sent), "doc_id long, n long, bag binary").collect()
    assert len(bags) == 205 and len({(r["n"], bytes(r["bag"])) for r in bags}) == 1
    row, term, tf = bag_search.unbagged([bytes(r["bag"]) for r in bags[:2]] + [b""] + [bytes(bags[0]["bag"])])
    assert row.tolist() == [0] * 4 + [1] * 4 + [3] * 4 and np.unique(tf).tolist() == [1] and term[:4].tolist() == sorted(term[:4])
