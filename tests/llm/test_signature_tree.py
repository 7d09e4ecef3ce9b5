"""N-gram Jaccard join against all pairs of a small table."""

import random

import numpy as np
import pytest

from loomstone.llm import signature_tree as st


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\x0b", " ").split(None)
        words = [w for w in words if w]
        if not words:
            sets.append(set())
        elif len(words) < size:
            sets.append({tuple(words)})
        else:
            sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    ids: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return sorted(((doc, len(sets[i]), ids.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def made_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for length in (4, 9, 10, 11, 20, 40, 90, 150, 400):
        text = [word() for _ in range(length)]
        for _ in range(12):  # a chain: each a little further from the first
            rows.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(170)]
    for _ in range(260):  # a hot group of near copies of one text, some too far for a link
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(base)] * 30 + ["", " \t\n", "one", "one", "ONE", "one two", "é É", "x"]
    rows += [" ".join(word() for _ in range(60)) for _ in range(60)]
    rng.shuffle(rows)
    out = [(i, t) for i, t in enumerate(rows)] + [(2000, None), (None, rows[3]), (None, "nobody else says this"), (None, "")]
    return out + [out[5], out[5]]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_equals_all_pairs(spark, size, percent):
    rows = made_rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, COMPONENT_ID int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = st.near_duplicates(docs.repartition(5), size, percent, block=16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, size, percent)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        levels = st.Levels(percent)
        for n in [*range(5, 60), 200, 777, 3000]:
            for _ in range(3):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                worst = len(a) - -(-percent * len(a) // 100)  # elements the smaller set may lack
                b = np.sort(rng.permutation(a)[: len(a) - worst])
                assert 100 * len(b) >= percent * len(a)
                if worst:
                    (ka, least_a), (kb, least_b) = st.part_keys(a, levels), st.part_keys(b, levels)
                    both = np.intersect1d(ka, kb) >> np.uint64(16) & np.uint64(1)
                    shared = [int((both == odd).sum()) for odd in (0, 1)]
                    assert any(shared[odd] >= max(1, least_a[odd], least_b[odd]) for odd in (0, 1) if least_a[odd] and least_b[odd])


def test_bound_never_cuts_a_link():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    sets = [np.sort(rng.permutation(base)[: rng.integers(2700, 3000)]) for _ in range(40)]
    bitmaps = [np.frombuffer(st.bitmap_of(x), np.uint64) for x in sets]
    linker = st.Linker([len(x) for x in sets], 90, sets)
    tree = st.Tree(bitmaps, [len(x) for x in sets], list(range(40)))
    linker.traverse(tree, tree, list(range(40)), list(range(40)))
    only_bits = st.Linker([len(x) for x in sets], 90)
    only_bits.traverse(tree, tree, list(range(40)), list(range(40)))
    assert {i for link in linker.links for i in link} <= only_bits.open
    brute_parent = list(range(40))
    for i in range(40):
        for j in range(i):
            both = np.intersect1d(sets[i], sets[j]).size
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((brute_parent[i], brute_parent[j]))
                brute_parent = [low if p == high else p for p in brute_parent]
    groups = lambda parents: {frozenset(k for k, q in enumerate(parents) if q == p) for p in parents}
    assert groups([linker.find(i) for i in range(40)]) == groups(brute_parent)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert st.near_duplicates(docs).count() == 0
    assert st.keep_one(docs).count() == 0


def test_keep_one_goes_by_id_and_text(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [
        (1, words("a")),
        (5, words("a") + " more"),  # near copy of 1: goes
        (5, words("b")),  # another text of the id, linked with nothing: stays
        (5, words("c")),  # names its group, though its id is gone through another text
        (6, words("c") + " more"),
        (7, words("d")),  # two texts of one id that are near copies: one of them stays
        (7, words("d") + " more"),
        (8, words("e")),
        (8, words("e")),  # a row repeated whole is the same document
        (None, words("a")),
        (9, ""),
        (9, None),
    ]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, GONE int").repartition(3)
    kept = st.keep_one(docs).collect()
    assert docs.columns == ["doc_id", "text", "GONE"] and all(rows[r["GONE"]] == (r["doc_id"], r["text"]) for r in kept)
    stays = sorted(r["GONE"] for r in kept)
    assert [i for i in stays if i not in (5, 6)] == [0, 2, 3, 7, 8, 9, 10, 11]
    assert len([i for i in stays if i in (5, 6)]) == 1


def passage_rows(n, own, shared):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(shared)]
    return [(i, " ".join([*(word() for _ in range(own // 2)), *passage, *(word() for _ in range(own // 2))])) for i in range(n)]


def test_rows_of_a_shared_passage_grow_with_the_documents(spark):
    """Many documents that hold one passage meet in parts of it, but leave these for the parts of their own."""
    made = []
    for n in (200, 400, 800):
        docs = spark.createDataFrame(passage_rows(n, 80, 60), "doc_id long, text string").repartition(4)
        described = st.stored(docs.withColumn("th", st.text_key(docs["text"])).mapInArrow(st._described(5, 80), "doc_id long, th long, n long, digest binary, bits binary, keys binary, even int, odd int"), "described")
        groups = st.stored(st.candidate_groups(described), "groups")
        assert groups.groupBy("key").count().where(f"count > {n // 8}").count() > 5
        classes = described.select("doc_id", "n", "digest", "bits", "even", "odd", st.node_of("digest").alias("node"))
        rows = st._rest_rows(groups, classes, spark.createDataFrame([], "node binary, component binary"), 64)
        made.append(rows.count() if rows is not None else 0)
    assert made[2] <= 2.6 * max(made[1], 100) and made[1] <= 2.6 * max(made[0], 100) and made[2] < 800


def test_passages_of_all_lengths_against_all_pairs(spark):
    rows = [(len(t) * 1000 + i, t) for own, shared in ((80, 80), (30, 90), (10, 100), (4, 60), (0, 50)) for i, t in passage_rows(90, own, shared)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = st.near_duplicates(docs, 5, 80, block=16).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 5, 80)


def test_scratch_tables_go(spark):
    import pathlib

    from loomstone.session import shared_folder

    top = pathlib.Path(shared_folder(spark).removeprefix("file:")) / spark.sparkContext.applicationId
    there = lambda: {p.name for p in top.glob("*")} if top.exists() else set()
    before = there()
    docs = spark.createDataFrame(made_rows(), "doc_id long, text string")
    kept = st.keep_one(docs, block=16)
    assert {n.rsplit("-", 1)[0] for n in there() - before} == {"gone"} and kept.count()
