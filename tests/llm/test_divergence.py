"""Quality rules: counts against plain loops, distances against their formula, verdicts on made texts."""

import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import divergence as dv

PIECES = st.lists(st.sampled_from(["a", "b", "the", "of", " ", " ", "\n", "\t", "\x0b", "é", "#", "|", "!!", "A", "9", "<"]), max_size=60).map("".join)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_counts(text):
    raw = text.encode()
    assert dv.measure(raw, raw.split(), "xx", {}, 50, 200) == (*brute(text), None, None)


def test_distance():
    a, b = np.array([8, 2, 0]), np.array([1, 1, 2])
    p, q = a / 10, b / 4
    m = (p + q) / 2
    kl = lambda x: sum(i * math.log2(i / j) for i, j in zip(x, m) if i)
    assert math.isclose(dv.js_distance(a, b), math.sqrt((kl(p) + kl(q)) / 2))
    assert dv.js_distance(a, a * 3) < 1e-7 and dv.js_distance(np.array([1, 0]), np.array([0, 5])) == 1.0
    assert dv.js_distance(np.array([0, 0]), np.array([1, 1])) == 1.0


def test_class_counts_see_whole_characters():
    counts = dict(zip(dv.CLASSES, dv.class_counts("Aé日 9.!#a\n💡~".encode())))
    assert counts == {"lower": 1, "upper": 1, "digit": 1, "blank": 2, "stop": 1, "mark": 1, "symbol": 1, "other": 1, "wide": 3}


def made_docs():
    rng = random.Random(6)
    common = {"aa": ["the", "of", "and", "to"], "bb": ["der", "die", "und", "zu"]}
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        words = [rng.choice(common[lang]) if rng.random() < 0.4 else word() for _ in range(rng.randint(60, 300))]
        rows.append((i, lang, " ".join(words) + "."))
    return rows


def test_references_are_exact(spark):
    rows = made_docs()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(9)
    refs = dv.references(docs, tokens=500)
    assert set(refs) == {"aa", "bb"}
    for lang, (words, counts, classes) in refs.items():
        every = [w for _, own, t in rows if own == lang for w in t.encode().split()]
        expected = sorted(((every.count(w), w) for w in set(every) if every.count(w) >= 0.004 * len(every)), key=lambda x: (-x[0], x[1]))[:32]
        assert words == [w for _, w in expected]
        assert counts.tolist() == [c for c, _ in expected] + [len(every) - sum(c for c, _ in expected)]
        assert classes.tolist() == sum(dv.class_counts(t.encode()) for _, own, t in rows if own == lang).tolist()


def test_verdicts(spark):
    rows = made_docs()
    rng = random.Random(1)
    shout = " ".join("".join(rng.choice("ABCDEFGH") for _ in range(6)) + "!!" for _ in range(80))
    marks = " ".join(w + "***" for w in rows[1][2].split())
    odd = [(900, "aa", shout), (901, "aa", marks), (902, "aa", "the of and " * 100), (903, "aa", None), (904, "bb", ""), (905, None, rows[0][2]), (906, "zz", rows[1][2]), (907, "aa", "too few words"), (None, "aa", rows[3][2])]
    docs = spark.createDataFrame([(*r, True) for r in rows + odd + [rows[5], rows[5]]], "doc_id long, lang string, text string, KEPT boolean")
    got = dv.judge(docs).collect()
    assert len(got) == len(rows) + len(odd) + 2
    kept = {r["doc_id"]: r["kept"] for r in got}
    failed = {r["doc_id"]: r["base_failed"] for r in got}
    assert all(kept[i] for i in range(400))
    assert not any(kept[i] for i in (900, 901, 902, 903, 904, 907)) and kept[905] and kept[906] and kept[None]
    assert not failed[900] and not failed[901] and all(failed[i] for i in (902, 903, 904, 907))
    assert dv.judge(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    assert dv.keep_good(docs).columns == docs.columns
