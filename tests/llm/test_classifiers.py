"""Toxicity grammar and quality classifier: rules by hand, held-out accuracy on the given tables, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import kernel, toxicity
from loomstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LEXICON = toxicity.Lexicon({"lowei*": 5.0, "grub": 2.0})


def mass(text):
    return sum(toxicity.clause_scores(text.lower(), LEXICON))


def test_lexicon_reads_words_and_beginnings():
    assert LEXICON.weight("idiot") == 3 and LEXICON.weight("loweischaft") == 5 and LEXICON.weight("lowei") == 0
    assert LEXICON.weight("grub") == 2 and LEXICON.weight("grubs") == 0


def test_clauses_are_scored_not_words():
    plain, aimed, denied, told = "an idiot walked", "you idiot", "not an idiot", "he wrote idiot"
    assert mass(aimed) > mass(plain) > mass(denied) > 0
    assert mass("she said idiot") < mass("she idiot")
    assert mass(told) < mass("he idiot")
    assert mass("I will kill it") > 3 * mass("it can kill") > 0
    assert mass("not far. idiot") == mass("idiot")  # negation ends with its clause
    assert mass("not one two three idiot") == mass("idiot")  # and after three words
    assert mass('they said: "idiot. moron"') < mass("idiot. moron")
    assert mass("a clean sentence about trees, kindly meant") == 0


def test_quotes_and_tag_questions():
    assert mass('he said 5" pipes. you idiot') == mass("you idiot")  # an inch mark opens nothing
    assert mass('he said "never mind\nyou idiot') == mass("you idiot")  # a line end closes
    assert mass("she wrote: «the idiot. the moron»") == mass("the idiot. the moron") / 2
    assert mass("„you idiot” he shouted") == mass("you idiot")  # a quotation without a verb of saying counts in full
    assert mass("isn't he an idiot?") == mass("he an idiot") and mass("he isn't an idiot") < mass("he an idiot")


def by_each_transducer(tokens):
    """Clause weights from every transducer by itself: all positions of a match, each with the weights along its path."""
    out, states, hits = [], dict.fromkeys(toxicity.GRAMMAR, 0), []
    for token, symbol in [*tokens, (".", "end")]:
        if symbol in toxicity.CLOSERS:
            final = np.prod([t.last(states[n]) for n, t in toxicity.GRAMMAR.items()])
            if hits:
                out.append(sum(hits) * final)
            hits = []
        steps = {n: t.step(states[n], symbol) for n, t in toxicity.GRAMMAR.items()}
        harm = steps["threat"][1] if symbol == "threat" else 0.0
        found = max(LEXICON.weight(token), harm) if symbol not in toxicity.CLOSERS and symbol not in toxicity.MARKS else 0.0
        if found:
            hits.append(found * np.prod([w for n, (_, w) in steps.items() if n != "threat"]))
        states = {n: then for n, (then, _) in steps.items()}
    return out


def test_composition_equals_the_paths_of_its_parts():
    words = {"word": "idiot", "intent": "will", "threat": "kill", "target": "you", "negation": "not", "contracted": "isn", "report": "said", "open": "“", "close": "”", "comma": ",", "colon": ":", "end": ".", "line": "\n"}
    assert list(words) == toxicity.CLASSES
    rng = np.random.default_rng(3)
    paths = [[a, b, c] for a in words for b in words for c in words] + [list(rng.choice(list(words), 9)) for _ in range(3000)]
    for path in paths:
        text = " ".join(words[c] for c in [*path, "word"])
        tokens = list(toxicity.symbols(text))
        assert [c for _, c in tokens] == [*path, "word"]
        assert np.allclose(toxicity.clause_scores(text, LEXICON), by_each_transducer(tokens)), text
    assert len(toxicity.COMPOSED.arc) <= 1 * 4 * 2 * 5 * 5


def held_out(spark, name, label):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id")
    return [(r["score"], r["predicted"], r[label]) for r in rows.where("held_out").collect()]


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op1_toxicity", "toxic")
    assert np.mean([p == y for _, p, y in rows]) > 0.95
    assert not sum(p for _, p, y in rows if y == 0)


def test_quality_held_out(spark):
    rows = held_out(spark, "op5_quality_classifier", "quality")
    assert np.mean([p == y for _, p, y in rows]) > 0.97
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p, _ in rows)


def made(spark):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(["tree", "house", "river", "walks", "slowly", "the", "and"], 60)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["tree", "house", "the", "and", "old", "new", "red", "big"], 30)) + f" grumblefoot{'abcd'[i % 4]} " + " ".join(rng.choice(["river", "walks"], 5)) for i in range(80)]
    texts = good + bad
    rows = [(i, t, 1, 0.1) for i, t in enumerate(texts)] + [(900, None, 1, 0.1), (901, "", 1, 0.1), (None, bad[0], 1, 0.1), (902, "grumblefoote " * 50_000, 1, 0.1), (903, good[0], 1, 0.1)]
    docs = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, toxic int, SCORE double")
    labels = [(i, int(i < 150), int(i >= 150)) for i in range(230)] + [(None, 1, 1), (3, None, None), (3, 1, 0), (5, 7, 7)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts


def test_learned_words_and_odd_rows(spark):
    docs, labels, texts = made(spark)
    model = toxicity.learn(docs, labels, F.col("doc_id") % 5 != 0)
    assert any(w.startswith("grum") for w in model[0])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i >= 150) for i in range(230))
    assert got[900] == got[901] < 0.5 and got[None] >= 0.5 and got[902] >= 0.5 and got[903] == got[0]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(150), 900, 901, 903}


@pytest.mark.parametrize("rows", [[], [(1, 1, 1)]])
def test_labels_of_one_class_or_none(spark, rows):
    docs, _, _ = made(spark)
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    assert toxicity.score(docs, model).count() == docs.count()
    assert kernel.score(docs, kernel.learn(docs, labels, F.lit(True))).count() == docs.count()
    empty = docs.limit(0)
    assert toxicity.score(empty, model).count() == 0


def test_kernel_features_approximate_a_gaussian():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    z = kernel.Features(np.zeros(4), np.ones(4), 20_000, 2.0, 1)(x)[:, :20_000]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_summed_normal_equations(spark):
    rng = np.random.default_rng(1)
    x, n = rng.normal(size=(200, len(kernel.STATS))), len(kernel.STATS)
    y = x[:, 0] * 2 + np.sin(x[:, 1])
    of = kernel.Features(np.zeros(n), np.ones(n), 32, 3.0, 2)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, y double").repartition(7)
    z = of(x)
    assert np.allclose(kernel.ridge(rows, of, 0.5), np.linalg.solve(z.T @ z + 0.5 * np.eye(z.shape[1]), z.T @ y), atol=1e-8)


def test_isotonic_rates():
    rates = kernel.isotonic(np.arange(5), np.array([0, 5, 3, 9, 10]), np.array([10, 10, 10, 10, 10]))
    assert (np.diff(rates) >= 0).all() and rates[1] == rates[2] == 8.5 / 21


def test_statistics_of_odd_texts():
    assert not kernel.document_statistics(None).any() and not kernel.document_statistics("").any()
    for text in (" \n", "x", "é" * 100_000, "a\n" * 5000):
        assert np.isfinite(kernel.document_statistics(text)).all()


def test_score_equals_plain_algebra(spark):
    """Weights and scores are those of features, normal equations and calibration written out in numpy."""
    docs, labels, texts = made(spark)
    model = kernel.learn(docs, labels, F.lit(True), features=16, bins=20, width=3.0, penalty=0.1, seed=7)
    fold = {r["doc_id"]: r["f"] for r in spark.range(230).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)).alias("f")).collect()}
    stats = np.array([kernel.document_statistics(t) for t in texts])
    y = np.array([1.0 if i < 150 else -1.0 for i in range(230)])
    scale = np.where(stats.std(0) > 1e-9, stats.std(0), 1.0)
    z = np.clip((stats - stats.mean(0)) / scale, -8, 8)
    rng = np.random.default_rng(7)
    omega = rng.normal(0, 1 / (3.0 * np.sqrt(len(kernel.STATS) / 8)), (len(kernel.STATS), 16))
    features = np.hstack([np.sqrt(2 / 16) * np.cos(z @ omega + rng.uniform(0, 2 * np.pi, 16)), z / 8, np.ones((230, 1))])
    fit = np.array([fold[i] != 0 for i in range(230)])
    weights = np.linalg.solve(features[fit].T @ features[fit] + 0.1 * np.eye(features.shape[1]), features[fit].T @ y[fit])
    assert np.allclose(model.weights, weights, atol=1e-6)
    raw = features @ weights
    want = np.interp(raw, model.edges, model.rates) * 0.999 + 0.001 / (1 + np.exp(-raw))
    got = {r["doc_id"]: r["score"] for r in kernel.score(docs.where("doc_id < 230"), model).collect()}
    assert np.allclose([got[i] for i in range(230)], want, atol=1e-6)


def test_repeated_ids_teach_once(spark):
    docs, labels, _ = made(spark)
    many = docs.unionByName(docs.where("doc_id < 5").crossJoin(spark.range(40)).drop("id"))
    assert toxicity.learn(many, labels, F.lit(True))[0] == toxicity.learn(docs, labels, F.lit(True))[0]
