"""Figures that come from counts, and scores kept as text."""

import numpy as np
from pyspark.sql import functions as F

from loomstone.operators import evaluation as ev
from loomstone.operators import tagging as tg


def test_corpus_stats_equal_numpy(spark):
    rng = np.random.default_rng(4)
    sizes = {"a": [0, 5, 5, 9000, 130], "b": rng.integers(0, 20_000, 400).tolist(), None: [7], "d": []}
    rows = [(g, "x" * int(n)) for g, all_ in sizes.items() for n in all_] + [("d", None), ("a", None)]
    out = tg.corpus_stats(spark.createDataFrame(rows, "g string, text string").repartition(5), ["g"])
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r for r in out.collect()}
    assert got.keys() == sizes.keys()
    for g, n in sizes.items():
        r = got[g]
        assert r["chunks"] == len(n) + (g in ("a", "d"))
        if not n:
            assert r["median"] is None and r["p95"] is None and r["chars"] is None
            continue
        assert (r["chars"], r["smallest"], r["largest"], r["short_chunks"]) == (sum(n), min(n), max(n), sum(x < 100 for x in n))
        assert abs(r["median"] - np.quantile(n, 0.5)) < 1e-9 and abs(r["p95"] - np.quantile(n, 0.95)) < 1e-6
    assert tg.corpus_stats(spark.createDataFrame([], "g string, text string"), ["g"]).count() == 0


def test_graded_runs(spark):
    texts = {
        1: ("{'correct': True, 'x': 1}", True), 2: ('{"a": [1, 2], "correct": true}', True), 3: ("{'correct': False}", False), 4: ("{'incorrect': True}", False),
        5: ("correct: True", False), 6: (None, False), 7: ("{'note': 'x', 'correct':1}", True), 8: ("", False),
    }
    runs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "id long, score string")
    steps = ["grade:all_irrelevant(0rel/5total,max=0.28,cov=none)", "grade:pass(2rel/2kept/5total,max=0.71,cov=full)"]
    path = [(i, steps if i % 2 else steps[1:]) for i in [*texts, 50]] + [(60, ["router:x"])]
    grades = ev.parse_grade_log(spark.createDataFrame(path, "id long, path array<string>"), "id", "path")
    got = {r["id"]: (r["score"], r["coverage"], r["correct"]) for r in ev.graded_runs(grades, runs).collect()}
    want = {i: ((0.28, "none", right) if i % 2 else (0.71, "full", right)) for i, (_, right) in [*texts.items(), (50, (None, False))]}
    assert got == want
    bins = {r["low"]: (r["correct"], r["wrong"]) for r in ev.score_histogram(ev.graded_runs(grades, runs)).collect()}
    low, high = [v[2] for v in want.values() if v[0] == 0.28], [v[2] for v in want.values() if v[0] == 0.71]
    assert bins[0.0] == (sum(low), len(low) - sum(low)) and bins[0.7] == (sum(high), len(high) - sum(high))


def test_weak_passes_read_the_rows_once(spark):
    rows = [(i, round((i * 7 % 100) / 100, 2) if i % 11 else None, None if i % 13 == 0 else i % 3 != 0) for i in range(1, 400)]
    out = ev.weak_passes(spark.createDataFrame(rows, "id long, score double, correct boolean").repartition(5), n=6)
    want = []
    for right, kind in ((False, "suspect"), (True, "at_risk")):
        side = sorted((s, i) for i, s, c in rows if s is not None and s < 0.6 and c is right)[:6]
        want += [(i, s, right, kind) for s, i in side]
    assert sorted(tuple(r) for r in out.select("id", "score", "correct", "kind").collect()) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_grades_are_matched_only_where_asked_for(spark):
    steps = ["x", "grade:pass(2rel/2kept/5total,max=0.71,cov=full)", None, "grade:no_docs"]
    paths = spark.createDataFrame([(1, steps), (2, ["x"]), (3, None), (4, [])], "id long, path array<string>")
    grades = ev.parse_grade_log(paths, "id", "path")
    row = grades.collect()
    assert len(row) == 1 and (row[0]["n_grades"], row[0]["first_max"], row[0]["first_kept"], row[0]["final_status"], row[0]["final_cov"]) == (2, 0.71, 2, "no_docs", "none")
    plan = grades.select("id", "first_max")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
