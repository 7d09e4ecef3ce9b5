"""Line dedup against a plain loop; keep bitmaps."""

import random

import pytest

from loomstone.llm import lines


def brute(rows, min_docs, min_chars, keep_first):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    holders: dict[str, list] = {}
    for doc, text in order:
        seen = set()
        for at, line in enumerate((text or "").split("\n")):
            key = "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= max(1, min_chars):
                if key not in seen:
                    holders.setdefault(key, []).append(((doc, text), at))
                seen.add(key)
    gone = {k: v for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        kept, all_lines = [], (text or "").split("\n")
        for at, line in enumerate(all_lines):
            key = "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if key not in gone or (keep_first and gone[key][0] == ((doc, text), at)):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def made_rows(first_free: bool):
    rng = random.Random(8)
    common = [f"Common line {i}" for i in range(12)] + ["ÄÖ zwölf", "x"]
    rows = []
    for doc in range(120):
        own = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(common)) if rng.random() < 0.5 else f"own {doc} {i}" for i in range(rng.randint(1, 14))]
        rows.append((doc, "\n".join(own)))
    rows += [(200 + i, "the hot line\nthe hot line\n" + str(i)) for i in range(90)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "\x0b hot \r"), (None, "the hot line\nx"), (None, "unnamed")]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("options", [{"min_docs": 10}, {"min_docs": 10, "min_chars": 2}, {"min_docs": 2, "keep_first": True}])
def test_equals_plain_loop(spark, options):
    rows = made_rows(True)
    docs = spark.createDataFrame([(d, t, "n", 5) for d, t in rows], "doc_id long, text string, keep string, N_LINES int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lines.drop_repeated_lines(docs.repartition(6), **options)
        assert out.columns == ["doc_id", "text", "keep", "n_lines", "n_dropped"]
        got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows, options["min_docs"], options.get("min_chars", 1), options.get("keep_first", False))


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_repeated_lines(empty).count() == 0
    long = "\n".join(f"row {i % 700}" for i in range(20_000))
    docs = spark.createDataFrame([(i, long) for i in range(9)] + [(9, "row 0\nrow zero")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs).collect()}
    assert got[9]["text"] == "row zero" and got[0]["n_dropped"] == len([i for i in range(20_000) if i % 700 == 0])
