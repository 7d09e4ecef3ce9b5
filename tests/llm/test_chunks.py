"""Substring dedup against a plain loop over all chunks."""

import random

from loomstone.llm import chunks

OPTIONS = (4, 16, 128)


def brute(rows, run_bytes):
    """{(doc_id, text): spans} by one pass in order of (doc_id, start, text)."""
    gear = chunks.gear_table()
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    places: dict[bytes, list] = {}
    for doc, text in rows:
        raw, last = (text or "").encode(), 0
        for at in chunks.cut_points(raw, gear, *OPTIONS):
            places.setdefault(raw[last:at], []).append(((doc is not None, doc or 0, last), text, last, at))
            last = at
    gone: dict = {}
    for found in places.values():
        first = min(p[0] for p in found)
        for (named, doc, _), text, start, end in found:
            if (named, doc, start) != first:
                gone.setdefault((doc if named else None, text), []).append((start, end))
    out = {}
    for key, spans in gone.items():
        runs = []
        for start, end in sorted(spans):
            if runs and runs[-1][1] == start:
                runs[-1][1] = end
            else:
                runs.append([start, end])
        if runs := [tuple(r) for r in runs if r[1] - r[0] >= run_bytes]:
            out[key] = runs
    return out


def made_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwxyzäöé") for _ in range(rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(60) for _ in range(6)]
    rows = []
    for doc in range(150):
        parts = [say(rng.randint(5, 120))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts += [rng.choice(passages), say(rng.randint(3, 50))]
        rows.append((doc, "\n".join(parts)))
    rows += [(150 + i, passages[0]) for i in range(80)]  # a hot group
    rows += [(None, passages[1]), (None, say(40)), (300, None), (301, ""), (302, "x"), (303, "zz " * 3000)]
    rows += [rows[7], rows[7]]
    return rows, passages


def test_equals_brute_force(spark):
    rows, passages = made_rows()
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, spans string, N_SPANS int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunks.drop_repeats(docs.repartition(7), run_bytes=128).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute(rows, 128)
    by_doc: dict = {}
    for (doc, text), spans in want.items():
        by_doc.setdefault(doc, []).append(chunks.cut_spans(text, [{"start": a, "end": b} for a, b in spans]))
    assert len(got) == len(rows)
    flagged = [(r["doc_id"], r["text"]) for r in got if r["n_spans"]]
    expected = []
    for doc, text in rows:
        if (doc, text) in want:
            expected.append((doc, chunks.cut_spans(text, [{"start": a, "end": b} for a, b in want[doc, text]])))
    assert sorted(flagged, key=str) == sorted(expected, key=str)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[300] is None and texts[301] == "" and texts[302] == "x"
    holding = [d for d, t in rows if t and passages[0] in t]
    assert sum(passages[0] in (texts[d] or "") for d in set(holding)) <= 1


def test_insertions_move_no_cuts():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)).encode()
    gear = chunks.gear_table()

    def pieces(raw):
        cuts = chunks.cut_points(raw, gear, *OPTIONS)
        return {raw[a:b] for a, b in zip([0, *cuts], cuts)}

    before, after = pieces(text), pieces(text[:700] + b"inserted " + text[700:])
    assert len(before - after) <= 4


def test_long_characters_stay_whole():
    text = "日本語のテキスト" * 200
    raw, gear = text.encode(), chunks.gear_table()
    cuts = chunks.cut_points(raw, gear, *OPTIONS)
    assert cuts[-1] == len(raw) and all(raw[a:b].decode() for a, b in zip([0, *cuts], cuts))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunks.drop_repeats(docs).count() == 0
