"""The corpus pipeline: every stage does its operator's work on what the stage before kept, and clean documents come through."""

import os

import corpus_pipeline
from pyspark.sql import functions as F
from loomstone.llm import byte_bpe, signature_tree
from loomstone.llm.common import stored, table
from loomstone.llm.queries import vocabulary
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_signature_tree import brute as brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    tables = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), name))
    given, clean, lines, alone, mixed, encoded = [t.collect() for t in tables]
    assert all(t.columns == COLUMNS for t in tables[:-1])

    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in given} - {r["doc_id"] for r in clean}
    not_toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    assert gone & toxic and not gone & not_toxic

    want = brute_lines([(r["doc_id"], r["text"]) for r in clean], 10, 1, True)
    assert sorted(((r["doc_id"], r["text"]) for r in lines), key=str) == sorted(((d, t) for d, t, _, gone in want if not gone or t.split()), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    groups = brute_groups([(r["doc_id"], r["text"]) for r in lines], 5, 80)
    assert sorted(r["doc_id"] for r in alone) == sorted(d for d, _, c in groups if c == d)
    assert len(signature_tree.near_duplicates(tables[2], 5, 80).collect()) == len(lines)

    by_id = {r["doc_id"]: tuple(r) for r in alone}
    assert all(by_id[r["doc_id"]] == tuple(r) for r in mixed)
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert 1.1 * words(alone) < words(mixed) <= 2 * words(alone)
    assert len(encoded) == len(mixed) and all(r["spells_text"] for r in encoded)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "spells_text"] and rows.count() > 0


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_one_of_twelve_exact_copies_comes_out_whole(spark, tmp_path):
    sf = str(tmp_path)
    text = "\n".join(["The harbour office opens at seven and closes at four.", "", "Boats that come later wait at the outer quay until the morning.", "A lamp shows where."])
    docs = table(spark, SF, "documents")
    copies = spark.createDataFrame([(10_000_000 + i, text, "en", "harbour", len(text)) for i in range(12)], COLUMNS)
    copies = copies.select(*[copies[f.name].cast(f.dataType) for f in docs.schema])
    docs.unionByName(copies).write.parquet(f"{sf}/documents.parquet")
    os.symlink(f"{SF}/labels.parquet", f"{sf}/labels.parquet")

    out = stored(corpus_pipeline.run(spark, sf).where("doc_id >= 10000000"), "copies")
    spelled = byte_bpe.decode(out, vocabulary()[0]).collect()
    assert {r["doc_id"] for r in spelled} == {10_000_000} and all(bytes(r["decoded"]) == text.encode() for r in spelled)
    assert all(r["spells_text"] for r in out.collect())


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = table(spark, SF, "documents").withColumn("GONE", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("cluster", F.lit(2))
    long = "tide and rope " * 60_000
    odd = [(20_000_000, None, None, None), (20_000_001, "", "en", None), (None, "nobody's words stand here alone", "en", "q"), (20_000_002, long, None, "q"), (20_000_003, "twice the same row of words, whole", "en", "q"), (20_000_003, "twice the same row of words, whole", "en", "q")]
    rows = spark.createDataFrame([(i, t, la, so, len(t or ""), 1, "x", 2) for i, t, la, so in odd], docs.schema)
    docs = stored(docs.unionByName(rows), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == [*COLUMNS, "GONE", "_row", "cluster"]
        ids = [r["doc_id"] for r in docs.where("doc_id IS NULL OR doc_id >= 20000000").select("doc_id").collect()]
        if name != "source_mix":
            assert sorted(ids, key=str) == sorted([i for i, *_ in odd], key=str), name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.where("NOT spells_text").count() == 0 and encoded.count() == docs.count()
