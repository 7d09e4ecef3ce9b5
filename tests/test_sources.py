"""Folder listing, phrases in texts, retrievers by name."""

import random

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from loomstone.operators import inventory as inv
from loomstone.operators import retrievers as rt
from loomstone.sources import folders as fo
from loomstone.sources import records as re_


def _tree(root):
    for name in ("a.txt", "_notes.txt", ".hidden.txt", "x.bin", "in/b.MD", "in/_deep/c.txt", "in/_deep/more/d.txt", "other/e.txt", ".dir/f.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "in" / "loop").symlink_to(root, target_is_directory=True)


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_folders_are_listed_whole(spark, tmp_path, tasks):
    _tree(tmp_path)
    got = fo.scan_folders(spark, f"file://{tmp_path}", tasks=tasks)
    rows = {r["path"]: (r["suffix"], r["size"]) for r in got.collect()}
    assert rows == {n: ("." + n.rsplit(".", 1)[1].lower(), len(n)) for n in ("a.txt", "_notes.txt", "in/b.MD", "in/_deep/c.txt", "in/_deep/more/d.txt", "other/e.txt", ".dir/f.txt")}
    every = fo.list_folders(spark, str(tmp_path), tasks=tasks)
    assert {r["path"] for r in every.collect()} == {*rows, ".hidden.txt", "x.bin"}
    assert every.where("modified IS NULL OR denied OR size IS NULL").count() == 0


def test_folder_missing_or_empty(spark, tmp_path):
    assert fo.scan_folders(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no folder"):
        fo.list_folders(spark, str(tmp_path / "none")).count()


class _Refusing(pafs.LocalFileSystem):
    def get_file_info(self, of):
        if isinstance(of, pafs.FileSelector) and of.base_dir.endswith("other"):
            raise PermissionError(13, "denied")
        return super().get_file_info(of)


def test_refused_folders_are_counted(spark, tmp_path):
    _tree(tmp_path)
    system, top = _Refusing(), str(tmp_path)
    assert len(fo.plan(system, top, 2)) <= 5
    rows = [r for part in fo.plan(system, top, 3) for r in fo.walk(system, top, part.path, part.deep, [".txt"])]
    assert [r[:2] for r in rows if r[4]] == [("other", f"{top}/other")] and len(rows) == len(set(rows)) == 6
    listing = spark.createDataFrame(rows, "path string, file string, size long, modified long, denied boolean")
    files = inv.classified(listing.where("NOT denied").select(F.concat(F.lit("/share/"), "path").alias("path"), "size", F.lit(1).cast("long").alias("mtime")), "/share", 1)
    assert inv.estate_summary(files, inv.duplicate_groups(files), listing).first()["access_denied"] == 1
    assert inv.estate_summary(files, inv.duplicate_groups(files), 4).first()["access_denied"] == 4


def test_phrases_in_texts_equal_plain_search(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab 가") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "ab" * 50_000)]
    phrases = [(i, "".join(rng.choice("ab 가") for _ in range(rng.randint(1, 5)))) for i in range(60)] + [(70, ""), (71, None), (72, "ab"), (73, "ab")]
    want = {(q, i) for q, p in phrases for i, t in texts if p is not None and t is not None and p in t}
    asked = spark.createDataFrame(phrases, "query_id long, text string")
    held = spark.createDataFrame(texts, "item_id long, text string")
    for block, most in ((16384, 8 << 20), (7, 8 << 20), (1000, 200)):
        got = [tuple(r) for r in re_.holders(asked, held, block, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert re_.holders(asked.limit(0), held).count() == 0


def test_retrievers_keep_the_contract(spark):
    hits = "query_id long, item_id long, rank int, score double"
    good = [(1, 5, 1, 0.9), (1, 6, 2, 0.9), (2, 5, 1, 0.1)]
    bad = [(3, 5, 1, 0.1), (3, 6, 2, 0.2), (4, 5, 1, 1.0), (4, 5, 2, 0.5), (5, 5, 2, 1.0), (6, 1, 1, 1.0), (6, 2, 2, 1.0), (6, 3, 3, 1.0), (7, 1, 1, None)]
    broken = rt.broken_ranks(spark.createDataFrame(good + bad, hits), 2)
    assert {tuple(r) for r in broken.collect()} == {(3, "score_rises"), (4, "repeated_item"), (5, "gap"), (6, "too_many"), (7, "null")}
    assert {"dense", "lexical", "hybrid"} <= set(rt.retriever_names())
    with pytest.raises(ValueError, match="already"):
        rt.retriever("dense")(lambda *_: None)
    with pytest.raises(KeyError, match="no retriever"):
        rt.retrieve("none", None, None, 3)
    frame = spark.createDataFrame(good, hits)
    try:
        rt.retriever("odd")(lambda q, c, k: q.withColumn("rank", F.col("rank").cast("string")).drop("score"))
        with pytest.raises(TypeError, match="rank is string, not int; score is missing"):
            rt.retrieve("odd", frame, None, 3)
    finally:
        rt._NAMED.pop("odd")
