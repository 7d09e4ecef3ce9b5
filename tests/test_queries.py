"""Every registered query against its SQL twin at the smallest scale."""

import pytest

from workload import all_oracles, all_queries
from workload.check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    if name not in all_oracles():
        assert df.count() > 0
        return
    assert [d for d in differences(df, con, all_oracles()[name]) if not d.startswith("NOTE")] == []


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "query_id" in df.columns


def test_entry_without_an_optional_library():
    """Where a library that only the training-data operators need is missing, the other queries stay."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') and n[2:3].isdigit() for n in q), len(o))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(all_queries()) and int(out[1]) == 0 and int(out[2]) == len(all_oracles())


@pytest.mark.parametrize("name", ["unknown_fallback", "route_postchecks_v1", "route_postchecks_v2"])
def test_short_and_empty_turns(spark, tmp_path, name):
    """What whole turns hardly reach: turns without a word, or of a few letters."""
    import os

    texts = ["", " ", "안녕", "더 자세히 알려줘", "너는 뭐야", "첨부 파일 봐줘", "help", "어떤 기능이 있어?", "x"]
    rows = [(c, t, "user", texts[(c + t) % len(texts)]) for c in range(70) for t in (0, 2)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    made.write.parquet(f"{tmp_path}/made")
    for table in os.listdir(SF):
        if table != "conversations.parquet":
            os.symlink(f"{SF}/{table}", f"{tmp_path}/{table}")
    part = next(f for f in os.listdir(f"{tmp_path}/made") if f.endswith(".parquet"))
    os.symlink(f"{tmp_path}/made/{part}", f"{tmp_path}/conversations.parquet")
    assert [d for d in differences(all_queries()[name](spark, str(tmp_path)), connect(str(tmp_path)), all_oracles()[name]) if not d.startswith("NOTE")] == []
