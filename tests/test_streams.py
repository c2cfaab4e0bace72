"""Streams over a table of part files give what they give over the same table as one file."""

import os
import shutil
from collections import Counter

import pytest

from formloom import catalog
from formloom.streaming import arrivals

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """events as 30 part files, the latest rows in the file that arrived first."""
    d = str(tmp_path_factory.mktemp("parts"))
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts", ascending=False)
    os.mkdir(f"{d}/events.parquet")
    step = -(-len(events) // 30)
    for i in range(30):
        part = f"{d}/events.parquet/part-{i:05d}.parquet"
        spark.createDataFrame(events[i * step : (i + 1) * step], spark.read.parquet(f"{SF}/events.parquet").schema).coalesce(1).write.parquet(f"{d}/one")
        shutil.move(next(f.path for f in os.scandir(f"{d}/one") if f.name.endswith(".parquet")), part)
        shutil.rmtree(f"{d}/one")
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    return d


@pytest.mark.parametrize("name", ["stream_sessions", "stream_hours", "stream_reassembly"])
def test_part_files_give_the_rows_of_one_file(spark, parts, name):
    got, want = (Counter(map(tuple, catalog.queries()[name](spark, d).collect())) for d in (parts, SF))
    assert got == want and got


def test_rows_of_all_part_files_arrive(spark, parts):
    assert arrivals.drained(arrivals.arriving_table(spark, parts, "events")).count() == spark.read.parquet(f"{SF}/events.parquet").count()
