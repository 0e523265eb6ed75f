"""ZIP archives written and read back."""

import os
import zipfile

from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources import archives as A
from tidemark.sources import readers as RD


def test_round_trip_by_member(spark):
    root = scratch_path(spark, "zips")
    rows = [(f"q={a}", f"m{k % 3}.txt", f"{k}^é {k}") for a in (1, 2) for k in range(50_000 if a == 1 else 7)]
    done = A.write_zips(spark.createDataFrame(rows, "a string, m string, line string").repartition(5), root, archive="a", member="m", header=["id^text"])
    assert {tuple(r) for r in done.collect()} == {("q=1.zip", 3, 50_000), ("q=2.zip", 3, 7)}
    got = A.zip_lines(spark, root)
    assert got.rdd.getNumPartitions() == 6
    heads = got.where("line_no = 0").select("line").distinct().collect()
    assert [r[0] for r in heads] == ["id^text"]
    back = got.where("line_no > 0").select(F.regexp_extract("file", r"(q=\d+)\.zip$", 1).alias("a"), "member", "line").collect()
    assert sorted(map(tuple, back)) == sorted(rows)


def test_caret_members_with_description_missing_marks_and_absent_items(spark):
    root = scratch_path(spark, "zips")
    os.makedirs(f"{root}/deep")
    with zipfile.ZipFile(f"{root}/deep/q=8001.zip", "w") as z:
        z.writestr("one.txt", "id^date^v\nwords^words^words\n1^20000331^2.5\n2^20000331^--------\n".encode("latin-1"))
        z.writestr("two.txt", "id^date^v\r\n3^20000331^ \r\n".encode("latin-1"))
        z.writestr("empty.txt", b"")
    df = RD.read_caret_zip(spark, root, items=["v", "w"], ids=["date", "file_q"], entity="id", header=["id", "date", "v"])
    assert {tuple(r) for r in df.select("id", "date", "file_q", "v", "w").collect()} == {(1, "20000331", 8001, 2.5, None), (2, "20000331", 8001, None, None), (3, "20000331", 8001, None, None)}


def test_no_archive_gives_no_lines(spark):
    root = scratch_path(spark, "zips")
    os.makedirs(root)
    assert A.zip_lines(spark, root).count() == 0
