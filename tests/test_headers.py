"""Headers of many files in one job."""

import os

import pytest

from voltweave.sources import market


def test_a_thousand_files_in_one_job(spark, tmp_path):
    want = {}
    for k in range(1000):
        path = tmp_path / f"{k % 7}_{k}.csv"
        head = ["a,b", "a\tb\tc", "﻿x"][k % 3]
        path.write_text(head + "\n" + "1\t2\n" * (k % 5), encoding="utf-8")
        want[str(path)] = head.lstrip("﻿")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        assert market.headers(spark, list(want)) == want
        # Listing that many files is a job of Spark's own; reading them is one more.
        assert len(tracker.getJobIdsForGroup("headers")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_large_files_and_odd_names(spark, tmp_path, monkeypatch):
    a, b = tmp_path / "with space & 100%.csv", tmp_path / "b.csv"
    a.write_text("head a\n" + "x" * 99 + "\n" * 3)
    b.write_text("head b\n" + ("y" * 999 + "\n") * 3000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert market.headers(spark, [str(a), f"file://{b}"]) == {str(a): "head a", f"file://{b}": "head b"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    monkeypatch.chdir(tmp_path)
    assert market.headers(spark, [os.path.abspath("b.csv")]) == {str(b): "head b"}


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n")
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="empty file: .*e.csv"):
        market.headers(spark, [str(tmp_path / "a.csv"), str(tmp_path / "e.csv")])
    assert market.headers(spark, []) == {}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        market.headers(spark, [str(tmp_path / "none.csv")])
