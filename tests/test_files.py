from __future__ import annotations

from datetime import datetime

from heliograph.sources.files import read_bars, read_journal, upserted, write_csv


def test_bars_from_csv_leave_out_broken_lines_and_copies(spark, tmp_path):
    lines = ["symbol,ts,open,high,low,close,volume", "a,2024-01-01T00:00:00,1,2,0.5,1.5,10", "a,2024-01-01T00:00:00,1,2,0.5,1.7,10", "a,not a time,1,2,3,4,5", ",2024-01-01T01:00:00,1,2,3,4,5"]
    path = tmp_path / "bars_csv"
    path.mkdir()
    (path / "x.csv").write_text("\n".join(lines))
    assert [tuple(r) for r in read_bars(spark, str(path)).collect()] == [("a", datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.7, 10.0)]
    df = read_bars(spark, str(path))
    write_csv(df, str(tmp_path / "again_csv"), ["symbol"])
    assert read_bars(spark, str(tmp_path / "again_csv")).collect() == df.collect()


def test_upsert(spark):
    held = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "k string, v double")
    new = spark.createDataFrame([("b", 9.0), ("c", None), (None, 4.0)], "k string, v double")
    assert sorted(map(tuple, upserted(held, new, "k").collect()), key=str) == sorted([("a", 1.0), ("b", 9.0), ("c", None), (None, 4.0)], key=str)
    assert upserted(held.limit(0), new.limit(0), "k").count() == 0


def test_journal_lines_of_all_layouts(spark, tmp_path):
    (tmp_path / "j.csv").write_text("a,x,exit,1.5\na,x,1,stop,-1\nt,a,x,1,take,2\n\nodd line\n")
    got = sorted(map(tuple, read_journal(spark, str(tmp_path)).collect()), key=str)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(4, "a", "exit", 1.5), (5, "a", "stop", -1.0), (6, "a", "take", 2.0), (None, None, None, None)]
