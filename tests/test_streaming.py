import datetime as dt

from pyspark.sql import functions as F

from tessera.streaming import run_trend


def events(spark, path, rows, name):
    spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m), v) for i, m, v in rows], "read_id string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def test_trend_over_two_runs_and_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in/*", "out", "state"))
    schema = "read_id string, ts timestamp, value double"
    events(spark, tmp_path / "in", [("a", 5, 1.0), ("b", 50, 3.0), ("c", 70, 5.0), ("d", 400, 9.0)], "one")
    trend = lambda: run_trend.hourly_trend(run_trend.read_drop_folder(spark, source, schema), good=F.col("value") > 2)
    run_trend.run_to_table(trend(), out, state)
    # after 400 minutes and two hours of grace, hour 0 is closed: a row for it comes too late
    events(spark, tmp_path / "in", [("late", 6, 100.0), ("e", 900, 1.0)], "two")
    run_trend.run_to_table(trend(), out, state)
    got = {r["start"].hour: (r["n"], r["share_good"], r["mean_value"]) for r in spark.read.parquet(out).collect()}
    assert got[0] == (2, 0.5, 2.0) and got[1] == (1, 1.0, 5.0) and got[6] == (1, 1.0, 9.0)


def test_first_arrivals(spark, tmp_path):
    events(spark, tmp_path / "in", [("a", 5, 1.0), ("a", 6, 2.0), ("b", 7, 3.0)], "one")
    stream = run_trend.read_drop_folder(spark, str(tmp_path / "in/*"), "read_id string, ts timestamp, value double")
    run_trend.run_to_table(run_trend.first_arrivals(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["read_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_open_windows_are_kept(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in/*", "out", "state"))
    schema = "read_id string, ts timestamp, value double"
    trend = lambda: run_trend.hourly_trend(run_trend.read_drop_folder(spark, source, schema), good=F.col("value") > 2)
    events(spark, tmp_path / "in", [("a", 5, 1.0), ("b", 70, 5.0)], "one")
    run_trend.run_to_latest(trend(), out, state)
    events(spark, tmp_path / "in", [("c", 75, 1.0), ("d", 130, 9.0)], "two")
    run_trend.run_to_latest(trend(), out, state)
    got = {r["start"].hour: (r["n"], r["share_good"], r["mean_value"]) for r in run_trend.latest(spark, out, ["start"]).collect()}
    assert got == {0: (1, 0.0, 1.0), 1: (2, 0.5, 3.0), 2: (1, 1.0, 9.0)}
