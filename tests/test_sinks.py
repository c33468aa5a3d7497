"""Metrics are kept once for each run, whatever is written again."""

import pytest

from threadlens.sources import io as IO


@pytest.fixture()
def place(tmp_path):
    return str(tmp_path / "metrics")


def rows(spark, place):
    return sorted(map(tuple, IO.read_metrics(spark, place).select("model", "seed", "f1").collect()), key=str)


def test_same_runs_twice_leave_one_row_each(spark, place):
    runs = [("beto", s, s / 7) for s in range(40)] + [(None, 1, 0.12345)]
    df = spark.createDataFrame(runs, "model string, seed int, f1 double")
    for _ in range(2):
        IO.write_metrics(df, place)
        assert rows(spark, place) == sorted(((m, s, round(f, 3)) for m, s, f in runs), key=str)
    changed = spark.createDataFrame([("beto", 3, 0.5), ("mbert", 3, 0.25)], "model string, seed int, f1 double")
    IO.write_metrics(changed, place)
    want = {(m, s): round(f, 3) for m, s, f in runs} | {("beto", 3): 0.5, ("mbert", 3): 0.25}
    assert rows(spark, place) == sorted(((*k, f) for k, f in want.items()), key=str)
    IO.write_metrics(changed, place, append=False)
    assert rows(spark, place) == [("beto", 3, 0.5), ("mbert", 3, 0.25)]


def test_columns_may_differ_between_writes(spark, place):
    IO.write_metrics(spark.createDataFrame([("beto", 1, 0.5)], "model string, seed int, f1 double"), place)
    IO.write_metrics(spark.createDataFrame([("beto", 2, 0.75, 1.0)], "model string, seed int, f1 double, mse double"), place)
    got = {r.seed: (r.f1, r.mse) for r in IO.read_metrics(spark, place).collect()}
    assert got == {1: (0.5, None), 2: (0.75, 1.0)}


def test_a_failed_write_leaves_the_table(spark, place):
    df = spark.createDataFrame([("beto", 1, 0.5)], "model string, seed int, f1 double")
    IO.write_metrics(df, place)
    with pytest.raises(Exception, match="boom"):
        IO.write_metrics(df.selectExpr("model", "seed", "assert_true(f1 < 0, 'boom') IS NULL AS bad", "f1"), place)
    assert rows(spark, place) == [("beto", 1, 0.5)]
