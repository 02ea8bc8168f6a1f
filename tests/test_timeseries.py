"""Windows and alignment against numpy and pandas on small series with ties, gaps and repeated times."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewake.functions import geometry as geo
from tidewake.operators import asof, deadreckon, gates, stats
from tidewake.operators import timeseries as ts
from tidewake.plans import catalogue

KS = [12, 72, 28, 96, 27, 11, 15]


def series(spark, values, times=None, run=1):
    times = range(len(values)) if times is None else times
    return spark.createDataFrame([(run, i, float(t), float(v)) for i, (t, v) in enumerate(zip(times, values))], "run_id long, _row long, t_s double, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("run_id", "t_s", "_row").select(name).collect()]


@pytest.mark.parametrize("size", [1, 2, 5, 6])
def test_moving_average_is_zero_padded(spark, size):
    x = np.random.default_rng(1).normal(size=11)
    got = column(series(spark, x).withColumn("y", ts.moving_average_same(F.col("x"), size)), "y")
    assert np.allclose(got, np.convolve(x, np.ones(size) / size, "same"))


def test_rolling_median(spark):
    x = np.random.default_rng(2).normal(size=15)
    got = column(series(spark, x).withColumn("y", ts.rolling_median(F.col("x"), 7)), "y")
    want = pd.Series(x).rolling(7, center=True, min_periods=3).median()
    assert np.allclose(got, want)


def test_unwrap(spark):
    x = np.concatenate([np.linspace(0, 20, 40), np.linspace(20, -9, 30)])
    wrapped = (x + math.pi) % (2 * math.pi) - math.pi
    got = column(ts.unwrap(series(spark, wrapped), "x", "y"), "y")
    assert np.allclose(got, np.unwrap(wrapped))


def test_downsample_matches_linspace(spark):
    for n, points in ((50, 7), (5, 9), (20, 20), (21, 20)):
        got = sorted(column(ts.downsample(series(spark, range(n)), points), "x"))
        assert got == sorted(set(np.linspace(0, n - 1, min(points, n)).astype(int))) or n <= points


def test_guard_drops_gaps(spark):
    got = column(ts.guarded_dt(series(spark, [0] * 6, [0, 1, 2, 3, 30, 31]), 0.0), "dt")
    assert got == [0, 1, 1, 1, 0, 1]


@pytest.mark.parametrize("tie,want", [("later", 2.0), ("earlier", 0.0)])
def test_nearest_tie(spark, tie, want):
    left = series(spark, [0], [1.0]).drop("x")
    got = asof.nearest(left, series(spark, [10, 20], [0.0, 2.0]), ["x"], tie=tie).first()
    assert got.match_t_s == want


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lt, rt = np.sort(rng.integers(0, 40, 12) / 2), np.unique(rng.integers(0, 40, 9) / 2)
    for tie in ("later", "earlier"):
        got = column(asof.nearest(series(spark, lt, lt).drop("x"), series(spark, rt, rt), ["x"], tie=tie), "x")
        best = lambda t: min(rt, key=lambda r: (abs(r - t), -r if tie == "later" else r))  # noqa: E731, B023
        assert got == [best(t) for t in lt]


def test_forward_has_no_match_at_the_end(spark):
    got = asof.forward(series(spark, [0, 0], [1.0, 5.0]).drop("x"), series(spark, [7], [3.0]), ["x"]).orderBy("t_s").collect()
    assert [r.x for r in got] == [7.0, None]


def test_interpolation_clamps(spark):
    lt, rt, rv = [0.0, 1.5, 9.0], [1.0, 2.0, 4.0], [10.0, 20.0, 0.0]
    got = column(asof.interpolated(series(spark, [0] * 3, lt).drop("x"), series(spark, rv, rt), ["x"]), "interp_x")
    assert np.allclose(got, np.interp(lt, rt, rv))


def test_constant_velocity(spark):
    rows = spark.createDataFrame([(1, i, float(i), 1.0, 0.5, 0.0) for i in range(11)], "run_id long, _row long, t_s double, vE double, vN double, vU double")
    last = deadreckon.from_earth_velocity(rows).orderBy(F.desc("t_s")).first()
    assert (last.E, last.N, last.U) == (10.0, 5.0, 0.0) and abs(last.yaw_rad - math.atan2(0.5, 1.0)) < 1e-12


def test_level_imu_is_at_rest(spark):
    rows = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, math.pi, 0.0, math.pi / 2) for i in range(9)], "run_id long, _row long, t_s double, ax double, ay double, az double, gx double, gy double, gz double, roll double, pitch double, yaw double")
    out = deadreckon.preprocessed_imu(rows, static_s=3.0).collect()
    assert all(abs(r.lin_z) < 1e-12 and abs(r.lin_x) < 1e-12 for r in out)


def test_nan_passes_gates(spark):
    rows = spark.createDataFrame([(1, i, float(i), v, 0.0, 0.0) for i, v in enumerate([0.0, float("nan"), 0.0, 9.0])], "run_id long, _row long, t_s double, vE double, vN double, vU double")
    got = rows.select("_row", gates.jump_gate().alias("j")).orderBy("_row").collect()
    assert [r.j for r in got] == [False, False, False, True]


def test_order_of_rows_is_immaterial(spark):
    rows = series(spark, np.random.default_rng(5).normal(size=30)).withColumn("vE", F.col("x")).withColumn("vN", F.col("x")).withColumn("vU", F.lit(0.0))
    a = gates.preprocessed_velocity(rows).orderBy("_row").collect()
    b = gates.preprocessed_velocity(rows.orderBy(F.rand(3)).repartition(3)).orderBy("_row").collect()
    assert a == b


def test_course_keeps_the_sign_of_zeros(spark):
    v = [(0.0, 0.0), (-0.0, 0.0), (-0.0, -0.0), (-1.0, -0.0), (-1.0, 0.0), (0.0, -2.0), (1.0, -0.0)]
    rows = spark.createDataFrame(v, "e double, n double").select("e", "n", geo.course(F.col("e"), F.col("n")).alias("c")).collect()
    assert all(r.c == math.atan2(r.n, r.e) for r in rows)


def test_heading_of_no_velocity_is_unwrapped_from_the_half_turn(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, -1.0, -0.1), (1, 1, 1.0, -0.0, 0.0)], "run_id long, _row long, t_s double, e double, n double")
    made = ts.unwrap(rows.withColumn("h", geo.course(F.col("e"), F.col("n")) * 0.97), "h", "un")
    assert np.allclose(column(made, "un"), np.unwrap([0.97 * math.atan2(-0.1, -1.0), 0.97 * math.pi]))


def test_correlation_with_a_constant_is_null(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0), (0, 1.0, 5.0), (1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0), (2, 1e-170, 1e-170), (2, 0.0, 0.0)], "g long, x double, y double")
    got = {r.g: r.c for r in rows.groupBy("g").agg(stats.pearson(F.col("x"), F.col("y"), 2).alias("c")).collect()}
    assert got[0] is None and abs(got[1] - 1) < 1e-12


def test_the_first_of_equal_axes_dominates(spark, tmp_path):
    """The mean squares of gx and gz are 13.5 / 7 each, but for the last digits of their sums."""
    when = datetime.datetime(2024, 1, 1)
    rows = [(i, when, 1, "view", 5.0, f'{{"k": {k}}}') for i, k in enumerate(KS * 6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert [r.axis for r in catalogue.queries()["a15_residual_dominance"](spark, str(tmp_path)).collect()] == ["x"]
