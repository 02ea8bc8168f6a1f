"""Filters and the factor graph on motions whose result is known."""

import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.operators import estimate

SCHEMA = "run_id long, _row long, t_s double, kind string, ax double, ay double, az double, gz double, roll double, pitch double, yaw double, vE double, vN double, vU double"


def straight(spark, n=60, speed=0.5):
    rows = []
    for i in range(n):
        rows.append((1, 2 * i, 0.1 * i, "IMU", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, None))
        rows.append((1, 2 * i + 1, 0.1 * i, "BE", None, None, None, None, None, None, None, speed, 0.0, 0.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_filter_reaches_the_measured_speed(spark):
    last = estimate.inertial_filter(straight(spark)).orderBy("_row").collect()[-1]
    assert abs(last.vE - 0.5) < 0.02 and abs(last.vN) < 0.02 and 2.5 < last.E < 3.2 and last.nis < 20


def planar(spark, speed):
    """At rest for the filter, with body-frame velocities between the inertial samples."""
    imu = spark.createDataFrame([(1, i, 0.1 * i, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(60)], "run_id long, _row long, t_s double, ax double, ay double, az double, gz double, roll double, pitch double, yaw double")
    v = [(1, 100 + i, 0.1 * i + 0.04, speed, 0.0, 0.1 * i) for i in range(-3, 70)]
    velocities = spark.createDataFrame(v, "run_id long, _row long, t_s double, vE double, vN double, vU double")
    return estimate.planar_run(imu, velocities, velocities)


def test_planar_run(spark):
    rows = planar(spark, 0.5).orderBy("t_imu_s", "t_s").collect()
    seen = [r for r in rows if r.kind == "BI"]
    assert abs(rows[-1].vE - 0.5) < 0.05 and {r.status for r in rows} <= {"gap", "step", "still", "rejected", "inflated", "applied"}
    # only velocities that the samples cover, each at the first sample after it
    assert len(seen) == 59 and all(abs(r.t_imu_s - r.t_s - 0.06) < 1e-9 for r in seen)
    assert {r.status for r in planar(spark, 0.01).filter("kind = 'BI'").collect()} == {"still"}


def test_focus_record(spark):
    rows = estimate.focus_record(planar(spark, 0.5)).orderBy("t_s").collect()
    assert len(rows) == 59 and len(rows[0].asDict()) >= 60
    for r in rows:
        assert abs(r.speed_pre_h - math.hypot(r.vE_pre, r.vN_pre)) < 1e-12 and abs(r.verr_h - math.hypot(r.vE - r.vE_meas, r.vN - r.vN_meas)) < 1e-12
        assert abs(r.rwhite_norm**2 - (r.rE**2 / r.SE + r.rN**2 / r.SN)) < 1e-6 * max(1, r.rwhite_norm**2) + 0.05 * r.rwhite_norm**2
        assert r.triggered == bool(r.triggers) and ("nis" in r.triggers) == (r.nis > 25)


def test_pseudo_measurements(spark):
    rows = [(1, 2 * i, 0.1 * i, "IMU", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, None) for i in range(60)]
    rows += [(1, 2 * i + 1, 0.1 * i, ("YAW", "VU", "BI")[i % 3], None, None, None, None, None, None, 0.3, 0.2, 0.0, 0.4) for i in range(60)]
    last = estimate.inertial_filter(spark.createDataFrame(rows, SCHEMA)).orderBy("_row").collect()[-1]
    assert abs(last.yaw_rad - 0.3) < 0.02 and abs(last.vU - 0.4) < 0.05 and abs(last.vE - 0.2 * math.cos(0.3)) < 0.05 and abs(last.vN - 0.2 * math.sin(0.3)) < 0.05


def test_quaternion_of_a_pure_yaw_rate(spark):
    rows = spark.createDataFrame([(1, i, 0.1 * i, 0.0, 0.0, 0.5) for i in range(11)], "run_id long, _row long, t_s double, gx double, gy double, gz double")
    last = estimate.quaternion_attitude(rows).orderBy("_row").collect()[-1]
    assert abs(2 * math.atan2(last.qz, last.qw) - 0.5) < 1e-9


def test_update_shrinks_covariance():
    x, cov = np.zeros(11), np.eye(11)
    h = np.zeros((3, 11))
    h[:, 3:6] = np.eye(3)
    out, new, s, nis = estimate.update(x, cov, np.ones(3), h, np.eye(3) * 0.1)
    assert np.allclose(out[3:6], 1 / 1.1) and np.all(np.diag(new)[3:6] < 0.1) and np.allclose(s, 1.1) and abs(nis - 3 / 1.1) < 1e-12


def test_many_runs_in_step_equal_one_at_a_time(spark):
    rng = np.random.default_rng(2)
    rows = []
    for run in range(7):
        for i in range(int(rng.integers(3, 60))):
            kind = ["IMU", "BE", "BI", "YAW", "VU"][0 if i == 0 and run else rng.integers(5)]
            rows.append((run, i, float(np.round(rng.uniform(0, 6), 2)), kind, *(float(v) for v in rng.normal(size=7) * 0.3), *(float(v) if rng.random() > 0.05 else None for v in rng.normal(size=3))))
    table, noise = spark.createDataFrame(rows, SCHEMA), estimate.Noise(most_dt=0.8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")  # so that runs go on in other batches
    try:
        got = {(r.run_id, r._row): r for r in estimate.inertial_filter(table, noise).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for run in range(7):
        x, cov, last, roll, pitch = np.zeros((1, 11)), np.diag(np.square(noise.start))[None], None, 0.0, 0.0
        for _, row, t, kind, ax, ay, az, gz, r_, p_, y_, *v in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[3] != "IMU", r[1])):
            nis = math.nan
            if kind == "IMU":
                if last is None:
                    x[0, 6] = estimate.wrap(y_)
                elif 0 < t - last <= noise.most_dt:
                    x, cov = estimate.propagate(x, cov, np.array([t - last]), np.array([[ax, ay, az]]), np.array([gz]), np.array([r_]), np.array([p_]), noise)
                last, roll, pitch = t, r_, p_
            elif last is not None:
                z = np.array([math.nan if c is None else c for c in v])
                h, res, wide = {"YAW": (np.eye(11)[[6]], np.array([estimate.wrap(y_ - x[0, 6])]), [noise.yaw]), "VU": (np.eye(11)[[5]], z[2:] - x[0, 5:6], [noise.velocity_z])}.get(kind, (None, None, [noise.velocity_xy, noise.velocity_xy, noise.velocity_z]))
                if h is None:
                    into = estimate.rotation(roll, pitch, x[0, 6]).T if kind == "BI" else np.eye(3)
                    h, res = into @ np.eye(11)[3:6], z - into @ x[0, 3:6]
                if np.isfinite(res).all():
                    a, b, _, nis = estimate.update(x[0], cov[0], res, h, np.diag(np.square(wide)))
                    x, cov = a[None], b[None]
            r = got[run, row]
            assert np.allclose([r.E, r.N, r.U, r.vE, r.vN, r.vU, r.yaw_rad], [*x[0, :6], x[0, 6]], atol=1e-9) and (np.isclose(r.nis, nis) if not math.isnan(nis) else r.nis is None or math.isnan(r.nis))


# --- inputs that aren't numbers, and updates that are rolled back --------------------------------


def odd_rows():
    rng = np.random.default_rng(6)
    rows = []
    for run in range(5):
        for i in range(80):
            kind = "IMU" if i < 2 or rng.random() < 0.6 else ("BE", "BI", "YAW", "VU")[rng.integers(4)]
            numbers = [float(v) for v in rng.normal(size=10) * 0.3]
            for j in range(10):
                if i > 2 and rng.random() < 0.03:
                    numbers[j] = [None, math.nan, math.inf][rng.integers(3)]
            if kind != "IMU" and rng.random() < 0.2:
                numbers[6:] = [3.0, 5.0, -4.0, 6.0]  # far off
            rows.append((run, i, round(0.1 * i, 2), kind, *numbers))
    return rows


def one_by_one(rows, noise, retry):
    """(status, state, counters) after each row of one run, a row at a time, with copies of all that an update may change."""
    x, cov, last, roll, pitch, counts, out = np.zeros(11), np.diag(np.square(noise.start)), None, 0.0, 0.0, [0, 0, 0], {}
    fine = lambda *v: all(c is not None and math.isfinite(c) for c in v)
    for _, row, t, kind, ax, ay, az, gz, r_, p_, y_, *v in sorted(rows, key=lambda r: (r[2], r[3] != "IMU", r[1])):
        if kind == "IMU":
            sound = fine(ax, ay, az, gz, r_, p_)
            status = "gap"
            if not sound:
                status = "bad_input"
            elif last is None:
                status, x[6] = "start", estimate.wrap(y_) if fine(y_) else 0.0
            elif 0 < t - last <= noise.most_dt:
                status = "step"
                a, b = estimate.propagate(x[None], cov[None], np.array([t - last]), np.array([[ax, ay, az]]), np.array([gz]), np.array([r_]), np.array([p_]), noise)
                x, cov = a[0], b[0]
            if sound or last is not None:
                last = t
            if sound:
                roll, pitch = r_, p_
        elif last is None:
            status = "waiting"
        else:
            needed = {"YAW": [y_], "VU": v[2:]}.get(kind, v)
            status = "rejected_nan"
            if fine(*needed):
                for attempt in range(1 + (retry.attempts if retry else 0)):
                    kept = x.copy(), cov.copy(), list(counts)
                    wide = retry.times**attempt if retry else 1.0
                    if kind == "YAW":
                        h, res, sd = np.eye(11)[[6]], np.array([estimate.wrap(y_ - x[6])]), [noise.yaw]
                    elif kind == "VU":
                        h, res, sd = np.eye(11)[[5]], np.array([v[2] - x[5]]), [noise.velocity_z]
                    else:
                        into = estimate.rotation(roll, pitch, x[6]).T if kind == "BI" else np.eye(3)
                        h, res, sd = into @ np.eye(11)[3:6], np.array(v) - into @ x[3:6], [noise.velocity_xy, noise.velocity_xy, noise.velocity_z]
                    x, cov, _, nis = estimate.update(x, cov, res, h, np.diag(np.square(sd)) * wide)
                    counts[0] += 1
                    counts[1] += attempt > 0
                    status = "retried" if attempt else "applied"
                    if not retry or nis <= retry.limit:
                        break
                    (x, cov, counts), status = kept, "rejected"
                counts[2] += status == "rejected"
        out[row] = status, x.copy(), tuple(counts)
    return out


def test_odd_inputs_and_retries_equal_one_row_at_a_time(spark):
    rows, noise = odd_rows(), estimate.Noise(most_dt=0.35)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for retry in (None, estimate.Retry(limit=15.0, times=20.0, attempts=2)):
        got = estimate.inertial_filter(table, noise, retry).collect()
        assert len(got) == len(rows)
        want = {run: one_by_one([r for r in rows if r[0] == run], noise, retry) for run in range(5)}
        for r in got:
            status, x, counts = want[r.run_id][r._row]
            assert r.status == status and (r.n_used, r.n_retried, r.n_rejected) == counts
            assert np.allclose([r.E, r.N, r.U, r.vE, r.vN, r.vU, r.yaw_rad], x[:7], atol=1e-9)
        seen = {r.status for r in got}
        assert {"start", "step", "gap", "bad_input", "rejected_nan", "applied"} <= seen and (not retry or {"retried", "rejected"} <= seen)
        audit = estimate.update_audit(spark.createDataFrame(got)).collect()
        assert all(r.used == (r.status in ("applied", "retried")) and r.report_ok == (r.status not in ("waiting", "rejected_nan")) for r in audit)
        assert all(abs(r.dvE) + abs(r.dpE) == 0 for r in audit if not r.used) and any(r.dvE for r in audit)


def test_snapshot_and_restore():
    state = [np.arange(12.0).reshape(4, 3), np.arange(4), np.zeros((4, 2, 2))]
    runs, was = np.array([3, 1]), [a.copy() for a in state]
    taken = estimate.snapshot(state, runs)
    for a in state:
        a += 7
    estimate.restore(state, runs, taken, np.array([True, False]))
    for a, b in zip(state, was):
        assert (a[3] == b[3]).all() and (a[[0, 1, 2]] == b[[0, 1, 2]] + 7).all()


def test_planar_run_with_odd_inputs(spark):
    nan, inf = math.nan, math.inf
    imu = [[1, i, 0.1 * i, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] for i in range(40)]
    imu[1][3], imu[5][6], imu[6][8], imu[20][9] = None, nan, inf, nan  # an acceleration, a rate, a pitch, a heading
    schema = "run_id long, _row long, t_s double, ax double, ay double, az double, gz double, roll double, pitch double, yaw double"
    v = [[1, 100 + i, 0.1 * i + 0.04, 0.5, 0.0, 0.0] for i in range(39)]
    v[7][3], v[12][4], v[13][5] = nan, None, inf
    velocities = spark.createDataFrame(v, "run_id long, _row long, t_s double, vE double, vN double, vU double")
    rows = estimate.planar_run(spark.createDataFrame(imu, schema), velocities, velocities).orderBy("t_imu_s", "kind", "t_s").collect()
    by = {r._row: r for r in rows}
    assert [by[i].status for i in (1, 2, 5, 6, 7, 20)] == ["bad_input", "gap", "bad_input", "bad_input", "step", "step"]
    assert {i for i, r in by.items() if r.status == "rejected_nan"} >= {107, 112, 113} and by[107].nis0 is None or math.isnan(by[107].nis0)
    assert all(math.isfinite(r.E) and math.isfinite(r.vE) for r in rows) and abs(rows[-1].vE - 0.5) < 0.05
    assert len(estimate.focus_record(estimate.planar_run(spark.createDataFrame(imu, schema), velocities, velocities)).collect()) == len([r for r in rows if r.kind == "BI"])


def test_runs_are_dealt_out_after_a_union(spark):
    """Both sides are partitioned by run already; they are read in parts of their own once sizes differ, so an exchange has to be over the union."""
    rows = lambda n: spark.range(n).select((F.col("id") % 50).alias("run_id"), F.col("id").cast("double").alias("t_s")).withColumn("least", F.min("t_s").over(W.partitionBy("run_id")))
    plan = estimate.sorted_runs(rows(20_000).unionByName(rows(200)), "t_s")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Exchange") < plan.find("Union")
