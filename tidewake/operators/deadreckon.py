"""Dead reckoning and attitude as nested running sums over a run."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions import geometry as geo
from tidewake.functions.columns import deadband
from tidewake.operators.asof import nearest
from tidewake.operators.timeseries import guarded_dt, hold_last, moving_average_same, run, running_sum, static_window, step, unwrap, whole


def from_earth_velocity(df: DataFrame, max_gap: float = 0.0, least_speed: float = 1e-3) -> DataFrame:
    """Position by summing earth-frame velocity over guarded steps; yaw is the course, held when slow."""
    df = guarded_dt(df, max_gap)
    sums = {p: running_sum(F.col(v) * F.col("dt")) for p, v in (("E", "vE"), ("N", "vN"), ("U", "vU"))}
    moving = geo.norm(F.col("vE"), F.col("vN")) > least_speed
    yaw = F.coalesce(hold_last(geo.course(F.col("vE"), F.col("vN")), moving), F.lit(0.0))
    return df.withColumns({**sums, "yaw_rad": yaw, "yaw_deg": F.degrees(yaw)})


def from_body_velocity(velocity: DataFrame, attitude: DataFrame, max_gap: float = 0.0, flip_z: bool = True) -> DataFrame:
    """Body velocities are turned by the nearest attitude (the earlier at a tie), then summed.

    ``flip_z`` mirrors the z axis of the sensor, as its mounting did; without it axes are taken as they are.
    """
    rows = nearest(velocity.drop("roll", "pitch", "yaw"), attitude, ["roll", "pitch", "yaw"], tie="earlier")
    body = F.col("vE"), F.col("vN"), F.col("vU") * (-1.0 if flip_z else 1.0)
    east, north, up = geo.rotate(geo.rotation(F.col("roll"), F.col("pitch"), F.col("yaw")), body)
    rows = guarded_dt(rows.filter(F.col("yaw").isNotNull()).withColumns({"v_e": east, "v_n": north, "v_u": up}), max_gap)
    return rows.withColumns({p: running_sum(F.col(v) * F.col("dt")) for p, v in (("E", "v_e"), ("N", "v_n"), ("U", "v_u"))})


def from_acceleration(df: DataFrame, max_gap: float = 0.0) -> DataFrame:
    """Velocity is the sum of turned acceleration, position the sum of the new velocity: two nested sums."""
    a = geo.rotate(geo.rotation(F.col("roll"), F.col("pitch"), F.col("yaw")), (F.col("lin_x"), F.col("lin_y"), F.col("lin_z")))
    df = guarded_dt(df, max_gap).withColumns({f"_a{i}": x for i, x in enumerate(a)})
    df = df.withColumns({f"v_{n}": running_sum(F.col(f"_a{i}") * F.col("dt")) for i, n in enumerate("enu")})
    return df.withColumns({p: running_sum(F.col(f"v_{n}") * F.col("dt")) for p, n in zip("ENU", "enu")}).drop("_a0", "_a1", "_a2")


def integrated(df: DataFrame, rate: str, to: str, start: float = 0.0) -> DataFrame:
    """Left end-point integration of a rate, wrapped into [-pi, pi)."""
    d = F.coalesce(step(F.col("t_s")), F.lit(0.0))
    before = F.coalesce(F.lag(rate).over(run()), F.lit(0.0))
    df = df.withColumn("_part", before * F.greatest(d, F.lit(0.0)))
    return df.withColumn(to, geo.wrap_pi(start + running_sum(F.col("_part")))).drop("_part")


def euler_rates(df: DataFrame) -> DataFrame:
    """Rates of roll, pitch and yaw from body rates gx, gy, gz (rad/s) and the attitude at hand."""
    r, p = F.col("roll"), F.col("pitch")
    turn = F.sin(r) * F.col("gy") + F.cos(r) * F.col("gz")
    cosine = F.when(F.abs(F.cos(p)) < 1e-6, F.lit(1e-6)).otherwise(F.cos(p))
    return df.withColumns({"roll_rate": F.col("gx") + turn * F.tan(p), "pitch_rate": F.cos(r) * F.col("gy") - F.sin(r) * F.col("gz"), "yaw_rate": turn / cosine})


def preprocessed_imu(df: DataFrame, *, static_s: float = 20.0, window: int = 5, rate_deadband: float = 0.0, axes: str = "rfu_to_frd", compat: bool = False) -> DataFrame:
    """Calibrated inertial samples: axes mapped, g to m/s2, deg to rad, biases of the static window taken off.

    Adds acc_*, gyro_*, lin_* (gravity added to specific force, bias off), the biases, the smoothed
    gyro_*_f and lin_*_f, and yaw_f, the mean of the unwrapped yaw (with ``compat`` of the wrapped one,
    which has an artefact at the half turn).
    """
    acc = geo.axis_map((F.col("ax"), F.col("ay"), F.col("az")), axes)
    rate = geo.axis_map((F.col("gx"), F.col("gy"), F.col("gz")), axes)
    df = df.withColumns({f"acc_{a}": c * geo.GRAVITY for a, c in zip("xyz", acc)} | {f"gyro_raw_{a}": F.radians(c) for a, c in zip("xyz", rate)})
    df = df.withColumn("static", static_window(static_s))
    force = tuple(F.col(f"acc_{a}") for a in "xyz")
    free = geo.linear_acceleration(force, F.col("roll"), F.col("pitch"), (F.lit(0.0),) * 3)
    df = df.withColumns({f"_free_{a}": c for a, c in zip("xyz", free)})
    mean = lambda c: F.avg(F.when(F.col("static"), F.col(c))).over(whole())
    df = df.withColumns({f"bias_gyro_{a}": mean(f"gyro_raw_{a}") for a in "xyz"} | {f"bias_acc_{a}": mean(f"_free_{a}") for a in "xyz"})
    df = df.withColumns({f"gyro_{a}": deadband(F.col(f"gyro_raw_{a}") - F.col(f"bias_gyro_{a}"), rate_deadband) for a in "xyz"} | {f"lin_{a}": F.col(f"_free_{a}") - F.col(f"bias_acc_{a}") for a in "xyz"})
    df = df.withColumns({f"{k}_{a}_f": moving_average_same(F.col(f"{k}_{a}"), window) for k in ("gyro", "lin") for a in "xyz"})
    df = unwrap(df, "yaw", "yaw_unwrapped")
    smooth = moving_average_same(F.col("yaw" if compat else "yaw_unwrapped"), window)
    return df.withColumn("yaw_f", geo.wrap_pi(smooth)).drop("_free_x", "_free_y", "_free_z")
