"""Recursive estimators: an 11-state and a planar error-state filter.

A run is sequential by nature; runs are spread over the cluster, and those of a task are stepped
through side by side, as arrays. What can be said of a row without the
state (matches, rotated measurements, selection) is made of columns before the grouped step. Time-ordered
input is made here again, so shuffles can't harm it. A row with a null or non-finite input that it needs
changes no state: its status says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import geometry as geo
from tidewake.functions.columns import above
from tidewake.operators.asof import forward, nearest, overlap

P, V, YAW, BA, BG = slice(0, 3), slice(3, 6), 6, slice(7, 10), 10


def wrap(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


def rotation(roll: float, pitch: float, yaw: float) -> np.ndarray:
    cr, sr, cp, sp, cy, sy = math.cos(roll), math.sin(roll), math.cos(pitch), math.sin(pitch), math.cos(yaw), math.sin(yaw)
    return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])


@dataclass(frozen=True)
class Noise:
    """Standard deviations of inputs and measurements, and of the start."""

    acc: float = 0.05
    gyro: float = 0.005
    acc_bias: float = 1e-4
    gyro_bias: float = 1e-5
    velocity_xy: float = 0.05
    velocity_z: float = 0.05
    yaw: float = 0.05
    start: tuple[float, ...] = (1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.2, 0.05, 0.05, 0.05, 0.01)
    most_dt: float = 1.0
    gravity: float = 0.0  # 0 for linear acceleration, else specific force


def rotations(roll: np.ndarray, pitch: np.ndarray, yaw: np.ndarray) -> np.ndarray:
    """``rotation`` of many attitudes: (n, 3, 3)."""
    cr, sr, cp, sp, cy, sy = np.cos(roll), np.sin(roll), np.cos(pitch), np.sin(pitch), np.cos(yaw), np.sin(yaw)
    rows = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def propagate(x: np.ndarray, cov: np.ndarray, dt: np.ndarray, acc: np.ndarray, gz: np.ndarray, roll: np.ndarray, pitch: np.ndarray, noise: Noise) -> tuple[np.ndarray, np.ndarray]:
    """One inertial step of many states (n, 11): the mid-point attitude turns the acceleration; the transition is of second order in dt."""
    n, force, rate, d = len(x), acc - x[:, BA], gz - x[:, BG], dt[:, None]
    turn = rotations(roll, pitch, x[:, YAW] + 0.5 * rate * dt)
    a = (turn @ force[:, :, None])[:, :, 0] - np.array([0.0, 0.0, noise.gravity])
    out = x.copy()
    out[:, P] += x[:, V] * d + 0.5 * a * d * d
    out[:, V] += a * d
    out[:, YAW] = wrap(x[:, YAW] + rate * dt)
    flow = np.zeros((n, 11, 11))
    flow[:, P, V], flow[:, V, BA], flow[:, YAW, BG] = np.eye(3), -turn, -1.0
    flow[:, V, YAW] = (turn @ np.stack((-force[:, 1], force[:, 0], np.zeros(n)), -1)[:, :, None])[:, :, 0]
    spread, d = np.zeros((11, 11)), dt[:, None, None]
    spread[V, V] = noise.acc**2 * np.eye(3)
    spread[YAW, YAW], spread[BA, BA], spread[BG, BG] = noise.gyro**2, noise.acc_bias**2 * np.eye(3), noise.gyro_bias**2
    step, back = np.eye(11) + flow * d + 0.5 * (flow @ flow) * d * d, flow.transpose(0, 2, 1)
    grown = spread * d + 0.5 * (flow @ spread + spread @ back) * d**2 + (flow @ spread @ back) * d**3 / 3
    cov = step @ cov @ step.transpose(0, 2, 1) + grown
    return out, 0.5 * (cov + cov.transpose(0, 2, 1))


def update(x: np.ndarray, cov: np.ndarray, r: np.ndarray, h: np.ndarray, noise: np.ndarray, yaw: int | None = YAW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linear updates with residuals r in Joseph form, of one state or of many; returns state, covariance, diagonal of S, and r' S^-1 r."""
    t = lambda m: np.swapaxes(m, -1, -2)
    s = h @ cov @ t(h) + noise
    gain = t(np.linalg.solve(s, h @ cov))
    keep = np.eye(x.shape[-1]) - gain @ h
    out = x + (gain @ r[..., None])[..., 0]
    if yaw is not None:
        out[..., yaw] = wrap(out[..., yaw])
    cov = keep @ cov @ t(keep) + gain @ noise @ t(gain)
    return out, 0.5 * (cov + t(cov)), np.diagonal(s, axis1=-2, axis2=-1), np.einsum("...i,...i->...", r, np.linalg.solve(s, r[..., None])[..., 0])


def in_step(runs: Iterator[pd.DataFrame], start: Callable[[int], list[np.ndarray]], advance: Callable[[list[np.ndarray], np.ndarray, np.ndarray], None]) -> Iterator[pd.DataFrame]:
    """Steps through many runs at once, in batches of rows sorted by run and in order inside each.

    ``start`` makes the states of n runs, arrays by run; ``advance(state, runs, rows)`` moves the states of
    ``runs`` by one row of the batch each, set by ``advance.load`` before. A run that goes on in the next batch takes its state along, so a
    batch is all that is held, however long a run is.
    """
    carried = None
    for batch in runs:
        if not len(batch):
            continue
        ids = batch["run_id"].to_numpy()
        begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        size = np.diff(np.append(begin, len(ids)))
        state = start(len(begin))
        if carried is not None and carried[0] == ids[0]:
            for mine, was in zip(state, carried[1]):
                mine[0] = was
        advance.load(batch)
        for k in range(int(size.max())):
            live = np.flatnonzero(size > k)
            advance(state, live, begin[live] + k)
        carried = ids[-1], [a[-1].copy() for a in state]
        yield advance.made()


def snapshot(state: list[np.ndarray], runs: np.ndarray) -> list[np.ndarray]:
    """What all of ``state`` holds of ``runs``: states, covariances, clocks and counters."""
    return [a[runs].copy() for a in state]


def restore(state: list[np.ndarray], runs: np.ndarray, taken: list[np.ndarray], which: np.ndarray) -> None:
    """Sets those of ``runs`` that ``which`` marks back to what ``snapshot`` took of them."""
    for a, was in zip(state, taken):
        a[runs[which]] = was[which]


def sorted_runs(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a run in one partition and in order, beside those of other runs.

    Runs are dealt out by their hash: Spark leaves out ``repartition("run_id")`` over a union of tables that are
    partitioned by run already, and then reads the sides of that union in parts of their own.
    """
    return rows.repartition(F.xxhash64("run_id")).sortWithinPartitions("run_id", *order)


def measurements(be: DataFrame, bi: DataFrame, *, use_body: bool = True) -> DataFrame:
    """``be`` with the measurement zE, zN, zU of each row, its speeds and ``src_xy``, the source of the horizontal part.

    The vertical part is always that of the earth-frame log. The horizontal part is the body-frame
    velocity of the same ordinal, turned by the row's attitude (roll, pitch, yaw), in runs where both
    logs have as many rows; else it is the earth-frame velocity.
    """
    order, whole = W.partitionBy("run_id").orderBy("t_s", "_row"), W.partitionBy("run_id")
    numbered = lambda df: df.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(whole)})
    body = numbered(bi).select("run_id", "_i", F.col("_n").alias("_m"), F.col("vE").alias("_x"), F.col("vN").alias("_y"), F.col("vU").alias("_z"))
    rows = numbered(be).join(body, ["run_id", "_i"], "left")
    aligned = F.coalesce(F.col("_m") == F.col("_n"), F.lit(False)) & F.lit(use_body)
    east, north, _ = geo.rotate(geo.rotation(F.col("roll"), F.col("pitch"), F.col("yaw")), (F.col("_x"), F.col("_y"), F.col("_z")))
    rows = rows.withColumns({"src_xy": F.when(aligned, "BI").otherwise("BE"), "zE": F.when(aligned, east).otherwise(F.col("vE")), "zN": F.when(aligned, north).otherwise(F.col("vN")), "zU": F.col("vU")})
    rows = rows.withColumns({"speed_h": F.hypot("zE", "zN"), "speed_3d": F.sqrt(F.col("zE") ** 2 + F.col("zN") ** 2 + F.col("zU") ** 2)})
    return rows.drop("_i", "_n", "_m", "_x", "_y", "_z")


FILTERED = (
    "run_id long, _row long, t_s double, kind string, E double, N double, U double, yaw_rad double, vE double, vN double, vU double, nis double, r0 double, r1 double, r2 double, S0 double, S1 double, S2 double, "
    "E_pre double, N_pre double, U_pre double, vE_pre double, vN_pre double, vU_pre double, inflate double, status string, n_used long, n_retried long, n_rejected long"
)


@dataclass(frozen=True)
class Retry:
    """A measurement whose normalised innovation is over ``limit`` is undone and tried again with ``times`` the noise, ``attempts`` times; then it is rejected."""

    limit: float = 25.0
    times: float = 10.0
    attempts: int = 2


def inertial_filter(timeline: DataFrame, noise: Noise = Noise(), retry: Retry | None = None) -> DataFrame:
    """Runs the 11-state filter over each run of ``timeline``: a row out for each row in.

    Rows are IMU samples (ax, ay, az, gx, gy, gz in SI units, roll, pitch, yaw), velocities (vE, vN,
    vU) or pseudo-measurements: BE is a velocity in the earth frame, BI one in the body frame, compared
    with the state's velocity there; YAW is a heading (``yaw``), VU a vertical velocity (``vU``). At one time IMU
    rows come first. Steps over ``noise.most_dt`` or back advance the clock alone.

    ``status`` of a sample is ``start``, ``step``, ``gap`` (the clock alone) or ``bad_input``, where an input isn't a
    finite number (the clock alone; without a time not even that). Of a measurement it is ``waiting`` (before the first
    sample), ``rejected_nan``, ``applied``, ``retried`` or ``rejected``; the last two need ``retry``. A
    rejected one leaves state, covariance and counters as they were before it; its diagnostics are those of the last attempt.
    """

    names = [c.split()[0] for c in FILTERED.split(", ")]
    pick, spread = np.eye(11)[V], np.diag([noise.velocity_xy**2, noise.velocity_xy**2, noise.velocity_z**2])

    class Step:
        def load(self, batch: pd.DataFrame) -> None:
            self.batch = batch
            self.kind = batch["kind"].to_numpy()
            self.t, self.gz, self.roll, self.pitch, self.yaw = (batch[c].to_numpy(np.float64) for c in ("t_s", "gz", "roll", "pitch", "yaw"))
            self.acc, self.z = (batch[list(c)].to_numpy(np.float64) for c in (("ax", "ay", "az"), ("vE", "vN", "vU")))
            self.sound = np.isfinite(self.acc).all(axis=1) & np.isfinite(self.gz) & np.isfinite(self.roll) & np.isfinite(self.pitch) & np.isfinite(self.t)
            self.out, self.status, self.counts = np.full((len(batch), 21), np.nan), np.full(len(batch), "waiting", object), np.zeros((len(batch), 3), np.int64)

        def made(self) -> pd.DataFrame:
            out = pd.DataFrame(self.out, columns=names[4:25]).assign(status=self.status)
            counts = pd.DataFrame(self.counts, columns=names[26:])
            return pd.concat([self.batch[names[:4]].reset_index(drop=True), out, counts], axis=1)

        def __call__(self, state: list[np.ndarray], runs: np.ndarray, rows: np.ndarray) -> None:
            x, cov, last, roll, pitch, counts = state
            self.out[rows, 14:20] = x[runs][:, :6]
            inertial = self.kind[rows] == "IMU"
            a, at = runs[inertial], rows[inertial]
            new, sound, dt = np.isnan(last[a]), self.sound[at], self.t[at] - last[a]
            begun = new & sound & np.isfinite(self.yaw[at])
            x[a[begun], YAW] = wrap(self.yaw[at[begun]])
            go = sound & (dt > 0) & (dt <= noise.most_dt)
            b, r = a[go], at[go]
            if len(b):
                x[b], cov[b] = propagate(x[b], cov[b], dt[go], self.acc[r], self.gz[r], self.roll[r], self.pitch[r], noise)
            self.status[at] = np.select([~sound, new, go], ["bad_input", "start", "step"], "gap")
            timed = np.isfinite(self.t[at]) & (sound | ~new)  # a run begins with a sound sample
            last[a[timed]] = self.t[at[timed]]
            roll[a[sound]], pitch[a[sound]] = self.roll[at[sound]], self.pitch[at[sound]]
            begun = ~inertial & ~np.isnan(last[runs])
            for kind in ("YAW", "VU", "velocity"):
                mine = begun & (self.kind[rows] == kind if kind != "velocity" else ~np.isin(self.kind[rows], ("YAW", "VU")))
                a, at = runs[mine], rows[mine]
                if not len(a):
                    continue
                if kind == "YAW":
                    h, residual, wide = np.eye(11)[[YAW]], wrap(self.yaw[at] - x[a, YAW])[:, None], np.array([[noise.yaw**2]])
                elif kind == "VU":
                    h, residual, wide = np.eye(11)[[5]], (self.z[at, 2] - x[a, 5])[:, None], np.array([[noise.velocity_z**2]])
                else:
                    turn = rotations(roll[a], pitch[a], x[a, YAW]).transpose(0, 2, 1)
                    into = np.where((self.kind[at] == "BI")[:, None, None], turn, np.eye(3))
                    h, wide = into @ pick, spread
                    residual = self.z[at] - (into @ x[a][:, V, None])[:, :, 0]
                good = np.isfinite(residual).all(axis=1)
                self.status[at] = np.where(good, "applied", "rejected_nan")
                if good.any():
                    self.measure(state, a[good], at[good], residual[good], h[good] if h.ndim == 3 else h, wide)
            self.out[rows, 0:3], self.out[rows, 3], self.out[rows, 4:7] = x[runs][:, P], x[runs, YAW], x[runs][:, V]
            self.counts[rows] = counts[runs]

        def measure(self, state: list[np.ndarray], a: np.ndarray, at: np.ndarray, residual: np.ndarray, h: np.ndarray, wide: np.ndarray) -> None:
            """Updates the states of the runs ``a`` by their rows ``at``; what ``retry`` finds too far off is rolled back and tried again."""
            x, cov, counts = state[0], state[1], state[5]
            n, times = residual.shape[1], 1.0
            for attempt in range(1 + (retry.attempts if retry else 0)):
                before = snapshot(state, a)
                x[a], cov[a], s, nis = update(x[a], cov[a], residual, h, wide * times)
                counts[a, 0] += 1
                counts[a, 1] += attempt > 0
                self.out[at, 7], self.out[at, 8 : 8 + n], self.out[at, 11 : 11 + n], self.out[at, 20] = nis, residual, s, times
                if attempt:
                    self.status[at] = "retried"
                over = nis > retry.limit if retry else np.zeros(len(a), bool)
                if not over.any():
                    return
                restore(state, a, before, over)
                self.status[at[over]] = "rejected"
                a, at, residual, h, times = a[over], at[over], residual[over], h[over] if h.ndim == 3 else h, times * retry.times
            counts[a, 2] += 1

    def start(n: int) -> list[np.ndarray]:
        return [np.zeros((n, 11)), np.tile(np.diag(np.square(noise.start)), (n, 1, 1)), np.full(n, np.nan), np.zeros(n), np.zeros(n), np.zeros((n, 3), np.int64)]

    rows = timeline.withColumn("_rank", F.when(F.col("kind") == "IMU", 0).otherwise(1))
    return sorted_runs(rows, "t_s", "_rank", "_row").mapInPandas(lambda batches: in_step(batches, start, Step()), FILTERED)


def update_audit(filtered: DataFrame) -> DataFrame:
    """The measurements of ``inertial_filter`` with what each changed: dvE, dvN, dvU, dpE, dpN, dpU, whether it was used, and report_ok, whether it has an innovation."""
    rows = filtered.filter("kind <> 'IMU'")
    after = {f"dv{a}": F.col(f"v{a}") - F.col(f"v{a}_pre") for a in "ENU"} | {f"dp{a}": F.col(a) - F.col(f"{a}_pre") for a in "ENU"}
    return rows.withColumns(after | {"used": F.col("status").isin("applied", "retried"), "report_ok": F.col("nis").isNotNull() & ~F.isnan("nis")})


@dataclass(frozen=True)
class PlanarLimits:
    sigma_acc: float = 0.25
    sigma_gyro: float = 0.01
    sigma_bias: float = 1e-4
    sigma_velocity: float = 0.008
    sigma_still: float = 0.06
    still_speed: float = 0.04
    dead_acc: float = 0.02
    clip_acc: float = 1.5
    leak: float = 0.35
    most_speed: float = 0.80
    dt_max: float = 0.5
    nis_soft: float = 25.0
    nis_target: float = 25.0
    nis_hard: float = 120.0
    ratio_soft: float = 2.5
    ratio_hard: float = 10.0
    speed_floor: float = 0.07
    inflate_max: float = 5e3
    reject_after: bool = False


#: A row of the planar run: the state after it, and of velocities what the update saw.
PLANAR = (
    "run_id long, _row long, kind string, t_s double, t_imu_s double, E double, N double, vE double, vN double, yaw_rad double, bgz double, prop_ok boolean, dt_prop_s double, yaw_used_rad double, vU_be double, "
    "status string, E_pre double, N_pre double, vE_pre double, vN_pre double, vE_meas double, vN_meas double, rE double, rN double, SE double, SN double, S_cond double, nis0 double, nis1 double, R_inflate double, "
    "R_E double, R_N double, HPHt_E double, HPHt_N double, rwhiteE double, rwhiteN double, dx_norm double, dx_v_h double, dx_yaw double, dx_bgz double, Pcond double, P_pos_tr double, P_vel_tr double, P_yaw double, P_bgz double"
)


def planar_inputs(imu: DataFrame, bi: DataFrame, be: DataFrame) -> DataFrame:
    """The planar run's rows: run_id, _row, kind, t_s, t_imu_s, roll, pitch, yaw and the inputs of each.

    Only the time that both logs cover counts. A body-frame velocity (vE, vN, vU of ``bi``) belongs to the
    first inertial sample at or after it, whose attitude turns it into vE_meas, vN_meas; vU_be is the
    vertical velocity of the nearest row of ``be``.
    """
    window = overlap(imu, bi)
    inside = lambda df: df.join(window, "run_id").filter((F.col("t_s") >= F.col("t0")) & (F.col("t_s") <= F.col("t1"))).drop("t0", "t1")
    imu, bi = inside(imu), inside(bi)
    rows = forward(bi.select("run_id", "t_s", "_row", "vE", "vN", "vU"), imu, ["roll", "pitch", "yaw"], prefix="imu_").filter("imu_t_s is not null")
    east, north, _ = geo.rotate(geo.rotation(F.col("roll"), F.col("pitch"), F.col("yaw")), (F.col("vE"), F.col("vN"), F.col("vU")))
    rows = rows.select("run_id", "t_s", "_row", F.col("imu_t_s").alias("t_imu_s"), "roll", "pitch", "yaw", east.alias("vE_meas"), north.alias("vN_meas"))
    rows = nearest(rows, be.select("run_id", "t_s", "_row", F.col("vU").alias("vU_be")), ["vU_be"], tie="earlier").withColumn("kind", F.lit("BI"))
    samples = imu.select("run_id", "t_s", "_row", F.col("t_s").alias("t_imu_s"), "roll", "pitch", "yaw", "ax", "ay", "az", "gz", F.lit("IMU").alias("kind"))
    return rows.drop("match_t_s", "match_row").unionByName(samples, allowMissingColumns=True)


def planar_run(imu: DataFrame, bi: DataFrame, be: DataFrame, limits: PlanarLimits = PlanarLimits()) -> DataFrame:
    """The 6-state planar filter (position, velocity, yaw, gyro bias) over each run: a row (PLANAR) per inertial sample and velocity.

    At each inertial sample the state moves to its time, and then all velocities that belong to it are
    applied. Status of velocities: ``still`` (speed at most ``still_speed``: the measurement is zero and
    always applied), ``rejected``, ``inflated``, ``rejected_after``, ``applied``, or ``rejected_nan`` for one that isn't finite, which
    leaves state and covariance alone and has no diagnostics; of samples ``step``, ``gap``, or
    ``bad_input`` where an input isn't a finite number: the clock alone advances.
    """

    def step(x, cov, dt, acc, gz, roll, pitch):
        """States (n, 6) moved by ``dt``: turned, accelerated within limits, leaking, slowed to the most speed."""
        n, x, d = len(x), x.copy(), dt[:, None]
        x[:, 4] = wrap(x[:, 4] + (gz - x[:, 5]) * dt)

        def planar(yaw: np.ndarray) -> np.ndarray:
            a = (rotations(roll, pitch, yaw) @ acc[:, :, None])[:, :2, 0]
            return np.clip(np.where(np.abs(a) < limits.dead_acc, 0.0, a), -limits.clip_acc, limits.clip_acc)

        a = planar(x[:, 4])
        v = (x[:, 2:4] + a * d) * np.maximum(0.0, 1 - limits.leak * d)
        speed = np.hypot(v[:, 0], v[:, 1])
        x[:, 2:4] = v * np.where(speed > limits.most_speed, limits.most_speed / np.maximum(speed, 1e-12), 1.0)[:, None]
        x[:, 0:2] += x[:, 2:4] * d
        move = np.tile(np.eye(6), (n, 1, 1))
        move[:, 0, 2] = move[:, 1, 3] = dt
        move[:, 2:4, 4] = (planar(x[:, 4] + 1e-6) - a) / 1e-6 * d
        move[:, 4, 5] = -dt
        q = np.zeros((n, 6, 6))
        for i in (0, 1):
            q[:, i, i], q[:, i, i + 2], q[:, i + 2, i], q[:, i + 2, i + 2] = (limits.sigma_acc**2 * c for c in (dt**4 / 4, dt**3 / 2, dt**3 / 2, dt**2))
        q[:, 4, 4], q[:, 5, 5] = (limits.sigma_gyro * dt) ** 2, limits.sigma_bias**2 * dt
        cov = move @ cov @ move.transpose(0, 2, 1) + q
        return x, 0.5 * (cov + cov.transpose(0, 2, 1))

    names = [c.split()[0] for c in PLANAR.split(", ")]
    column = {name: i for i, name in enumerate(names)}
    pick = np.eye(6)[2:4]

    class Step:
        def load(self, batch: pd.DataFrame) -> None:
            self.batch = batch
            self.inertial = (batch["kind"] == "IMU").to_numpy()
            self.t, self.gz, self.roll, self.pitch, self.yaw, self.up = (batch[c].to_numpy(np.float64) for c in ("t_s", "gz", "roll", "pitch", "yaw", "vU_be"))
            self.acc, self.z = (batch[list(c)].to_numpy(np.float64) for c in (("ax", "ay", "az"), ("vE_meas", "vN_meas")))
            self.sound = np.isfinite(self.acc).all(axis=1) & np.isfinite(self.gz) & np.isfinite(self.roll) & np.isfinite(self.pitch) & np.isfinite(self.t)
            self.out = np.full((len(batch), len(names)), np.nan)
            self.moved, self.status = np.zeros(len(batch), bool), np.full(len(batch), "gap", object)

        def put(self, rows: np.ndarray, first: str, *values: np.ndarray) -> None:
            """Values of neighbouring columns from ``first`` on."""
            at = column[first]
            for v in values:
                wide = v.reshape(len(rows), -1)
                self.out[rows, at : at + wide.shape[1]] = wide
                at += wide.shape[1]

        def made(self) -> pd.DataFrame:
            out = pd.DataFrame(self.out, columns=names)
            return out.assign(prop_ok=self.moved, status=self.status, **{c: self.batch[c].to_numpy() for c in ("run_id", "_row", "kind", "t_s", "t_imu_s")})

        def __call__(self, state: list[np.ndarray], runs: np.ndarray, rows: np.ndarray) -> None:
            x, cov, last, moved, dt = state
            a, at = runs[self.inertial[rows]], rows[self.inertial[rows]]
            new, sound = np.isnan(last[a]), self.sound[at]
            dt[a] = np.where(new | ~np.isfinite(self.t[at]), 0.0, self.t[at] - last[a])
            begun = new & sound & np.isfinite(self.yaw[at])
            x[a[begun], 4] = wrap(self.yaw[at[begun]])
            moved[a] = sound & (dt[a] > 0) & (dt[a] <= limits.dt_max)
            b, r = a[moved[a]], at[moved[a]]
            if len(b):
                x[b], cov[b] = step(x[b], cov[b], dt[b], self.acc[r], self.gz[r], self.roll[r], self.pitch[r])
            timed = np.isfinite(self.t[at]) & (sound | ~new)  # a run begins with a sound sample
            last[a[timed]] = self.t[at[timed]]
            self.status[at] = np.select([~sound, moved[a]], ["bad_input", "step"], "gap")
            a, at = runs[~self.inertial[rows]], rows[~self.inertial[rows]]
            finite = np.isfinite(self.z[at]).all(axis=1)
            self.status[at] = "rejected_nan"
            if finite.any():
                self.measure(x, cov, a[finite], at[finite])
            self.moved[rows] = moved[runs]
            self.put(rows, "E", x[runs])
            self.put(rows, "dt_prop_s", dt[runs], self.yaw[rows], self.up[rows])

        def measure(self, x: np.ndarray, cov: np.ndarray, a: np.ndarray, at: np.ndarray) -> None:
            before, p = x[a].copy(), cov[a]
            still = np.hypot(*self.z[at].T) <= limits.still_speed
            z = np.where(still[:, None], 0.0, self.z[at])
            noise = np.eye(2) * (np.where(still, limits.sigma_still, limits.sigma_velocity) ** 2)[:, None, None]
            residual, spread = z - before[:, 2:4], pick @ p @ pick.T
            nis = np.einsum("ni,ni->n", residual, np.linalg.solve(spread + noise, residual[:, :, None])[:, :, 0])
            ratio = np.hypot(before[:, 2], before[:, 3]) / np.maximum(np.hypot(z[:, 0], z[:, 1]), limits.speed_floor)
            rejected = ~still & ((nis > limits.nis_hard) | (ratio > limits.ratio_hard))
            grown = np.maximum(np.where(nis > limits.nis_soft, nis / limits.nis_target, 1.0), np.where(ratio > limits.ratio_soft, (ratio / limits.ratio_soft) ** 2, 1.0))
            inflate = np.where(still | rejected, 1.0, np.minimum(limits.inflate_max, np.maximum(1.0, grown)))
            used = noise * inflate[:, None, None]
            new, new_cov, s, after = update(before, p, residual, pick, used, yaw=4)
            late = ~still & ~rejected & (after > limits.nis_hard) if limits.reject_after else np.zeros(len(a), bool)
            taken = ~rejected & ~late
            x[a], cov[a] = np.where(taken[:, None], new, before), np.where(taken[:, None, None], new_cov, p)
            self.status[at] = np.select([still, rejected, late, inflate > 1], ["still", "rejected", "rejected_after", "inflated"], "applied")
            whole, dx, p = spread + used, x[a] - before, cov[a]
            dx[:, 4] = wrap(dx[:, 4])
            white = np.linalg.solve(np.linalg.cholesky(whole), residual[:, :, None])[:, :, 0]
            diagonal = lambda m: np.diagonal(m, axis1=1, axis2=2)
            self.put(at, "E_pre", before[:, :4], z, residual, s, np.linalg.cond(whole), nis, np.where(rejected, np.nan, after), inflate, diagonal(used), diagonal(spread), white, np.linalg.norm(dx, axis=1), np.hypot(dx[:, 2], dx[:, 3]), dx[:, 4], dx[:, 5], np.linalg.cond(p), p[:, 0, 0] + p[:, 1, 1], p[:, 2, 2] + p[:, 3, 3], p[:, 4, 4], p[:, 5, 5])

    def start(n: int) -> list[np.ndarray]:
        return [np.zeros((n, 6)), np.tile(np.diag([0.25, 0.25, 0.36, 0.36, math.radians(10) ** 2, 4e-4]), (n, 1, 1)), np.full(n, np.nan), np.zeros(n, bool), np.zeros(n)]

    rows = planar_inputs(imu, bi, be).withColumn("_rank", F.when(F.col("kind") == "IMU", 0).otherwise(1))
    return sorted_runs(rows, "t_imu_s", "_rank", "t_s", "_row").mapInPandas(lambda batches: in_step(batches, start, Step()), PLANAR)


@dataclass(frozen=True)
class FocusLimits:
    """What a velocity update is marked for."""

    speed: float = 1.0
    ratio: float = 2.5
    nis: float = 25.0
    error: float = 0.3
    moved: float = 0.5
    white: float = 5.0
    inflate: float = 10.0


def focus_record(planar: DataFrame, limits: FocusLimits = FocusLimits()) -> DataFrame:
    """The velocity updates of ``planar_run`` with what follows from each row: speeds, errors, traces, and whether one of seven limits is passed."""
    h = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    rows = planar.filter("kind = 'BI'").withColumns(
        {
            "used": ~F.col("status").isin("rejected", "rejected_after"), "dt_match_s": F.col("t_imu_s") - F.col("t_s"), "speed_pre_h": h("vE_pre", "vN_pre"), "speed_post_h": h("vE", "vN"), "speed_meas_h": h("vE_meas", "vN_meas"),
            "verrE": F.col("vE") - F.col("vE_meas"), "verrN": F.col("vN") - F.col("vN_meas"), "nis": F.coalesce(F.nanvl("nis1", "nis0"), "nis0"), "rwhite_norm": h("rwhiteE", "rwhiteN"),
            "HPHt_over_R": F.greatest(F.col("HPHt_E") / F.col("R_E"), F.col("HPHt_N") / F.col("R_N")), "P_tr": F.col("P_pos_tr") + F.col("P_vel_tr") + F.col("P_yaw") + F.col("P_bgz"), "S_tr": F.col("SE") + F.col("SN"), "R_tr": F.col("R_E") + F.col("R_N"),
            "R_cond": F.greatest("R_E", "R_N") / F.least("R_E", "R_N"), "yaw_err_rad": geo.wrap_pi(F.col("yaw_rad") - F.col("yaw_used_rad")), "vU_ref_err": -F.col("vU_be"),
        }
    )
    rows = rows.withColumns({"verr_h": h("verrE", "verrN"), "ratio_pre_over_meas": F.col("speed_pre_h") / F.greatest("speed_meas_h", F.lit(1e-9))})
    over = {"speed_pre_h": limits.speed, "ratio_pre_over_meas": limits.ratio, "nis": limits.nis, "verr_h": limits.error, "dx_norm": limits.moved, "rwhite_norm": limits.white, "R_inflate": limits.inflate}
    return rows.withColumn("triggers", F.array_compact(F.array(*(F.when(above(F.col(c), v), F.lit(c)) for c, v in over.items())))).withColumn("triggered", F.size("triggers") > 0)


def quaternion_attitude(samples: DataFrame) -> DataFrame:
    """(run_id, _row, qw, qx, qy, qz): attitude by left end-point integration of body rates (rad/s), kept at length 1; rates that aren't finite turn nothing."""

    class Step:
        def load(self, batch: pd.DataFrame) -> None:
            self.batch, self.t, self.rate = batch, batch["t_s"].to_numpy(np.float64), batch[["gx", "gy", "gz"]].to_numpy(np.float64)
            self.out = np.empty((len(batch), 4))

        def made(self) -> pd.DataFrame:
            return self.batch[["run_id", "_row"]].reset_index(drop=True).join(pd.DataFrame(self.out, columns=["qw", "qx", "qy", "qz"]))

        def __call__(self, state: list[np.ndarray], runs: np.ndarray, rows: np.ndarray) -> None:
            q, last, rate = state
            dt = self.t[rows] - last[runs]
            a, v = runs[dt > 0], (rate[runs] * dt[:, None])[dt > 0]  # false for NaN, the first sample
            angle = np.linalg.norm(v, axis=1)
            s = np.where(angle > 1e-12, np.sin(angle / 2) / np.maximum(angle, 1e-12), 0.5)
            w, (x, y, z) = np.cos(angle / 2), (v * s[:, None]).T
            qw, qx, qy, qz = q[a].T
            new = np.stack((qw * w - qx * x - qy * y - qz * z, qw * x + qx * w + qy * z - qz * y, qw * y - qx * z + qy * w + qz * x, qw * z + qx * y - qy * x + qz * w), -1)
            q[a] = new / np.linalg.norm(new, axis=1, keepdims=True)
            timed = np.isfinite(self.t[rows])
            last[runs[timed]], rate[runs[timed]] = self.t[rows[timed]], np.where(np.isfinite(self.rate[rows[timed]]).all(axis=1)[:, None], self.rate[rows[timed]], 0.0)
            self.out[rows] = q[runs]

    def start(n: int) -> list[np.ndarray]:
        return [np.tile([1.0, 0.0, 0.0, 0.0], (n, 1)), np.full(n, np.nan), np.zeros((n, 3))]

    schema = "run_id long, _row long, qw double, qx double, qy double, qz double"
    return sorted_runs(samples, "t_s", "_row").mapInPandas(lambda batches: in_step(batches, start, Step()), schema)
