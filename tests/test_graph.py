"""The factor graph against a dense solver with numeric derivatives."""

import math

import numpy as np
import pandas as pd
import pytest

from tests.test_estimate import straight
from tidewake.operators import graph
from tidewake.operators.estimate import rotation, wrap


def dense(frames: pd.DataFrame, seen: pd.DataFrame, sigma: dict, delta: float | None, iterations: int = 10):
    """States, biases and cost of one run: factor by factor, derivatives by differences, one dense system."""
    n = len(frames)
    t, u = frames["t_s"].to_numpy(), frames[graph.INPUTS].to_numpy()
    x = np.zeros(7 * n + 4)
    x[: 7 * n].reshape(n, 7)[:, 6] = frames["yaw"].to_numpy()
    jobs = [("move", i, None) for i in range(n - 1)] + [(k, int(i), np.array(z)) for k, i, *z in seen[["kind", "node", "z0", "z1", "z2"]].itertuples(index=False)]

    def residual(job, x):
        kind, i, z = job
        a, bias = x[7 * i : 7 * i + 7], x[7 * n :]
        if kind == "move":
            b, dt, rate = x[7 * i + 7 : 7 * i + 14], t[i + 1] - t[i], u[i, 3] - bias[3]
            acc = rotation(u[i, 4], u[i, 5], a[6] + 0.5 * rate * dt) @ (u[i, :3] - bias[:3])
            return np.concatenate((b[:3] - a[:3] - a[3:6] * dt - 0.5 * acc * dt * dt, b[3:6] - a[3:6] - acc * dt, [wrap(b[6] - a[6] - rate * dt)])) / (sigma["move"] * max(dt, 1e-3))
        if kind == "prior":
            return np.concatenate((a[:6], [wrap(a[6] - z[0])], bias)) / sigma["prior"]
        if kind == "yaw":
            return np.array([wrap(a[6] - z[0])]) / sigma["yaw"]
        return ((rotation(u[i, 4], u[i, 5], a[6]).T @ a[3:6] if kind == "BI" else a[3:6]) - z) / sigma[kind]

    def weight(r):
        return 1.0 if delta is None or np.linalg.norm(r) <= delta else delta / np.linalg.norm(r)

    total = lambda x: sum(0.5 * weight(r) * r @ r for r in (residual(j, x) for j in jobs))
    cost = total(x)
    for _ in range(iterations):
        h, g = 1e-9 * np.eye(len(x)), np.zeros(len(x))
        for job in jobs:
            i = job[1]
            cols = [*range(7 * i, 7 * i + (14 if job[0] == "move" else 7)), *range(7 * n, 7 * n + 4)]
            r, jac = residual(job, x), []
            for c in cols:
                step = np.zeros(len(x))
                step[c] = 1e-6
                d = residual(job, x + step) - residual(job, x - step)
                jac.append(d / 2e-6)
            jac = np.array(jac).T
            h[np.ix_(cols, cols)] += weight(r) * jac.T @ jac
            g[cols] += weight(r) * jac.T @ r
        step = np.linalg.solve(h, -g)
        x = x + step
        x[6 : 7 * n : 7] = wrap(x[6 : 7 * n : 7])
        now = total(x)
        done = np.linalg.norm(step) < 1e-6 or abs(now - cost) < 1e-6 * max(cost, 1.0)
        cost = now
        if done:
            break
    return x[: 7 * n].reshape(n, 7), x[7 * n :], cost


def made(run: int, n: int, seed: int, far: float = 8.0):
    """Nodes of a turning, tilting run and velocities, some of them far off."""
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.05, 0.15, n))
    nodes = pd.DataFrame({"run_id": run, "node": np.arange(n), "t_s": t, "yaw": wrap(0.3 * t + rng.normal(size=n) * 0.02)} | {c: rng.normal(size=n) * 0.1 for c in graph.INPUTS})
    nodes["gz"] = 0.3
    rows = [(run, k, int(i), t[i], *(rng.normal(size=3) * 0.05 + [0.5, 0.1, 0.0] + (far if rng.random() < 0.05 else 0.0))) for i in range(n) for k in ("BE", "BI") if rng.random() < 0.5]
    rows += [(run, "yaw", i, t[i], nodes["yaw"][i], 0.0, 0.0) for i in range(n)] + [(run, "prior", 0, t[0], nodes["yaw"][0], 0.0, 0.0)]
    return nodes, pd.DataFrame(rows, columns=["run_id", "kind", "node", "t_s", "z0", "z1", "z2"])


@pytest.mark.parametrize("delta", [None, 1.345])
def test_equal_to_one_dense_solve(spark, delta):
    runs = [made(i, n, i) for i, n in enumerate((1, 2, 9, 17, 30, 16))]
    nodes, seen = (spark.createDataFrame(pd.concat(r[k] for r in runs)) for k in (0, 1))
    got = graph.smooth(nodes, seen, delta=delta).toPandas()
    assert len(got) == sum(len(n) for n, _ in runs)
    for run, (frames, table) in enumerate(runs):
        states, _, cost = dense(frames, table, graph.SIGMA, delta)
        mine = got[got["run_id"] == run].sort_values("node")
        # both stop when the cost changes by less than a millionth
        assert np.allclose(mine[graph.STATE].to_numpy(), states, atol=1e-5) and abs(mine["cost"].iloc[0] - cost) < 1e-5 * max(cost, 1.0)


def test_long_run_through_windows(spark):
    """5,000 samples, a node each: what windows give agrees with one solve of all nodes."""
    frames, table = made(1, 5000, 3, 0.3)
    nodes, seen = spark.createDataFrame(frames), spark.createDataFrame(table)
    whole = graph.smooth(nodes, seen, window=6000, common=100, delta=None).toPandas().sort_values("node")
    parts = graph.smooth(nodes, seen, window=1500, common=300, delta=None).toPandas().sort_values("node")
    assert len(whole) == len(parts) == 5000 and (parts["node"].to_numpy() == np.arange(5000)).all()
    gap = np.abs(whole[graph.STATE].to_numpy() - parts[graph.STATE].to_numpy())
    assert gap[:, 3:6].max() < 0.005 and np.abs(wrap(whole["yaw_rad"].to_numpy() - parts["yaw_rad"].to_numpy())).max() < 0.002
    assert gap[:, :3].max() < 0.001 * np.abs(whole[["E", "N", "U"]].to_numpy()).max()
    with pytest.raises(ValueError):
        graph.smooth(nodes, seen, window=10, common=10)


def test_bordered_systems_equal_dense_ones():
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        m, size = 3, 7 * n + 4
        a = rng.normal(size=(m, size, size))
        full = np.zeros((m, size, size))
        full[:, -4:, :] = full[:, :, -4:] = 1.0
        for i in range(n):
            for j in (i - 1, i, i + 1):
                if 0 <= j < n:
                    full[:, 7 * i : 7 * i + 7, 7 * j : 7 * j + 7] = 1.0
        full *= a + a.transpose(0, 2, 1)
        full += 40 * np.eye(size)
        right = rng.normal(size=(m, size))
        block = lambda i, j: full[:, 7 * i : 7 * i + 7, 7 * j : 7 * j + 7]  # noqa: E731, B023
        stack = lambda parts, shape: np.stack(parts, 1) if parts else np.zeros(shape)
        x, b = graph.bordered(
            stack([block(i, i) for i in range(n)], None), stack([block(i, i + 1) for i in range(n - 1)], (m, 0, 7, 7)),
            full[:, :-4, -4:].reshape(m, n, 7, 4), full[:, -4:, -4:], right[:, :-4].reshape(m, n, 7), right[:, -4:],
        )
        assert np.allclose(np.concatenate((x.reshape(m, -1), b), axis=1), np.linalg.solve(full, right[..., None])[..., 0])


def test_graph_follows_velocities(spark):
    rows = straight(spark, 40)
    nodes = graph.keyframes(rows.filter("kind = 'IMU'"), 5)
    table = graph.factors(nodes, rows.filter("kind = 'BE'").withColumnRenamed("kind", "src"))
    out = graph.smooth(nodes, table).orderBy("node").collect()
    assert len(out) == 8 and all(abs(r.vE - 0.5) < 0.05 for r in out[2:]) and out[-1].E > 1.5 and all(math.isfinite(r.cost) for r in out)
    assert graph.smooth(nodes.limit(0), table.limit(0)).count() == 0
