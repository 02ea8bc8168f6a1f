"""A factor graph over the keyframes of a run: factors as columns, residuals as columns, and a Gauss-Newton solver.

The normal equations of a run are block-tridiagonal in its nodes (7 unknowns each) with the 4 biases as a
border, so a step costs a fixed amount a node. The runs of a task are solved together, as arrays;
Jacobians are closed formulas for all factors of a kind at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import geometry as geo
from tidewake.operators.asof import nearest
from tidewake.operators.estimate import rotations, sorted_runs, wrap
from tidewake.operators.timeseries import stride


def keyframes(imu: DataFrame, every: int, most: int | None = None) -> DataFrame:
    """Every ``every``-th sample of a run as a node, numbered from 0; the first ``most``, if that is given."""
    nodes = stride(imu, every, most)
    return nodes.withColumn("node", F.row_number().over(W.partitionBy("run_id").orderBy("t_s", "_row")) - 1)


def factors(nodes: DataFrame, velocities: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(run_id, kind, node, t_s, z0, z1, z2): a prior on the first node, yaw at each node, velocities at their nearest node."""
    near = nearest(velocities.select("run_id", "t_s", "_row", "src", "vE", "vN", "vU"), nodes, ["node"], tie="later", tolerance=tolerance)
    seen = near.filter("node is not null").select("run_id", F.col("src").alias("kind"), "node", "t_s", F.col("vE").alias("z0"), F.col("vN").alias("z1"), F.col("vU").alias("z2"))
    zero = F.lit(0.0)
    yaw = nodes.select("run_id", F.lit("yaw").alias("kind"), "node", "t_s", F.col("yaw").alias("z0"), zero.alias("z1"), zero.alias("z2"))
    prior = nodes.filter("node = 0").select("run_id", F.lit("prior").alias("kind"), "node", "t_s", F.col("yaw").alias("z0"), zero.alias("z1"), zero.alias("z2"))
    return seen.unionByName(yaw).unionByName(prior)


#: Standard deviations by kind of factor.
SIGMA = {"prior": 0.1, "yaw": 0.05, "BE": 0.05, "BI": 0.05, "move": 0.1}


def factor_residuals(states: DataFrame, factor_table: DataFrame, sigma: dict[str, float] | None = None) -> DataFrame:
    """(run_id, kind, node, residuals, cost): whitened residuals of each factor at given states, and half of their squares.

    ``states`` has a row (run_id, node, t_s, E, N, U, vE, vN, vU, yaw_rad, ax, ay, az, gz, roll, pitch) for each
    node; biases are zero. Columns alone: a node joins its factors, and the next node for the motion.
    """
    s = SIGMA | (sigma or {})
    v, next_of = (F.col("vE"), F.col("vN"), F.col("vU")), lambda c: F.lead(c).over(W.partitionBy("run_id").orderBy("node"))
    back = geo.rotation(F.col("roll"), F.col("pitch"), F.col("yaw_rad"))
    body = [sum((back[i][k] * v[i] for i in (1, 2)), back[0][k] * v[0]) for k in range(3)]
    z, heading = [F.col(f"z{i}") for i in range(3)], geo.wrap_pi(F.col("yaw_rad") - F.col("z0"))
    over = lambda values, kind: F.transform(F.array(*values), lambda r: r / s[kind])
    rows = states.drop("t_s").join(factor_table.select("run_id", "kind", F.col("node").cast("long").alias("node"), "z0", "z1", "z2"), ["run_id", "node"])
    made = (
        F.when(F.col("kind") == "BE", over([a - b for a, b in zip(v, z)], "BE")).when(F.col("kind") == "BI", over([a - b for a, b in zip(body, z)], "BI"))
        .when(F.col("kind") == "yaw", over([heading], "yaw")).otherwise(over([F.col("E"), F.col("N"), F.col("U"), *v, heading, *[F.lit(0.0)] * 4], "prior"))
    )
    seen = rows.select("run_id", "kind", "node", made.alias("residuals"))
    dt, rate = next_of("t_s") - F.col("t_s"), F.col("gz")
    acc = geo.rotate(geo.rotation(F.col("roll"), F.col("pitch"), F.col("yaw_rad") + 0.5 * rate * dt), (F.col("ax"), F.col("ay"), F.col("az")))
    place = [next_of(p) - F.col(p) - F.col(q) * dt - 0.5 * a * dt * dt for p, q, a in zip(("E", "N", "U"), ("vE", "vN", "vU"), acc)]
    speed = [next_of(q) - F.col(q) - a * dt for q, a in zip(("vE", "vN", "vU"), acc)]
    turn = geo.wrap_pi(next_of("yaw_rad") - F.col("yaw_rad") - rate * dt)
    moved = F.transform(F.array(*place, *speed, turn), lambda r: r)
    wide = s["move"] * F.greatest(dt, F.lit(1e-3))
    moves = states.select("run_id", F.lit("move").alias("kind"), F.col("node").cast("long").alias("node"), moved.alias("r"), F.when(dt.isNotNull(), wide).alias("w")).filter("w is not null")
    moves = moves.select("run_id", "kind", "node", F.transform("r", lambda r: r / F.col("w")).alias("residuals"))
    return seen.unionByName(moves).withColumn("cost", 0.5 * F.aggregate("residuals", F.lit(0.0), lambda t, r: t + r * r))


GRAPH = "run_id long, node int, t_s double, E double, N double, U double, vE double, vN double, vU double, yaw_rad double, cost double, iterations int"


STATE = ["E", "N", "U", "vE", "vN", "vU", "yaw_rad"]
INPUTS = ["ax", "ay", "az", "gz", "roll", "pitch"]
#: A run of more nodes is solved window by window; neighbouring windows have so many nodes in common.
WINDOW, COMMON = 4000, 400
HUBER = 1.345


def bordered(diagonal: np.ndarray, upper: np.ndarray, border: np.ndarray, corner: np.ndarray, right: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solves many systems with a block-tridiagonal matrix and a border, by elimination from the first node to the last.

    Blocks: ``diagonal`` (m, n, 7, 7), ``upper`` (m, n - 1, 7, 7) between a node and the next one, ``border``
    (m, n, 7, 4), ``corner`` (m, 4, 4); right sides ``right`` (m, n, 7) and ``below`` (m, 4). All are symmetric.
    """
    m, n = right.shape[:2]
    known = np.concatenate((right[..., None], border), axis=-1)
    solved = np.empty((m, n, 7, 12))
    pivot, part = diagonal[:, 0], known[:, 0]
    for i in range(n):
        wide = upper[:, i] if i < n - 1 else np.zeros((m, 7, 7))
        solved[:, i] = np.linalg.solve(pivot, np.concatenate((part, wide), axis=-1))
        if i < n - 1:
            back = upper[:, i].transpose(0, 2, 1)
            pivot, part = diagonal[:, i + 1] - back @ solved[:, i, :, 5:], known[:, i + 1] - back @ solved[:, i, :, :5]
    out = solved[..., :5]
    for i in range(n - 2, -1, -1):
        out[:, i] -= solved[:, i, :, 5:] @ out[:, i + 1]
    left = border.transpose(0, 1, 3, 2)
    biases = np.linalg.solve(corner - (left @ out[..., 1:]).sum(axis=1), (below - (left @ out[..., :1]).sum(axis=1)[..., 0])[..., None])[..., 0]
    return out[..., 0] - (out[..., 1:] @ biases[:, None, :, None])[..., 0], biases


class Graphs:
    """The graphs of many runs, or windows of runs, as arrays padded to the most nodes of any."""

    def __init__(self, size: np.ndarray, dt: np.ndarray, inputs: np.ndarray, seen: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], prior: np.ndarray, sigma: dict[str, float], delta: float | None) -> None:
        """``dt`` (m, n - 1) and ``inputs`` (m, n, 6) by node, ``seen`` (run, node, values) by kind, ``prior`` (m, 11) of the first node and the biases."""
        self.size, self.dt, self.inputs, self.seen, self.prior, self.sigma, self.delta = size, dt, inputs, seen, prior, sigma, delta
        self.there = np.arange(dt.shape[1]) + 1 < size[:, None]  # moves between nodes that are there

    def factors(self, x: np.ndarray, bias: np.ndarray) -> Iterator[tuple]:
        """(kind, run, node, residuals, Jacobians by the node, the next node and the biases) of all factors of each kind, whitened and weighted; the halves of their squares."""
        m = len(x)
        eye = np.broadcast_to(np.eye(7), (m, 7, 7))
        first = np.concatenate((x[:, 0] - self.prior[:, :7], bias - self.prior[:, 7:]), axis=1)
        first[:, 6] = wrap(first[:, 6])
        none, to = np.zeros((m, 4, 7)), np.zeros((m, 7, 4))
        yield self._weighted("prior", np.arange(m), np.zeros(m, np.int64), first, np.concatenate((eye, none), axis=1), None, np.concatenate((to, np.broadcast_to(np.eye(4), (m, 4, 4))), axis=1), self.sigma["prior"])
        if x.shape[1] > 1:
            run, node = np.nonzero(self.there)
            yield self._moves(x, bias, run, node)
        for kind, (run, node, z) in self.seen.items():
            if not len(run):
                continue
            a, jac = x[run, node], np.zeros((len(run), 1 if kind == "yaw" else 3, 7))
            if kind == "yaw":
                residual = wrap(a[:, 6] - z[:, 0])[:, None]
                jac[:, 0, 6] = 1.0
            elif kind == "BI":
                back = rotations(self.inputs[run, node, 4], self.inputs[run, node, 5], a[:, 6]).transpose(0, 2, 1)
                residual = (back @ a[:, 3:6, None])[..., 0] - z
                jac[:, :, 3:6] = back
                jac[:, :, 6] = (back @ np.stack((a[:, 4], -a[:, 3], np.zeros(len(a))), -1)[..., None])[..., 0]
            else:
                residual = a[:, 3:6] - z
                jac[:, :, 3:6] = np.eye(3)
            yield self._weighted(kind, run, node, residual, jac, None, None, self.sigma[kind])

    def _moves(self, x: np.ndarray, bias: np.ndarray, run: np.ndarray, node: np.ndarray) -> tuple:
        a, b, u, dt = x[run, node], x[run, node + 1], self.inputs[run, node], self.dt[run, node]
        rate = u[:, 3] - bias[run, 3]
        turn = rotations(u[:, 4], u[:, 5], a[:, 6] + 0.5 * rate * dt)
        acc = (turn @ (u[:, :3] - bias[run, :3])[..., None])[..., 0]
        round_ = np.stack((-acc[:, 1], acc[:, 0], np.zeros(len(a))), -1)  # by the heading
        d, half = dt[:, None], 0.5 * dt[:, None] ** 2
        residual = np.concatenate((b[:, :3] - a[:, :3] - a[:, 3:6] * d - half * acc, b[:, 3:6] - a[:, 3:6] - acc * d, wrap(b[:, 6] - a[:, 6] - rate * dt)[:, None]), axis=1)
        here, next_, to = np.zeros((len(a), 7, 7)), np.broadcast_to(np.eye(7), (len(a), 7, 7)), np.zeros((len(a), 7, 4))
        here[:, range(7), range(7)] = -1.0
        here[:, range(3), range(3, 6)] = -d
        here[:, :3, 6], here[:, 3:6, 6] = -half * round_, -d * round_
        to[:, :3, :3], to[:, 3:6, :3] = half[..., None] * turn, d[..., None] * turn
        to[:, :3, 3], to[:, 3:6, 3], to[:, 6, 3] = half * round_ * 0.5 * d, d * round_ * 0.5 * d, dt
        return self._weighted("move", run, node, residual, here, next_, to, self.sigma["move"] * np.maximum(dt, 1e-3))

    def _weighted(self, kind: str, run: np.ndarray, node: np.ndarray, residual: np.ndarray, here: np.ndarray, next_: np.ndarray | None, to: np.ndarray | None, sigma: float | np.ndarray) -> tuple:
        """Divides by sigma, and weighs by Huber's rule for the norm of a whole factor."""
        scale = np.broadcast_to(1.0 / np.asarray(sigma), (len(residual),))
        norm = np.linalg.norm(residual, axis=1) * scale
        if self.delta is not None:
            scale = scale * np.sqrt(np.where(norm <= self.delta, 1.0, self.delta / np.maximum(norm, 1e-6)))
        cubes = (None if j is None else j * scale[:, None, None] for j in (here, next_, to))
        residual = residual * scale[:, None]
        return kind, run, node, residual, *cubes, 0.5 * (residual * residual).sum(axis=1)

    def cost(self, x: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Half of the weighted squares of each run."""
        return sum(np.bincount(run, half, len(x)) for _, run, *_, half in self.factors(x, bias))

    def step(self, x: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The Gauss-Newton step of states and biases."""
        m, n = x.shape[:2]
        diagonal, border, right = np.zeros((m, n, 7, 7)), np.zeros((m, n, 7, 4)), np.zeros((m, n, 7))
        upper, corner, below = np.zeros((m, max(n - 1, 0), 7, 7)), np.zeros((m, 4, 4)), np.zeros((m, 4))
        diagonal[:] = 1e-9 * np.eye(7)
        diagonal[np.arange(n) >= self.size[:, None]] = np.eye(7)
        corner[:] = 1e-9 * np.eye(4)
        t = lambda j: j.transpose(0, 2, 1)
        times = lambda j, r: (t(j) @ r[..., None])[..., 0]
        for _, run, node, r, here, next_, to, _ in self.factors(x, bias):
            order = np.argsort(run * n + node, kind="stable")
            begin = np.flatnonzero(np.append(True, np.diff((run * n + node)[order]) > 0))
            at = run[order][begin], node[order][begin]
            gather = lambda v: np.add.reduceat(v[order], begin, axis=0)  # noqa: E731, B023  factors of one node add up
            diagonal[at] += gather(t(here) @ here)
            right[at] -= gather(times(here, r))
            if next_ is not None:
                upper[at] += gather(t(here) @ next_)
                diagonal[at[0], at[1] + 1] += gather(t(next_) @ next_)
                right[at[0], at[1] + 1] -= gather(times(next_, r))
                border[at[0], at[1] + 1] += gather(t(next_) @ to)
            if to is not None:
                border[at] += gather(t(here) @ to)
                begin = np.flatnonzero(np.append(True, np.diff(run[order]) > 0))
                corner[run[order][begin]] += gather(t(to) @ to)
                below[run[order][begin]] -= gather(times(to, r))
        return bordered(diagonal, upper, border, corner, right, below)

    def solve(self, x: np.ndarray, bias: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """States, biases, cost and number of steps of each run: it ends when the step or the relative change of the cost is under 1e-6."""
        x, bias, cost, used = x.copy(), bias.copy(), self.cost(x, bias), np.zeros(len(x), np.int32)
        going = np.ones(len(x), bool)
        for k in range(1, iterations + 1):
            dx, db = self.step(x, bias)
            dx[np.arange(x.shape[1]) >= self.size[:, None]] = 0.0
            dx[~going], db[~going] = 0.0, 0.0
            x, bias = x + dx, bias + db
            x[..., 6] = wrap(x[..., 6])
            now = self.cost(x, bias)
            used[going] = k
            small = np.sqrt((dx * dx).sum(axis=(1, 2)) + (db * db).sum(axis=1)) < 1e-6
            going &= ~(small | (np.abs(now - cost) < 1e-6 * np.maximum(cost, 1.0)))
            cost = now
            if not going.any():
                break
        return x, bias, cost, used


def whole_runs(batches: Iterator[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Batches sorted by run, put together so that each holds whole runs and about ``rows`` rows."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= rows and held[0]["run_id"].iloc[0] != batch["run_id"].iloc[-1]:
            table = pd.concat(held)
            last = (table["run_id"] == table["run_id"].iloc[-1]).to_numpy()
            yield table[~last]
            held = [table[last]]
    if held:
        yield pd.concat(held)


def smooth(nodes: DataFrame, factor_table: DataFrame, *, iterations: int = 10, sigma: dict[str, float] | None = None, delta: float | None = HUBER, window: int = WINDOW, common: int = COMMON) -> DataFrame:
    """Gauss-Newton over the nodes of each run (7 unknowns each) and its biases (4): GRAPH, a row a node.

    Between nodes the state moves by the node's own acceleration and rate. Factors are weighted by Huber's rule
    for their whole norm beyond ``delta`` (None: not at all). Runs of up to ``window`` nodes are solved in one system, of a cost linear in its
    nodes. A longer run goes through windows that share ``common`` nodes: what one makes of the node where the next begins, and
    of the biases, is the next one's prior, and shared nodes are taken from the earlier window in their
    first half. ``cost`` and ``iterations`` are those of a node's window. Velocities that aren't finite are left out; the runs of nodes without other
    factors follow their inertial input.
    """
    if not 0 < common < window:
        raise ValueError("windows must be longer than what they share")
    s = SIGMA | (sigma or {})
    names = [c.split()[0] for c in GRAPH.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in whole_runs(batches):
            frames = table[table["kind"] == "node"].sort_values(["run_id", "node"])
            if len(frames):
                yield solved(frames, table[table["kind"].isin(["yaw", "BE", "BI"])], table[table["kind"] == "prior"])

    def solved(frames: pd.DataFrame, seen: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
        ids, begin, count = np.unique(frames["run_id"].to_numpy(), return_index=True, return_counts=True)
        t, inputs, start = frames["t_s"].to_numpy(np.float64), np.nan_to_num(frames[INPUTS].to_numpy(np.float64)), np.zeros((len(frames), 7))
        start[:, 6] = wrap(np.nan_to_num(frames["yaw"].to_numpy(np.float64)))
        of = np.searchsorted(ids, seen["run_id"].to_numpy())
        node, values, kinds = seen["node"].to_numpy(np.int64), seen[["z0", "z1", "z2"]].to_numpy(np.float64), seen["kind"].to_numpy()
        held = np.isfinite(values).all(axis=1) & (ids[np.minimum(of, len(ids) - 1)] == seen["run_id"].to_numpy())
        of = np.minimum(of, len(ids) - 1)
        firsts = np.zeros((len(ids), 11))
        firsts[:, 6] = start[begin, 6]
        firsts[np.searchsorted(ids, prior["run_id"].to_numpy()), 6] = np.nan_to_num(prior["z0"].to_numpy(np.float64))
        out, bias, cost, used = start.copy(), np.zeros((len(ids), 4)), np.zeros(len(frames)), np.zeros(len(frames), np.int32)
        at = np.zeros(len(ids), np.int64)  # the first node of each run's window
        live = np.arange(len(ids))
        while len(live):
            size = np.minimum(count[live] - at[live], window)
            for wide in np.unique(np.ceil(np.log2(size))):  # windows of about one size together
                mine = live[np.ceil(np.log2(size)) == wide]
                n = np.minimum(count[mine] - at[mine], window)
                index = np.minimum((begin + at)[mine, None] + np.arange(n.max()), (begin + count - 1)[mine, None])
                place = np.full(len(ids), -1)
                place[mine] = np.arange(len(mine))
                inside = held & (place[of] >= 0) & (node >= at[of]) & (node < at[of] + n[place[of]])
                which = {k: inside & (kinds == k) for k in ("yaw", "BE", "BI")}
                graphs = Graphs(n, np.diff(t[index], axis=1), inputs[index], {k: (place[of[w]], node[w] - at[of[w]], values[w]) for k, w in which.items()}, firsts[mine], s, delta)
                guess = start[index].copy()
                guess[:, :, :3] += firsts[mine, None, :3]  # a window begins where the one before has put its first node
                x, bias[mine], c, k = graphs.solve(guess, bias[mine], iterations)
                keep = (np.arange(index.shape[1]) < n[:, None]) & ((np.arange(index.shape[1]) >= common // 2) | (at[mine] == 0)[:, None])
                rows = index[keep]
                out[rows], cost[rows], used[rows] = x[keep], np.repeat(c, keep.sum(axis=1)), np.repeat(k, keep.sum(axis=1))
                on = at[mine] + n < count[mine]
                ahead = n[on] - common
                firsts[mine[on]] = np.concatenate((x[on, ahead], bias[mine[on]]), axis=1)
                at[mine[on]] += ahead
                at[mine[~on]] = count[mine[~on]]
            live = np.flatnonzero(at < count)
        made = pd.DataFrame(out, columns=STATE).assign(run_id=frames["run_id"].to_numpy(), node=frames["node"].to_numpy(np.int32), t_s=t, cost=cost, iterations=used)
        return made.assign(yaw_rad=wrap(out[:, 6]))[names]

    rows = nodes.select("run_id", F.lit("node").alias("kind"), F.col("node").cast("int").alias("node"), "t_s", "yaw", *INPUTS)
    rows = rows.unionByName(factor_table.select("run_id", "kind", F.col("node").cast("int").alias("node"), "t_s", "z0", "z1", "z2"), allowMissingColumns=True)
    return sorted_runs(rows).mapInPandas(run, GRAPH)
