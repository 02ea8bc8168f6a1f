"""State that lives between micro-batches, in typed state variables: an attitude, and intents that expire on their own.

Both need a state store that keeps many variables of a key: ``started`` sets the one that Spark has for it while a query starts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

ATTITUDE = "run_id long, _row long, t_s double, status string, qw double, qx double, qy double, qz double, roll double, pitch double, yaw double"


def turned(q: tuple[float, ...], rate: tuple[float, ...], dt: float) -> tuple[float, ...]:
    """The unit quaternion ``q`` turned by a body rate over ``dt``."""
    x, y, z = (r * dt for r in rate)
    angle = math.sqrt(x * x + y * y + z * z)
    s = math.sin(angle / 2) / angle if angle > 1e-12 else 0.5
    w, x, y, z = math.cos(angle / 2), x * s, y * s, z * s
    a, b, c, d = q
    new = a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w
    length = math.sqrt(sum(v * v for v in new))
    return tuple(v / length for v in new)


def angles(q: tuple[float, ...]) -> tuple[float, float, float]:
    """Roll, pitch and yaw of a quaternion."""
    w, x, y, z = q
    pitch = math.asin(max(-1.0, min(1.0, 2 * (w * y - z * x))))
    if abs(abs(pitch) - math.pi / 2) < 1e-6:  # at the poles yaw takes all
        return 0.0, pitch, math.atan2(-2 * (x * y - w * z), 1 - 2 * (x * x + z * z))
    return math.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), pitch, math.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


class Attitude(StatefulProcessor):
    """Quaternion, clock and rate of each run: a sample turns the attitude by the rate of the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("attitude", "qw double, qx double, qy double, qz double, t double, gx double, gy double, gz double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else (1.0, 0.0, 0.0, 0.0, math.nan, 0.0, 0.0, 0.0)
        q, t, rate, out = tuple(state[:4]), state[4], tuple(state[5:]), []
        for row, now, *new in pd.concat(list(rows)).sort_values(["t_s", "nth"])[["nth", "t_s", "gx", "gy", "gz"]].itertuples(index=False):
            if not math.isfinite(now) or now < t:
                out.append((key[0], row, now, "late", *q, *angles(q)))
                continue
            if now > t:  # false for NaN, the first sample
                q = turned(q, rate, now - t)
            t, rate = now, tuple(new) if all(map(math.isfinite, new)) else (0.0, 0.0, 0.0)
            out.append((key[0], row, now, "used", *q, *angles(q)))
        self.held.update((*q, t, *rate))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ATTITUDE.split(", ")])

    def close(self) -> None:
        pass


def attitudes(stream: DataFrame) -> DataFrame:
    """ATTITUDE of samples (run_id, _row, t_s, gx, gy, gz in rad/s), over all batches so far.

    The samples of a batch are ordered by time; one that is older than what came before it is ``late`` and turns nothing. Rates that
    aren't finite turn nothing.
    """
    stream = stream.withColumnRenamed("_row", "nth")  # names with a leading underscore don't reach the processor
    return stream.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Attitude(), outputStructType=ATTITUDE, outputMode="Append", timeMode="None")


INTENTS = "run_id long, source string, seq long, stamp_ms long, status string, at_ms long"


SHARDS = 512  # groups of sources that share a state; fixed for the life of a checkpoint
HELD = "run_id array<long>, source array<string>, newest array<long>, seq array<long>, stamp array<long>, deadline array<long>"


class Intents(StatefulProcessor):
    """The newest intents of a shard's sources with their deadlines, stepped through as arrays; one timer, at the earliest deadline, lets those expire where nothing more comes.

    A state that is read and written for a shard at once makes calls that don't grow with the number of sources.
    """

    def __init__(self, default_ttl_ms: int) -> None:
        self.default = default_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _read(self) -> pd.DataFrame:
        """A row a source; a null deadline says that its intent has expired."""
        columns = self.held.get() if self.held.exists() else [[]] * 6
        held = pd.DataFrame({c.split()[0]: pd.Series(list(v), dtype=object) for c, v in zip(HELD.split(", "), columns)})
        held["live"] = held["deadline"].notna()
        for c in ("newest", "seq", "stamp", "deadline"):
            held[c] = held[c].where(held[c].notna(), 0).astype(np.int64)
        return held

    def _keep(self, held: pd.DataFrame, timer: int | None) -> None:
        """``timer`` is the one that is set, if any."""
        deadlines = [d if live else None for d, live in zip(held["deadline"].tolist(), held["live"].tolist())]
        self.held.update((held["run_id"].tolist(), held["source"].tolist(), held["newest"].tolist(), held["seq"].tolist(), held["stamp"].tolist(), deadlines))
        earliest = min((d for d in deadlines if d is not None), default=None)
        if earliest != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if earliest is not None:
                self.handle.registerTimer(earliest)

    def _rows(self, rows: pd.DataFrame, status: str | np.ndarray, at: str) -> pd.DataFrame:
        made = pd.DataFrame({"run_id": rows["run_id"], "source": rows["source"], "seq": rows["seq"], "stamp_ms": rows["stamp"], "status": status, "at_ms": rows[at]})
        return made if made["run_id"].isna().any() else made.astype({"run_id": np.int64})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._read()
        timer = int(held["deadline"][held["live"]].min()) if held["live"].any() else None
        new = pd.concat(list(rows), ignore_index=True).rename(columns={"stamp_ms": "stamp"})
        # null runs have shards of their own, so that ids beside them stay integers
        new["run_id"] = pd.Series([None] * len(new) if new["run_id"].isna().all() else new["run_id"].astype(np.int64).tolist(), dtype=object)
        keys = pd.concat([held[["run_id", "source"]], new[["run_id", "source"]].astype(object)], ignore_index=True)
        new["at"] = keys.groupby(["run_id", "source"], sort=False, dropna=False).ngroup().to_numpy()[len(held) :]  # the held ones come first
        known = len(held)
        first = new.loc[new["at"] >= known].drop_duplicates("at").sort_values("at")
        held = pd.concat([held, first[["run_id", "source"]].assign(newest=0, seq=0, stamp=0, deadline=0, live=False)], ignore_index=True) if len(first) else held
        new = new.sort_values(["at", "stamp", "nth"], ignore_index=True)
        ttl = new["ttl_ms"].fillna(0).astype(np.int64)
        new = new.assign(seq=new["seq"].astype(np.int64), stamp=new["stamp"].astype(np.int64), deadline=new["stamp"].astype(np.int64) + ttl.where(ttl > 0, self.default))
        at, seq = new["at"].to_numpy(), new["seq"].to_numpy()
        begins = np.concatenate(([True], at[1:] != at[:-1]))
        before = np.roll(new.groupby("at")["seq"].cummax().to_numpy(), 1)
        ok = (begins | (seq > before)) & ((at >= known) | (seq > held["newest"].to_numpy()[at]))
        yield self._rows(new, np.where(ok, "accepted", "out_of_order"), "stamp")

        taken = new[ok].reset_index(drop=True)
        at = taken["at"].to_numpy()
        begins = np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]
        # what each accepted intent replaces: the one before, or the one held
        last = {c: np.where(begins, held[c].to_numpy()[at], np.roll(taken[c].to_numpy(), 1)) for c in ("seq", "stamp", "deadline")}
        gone = (~begins | held["live"].to_numpy()[at]) & (taken["stamp"].to_numpy() > last["deadline"])
        yield self._rows(taken.assign(**last)[gone], "expired", "deadline")

        ends = taken[np.concatenate((at[1:] != at[:-1], [True]))[: len(at)]]
        for c in ("seq", "stamp", "deadline"):
            held.loc[ends["at"].to_numpy(), c] = ends[c].to_numpy()
        held.loc[ends["at"].to_numpy(), "newest"] = ends["seq"].to_numpy()
        held.loc[ends["at"].to_numpy(), "live"] = True
        self._keep(held, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, mark = self._read(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = held["live"] & (held["deadline"] <= mark)
        if gone.any():
            held["live"] &= ~gone
            self._keep(held, None)  # the timer is spent
            yield self._rows(held[gone], "expired", "deadline")

    def close(self) -> None:
        pass


def intent_expiries(stream: DataFrame, default_ttl_ms: int, delay: str = "1 second") -> DataFrame:
    """INTENTS: accepted, out_of_order and expired intents of (run_id, source, _row, seq, ts, stamp_ms, ttl_ms).

    An intent is accepted if its number is over all before it of its source, and expires at its deadline when the watermark
    of ``ts`` has passed that, though no later row comes. A ttl of 0 is the default.
    """
    shard = F.pmod(F.xxhash64("run_id", "source"), F.lit(SHARDS)) + F.when(F.col("run_id").isNull(), SHARDS).otherwise(0)
    rows = stream.select("run_id", "source", F.col("_row").alias("nth"), "seq", "ts", "stamp_ms", "ttl_ms", shard.alias("shard"))
    return rows.withWatermark("ts", delay).groupBy("shard").transformWithStateInPandas(statefulProcessor=Intents(default_ttl_ms), outputStructType=INTENTS, outputMode="Append", timeMode="EventTime")


def run_once(stream: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Everything that is available now, in as many batches as the source makes, written to ``path`` and read back."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
