"""Structured Streaming forms: late samples, duplicates, stateful replay, sliding corrections, windows.

Event time is a timestamp with a time zone; tables without one are cast first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Repeated samples within the watermark are dropped; all repeated ones of a batch."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, length: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Count, mean and largest value per run and fixed window; samples later than the watermark are dropped."""
    windows = stream.withWatermark(time, delay).groupBy("run_id", F.window(time, length))
    return windows.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select("run_id", F.col("window.start").alias("start"), "n", "mean", "most")


def sessions(stream: DataFrame, gap: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Bursts of samples that are at most ``gap`` apart."""
    return stream.withWatermark(time, delay).groupBy("run_id", F.session_window(time, gap)).agg(F.count("*").alias("n")).select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


REPLAYED = "run_id long, _row long, t_s double, status string, yaw double, E double, N double, age double"
STATE = "t double, yaw double, e double, n double, rate double"


def replayed(stream: DataFrame, most_dt: float) -> DataFrame:
    """Replays samples (run_id, _row, t_s, kind, gz, vE, vN) into a yaw and position that are kept between batches.

    Rows of a batch are ordered by time; a row that isn't newer than all before it gets the status
    ``late`` and changes nothing. ``age`` is the time since the run's last inertial sample.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, yaw, e, n, rate = state.get if state.exists else (math.nan, 0.0, 0.0, 0.0, 0.0)
        rows, out = pd.concat(list(parts)).sort_values(["t_s", "_row"]), []
        for row, now, kind, gz, ve, vn in rows[["_row", "t_s", "kind", "gz", "vE", "vN"]].itertuples(index=False):
            status, age = "used", math.nan
            if not math.isnan(t):
                age = now - t
                if age <= 0:
                    out.append((key[0], row, now, "late", yaw, e, n, age))
                    continue
            dt = age if age <= most_dt else 0.0  # false for NaN: the first sample only sets the clock
            yaw = (yaw + rate * dt + math.pi) % (2 * math.pi) - math.pi
            if kind == "IMU":
                rate = gz
            else:
                e, n = e + ve * dt, n + vn * dt
            t = now
            out.append((key[0], row, now, status, yaw, e, n, age))
        state.update((t, yaw, e, n, rate))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])

    return stream.groupBy("run_id").applyInPandasWithState(run, REPLAYED, STATE, "append", GroupStateTimeout.NoTimeout)


CORRECTED = "run_id long, _row long, t_s double, correction_e double, correction_n double, held int"
HELD = "t array<double>, e array<double>, n array<double>"


def sliding_correction(stream: DataFrame, horizon_s: float = 5.0) -> DataFrame:
    """Mean of measured minus estimated velocity (dvE, dvN) over the last ``horizon_s`` seconds of each run."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        out = []
        for row, t, e, n in pd.concat(list(parts)).sort_values(["t_s", "_row"])[["_row", "t_s", "dvE", "dvN"]].itertuples(index=False):
            held = [h for h in [*held, (t, e, n)] if h[0] >= t - horizon_s]
            out.append((key[0], row, t, sum(h[1] for h in held) / len(held), sum(h[2] for h in held) / len(held), len(held)))
        state.update(tuple(list(c) for c in zip(*held)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CORRECTED.split(", ")])

    return stream.groupBy("run_id").applyInPandasWithState(run, CORRECTED, HELD, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Everything that is available now, written to ``path`` and read back."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
