"""Writers of tables, trajectories, event logs and small reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRAJECTORY = ("t_s", "E", "N", "U", "yaw_rad", "yaw_deg")
EVENT = ("mono_ns", "wall_time", "component", "event", "level", "run_id", "message", "process_name", "action", "result", "pid", "exit_code", "restart_count")


def write_csv(df: DataFrame, path: str, *, by: Sequence[str] = ("run_id",), mode: str = "errorifexists") -> None:
    """CSV with a header, one folder per value of ``by``."""
    there = [c for c in by if c in df.columns]
    # files of tasks get their places as tasks end: thousands of folders aren't moved one by one by the driver
    writer = df.write.mode(mode).option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    (writer.partitionBy(*there) if there else writer).csv(path)


def processed_imu_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, in order, then the rest; angles in radians also in degrees."""
    degrees = {c[: -len("_rad")] + "_deg": F.degrees(c) for c in df.columns if c.endswith("_rad") and c[: -len("_rad")] + "_deg" not in df.columns}
    df = df.withColumns(degrees) if degrees else df
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def write_trajectory(df: DataFrame, path: str, extra: Sequence[str] = (), *, by: Sequence[str] = ("run_id",)) -> None:
    """The six trajectory columns and ``extra`` ones, degrees filled from radians where they are missing.

    A folder a run; with ``by=()`` the run is a column instead, so that files grow with the rows and not with the runs.
    """
    if "yaw_deg" not in df.columns:
        df = df.withColumn("yaw_deg", F.degrees("yaw_rad"))
    write_csv(df.select("run_id", *TRAJECTORY, *extra), path, by=by)


EXTENDED = ("t_s", "E", "N", "U", "yaw_rad", "yaw_deg", "src", "speed", "valid")


def write_extended_trajectory(df: DataFrame, path: str, yaw: DataFrame | None = None, *, by: Sequence[str] = ("run_id",)) -> None:
    """Nine columns, one folder a run (none with ``by=()``, see ``write_trajectory``); yaw and src come by ordinal from ``yaw`` (run_id, yaw_rad, src, t_s, _row).

    A shorter series is padded with its last values, a longer one is trimmed; missing columns are empty.
    """
    if yaw is not None:
        place = F.row_number().over(W.partitionBy("run_id").orderBy("t_s", "_row"))
        side = yaw.select("run_id", place.alias("_i"), F.col("yaw_rad").alias("_yaw"), F.col("src").alias("_src"))
        df = df.drop("yaw_rad", "yaw_deg", "src").withColumn("_i", place).join(side, ["run_id", "_i"], "left")
        last = W.partitionBy("run_id").orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)
        df = df.withColumns({"yaw_rad": F.last("_yaw", True).over(last), "src": F.last("_src", True).over(last)})
    if "yaw_deg" not in df.columns:
        df = df.withColumn("yaw_deg", F.degrees("yaw_rad"))
    write_csv(df.select("run_id", *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EXTENDED)), path, by=by)


def read_trajectory(spark, path: str) -> DataFrame:
    """Yaw from radians, or from degrees where there are none."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    rad = F.col("yaw_rad").cast("double") if "yaw_rad" in df.columns else F.lit(None).cast("double")
    deg = F.radians(F.col("yaw_deg").cast("double")) if "yaw_deg" in df.columns else F.lit(None).cast("double")
    return df.withColumn("yaw_rad", F.coalesce(rad, deg))


def append_events(df: DataFrame, path: str) -> None:
    """Event rows in the fixed column order, absent columns empty, added to what is there."""
    df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in EVENT)).write.mode("append").option("header", True).csv(path)


def _few(df: DataFrame, most: int) -> list:
    """All rows of a small result; ValueError if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write the table instead")
    return rows


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A small result as a Markdown table; ValueError over ``most`` rows."""
    rows = _few(df, most)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return f"## {title}\n\n{head}" + "".join("| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows)


def write_report(df: DataFrame, path: str) -> None:
    """A result as JSON lines by Spark's commit protocol: readers see all of it or nothing."""
    df.write.mode("overwrite").json(path)


def report_json(df: DataFrame, most: int = 10_000) -> str:
    """A small result as one JSON text; ValueError over ``most`` rows."""
    return json.dumps([r.asDict(True) for r in _few(df, most)], default=str)
