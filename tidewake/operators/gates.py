"""Gates of velocity samples: each is a column, and the reasons for which a sample fails are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.columns import above, below, gate_flag, joined_reasons, timeline_flag
from tidewake.functions.geometry import norm
from tidewake.operators.timeseries import moving_average_same, robust_z, run, step, whole


@dataclass(frozen=True)
class GateLimits:
    dv_axis: float = 0.20
    dv_horizontal: float = 0.25
    vu_abs: float = 0.30
    outlier_z: float = 8.0
    outlier_window: int = 15
    speed_min: float = 0.0
    speed_max: float = 5.0
    keep_static_s: float = 20.0


def normalised_source(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def by_source(df: DataFrame, source: str, column: str = "src") -> DataFrame:
    return df.filter(normalised_source(F.col(column)) == source.upper())


def valid_gate(df: DataFrame) -> Column:
    """Fails where a validity column is there and false."""
    return ~gate_flag(F.col("valid")) if "valid" in df.columns else F.lit(False)


def bottom_track_gate(df: DataFrame) -> Column:
    """Fails on water-mass samples, if the column is there."""
    return gate_flag(F.col("water_mass")) if "water_mass" in df.columns else F.lit(False)


def jump_gate(limits: GateLimits = GateLimits(), east: str = "vE", north: str = "vN", up: str = "vU", *by: str) -> Column:
    """Fails where velocity jumps from the raw row before; the first row passes."""
    e, n, u = (step(F.col(c), *by) for c in (east, north, up))
    axis = F.greatest(F.abs(e), F.abs(n), F.abs(u))
    return (F.row_number().over(run(*by)) > 1) & (above(axis, limits.dv_axis) | above(norm(e, n), limits.dv_horizontal))


def vertical_gate(limits: GateLimits = GateLimits(), up: str = "vU", *by: str) -> Column:
    return (F.row_number().over(run(*by)) > 1) & above(F.abs(F.col(up)), limits.vu_abs)


def outlier_gate(df: DataFrame, column: str, limits: GateLimits = GateLimits(), to: str = "outlier", *by: str) -> DataFrame:
    """Fails where the robust z of ``column`` is over the limit; runs with under 15 rows pass."""
    df = robust_z(df, column, limits.outlier_window, *by, to="_z")
    enough = F.count("*").over(whole(*by)) >= 15
    return df.withColumn(to, enough & above(F.col("_z"), limits.outlier_z)).drop("_z")


def speed_gate(c: Column, limits: GateLimits = GateLimits()) -> Column:
    return below(c, limits.speed_min) | above(c, limits.speed_max)


def gated(df: DataFrame, limits: GateLimits = GateLimits(), *, vertical: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds speed, gate_pass and gate_reasons; the first ``keep_static_s`` seconds pass always."""
    df = df.withColumn("speed", norm(F.col("vE"), F.col("vN"), F.col("vU")))
    df = outlier_gate(df, "speed", limits, "_outlier", *by)
    reasons = [
        ("valid", valid_gate(df)),
        ("water_mass", bottom_track_gate(df)),
        ("dv_jump", jump_gate(limits, "vE", "vN", "vU", *by)),
        ("vu_abs", vertical_gate(limits, "vU", *by) if vertical else F.lit(False)),
        ("outlier", F.col("_outlier")),
        ("speed_range", speed_gate(F.col("speed"), limits)),
    ]
    df = df.withColumn("_reasons", joined_reasons(reasons))
    static = F.col("t_s") <= F.min("t_s").over(whole(*by)) + limits.keep_static_s
    df = df.withColumn("gate_reasons", F.when(static, F.lit("")).otherwise(F.col("_reasons")))
    return df.withColumn("gate_pass", F.col("gate_reasons") == "").drop("_reasons", "_outlier")


def selected(df: DataFrame, source: str = "AUTO", *, speed: str = "speed_ok", gate: str = "gate_ok") -> DataFrame:
    """Rows of one source that pass the flags and have a finite time.

    AUTO takes BI in runs that have it, else BE; other names don't filter by source.
    """
    rows = df.filter(~F.isnan("t_s") & F.col("t_s").isNotNull())
    for flag in (gate, speed):
        if flag in df.columns:
            rows = rows.filter(timeline_flag(F.col(flag)))
    source = source.upper()
    if source in ("BI", "BE"):
        return by_source(rows, source)
    if source == "AUTO":
        has_body = F.max(normalised_source(F.col("src")) == "BI").over(W.partitionBy("run_id"))
        return rows.withColumn("_b", has_body).filter(normalised_source(F.col("src")) == F.when(F.col("_b"), "BI").otherwise("BE")).drop("_b")
    return rows


def preprocessed_velocity(df: DataFrame, limits: GateLimits = GateLimits(), window: int = 5, *by: str) -> DataFrame:
    """Gates, then keeps what passes and smooths it with the zero-padded centred mean."""
    kept = gated(df, limits, by=by).filter("gate_pass")
    smooth = {f"{c}_f": moving_average_same(F.col(c), window, *by) for c in ("vE", "vN", "vU")}
    kept = kept.withColumns(smooth)
    return kept.withColumn("speed_f", norm(*(F.col(f"{c}_f") for c in ("vE", "vN", "vU"))))
