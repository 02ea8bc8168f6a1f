"""Windows over the samples of a run, ordered by time and then by the row's ordinal.

Every function takes rows with ``run_id``, ``t_s`` and ``_row``; ``by`` names further partition columns.
A run is one partition, so runs are the unit that a cluster spreads; one ordering serves all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.columns import finite

ORDER = ("t_s", "_row")


def run(*by: str) -> WindowSpec:
    return W.partitionBy("run_id", *by).orderBy(*ORDER)


def whole(*by: str) -> WindowSpec:
    return W.partitionBy("run_id", *by)


def frame(before: int, after: int, *by: str) -> WindowSpec:
    return run(*by).rowsBetween(-before, after)


def until_now(*by: str) -> WindowSpec:
    return run(*by).rowsBetween(W.unboundedPreceding, W.currentRow)


def step(c: Column, *by: str) -> Column:
    """Difference to the row before; null on the first."""
    return c - F.lag(c).over(run(*by))


def moving_average_same(c: Column, size: int, *by: str) -> Column:
    """Centred sum of ``size`` rows over ``size``: rows outside the run count as 0."""
    return F.sum(c).over(frame(size // 2, (size - 1) // 2, *by)) / size


def rolling_mean(c: Column, size: int, *by: str, least: int = 1) -> Column:
    """Centred mean over the rows there are; even sizes grow by one. Null under ``least`` values."""
    size += 1 - size % 2
    w = frame(size // 2, (size - 1) // 2, *by)
    return F.when(F.count(c).over(w) >= least, F.avg(c).over(w))


def rolling_median(c: Column, size: int, *by: str) -> Column:
    w = frame(size // 2, (size - 1) // 2, *by)
    return F.when(F.count(c).over(w) >= max(3, size // 3), F.percentile(c, F.lit(0.5)).over(w))


def robust_z(df: DataFrame, column: str, size: int, *by: str, to: str = "robust_z") -> DataFrame:
    """|x - median| / (1.4826 MAD) over centred windows; null where the MAD is 1e-9 or less."""
    df = df.withColumn("_median", rolling_median(F.col(column), size, *by))
    df = df.withColumn("_mad", rolling_median(F.abs(F.col(column) - F.col("_median")), size, *by))
    z = F.when(F.col("_mad") > 1e-9, F.abs(F.col(column) - F.col("_median")) / (1.4826 * F.col("_mad")))
    return df.withColumn(to, z).drop("_median", "_mad")


def unwrap(df: DataFrame, column: str, to: str, *by: str) -> DataFrame:
    """Angles without jumps of more than half a turn."""
    d = step(F.col(column), *by)
    wrapped = F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi
    wrapped = F.when((wrapped == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(wrapped)
    fix = F.when(F.abs(d) < math.pi, F.lit(0.0)).otherwise(wrapped - d)
    df = df.withColumn("_fix", F.coalesce(fix, F.lit(0.0)))
    return df.withColumn(to, F.col(column) + F.sum("_fix").over(until_now(*by))).drop("_fix")


def running_sum(c: Column, *by: str) -> Column:
    return F.sum(c).over(until_now(*by))


def guarded_dt(df: DataFrame, max_gap: float, to: str = "dt", *by: str) -> DataFrame:
    """Time steps with gaps set to 0.

    The guard is 5 medians where ``max_gap`` isn't positive, 3 medians where it is under 1.5 medians,
    else ``max_gap``; without steps there is none. The first step is 0, as are steps back.
    """
    df = df.withColumn("_d", step(F.col("t_s"), *by))
    positive = finite(F.when(F.col("_d") > 0, F.col("_d")))
    median = F.percentile(positive, F.lit(0.5)).over(whole(*by))
    guard = F.when(median.isNull(), math.inf).when(F.lit(max_gap) <= 0, 5 * median).when(F.lit(max_gap) < 1.5 * median, 3 * median).otherwise(F.lit(max_gap))
    df = df.withColumn("_guard", guard)
    return df.withColumn(to, F.when((F.col("_d") > 0) & (F.col("_d") <= F.col("_guard")), F.col("_d")).otherwise(0.0)).drop("_d", "_guard")


def trapezoid(c: Column, *by: str) -> Column:
    """Each step's share of the integral of ``c`` over time; 0 on the first row."""
    return F.coalesce((c + F.lag(c).over(run(*by))) / 2 * step(F.col("t_s"), *by), F.lit(0.0))


def hold_last(c: Column, valid: Column, *by: str) -> Column:
    """``c`` where valid, else the last valid value."""
    return F.last(F.when(valid, c), ignorenulls=True).over(until_now(*by))


def relative_time(*by: str) -> Column:
    return F.col("t_s") - F.min("t_s").over(whole(*by))


def stride(df: DataFrame, every: int, most: int | None = None, *by: str) -> DataFrame:
    """Every ``every``-th row of a run from its first, the first ``most`` of them."""
    df = df.withColumn("_n", F.row_number().over(run(*by)) - 1).filter(F.col("_n") % every == 0)
    if most is not None:
        df = df.filter(F.col("_n") < every * most)
    return df.drop("_n")


def downsample(df: DataFrame, points: int, *by: str) -> DataFrame:
    """At most ``points`` rows of a run, evenly spread, both ends among them."""
    df = df.withColumns({"_i": F.row_number().over(run(*by)) - 1, "_n": F.count("*").over(whole(*by))})
    if points < 2:
        return df.filter(F.col("_i") < points).drop("_i", "_n")
    last = F.lit(points - 1)
    # the row is floor(j (n - 1) / (points - 1)) for some j: the least such j that reaches it gives it back
    j = F.ceil(F.col("_i") * last / F.greatest(F.col("_n") - 1, F.lit(1)))
    keep = (F.col("_n") <= points) | (F.floor(j * (F.col("_n") - 1) / last) == F.col("_i"))
    return df.filter(keep).drop("_i", "_n")


def tail_window(length: float, *by: str) -> Column:
    """Number of rows in the last ``length`` seconds up to each row."""
    micros = F.round(F.col("t_s") * 1e6).cast("long")
    w = W.partitionBy("run_id", *by).orderBy(micros).rangeBetween(-int(length * 1e6), 0)
    return F.count("*").over(w)


def static_window(length: float) -> Column:
    """The first ``length`` seconds of a run, both ends included; the whole run where that is empty."""
    inside = F.col("t_s") <= F.min("t_s").over(whole()) + length
    return F.coalesce(inside, F.lit(False)) | ~F.coalesce(F.max(inside).over(whole()), F.lit(False))


def newer_than_before() -> Column:
    """False for a sample that isn't newer than all that came before it in order of arrival (_row)."""
    earlier = W.partitionBy("run_id").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    newest = F.max("t_s").over(earlier)
    return newest.isNull() | (F.col("t_s") > newest)
