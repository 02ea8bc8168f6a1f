"""Statistics of sensor columns: per run or per group, on finite values only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.columns import finite
from tidewake.functions.geometry import wrap_pi
from tidewake.operators.timeseries import step

#: 95 % points of the chi-square distribution for 1 to 6 degrees of freedom.
CHI2_95 = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.070, 6: 12.592}
SPEED_BINS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 2.0)


def quantile(c: Column, q: float) -> Column:
    """Exact, by linear interpolation."""
    return F.percentile(c, F.lit(q))


def when_enough(c: Column, value: Column, least: int) -> Column:
    return F.when(F.count(c) >= least, value)


def scalar_stats(c: Column, name: str) -> list[Column]:
    """mean, std (population), p95 of |x|, max |x| and rms of the finite values."""
    c = finite(c)
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), quantile(F.abs(c), 0.95).alias(f"{name}_p95abs"), F.max(F.abs(c)).alias(f"{name}_maxabs"), F.sqrt(F.avg(c * c)).alias(f"{name}_rms")]


def vector_stats(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Tidy (by, axis, mean, std, p95abs), one row per column, from one pass over an unpivoted table."""
    tidy = df.select(*by, *(finite(F.col(c).cast("double")).alias(c) for c in columns)).unpivot(list(by), list(columns), "axis", "x")
    return tidy.groupBy(*by, "axis").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), quantile(F.abs(F.col("x")), 0.95).alias("p95abs"))


def steps(df: DataFrame, *by: str) -> DataFrame:
    """Adds dt, the positive finite step to the row before."""
    d = step(F.col("t_s"), *by)
    return df.withColumn("dt", finite(F.when(d > 0, d)))


def sample_rate(df: DataFrame) -> DataFrame:
    """(run_id, fs): one over the median step; null without steps."""
    return steps(df).groupBy("run_id").agg(F.try_divide(F.lit(1.0), quantile(F.col("dt"), 0.5)).alias("fs"))


def step_stats(df: DataFrame) -> DataFrame:
    """Per run the median, p95, least and largest step and the share that is over 3 or under half a median."""
    rows = steps(df)
    rows = rows.withColumn("median", quantile(F.col("dt"), 0.5).over(W.partitionBy("run_id"))).filter("dt is not null")
    bad = ((F.col("dt") > 3 * F.col("median")) | (F.col("dt") < 0.5 * F.col("median"))).cast("double")
    return rows.groupBy("run_id").agg(F.max("median").alias("median"), quantile(F.col("dt"), 0.95).alias("p95"), F.min("dt").alias("least"), F.max("dt").alias("largest"), F.avg(bad).alias("bad_ratio"))


def pearson(x: Column, y: Column, least: int) -> Column:
    """Correlation over rows where both are finite; null under ``least`` of them or without variance."""
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    # corr itself divides by zero, which is an error, whatever a condition around it says: aggregates come first
    return F.when((F.count(x) >= least) & (sx > 0) & (sy > 0), F.covar_pop(x, y) / sx / sy)


def zero_ratio(c: Column) -> Column:
    return F.avg((F.abs(c) < 1e-12).cast("double"))


def share_above(c: Column, limit: float) -> Column:
    """Share of all rows whose value is over the limit; NaN and null count as not over."""
    return F.avg(F.coalesce((finite(c) > limit).cast("double"), F.lit(0.0)))


def counts_map(c: Column) -> Column:
    """Counts of a text column that was grouped already, as a map; see ``reason_counts``."""
    return F.map_from_entries(F.array_sort(F.collect_list(c)))


def reason_counts(df: DataFrame, by: Sequence[str], reasons: str) -> DataFrame:
    """(by, reason, n) from semicolon-joined reasons."""
    return df.select(*by, F.explode(F.split(reasons, ";")).alias("reason")).filter("reason <> ''").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def speed_bin(c: Column, edges: Sequence[float] = SPEED_BINS) -> Column:
    """Number of the half-open bin [edge, next edge); null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((c >= a) & (c < b), i).otherwise(out)
    return out


def fixed_windows(df: DataFrame, length: float, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Stats of ``columns`` in windows of ``length`` seconds from the run's first sample; windows under ``least`` rows go."""
    first = F.min("t_s").over(W.partitionBy("run_id"))
    rows = df.withColumn("bin", F.floor((F.col("t_s") - first) / length))
    stats = [x for c in columns for x in scalar_stats(F.col(c), c)[:3]]
    return rows.groupBy("run_id", "bin").agg(F.count("*").alias("n"), *stats).filter(F.col("n") >= least)


def worst_windows(df: DataFrame, length: float, nis: str, least: int, share: float = 0.90) -> DataFrame:
    """Windows with ``least`` rows whose mean reaches the ``share`` quantile of all windows' means.

    Where fewer than three windows have a mean, p95 is the score instead. The threshold is one row, joined back.
    """
    first = F.min("t_s").over(W.partitionBy("run_id"))
    rows = df.withColumn("bin", F.floor((F.col("t_s") - first) / length)).withColumn("x", finite(F.col(nis)))
    bins = rows.groupBy("run_id", "bin").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), quantile(F.col("x"), 0.95).alias("p95"), quantile(F.col("x"), 0.99).alias("p99"), F.avg(F.col("x").isNull().cast("double")).alias("missing"))
    bins = bins.filter(F.col("n") >= least)
    enough = bins.agg((F.count("mean") >= 3).alias("enough"), quantile(F.col("mean"), share).alias("q_mean"), quantile(F.col("p95"), share).alias("q_p95"))
    score = F.when(F.col("enough"), F.col("mean")).otherwise(F.col("p95"))
    limit = F.when(F.col("enough"), F.col("q_mean")).otherwise(F.col("q_p95"))
    return bins.join(F.broadcast(enough)).withColumn("bad", score >= limit).drop("enough", "q_mean", "q_p95")  # one row


def collapse_times(df: DataFrame, means: Sequence[str], maxima: Sequence[str]) -> DataFrame:
    """One row per run and time."""
    return df.groupBy("run_id", "t_s").agg(*(F.max(c).alias(c) for c in maxima), *(F.avg(c).alias(c) for c in means))


def chi2_limit(dim: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CHI2_95.items() for x in kv))
    return F.coalesce(F.element_at(table, dim), F.lit(CHI2_95[3]))


def time_weighted_mean(df: DataFrame, column: str) -> DataFrame:
    """Per run the trapezoid mean of a column over time; the plain mean where no time passes."""
    d = step(F.col("t_s"))
    area = (F.col(column) + F.lag(column).over(W.partitionBy("run_id").orderBy("t_s", "_row"))) / 2 * d
    rows = df.withColumns({"_d": d, "_area": area})
    return rows.groupBy("run_id").agg(F.when(F.sum("_d") > 0, F.sum("_area") / F.sum("_d")).otherwise(F.avg(column)).alias("mean"))


def slope(y: Column, x: Column, least: int = 10) -> Column:
    return F.when(F.count(y) >= least, F.regr_slope(y, x))


def circular_mean_deg(c: Column) -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(c)), F.avg(F.cos(c))))


def best_offset(df: DataFrame, a: str, b: str, offsets: Sequence[float] = (0.0, 90.0, -90.0, 180.0)) -> DataFrame:
    """Per run the offset (degrees) with the least rms of a - b - offset, wrapped; the first wins ties.

    All offsets are columns of one aggregation: no row is copied.
    """
    rms = [F.sqrt(F.avg(F.pow(wrap_pi(F.col(a) - F.col(b) - math.radians(o)), 2))).alias(f"_r{i}") for i, o in enumerate(offsets)]
    rows = df.groupBy("run_id").agg(*rms)
    ranked = F.array_sort(F.array(*(F.struct(F.round(f"_r{i}", 9).alias("rms"), F.lit(i).alias("i"), F.lit(float(o)).alias("offset")) for i, o in enumerate(offsets))))
    return rows.select("run_id", F.get(ranked, F.lit(0)).alias("best")).select("run_id", "best.offset", "best.rms")


def linear_map(df: DataFrame, by: Sequence[str], x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """Least-squares 2 x 2 map y = M x from five sums, with its determinant, and the rotation and scale nearest to it."""
    (a, b), (c, d) = x, y
    s = df.groupBy(*by).agg(*(F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("aa", a, a), ("ab", a, b), ("bb", b, b), ("ca", c, a), ("cb", c, b), ("da", d, a), ("db", d, b))))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("_det", F.when(F.abs(det) > 1e-12, det))
    m = {
        "m00": (F.col("ca") * F.col("bb") - F.col("cb") * F.col("ab")) / F.col("_det"), "m01": (F.col("cb") * F.col("aa") - F.col("ca") * F.col("ab")) / F.col("_det"),
        "m10": (F.col("da") * F.col("bb") - F.col("db") * F.col("ab")) / F.col("_det"), "m11": (F.col("db") * F.col("aa") - F.col("da") * F.col("ab")) / F.col("_det"),
    }
    s = s.withColumns(m)
    angle = F.atan2(F.col("m10") - F.col("m01"), F.col("m00") + F.col("m11"))
    # singular values of a 2 x 2 matrix in closed form
    e, f, g, h = (F.col("m00") + F.col("m11")) / 2, (F.col("m00") - F.col("m11")) / 2, (F.col("m10") + F.col("m01")) / 2, (F.col("m10") - F.col("m01")) / 2
    q, r = F.sqrt(e * e + h * h), F.sqrt(f * f + g * g)
    s = s.withColumns({"det": F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10"), "angle_deg": F.degrees(angle), "scale": ((q + r) + F.abs(q - r)) / 2})
    trace, gram = F.col("aa") + F.col("bb"), F.sqrt(F.pow(F.col("aa") - F.col("bb"), 2) + 4 * F.col("ab") * F.col("ab"))
    return s.withColumn("cond", F.when(trace - gram > 0, (trace + gram) / (trace - gram))).select(*by, *m, "det", "angle_deg", "scale", "cond")


#: Axis transforms that frame searches try: name, east from (x, y), north from (x, y).
FRAMES = (("identity", "x", "y"), ("swap", "y", "x"), ("flip_x", "-x", "y"), ("flip_y", "x", "-y"), ("flip_xy", "-x", "-y"), ("rot_p90", "-y", "x"), ("rot_m90", "y", "-x"))


def frame_candidates(df: DataFrame, by: Sequence[str], east: str, north: str, heading: str, offsets: Sequence[float] = (0.0, 90.0, -90.0, 180.0)) -> DataFrame:
    """(by, frame, offset, mean, std, p95) of the wrapped difference between course and heading for each candidate.

    Candidates are an array of constants per row, so a row is copied once for each of them and no table is joined.
    """
    def course(e: str, n: str) -> Column:
        pick = lambda k: (-1.0 if k[0] == "-" else 1.0) * F.col(east if k[-1] == "x" else north)
        return F.atan2(pick(n), pick(e))

    rows = df.select(*by, F.col(heading).alias("_h"), F.explode(F.array(*(F.struct(F.lit(n).alias("frame"), course(e, m).alias("course")) for n, e, m in FRAMES))).alias("c"))
    rows = rows.select(*by, "_h", "c.frame", "c.course", F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    d = wrap_pi(F.col("course") - F.col("_h") - F.radians("offset"))
    return rows.withColumn("d", d).groupBy(*by, "frame", "offset").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), quantile(F.abs(F.col("d")), 0.95).alias("p95"))


def tilt_error_deg(ax: Column, ay: Column, g: float = 9.78) -> Column:
    """Tilt that explains a mean horizontal acceleration."""
    horizontal = F.sqrt(F.avg(ax) * F.avg(ax) + F.avg(ay) * F.avg(ay))
    return F.degrees(F.asin(F.least(F.lit(1.0), horizontal / g)))


def flag_source_rates(df: DataFrame, by: Sequence[str], *, ok: str = "gate_ok", reason: str = "gate_reason", speed: str = "speed", static_s: float = 20.0, most_speed: float = 0.05, top: int = 8) -> DataFrame:
    """Per group ``by`` (a source) n, n_ok, ok_rate, the ``top`` reasons of rows that fail with their counts, and the speed at rest.

    ``static_p95`` is the 95th percentile of |speed| over the group's first ``static_s`` seconds, rows
    without a finite speed left out; ``warn`` says that it is over ``most_speed``.
    """
    rows = df.withColumn("_t0", F.min("t_s").over(W.partitionBy(*by)))
    still = F.when((F.col("t_s") - F.col("_t0") <= static_s) & ~F.isnan(speed), F.abs(F.col(speed)))
    flag = F.coalesce(F.col(ok), F.lit(False))
    rates = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_ok"), F.avg(flag.cast("double")).alias("ok_rate"), quantile(still, 0.95).alias("static_p95"))
    counts = df.filter(~flag).groupBy(*by, F.col(reason).cast("string").alias("_reason")).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_n"), "_reason"))
    best = counts.withColumn("_rank", rank).filter(F.col("_rank") <= top).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col("_reason").alias("reason"), F.col("_n").alias("n")))).alias("_r"))
    rates = rates.join(best, list(by), "left")
    reasons = F.coalesce(F.transform("_r", lambda r: F.concat_ws(":", r.reason, r.n.cast("string"))), F.array().cast("array<string>"))
    return rates.withColumns({"reasons": reasons, "warn": F.coalesce(F.col("static_p95") > most_speed, F.lit(False))}).drop("_r")
