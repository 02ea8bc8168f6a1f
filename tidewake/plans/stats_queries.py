"""Queries over the sensor view of events: statistics, diagnostics, geometry, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import columns as col
from tidewake.functions import geometry as geo
from tidewake.operators import stats
from tidewake.operators import timeseries as ts
from tidewake.plans.catalogue import register
from tidewake.plans.samples import HOUR, SQL, rounded, samples, table
from tidewake.plans.series_queries import OVER

_D = SQL + f", d AS (SELECT *, t_s - lag(t_s) OVER ({OVER}) AS dt FROM s), p AS (SELECT * FROM d WHERE dt > 0)"


def _r(df, *keys, digits=6):
    return rounded(df, *df.columns, digits=digits)


@register("a01_sample_rate", _D + " SELECT run_id, round(1.0 / quantile_cont(dt, 0.5), 9) AS fs FROM p GROUP BY run_id")
def a01(spark, sf):
    return _r(stats.sample_rate(samples(spark, sf)), digits=9)


@register("a02_dt_stats", _D + ", m AS (SELECT run_id, quantile_cont(dt, 0.5) AS median FROM p GROUP BY run_id) SELECT run_id, round(median, 6) AS median, round(quantile_cont(dt, 0.95), 6) AS p95, round(min(dt), 6) AS least, round(max(dt), 6) AS largest, round(avg(CASE WHEN dt > 3 * median OR dt < 0.5 * median THEN 1.0 ELSE 0.0 END), 6) AS bad_ratio FROM p JOIN m USING (run_id) GROUP BY run_id, median")
def a02(spark, sf):
    return _r(stats.step_stats(samples(spark, sf)))


_ST = SQL + ", z AS (SELECT *, t_s <= min(t_s) OVER (PARTITION BY run_id) + 240 * 3600.0 AS static FROM s)"


@register("a03_a04_bias_noise", _ST + f", d AS (SELECT *, t_s - lag(t_s) OVER ({OVER}) AS dt FROM z) SELECT run_id, round(avg(gx) FILTER (WHERE static), 6) AS bias_gx, round(avg(gy) FILTER (WHERE static), 6) AS bias_gy, round(stddev_pop(gx) FILTER (WHERE static) * sqrt(quantile_cont(dt, 0.5) FILTER (WHERE dt > 0)), 4) AS noise_gx FROM d GROUP BY run_id")
def a03(spark, sf):
    rows = stats.steps(samples(spark, sf).withColumn("static", ts.static_window(240 * HOUR)))
    inside = lambda c: F.when(F.col("static"), F.col(c))
    noise = F.stddev_pop(inside("gx")) * F.sqrt(stats.quantile(F.col("dt"), 0.5))
    return rows.groupBy("run_id").agg(F.round(F.avg(inside("gx")), 6).alias("bias_gx"), F.round(F.avg(inside("gy")), 6).alias("bias_gy"), F.round(noise, 4).alias("noise_gx"))


@register("a05_vec_stats", SQL + ", u AS (SELECT run_id, 'ax' AS axis, ax AS x FROM s UNION ALL SELECT run_id, 'ay', ay FROM s UNION ALL SELECT run_id, 'az', az FROM s) SELECT run_id, axis, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(abs(x), 0.95), 6) AS p95abs FROM u GROUP BY run_id, axis")
def a05(spark, sf):
    return _r(stats.vector_stats(samples(spark, sf), ["run_id"], ["ax", "ay", "az"]))


@register("a06_scalar_stats", SQL + " SELECT src, round(avg(value), 6) AS v_mean, round(stddev_pop(value), 6) AS v_std, round(quantile_cont(abs(value), 0.95), 6) AS v_p95abs, round(max(abs(value)), 6) AS v_maxabs, round(sqrt(avg(value * value)), 6) AS v_rms FROM s GROUP BY src")
def a06(spark, sf):
    return _r(samples(spark, sf).groupBy("src").agg(*stats.scalar_stats(F.col("value"), "v")))


@register("a07_zero_ratio", SQL + " SELECT run_id, round(avg(CASE WHEN abs(ax) < 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS zero_ax FROM s GROUP BY run_id")
def a07(spark, sf):
    return _r(samples(spark, sf).groupBy("run_id").agg(stats.zero_ratio(F.col("ax")).alias("zero_ax")))


@register("a08_frame_summary", SQL + f", j AS (SELECT *, abs(vU) > 0.25 AS steep, abs(vE - lag(vE) OVER (PARTITION BY run_id, src ORDER BY t_s, _row)) AS de FROM s WHERE src <> 'IMU') SELECT run_id, src, count(*) AS n, count(*) FILTER (WHERE gate_ok) AS n_ok, round(avg(CASE WHEN gate_ok THEN 1.0 ELSE 0.0 END), 6) AS pass_ratio, round(max(t_s) - min(t_s), 6) AS duration, round(max(de), 6) AS max_jump, round(avg(CASE WHEN steep THEN 1.0 ELSE 0.0 END), 6) AS steep_ratio FROM j GROUP BY run_id, src")
def a08(spark, sf):
    rows = samples(spark, sf, "BE", "BI").withColumn("de", F.abs(ts.step(F.col("vE"), "src")))
    ok = F.col("gate_ok")
    return _r(rows.groupBy("run_id", "src").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.avg(ok.cast("double")).alias("pass_ratio"), (F.max("t_s") - F.min("t_s")).alias("duration"), F.max("de").alias("max_jump"), F.avg(col.above(F.abs("vU"), 0.25).cast("double")).alias("steep_ratio")))


@register("a09_value_counts", SQL + ", f AS (SELECT src, CASE WHEN NOT valid THEN 'valid' END AS a, CASE WHEN water_mass THEN 'water_mass' END AS b FROM s), r AS (SELECT src, a AS reason FROM f UNION ALL SELECT src, b FROM f) SELECT src, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY src, reason")
def a09(spark, sf):
    reasons = col.joined_reasons([("valid", ~F.col("valid")), ("water_mass", F.col("water_mass"))])
    return stats.reason_counts(samples(spark, sf).withColumn("reasons", reasons), ["src"], "reasons")


@register("a10_a11_mode_stats", SQL + " SELECT src, round(max(t_s) - min(t_s), 6) AS duration, round(count(*) / (max(t_s) - min(t_s)), 9) AS fs, round(min(sqrt(vE * vE + vN * vN)), 6) AS v_min, round(avg(sqrt(vE * vE + vN * vN)), 6) AS v_mean, round(quantile_cont(sqrt(vE * vE + vN * vN), 0.95), 6) AS v_p95, round(stddev_pop(vE), 6) AS e_std FROM s GROUP BY src")
def a10(spark, sf):
    v, span = geo.norm(F.col("vE"), F.col("vN")), F.max("t_s") - F.min("t_s")
    return samples(spark, sf).groupBy("src").agg(F.round(span, 6).alias("duration"), F.round(F.count("*") / span, 9).alias("fs"), F.round(F.min(v), 6).alias("v_min"), F.round(F.avg(v), 6).alias("v_mean"), F.round(stats.quantile(v, 0.95), 6).alias("v_p95"), F.round(F.stddev_pop("vE"), 6).alias("e_std"))


@register("a12_pearson", SQL + " SELECT run_id, CASE WHEN count(*) >= 5 THEN round(corr(vE, gx), 6) END AS c_e_gx, round(corr(vN, value), 6) AS c_n_value FROM s WHERE src = 'BE' GROUP BY run_id HAVING count(*) >= 5")
def a12(spark, sf):
    rows = samples(spark, sf, "BE").groupBy("run_id").agg(stats.pearson(F.col("vE"), F.col("gx"), 5).alias("c_e_gx"), stats.pearson(F.col("vN"), F.col("value"), 3).alias("c_n_value"), F.count("*").alias("n"))
    return _r(rows.filter("n >= 5").drop("n"))


@register("a13_nis_summary", SQL + " SELECT run_id, round(avg(value), 6) AS nis_mean, round(quantile_cont(value, 0.95), 6) AS nis_p95, round(quantile_cont(value, 0.99), 6) AS nis_p99, round(avg(sqrt(vE * vE + vN * vN)), 6) AS dv_mean, round(max(sqrt(vE * vE + vN * vN)), 6) AS dv_max FROM s GROUP BY run_id")
def a13(spark, sf):
    dv = geo.norm(F.col("vE"), F.col("vN"))
    return _r(samples(spark, sf).groupBy("run_id").agg(F.avg("value").alias("nis_mean"), stats.quantile(F.col("value"), 0.95).alias("nis_p95"), stats.quantile(F.col("value"), 0.99).alias("nis_p99"), F.avg(dv).alias("dv_mean"), F.max(dv).alias("dv_max")))


@register("a14_consistency_issues", SQL + ", g AS (SELECT run_id, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, corr(vE, vN) AS c FROM s GROUP BY run_id HAVING count(*) >= 20) SELECT run_id, n, concat_ws(';', CASE WHEN p50 > 100 THEN 'median_high' END, CASE WHEN p95 > 330 THEN 'tail_high' END, CASE WHEN abs(c) > 0.2 THEN 'cross_correlated' END) AS issues FROM g")
def a14(spark, sf):
    g = samples(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), stats.quantile(F.col("value"), 0.5).alias("p50"), stats.quantile(F.col("value"), 0.95).alias("p95"), stats.pearson(F.col("vE"), F.col("vN"), 3).alias("c"))
    issues = [("median_high", col.above(F.col("p50"), 100)), ("tail_high", col.above(F.col("p95"), 330)), ("cross_correlated", col.above(F.abs("c"), 0.2))]
    return g.filter("n >= 20").select("run_id", "n", col.joined_reasons(issues).alias("issues"))


@register("a15_residual_dominance", SQL + ", q AS (SELECT run_id, quantile_cont(value, 0.9) AS lim FROM s GROUP BY run_id), m AS (SELECT run_id, avg(gx * gx) AS a, avg(gy * gy) AS b, avg(gz * gz) AS c FROM s JOIN q USING (run_id) WHERE value >= lim GROUP BY run_id) SELECT run_id, CASE WHEN a >= b AND a >= c THEN 'x' WHEN b >= c THEN 'y' ELSE 'z' END AS axis FROM m")
def a15(spark, sf):
    rows = samples(spark, sf).withColumn("lim", stats.quantile(F.col("value"), 0.9).over(W.partitionBy("run_id"))).filter("value >= lim")
    m = rows.groupBy("run_id").agg(*(F.avg(F.col(c) * F.col(c)).alias(c) for c in ("gx", "gy", "gz")))
    top = F.greatest("gx", "gy", "gz") * (1 - 1e-12)  # equal means differ in the last digits by the order of their sums
    return m.select("run_id", col.first_reason([("x", F.col("gx") >= top), ("y", F.col("gy") >= top)], "z").alias("axis"))


@register("a16_focus_metrics", SQL + " SELECT run_id, round(sqrt(avg(vE * vE)), 6) AS rmse, round(quantile_cont(abs(vE), 0.95), 6) AS p95, round(avg(CASE WHEN gate_ok THEN 1.0 ELSE 0.0 END), 6) AS trigger_ratio FROM s GROUP BY run_id HAVING count(*) >= 20")
def a16(spark, sf):
    rows = samples(spark, sf).groupBy("run_id").agg(F.sqrt(F.avg(F.col("vE") * F.col("vE"))).alias("rmse"), stats.quantile(F.abs("vE"), 0.95).alias("p95"), F.avg(F.col("gate_ok").cast("double")).alias("trigger_ratio"), F.count("*").alias("n"))
    return _r(rows.filter("n >= 20").drop("n"))


@register("a17_speed_bins", SQL + ", b AS (SELECT *, sqrt(vE * vE + vN * vN) AS v FROM s), c AS (SELECT *, CASE WHEN v < 0.02 THEN 0 WHEN v < 0.05 THEN 1 WHEN v < 0.1 THEN 2 WHEN v < 0.2 THEN 3 WHEN v < 0.5 THEN 4 WHEN v < 2 THEN 5 END AS bin FROM b) SELECT bin, count(*) AS n, round(sqrt(avg(gx * gx)), 6) AS rmse, round(quantile_cont(abs(gx), 0.95), 6) AS p95 FROM c WHERE bin IS NOT NULL GROUP BY bin")
def a17(spark, sf):
    rows = samples(spark, sf).withColumn("bin", stats.speed_bin(geo.norm(F.col("vE"), F.col("vN")))).filter("bin is not null")
    return _r(rows.groupBy("bin").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("gx") * F.col("gx"))).alias("rmse"), stats.quantile(F.abs("gx"), 0.95).alias("p95")))


_BIN = SQL + ", b AS (SELECT *, CAST(floor((t_s - min(t_s) OVER (PARTITION BY run_id)) / (100 * 3600.0)) AS BIGINT) AS bin FROM s)"


@register("a18_r13_fixed_windows", _BIN + " SELECT run_id, bin, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(quantile_cont(abs(value), 0.95), 6) AS value_p95abs FROM b GROUP BY run_id, bin HAVING count(*) >= 3")
def a18(spark, sf):
    return _r(stats.fixed_windows(samples(spark, sf), 100 * HOUR, ["value"]))


@register("a19_bad_windows", _BIN + ", g AS (SELECT run_id, bin, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, 0.0::DOUBLE AS missing FROM b GROUP BY run_id, bin HAVING count(*) >= 5) SELECT run_id, bin, n, round(mean, 6) AS mean, round(p95, 6) AS p95, round(p99, 6) AS p99, missing, mean >= (SELECT quantile_cont(mean, 0.9) FROM g) AS bad FROM g")
def a19(spark, sf):
    return _r(stats.worst_windows(samples(spark, sf), 100 * HOUR, "value", 5))


@register("a20_a21_collapse_chi2", SQL + ", c AS (SELECT run_id, floor(t_s / 36000) AS t_s, max(value / 40) AS nis, max(1 + k % 6) AS dim, avg(gx) AS r FROM s GROUP BY run_id, floor(t_s / 36000)) SELECT run_id, count(*) AS n, round(avg(CASE WHEN nis > [3.841, 5.991, 7.815, 9.488, 11.070, 12.592][dim] THEN 1.0 ELSE 0.0 END), 6) AS exceed, round(avg(r), 6) AS r FROM c GROUP BY run_id")
def a20(spark, sf):
    rows = samples(spark, sf).withColumns({"t_s": F.floor(F.col("t_s") / 36000), "nis": F.col("value") / 40, "dim": 1 + F.col("k") % 6})
    once = stats.collapse_times(rows.withColumn("r", F.col("gx")), ["r"], ["nis", "dim"])
    return _r(once.groupBy("run_id").agg(F.count("*").alias("n"), F.avg(col.above(F.col("nis"), stats.chi2_limit(F.col("dim"))).cast("double")).alias("exceed"), F.avg("r").alias("r")))


@register("a22_a23_time_weighted", _D + f", t AS (SELECT *, (value + lag(value) OVER ({OVER})) / 2 * dt AS area FROM d) SELECT run_id, round(sum(area) / sum(dt), 5) AS mean FROM t GROUP BY run_id")
def a22(spark, sf):
    return _r(stats.time_weighted_mean(samples(spark, sf), "value"), digits=5)


@register("a24_a25_slope_circular", SQL + ", r AS (SELECT *, (t_s - min(t_s) OVER (PARTITION BY run_id)) / 3600 AS h FROM s) SELECT run_id, CASE WHEN count(*) >= 10 THEN round(regr_slope(value, h), 6) END AS slope, round(degrees(atan2(avg(sin(heading)), avg(cos(heading)))), 4) AS heading FROM r GROUP BY run_id")
def a24(spark, sf):
    rows = samples(spark, sf).withColumn("h", ts.relative_time() / 3600)
    return rows.groupBy("run_id").agg(F.round(stats.slope(F.col("value"), F.col("h")), 6).alias("slope"), F.round(stats.circular_mean_deg(F.col("heading")), 4).alias("heading"))


_WRAP = "({x}) - 2 * pi() * floor((({x}) + pi()) / (2 * pi()))"


@register("a26_best_offset", SQL + ", o AS (SELECT * FROM (VALUES (0, 0.0), (1, 90.0), (2, -90.0), (3, 180.0)) AS t(i, o)), c AS (SELECT run_id, i, o, round(sqrt(avg(pow(" + _WRAP.format(x="heading * 0.5 - yaw * 0.25 - radians(o)") + ", 2))), 9) AS rms FROM s, o GROUP BY run_id, i, o), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rms, i) AS rk FROM c) SELECT run_id, CAST(o AS DOUBLE) AS offset_deg, round(rms, 6) AS rms FROM k WHERE rk = 1")
def a26(spark, sf):
    rows = samples(spark, sf).withColumns({"a": F.col("heading") * 0.5, "b": F.col("yaw") * 0.25})
    return stats.best_offset(rows, "a", "b").select("run_id", F.col("offset").alias("offset_deg"), F.round("rms", 6).alias("rms"))


@register("a27_lsq_map_2x2", SQL + ", q AS (SELECT run_id, sum(vE * vE) AS aa, sum(vE * vN) AS ab, sum(vN * vN) AS bb, sum(gx * vE) AS ca, sum(gx * vN) AS cb, sum(gy * vE) AS da, sum(gy * vN) AS db FROM s GROUP BY run_id), m AS (SELECT run_id, (ca * bb - cb * ab) / (aa * bb - ab * ab) AS m00, (cb * aa - ca * ab) / (aa * bb - ab * ab) AS m01, (da * bb - db * ab) / (aa * bb - ab * ab) AS m10, (db * aa - da * ab) / (aa * bb - ab * ab) AS m11 FROM q) SELECT run_id, round(m00, 6) AS m00, round(m01, 6) AS m01, round(m10, 6) AS m10, round(m11, 6) AS m11, round(m00 * m11 - m01 * m10, 6) AS det, round(degrees(atan2(m10 - m01, m00 + m11)), 4) AS angle_deg FROM m")
def a27(spark, sf):
    m = stats.linear_map(samples(spark, sf), ["run_id"], ("vE", "vN"), ("gx", "gy"))
    return m.select("run_id", *(F.round(c, 6).alias(c) for c in ("m00", "m01", "m10", "m11", "det")), F.round("angle_deg", 4).alias("angle_deg"))


@register("a28_t05_frame_candidates", SQL + ", f AS (SELECT * FROM (VALUES ('identity', 1, 0, 0, 1), ('swap', 0, 1, 1, 0), ('flip_x', -1, 0, 0, 1), ('flip_y', 1, 0, 0, -1), ('flip_xy', -1, 0, 0, -1), ('rot_p90', 0, -1, 1, 0), ('rot_m90', 0, 1, -1, 0)) AS t(frame, ex, ey, nx, ny)), o AS (SELECT unnest([0.0, 90.0, -90.0, 180.0]) AS off), c AS (SELECT run_id, frame, off, atan2(nx * gx + ny * gy, ex * gx + ey * gy) - heading * 0.37 - radians(off) AS d FROM s, f, o WHERE gx <> 0 AND gy <> 0), w AS (SELECT run_id, frame, CAST(off AS DOUBLE) AS offset_deg, stddev_pop(" + _WRAP.format(x="d") + ") AS std FROM c GROUP BY run_id, frame, off) SELECT run_id, frame, offset_deg, round(std, 4) AS std FROM w")
def a28(spark, sf):
    rows = samples(spark, sf).filter("gx <> 0 and gy <> 0").withColumn("h", F.col("heading") * 0.37)
    c = stats.frame_candidates(rows, ["run_id"], "gx", "gy", "h")
    return c.select("run_id", "frame", F.col("offset").alias("offset_deg"), F.round("std", 4).alias("std"))


@register("a29_flag_rates", SQL + " SELECT src, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS valid_rate, round(quantile_cont(value, 0.5) FILTER (WHERE gate_ok) - quantile_cont(value, 0.5), 6) AS gated_delta, round(quantile_cont(value, 0.95), 6) AS p95 FROM s GROUP BY src")
def a29(spark, sf):
    v = F.col("value")
    return _r(samples(spark, sf).groupBy("src").agg(F.avg(col.audit_flag(F.col("valid"))).alias("valid_rate"), (stats.quantile(F.when(F.col("gate_ok"), v), 0.5) - stats.quantile(v, 0.5)).alias("gated_delta"), stats.quantile(v, 0.95).alias("p95")))


@register("a30_tilt_error", SQL + " SELECT run_id, round(degrees(asin(least(1.0, sqrt(pow(avg(ax * 9.78), 2) + pow(avg(ay * 9.78), 2)) / 9.78))), 6) AS tilt_deg FROM s GROUP BY run_id")
def a30(spark, sf):
    return _r(samples(spark, sf).groupBy("run_id").agg(stats.tilt_error_deg(F.col("ax") * geo.GRAVITY, F.col("ay") * geo.GRAVITY).alias("tilt_deg")))


@register("a37_timing_quality", SQL + ", o AS (SELECT *, max(t_s) OVER (PARTITION BY run_id ORDER BY value, _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s) SELECT run_id, count(*) FILTER (WHERE t_s < newest) AS out_of_order, count(*) FILTER (WHERE t_s = newest) AS duplicates, count(*) FILTER (WHERE newest - t_s > 3600 * 100.0) AS stale FROM o GROUP BY run_id")
def a37(spark, sf):
    earlier = W.partitionBy("run_id").orderBy("value", "_row").rowsBetween(W.unboundedPreceding, -1)
    rows = samples(spark, sf).withColumn("newest", F.max("t_s").over(earlier))
    return rows.groupBy("run_id").agg(F.count_if(col.below(F.col("t_s"), F.col("newest"))).alias("out_of_order"), F.count_if(F.coalesce(F.col("t_s") == F.col("newest"), F.lit(False))).alias("duplicates"), F.count_if(col.above(F.col("newest") - F.col("t_s"), 100 * HOUR)).alias("stale"))


@register("a38_run_summary", _D + " SELECT run_id, count(*) AS n, round(min(t_s), 3) AS t0, round(max(t_s), 3) AS t1, round(min(dt), 6) AS dt_min, round(quantile_cont(dt, 0.5), 6) AS dt_med, round(max(dt), 6) AS dt_max FROM d GROUP BY run_id")
def a38(spark, sf):
    rows = samples(spark, sf).withColumn("dt", ts.step(F.col("t_s")))
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.min("t_s"), 3).alias("t0"), F.round(F.max("t_s"), 3).alias("t1"), F.round(F.min("dt"), 6).alias("dt_min"), F.round(stats.quantile(F.col("dt"), 0.5), 6).alias("dt_med"), F.round(F.max("dt"), 6).alias("dt_max"))


@register("a39_a41_gravity_residual", SQL + ", f AS (SELECT *, ay * 9.78 + 9.78 * sin(pitch) AS fx, ax * 9.78 - 9.78 * sin(roll) * cos(pitch) AS fy FROM s) SELECT run_id, round(avg(fx), 6) AS mean_x, round(avg(fy), 6) AS mean_y, round(sqrt(avg(fx * fx + fy * fy)), 6) AS rms, round(0.5 * avg(fx) * pow((max(t_s) - min(t_s)) / 1e6, 2), 6) AS drift_x FROM f GROUP BY run_id")
def a39(spark, sf):
    g = geo.gravity_in_body(F.col("roll"), F.col("pitch"))
    rows = samples(spark, sf).withColumns({"fx": F.col("ay") * geo.GRAVITY + g[0], "fy": F.col("ax") * geo.GRAVITY + g[1]})
    drift = 0.5 * F.avg("fx") * F.pow((F.max("t_s") - F.min("t_s")) / 1e6, 2)
    return _r(rows.groupBy("run_id").agg(F.avg("fx").alias("mean_x"), F.avg("fy").alias("mean_y"), F.sqrt(F.avg(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))).alias("rms"), drift.alias("drift_x")))


@register("a42_time_spans", SQL + ", g AS (SELECT run_id, min(t_s) FILTER (WHERE src = 'IMU') AS i0, min(t_s) FILTER (WHERE src = 'BE') AS b0, max(t_s) FILTER (WHERE src = 'IMU') AS i1, max(t_s) FILTER (WHERE src = 'BE') AS b1 FROM s GROUP BY run_id) SELECT run_id, round(b0 - i0, 6) AS start_offset, round(b1 - i1, 6) AS end_offset FROM g")
def a42(spark, sf):
    at = lambda f, s: f(F.when(F.col("src") == s, F.col("t_s")))
    return _r(samples(spark, sf).groupBy("run_id").agg((at(F.min, "BE") - at(F.min, "IMU")).alias("start_offset"), (at(F.max, "BE") - at(F.max, "IMU")).alias("end_offset")))


@register("a43_a44_quantile_report", SQL + " SELECT run_id, round(max(value), 6) AS max_value, count(*) FILTER (WHERE value > 300) AS triggers, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CASE WHEN value > 200 AND gate_ok THEN 1.0 ELSE 0.0 END), 6) AS share FROM s GROUP BY run_id")
def a43(spark, sf):
    v = F.col("value")
    return _r(samples(spark, sf).groupBy("run_id").agg(F.max(v).alias("max_value"), F.count_if(v > 300).alias("triggers"), stats.quantile(v, 0.5).alias("p50"), stats.quantile(v, 0.9).alias("p90"), stats.share_above(F.when(F.col("gate_ok"), v), 200).alias("share")))


# --- geometry ----------------------------------------------------------------------------------


#: Angles are compared by sine and cosine: a half turn may come out on either side.
_TURN = lambda x, n: f"round(sin({x}), 6) + 0.0 AS {n}_sin, round(cos({x}), 6) + 0.0 AS {n}_cos"


def _turn(x, name):
    return [(F.round(F.sin(x), 6) + 0.0).alias(f"{name}_sin"), (F.round(F.cos(x), 6) + 0.0).alias(f"{name}_cos")]


@register("m01_m02_angles", SQL + f" SELECT _row, {_TURN('heading * 1.7', 'pi')}, {_TURN('heading * 1.7', 'half')}, {_TURN('heading * -1.3', 'full')}, true AS inside FROM s")
def m01(spark, sf):
    h, pi = F.col("heading"), 3.141592653589793
    a, b, c = geo.wrap_pi(h * 1.7), geo.wrap_180(F.degrees(h) * 1.7), geo.wrap_2pi(h * -1.3)
    inside = (a >= -pi) & (a < pi) & (b >= -180) & (b < 180) & (c >= 0) & (c <= 2 * pi)
    return samples(spark, sf).select("_row", *_turn(a, "pi"), *_turn(F.radians(b), "half"), *_turn(c, "full"), inside.alias("inside"))


@register("m03_auto_deg_to_rad", SQL + ", d AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN k * 3.6 ELSE heading END AS x FROM s), q AS (SELECT run_id, count(*) >= 10 AND quantile_cont(abs(x), 0.95) > 2.4 * pi() AS deg FROM d GROUP BY run_id) SELECT _row, round(CASE WHEN deg THEN radians(x) ELSE x END, 6) AS rad FROM d JOIN q USING (run_id)")
def m03(spark, sf):
    rows = samples(spark, sf).withColumn("x", F.when(F.col("run_id") % 2 == 0, F.col("k") * 3.6).otherwise(F.col("heading")))
    run = W.partitionBy("run_id")
    degrees = (F.count("x").over(run) >= 10) & (stats.quantile(F.abs("x"), 0.95).over(run) > 2.4 * 3.141592653589793)
    return rows.select("_row", F.round(F.when(degrees, F.radians("x")).otherwise(F.col("x")), 6).alias("rad"))


@register("m04_m07_rotation", SQL + f" SELECT _row, round(sqrt(ax * ax + ay * ay + az * az), 6) AS norm3, round(roll, 6) + 0.0 AS roll_, round(pitch, 6) + 0.0 AS pitch_, {_TURN('yaw', 'yaw')}, round(ay, 6) AS body_x FROM s")
def m04(spark, sf):
    rows = samples(spark, sf)
    roll, pitch, yaw = geo.angles_of(geo.rotation(F.col("roll"), F.col("pitch"), F.col("yaw")))
    body = geo.axis_map((F.col("ax"), F.col("ay"), F.col("az")), "rfu_to_frd")
    return rows.select("_row", F.round(geo.norm(F.col("ax"), F.col("ay"), F.col("az")), 6).alias("norm3"), (F.round(roll, 6) + 0.0).alias("roll_"), (F.round(pitch, 6) + 0.0).alias("pitch_"), *_turn(yaw, "yaw"), F.round(body[0], 6).alias("body_x"))


@register("m08_m09_gravity", SQL + " SELECT _row, round(ax * 9.78 + 9.78 * sin(pitch) - 0.1, 6) AS lin_x, round(-9.78 * cos(roll) * cos(pitch), 6) AS grav_z FROM s")
def m08(spark, sf):
    force = tuple(F.col(c) * geo.GRAVITY for c in ("ax", "ay", "az"))
    lin = geo.linear_acceleration(force, F.col("roll"), F.col("pitch"), (F.lit(0.1), F.lit(0.0), F.lit(0.0)))
    return samples(spark, sf).select("_row", F.round(lin[0], 6).alias("lin_x"), F.round(geo.gravity_in_body(F.col("roll"), F.col("pitch"))[2], 6).alias("grav_z"))


@register("m10_m12_quaternions", SQL + " SELECT _row, round(cos(yaw) * vE - sin(yaw) * vN, 6) AS x, round(sin(yaw) * vE + cos(yaw) * vN, 6) AS y, round(vU, 6) AS z FROM s")
def m10(spark, sf):
    q = geo.quaternion_unit(geo.quaternion_of_turn((F.lit(0.0), F.lit(0.0), F.col("yaw"))))
    x, y, z = geo.quaternion_rotate(q, (F.col("vE"), F.col("vN"), F.col("vU")))
    return samples(spark, sf).select("_row", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@register("m11_m14_course_sigma", SQL + f" SELECT _row, {_TURN('atan2(vN, vE)', 'course')}, round(1.5 * sqrt(pow(0.02 * sqrt(vE * vE + vN * vN), 2) + 0.01 * 0.01), 6) AS sigma FROM s")
def m11(spark, sf):
    speed = geo.norm(F.col("vE"), F.col("vN"))
    return samples(spark, sf).select("_row", *_turn(geo.course(F.col("vE"), F.col("vN")), "course"), F.round(geo.speed_sigma(speed, 0.02, 0.01, 1.5), 6).alias("sigma"))


@register("m13_confidence_label", SQL + " SELECT _row, CASE WHEN value >= 400 THEN 'high' WHEN value >= 200 THEN 'medium' WHEN value > 50 THEN 'low' ELSE 'none' END AS label FROM s")
def m13(spark, sf):
    v = F.col("value")
    return samples(spark, sf).select("_row", col.first_reason([("high", v >= 400), ("medium", v >= 200), ("low", v > 50)], "none").alias("label"))


# --- sort, limit, sets -------------------------------------------------------------------------


@register("t01_stable_time_sort", SQL + f" SELECT run_id, _row, row_number() OVER ({OVER}) AS place FROM s")
def t01(spark, sf):
    return samples(spark, sf).select("run_id", "_row", F.row_number().over(ts.run()).cast("long").alias("place"))


@register("t03_topk_nis", SQL + " SELECT run_id, _row, value FROM s ORDER BY value DESC, _row LIMIT 25")
def t03(spark, sf):
    return samples(spark, sf).select("run_id", "_row", col.to_number(F.col("value").cast("string")).alias("value")).orderBy(F.desc("value"), "_row").limit(25)


@register("t04_topk_reports", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 50")
def t04(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(50)


@register("t06_s16_latest_row", SQL + " SELECT run_id, max_by(_row, struct_pack(t := t_s, r := _row)) AS _row, max_by(value, struct_pack(t := t_s, r := _row)) AS value FROM s GROUP BY run_id")
def t06(spark, sf):
    last = F.max_by(F.struct("_row", "value"), F.struct("t_s", "_row"))
    return samples(spark, sf).groupBy("run_id").agg(last.alias("x")).select("run_id", "x._row", "x.value")


@register("u01_concat_all", SQL + " SELECT run_id, _row, vE AS v, NULL::DOUBLE AS body FROM s WHERE src = 'BE' UNION ALL SELECT run_id, _row, NULL, vE FROM s WHERE src = 'BI'")
def u01(spark, sf):
    a = samples(spark, sf, "BE").select("run_id", "_row", F.col("vE").alias("v"))
    return a.unionByName(samples(spark, sf, "BI").select("run_id", "_row", F.col("vE").alias("body")), allowMissingColumns=True)


@register("u03_s08_dedup_first", SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY run_id, floor(t_s / 36000) ORDER BY _row) AS i FROM s) SELECT run_id, _row FROM n WHERE i = 1")
def u03(spark, sf):
    first = F.row_number().over(W.partitionBy("run_id", F.floor(F.col("t_s") / 36000)).orderBy("_row"))
    return samples(spark, sf).withColumn("i", first).filter("i = 1").select("run_id", "_row")


@register("u04_ordered_unique", SQL + ", m AS (SELECT run_id, k, min(_row) AS first_row FROM s GROUP BY run_id, k) SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY first_row) AS place FROM m")
def u04(spark, sf):
    seen = samples(spark, sf).groupBy("run_id", "k").agg(F.min("_row").alias("first_row"))
    return seen.select("run_id", "k", F.row_number().over(W.partitionBy("run_id").orderBy("first_row")).cast("long").alias("place"))


@register("u05_evidence_union", SQL + " SELECT _row, array_to_string(list_distinct_ordered, ',') AS evidence FROM (SELECT _row, CASE WHEN k % 3 = k % 2 THEN [CAST(k % 3 AS VARCHAR)] ELSE [CAST(k % 3 AS VARCHAR), CAST(k % 2 AS VARCHAR)] END AS list_distinct_ordered FROM s)")
def u05(spark, sf):
    a, b = (F.array((F.col("k") % n).cast("string")) for n in (3, 2))
    return samples(spark, sf).select("_row", F.array_join(F.array_distinct(F.concat(a, b)), ",").alias("evidence"))


@register("a46_flag_source_rates", SQL + """, g AS (SELECT *, 'r' || (k % 3) AS reason, abs(value / 245) AS v, min(t_s) OVER (PARTITION BY run_id, src) AS t0 FROM s WHERE src <> 'IMU'),
  r AS (SELECT run_id, src, reason, count(*) AS n, row_number() OVER (PARTITION BY run_id, src ORDER BY count(*) DESC, reason) AS i FROM g WHERE NOT gate_ok GROUP BY run_id, src, reason),
  b AS (SELECT run_id, src, string_agg(reason || ':' || n, ',' ORDER BY i) AS reasons FROM r WHERE i <= 2 GROUP BY run_id, src),
  m AS (SELECT run_id, src, count(*) AS n, count(*) FILTER (WHERE gate_ok) AS n_ok, quantile_cont(v, 0.95) FILTER (WHERE t_s - t0 <= 360000) AS p FROM g GROUP BY run_id, src)
  SELECT run_id, src, n, n_ok, round(n_ok / n, 6) AS ok_rate, coalesce(reasons, '') AS reasons, round(p, 6) AS static_p95, p > 0.5 AS warn FROM m LEFT JOIN b USING (run_id, src)""")
def a46(spark, sf):
    rows = samples(spark, sf, "BE", "BI").withColumns({"gate_reason": F.concat(F.lit("r"), (F.col("k") % 3).cast("string")), "speed": F.col("value") / 245})
    out = stats.flag_source_rates(rows, ["run_id", "src"], static_s=100 * HOUR, most_speed=0.5, top=2)
    return out.select("run_id", "src", "n", "n_ok", F.round("ok_rate", 6).alias("ok_rate"), F.array_join("reasons", ",").alias("reasons"), F.round("static_p95", 6).alias("static_p95"), "warn")
