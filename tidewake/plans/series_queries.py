"""Queries over the sensor view of events: gates, windows, alignment, dead reckoning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import columns as col
from tidewake.functions import geometry as geo
from tidewake.operators import asof, deadreckon, gates
from tidewake.operators import timeseries as ts
from tidewake.plans.catalogue import register
from tidewake.plans.samples import HOUR, SQL, rounded, samples

LIMITS = gates.GateLimits(dv_axis=1.5, dv_horizontal=1.8, vu_abs=0.25, outlier_z=1.6, outlier_window=15, speed_min=0.05, speed_max=1.95, keep_static_s=24 * HOUR)
OVER = "PARTITION BY run_id ORDER BY t_s, _row"


@register("p01_src_split", SQL + " SELECT run_id, _row, src FROM s WHERE src IN ('BI', 'BE')")
def p01(spark, sf):
    rows = samples(spark, sf).withColumn("src", F.concat(F.lit(" "), F.lower("src")))
    return gates.by_source(rows, "BI").unionByName(gates.by_source(rows, "BE")).select("run_id", "_row", gates.normalised_source(F.col("src")).alias("src"))


@register("p03_time_window", SQL + ", b AS (SELECT run_id, min(t_s) AS t0 FROM s GROUP BY run_id) SELECT s.run_id, _row FROM s JOIN b USING (run_id) WHERE t_s BETWEEN t0 + 100 * 3600.0 AND t0 + 300 * 3600.0")
def p03(spark, sf):
    return samples(spark, sf).withColumn("rel", ts.relative_time()).filter(F.col("rel").between(100 * HOUR, 300 * HOUR)).select("run_id", "_row")


@register("p04_static_window", SQL + ", b AS (SELECT run_id, min(t_s) AS t0 FROM s GROUP BY run_id) SELECT s.run_id, _row, t_s <= t0 + 24 * 3600.0 AS static FROM s JOIN b USING (run_id)")
def p04(spark, sf):
    return samples(spark, sf).select("run_id", "_row", ts.static_window(24 * HOUR).alias("static"))


GATED = f"""{SQL}, v AS (SELECT *, sqrt(vE * vE + vN * vN + vU * vU) AS speed,
    row_number() OVER ({OVER}) AS rn, count(*) OVER (PARTITION BY run_id) AS n_rows, min(t_s) OVER (PARTITION BY run_id) AS t0,
    abs(vE - lag(vE) OVER ({OVER})) AS de, abs(vN - lag(vN) OVER ({OVER})) AS dn, abs(vU - lag(vU) OVER ({OVER})) AS du FROM s WHERE src = 'BE'),
  m AS (SELECT *, CASE WHEN count(speed) OVER w >= 5 THEN quantile_cont(speed, 0.5) OVER w END AS med FROM v WINDOW w AS ({OVER} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
  d AS (SELECT *, abs(speed - med) AS dev FROM m),
  z AS (SELECT *, CASE WHEN count(dev) OVER w >= 5 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM d WINDOW w AS ({OVER} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
  f AS (SELECT *, NOT valid AS f1, water_mass AS f2, rn > 1 AND (greatest(de, dn, du) > 1.5 OR sqrt(de * de + dn * dn) > 1.8) AS f3,
        rn > 1 AND abs(vU) > 0.25 AS f4, n_rows >= 15 AND mad > 1e-9 AND dev / (1.4826 * mad) > 1.6 AS f5, speed < 0.05 OR speed > 1.95 AS f6 FROM z),
  g AS (SELECT *, CASE WHEN t_s <= t0 + 24 * 3600.0 THEN '' ELSE concat_ws(';', CASE WHEN f1 THEN 'valid' END, CASE WHEN f2 THEN 'water_mass' END, CASE WHEN f3 THEN 'dv_jump' END,
        CASE WHEN f4 THEN 'vu_abs' END, CASE WHEN f5 THEN 'outlier' END, CASE WHEN f6 THEN 'speed_range' END) END AS gate_reasons FROM f)"""


@register("p05_p11_gate_reasons", GATED + " SELECT run_id, _row, gate_reasons, gate_reasons = '' AS gate_pass FROM g")
def p11(spark, sf):
    return gates.gated(samples(spark, sf, "BE"), LIMITS).select("run_id", "_row", "gate_reasons", "gate_pass")


@register("p06_gate_dv_jump", GATED + " SELECT run_id, _row, coalesce(f3, false) AS jump FROM g")
def p06(spark, sf):
    return samples(spark, sf, "BE").select("run_id", "_row", gates.jump_gate(LIMITS).alias("jump"))


@register("p07_gate_vu_abs", GATED + " SELECT run_id, _row, f4 AS steep FROM g")
def p07(spark, sf):
    return samples(spark, sf, "BE").select("run_id", "_row", gates.vertical_gate(LIMITS).alias("steep"))


@register("p08_gate_robust_outlier", GATED + " SELECT run_id, _row, coalesce(f5, false) AS outlier FROM g")
def p08(spark, sf):
    rows = samples(spark, sf, "BE").withColumn("speed", geo.norm(F.col("vE"), F.col("vN"), F.col("vU")))
    return gates.outlier_gate(rows, "speed", LIMITS).select("run_id", "_row", "outlier")


@register("p09_gate_speed_range", GATED + " SELECT run_id, _row, f6 AS out_of_range FROM g")
def p09(spark, sf):
    return samples(spark, sf, "BE").select("run_id", "_row", gates.speed_gate(geo.norm(F.col("vE"), F.col("vN"), F.col("vU")), LIMITS).alias("out_of_range"))


@register("e20_dvl_preprocess", GATED + f""", k AS (SELECT *, sum(vE) OVER w / 5 AS a, sum(vN) OVER w / 5 AS b, sum(vU) OVER w / 5 AS c FROM g WHERE gate_reasons = '' WINDOW w AS ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT run_id, _row, round(a, 6) AS vE_f, round(b, 6) AS vN_f, round(c, 6) AS vU_f, round(sqrt(a * a + b * b + c * c), 6) AS speed_f FROM k""")
def e20(spark, sf):
    return rounded(gates.preprocessed_velocity(samples(spark, sf, "BE"), LIMITS), "run_id", "_row", "vE_f", "vN_f", "vU_f", "speed_f")


@register("p12_dvl_select", SQL + ", c AS (SELECT *, coalesce(bool_or(src = 'BI') OVER (PARTITION BY run_id), false) AS has FROM s WHERE gate_ok) SELECT run_id, _row, src FROM c WHERE src = CASE WHEN has THEN 'BI' ELSE 'BE' END")
def p12(spark, sf):
    return gates.selected(samples(spark, sf), "AUTO").select("run_id", "_row", "src")


@register("p13_quality_mask", SQL + " SELECT run_id, _row FROM s WHERE gate_ok AND valid")
def p13(spark, sf):
    rows = samples(spark, sf)
    flags = [F.col(c).cast("double") > 0.5 for c in ("gate_ok", "speed_ok", "valid") if c in rows.columns]
    return rows.filter(col.all_of(flags)).select("run_id", "_row")


@register("p14_audit_filter", SQL + " SELECT run_id, _row FROM s WHERE src = 'BE' AND gate_ok AND sqrt(vE * vE + vN * vN) BETWEEN 0.1 AND 1.5")
def p14(spark, sf):
    speed = geo.norm(F.col("vE"), F.col("vN"))
    return gates.by_source(samples(spark, sf), "BE").filter((F.col("gate_ok").cast("double") > 0.5) & speed.between(0.1, 1.5)).select("run_id", "_row")


@register("p15_p16_deadband_clip", SQL + " SELECT run_id, _row, CASE WHEN abs(ax) < 0.025 THEN 0.0 ELSE ax END AS ax_dead, greatest(-0.03, least(0.03, CASE WHEN abs(ay) < 0.015 THEN 0.0 ELSE ay END)) AS ay_clip FROM s")
def p15(spark, sf):
    return samples(spark, sf).select("run_id", "_row", col.deadband(F.col("ax"), 0.025).alias("ax_dead"), col.clip(col.deadband(F.col("ay"), 0.015), -0.03, 0.03).alias("ay_clip"))


@register("p17_minimal_columns", SQL + " SELECT t_s, run_id, k FROM s WHERE src = 'BI'")
def p17(spark, sf):
    rows = samples(spark, sf, "BI")
    names = [col.resolve(rows, c) for c in (("t_s", "EstS"), ("run_id", "SensorID"), ("id", "k"))]
    return rows.select(*names)


@register("p18_finite_filter", SQL + " SELECT run_id, _row FROM s WHERE NOT (src = 'BE' AND k % 7 = 0) AND k % 9 <> 0")
def p18(spark, sf):
    rows = samples(spark, sf)
    east = F.when((F.col("src") == "BE") & (F.col("k") % 7 == 0), float("nan")).otherwise(F.col("vE"))
    north = F.when(F.col("k") % 9 == 0, float("inf")).otherwise(F.col("vN"))
    return rows.withColumns({"vE": east, "vN": north}).filter(col.all_of([col.finite(F.col(c)).isNotNull() for c in ("t_s", "vE", "vN", "vU")])).select("run_id", "_row")


@register("p19_p20_flip_depth", SQL + " SELECT run_id, _row, round(-vN, 6) AS vN, round(-vU, 6) AS depth FROM s")
def p19(spark, sf):
    return rounded(samples(spark, sf).withColumns({"vN": -F.col("vN"), "depth": -F.col("vU")}), "run_id", "_row", "vN", "depth")


@register("p21_anomaly_union", SQL + " SELECT run_id, _row FROM s WHERE gate_ok AND (abs(gx) > 1.9 OR abs(gy) > 1.9 OR abs(gz) > 2.6 OR abs(ax) > 0.045 OR vE > 1.8 OR vN > 1.8)")
def p21(spark, sf):
    limits = {"gx": 1.9, "gy": 1.9, "gz": 2.6, "ax": 0.045}
    masks = [col.above(F.abs(F.col(c)), v) for c, v in limits.items()] + [col.above(F.col(c), 1.8) for c in ("vE", "vN")]
    return samples(spark, sf).filter(col.any_of(masks) & F.col("gate_ok")).select("run_id", "_row")


@register("p23_attitude_fallback", SQL + " SELECT run_id, _row, round(CASE WHEN k % 3 = 0 THEN roll WHEN k % 3 = 1 THEN radians(k % 10) ELSE 0.0 END, 6) AS roll FROM s")
def p23(spark, sf):
    rows = samples(spark, sf)
    matched, angle = F.when(F.col("k") % 3 == 0, F.col("roll")), F.when(F.col("k") % 3 == 1, F.radians(F.col("k") % 10))
    return rounded(rows.withColumn("roll", F.coalesce(matched, angle, F.lit(0.0))), "run_id", "_row", "roll")


@register("p24_yaw_precedence", SQL + " SELECT run_id, _row, round(CASE WHEN k % 4 = 0 THEN radians(k) WHEN k % 4 = 1 THEN yaw ELSE 0.0 END, 6) AS yaw FROM s")
def p24(spark, sf):
    first = F.when(F.col("k") % 4 == 1, F.col("yaw")).otherwise(float("nan"))
    degrees = F.when(F.col("k") % 4 == 0, F.col("k").cast("double"))
    return rounded(samples(spark, sf).withColumn("yaw", F.coalesce(col.finite(first), F.radians(degrees), F.lit(0.0))), "run_id", "_row", "yaw")


_UNWRAP = """, d{n} AS (SELECT *, {c} - lag({c}) OVER (""" + OVER + """) AS d FROM {t}),
  w{n} AS (SELECT *, d + pi() - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi() AS dm FROM d{n}),
  x{n} AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < pi() THEN 0.0 ELSE CASE WHEN dm = -pi() AND d > 0 THEN pi() ELSE dm END - d END AS fix FROM w{n}),
  u{n} AS (SELECT *, {c} + sum(fix) OVER (""" + OVER + """ ROWS UNBOUNDED PRECEDING) AS un FROM x{n})"""


@register("p25_yaw_candidates", SQL + """, c AS (SELECT run_id, _row, 'heading' AS name, heading AS rad FROM s UNION ALL SELECT run_id, _row, 'yaw', yaw FROM s UNION ALL SELECT run_id, _row, 'half', yaw / 2 FROM s)
  SELECT run_id, _row, name, round(sin(rad), 6) + 0.0 AS sine, round(cos(rad), 6) + 0.0 AS cosine, true AS inside FROM c""")
def p25(spark, sf):
    """By sine and cosine, as a half turn may come out on either side."""
    rows = samples(spark, sf).withColumn("half", F.col("yaw") / 2).unpivot(["run_id", "_row", "t_s"], ["heading", "yaw", "half"], "name", "rad")
    wrapped = geo.wrap_pi(F.col("unwrapped"))
    rows = ts.unwrap(rows, "rad", "unwrapped", "name").withColumn("wrapped", wrapped)
    return rows.select("run_id", "_row", "name", (F.round(F.sin("wrapped"), 6) + 0.0).alias("sine"), (F.round(F.cos("wrapped"), 6) + 0.0).alias("cosine"), F.col("wrapped").between(-3.141592653589794, 3.141592653589794).alias("inside"))


@register("w01_diff_lag", SQL + f" SELECT run_id, _row, round(t_s - lag(t_s) OVER ({OVER}), 6) AS dt, round(vE - lag(vE) OVER ({OVER}), 6) AS dv FROM s")
def w01(spark, sf):
    return rounded(samples(spark, sf).withColumns({"dt": ts.step(F.col("t_s")), "dv": ts.step(F.col("vE"))}), "run_id", "_row", "dt", "dv")


@register("w02_moving_average_same", SQL + f" SELECT run_id, _row, round(sum(value) OVER ({OVER} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6, 6) AS even, round(sum(value) OVER ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS odd FROM s")
def w02(spark, sf):
    return rounded(samples(spark, sf).withColumns({"even": ts.moving_average_same(F.col("value"), 6), "odd": ts.moving_average_same(F.col("value"), 5)}), "run_id", "_row", "even", "odd")


@register("w03_rolling_mean_centered", SQL + f" SELECT run_id, _row, round(avg(value) OVER ({OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM s")
def w03(spark, sf):
    return rounded(samples(spark, sf).withColumn("mean", ts.rolling_mean(F.col("value"), 6)), "run_id", "_row", "mean")


@register("w04_rolling_median_mad", SQL + f""", m AS (SELECT *, CASE WHEN count(value) OVER w >= 3 THEN quantile_cont(value, 0.5) OVER w END AS med FROM s WINDOW w AS ({OVER} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
  SELECT run_id, _row, round(med, 6) AS median, round(CASE WHEN count(abs(value - med)) OVER w >= 3 THEN quantile_cont(abs(value - med), 0.5) OVER w END, 6) AS mad FROM m WINDOW w AS ({OVER} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def w04(spark, sf):
    rows = samples(spark, sf).withColumn("median", ts.rolling_median(F.col("value"), 9))
    return rounded(rows.withColumn("mad", ts.rolling_median(F.abs(F.col("value") - F.col("median")), 9)), "run_id", "_row", "median", "mad")


@register("w05_unwrap", SQL + ", q AS (SELECT *, yaw * 0.97 AS a FROM s)" + _UNWRAP.format(n="", c="a", t="q") + " SELECT run_id, _row, round(un, 6) AS unwrapped FROM u")
def w05(spark, sf):
    return rounded(ts.unwrap(samples(spark, sf).withColumn("a", F.col("yaw") * 0.97), "a", "unwrapped"), "run_id", "_row", "unwrapped")


@register("w07_cumtrapz", SQL + f""", p AS (SELECT *, coalesce((vE + lag(vE) OVER ({OVER})) / 2 * (t_s - lag(t_s) OVER ({OVER})), 0.0) AS part FROM s)
  SELECT run_id, _row, round(sum(part) OVER ({OVER} ROWS UNBOUNDED PRECEDING), 3) AS area FROM p""")
def w07(spark, sf):
    rows = samples(spark, sf).withColumn("part", ts.trapezoid(F.col("vE")))
    return rounded(rows.withColumn("area", ts.running_sum(F.col("part"))), "run_id", "_row", "area", digits=3)


@register("w08_hold_last", SQL + f" SELECT run_id, _row, round(last_value(CASE WHEN value > 200 THEN heading END IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS held FROM s")
def w08(spark, sf):
    return rounded(samples(spark, sf).withColumn("held", ts.hold_last(F.col("heading"), F.col("value") > 200)), "run_id", "_row", "held")


@register("w09_relative_time", SQL + " SELECT run_id, _row, round(t_s - min(t_s) OVER (PARTITION BY run_id), 6) AS rel FROM s")
def w09(spark, sf):
    return rounded(samples(spark, sf).withColumn("rel", ts.relative_time()), "run_id", "_row", "rel")


@register("w10_stride", SQL + f", n AS (SELECT *, row_number() OVER ({OVER}) - 1 AS i FROM s) SELECT run_id, _row FROM n WHERE i % 5 = 0 AND i < 40")
def w10(spark, sf):
    return ts.stride(samples(spark, sf), 5, 8).select("run_id", "_row")


@register("w11_linspace_downsample", SQL + f""", n AS (SELECT *, row_number() OVER ({OVER}) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM s),
  j AS (SELECT DISTINCT run_id, CAST(j.r * (n - 1) // 19 AS BIGINT) AS i FROM n, range(20) AS j(r))
  SELECT n.run_id, _row FROM n WHERE n.n <= 20 UNION ALL SELECT n.run_id, _row FROM n JOIN j ON n.run_id = j.run_id AND n.i = j.i WHERE n.n > 20""")
def w11(spark, sf):
    return ts.downsample(samples(spark, sf), 20).select("run_id", "_row")


@register("w12_tail_window", SQL + " SELECT run_id, _row, count(*) OVER (PARTITION BY run_id ORDER BY CAST(round(t_s * 1e6) AS BIGINT) RANGE BETWEEN 360000000000 PRECEDING AND CURRENT ROW) AS n FROM s")
def w12(spark, sf):
    rows = samples(spark, sf)
    return rows.select("run_id", "_row", ts.tail_window(100 * HOUR).alias("n"))


@register("w13_heading_from_velocity", SQL + ", q AS (SELECT *, atan2(vN, vE) * 0.97 AS h FROM s)" + _UNWRAP.format(n="", c="h", t="q") + " SELECT run_id, _row, round(degrees(un), 5) AS heading_deg FROM u")
def w13(spark, sf):
    rows = samples(spark, sf).withColumn("h", geo.course(F.col("vE"), F.col("vN")) * 0.97)
    return rounded(ts.unwrap(rows, "h", "un").withColumn("heading_deg", F.degrees("un")), "run_id", "_row", "heading_deg", digits=5)


@register("w14_record_policy", SQL + f", n AS (SELECT *, row_number() OVER ({OVER}) AS i FROM s) SELECT run_id, _row FROM n WHERE i % 10 = 0 OR value > 450")
def w14(spark, sf):
    return samples(spark, sf).withColumn("i", F.row_number().over(ts.run())).filter((F.col("i") % 10 == 0) | (F.col("value") > 450)).select("run_id", "_row")


# --- alignment ---------------------------------------------------------------------------------

_SIDES = SQL + ", l AS (SELECT * FROM s WHERE src <> 'IMU'), r AS (SELECT run_id, t_s, _row, value, heading FROM s WHERE src = 'IMU')"
_NEAR = _SIDES + """, f AS (SELECT l.run_id, l._row, l.t_s, r.t_s AS aft, r._row AS ar, r.value AS av FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t_s <= r.t_s),
  n AS (SELECT f.*, r.t_s AS bt, r._row AS br, r.value AS bv FROM f ASOF LEFT JOIN r ON f.run_id = r.run_id AND f.t_s >= r.t_s)"""


def _sides(spark, sf):
    return samples(spark, sf, "BE", "BI").select("run_id", "t_s", "_row"), samples(spark, sf, "IMU")


@register("j01_asof_forward", _NEAR + " SELECT run_id, _row, ar AS match_row, round(aft - t_s, 6) AS gap FROM n")
def j01(spark, sf):
    left, right = _sides(spark, sf)
    return rounded(asof.forward(left, right, ["value"]).withColumn("gap", F.col("match_t_s") - F.col("t_s")), "run_id", "_row", "match_row", "gap")


@register("j02_asof_nearest_later", _NEAR + " SELECT run_id, _row, CASE WHEN aft IS NULL THEN br WHEN bt IS NULL OR aft - t_s <= t_s - bt THEN ar ELSE br END AS match_row FROM n")
def j02(spark, sf):
    return asof.nearest(*_sides(spark, sf), ["value"], tie="later").select("run_id", "_row", "match_row")


@register("j03_j05_asof_nearest_earlier", _NEAR + " SELECT run_id, _row, CASE WHEN aft IS NULL THEN br WHEN bt IS NULL OR aft - t_s < t_s - bt THEN ar ELSE br END AS match_row FROM n")
def j03(spark, sf):
    return asof.nearest(*_sides(spark, sf), ["value"], tie="earlier").select("run_id", "_row", "match_row")


@register("j04_asof_nearest_tolerance", _NEAR + ", p AS (SELECT *, CASE WHEN aft IS NULL THEN br WHEN bt IS NULL OR aft - t_s <= t_s - bt THEN ar ELSE br END AS m, CASE WHEN aft IS NULL THEN t_s - bt WHEN bt IS NULL OR aft - t_s <= t_s - bt THEN aft - t_s ELSE t_s - bt END AS gap FROM n) SELECT run_id, _row, CASE WHEN gap <= 6 * 3600.0 THEN m END AS match_row FROM p")
def j04(spark, sf):
    return asof.nearest(*_sides(spark, sf), ["value"], tie="later", tolerance=6 * HOUR).select("run_id", "_row", "match_row")


_STATUS = _SIDES + """, t AS (SELECT run_id, min(t_s) AS t0 FROM r GROUP BY run_id),
  f AS (SELECT l.*, r.t_s AS aft, r._row AS anchor FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t_s <= r.t_s),
  o AS (SELECT f.run_id, f._row, f.t_s, f.src, f.anchor, CASE WHEN f.t_s < t0 THEN 'DROP_TOO_OLD' WHEN NOT gate_ok OR NOT valid THEN 'DROP_INVALID'
        WHEN anchor IS NULL OR aft - f.t_s > 6 * 3600.0 THEN 'DROP_OUT_OF_WINDOW' ELSE 'USED_OK' END AS status FROM f LEFT JOIN t USING (run_id))"""


def event_status(spark, sf):
    """First failing reason of each velocity sample against the run's inertial samples."""
    right = samples(spark, sf, "IMU")
    rows = asof.forward(samples(spark, sf, "BE", "BI"), right, [])
    start = right.groupBy("run_id").agg(F.min("t_s").alias("imu_t0"))
    rows = rows.join(start, "run_id", "left")
    reasons = [
        ("DROP_TOO_OLD", col.below(F.col("t_s"), F.col("imu_t0"))),
        ("DROP_INVALID", ~col.timeline_flag(F.col("gate_ok")) | ~col.timeline_flag(F.col("valid"))),
        ("DROP_OUT_OF_WINDOW", F.col("anchor").isNull() | col.above(F.col("match_t_s") - F.col("t_s"), 6 * HOUR)),
    ]
    return rows.withColumnRenamed("match_row", "anchor").withColumn("status", col.first_reason(reasons, "USED_OK"))


@register("j06_j07_event_status", _STATUS + " SELECT run_id, _row, src, anchor, status FROM o")
def j07(spark, sf):
    return event_status(spark, sf).select("run_id", "_row", "src", "anchor", "status")


@register("j08_ordinal_join", SQL + """, a AS (SELECT run_id, _row, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) AS j, count(*) OVER (PARTITION BY run_id) AS n FROM s WHERE src = 'BI'),
  b AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) AS j, count(*) OVER (PARTITION BY run_id) AS m FROM s WHERE src = 'BE')
  SELECT a.run_id, a._row, CASE WHEN n = m THEN value END AS paired FROM a LEFT JOIN b ON a.run_id = b.run_id AND a.j = b.j""")
def j08(spark, sf):
    right = samples(spark, sf, "BE").withColumn("paired", F.col("value"))
    return asof.ordinal_join(samples(spark, sf, "BI").select("run_id", "t_s", "_row"), right, ["paired"]).select("run_id", "_row", "paired")


@register("j09_interp_join", _NEAR + " SELECT run_id, _row, round(CASE WHEN aft IS NULL THEN bv WHEN bt IS NULL THEN av WHEN aft > bt THEN bv + (t_s - bt) / (aft - bt) * (av - bv) ELSE bv END, 6) AS interp_value FROM n")
def j09(spark, sf):
    return rounded(asof.interpolated(*_sides(spark, sf), ["value"]), "run_id", "_row", "interp_value")


@register("j10_overlap_window", _SIDES + ", a AS (SELECT run_id, min(t_s) AS a0, max(t_s) AS a1 FROM l GROUP BY run_id), b AS (SELECT run_id, min(t_s) AS b0, max(t_s) AS b1 FROM r GROUP BY run_id) SELECT run_id, round(greatest(a0, b0), 6) AS t0, round(least(a1, b1), 6) AS t1 FROM a JOIN b USING (run_id) WHERE greatest(a0, b0) <= least(a1, b1)")
def j10(spark, sf):
    return rounded(asof.overlap(samples(spark, sf, "BE", "BI"), samples(spark, sf, "IMU")), "run_id", "t0", "t1")


_TIMELINE = _STATUS + """, k AS (SELECT run_id, _row AS anchor, t_s AS kt FROM r)
  , m AS (SELECT run_id, _row, t_s, 'IMU' AS kind, t_s AS kt, _row AS key, 0 AS rank FROM r
        UNION ALL SELECT o.run_id, o._row, o.t_s, src, k.kt, o.anchor, 1 FROM o JOIN k ON o.run_id = k.run_id AND o.anchor = k.anchor WHERE status = 'USED_OK')"""


@register("u02_t02_timeline_merge", _TIMELINE + " SELECT run_id, kind, _row, row_number() OVER (PARTITION BY run_id ORDER BY kt, key, rank, t_s, _row) AS ordinal FROM m")
def u02(spark, sf):
    imu = samples(spark, sf, "IMU").select("run_id", "_row", "t_s", F.lit("IMU").alias("kind"), F.col("t_s").alias("kt"), F.col("_row").alias("key"), F.lit(0).alias("rank"))
    used = event_status(spark, sf).filter("status = 'USED_OK'").select("run_id", "_row", "t_s", F.col("src").alias("kind"), F.col("match_t_s").alias("kt"), F.col("anchor").alias("key"), F.lit(1).alias("rank"))
    ordinal = F.row_number().over(W.partitionBy("run_id").orderBy("kt", "key", "rank", "t_s", "_row"))
    return imu.unionByName(used).select("run_id", "kind", "_row", ordinal.cast("long").alias("ordinal"))


@register("a45_alignment_report", _STATUS + """, i AS (SELECT run_id, min(t_s) AS i0, max(t_s) AS i1, count(*) AS n_imu FROM r GROUP BY run_id),
  d AS (SELECT run_id, min(t_s) AS d0, max(t_s) AS d1, count(*) AS n_dvl, count(*) FILTER (WHERE status = 'USED_OK') AS n_used, min(anchor) FILTER (WHERE status = 'USED_OK' AND t_s = (SELECT min(p.t_s) FROM o p WHERE p.run_id = o.run_id AND p.status = 'USED_OK')) AS k0 FROM o GROUP BY run_id)
  SELECT run_id, n_imu, n_dvl, n_used, k0, round(d0 - i0, 6) AS start_offset, round(d1 - i1, 6) AS end_offset FROM i JOIN d USING (run_id)""")
def a45(spark, sf):
    imu = samples(spark, sf, "IMU").groupBy("run_id").agg(F.min("t_s").alias("i0"), F.max("t_s").alias("i1"), F.count("*").alias("n_imu"))
    used = F.col("status") == "USED_OK"
    dvl = event_status(spark, sf).groupBy("run_id").agg(
        F.min("t_s").alias("d0"), F.max("t_s").alias("d1"), F.count("*").alias("n_dvl"), F.count_if(used).alias("n_used"),
        F.min(F.when(used, F.struct("t_s", "anchor"))).getField("anchor").alias("k0"),
    )
    rows = imu.join(dvl, "run_id").withColumns({"start_offset": F.col("d0") - F.col("i0"), "end_offset": F.col("d1") - F.col("i1")})
    return rounded(rows, "run_id", "n_imu", "n_dvl", "n_used", "k0", "start_offset", "end_offset")


# --- dead reckoning ----------------------------------------------------------------------------

_DT = """, q{n} AS (SELECT *, t_s - lag(t_s) OVER (""" + OVER + """) AS d FROM {t}),
  h{n} AS (SELECT *, (SELECT quantile_cont(z.d, 0.5) FROM q{n} z WHERE z.run_id = q{n}.run_id AND z.d > 0) AS gap_med FROM q{n}),
  t{n} AS (SELECT *, CASE WHEN d > 0 AND (gap_med IS NULL OR d <= {g}) THEN d ELSE 0.0 END AS dt FROM h{n})"""


@register("e01_dt_guard", SQL + _DT.format(n="", t="s", g="3 * gap_med") + " SELECT run_id, _row, round(dt, 6) AS dt FROM t")
def e01(spark, sf):
    return rounded(ts.guarded_dt(samples(spark, sf), HOUR / 1000), "run_id", "_row", "dt")


_DR = _DT.format(n="", t="{t}", g="5 * gap_med") + f""", p AS (SELECT *, sum(vE * dt) OVER w AS E, sum(vN * dt) OVER w AS N, sum(vU * dt) OVER w AS U,
   coalesce(last_value(CASE WHEN sqrt(vE * vE + vN * vN) > 1e-3 THEN atan2(vN, vE) END IGNORE NULLS) OVER w, 0.0) AS yaw_rad FROM t WINDOW w AS ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("e02_dead_reckon_be", SQL + ", b AS (SELECT * FROM s WHERE src = 'BE' AND gate_ok)" + _DR.format(t="b") + " SELECT run_id, _row, round(E, 2) AS E, round(N, 2) AS N, round(U, 2) AS U, round(yaw_rad, 5) AS yaw_rad FROM p")
def e02(spark, sf):
    path = deadreckon.from_earth_velocity(gates.selected(samples(spark, sf), "BE"))
    return path.select("run_id", "_row", *(F.round(c, 2).alias(c) for c in "ENU"), F.round("yaw_rad", 5).alias("yaw_rad"))


@register("dead_reckon_gated_be", GATED + ", b AS (SELECT * FROM g WHERE gate_reasons = '')" + _DR.format(t="b") + " SELECT run_id, round(max_by(E, struct_pack(t_s := t_s, r := _row)), 2) AS E, round(max_by(N, struct_pack(t_s := t_s, r := _row)), 2) AS N, count(*) AS n_used FROM p GROUP BY run_id")
def flagship(spark, sf):
    path = deadreckon.from_earth_velocity(gates.gated(samples(spark, sf, "BE"), LIMITS).filter("gate_pass"))
    last = F.max_by(F.struct("E", "N"), F.struct("t_s", "_row"))
    return path.groupBy("run_id").agg(last.alias("p"), F.count("*").alias("n_used")).select("run_id", F.round("p.E", 2).alias("E"), F.round("p.N", 2).alias("N"), "n_used")


@register("w06_e15_integrate_yaw", SQL + f""", q AS (SELECT *, coalesce(lag(radians(gz) / 3600) OVER ({OVER}), 0.0) * coalesce(t_s - lag(t_s) OVER ({OVER}), 0.0) AS part FROM s),
  c AS (SELECT *, sum(part) OVER ({OVER} ROWS UNBOUNDED PRECEDING) + 3.141592653589793 AS a FROM q) SELECT run_id, _row, round(a - 2 * pi() * floor(a / (2 * pi())) - pi(), 6) AS yaw_int FROM c""")
def e15(spark, sf):
    rows = samples(spark, sf).withColumn("rate", F.radians("gz") / 3600)
    return rounded(deadreckon.integrated(rows, "rate", "yaw_int"), "run_id", "_row", "yaw_int")


_IMU = f"""{SQL}, m AS (SELECT *, ay * 9.78 AS acc_x, ax * 9.78 AS acc_y, -az * 9.78 AS acc_z, radians(gy) AS gr, t_s <= min(t_s) OVER (PARTITION BY run_id) + 24 * 3600.0 AS static FROM s WHERE src = 'IMU'),
  f AS (SELECT *, acc_x + 9.78 * sin(pitch) AS fx, acc_y - 9.78 * sin(roll) * cos(pitch) AS fy, acc_z - 9.78 * cos(roll) * cos(pitch) AS fz FROM m),
  b AS (SELECT *, fx - avg(fx) FILTER (WHERE static) OVER (PARTITION BY run_id) AS lin_x, fy - avg(fy) FILTER (WHERE static) OVER (PARTITION BY run_id) AS lin_y,
        fz - avg(fz) FILTER (WHERE static) OVER (PARTITION BY run_id) AS lin_z, gr - avg(gr) FILTER (WHERE static) OVER (PARTITION BY run_id) AS gyro_x FROM f)"""


def _imu(spark, sf):
    return deadreckon.preprocessed_imu(samples(spark, sf, "IMU"), static_s=24 * HOUR)


@register("e19_imu_preprocess", _IMU + f" SELECT run_id, _row, round(lin_x, 6) AS lin_x, round(lin_y, 6) AS lin_y, round(lin_z, 6) AS lin_z, round(sum(gyro_x) OVER ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS gyro_x_f FROM b")
def e19(spark, sf):
    return rounded(_imu(spark, sf), "run_id", "_row", "lin_x", "lin_y", "lin_z", "gyro_x_f")


_ROT = {
    "E": "cos(yaw) * cos(pitch) * {x} + (cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll)) * {y} + (cos(yaw) * sin(pitch) * cos(roll) + sin(yaw) * sin(roll)) * {z}",
    "N": "sin(yaw) * cos(pitch) * {x} + (sin(yaw) * sin(pitch) * sin(roll) + cos(yaw) * cos(roll)) * {y} + (sin(yaw) * sin(pitch) * cos(roll) - cos(yaw) * sin(roll)) * {z}",
}


@register("e04_dead_reckon_imu", _IMU + _DT.format(n="", t="b", g="5 * gap_med") + f""", a AS (SELECT *, sum(({_ROT["E"].format(x="lin_x", y="lin_y", z="lin_z")}) * dt) OVER w AS speed_e FROM t WINDOW w AS ({OVER} ROWS UNBOUNDED PRECEDING))
  SELECT run_id, _row, round(speed_e, 2) AS v_e, round(sum(speed_e * dt) OVER ({OVER} ROWS UNBOUNDED PRECEDING) / 1e6, 2) AS E FROM a""")
def e04(spark, sf):
    path = deadreckon.from_acceleration(_imu(spark, sf))
    return path.select("run_id", "_row", F.round("v_e", 2).alias("v_e"), F.round(F.col("E") / 1e6, 2).alias("E"))


@register("e03_dead_reckon_imu_dvl", SQL + """, l AS (SELECT run_id, _row, t_s, vE, vN, -vU AS vD FROM s WHERE src = 'BI'), r AS (SELECT run_id, t_s, roll, pitch, yaw FROM s WHERE src = 'IMU'),
  f AS (SELECT l.*, r.t_s AS aft, r.roll AS ar, r.pitch AS ap, r.yaw AS ay FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t_s <= r.t_s),
  n AS (SELECT f.*, r.t_s AS bt, r.roll AS br, r.pitch AS bp, r.yaw AS by_ FROM f ASOF LEFT JOIN r ON f.run_id = r.run_id AND f.t_s >= r.t_s),
  g AS (SELECT *, aft IS NOT NULL AND (bt IS NULL OR aft - t_s < t_s - bt) AS ahead FROM n WHERE aft IS NOT NULL OR bt IS NOT NULL),
  o AS (SELECT *, CASE WHEN ahead THEN ar ELSE br END AS roll, CASE WHEN ahead THEN ap ELSE bp END AS pitch, CASE WHEN ahead THEN ay ELSE by_ END AS yaw FROM g)""" + _DT.format(n="", t="o", g="5 * gap_med") + f"""
  SELECT run_id, _row, round(sum(({_ROT["E"].format(x="vE", y="vN", z="vD")}) * dt) OVER w, 2) AS E, round(sum(({_ROT["N"].format(x="vE", y="vN", z="vD")}) * dt) OVER w, 2) AS N FROM t WINDOW w AS ({OVER} ROWS UNBOUNDED PRECEDING)""")
def e03(spark, sf):
    path = deadreckon.from_body_velocity(samples(spark, sf, "BI"), samples(spark, sf, "IMU"))
    return path.select("run_id", "_row", F.round("E", 2).alias("E"), F.round("N", 2).alias("N"))


@register("e10_traj_postprocess", SQL + ", b AS (SELECT * FROM s WHERE src = 'BE' AND gate_ok)" + _DR.format(t="b") + f" SELECT run_id, _row, round(avg(E) OVER w, 2) AS E, round(avg(-N) OVER w, 2) AS N FROM p WINDOW w AS ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def e10(spark, sf):
    path = deadreckon.from_earth_velocity(gates.selected(samples(spark, sf), "BE")).withColumn("N", -F.col("N"))
    path = path.withColumns({"Es": ts.rolling_mean(F.col("E"), 5), "Ns": ts.rolling_mean(F.col("N"), 5)})
    return path.select("run_id", "_row", F.round("Es", 2).alias("E"), F.round("Ns", 2).alias("N"))
