"""Queries of the recursive estimators over the sensor view of events, with hours read as seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators import deadreckon, estimate, gates, graph
from tidewake.plans.catalogue import register
from tidewake.plans.samples import HOUR, SQL, samples
from tidewake.plans.series_queries import GATED, LIMITS

RECURSIVE = SQL.replace("WITH ", "WITH RECURSIVE ", 1)
WRAPPED = lambda x: f"(({x}) + pi() - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


def _timeline(spark, sf):
    """Samples on a clock of hours; inertial inputs in small SI units."""
    rows = samples(spark, sf).withColumns({"t_s": F.col("t_s") / HOUR, "kind": F.col("src"), "gz": F.radians("gz") / 10})
    return rows.filter(F.col("kind").isin("IMU") | F.col("gate_ok")).select("run_id", "_row", "t_s", "kind", "ax", "ay", "az", "gx", "gy", "gz", "roll", "pitch", "yaw", "vE", "vN", "vU")


@register("e05_e08_inertial_filter")
def e08(spark, sf):
    return estimate.inertial_filter(_timeline(spark, sf), estimate.Noise(most_dt=200.0))


@register("e08_filter_audit", SQL + " SELECT run_id, count(*) FILTER (WHERE src = 'IMU') AS n_imu, count(*) FILTER (WHERE src = 'BE' AND gate_ok) AS n_be, count(*) FILTER (WHERE src = 'BI' AND gate_ok) AS n_bi FROM s GROUP BY run_id")
def e08_audit(spark, sf):
    of = lambda k: F.count_if(F.col("kind") == k)
    return e08(spark, sf).groupBy("run_id").agg(of("IMU").alias("n_imu"), of("BE").alias("n_be"), of("BI").alias("n_bi"))


#: The vertical and the heading states of the 11-state filter for level runs, where neither depends on others: a
#: recursion over each run's rows with 3 x 3 and 2 x 2 covariances. ``limit`` is what a normalised innovation may be, 100 the most inflation.
def _level_sql(limit: str) -> str:
    return RECURSIVE + f""", o AS (SELECT run_id, _row, t_s / 3600 AS t, CASE src WHEN 'BE' THEN 'VU' WHEN 'BI' THEN 'YAW' ELSE 'IMU' END AS kind, az, radians(gz) / 10 AS gz, yaw, vU,
          row_number() OVER (PARTITION BY run_id ORDER BY t_s / 3600, CASE WHEN src = 'IMU' THEN 0 ELSE 1 END, _row) AS n FROM s WHERE src = 'IMU' OR gate_ok),
    r AS (SELECT DISTINCT run_id, 0::BIGINT AS n, NULL::BIGINT AS _row, '' AS kind, '' AS status, NULL::DOUBLE AS last, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS b, 0.0::DOUBLE AS y, 0.0::DOUBLE AS g,
                 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 0.25::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0025::DOUBLE AS p22, 0.04::DOUBLE AS h00, 0.0::DOUBLE AS h01, 0.0001::DOUBLE AS h11,
                 NULL::DOUBLE AS nis, NULL::DOUBLE AS m, 0::BIGINT AS used, 0::BIGINT AS retried, 0::BIGINT AS rejected FROM o
      UNION ALL
      SELECT run_id, n, _row, kind, CASE WHEN kind = 'IMU' THEN CASE WHEN last IS NULL THEN 'start' WHEN d > 0 THEN 'step' ELSE 'gap' END WHEN last IS NULL THEN 'waiting' WHEN over THEN 'rejected' WHEN m > 1 THEN 'retried' ELSE 'applied' END,
             CASE WHEN kind = 'IMU' THEN t ELSE last END, u + a0 * r, v + a1 * r, b + a2 * r, CASE WHEN kind = 'IMU' AND last IS NULL THEN {WRAPPED("yaw")} ELSE {WRAPPED("y + c0 * r")} END, g + c1 * r,
             p00 - a0 * a0 * si, p01 - a0 * a1 * si, p02 - a0 * a2 * si, p11 - a1 * a1 * si, p12 - a1 * a2 * si, p22 - a2 * a2 * si, h00 - c0 * c0 * si, h01 - c0 * c1 * si, h11 - c1 * c1 * si,
             nis, m, used + CASE WHEN seen AND NOT over THEN 1 ELSE 0 END, retried + CASE WHEN seen AND NOT over AND m > 1 THEN 1 ELSE 0 END, rejected + CASE WHEN over THEN 1 ELSE 0 END
      FROM (SELECT *, CASE WHEN kind = 'VU' AND taken THEN p01 / si ELSE 0 END AS a0, CASE WHEN kind = 'VU' AND taken THEN p11 / si ELSE 0 END AS a1, CASE WHEN kind = 'VU' AND taken THEN p12 / si ELSE 0 END AS a2,
                   CASE WHEN kind = 'YAW' AND taken THEN h00 / si ELSE 0 END AS c0, CASE WHEN kind = 'YAW' AND taken THEN h01 / si ELSE 0 END AS c1
            FROM (SELECT *, CASE WHEN seen THEN var + 0.0025 * m ELSE 1.0 END AS si, CASE WHEN seen THEN r * r / (var + 0.0025 * m) END AS nis, seen AND r * r / (var + 0.0025 * m) > {limit} AS over, seen AND r * r / (var + 0.0025 * m) <= {limit} AS taken
                  FROM (SELECT *, CASE WHEN r * r / (var + 0.0025) <= {limit} THEN 1.0 WHEN r * r / (var + 0.025) <= {limit} THEN 10.0 ELSE 100.0 END AS m
                        FROM (SELECT *, kind <> 'IMU' AND last IS NOT NULL AS seen, CASE kind WHEN 'VU' THEN p11 WHEN 'YAW' THEN h00 END AS var, CASE kind WHEN 'VU' THEN vU - v WHEN 'YAW' THEN {WRAPPED("yaw - y")} ELSE 0 END AS r
                              FROM (SELECT run_id, n, _row, kind, t, yaw, vU, last, d, used, retried, rejected, u + v * d + 0.5 * (az - b) * d * d AS u, v + (az - b) * d AS v, b, {WRAPPED("y + (gz - g) * d")} AS y, g,
                                           f0 + d * f1 - d * d / 2 * f2 + 0.0025 * d ** 3 / 3 AS p00, f1 - d * f2 + 0.0025 * d * d / 2 AS p01, f2 AS p02, p11 - 2 * d * p12 + d * d * p22 + 0.0025 * d + 1e-8 * d ** 3 / 3 AS p11, p12 - d * p22 - 1e-8 * d * d / 2 AS p12, p22 + 1e-8 * d AS p22,
                                           h00 - 2 * d * h01 + d * d * h11 + 2.5e-5 * d + 1e-10 * d ** 3 / 3 AS h00, h01 - d * h11 - 1e-10 * d * d / 2 AS h01, h11 + 1e-10 * d AS h11
                                    FROM (SELECT *, p00 + d * p01 - d * d / 2 * p02 AS f0, p01 + d * p11 - d * d / 2 * p12 AS f1, p02 + d * p12 - d * d / 2 * p22 AS f2
                                          FROM (SELECT o.*, r.* EXCLUDE (run_id, n, _row, kind, status, nis, m), CASE WHEN o.kind = 'IMU' AND o.t - r.last > 0 AND o.t - r.last <= 200 THEN o.t - r.last ELSE 0 END AS d FROM r JOIN o ON o.run_id = r.run_id AND o.n = r.n + 1))))))))
  SELECT run_id, _row, status, round(u, 3) + 0.0 AS "U", round(v, 5) + 0.0 AS "vU", round(sin(y), 5) + 0.0 AS yaw_sin, round(cos(y), 5) + 0.0 AS yaw_cos, round(ln(1 + nis), 5) AS ln_nis, CASE WHEN nis IS NOT NULL THEN m END AS inflate, used, retried, rejected FROM r WHERE n > 0"""


def _level(spark, sf, retry=None):
    """The runs kept level, with the earth-frame log as vertical velocities and the body-frame log as headings."""
    kind = F.when(F.col("kind") == "BE", "VU").when(F.col("kind") == "BI", "YAW").otherwise("IMU")
    rows = _timeline(spark, sf).withColumns({"kind": kind, "roll": F.lit(0.0), "pitch": F.lit(0.0)})
    made = estimate.inertial_filter(rows, estimate.Noise(most_dt=200.0), retry)
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    return made.select(
        "run_id", "_row", "status", (F.round("U", 3) + 0.0).alias("U"), (F.round("vU", 5) + 0.0).alias("vU"), (F.round(F.sin("yaw_rad"), 5) + 0.0).alias("yaw_sin"), (F.round(F.cos("yaw_rad"), 5) + 0.0).alias("yaw_cos"), F.round(F.log1p(value("nis")), 5).alias("ln_nis"),
        value("inflate").alias("inflate"), F.col("n_used").alias("used"), F.col("n_retried").alias("retried"), F.col("n_rejected").alias("rejected"),
    )


@register("e05_e06_level_filter", _level_sql("1e300"))
def e06(spark, sf):
    return _level(spark, sf)


@register("e09_nis_retry", _level_sql("25.0"))
def e09(spark, sf):
    return _level(spark, sf, estimate.Retry(limit=25.0, times=10.0, attempts=2))


@register("e08_pipeline", GATED + """, b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) AS i, count(*) OVER (PARTITION BY run_id) AS m FROM g WHERE gate_reasons = ''),
  w AS (SELECT run_id, min(t_s) AS t0, max(t_s) AS t1 FROM s WHERE src = 'IMU' GROUP BY run_id)
  SELECT b.run_id, b._row, CASE WHEN b.t_s >= w.t0 THEN 'applied' ELSE 'waiting' END AS status, b.t_s >= w.t0 AS report_ok, CASE WHEN b.t_s >= w.t0 THEN round(b.vE, 6) END AS "zE", CASE WHEN b.t_s >= w.t0 THEN round(b.vN, 6) END AS "zN", CASE WHEN b.t_s >= w.t0 THEN round(b.vU, 6) END AS "zU" FROM b JOIN w USING (run_id)""")
def e08_pipeline(spark, sf):
    """Raw logs through E19, E20 and E07 into the filter, and its audit; what a velocity was measured as is its innovation and the state before it."""
    imu = deadreckon.preprocessed_imu(samples(spark, sf, "IMU"), static_s=24 * HOUR)
    imu = imu.select("run_id", "_row", "t_s", F.lit("IMU").alias("kind"), *(F.col(f"lin_{a}").alias(f"a{a}") for a in "xyz"), (F.col("gyro_z_f") / 10).alias("gz"), "roll", "pitch", F.col("yaw_f").alias("yaw"))
    velocities = estimate.measurements(gates.preprocessed_velocity(samples(spark, sf, "BE"), LIMITS), samples(spark, sf, "BI"), use_body=False)
    velocities = velocities.select("run_id", "_row", "t_s", F.lit("BE").alias("kind"), F.col("zE").alias("vE"), F.col("zN").alias("vN"), F.col("zU").alias("vU"))
    inside = velocities.join(imu.select("run_id").distinct(), "run_id", "left_semi")
    rows = imu.unionByName(inside, allowMissingColumns=True).withColumn("t_s", F.col("t_s") / HOUR)
    audit = estimate.update_audit(estimate.inertial_filter(rows, estimate.Noise(most_dt=200.0)))
    z = {f"z{a}": F.when(F.col("report_ok"), F.round(F.col(f"r{i}") + F.col(f"v{a}_pre"), 6)) for i, a in enumerate("ENU")}
    return audit.select("run_id", "_row", "status", "report_ok", *(c.alias(n) for n, c in z.items()))


def _planar(spark, sf):
    """Inertial samples, body-frame and earth-frame velocities on a clock of hours."""
    rows = samples(spark, sf).withColumns({"t_s": F.col("t_s") / HOUR, "gz": F.radians("gz") / 10})
    return tuple(rows.filter(F.col("src") == s) for s in ("IMU", "BI", "BE"))


@register("e11_e14_planar_filter")
def e13(spark, sf):
    return estimate.focus_record(estimate.planar_run(*_planar(spark, sf), estimate.PlanarLimits(dt_max=200.0)))


_EAST = "cos(i.yaw) * cos(i.pitch) * b.vE + (cos(i.yaw) * sin(i.pitch) * sin(i.roll) - sin(i.yaw) * cos(i.roll)) * b.vN + (cos(i.yaw) * sin(i.pitch) * cos(i.roll) + sin(i.yaw) * sin(i.roll)) * b.vU"


_NORTH = "sin(i.yaw) * cos(i.pitch) * b.vE + (sin(i.yaw) * sin(i.pitch) * sin(i.roll) + cos(i.yaw) * cos(i.roll)) * b.vN + (sin(i.yaw) * sin(i.pitch) * cos(i.roll) - cos(i.yaw) * sin(i.roll)) * b.vU"
#: The planar filter without acceleration: east and north have one 2 x 2 covariance, and meet in speeds and innovations alone.
_COAST = RECURSIVE + f""", w AS (SELECT run_id, greatest(min(t_s) FILTER (WHERE src = 'IMU'), min(t_s) FILTER (WHERE src = 'BI')) AS t0, least(max(t_s) FILTER (WHERE src = 'IMU'), max(t_s) FILTER (WHERE src = 'BI')) AS t1 FROM s GROUP BY run_id),
  x AS (SELECT s.*, (t_s / 3600.0) AS h FROM s JOIN w USING (run_id) WHERE t_s BETWEEN t0 AND t1), i AS (SELECT * FROM x WHERE src = 'IMU' QUALIFY row_number() OVER (PARTITION BY run_id, t_s ORDER BY _row) = 1), b AS (SELECT * FROM x WHERE src = 'BI'),
  o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, rank, h, _row) AS n FROM (
        SELECT b.run_id, b._row, i.h AS t, b.h, 1 AS rank, NULL AS gz, NULL AS yaw, {_EAST} AS ze, {_NORTH} AS zn FROM b ASOF JOIN i ON b.run_id = i.run_id AND b.t_s <= i.t_s
        UNION ALL SELECT run_id, _row, h, h, 0, radians(gz) / 10, yaw, NULL, NULL FROM x WHERE src = 'IMU')),
  r AS (SELECT DISTINCT run_id, 0::BIGINT AS n, NULL::BIGINT AS _row, '' AS status, NULL::DOUBLE AS last, 0.0::DOUBLE AS e, 0.0::DOUBLE AS nn, 0.0::DOUBLE AS ve, 0.0::DOUBLE AS vn, 0.0::DOUBLE AS y, 0.25::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.36::DOUBLE AS p11,
               NULL::DOUBLE AS nis0, NULL::DOUBLE AS nis1, NULL::DOUBLE AS inflate, '' AS triggers FROM o
    UNION ALL
    SELECT run_id, n, _row, status, CASE WHEN rank = 0 THEN t ELSE last END, e2, n2, ve2, vn2, CASE WHEN rank = 0 AND last IS NULL THEN {WRAPPED("yaw")} ELSE y END, p00 - k0 * k0 * s1, p01 - k0 * k1 * s1, p11 - k1 * k1 * s1, nis0, CASE WHEN rank = 1 AND status <> 'rejected' THEN nis1 END, inflate,
           CASE WHEN rank = 0 THEN '' ELSE concat_ws(',', CASE WHEN speed > 1 THEN 'speed_pre_h' END, CASE WHEN speed / greatest(sqrt(z0 * z0 + z1 * z1), 1e-9) > 2.5 THEN 'ratio_pre_over_meas' END, CASE WHEN (CASE WHEN status = 'rejected' THEN nis0 ELSE nis1 END) > 25 THEN 'nis' END,
             CASE WHEN sqrt((ve2 - z0) ** 2 + (vn2 - z1) ** 2) > 0.3 THEN 'verr_h' END, CASE WHEN sqrt(k0 * k0 + k1 * k1) * sqrt(re * re + rn * rn) > 0.5 THEN 'dx_norm' END, CASE WHEN sqrt(nis1) > 5 THEN 'rwhite_norm' END, CASE WHEN inflate > 10 THEN 'R_inflate' END) END
    FROM (SELECT *, e + k0 * re AS e2, nn + k0 * rn AS n2, ve + k1 * re AS ve2, vn + k1 * rn AS vn2
      FROM (SELECT *, CASE WHEN rank = 1 AND status <> 'rejected' THEN p01 / s1 ELSE 0 END AS k0, CASE WHEN rank = 1 AND status <> 'rejected' THEN p11 / s1 ELSE 0 END AS k1, (re * re + rn * rn) / s1 AS nis1
        FROM (SELECT *, p11 + noise * coalesce(inflate, 1) AS s1, CASE WHEN rank = 0 THEN CASE WHEN d > 0 THEN 'step' ELSE 'gap' END WHEN still THEN 'still' WHEN bad THEN 'rejected' WHEN inflate > 1 THEN 'inflated' ELSE 'applied' END AS status
          FROM (SELECT *, CASE WHEN rank = 1 THEN CASE WHEN still OR bad THEN 1.0 ELSE least(5e3, greatest(1.0, CASE WHEN nis0 > 25 THEN nis0 / 25 ELSE 1.0 END, CASE WHEN ratio > 2.5 THEN (ratio / 2.5) ** 2 ELSE 1.0 END)) END END AS inflate
            FROM (SELECT *, NOT still AND (nis0 > 120 OR ratio > 10) AS bad
              FROM (SELECT *, CASE WHEN rank = 1 THEN (re * re + rn * rn) / (p11 + noise) END AS nis0, speed / greatest(sqrt(z0 * z0 + z1 * z1), 0.07) AS ratio
                FROM (SELECT *, CASE WHEN rank = 1 THEN z0 - ve ELSE 0 END AS re, CASE WHEN rank = 1 THEN z1 - vn ELSE 0 END AS rn, sqrt(ve * ve + vn * vn) AS speed, CASE WHEN still THEN 0.0036 ELSE 0.000064 END AS noise
                  FROM (SELECT *, coalesce(sqrt(ze * ze + zn * zn) <= 0.04, false) AS still, CASE WHEN sqrt(ze * ze + zn * zn) <= 0.04 THEN 0.0 ELSE ze END AS z0, CASE WHEN sqrt(ze * ze + zn * zn) <= 0.04 THEN 0.0 ELSE zn END AS z1
                    FROM (SELECT run_id, n, _row, rank, t, yaw, ze, zn, last, d, e + d * ve * f AS e, nn + d * vn * f AS nn, ve * f AS ve, vn * f AS vn, {WRAPPED("y + gz * d")} AS y0, coalesce({WRAPPED("y + gz * d")}, y) AS y,
                                 p00 + 2 * d * p01 + d * d * p11 + 0.0625 * d ** 4 / 4 AS p00, p01 + d * p11 + 0.0625 * d ** 3 / 2 AS p01, p11 + 0.0625 * d * d AS p11
                      FROM (SELECT *, slow * CASE WHEN d > 0 AND slow * sqrt(ve * ve + vn * vn) > 0.8 THEN 0.8 / (slow * sqrt(ve * ve + vn * vn)) ELSE 1.0 END AS f
                        FROM (SELECT *, greatest(0.0, 1 - 0.001 * d) AS slow
                          FROM (SELECT o.*, r.* EXCLUDE (run_id, n, _row, status, nis0, nis1, inflate, triggers), CASE WHEN o.rank = 0 AND o.t - r.last > 0 AND o.t - r.last <= 200 THEN o.t - r.last ELSE 0 END AS d FROM r JOIN o ON o.run_id = r.run_id AND o.n = r.n + 1)))))))))))))"""


@register("e11_e14_coasting_filter", _COAST + """ SELECT run_id, _row, status, round(e, 3) + 0.0 AS "E", round(nn, 3) + 0.0 AS "N", round(ve, 5) + 0.0 AS "vE", round(vn, 5) + 0.0 AS "vN", round(sin(y), 5) + 0.0 AS yaw_sin, round(ln(1 + nis0), 5) AS ln_nis0, round(ln(1 + nis1), 5) AS ln_nis1, round(ln(inflate), 5) AS ln_inflate, triggers FROM r WHERE n > 0""")
def e12_coasting(spark, sf):
    """The planar filter with all accelerations inside its dead band: states, innovations, statuses and marks of every row."""
    made = estimate.planar_run(*_planar(spark, sf), estimate.PlanarLimits(dt_max=200.0, dead_acc=100.0, leak=0.001))
    marks = estimate.focus_record(made).select("run_id", "_row", F.array_join("triggers", ",").alias("triggers"))
    value = lambda c, f: F.round(f(F.when(~F.isnan(c), F.col(c))), 5)
    rows = made.join(marks, ["run_id", "_row"], "left")
    return rows.select(
        "run_id", "_row", "status", *((F.round(c, 3) + 0.0).alias(c) for c in ("E", "N")), *((F.round(c, 5) + 0.0).alias(c) for c in ("vE", "vN")), (F.round(F.sin("yaw_rad"), 5) + 0.0).alias("yaw_sin"), value("nis0", F.log1p).alias("ln_nis0"), value("nis1", F.log1p).alias("ln_nis1"),
        value("R_inflate", F.log).alias("ln_inflate"), F.coalesce("triggers", F.lit("")).alias("triggers"),
    )


@register("e13_planar_inputs", SQL + f""", w AS (SELECT run_id, greatest(min(t_s) FILTER (WHERE src = 'IMU'), min(t_s) FILTER (WHERE src = 'BI')) AS t0, least(max(t_s) FILTER (WHERE src = 'IMU'), max(t_s) FILTER (WHERE src = 'BI')) AS t1 FROM s GROUP BY run_id),
  x AS (SELECT s.*, (t_s / 3600.0) AS h FROM s JOIN w USING (run_id) WHERE t_s BETWEEN t0 AND t1), i AS (SELECT * FROM x WHERE src = 'IMU' QUALIFY row_number() OVER (PARTITION BY run_id, t_s ORDER BY _row) = 1), b AS (SELECT * FROM x WHERE src = 'BI'),
  m AS (SELECT b.run_id, b._row, i.h AS t_imu, {_EAST} AS east FROM b ASOF JOIN i ON b.run_id = i.run_id AND b.t_s <= i.t_s)
  SELECT run_id, _row, 'BI' AS kind, round(t_imu, 6) AS t_imu_s, round(east, 6) AS "vE_meas" FROM m UNION ALL SELECT run_id, _row, 'IMU', round(h, 6), NULL FROM x WHERE src = 'IMU'""")
def e13_inputs(spark, sf):
    return estimate.planar_inputs(*_planar(spark, sf)).select("run_id", "_row", "kind", F.round("t_imu_s", 6).alias("t_imu_s"), F.round("vE_meas", 6).alias("vE_meas"))


@register("e15_quaternion_attitude", RECURSIVE + """, i AS (SELECT run_id, _row, t_s / 3600 AS t, radians(gx) / 10 AS a, radians(gy) / 10 AS b, radians(gz) / 10 AS c, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) AS n FROM s WHERE src = 'IMU'),
  d AS (SELECT *, lead(_row) OVER w AS next_row, greatest(lead(t) OVER w - t, 0) AS dt FROM i WINDOW w AS (PARTITION BY run_id ORDER BY n)), m AS (SELECT *, sqrt(a * a + b * b + c * c) * dt AS angle FROM d WHERE next_row IS NOT NULL),
  h AS (SELECT run_id, n, next_row, cos(angle / 2) AS w, a * dt * f AS x, b * dt * f AS y, c * dt * f AS z FROM (SELECT *, CASE WHEN angle > 1e-12 THEN sin(angle / 2) / angle ELSE 0.5 END AS f FROM m)),
  q AS (SELECT run_id, n, _row, 1.0::DOUBLE AS qw, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz FROM i WHERE n = 1 UNION ALL
        SELECT q.run_id, q.n + 1, h.next_row, qw * w - qx * x - qy * y - qz * z, qw * x + qx * w + qy * z - qz * y, qw * y - qx * z + qy * w + qz * x, qw * z + qx * y - qy * x + qz * w FROM q JOIN h ON q.run_id = h.run_id AND q.n = h.n)
  SELECT run_id, _row, round(qw, 6) AS qw, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz FROM q""")
def e15(spark, sf):
    rows = samples(spark, sf, "IMU").withColumns({c: F.radians(c) / 10 for c in ("gx", "gy", "gz")} | {"t_s": F.col("t_s") / HOUR})
    return estimate.quaternion_attitude(rows).select("run_id", "_row", *(F.round(c, 6).alias(c) for c in ("qw", "qx", "qy", "qz")))


def _graph(spark, sf):
    rows = _timeline(spark, sf)
    nodes = graph.keyframes(rows.filter("kind = 'IMU'"), 8)
    return nodes, graph.factors(nodes, rows.filter("kind <> 'IMU'").withColumnRenamed("kind", "src"), tolerance=12.0)


def level_nodes(spark, sf):
    """Every eighth sample of a run as a node at its own velocity and heading, all places being zero."""
    rows = samples(spark, sf, "IMU").withColumns({"t_s": F.col("t_s") / HOUR, "gz": F.radians("gz") / 10})
    nodes = graph.keyframes(rows, 8).withColumn("node", F.col("node").cast("long"))
    return nodes.select("run_id", "node", "t_s", *(F.lit(0.0).alias(c) for c in ("E", "N", "U")), "vE", "vN", "vU", F.col("yaw").alias("yaw_rad"), "ax", "ay", "az", "gz", "roll", "pitch", "k")


@register("e16_graph_factors", SQL + f""", i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) - 1 AS n FROM s WHERE src = 'IMU'), k AS (SELECT run_id, t_s, n // 8 AS node FROM i WHERE n % 8 = 0),
  v AS (SELECT run_id, _row, src, t_s FROM s WHERE src <> 'IMU' AND gate_ok), f AS (SELECT v.*, k.t_s AS aft, k.node AS an FROM v ASOF LEFT JOIN k ON v.run_id = k.run_id AND v.t_s <= k.t_s),
  b AS (SELECT f.*, k.t_s AS bef, k.node AS bn FROM f ASOF LEFT JOIN k ON f.run_id = k.run_id AND f.t_s >= k.t_s),
  p AS (SELECT *, CASE WHEN aft IS NULL THEN bn WHEN bef IS NULL OR aft - t_s <= t_s - bef THEN an ELSE bn END AS node, CASE WHEN aft IS NULL THEN t_s - bef WHEN bef IS NULL OR aft - t_s <= t_s - bef THEN aft - t_s ELSE t_s - bef END AS gap FROM b),
  a AS (SELECT run_id, src AS kind, node FROM p WHERE gap <= 12 * 3600.0 UNION ALL SELECT run_id, 'yaw', node FROM k UNION ALL SELECT run_id, 'prior', node FROM k WHERE node = 0)
  SELECT run_id, kind, node, count(*) AS n FROM a GROUP BY run_id, kind, node""")
def e16(spark, sf):
    return _graph(spark, sf)[1].groupBy("run_id", "kind", F.col("node").cast("long").alias("node")).agg(F.count("*").alias("n"))


@register("e17_e18_gauss_newton")
def e17(spark, sf):
    return graph.smooth(*_graph(spark, sf))


_R = ("cos(yaw) * cos(pitch)", "cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll)", "cos(yaw) * sin(pitch) * cos(roll) + sin(yaw) * sin(roll)", "sin(yaw) * cos(pitch)", "sin(yaw) * sin(pitch) * sin(roll) + cos(yaw) * cos(roll)", "sin(yaw) * sin(pitch) * cos(roll) - cos(yaw) * sin(roll)", "-sin(pitch)", "cos(pitch) * sin(roll)", "cos(pitch) * cos(roll)")
_TURNED = lambda k: " + ".join(f"({_R[3 * k + i].replace('yaw', 'mid')}) * a{c}" for i, c in enumerate("xyz"))


@register("e18_factor_residuals", SQL + f""", i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) - 1 AS n FROM s WHERE src = 'IMU'),
  k AS (SELECT run_id, t_s / 3600 AS t, n // 8 AS node, vE, vN, vU, yaw, roll, pitch, ax, ay, az, radians(gz) / 10 AS rate FROM i WHERE n % 8 = 0),
  c AS (SELECT k.run_id, v.src AS kind, k.node, CASE v.src WHEN 'BE' THEN pow(k.vE - v.vE, 2) + pow(k.vN - v.vN, 2) + pow(k.vU - v.vU, 2)
          ELSE {" + ".join(f"pow(({_R[j].replace('yaw', 'k.yaw').replace('pitch', 'k.pitch').replace('roll', 'k.roll')}) * k.vE + ({_R[3 + j].replace('yaw', 'k.yaw').replace('pitch', 'k.pitch').replace('roll', 'k.roll')}) * k.vN + ({_R[6 + j].replace('yaw', 'k.yaw').replace('pitch', 'k.pitch').replace('roll', 'k.roll')}) * k.vU - v.{z}, 2)" for j, z in enumerate(("vE", "vN", "vU")))} END / pow(0.05, 2) / 2 AS cost
        FROM k JOIN s v ON v.run_id = k.run_id AND v.src <> 'IMU' AND v.k % 8 = k.node),
  d AS (SELECT *, lead(t) OVER w - t AS dt, lead(vE) OVER w AS e2, lead(vN) OVER w AS n2, lead(vU) OVER w AS u2, lead(yaw) OVER w AS y2 FROM k WINDOW w AS (PARTITION BY run_id ORDER BY node)),
  f AS (SELECT *, yaw + 0.5 * rate * dt AS mid FROM d WHERE dt IS NOT NULL), g AS (SELECT *, {_TURNED(0)} AS a0, {_TURNED(1)} AS a1, {_TURNED(2)} AS a2 FROM f),
  m AS (SELECT run_id, 'move' AS kind, node, ({" + ".join(f"pow(-{v} * dt - 0.5 * a{j} * dt * dt, 2) + pow({v2} - {v} - a{j} * dt, 2)" for j, (v, v2) in enumerate((("vE", "e2"), ("vN", "n2"), ("vU", "u2"))))} + pow({WRAPPED("y2 - yaw - rate * dt")}, 2)) / pow(0.1 * greatest(dt, 1e-3), 2) / 2 AS cost FROM g)
  SELECT run_id, kind, count(*) AS n, round(sum(ln(1 + cost)), 4) AS cost FROM (SELECT * FROM c UNION ALL SELECT * FROM m) GROUP BY run_id, kind""")
def e18(spark, sf):
    """Residuals at each node's own velocity and heading, all places being zero; velocities belong to the node of their k modulo 8."""
    states = level_nodes(spark, sf)
    seen = samples(spark, sf).filter("src <> 'IMU'").select("run_id", F.col("src").alias("kind"), (F.col("k") % 8).cast("long").alias("node"), F.col("vE").alias("z0"), F.col("vN").alias("z1"), F.col("vU").alias("z2"))
    cost = F.round(F.sum(F.log(1 + F.col("cost"))), 4)
    return graph.factor_residuals(states, seen).groupBy("run_id", "kind").agg(F.count("*").alias("n"), cost.alias("cost"))
