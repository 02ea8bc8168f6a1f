"""Queries of binary records, configs, supervised processes, intents and reports; files are written from the given tables and read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.columns import above, below, unsigned_zero
from tidewake.operators import audit, graph, ops
from tidewake.plans.catalogue import register
from tidewake.plans.estimate_queries import RECURSIVE, WRAPPED, level_nodes
from tidewake.plans.samples import HOUR, SQL, samples, table
from tidewake.sources import ranges, readers, sinks, wire
from tidewake.sources.scratch import fresh_folder
from tidewake.streaming import stateful


def _micros(column: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


# --- binary records ----------------------------------------------------------------------------


@register("d02_trace_quality", SQL + """, o AS (SELECT *, 1 + k % 7 AS kind, max(t_s) OVER (PARTITION BY run_id ORDER BY value, _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s WHERE k % 7 IN (0, 1, 3, 4))
  SELECT run_id, count(*) AS n, count(*) FILTER (WHERE t_s < newest) AS out_of_order, count(*) FILTER (WHERE t_s = newest) AS duplicates, count(*) FILTER (WHERE newest - t_s > 3600 * 100.0) AS stale, CAST(count(*) FILTER (WHERE k % 2 = 1) AS BIGINT) AS flagged,
         CAST(sum(k) AS BIGINT) AS sensor_to_recv_ms, CAST(max(k % 5) AS BIGINT) AS worst_backlog_ms FROM o GROUP BY run_id""")
def d02_trace(spark, sf):
    """S14 and A37 on a trace of the events, in the order of their values; the run rides in the fault code. Four of the seven kinds are asked for."""
    k, ns = F.col("k"), F.round(F.col("t_s") * 1e6).cast("long") * 1000
    records = samples(spark, sf).select(
        "run_id", "value", "_row", F.lit(1).alias("version"), (1 + k % 7).alias("kind"), (k % 2).alias("flags"), ns.alias("sensor_time_ns"), (ns + k * 1_000_000).alias("recv_mono_ns"), (ns + (k + k % 5) * 1_000_000).alias("consume_mono_ns"),
        F.lit(0).cast("long").alias("publish_mono_ns"), k.alias("age_ms"), F.col("run_id").alias("fault_code"),
    )
    path = fresh_folder(spark, "trace")
    ranges.write_trace(records.repartition("run_id").sortWithinPartitions("run_id", "value", "_row").drop("value", "_row"), path)
    rows = ranges.binary_trace(spark, path, range_bytes=1 << 16).filter(F.col("kind").isin(1, 2, 4, 5)).withColumn("run_id", F.col("fault_code"))
    newest = F.max("sensor_time_ns").over(W.partitionBy("run_id").orderBy("path", "record").rowsBetween(W.unboundedPreceding, -1))
    t, rows = F.col("sensor_time_ns"), rows.withColumn("newest", newest)
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(below(t, F.col("newest"))).alias("out_of_order"), F.count_if(F.coalesce(t == F.col("newest"), F.lit(False))).alias("duplicates"), F.count_if(above(F.col("newest") - t, 100 * HOUR * 1e9)).alias("stale"),
        F.count_if(F.col("flags") == 1).alias("flagged"), F.expr("sum((recv_mono_ns - sensor_time_ns) div 1000000)").alias("sensor_to_recv_ms"), F.expr("max((consume_mono_ns - recv_mono_ns) div 1000000)").alias("worst_backlog_ms"),
    )


@register("s15_wire_structs", SQL + """ SELECT _row, CAST(CAST(round(t_s * 1e6) AS BIGINT) * 1000 AS BIGINT) AS t_ns, round(vE, 6) + 0.0 AS east, round(vN, 6) + 0.0 AS north, round(yaw, 6) AS yaw, round(-value, 6) AS depth, CAST(k AS BIGINT) AS age_ms, CAST(k % 2 AS BIGINT) AS valid, CAST(k % 5 AS BIGINT) AS nav_state,
  CAST(k * 600 AS BIGINT) AS fault_code, CAST(65535 - k AS BIGINT) AS status_flags FROM s WHERE src <> 'IMU'""")
def s15(spark, sf):
    """Navigation states packed as C has them, saved as payloads with their header and decoded by column expressions."""
    rows = samples(spark, sf, "BE", "BI").select("_row", F.round(F.col("t_s") * 1e6).cast("long").alias("us"), "vE", "vN", "yaw", "value", "k")
    c_struct = np.dtype(
        [("t_ns", "<u8"), ("pos", "<f8", 3), ("vel", "<f8", 3), ("rpy", "<f8", 3), ("depth", "<f8"), ("omega_b", "<f8", 3), ("acc_b", "<f8", 3), ("age_ms", "<u4"), ("valid", "u1"), ("stale", "u1"), ("degraded", "u1"), ("nav_state", "u1"), ("health", "u1"), ("r0", "u1"), ("fault_code", "<u2"), ("sensor_mask", "<u2"), ("status_flags", "<u2"), ("r1", "<u2")],
        align=True,
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            out = np.zeros(b.num_rows, c_struct)
            out["t_ns"], out["vel"][:, 0], out["vel"][:, 1], out["rpy"][:, 2], out["depth"] = of("us") * 1000, of("vE"), of("vN"), of("yaw"), -of("value")
            out["age_ms"], out["valid"], out["nav_state"], out["fault_code"], out["status_flags"] = of("k"), of("k") % 2, of("k") % 5, of("k") * 600, 65535 - of("k")
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array([x.tobytes() for x in out], pa.binary())], names=["_row", "payload"])

    # decoding is much work for few bytes, so that the scan's own parts would be too few
    blobs = rows.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(packed, "_row long, payload binary")
    made = wire.decoded(blobs, wire.NAV_STATE, keep=["_row"])
    part = lambda c, i: F.round(F.get(c, F.lit(i)), 6) + 0.0
    return made.select("_row", F.col("t_ns").cast("long").alias("t_ns"), part("vel", 0).alias("east"), part("vel", 1).alias("north"), part("rpy", 2).alias("yaw"), F.round("depth", 6).alias("depth"), "age_ms", "valid", "nav_state", "fault_code", "status_flags")


# --- ends of logs, documents, configs ----------------------------------------------------------


@register("s16_latest_csv_rows", SQL + " SELECT run_id, max_by(_row, struct_pack(t := t_s, r := _row)) AS _row, round(max_by(value, struct_pack(t := t_s, r := _row)), 6) AS value FROM s GROUP BY run_id")
def s16(spark, sf):
    path = fresh_folder(spark, "latest")
    log = samples(spark, sf).select("run_id", F.col("run_id").alias("run"), "t_s", F.col("_row").alias("event"), "value")
    sinks.write_csv(log.repartition("run_id").sortWithinPartitions("run_id", "t_s", "event"), path)
    row = F.col("row")
    return readers.latest_csv_rows(spark, path, 2048).select(row["run"].cast("long").alias("run_id"), row["event"].cast("long").alias("_row"), F.round(row["value"].cast("double"), 6).alias("value"))


@register("s12_json_documents", "SELECT c_custkey, c_nationkey AS nation, c_acctbal > 0 AS funded, CASE WHEN c_custkey % 3 > 0 THEN round(c_acctbal, 2) END AS balance FROM customer")
def s12(spark, sf):
    path, key = fresh_folder(spark, "documents"), F.col("c_custkey")
    one = F.struct("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.when(key % 3 > 0, F.round("c_acctbal", 2)).alias("balance")).alias("account"), F.array(F.col("c_acctbal") > 0).alias("flags"))
    files = table(spark, sf, "customer").groupBy(F.floor(key / 2000).alias("file")).agg(F.collect_list(F.to_json(one)).alias("docs"))  # two thousand documents a file
    texts = files.select("file", F.concat(F.lit("[\n"), F.array_join("docs", ",\n"), F.lit("\n]")).alias("value"))
    # texts are small, so that Spark would join the parts and one task write all files
    texts.repartition(4 * spark.sparkContext.defaultParallelism, "file").write.partitionBy("file").text(path)
    docs = readers.json_documents(spark, path)
    return docs.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("account.nation").cast("int").alias("nation"), F.get("flags", F.lit(0)).alias("funded"), F.col("account.balance").alias("balance"))


@register("x15_yaml_values", """SELECT n_nationkey AS n, unnest(['logging.base_dir', 'logging.split_by_date', 'logging.deep.level', 'logging.after', 'other.base_dir', 'last']) AS key,
  unnest(['logs/' || n_name, 'true', CAST(n_nationkey AS VARCHAR), 'a: b', 'x # y', CAST(n_regionkey AS VARCHAR)]) AS value FROM nation""")
def x15(spark, sf):
    text = F.concat(
        F.lit("# a config\n\nlogging:   # where\n  base_dir: 'logs/"), "n_name", F.lit("'  # here\n  split_by_date: true\n  deep:\n\n      # deeper\n      level: "), F.col("n_nationkey").cast("string"), F.lit("\n  after: a: b\nlist:\n  - a: 1\n  - b\nother:\n    base_dir: \"x\u00a0# y\"\nempty:\nlast: "),
        F.col("n_regionkey").cast("string"), F.lit("\nnonsense\n"),
    )
    path = fresh_folder(spark, "configs")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), text.alias("value")).write.partitionBy("n").text(path)
    return readers.config_values(spark, path).select(F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("int").alias("n"), "key", F.replace("value", F.lit("\u00a0"), F.lit(" ")).alias("value"))


# --- streams with typed state ------------------------------------------------------------------


def _slices(spark, rows, by: str, n: int = 4, files: int = 16):
    """``rows`` written in ``n`` slices of ``by``, one after the other, as files that a stream finds in that order, a slice a batch.

    Files of a slice aren't in order among themselves, so no batch may end inside one: where slices differ in files, all are one batch.
    """
    folder = fresh_folder(spark, "slices")
    ends = rows.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
    place = F.least(F.floor((F.col(by) - ends.a) * n / max(ends.b - ends.a, 1e-9)), F.lit(n - 1)) if ends.a is not None else F.lit(0)
    for i in range(n):
        rows.filter(place == i).repartition(files).write.parquet(f"{folder}/in/{i}")
    counts = [len(spark.read.schema(rows.schema).parquet(f"{folder}/in/{i}").inputFiles()) for i in range(n)]
    batch = counts[0] if len(set(counts)) == 1 else sum(counts)
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", batch).parquet(f"{folder}/in"), folder


_QUATERNION = RECURSIVE + """, i AS (SELECT run_id, _row, t_s / 3600 AS t, radians(gx) / 10 AS a, radians(gy) / 10 AS b, radians(gz) / 10 AS c, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) AS n FROM s WHERE src = 'IMU'),
  d AS (SELECT *, lead(_row) OVER w AS next_row, greatest(lead(t) OVER w - t, 0) AS dt FROM i WINDOW w AS (PARTITION BY run_id ORDER BY n)), m AS (SELECT *, sqrt(a * a + b * b + c * c) * dt AS angle FROM d WHERE next_row IS NOT NULL),
  h AS (SELECT run_id, n, next_row, cos(angle / 2) AS w, a * dt * f AS x, b * dt * f AS y, c * dt * f AS z FROM (SELECT *, CASE WHEN angle > 1e-12 THEN sin(angle / 2) / angle ELSE 0.5 END AS f FROM m)),
  q AS (SELECT run_id, n, _row, 1.0::DOUBLE AS qw, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz FROM i WHERE n = 1 UNION ALL
        SELECT q.run_id, q.n + 1, h.next_row, qw * w - qx * x - qy * y - qz * z, qw * x + qx * w + qy * z - qz * y, qw * y - qx * z + qy * w + qz * x, qw * z + qx * y - qy * x + qz * w FROM q JOIN h ON q.run_id = h.run_id AND q.n = h.n)"""


@register("r06_stream_attitude", _QUATERNION + " SELECT run_id, _row, 'used' AS status, round(qw, 6) + 0.0 AS qw, round(qx, 6) + 0.0 AS qx, round(qy, 6) + 0.0 AS qy, round(qz, 6) + 0.0 AS qz, round(2 * (qw * qz + qx * qy), 6) + 0.0 AS sine FROM q")
def r06(spark, sf):
    """Quaternions kept over the micro-batches of a stream that gets the samples in slices of time; ``sine`` is that of yaw times the cosine of pitch."""
    rows = samples(spark, sf, "IMU").select("run_id", "_row", (F.col("t_s") / HOUR).alias("t_s"), *((F.radians(c) / 10).alias(c) for c in ("gx", "gy", "gz")))
    stream, folder = _slices(spark, rows, "t_s")
    done = stateful.run_once(stateful.attitudes(stream), f"{folder}/state", f"{folder}/out")
    return done.select("run_id", "_row", "status", *((F.round(c, 6) + 0.0).alias(c) for c in ("qw", "qx", "qy", "qz")), (F.round(F.sin("yaw") * F.cos("pitch"), 6) + 0.0).alias("sine"))


_INTENTS = """WITH i AS (SELECT user_id AS run_id, event_type AS source, event_id AS _row, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, epoch_us(ts) // 1000 AS stamp FROM events),
  n AS (SELECT *, CASE WHEN k % 7 = 0 THEN 0 ELSE _row END AS seq, (k % 10) * 72000000 AS ttl FROM i),
  o AS (SELECT *, coalesce(seq > max(seq) OVER (PARTITION BY run_id, source ORDER BY stamp, _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM n),
  a AS (SELECT *, stamp + CASE WHEN ttl > 0 THEN ttl ELSE 180000000 END AS deadline, lead(stamp) OVER (PARTITION BY run_id, source ORDER BY stamp, _row) AS following FROM o WHERE ok)"""


def _intents(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("source"), F.col("event_id").alias("_row"), k.alias("k"), _micros().alias("us"))
    return rows.select("run_id", "source", "_row", F.when(F.col("k") % 7 == 0, 0).otherwise(F.col("_row")).cast("long").alias("seq"), F.timestamp_micros("us").alias("ts"), F.floor(F.col("us") / 1000).cast("long").alias("stamp_ms"), (F.col("k") % 10 * 72_000_000).cast("long").alias("ttl_ms"))


@register("r10_intent_expiry", _INTENTS + """, m AS (SELECT epoch_us(max(ts)) // 1000 - 1000 AS mark FROM events)
  SELECT run_id, source, seq, stamp AS stamp_ms, CASE WHEN ok THEN 'accepted' ELSE 'out_of_order' END AS status, stamp AS at_ms FROM o
  UNION ALL SELECT run_id, source, seq, stamp, 'expired', deadline FROM a, m WHERE following > deadline OR (following IS NULL AND deadline <= mark)""")
def r10_stream(spark, sf):
    stream, folder = _slices(spark, _intents(spark, sf), "stamp_ms")
    return stateful.run_once(stateful.intent_expiries(stream, 180_000_000), f"{folder}/state", f"{folder}/out")


@register("r10_intent_checks", _INTENTS + " SELECT o.run_id, o.source, o._row, o.ok AS in_order, CASE WHEN a.following IS NULL OR a.following > a.deadline THEN a.deadline END AS expired_at_ms FROM o LEFT JOIN a ON a._row = o._row")
def r10_batch(spark, sf):
    rows = _intents(spark, sf).withColumns({"t_s": F.col("stamp_ms") / 1e3, "ttl_s": F.col("ttl_ms") / 1e3})
    made = ops.intent_checks(rows, 180_000.0)
    return made.select("run_id", "source", "_row", "in_order", F.round(F.col("expired_at") * 1e3).cast("long").alias("expired_at_ms"))


# --- processes, snapshots, preflight -----------------------------------------------------------

_EVENTS = {"view": "start", "click": "started", "signup": "exit_ok", "purchase": "stop", "error": "exit_failed"}


@register("r12_state_machine", RECURSIVE + f""", l(before, event, after) AS (VALUES {", ".join(f"('{a}', '{e}', '{b}')" for (a, e), b in ops.LIFECYCLE.items())}),
  v AS (SELECT run_id, _row, t_s, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _EVENTS.items())} END AS event, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) AS n FROM s),
  r AS (SELECT DISTINCT run_id, 0::BIGINT AS n, NULL::BIGINT AS _row, NULL::VARCHAR AS event, NULL::VARCHAR AS before, 'not_started' AS state, false AS ignored, 0::BIGINT AS starts, NULL::DOUBLE AS since, NULL::DOUBLE AS dwell FROM v
        UNION ALL SELECT v.run_id, v.n, v._row, v.event, r.state, coalesce(l.after, r.state), l.after IS NULL, r.starts + CASE WHEN v.event = 'start' AND l.after IS NOT NULL THEN 1 ELSE 0 END,
                         CASE WHEN r.since IS NULL OR coalesce(l.after, r.state) <> r.state THEN v.t_s ELSE r.since END, v.t_s - r.since
        FROM r JOIN v ON v.run_id = r.run_id AND v.n = r.n + 1 LEFT JOIN l ON l.before = r.state AND l.event = v.event)
  SELECT run_id, _row, event, before, state, ignored, greatest(starts - 1, 0) AS restarts, round(dwell, 4) AS dwell_s, CASE state WHEN 'failed' THEN 'failed' WHEN 'stopped' THEN 'stopped' ELSE 'running' END AS supervisor FROM r WHERE n > 0""")
def r12_machine(spark, sf):
    event = F.create_map(*(F.lit(x) for kv in _EVENTS.items() for x in kv))
    made = ops.process_states(samples(spark, sf).select("run_id", "_row", "t_s", F.element_at(event, F.col("event_type")).alias("event")))
    return made.select("run_id", "_row", "event", "before", "state", "ignored", "restarts", F.round(F.when(~F.isnan("dwell_s"), F.col("dwell_s")), 4).alias("dwell_s"), "supervisor")


@register("o08_motion_summary", SQL + """, l AS (SELECT run_id, max_by(struct_pack(e := vE, n := vN, u := vU, d := CASE WHEN k % 3 > 0 THEN value END), struct_pack(t := t_s, r := _row)) AS x FROM s GROUP BY run_id)
  SELECT run_id, 'available' AS state, CASE WHEN x.d IS NULL THEN 'velocity' ELSE 'velocity,depth' END AS available_fields, concat_ws('; ', 'velocity=' || printf('%.3f,%.3f,%.3f', x.e, x.n, x.u), 'depth=' || printf('%.3f', x.d)) AS summary FROM l""")
def o08(spark, sf):
    rows = samples(spark, sf).withColumn("depth", F.when(F.col("k") % 3 > 0, F.col("value")))
    rows = rows.withColumns({c: unsigned_zero(F.col(c)) for c in ("vE", "vN", "vU", "depth")})
    return ops.motion_snapshot(rows, {"velocity": ["vE", "vN", "vU"], "depth": ["depth"]})


_NEED = {"full_stack": "required", "nav_power": "required", "nav": "required", "imu_only": "partial", "power_only": "none", "no_sensor": "none"}


#: Artifacts of a bundle, the required ones first, and by which k a run has them.
_ARTIFACTS = ["supervisor.run_manifest", "supervisor.process_status", *ops.MERGE_INPUTS.values()]
_FIELD = "unnest([" + ", ".join(f"{{'i': {i}, 'key': '{key}'}}" for i, key in enumerate(_ARTIFACTS)) + "])"
_SUPERVISED = ["", "not_started", "running", "stopped", "failed"]


@register("o06_bundle_summary", SQL + f""", f AS (SELECT run_id, k, event_type, t_s, _row FROM s), r AS (SELECT run_id AS bundle, list(DISTINCT k) AS ks, max_by(k, struct_pack(t := t_s, r := _row)) AS k FROM f GROUP BY run_id),
  a AS (SELECT bundle, u.i AS i, u.key AS key, len(list_filter(ks, lambda x: x = 13 * u.i)) > 0 AS copied FROM (SELECT bundle, ks, {_FIELD} AS u FROM r)),
  h AS (SELECT bundle, coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE NOT copied AND i < 2), '') AS missing_required, coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE NOT copied AND i >= 2), '') AS missing_optional,
          coalesce(string_agg(CASE key {" ".join(f"WHEN '{v}' THEN '{n}'" for n, v in ops.MERGE_INPUTS.items())} END, ',' ORDER BY i) FILTER (WHERE NOT copied AND i >= 2), '') AS merge_missing FROM a GROUP BY bundle),
  p AS (SELECT run_id AS bundle, event_type, CASE WHEN max(run_id) % 3 = 0 THEN 'not_started' ELSE [{", ".join(f"'{x}'" for x in _SUPERVISED)}][CAST(max_by(k, struct_pack(t := t_s, r := _row)) % 5 AS BIGINT) + 1] END AS state FROM f GROUP BY run_id, event_type),
  b AS (SELECT bundle, bool_and(state = 'not_started') AS idle, bool_or(state NOT IN ('', 'not_started')) AS started, bool_or(state = 'running') AS live FROM p GROUP BY bundle)
  SELECT bundle, CASE WHEN idle AND k % 2 = 0 THEN 'preflight_failed_before_spawn' WHEN live OR k % 5 = 2 THEN 'child_process_running' WHEN started THEN 'child_process_stopped_after_start' ELSE 'run_created_without_child_start' END AS run_stage,
    CASE WHEN missing_required || missing_optional = '' THEN 'complete' ELSE 'incomplete' END AS bundle_status, missing_required = '' AS required_ok, missing_required, missing_optional, merge_missing = '' AS merge_ready, merge_missing
  FROM r JOIN h USING (bundle) JOIN b USING (bundle)""")
def o06_bundle(spark, sf):
    """Every run as a bundle: artifacts by the k that its rows have, a process for each type of event, the supervisor by the last row."""
    rows = samples(spark, sf).withColumn("bundle", F.col("run_id"))
    last = F.max_by("k", F.struct("t_s", "_row"))
    states = F.array(*map(F.lit, _SUPERVISED))
    pick = F.element_at(states, (F.col("k") % 5 + 1).cast("int"))
    runs = rows.groupBy("bundle").agg(last.alias("k")).select("bundle", pick.alias("supervisor_state"), F.when(F.col("k") % 2 == 0, "preflight_failed").alias("last_fault_event"))
    has = lambda i: F.bool_or(F.col("k") == 13 * i)
    found = [F.struct(F.lit(key).alias("key"), F.lit(i < 2).alias("required"), has(i).alias("copied")) for i, key in enumerate(_ARTIFACTS)]
    artifacts = rows.groupBy("bundle").agg(F.array(*found).alias("a")).select("bundle", F.inline("a"))
    processes = rows.groupBy("bundle", F.col("event_type").alias("process")).agg(last.alias("k")).select("bundle", "process", F.when(F.col("bundle") % 3 == 0, "not_started").otherwise(pick).alias("state"))
    return ops.bundle_summary(runs, artifacts, processes).drop("hints")


@register("o09_preflight_rows", SQL + f""", g AS (SELECT run_id, CAST(count(*) FILTER (WHERE src = 'IMU') AS VARCHAR) AS i, CAST(count(*) FILTER (WHERE src = 'BE') AS VARCHAR) AS d, max_by(k, struct_pack(t := t_s, r := _row)) AS k FROM s GROUP BY run_id),
  p AS (SELECT *, CASE WHEN run_id % 3 = 0 THEN 'control_only' ELSE 'bench' END AS runtime, CASE k % 6 {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NEED))} END AS sel FROM g),
  q AS (SELECT *, CASE WHEN sel IN ('full_stack', 'nav_power', 'nav') THEN 'bench_safe_smoke' WHEN sel = 'imu_only' THEN 'sensor_tools' ELSE 'preflight_only' END AS mode, CASE sel {" ".join(f"WHEN '{n}' THEN '{v}'" for n, v in _NEED.items())} END AS need, runtime = 'control_only' AS c FROM p)
  SELECT run_id, 'runtime_level' AS title, true AS ok, 'profile=' || runtime AS detail FROM q
  UNION ALL SELECT run_id, 'device_inventory', true, 'dvl=' || d || ', imu=' || i FROM q
  UNION ALL SELECT run_id, 'device_recommendations', true, CASE WHEN k % 2 = 0 THEN 'imu=/dev/ttyUSB' || k ELSE 'no trusted binding recommended yet' END FROM q
  UNION ALL SELECT run_id, 'startup_profile', true, 'requested=auto selected=' || sel || ' launch_mode=' || mode || ' nav_requirement=' || need FROM q
  UNION ALL SELECT run_id, 'device_binding_ambiguity', c, '/dev/a, /dev/b' || CASE WHEN c THEN '; navigation stays disabled' ELSE '' END FROM q WHERE k % 5 = 0
  UNION ALL SELECT run_id, 'startup_profile_requirements', c, 'no dvl' || CASE WHEN c THEN '; navigation readiness only' ELSE '' END FROM q WHERE k % 4 = 1
  UNION ALL SELECT run_id, 'startup_profile_gate', c OR mode = 'bench_safe_smoke', CASE WHEN c THEN 'navigation is optional, selected=' || sel ELSE 'selected=' || sel || ' launch_mode=' || mode END FROM q
  UNION ALL SELECT run_id, 'device_scan_risks', true, 'low; slow' FROM q WHERE k % 7 < 3""")
def o09(spark, sf):
    of = lambda s: F.count_if(F.col("src") == s).cast("string")
    g = samples(spark, sf).groupBy("run_id").agg(of("IMU").alias("i"), of("BE").alias("d"), F.max_by("k", F.struct("t_s", "_row")).alias("k"))
    k, texts = F.col("k"), lambda when, *x: F.when(when, F.array(*map(F.lit, x))).otherwise(F.array().cast("array<string>"))
    scans = g.select(
        "run_id", F.when(F.col("run_id") % 3 == 0, "control_only").otherwise("bench").alias("runtime"), F.create_map(F.lit("imu"), "i", F.lit("dvl"), "d").alias("counts"),
        F.when(k % 2 == 0, F.create_map(F.lit("imu"), F.concat(F.lit("/dev/ttyUSB"), k.cast("string")))).otherwise(F.create_map().cast("map<string,string>")).alias("bindings"), F.lit("auto").alias("requested"),
        F.element_at(F.array(*map(F.lit, _NEED)), k % 6 + 1).alias("selected"), texts(k % 5 == 0, "/dev/a", "/dev/b").alias("ambiguous"), texts(k % 4 == 1, "no dvl").alias("errors"), texts(k % 7 < 3, "low", "slow").alias("warnings"),
    )
    return ops.preflight(scans)


# --- audit -------------------------------------------------------------------------------------

_N = "doc_id % 300"


def _sources(spark, sf):
    """A file a document: a mark to do in every fourth, a function of doc_id % 300 lines and one of two levels."""
    d = F.col("doc_id")
    body = F.concat(F.when(d % 4 == 0, "# TODO tidy\n").otherwise(""), F.lit("def f():"), F.repeat(F.lit("\n    pass"), (d % 300).cast("int")), F.lit("\nasync def g(x):\n    if x:\n        return 1"))
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", F.concat(d.cast("string"), F.lit(".py"))).alias("path"), body.alias("text"))


_RISKS = f"""WITH d AS (SELECT doc_id, source, concat_ws('/', source, doc_id || '.py') AS path, {_N} + 4 AS code, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS comment, greatest({_N} + 1, 3) AS longest FROM documents),
  r AS (SELECT *, code + 15 * longest + 40 * 2 + 8 + CASE WHEN code > 200 THEN 200 ELSE 0 END AS score FROM d)"""


@register("c03_risk_chain", _RISKS + " SELECT path, CAST(code AS BIGINT) AS code, CAST(comment AS BIGINT) AS comment, CAST(longest AS BIGINT) AS longest, 2::BIGINT AS nest, 1::BIGINT AS branches, CAST(score AS BIGINT) AS score FROM r")
def c03(spark, sf):
    """C01, C02 and the branch tokens of each file chained into its score."""
    names = ("code", "comment", "longest", "nest", "branches", "score")
    return audit.risk_table(_sources(spark, sf)).select("path", *(F.col(c).cast("long").alias(c) for c in names))


@register("c10_directory_profile", _RISKS + """, a AS (SELECT sum(code) AS whole FROM r), g AS (SELECT coalesce(source, '.') AS directory, count(*) AS files, sum(code) AS code, sum(comment) AS comment, avg(score) AS avg_risk, max(score) AS max_risk, sum(comment) AS todo, sum(5 * comment) AS hits, sum(1 + doc_id % 3) AS changes, sum(score) AS risk FROM r GROUP BY source)
  SELECT directory, files, CAST(code AS BIGINT) AS code, CAST(comment AS BIGINT) AS comment, round(avg_risk, 4) AS avg_risk, CAST(max_risk AS BIGINT) AS max_risk, CAST(todo AS BIGINT) AS todo, CAST(hits AS BIGINT) AS hits, CAST(changes AS BIGINT) AS changes, round(100.0 * code / whole, 4) AS code_pct, round(risk / code::DOUBLE, 4) AS density FROM g, a""")
def c10(spark, sf):
    log = table(spark, sf, "documents").select(F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))), F.concat(F.lit("M\t"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py")))).alias("value"))
    changes = log.select(F.regexp_extract("value", r"^[AMDRC]\d*\t(.+)$", 1).alias("path")).groupBy("path").agg(F.count("*").alias("changes"))
    made = audit.directory_profile(_sources(spark, sf), changes)
    whole = lambda *names: (F.col(c).cast("long").alias(c) for c in names)
    return made.select("directory", *whole("files", "code", "comment", "max_risk", "todo", "hits", "changes"), *(F.round(c, 4).alias(c) for c in ("avg_risk", "code_pct", "density")))


@register("k07_report_tables", _RISKS + """, f AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS place FROM r), h AS (SELECT path, (1 + doc_id % 3) * score AS score, row_number() OVER (ORDER BY (1 + doc_id % 3) * score DESC, path) AS place FROM r)
  SELECT 'Top Risk Files' AS title, path, CAST(score AS BIGINT) AS score FROM f WHERE place <= 20 UNION ALL SELECT 'Hotspots', path, CAST(score AS BIGINT) FROM h WHERE place <= 20""")
def k07_tables(spark, sf):
    """Two of the report's tables; all of them are written as one Markdown text in a test."""
    changes = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), (1 + F.col("doc_id") % 3).alias("changes"))
    tables = audit.report_tables(_sources(spark, sf), changes)
    top = tables["Top Risk Files"].select(F.lit("Top Risk Files").alias("title"), "path", F.col("score").cast("long").alias("score"))
    return top.unionByName(tables["Hotspots"].select(F.lit("Hotspots").alias("title"), "path", F.col("weight").cast("long").alias("score")))


# --- factors -----------------------------------------------------------------------------------


@register("e18_yaw_prior_residuals", SQL + f""", i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_s, _row) - 1 AS n FROM s WHERE src = 'IMU'), k AS (SELECT run_id, n // 8 AS node, vE, vN, vU, yaw, yaw + (k % 5 - 2) / 10.0 AS z FROM i WHERE n % 8 = 0)
  SELECT run_id, 'yaw' AS kind, node, round(pow({WRAPPED("yaw - z")} / 0.05, 2) / 2, 5) AS cost FROM k
  UNION ALL SELECT run_id, 'prior', node, round((vE * vE + vN * vN + vU * vU + pow({WRAPPED("yaw - z")}, 2)) / 0.01 / 2, 5) FROM k WHERE node = 0""")
def e18_yaw(spark, sf):
    """Residuals of the heading at every node and of the prior at the first, against headings that are up to 0.2 off."""
    states = level_nodes(spark, sf)
    seen = states.select("run_id", F.lit("yaw").alias("kind"), "node", (F.col("yaw_rad") + (F.col("k") % 5 - 2) / 10.0).alias("z0"), F.lit(0.0).alias("z1"), F.lit(0.0).alias("z2"))
    seen = seen.unionByName(seen.filter("node = 0").withColumn("kind", F.lit("prior")))
    return graph.factor_residuals(states, seen).filter("kind <> 'move'").select("run_id", "kind", "node", F.round("cost", 5).alias("cost"))
