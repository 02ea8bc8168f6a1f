"""Binary layouts against ctypes, ranges and tails of large files, configs, processes, typed streaming state and reports."""

import ctypes as c
import datetime as d
import math
import os
import random
import struct
import types

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_sources import stream_of
from tidewake.functions import columns as col
from tidewake.functions import text as tx
from tidewake.operators import audit, ops
from tidewake.plans import catalogue
from tidewake.sources import ranges, readers, sinks, wire
from tidewake.streaming import stateful

KINDS = {"u8": c.c_uint8, "i8": c.c_int8, "u16": c.c_uint16, "i16": c.c_int16, "u32": c.c_uint32, "i32": c.c_int32, "u64": c.c_uint64, "i64": c.c_int64, "f32": c.c_float, "f64": c.c_double, "char": c.c_char}


def c_struct(shape):
    """The struct as the platform's C compiler lays it out."""
    members = []
    for name, kind, count, _ in shape.fields:
        kind = c_struct(kind) if isinstance(kind, wire.Layout) else KINDS[kind]
        members.append((name, kind * count if count else kind))
    return type("S", (c.Structure,), {"_fields_": members})


SHAPES = {n: getattr(wire, n) for n in ("NAV_STATE", "CONTROL_INTENT", "TELEMETRY_FRAME_V2", "TRACE_RECORD")}


@pytest.mark.parametrize("name", SHAPES)
def test_layouts_are_those_of_c(name):
    shape, made = SHAPES[name], c_struct(SHAPES[name])
    assert c.sizeof(made) == shape.size and c.alignment(made) == shape.align
    assert [getattr(made, n).offset for n, *_ in shape.fields] == [o for *_, o in shape.fields]
    assert wire.layout(("a", "u8"), ("b", "f64"), ("c", "u16", 3)).size == 24 and wire.NAV_STATE.size == 160 and wire.TRACE_RECORD.size == 48


def filled(value, rng):
    """Random numbers in all fields of a C struct; what it holds as Python values."""
    out = {}
    for name, kind in value._fields_:
        if isinstance(getattr(value, name), c.Structure):
            out[name] = filled(getattr(value, name), rng)
        elif isinstance(getattr(value, name), c.Array) and not isinstance(getattr(value, name), bytes):
            items = getattr(value, name)
            if issubclass(items._type_, c.Structure):
                out[name] = [filled(i, rng) for i in items]
            else:
                for i in range(len(items)):
                    items[i] = number(items._type_, rng)
                out[name] = list(items)
        elif isinstance(getattr(value, name), bytes):
            setattr(value, name, rng.choice([b"", b"pid", "caf\u00e9".encode(), b"x" * 32]))
            out[name] = getattr(value, name).decode()
        else:
            setattr(value, name, number(kind, rng))
            out[name] = getattr(value, name)
    return out


def number(kind, rng):
    if kind in (c.c_float, c.c_double):
        return rng.choice([0.0, -0.0, 1.5, -math.pi, 1e-310, 5e-324, 1e-42, 3e38, -1e300, 2.0**-1022, math.inf, -math.inf, math.nan, rng.gauss(0, 1), rng.gauss(0, 1) * 1e-20])
    bits = 8 * c.sizeof(kind)
    low = -(1 << bits - 1) if kind(-1).value < 0 else 0
    return rng.choice([low, low + (1 << bits) - 1, 0, 1, rng.randrange(low, low + (1 << bits))])


def same(mine, want):
    if isinstance(want, dict):
        return all(same(mine[k], v) for k, v in want.items() if not k.startswith(("reserved", "pad")))
    if isinstance(want, list):
        return len(mine) == len(want) and all(map(same, mine, want))
    if isinstance(want, float):
        return math.isnan(mine) if math.isnan(want) else mine == want
    return mine == want


@pytest.mark.parametrize("name", SHAPES)
def test_structs_are_read_back(spark, name):
    rng, made, rows, want = random.Random(3), c_struct(SHAPES[name]), [], {}
    for i in range(40):
        value = made()
        want[i] = filled(value, rng)
        rows.append((i, bytearray(bytes(value) + b"more" * (i % 2))))
    rows += [(100, bytearray(SHAPES[name].size - 1)), (101, None)]
    df = wire.decoded(spark.createDataFrame(rows, "i long, payload binary"), SHAPES[name], keep=["i"])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.asDict(True) for r in df.collect()}
    assert len(got) == 42 and all(v is None for i in (100, 101) for k, v in got[i].items() if k != "i")
    for i, w in want.items():
        assert same(got[i], w), (got[i], w)


def test_saved_payloads(spark, tmp_path):
    head = lambda version, shape: struct.pack("<IHHII", 0x4E, 1, version, shape.size, shape.align)
    value = c_struct(wire.NAV_STATE)(t_ns=7, age_ms=5)
    (tmp_path / "a.bin").write_bytes(head(2, wire.NAV_STATE) + bytes(value))
    (tmp_path / "b.bin").write_bytes(head(3, wire.NAV_STATE) + bytes(value))
    (tmp_path / "c.bin").write_bytes(b"xx")
    rows = readers.shared_payloads(spark, str(tmp_path), 0x4E, 1, 2, wire.NAV_STATE).collect()
    assert [(os.path.basename(r.path), int(r.t_ns), r.age_ms) for r in rows] == [("a.bin", 7, 5)]


def test_trace_in_ranges(spark, tmp_path):
    n = 5000
    rows = np.zeros(n, ranges.TRACE_TYPE)
    rows["version"], rows["kind"], rows["sensor_time_ns"], rows["age_ms"] = 1, 1 + np.arange(n) % 7, np.arange(n) * 1000 - 5, 2**32 - 1 - np.arange(n)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(rows.tobytes() + b"half a record")
    (tmp_path / "in" / "b.bin").write_bytes(rows[:3].tobytes())
    (tmp_path / "in" / "c.bin").write_bytes(b"")
    df = ranges.binary_trace(spark, str(tmp_path / "in"), range_bytes=10_000)
    assert df.rdd.getNumPartitions() >= n * 48 // 10_000
    got = df.orderBy("path", "record").collect()
    assert len(got) == n + 3 and [r.record for r in got[:n]] == list(range(n)) and got[17].sensor_time_ns == 16995 and got[17].age_ms == 2**32 - 18
    some = df.filter("kind = 3")
    assert "= 3" not in some._jdf.queryExecution().executedPlan().toString() and some.count() == sum(1 for i in range(n) if i % 7 == 2) + 1
    assert df.filter(F.col("kind").isin(1, 9) & (F.col("record") < 100)).count() == 15 + 1
    ranges.write_trace(some.drop("path", "record"), str(tmp_path / "out"))
    again = ranges.binary_trace(spark, str(tmp_path / "out"))
    assert again.count() == some.count() and again.agg(F.sum("sensor_time_ns")).first()[0] == some.agg(F.sum("sensor_time_ns")).first()[0]
    (tmp_path / "none").mkdir()
    assert ranges.binary_trace(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        ranges.binary_trace(spark, str(tmp_path / "lost")).count()


def test_tails_read_the_end_alone(spark, tmp_path):
    with open(tmp_path / "big.log", "wb") as f:  # 3 GB, all but the end a hole: more than one task could hold
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(b"\nbroken \xff line\n\nlast but one\r\nlast")
    (tmp_path / "small.log").write_text("only")
    (tmp_path / "empty.log").write_text("")
    got = ranges.tails(spark, str(tmp_path / "*.log"), 2, 1000).orderBy("path", "line").collect()
    assert [(os.path.basename(r.path), r.line, r.value) for r in got] == [("big.log", 0, "last but one"), ("big.log", 1, "last"), ("small.log", 0, "only")]
    assert {r.bytes_read for r in got} == {1000, 4}
    (tmp_path / "a.csv").write_text("t,v,w\n" + "".join(f"{i},{i * i}\n" for i in range(1000)))
    (tmp_path / "b.csv").write_text("t,v\n")
    rows = readers.latest_csv_rows(spark, str(tmp_path / "*.csv"), 100).collect()
    assert [(os.path.basename(r.path), r.row) for r in rows] == [("a.csv", {"t": "999", "v": "998001", "w": None})]


def test_yaml_values(spark):
    text = "# c\nlogging:\n  base_dir: 'logs'  # x\n  split_by_date: true\n  deep:\n      level: \"2\"\n\n  after: a: b\nother:\n  a: 1\nlist:\n  - b: 2\nurl: http://x#y\nempty:\na: 3\n"
    table = spark.createDataFrame([(text,), (None,), ("",), ("a:1\r\nb: 2\r\nb: 3",)], "t string")
    got = [[tuple(p) for p in r.v] for r in table.select(tx.yaml_values(F.col("t")).alias("v")).collect()]
    assert got[0] == [("logging.base_dir", "logs"), ("logging.split_by_date", "true"), ("logging.deep.level", "2"), ("logging.after", "a: b"), ("other.a", "1"), ("url", "http://x#y"), ("a", "3")]
    assert got[1:] == [[], [], [("b", "2"), ("b", "3")]]
    assert [r.v for r in table.select(tx.yaml_value(F.col("t"), "b").alias("v")).collect()] == [None, None, None, "3"]


def test_process_states(spark):
    told = ["exit_ok", "start", "started", "exit_failed", "start", "started", "what", "stop", "exit_failed", "start"]
    rows = [(1, i, 10.0 * i, e) for i, e in enumerate(told)] + [(2, 0, 5.0, "start"), (2, 1, 6.0, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.run_id, r._row): r for r in ops.process_states(spark.createDataFrame(rows, "run_id long, _row long, t_s double, event string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = [got[1, i] for i in range(10)]
    assert [r.state for r in mine] == ["not_started", "starting", "running", "failed", "starting", "running", "running", "stopping", "stopped", "starting"]
    assert [r.ignored for r in mine] == [True] + [False] * 5 + [True] + [False] * 3 and [r.restarts for r in mine] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 2]
    assert [r.supervisor for r in mine][3] == "failed" and mine[7].dwell_s == 20.0 and got[2, 1].ignored and got[2, 1].state == "starting"


def test_attitude_over_batches(spark, tmp_path):
    schema = "run_id long, _row long, t_s double, gx double, gy double, gz double"
    rng = random.Random(1)
    rows = [(run, i, 0.1 * i, *(rng.uniform(-2, 2) for _ in range(3))) for run in range(2) for i in range(30)]
    parts = [[r for r in rows if r[1] < 10], [r for r in rows if 10 <= r[1] < 12], [r for r in rows if r[1] >= 12] + [(0, 99, 0.5, 9.0, 9.0, 9.0)]]
    out = stateful.run_once(stateful.attitudes(stream_of(spark, tmp_path, parts, schema)), str(tmp_path / "cp"), str(tmp_path / "out")).collect()
    assert len(out) == 61 and [r._row for r in out if r.status == "late"] == [99]
    for run in range(2):
        turn, last = np.eye(3), None
        for _, i, t, *rate in (r for r in rows if r[0] == run):
            if last:
                v = np.array(last[1]) * (t - last[0])
                a = np.linalg.norm(v)
                k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
                turn = turn @ (np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k)
            last = t, rate
            r = next(r for r in out if (r.run_id, r._row) == (run, i))
            assert np.allclose([r.roll, r.pitch, r.yaw], [math.atan2(turn[2, 1], turn[2, 2]), -math.asin(turn[2, 0]), math.atan2(turn[1, 0], turn[0, 0])], atol=1e-9)


def test_intents_expire_without_a_later_row(spark, tmp_path):
    at = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    zero = int(d.datetime(2024, 1, 1, tzinfo=d.timezone.utc).timestamp() * 1000)
    row = lambda i, run, seq, s, ttl: (run, "gcs", i, seq, at(s), zero + 1000 * s, ttl)
    parts = [[row(0, 1, 5, 0, 3000), row(1, 1, 4, 1, 3000), row(2, 2, 1, 0, 0)], [row(3, 1, 6, 10, 60000)], [row(4, 3, 1, 100, 1000)], [row(5, 3, 2, 400, 1000)]]
    stream = stream_of(spark, tmp_path, parts, "run_id long, source string, _row long, seq long, ts timestamp, stamp_ms long, ttl_ms long")
    out = stateful.run_once(stateful.intent_expiries(stream, 30_000), str(tmp_path / "cp"), str(tmp_path / "out")).collect()
    got = sorted((r.run_id, r.seq, r.status, (r.at_ms - zero) // 1000) for r in out)
    assert got == [(1, 4, "out_of_order", 1), (1, 5, "accepted", 0), (1, 5, "expired", 3), (1, 6, "accepted", 10), (1, 6, "expired", 70), (2, 1, "accepted", 0), (2, 1, "expired", 30), (3, 1, "accepted", 100), (3, 1, "expired", 101), (3, 2, "accepted", 400)]


def test_intents_of_a_shard_take_few_calls(spark, tmp_path):
    """Random intents of 300 sources in four batches, against a plain loop: the calls to the state don't grow with the sources."""
    rng = random.Random(3)
    rows = [(rng.randrange(60), f"s{rng.randrange(5)}", i, 0 if rng.random() < 0.2 else i + rng.randrange(40), 10 * i + rng.randrange(3), rng.choice((0, 50, 900, 20_000))) for i in range(3000)]
    calls, state = [], {}

    class Handle:
        def getValueState(self, name, schema):
            return types.SimpleNamespace(exists=lambda: name in state, get=lambda: state[name], update=lambda v: (calls.append(name), state.update({name: v})))

        def registerTimer(self, at):
            calls.append("register")
            state["timer"] = at

        def deleteTimer(self, at):
            calls.append("delete")
            assert state.pop("timer") == at

    intents, out, mark = stateful.Intents(700), [], 0
    intents.init(Handle())
    for i in range(0, 3000, 750):
        values = types.SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        part = pd.DataFrame(rows[i : i + 750], columns=["run_id", "source", "nth", "seq", "stamp_ms", "ttl_ms"]).sample(frac=1, random_state=i)
        out += intents.handleInputRows((0,), iter([part[:100], part[100:]]), values)
        if state.get("timer", mark + 1) <= mark:
            info = types.SimpleNamespace(getExpiryTimeInMs=lambda at=state.pop("timer"): at)
            out += intents.handleExpiredTimer((0,), values, info)
        mark = int(part["stamp_ms"].max()) - 1
    got, want, newest, live = sorted(tuple(r) for t in out for r in t.itertuples(index=False)), [], {}, {}
    for run, source, _, seq, stamp, ttl in sorted(rows, key=lambda r: (r[4], r[2])):
        key = run, source
        if key in newest and seq <= newest[key]:
            want.append((*key, seq, stamp, "out_of_order", stamp))
            continue
        if key in live and stamp > live[key][2]:
            want.append((*key, *live[key][:2], "expired", live[key][2]))
        newest[key], live[key] = seq, (seq, stamp, stamp + (ttl or 700))
        want.append((*key, seq, stamp, "accepted", stamp))
    last = int(max(r[4] for r in rows[2250 - 750 : 2250])) - 1  # the last batch's watermark
    want += [(*key, *x[:2], "expired", x[2]) for key, x in live.items() if x[2] <= last]
    assert got == sorted(want) and len(calls) < 40


def test_slices_are_batches(spark, tmp_path):
    from tidewake.plans.systems_queries import _slices

    stream, folder = _slices(spark, spark.range(4000).repartition(12), "id")
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [1000] * 4


def test_lines_are_counted_as_their_kinds(spark):
    rng = random.Random(5)
    bits = ["", " ", "  ", "#", " # x", '"""', ' """ a', 'b """ c', '"""d"""', "x", "  y", "//", " // z", "/*", "*/", "/* e */", "f */", "\r", "\t", "\u00a0"]
    texts = [None, "", "\n", *("\n".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for language in ("python", "cpp", "shell", "yaml", "other"):
        kinds, counts = tx.line_kinds(F.col("text"), language), tx.line_counts(F.col("text"), language)
        got = rows.select(*(tx.count_of(kinds, k) for k in ("code", "comment", "blank")), counts.n - counts.comment - counts.blank, counts.comment, counts.blank).collect()
        assert [r[:3] for r in got] == [r[3:] for r in got]
    sizes = audit.file_sizes(spark.createDataFrame([("a.py", '"""\n' + "x\n" * 60_000)], "path string, text string"))
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(lambda" not in plan and sizes.first()[2:5] == (0, 60_001, 1)  # no array grows with each line


def test_report_of_all_tables(spark, tmp_path):
    files = spark.createDataFrame([("nav/a.py", "# TODO x\ndef f():\n    if x:\n        return 1\n" + "    pass\n" * 90), ("nav/b.cpp", "int add(int a) {\n  return a;\n}\n"), ("c.sh", "# s\necho\n"), ("empty.py", None)], "path string, text string")
    changes = spark.createDataFrame([("nav/a.py", 4), ("gone.py", 9)], "path string, changes long")
    tables = audit.report_tables(files, changes)
    text = "\n".join(sinks.markdown(t, title) for title, t in tables.items())
    assert [title for title in tables if f"## {title}" not in text] == [] and "| nav/a.py | f | 2 |" in text and "| nav | 2 |" in text
    profile = {r.directory: r for r in tables["Directory Risk Profile"].collect()}
    assert set(profile) == {"nav", "."} and profile["nav"].todo == 1 and profile["nav"].changes == 4 and abs(sum(r.code_pct for r in profile.values()) - 100) < 1e-9
    assert tables["Hotspots"].count() == 1 and audit.report_tables(files.limit(0), changes)["Language Breakdown"].count() == 0


def test_preflight_and_snapshot(spark):
    scans = spark.createDataFrame([(1, "bench", {"imu": 1}, {}, "auto", "nav", ["a"], [], None), (2, "control_only", {}, {"imu": "x"}, "auto", "odd", ["a"], ["e"], ["w"])], "run_id long, runtime string, counts map<string,int>, bindings map<string,string>, requested string, selected string, ambiguous array<string>, errors array<string>, warnings array<string>")
    rows = {(r.run_id, r.title): r for r in ops.preflight(scans).collect()}
    assert not rows[1, "device_binding_ambiguity"].ok and rows[2, "device_binding_ambiguity"].ok and rows[1, "startup_profile_gate"].ok and (1, "device_scan_risks") not in rows
    assert rows[2, "startup_profile"].detail.endswith("launch_mode=- nav_requirement=-") and rows[2, "device_recommendations"].detail == "imu=x"
    table = spark.createDataFrame([(1, 0.0, 0, 1.0, None), (1, 1.0, 1, 2.0, float("nan")), (2, 0.0, 0, None, None)], "run_id long, t_s double, _row long, v double, d double")
    got = {r.run_id: (r.state, r.available_fields, r.summary) for r in ops.motion_snapshot(table, {"velocity": ["v"], "depth": ["d"]}).collect()}
    assert got == {1: ("available", "velocity", "velocity=2.000"), 2: ("unavailable", "", "")}


def test_bundle_summary(spark):
    runs = spark.createDataFrame([(1, "failed", "preflight_failed"), (2, "stopped", None), (3, None, None), (4, "running", None), (5, "failed", "preflight_failed")], "bundle long, supervisor_state string, last_fault_event string")
    every = [(1, key, False, True) for key in ops.MERGE_INPUTS.values()]
    rows = [*every, (1, "supervisor.run_manifest", True, True), (2, "supervisor.run_manifest", True, None), (2, "nav.nav_state", None, True), (2, "nav.nav_state", False, False), (2, "child_logs.b", False, False), (2, "child_logs.a", False, False)]
    artifacts = spark.createDataFrame(rows, "bundle long, key string, required boolean, copied boolean")
    processes = spark.createDataFrame([(1, "p", "not_started"), (1, "q", "not_started"), (2, "p", "failed"), (2, "q", None), (5, "p", "not_started"), (5, "q", None)], "bundle long, process string, state string")
    got = {r.bundle: r for r in ops.bundle_summary(runs, artifacts, processes).collect()}
    assert [got[i].run_stage for i in range(1, 6)] == ["preflight_failed_before_spawn", "child_process_stopped_after_start", "run_created_without_child_start", "child_process_running", "run_created_without_child_start"]
    assert (got[1].bundle_status, got[1].merge_ready, got[1].merge_missing, got[1].required_ok) == ("complete", True, "", True)
    assert (got[2].bundle_status, got[2].required_ok, got[2].missing_required, got[2].missing_optional) == ("incomplete", False, "supervisor.run_manifest", "child_logs.a,child_logs.b")
    assert got[2].merge_missing == "nav_timing,control_log,telemetry_timeline,telemetry_events" and got[2].hints[1].startswith("required")
    assert got[3].bundle_status == "complete" and not got[3].merge_ready and got[3].hints[0] == ops.STAGE_HINTS["run_created_without_child_start"]
    assert ops.bundle_summary(runs.limit(0), artifacts, processes).count() == 0


def test_fixed_texts_are_those_of_c(spark):
    values = [0.0625, 0.1875, 1.0005, 2.0015, -0.0625, -0.0, -0.0001, 12345.6785, 1e6, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double").select("i", col.fixed(F.col("v"), 3).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["%.3f" % v for v in values] + [None]


def _still(folder):
    """Events whose last value of a run is 0.0, where the cosine or sine is negative, or a value that only rounds to zero; returns the SQL's connection."""
    rows = [(i, i, v, k) for i, (v, k) in enumerate([(0.0, 10), (0.0, 40), (0.0, 60), (0.0, 90), (0.01, 40), (-0.0, 10), (3.0, 50), (3.0, 75)])]
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(u AS BIGINT) AS user_id, 'purchase' AS event_type, CAST(v AS DOUBLE) AS value, '{{"k": ' || k || '}}' AS props
                    FROM (VALUES {", ".join(f"({i}, {u}, '{v}'::DOUBLE, {k})" for i, u, v, k in rows)}) r(i, u, v, k)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


@pytest.mark.parametrize("name, column", [("o08_motion_snapshot", "velocity"), ("o08_motion_summary", "summary")])
def test_a_last_velocity_of_zero_has_no_sign(spark, tmp_path, name, column):
    con = _still(tmp_path)
    got = {r.run_id: r[column] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(f"SELECT run_id, {column} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    assert any("-0.000" in t for t in got.values()) and sum("-0.000" not in t for t in got.values()) >= 4


def test_digits_of_a_number_are_read_once(spark):
    """Inside lambdas Spark computes an expression as often as it is written: two readings for a double, one for each type of whole numbers."""
    blobs = spark.createDataFrame([(bytes(wire.NAV_STATE.size),)], "payload binary")
    plan = wire.decoded(blobs, wire.NAV_STATE)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("conv(") <= 6
