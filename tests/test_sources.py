"""Readers and writers on small files, and the streaming forms against their batch results."""


import struct

import pytest
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.operators import audit, devices
from tidewake.sources import ranges, readers, sinks
from tidewake.streaming import replay


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MonoNS,AccX,extra\n1,0.5,x\n2,NaN,y\n3,bad,z\n")
    df = readers.scan_csv(spark, str(tmp_path / "a.csv"), ["MonoNS", "AccX"], text=["extra"])
    assert [(r._row, r.MonoNS, r.AccX, r.extra) for r in df.orderBy("_row").collect()] == [(1, 1, 0.5, "x"), (2, 2, None, "y"), (3, 3, None, "z")]
    with pytest.raises(KeyError):
        readers.scan_csv(spark, str(tmp_path / "a.csv"), ["GyroX"])


def test_parsed_velocities_are_clamped(spark, tmp_path):
    (tmp_path / "p.csv").write_text("EstS,SensorID,Src,Ve_enu(m_s),De_enu(m)\n10,DVL_H1000,BE,1.5,3\n12,DVL_H1000,BE,9,300\n12,OTHER,BE,1,1\n13,DVL_H1000,XX,1,1\n")
    rows = readers.scan_parsed_dvl(spark, str(tmp_path / "p.csv")).orderBy("t_s").collect()
    assert [(r.t_s, r["Ve_enu(m_s)"], r["De_enu(m)"]) for r in rows] == [(0.0, 1.5, 3.0), (2.0, 0.0, 0.0)]


def test_catalog(spark):
    cat = readers.run_catalog(spark, [{"run_id": "a", "date": "1", "note": "n"}, {"run_id": "b"}], [{"run_id": "a", "date": "2"}])
    assert readers.pick_run(cat, "a")["date"] == "2" and readers.pick_run(cat, "a")["note"] == "n"
    with pytest.raises(KeyError):
        readers.pick_run(cat, "c")


def test_trace_and_payload(spark, tmp_path):
    rec = struct.pack("<BBHIqqqqII", 1, 2, 3, 0, 10, 20, 30, 40, 5, 6)
    assert len(rec) == 48
    (tmp_path / "t.bin").write_bytes(rec * 2 + b"xx")
    rows = ranges.binary_trace(spark, str(tmp_path / "t.bin")).orderBy("record").collect()
    assert [(r.record, r.kind, r.publish_mono_ns, r.age_ms) for r in rows] == [(0, 2, 40, 5), (1, 2, 40, 5)]
    good, bad = struct.pack(readers.PAYLOAD, 7, 1, 2, 4, 8) + b"abcd", struct.pack(readers.PAYLOAD, 7, 1, 3, 4, 8) + b"abcd"
    blobs = spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(bad))], "path string, content binary")
    assert [(r.path, bytes(r.payload)) for r in readers.checked_payloads(blobs, 7, 1, 2, 4, 8).collect()] == [("g", b"abcd")]


def test_source_tree_and_tail(spark, tmp_path):
    (tmp_path / "src" / ".git").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("def f():\n    if x:\n        return 1\n\ndef g():\n    pass\n")
    (tmp_path / "src" / ".git" / "b.py").write_text("x = 1\n")
    (tmp_path / "src" / "c.bin").write_text("no")
    files = readers.source_tree(spark, str(tmp_path / "src"), ["py"])
    assert [r.path for r in files.collect()] == ["a.py"]
    spans = audit.function_spans(files).orderBy("line").collect()
    assert [(r.name, r.line, r.lines) for r in spans] == [("f", 1, 4), ("g", 5, 3)] and spans[0].nest == 2
    (tmp_path / "log.txt").write_text("\n".join(map(str, range(100))) + "\n")
    assert [r.value for r in readers.text_tail(spark, str(tmp_path / "log.txt"), 3).orderBy("line").collect()] == ["97", "98", "99"]
    assert readers.latest_file(spark, str(tmp_path / "src" / "*.py")).endswith("a.py")


def test_cpp_spans_and_block_comments(spark):
    cpp = "int add(int a, int b) {\n  if (a) {\n    return b;\n  }\n  return a;\n}\n\n/* one\ntwo */\n// three\nvoid g() {}\n"
    files = spark.createDataFrame([("m/a.cpp", cpp)], "path string, text string")
    assert [(r.name, r.lines, r.nest) for r in audit.function_spans(files).orderBy("line").collect()] == [("add", 6, 1), ("g", 1, 0)]
    size = audit.file_sizes(files).first()
    assert (size.code, size.comment, size.blank, size.language) == (7, 3, 2, "cpp")


def test_checksum_frames(spark):
    body = bytes([0x55, 0x61, 1, 2, 3, 4, 5, 6, 7, 8])
    frame = body + bytes([sum(body) & 0xFF])
    df = spark.createDataFrame([(bytearray(b"zz" + frame + b"\x55" + b"0" * 12),)], "data binary")
    got = df.select(tx.frames_with_checksum(F.col("data")).alias("f")).first().f
    assert (got.valid, got.loose) == (1, 2)


def test_sinks(spark, tmp_path):
    path = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0, 0.5)], "run_id long, t_s double, E double, N double, U double, yaw_rad double")
    sinks.write_trajectory(path, str(tmp_path / "traj"))
    assert abs(sinks.read_trajectory(spark, str(tmp_path / "traj")).first().yaw_rad - 0.5) < 1e-12
    sinks.append_events(spark.createDataFrame([(5, "start")], "mono_ns long, event string"), str(tmp_path / "ev"))
    sinks.append_events(spark.createDataFrame([(6, "stop")], "mono_ns long, event string"), str(tmp_path / "ev"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ev")).count() == 2
    assert "| 1 |" in sinks.markdown(path, "t")
    assert sinks.processed_imu_columns(path, ["yaw_rad"]).columns[0] == "yaw_rad"


def stream_of(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_replay_keeps_state_and_flags_late_rows(spark, tmp_path):
    schema = "run_id long, _row long, t_s double, kind string, gz double, vE double, vN double"
    parts = [[(1, 0, 0.0, "IMU", 0.1, 0.0, 0.0), (1, 1, 1.0, "BE", 0.0, 2.0, 1.0)], [(1, 2, 0.5, "IMU", 9.0, 0.0, 0.0), (1, 3, 2.0, "BE", 0.0, 2.0, 1.0)]]
    out = replay.run_once(replay.replayed(stream_of(spark, tmp_path, parts, schema), 5.0), str(tmp_path / "cp"), str(tmp_path / "out")).orderBy("_row").collect()
    assert [r.status for r in out] == ["used", "used", "late", "used"]
    assert abs(out[-1].yaw - 0.2) < 1e-12 and out[-1].E == 4.0 and out[-1].N == 2.0


def test_sliding_correction(spark, tmp_path):
    schema = "run_id long, _row long, t_s double, dvE double, dvN double"
    parts = [[(1, 0, 0.0, 1.0, 0.0), (1, 1, 3.0, 3.0, 0.0)], [(1, 2, 7.0, 5.0, 2.0)]]
    out = replay.run_once(replay.sliding_correction(stream_of(spark, tmp_path, parts, schema)), str(tmp_path / "cp"), str(tmp_path / "out")).orderBy("_row").collect()
    assert [(r.correction_e, r.held) for r in out] == [(1.0, 1), (2.0, 2), (4.0, 2)]


def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    schema = "run_id long, ts timestamp, value double"
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1) + d.timedelta(minutes=m)
    rows = [(1, at(i), float(i)) for i in range(10)] + [(1, at(500), 0.0)]
    stream = stream_of(spark, tmp_path, [rows, [(1, at(900), 0.0)]], schema)
    out = replay.run_once(replay.tumbling(stream, "5 minutes"), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert [(r.n, r.mean) for r in out.orderBy("start").collect()][:2] == [(5, 2.0), (5, 7.0)]
    sessions = replay.sessions(spark.createDataFrame(rows, schema), "10 minutes").orderBy("start").collect()
    assert [r.n for r in sessions] == [10, 1]
    assert replay.deduplicated(spark.createDataFrame(rows + rows, schema), ["run_id", "ts"]).count() == 11


def test_samples_of_devices(spark):
    """Excerpts in the shape of the devices' exports; a mixture is claimed by several types."""
    imu = "MonoNS,EstNS,MonoS,EstS,t_unix,AccX,AccY,AccZ,AsX,AsY,AsZ,HX,HY,HZ,AngX,AngY,AngZ,TemperatureC\n1,2,3,4,5,0.1,0.1,0.9,0,0,0,1,2,3,4,5,6,\n"
    dvl = 'Timestamp(s),SensorID,RawLine,CmdOrNote\n5.1,DVL_H1000,":TS000101+88888,V",\n5.2,DVL_H1000,":BE,+88888,V",\n5.3,DVL_H1000,":BD +888:SA, +3.0",RESP\n5.4,DVL_H1000,":BI,+8",\n5.5,DVL_H1000,":BS,+8",\n'
    volt = "Timestamp," + ",".join(f"CH{i}" for i in range(16)) + "\n2024-06-18 04:38:40," + ",".join(["1.433V", "0.000A"] * 8) + "\n"
    lines = "\n".join(f"CH{i}: 1.{i} V" for i in range(16))
    frame = bytes([0x55, 0x51, 1, 2, 3, 4, 5, 6, 7, 8])
    frame += bytes([sum(frame) & 0xFF])
    texts = {"imu": imu, "dvl": dvl, "volt": volt, "none": "serial debug\nheartbeat: 42\n", "mixed": dvl + "\n" + lines, "echo": "CS 1\nCZ\n", "usbl": "an USBL unit", "empty": ""}
    rows = [(k, bytearray(v.encode())) for k, v in texts.items()] + [("frames", bytearray(frame * 3)), ("null", None), ("bad", bytearray(b"\xff\xfe"))]
    got = {}
    for r in devices.classified(spark.createDataFrame(rows, "identity string, content binary")).collect():
        got.setdefault(r.identity, {})[r.type] = r
    assert set(got) == {"imu", "dvl", "volt", "mixed", "echo", "usbl", "frames"}
    assert abs(got["imu"]["imu"].score - 0.87) < 1e-9 and got["imu"]["imu"].support == "sample_backed" and set(got["imu"]) == {"imu"}
    assert got["dvl"]["dvl"].score >= 0.85 and got["dvl"]["dvl"].detector == "dvl_reply_tokens" and set(got["dvl"]["dvl"].evidence.split(",")) <= {"TS", "BE", "SA", "BI", "BS", "BD"}
    assert abs(got["volt"]["volt32"].score - 0.87) < 1e-9
    assert {"dvl", "volt32"} <= set(got["mixed"]) and abs(got["mixed"]["volt32"].score - got["mixed"]["dvl"].score) < 0.12
    assert got["echo"]["dvl"].score == 0.40 and got["echo"]["dvl"].support == "candidate_only" and got["usbl"]["usbl"].score == 0.60
    assert got["frames"]["imu"].detector == "imu_legacy_wit_sync" and abs(got["frames"]["imu"].score - 0.59) < 1e-9


def test_processed_loader_is_strict(spark, tmp_path):
    (tmp_path / "p.csv").write_text("t_s,AccX_mps2,AccY_mps2,AccZ_mps2,GyroX_rad_s,GyroY_rad_s,GyroZ_rad_s\n0,1,2,3,4,5,6\n")
    with pytest.raises(KeyError):
        readers.scan_processed_imu(spark, str(tmp_path / "p.csv"))
    row = readers.scan_processed_imu(spark, str(tmp_path / "p.csv"), strict=False).first()
    assert (row.gx, row.gz, row.yaw_nav_rad) == (4.0, 6.0, None)
    (tmp_path / "e.csv").write_text("EstS,Src\n")
    with pytest.raises(ValueError):
        readers.scan_sorted(spark, str(tmp_path / "e.csv"))


def test_extended_trajectory_and_reports(spark, tmp_path):
    path = spark.createDataFrame([(1, float(i), i, 1.0, 2.0, 3.0) for i in range(4)], "run_id long, t_s double, _row long, E double, N double, U double")
    yaw = spark.createDataFrame([(1, float(i), i, 0.1 * i, "BI") for i in range(2)], "run_id long, t_s double, _row long, yaw_rad double, src string")
    sinks.write_extended_trajectory(path, str(tmp_path / "x"), yaw)
    rows = sinks.read_trajectory(spark, str(tmp_path / "x")).orderBy("t_s").collect()
    assert [round(r.yaw_rad, 3) for r in rows] == [0.0, 0.1, 0.1, 0.1] and {r.src for r in rows} == {"BI"}
    sinks.write_report(path.select("E"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4
    for report in (lambda: sinks.markdown(path, "t", 3), lambda: sinks.report_json(path, 3)):
        with pytest.raises(ValueError):
            report()
    with pytest.raises(ValueError):
        audit.graph_text(spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "module string, target string, n long"), 1)


def test_cycles_of_any_length(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 11) for i in range(11)] + [(3, 1), (1, 0)], "module long, target long")
    got = {r.cycle: r.length for r in audit.cycles(edges).collect()}
    assert got == {">".join(map(str, range(11))): 11, "1>2>3": 3} and audit.cycles(edges, 5).count() == 1


def test_parts_of_a_folder_are_one_log(spark, tmp_path):
    for name, rows in (("part-0.csv", "10,DVL_H1000,BE,1\n"), ("part-1.csv", "12,DVL_H1000,BE,1\n"), ("other.csv", "13,DVL_H1000,BE,1\n")):
        (tmp_path / name).write_text("EstS,SensorID,Src,Ve_enu(m_s)\n" + rows)
    assert [r.t_s for r in readers.scan_parsed_dvl(spark, str(tmp_path)).orderBy("EstS").collect()] == [0.0, 2.0, 0.0]


def test_equal_times_come_in_the_order_asked_for(spark, tmp_path):
    (tmp_path / "s.csv").write_text("EstS,Src,event\n1,a,3\n1,a,2\n0,b,4\n1,a,1\n")
    assert [r.event for r in readers.scan_sorted(spark, str(tmp_path / "s.csv"), then=("event",)).collect()] == [4.0, 1.0, 2.0, 3.0]
    assert [r.event for r in readers.scan_sorted(spark, str(tmp_path / "s.csv")).collect()] == [4.0, 3.0, 2.0, 1.0]


def test_planar_inputs_of_many_runs_in_a_file(spark, tmp_path):
    (tmp_path / "b.csv").write_text("run_id,t_s,Ve_enu(m_s),Vn_enu,Vu_enu(m_s)\na,1,0.1,0,0\nb,1,0.2,0,0\na,1,0.3,0,0\nb,2,bad,0,0\n")
    rows = readers.scan_planar_inputs(spark, str(tmp_path / "b.csv"), "be", run="run_id").orderBy("run_id").collect()
    assert [(r.run_id, r.t_s, r.vE) for r in rows] == [("a", 1.0, 0.1), ("b", 1.0, 0.2)]


def test_trajectories_of_many_runs_share_files(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as run_id", "1.0D as t_s", "id * 0.5D as E", "0.0D as N", "0.0D as U", "0.5D as yaw_rad")
    sinks.write_trajectory(rows.coalesce(2), str(tmp_path / "t"), by=())
    assert len(list((tmp_path / "t").rglob("*.csv"))) == 2
    assert sinks.read_trajectory(spark, str(tmp_path / "t")).selectExpr("count(distinct run_id)", "sum(E)").first()[:] == (200, 9950.0)


def test_ends_of_many_files_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.csv").write_text(f"a\n0\n{i}\n")
    made = ranges.tails(spark, str(tmp_path), 1, 100, header=True)
    assert made.rdd.getNumPartitions() <= 75
    assert sorted(int(r.value) for r in made.collect()) == list(range(300))
