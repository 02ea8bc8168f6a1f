"""Readers of sensor logs, catalogues, source trees and binary traces."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.columns import finite, resolve, seconds
from tidewake.functions.text import readable, yaml_values
from tidewake.sources import ranges, wire

# The columns of the logs and of trace records.
IMU_COLUMNS = ("MonoNS", "EstNS", "MonoS", "EstS", "AccX", "AccY", "AccZ", "GyroX", "GyroY", "GyroZ", "YawDeg", "AngX", "AngY", "AngZ")
DVL_COLUMNS = (
    "MonoNS", "EstNS", "MonoS", "EstS", "SensorID", "Src", "Vx_body(m_s)", "Vy_body(m_s)", "Vz_body(m_s)", "Ve_enu(m_s)", "Vn_enu(m_s)", "Vu_enu(m_s)",
    "De_enu(m)", "Dn_enu(m)", "Du_enu(m)", "Depth(m)", "E(m)", "N(m)", "U(m)", "Valid", "ValidFlag", "IsWaterMass",
)
TEXTS = {"SensorID", "Src", "Valid", "ValidFlag", "IsWaterMass"}


def scan_csv(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str], *, text: Sequence[str] = (), missing: Sequence[str] = ("", "NaN", "nan")) -> DataFrame:
    """CSV logs with a header: required columns are checked, extra ones kept, numbers read as such.

    All columns are read as text and cast, so a bad cell is null instead of an error. Adds
    ``source_path`` and ``_row``, an ordinal in order of files and of lines within them.
    """
    raw = spark.read.option("header", True).csv(paths if isinstance(paths, str) else list(paths))
    names = [c.strip().lstrip("﻿") for c in raw.columns]
    raw = raw.toDF(*names)
    lacking = [c for c in required if c not in names]
    if lacking:
        raise KeyError(f"columns {lacking} are missing; there are {names}")
    raw = raw.withColumns({"source_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    # lines are counted by block of a file, so that a large file isn't one task
    blocks = raw.groupBy("source_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    blocks = blocks.withColumn("_before", F.sum("_n").over(W.partitionBy("source_path").orderBy("_block")) - F.col("_n")).drop("_n")
    for c in names:
        cell = F.col(f"`{c}`")
        cell = F.when(~F.trim(cell).isin(*missing), F.trim(cell))
        raw = raw.withColumn(c, cell if c in text else cell.try_cast("long" if c.endswith("NS") else "double"))
    numbered = raw.join(blocks, ["source_path", "_block"]).withColumn("_row", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long"))
    return numbered.select(*(F.col(f"`{c}`") for c in names), "source_path", "_row")


def scan_imu(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return scan_csv(spark, paths, IMU_COLUMNS)


def scan_dvl(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return scan_csv(spark, paths, DVL_COLUMNS, text=sorted(TEXTS), missing=("",))


def scan_parsed_dvl(spark: SparkSession, paths: str | Sequence[str], sensor: str = "DVL_H1000") -> DataFrame:
    """Parsed velocity logs of one sensor: known sources only, seconds from the log's start, outliers clamped by unit.

    Part files that Spark wrote into a folder are one log; other files are a log each.
    """
    from tidewake.functions.columns import clamp_by_unit

    rows = scan_csv(spark, paths, ("SensorID", "Src"), text=sorted(TEXTS))
    rows = rows.filter((F.col("SensorID") == sensor) & F.col("Src").isin("SA", "TS", "BI", "BS", "BE", "BD"))
    time = next(c for c in ("EstS", "MonoS", "Timestamp(s)") if c in rows.columns)
    rows = rows.withColumn("_log", F.regexp_replace("source_path", "/part-[^/]*$", ""))
    starts = rows.groupBy("_log").agg(F.min(f"`{time}`").alias("_start"))  # not a window, so that a long log isn't one task
    rows = rows.join(starts, "_log").withColumn("t_s", F.col(f"`{time}`") - F.col("_start"))
    return clamp_by_unit(rows.drop("_log", "_start"))


def scan_sorted(spark: SparkSession, paths: str | Sequence[str], text: Sequence[str] = ("Src",), then: Sequence[str] = ()) -> DataFrame:
    """A log with ``t_s`` from its first time column, in order of time; ValueError if it holds no row.

    Equal times come in order of the columns ``then``, and then as files and lines come.
    """
    rows = scan_csv(spark, paths, (), text=text)
    rows = rows.withColumn("t_s", seconds(rows))
    if rows.isEmpty():
        raise ValueError(f"no rows in {paths}")
    return rows.orderBy("t_s", *(f"`{c}`" for c in then), "source_path", "_row")


def scan_processed_imu(spark: SparkSession, paths: str | Sequence[str], *, gyro: str = "in", strict: bool = True) -> DataFrame:
    """(source_path, _row, t_s, ax, ay, az, gx, gy, gz, yaw_nav_rad, yaw_device_rad) of processed inertial logs.

    The filter needs rates that no threshold has cut, ``Gyro*_in_rad_s``: with ``strict`` a log without
    them is a KeyError, else the output rates stand in. ``gyro="out"`` asks for those of the output
    (``Gyro*_out_rad_s``, or ``Gyro*_rad_s`` in old logs). Yaws that aren't there are null.
    """
    rows = scan_csv(spark, paths, ("t_s", "AccX_mps2", "AccY_mps2", "AccZ_mps2"))
    family = lambda form: [form.format(a) for a in "XYZ"]
    there = {k: next((n for n in map(family, forms) if set(n) <= set(rows.columns)), None) for k, forms in {"in": ["Gyro{}_in_rad_s"], "out": ["Gyro{}_out_rad_s", "Gyro{}_rad_s"]}.items()}
    if strict and there["in"] is None:
        raise KeyError("Gyro*_in_rad_s is missing, and thresholded rates mustn't drive the filter")
    names = there[gyro] or there["out"] or there["in"]
    if names is None:
        raise KeyError(f"no gyro columns in {rows.columns}")
    yaw = (F.col(c).alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in ("yaw_nav_rad", "yaw_device_rad"))
    return rows.select("source_path", "_row", "t_s", *(F.col(f"Acc{a}_mps2").alias(f"a{a.lower()}") for a in "XYZ"), *(F.col(n).alias(f"g{a}") for n, a in zip(names, "xyz")), *yaw)


# The names under which the planar filter's inputs may come, best first.
PLANAR_INPUTS = {
    "imu": {"ax": ("AccX_mps2", "AccX"), "ay": ("AccY_mps2", "AccY"), "az": ("AccZ_mps2", "AccZ"), "gz": ("GyroZ_in_rad_s", "GyroZ_rad_s", "GyroZ"), "roll": ("roll_rad",), "pitch": ("pitch_rad",), "yaw": ("yaw_nav_rad", "yaw_rad")},
    "bi": {"vx": ("Vx_body(m_s)", "Vx_body"), "vy": ("Vy_body(m_s)", "Vy_body"), "vz": ("Vz_body(m_s)", "Vz_body")},
    "be": {"vE": ("Ve_enu(m_s)", "Ve_enu"), "vN": ("Vn_enu(m_s)", "Vn_enu"), "vU": ("Vu_enu(m_s)", "Vu_enu")},
}


def scan_planar_inputs(spark: SparkSession, paths: str | Sequence[str], kind: str, run: str | None = None) -> DataFrame:
    """One input of the planar filter, ``imu``, ``bi`` or ``be``: (source_path, _row, t_s, ...).

    Rows with a time or value that isn't a finite number are dropped; of equal times of a file the first row stays. Where files hold many
    runs, ``run`` is the column that tells them apart; it is kept, and of equal times of a run the first row stays.
    """
    rows = scan_csv(spark, paths, (run,) if run else (), text=(run,) if run else ())
    wanted = {to: resolve(rows, names) for to, names in PLANAR_INPUTS[kind].items()}
    own = ["source_path"] if run is None else [run]
    kept = [finite(seconds(rows)).alias("t_s"), *(finite(F.col(f"`{c}`")).alias(to) for to, c in wanted.items())]
    rows = rows.select("source_path", *own[: run is not None], "_row", *kept).dropna()
    first = F.row_number().over(W.partitionBy(*own, "t_s").orderBy("source_path", "_row"))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")


def scan_update_diag(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Diagnostics of filter updates: r_dim and S_dim are counted from r0..r5 and S0..S5 where the log has none.

    Headers lose byte order marks and blanks, empty cells are null. KeyError without t_s, name, nis or any residual.
    """
    rows = scan_csv(spark, paths, ("t_s", "name", "nis"), text=("name",))
    of = lambda p: [f"{p}{i}" for i in range(6) if f"{p}{i}" in rows.columns]
    if not of("r"):
        raise KeyError(f"no residuals r0..r5 in {rows.columns}")
    for p in ("r", "S"):
        counted = sum((F.col(c).isNotNull().cast("int") for c in of(p)), F.lit(0))
        known = F.coalesce(F.col(f"{p}_dim").cast("int"), F.lit(0)) if f"{p}_dim" in rows.columns else counted
        rows = rows.withColumn(f"{p}_dim", known)
    return rows


def run_catalog(spark: SparkSession, specs: Sequence[dict] | DataFrame, overrides: Sequence[dict] | DataFrame = ()) -> DataFrame:
    """(run_id, imu, dvl, date, note) from runs, a list or a table; overrides (run_id, date, note) win where they have a value."""

    def table(rows: Sequence[dict] | DataFrame, *names: str) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in names))
        return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"{n} string" for n in names))

    meta = table(overrides, "run_id", "date", "note").toDF("run_id", "m_date", "m_note")
    joined = table(specs, "run_id", "imu", "dvl", "date", "note").join(meta, "run_id", "left")
    return joined.select("run_id", "imu", "dvl", F.coalesce("m_date", "date").alias("date"), F.coalesce("m_note", "note").alias("note"))


def pick_run(catalog: DataFrame, run_id: str) -> dict:
    row = catalog.filter(F.col("run_id") == run_id).first()
    if row is None:
        raise KeyError(run_id)
    return row.asDict()


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The last path of a glob in order of names; contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).agg(F.max("path").alias("p")).first().p


def source_tree(spark: SparkSession, root: str, extensions: Sequence[str], skip: Sequence[str] = (".git", "build", "__pycache__"), most: int | None = None) -> DataFrame:
    """(path, text) of source files under ``root``; hidden and skipped folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}").load(root)
    inside = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(root.rstrip('/').split(':')[-1]) + 2})")
    parts = F.split(inside, "/")
    hidden = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: p.startswith(".") | p.isin(*skip)) & (F.size(parts) > 1)
    rows = files.filter(~hidden).select(inside.alias("path"), readable(F.col("content")).alias("text"))
    return rows if most is None else rows.orderBy("path").limit(most)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def serial_inventory(identities: DataFrame) -> DataFrame:
    """One row per real device of (path, canonical, priority, attributes...): the first non-null value by priority wins."""
    order = W.partitionBy("canonical").orderBy("priority", "path").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = [c for c in identities.columns if c not in ("canonical", "priority")]
    rows = identities.withColumns({f"_{c}": F.first(c, ignorenulls=True).over(order) for c in rest})
    rank = F.row_number().over(W.partitionBy("canonical").orderBy("priority", "path"))
    return rows.withColumn("_rank", rank).filter("_rank = 1").select("canonical", *(F.col(f"_{c}").alias(c) for c in rest))


PAYLOAD = "<IHHII"  # magic, layout version, payload version, payload size, payload alignment


def checked_payloads(blobs: DataFrame, magic: int, layout: int, version: int, size: int, align: int) -> DataFrame:
    """Payload bytes of blobs (path, content) whose header fits; others are left out."""
    text = F.hex("content")
    wants = struct.pack(PAYLOAD, magic, layout, version, size, align).hex().upper()
    head = struct.calcsize(PAYLOAD)
    fits = text.startswith(wants) & (F.length("content") >= head + size)
    return blobs.filter(fits).select("path", F.substring(F.col("content"), head + 1, size).alias("payload"))


def shared_payloads(spark: SparkSession, path: str, magic: int, layout: int, version: int, shape: wire.Layout) -> DataFrame:
    """(path, fields of ``shape``) of the saved payloads under ``path`` whose header fits the struct; others are left out."""
    blobs = spark.read.format("binaryFile").load(path).select("path", "content")
    return wire.decoded(checked_payloads(blobs, magic, layout, version, shape.size, shape.align), shape, keep=["path"])


def text_tail(spark: SparkSession, path: str, lines: int = 40, most_bytes: int = 32 << 10) -> DataFrame:
    """(line, value): the last lines of a log that aren't empty, from its last ``most_bytes`` bytes."""
    return ranges.tails(spark, path, lines, most_bytes).select("line", "value")


def latest_csv_rows(spark: SparkSession, path: str, most_bytes: int = 32 << 10) -> DataFrame:
    """(path, row): the last row of each CSV log under ``path`` as a map from its header, from the ends of the files alone.

    Cells hold no commas or quotes, as the logs' don't. Columns beyond the row's cells are null, cells beyond the header are left out.
    """
    last = ranges.tails(spark, path, 1, most_bytes, header=True)
    names, cells = F.split("header", ","), F.split("value", ",")
    clean = lambda x: F.trim(F.regexp_replace(x, "^\ufeff", ""))
    pairs = F.transform(names, lambda n, i: F.struct(clean(n), F.trim(F.get(cells, i))))
    return last.select("path", F.map_from_entries(pairs).alias("row"))


def config_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of the small YAML files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.inline(yaml_values(readable(F.col("content")))))
