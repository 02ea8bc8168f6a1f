"""Device types from captured text: header rules, line grammars and binary frames, as columns of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import text as tx

# Columns, tokens, frame types and scores by which the devices are known.
IMU_EXPORT = ("AccX", "AccY", "AccZ", "AsX", "AsY", "AsZ", "HX", "HY", "HZ", "AngX", "AngY", "AngZ")
IMU_TIME = ("MonoNS", "EstNS")
IMU_ARCHIVE = ("ax(g)", "ay(g)", "az(g)", "wx(deg/s)", "wy(deg/s)", "wz(deg/s)", "anglex(deg)", "angley(deg)", "anglez(deg)", "magx", "magy", "magz")
DVL_EXPORT = ("Timestamp(s)", "SensorID", "RawLine")
DVL_REPLY = r'(?i)(?:^|[\r\n"\x00:])(SA|TS|BI|BS|BE|BD)\s*,'
DVL_COMMAND = r'(?i)(?:^|[\r\n"\x00:])(CS|CZ)\b'
DVL_SENSOR = r"(?i)\bDVL_H\d+\b"
CHANNEL_LINE = r"(?i)(?:^|[\r\n])\s*CH(\d{1,2})\s*:\s*[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:\s*([A-Za-z%]+))?"
CELL_UNIT = r"^\s*[-+]?(?:\d+(?:\.\d*)?|\.\d+)\s*([A-Za-z%]+)\s*$"
USBL = r"(?i)\bUSBL\b"
FRAME_TYPES = (0x50, 0x5C)

FOUND = "array<struct<type:string,score:double,support:string,detector:string,evidence:string>>"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")


def header_fields(text: Column) -> Column:
    """Lower-cased fields of the first line that isn't blank, cut at commas or else at tabs."""
    line = F.regexp_replace(F.trim(F.get(_lines(text), F.lit(0))), "^﻿", "")
    fields = F.when(line.contains(","), F.split(line, ",")).otherwise(F.split(line, "\t"))
    return F.transform(fields, lambda x: F.lower(F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', ""))))


def _has_all(fields: Column, names: tuple[str, ...]) -> Column:
    return F.forall(F.array(*(F.lit(n.lower()) for n in names)), lambda n: F.array_contains(fields, n))


def _hit(kind: str, score: Column, support: Column | str, detector: Column | str, evidence: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(kind).alias("type"), F.round(score, 6).alias("score"), lit(support).alias("support"), lit(detector).alias("detector"), evidence.alias("evidence"))


def dvl_hit(text: Column, fields: Column) -> Column:
    """Velocity log: its export's header, reply tokens, or no more than echoed commands. Score 0 for none."""
    tokens = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DVL_REPLY), F.lit(1)), F.upper)))
    n = F.size(tokens)
    by_header = F.when(_has_all(fields, DVL_EXPORT), F.when(text.rlike(DVL_SENSOR), 0.78).otherwise(0.74)).otherwise(0.0)
    by_token = F.when(n >= 3, F.least(F.lit(0.94), 0.78 + 0.03 * n)).when(n == 2, 0.82).when(n == 1, 0.68).otherwise(0.0)
    score = F.greatest(by_header, by_token)
    echo = (score == 0) & text.rlike(DVL_COMMAND)
    detector = F.when(echo, "dvl_command_echo_only").when((n > 0) & (by_token >= by_header), "dvl_reply_tokens").otherwise("dvl_export_rawline_csv")
    return _hit("dvl", F.when(echo, 0.40).otherwise(score), F.when(echo, "candidate_only").otherwise("sample_backed"), detector, F.array_join(tokens, ","))


def volt_hit(text: Column, fields: Column) -> Column:
    """Voltage recorder: sixteen channel columns, with units in the first rows, or lines of single channels."""
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter(fields, lambda x: x.rlike(r"^ch\d{1,2}$")), lambda x: F.substring(x, 3, 2).cast("int"))))
    export = F.slice(numbers, 1, 16) == F.sequence(F.lit(0), F.lit(15))
    cells = F.flatten(F.transform(F.slice(_lines(text), 2, 4), lambda row: F.split(row, ",")))
    units = F.array_distinct(F.filter(F.transform(cells, lambda x: F.upper(F.regexp_extract(F.regexp_replace(F.trim(x), '^"+|"+$', ""), CELL_UNIT, 1))), lambda u: u != ""))
    first = F.get(fields, F.lit(0)).isin("timestamp", "monons")
    both = F.array_contains(units, "A") & F.array_contains(units, "V")
    by_header = F.when(export, 0.78 + F.when(first, 0.04).otherwise(0.0) + F.when(both, 0.05).when(F.size(units) > 0, 0.02).otherwise(0.0)).otherwise(0.0)
    channels = F.array_distinct(F.regexp_extract_all(text, F.lit(CHANNEL_LINE), F.lit(1)))
    marked = F.exists(F.regexp_extract_all(text, F.lit(CHANNEL_LINE), F.lit(2)), lambda u: u != "")
    n = F.size(channels)
    by_line = F.when(n >= 4, F.least(F.lit(0.82), 0.66 + 0.02 * F.least(n, F.lit(8))) + F.when(marked, 0.04).otherwise(0.0)).otherwise(0.0)
    lined = (by_line > 0) & (by_line >= by_header)
    score = F.least(F.lit(0.89), F.greatest(by_header, by_line))
    return _hit("volt32", score, F.when(lined, "partial").otherwise("sample_backed"), F.when(lined, "volt32_channel_lines").otherwise("volt32_export_csv"), F.array_join(F.array_sort(units), ","))


def imu_hit(fields: Column, data: Column) -> Column:
    """Inertial unit: one of two export headers, or frames of its old serial protocol."""
    export, archive = _has_all(fields, IMU_EXPORT), _has_all(fields, IMU_ARCHIVE)
    by_header = F.when(export, 0.84 + F.when(_has_all(fields, IMU_TIME), 0.03).otherwise(0.0)).when(archive, 0.78).otherwise(0.0)
    frames = tx.frames_with_checksum(data, FRAME_TYPES)
    enough = (frames.valid >= 2) | (frames.loose >= 4)
    by_frame = F.when(enough, F.least(F.lit(0.62), 0.50 + 0.03 * F.greatest(frames.valid, F.least(frames.loose, F.lit(4))))).otherwise(0.0)
    framed = enough & (by_frame >= by_header)
    detector = F.when(framed, "imu_legacy_wit_sync").when(export, "imu_export_csv").otherwise("imu_archive_text")
    evidence = F.concat_ws(",", F.when(export, "export"), F.when(archive, "archive"), F.when(enough, "frames"))
    return _hit("imu", F.least(F.lit(0.89), F.greatest(by_header, by_frame)), F.when(framed, "candidate_only").otherwise("sample_backed"), detector, evidence)


def classified(samples: DataFrame) -> DataFrame:
    """(identity, type, score, support, detector, evidence): the types that ``samples`` (identity, content binary) may come from.

    Bytes that aren't UTF-8 are ignored in text rules. Null and empty samples give no rows.
    """
    content = F.coalesce("content", F.lit(b""))
    rows = samples.select("identity", content.alias("content"), tx.readable(content).alias("text")).withColumn("fields", header_fields(F.col("text")))
    t, fields = F.col("text"), F.col("fields")
    usbl = _hit("usbl", F.when(t.rlike(USBL), 0.60).otherwise(0.0), "candidate_only", "usbl_ascii_token", F.lit("USBL"))
    hits = F.array(dvl_hit(t, fields), volt_hit(t, fields), imu_hit(fields, F.col("content")), usbl).cast(FOUND)
    return rows.select("identity", F.inline(F.filter(hits, lambda h: h.score > 0)))
