"""The driver's event table read as the sensor log of many runs, in Spark and in DuckDB SQL.

A user is a run, purchases are earth-frame velocities (BE), errors body-frame velocities (BI), all
other events inertial samples (IMU). Angles, flags and velocities come from the event's k and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600.0

_EXPRESSIONS = {
    "src": "CASE event_type WHEN 'purchase' THEN 'BE' WHEN 'error' THEN 'BI' ELSE 'IMU' END",
    "heading": "radians(k * 3.6)",
    "vE": "value / 245 * cos(radians(k * 3.6))",
    "vN": "value / 245 * sin(radians(k * 3.6))",
    "vU": "CAST(k % 7 - 3 AS DOUBLE) / 10",
    "valid": "k % 10 <> 0",
    "water_mass": "k % 13 = 0",
    "gate_ok": "k % 11 <> 0",
    "ax": "CAST(k % 11 - 5 AS DOUBLE) / 100",
    "ay": "CAST(k % 13 - 6 AS DOUBLE) / 100",
    "az": "CAST(k % 5 - 2 AS DOUBLE) / 100 - 1",
    "gx": "CAST(k % 9 - 4 AS DOUBLE) / 2",
    "gy": "CAST(k % 17 - 8 AS DOUBLE) / 4",
    "gz": "CAST(k % 19 - 9 AS DOUBLE) * 3 / 10",
    "roll": "radians(((k % 21) - 10) * 1.0)",
    "pitch": "radians(((k % 23) - 11) * 0.5)",
    "yaw": "radians(k * 3.6 - 180)",
}

#: A common table expression ``s`` for the oracles.
SQL = f"""WITH e0 AS (SELECT user_id AS run_id, event_id AS _row, epoch_us(ts) / 1e6 AS t_s, event_type, value,
                      CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
     s AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _EXPRESSIONS.items())} FROM e0)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def samples(spark: SparkSession, sf_dir: str, *src: str) -> DataFrame:
    """run_id, _row, t_s and the sensor columns, of the streams ``src`` or of all."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("_row"), (micros / 1e6).alias("t_s"), "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    rows = rows.select("*", *(F.expr(e).alias(n) for n, e in _EXPRESSIONS.items()))
    return rows.filter(F.col("src").isin(*src)) if src else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """``keep`` columns of ``df``, doubles rounded as the oracles round them."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in keep))
