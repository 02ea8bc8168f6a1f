"""As-of alignment of two streams of a run: unions and one window, never a join on time alone.

``left`` and ``right`` have run_id, t_s and _row. The right columns that are asked for come back
as given, null where nothing matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.operators.timeseries import run


def _both(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """Left rows as ``_l``, right rows as ``_r`` (a struct that begins with its time), in one table."""
    payload = F.struct(F.col("t_s").alias("t"), F.col("_row").alias("row"), *(F.col(v) for v in values))
    a = left.select("run_id", "t_s", F.col("_row"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_r"))
    b = right.select("run_id", "t_s", F.col("_row"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l"), payload.alias("_r"))
    return a.unionByName(b)


def neighbours(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """Left rows with ``before`` and ``after``: the last right row at or before, the first at or after.

    Of right rows of one time the last counts before and the first counts after.
    """
    rows = _both(left, right, values)
    is_right = F.col("_r").isNotNull()
    # a right row of the same time comes first for the look back and last for the look ahead
    back = W.partitionBy("run_id").orderBy("t_s", F.when(is_right, 0).otherwise(1), "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy("run_id").orderBy("t_s", F.when(is_right, 1).otherwise(0), "_row").rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.withColumns({"before": F.last("_r", ignorenulls=True).over(back), "after": F.first("_r", ignorenulls=True).over(ahead)})
    return rows.filter(F.col("_l").isNotNull()).select("_l.*", "before", "after")


def _picked(rows: DataFrame, picked: Column, values: list[str], prefix: str) -> DataFrame:
    rows = rows.withColumn("_pick", picked)
    return rows.withColumns({f"{prefix}t_s": F.col("_pick.t"), f"{prefix}row": F.col("_pick.row"), **{v: F.col(f"_pick.{v}") for v in values}}).drop("_pick", "before", "after")


def forward(left: DataFrame, right: DataFrame, values: list[str], prefix: str = "match_") -> DataFrame:
    """The first right row at or after each left row."""
    rows = _both(left, right, values)
    ahead = W.partitionBy("run_id").orderBy("t_s", F.when(F.col("_r").isNotNull(), 1).otherwise(0), "_row").rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.withColumn("after", F.first("_r", ignorenulls=True).over(ahead)).filter(F.col("_l").isNotNull()).select("_l.*", "after", F.lit(None).alias("before"))
    return _picked(rows, F.col("after"), values, prefix)


def nearest(left: DataFrame, right: DataFrame, values: list[str], *, tie: str = "later", tolerance: float | None = None, prefix: str = "match_") -> DataFrame:
    """The nearer of the neighbours; at equal distance the ``later`` or the ``earlier``. Beyond both ends the end counts."""
    rows = neighbours(left, right, values)
    gap_before, gap_after = F.col("t_s") - F.col("before.t"), F.col("after.t") - F.col("t_s")
    ahead = gap_after <= gap_before if tie == "later" else gap_after < gap_before
    pick = F.when(F.col("before").isNull() | ahead, F.col("after")).otherwise(F.col("before"))
    pick = F.when(F.col("after").isNull(), F.col("before")).otherwise(pick)
    if tolerance is not None:
        gap = F.when(pick.getField("t") >= F.col("t_s"), pick.getField("t") - F.col("t_s")).otherwise(F.col("t_s") - pick.getField("t"))
        pick = F.when(gap <= tolerance, pick)
    return _picked(rows, pick, values, prefix)


def interpolated(left: DataFrame, right: DataFrame, values: list[str], prefix: str = "interp_") -> DataFrame:
    """Right values at the left times by straight lines; beyond the ends the end's value."""
    rows = neighbours(left, right, values)
    span = F.col("after.t") - F.col("before.t")
    share = F.when(span > 0, (F.col("t_s") - F.col("before.t")) / span).otherwise(0.0)
    out = {f"{prefix}{v}": F.coalesce(F.col(f"before.{v}") + share * (F.col(f"after.{v}") - F.col(f"before.{v}")), F.col(f"before.{v}"), F.col(f"after.{v}")) for v in values}
    return rows.withColumns(out).drop("before", "after")


def ordinal_join(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """Row j of left with row j of right, in runs where both have equally many; else the values are null."""
    a = left.withColumns({"_j": F.row_number().over(run()), "_n": F.count("*").over(W.partitionBy("run_id"))})
    b = right.select("run_id", F.row_number().over(run()).alias("_j"), F.count("*").over(W.partitionBy("run_id")).alias("_m"), *values)
    joined = a.join(b, ["run_id", "_j"], "left")
    return joined.withColumns({v: F.when(F.col("_n") == F.col("_m"), F.col(v)) for v in values}).drop("_j", "_n", "_m")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(run_id, t0, t1): where both streams have samples; runs without overlap are left out."""
    a = left.groupBy("run_id").agg(F.min("t_s").alias("a0"), F.max("t_s").alias("a1"))
    b = right.groupBy("run_id").agg(F.min("t_s").alias("b0"), F.max("t_s").alias("b1"))
    return a.join(b, "run_id").select("run_id", F.greatest("a0", "b0").alias("t0"), F.least("a1", "b1").alias("t1")).filter("t0 <= t1")
