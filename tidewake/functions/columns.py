"""Column helpers: late-bound names, NaN-safe predicates, bool-like text."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME_COLUMNS = ("t_s", "EstS", "MonoS", "EstNS", "MonoNS")


def resolve(df: DataFrame, names: Sequence[str], required: bool = True) -> str | None:
    """The first of ``names`` that ``df`` has; a KeyError with its columns if there is none."""
    for name in names:
        if name in df.columns:
            return name
    if required:
        raise KeyError(f"none of {list(names)} in {df.columns}")
    return None


def seconds(df: DataFrame, names: Sequence[str] = TIME_COLUMNS) -> Column:
    """Time in seconds from the first time column there; nanoseconds are scaled."""
    name = resolve(df, names)
    c = F.col(f"`{name}`").cast("double")
    return c * 1e-9 if name.endswith("NS") else c


def first_usable_time(df: DataFrame, names: Sequence[str]) -> Column:
    """Time from the first column that has any finite value; a window over the whole table decides, per run."""
    from pyspark.sql import Window as W

    run = W.partitionBy("run_id")
    out = F.lit(None).cast("double")
    for name in reversed([n for n in names if n in df.columns]):
        c = finite(F.col(f"`{name}`").cast("double"))
        out = F.when(F.max(c.isNotNull()).over(run), c).otherwise(out)
    return out


def finite(c: Column) -> Column:
    """``c`` where it is finite, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < math.inf), c)


def above(c: Column, limit: Column | float) -> Column:
    """c > limit, false for NaN and null: a sample that can't be compared passes a gate."""
    return F.coalesce((c > limit) & ~F.isnan(c), F.lit(False))


def below(c: Column, limit: Column | float) -> Column:
    return F.coalesce(c < limit, F.lit(False))


def to_number(c: Column) -> Column:
    """Text as a double, null where it isn't a number."""
    return c.try_cast("double")


def gate_flag(c: Column) -> Column:
    """Bool-like text of gates: a closed list of true words, everything else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes", "y", "on"), F.lit(False))


def timeline_flag(c: Column, default: bool = True) -> Column:
    """Bool-like text of timelines: numbers by being other than 0, words by two lists, else ``default``."""
    text = F.lower(F.trim(c.cast("string")))
    number = to_number(text)
    return (
        F.when(c.isNull() | F.isnan(number), F.lit(default))
        .when(number.isNotNull(), number != 0)
        .when(text.isin("true", "t", "yes", "y", "ok"), F.lit(True))
        .when(text.isin("false", "f", "no", "n", ""), F.lit(False))
        .otherwise(F.lit(default))
    )


def audit_flag(c: Column) -> Column:
    """Bool-like text of audits: 1.0 or 0.0, null for what is neither."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1"), 1.0).when(text.isin("false", "0"), 0.0)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_reason(reasons: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first condition that holds."""
    out = F.lit(otherwise)
    for name, c in reversed(reasons):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def joined_reasons(reasons: Sequence[tuple[str, Column]]) -> Column:
    """Names of all conditions that hold, in order, joined by semicolons."""
    return F.concat_ws(";", *(F.when(c, F.lit(name)) for name, c in reasons))


def deadband(c: Column, limit: float) -> Column:
    return F.when(F.abs(c) < limit, F.lit(0.0)).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clamp_by_unit(df: DataFrame) -> DataFrame:
    """Implausible values become 0 by the unit in a column's name: over 5 m/s, 5000 mm/s or 100 m. NaN becomes 0."""
    limits = (("(m_s)", 5.0), ("(mm_s)", 5000.0), ("(m)", 100.0))
    out = {}
    for name in df.columns:
        limit = next((v for suffix, v in limits if name.endswith(suffix)), None)
        if limit is not None:
            c = F.col(f"`{name}`").cast("double")
            out[name] = F.coalesce(F.when(F.isnan(c) | (F.abs(c) > limit), 0.0).otherwise(c), F.lit(0.0))
    return df.withColumns(out)


def unsigned_zero(c: Column) -> Column:
    """``c`` with 0.0 for -0.0, as DuckDB's ``max_by`` gives it; a number that only rounds to zero keeps its sign."""
    return c + F.lit(0.0)


def fixed(c: Column, digits: int) -> Column:
    """A double as C's ``%.nf`` writes it: the exact value is rounded, halves to even; ``nan``, ``inf`` and ``-inf``; null stays null."""
    c = c.cast("double")
    finite_text = F.call_function("format_number", c, F.lit("0." + "0" * digits if digits else "0"))
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c.isNotNull(), finite_text)
