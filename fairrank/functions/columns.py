"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_lower0(c: str | Column) -> Column:
    """``max(x, 0)`` that keeps NULL as NULL (``greatest`` would turn it into 0)."""
    c = col(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)


def clip_range(c: str | Column, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole 24-hour units between two timestamps (floored), NULL-safe."""
    return F.timestamp_diff("DAY", col(earlier), col(later))


def elapsed_days_clipped(later: str | Column, earlier: str | Column) -> Column:
    return clip_lower0(elapsed_days(later, earlier))


def safe_ratio(num: str | Column, den: str | Column, default: float | None = None) -> Column:
    """``num / den``; a zero denominator yields NULL (or ``default``)."""
    r = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return r if default is None else F.coalesce(r, F.lit(float(default)))


def money_sum(c: str | Column) -> Column:
    """Order-independent sum of 2-decimal money values, returned as double."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def map_values(c: str | Column, mapping: Mapping[str, str], keep_unmapped: bool = True) -> Column:
    """Value replacement; unmapped values are kept (or NULLed), NULL stays NULL."""
    c = col(c)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    if expr is None:
        return c
    return expr.otherwise(c if keep_unmapped else F.lit(None))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


# Nudge added before rounding so exact decimal ties (e.g. 0.0003125) round the
# same way in engines with different double-rounding algorithms.
ROUND_NUDGE = 1e-9


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (presentation for cross-engine comparison)."""
    return df.select([
        F.round(F.col(f.name) + F.lit(ROUND_NUDGE), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
