"""Row transforms: default, min-max scaling, sequence, time and date buckets, and chains of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = {"seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000}
DATE_UNITS: dict[str, Callable[[Column], Column]] = {
    "day_of_week": F.dayofweek, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear,
    "week": F.weekofyear, "month": F.month, "quarter": F.quarter, "year": F.year,
}


def default_value(c: Column, value: object, when_null: bool = False) -> Column:
    """value always, or only where c is null."""
    return F.coalesce(c, F.lit(value)) if when_null else F.lit(value)


def min_max(c: Column, least: object, most: object) -> Column:
    """(c - least) / (most - least) in double; null where both bounds are equal."""
    low, high = F.lit(least).cast("double"), F.lit(most).cast("double")
    return F.try_divide(c.cast("double") - low, high - low)


def sequence(order: list[Column], base: int = 1, within: list[Column] | None = None) -> Column:
    """base, base + 1, ... in an explicit order, for each group of `within`; without groups all rows are one task's."""
    return F.lit(base - 1) + F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*order))


def time_bucket(c: Column, interval: int = 1, unit: str = "seconds", lower: bool = True, base: str = "1970-01-01 00:00:00") -> Column:
    """Start of the interval that holds c, or the next boundary, also for times on one."""
    width = interval * MICROS[unit]
    micros = F.unix_micros(c.cast("timestamp"))
    past = F.pmod(micros - F.unix_micros(F.lit(base).cast("timestamp")), F.lit(width))
    return F.timestamp_micros(micros - past + (0 if lower else width)).cast("timestamp_ntz")


def date_bucket(c: Column, unit: str) -> Column:
    """Start of the day, week, month, quarter or year."""
    return F.date_trunc(unit, c).cast("date")


def chain(df: DataFrame, steps: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """Builds new rows column by column; later steps may read earlier targets."""
    for name, c in steps:
        df = df.withColumn(name, c)
    return df.select(*keep, *[name for name, _ in steps])
