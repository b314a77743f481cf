"""Typed arithmetic (the result has the left type), three-way compare, registry of operators, range operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .aggregates import div, integer_root

_INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def arith(left: Column, op: str, right: Column, left_type: str) -> Column:
    """left op right in the left type; integers divide with truncation; % has the sign of left; overflow and division by zero raise."""
    wide = "bigint" if left_type in _INTEGERS else "double"
    a, b = left.cast(wide), right.cast(wide)
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: div(a, b) if wide == "bigint" else a / b, "%": lambda: a % b}[op]()
    return out.cast(left_type)


def root(c: Column, kind: str) -> Column:
    """Square root in the type of c, truncated for integers."""
    return (integer_root(c) if kind in _INTEGERS else F.sqrt(c.cast("double"))).cast(kind)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is null."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


class Operators:
    """Operators by (left type, name, right type); own ones can be registered."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str, str], Callable[[Column, Column], Column]] = {}

    def register(self, left: str, name: str, right: str, f: Callable[[Column, Column], Column]) -> None:
        self._known[left, name, right] = f

    def apply(self, left: str, name: str, right: str, a: Column, b: Column) -> Column:
        if (left, name, right) in self._known:
            return self._known[left, name, right](a, b)
        if name not in ("+", "-", "*", "/", "%"):
            raise KeyError((left, name, right))
        return arith(a, name, b, left)

    def assign(self, left: str, name: str, right: str, a: Column, b: Column) -> Column:
        """The new value of a after a compound assignment: +=, -=, *=, /=, %=, and ++ and -- which take no b."""
        if name in ("++", "--"):
            return self.apply(left, name[0], left, a, F.lit(1))
        if not name.endswith("="):
            raise KeyError((left, name, right))
        return self.apply(left, name[:-1], right, a, b)


LOWER_INCLUSIVE, UPPER_INCLUSIVE = 1, 2


def bounded(lower: Column, upper: Column, kind: str, flags: int = LOWER_INCLUSIVE) -> Column:
    """Half-open struct<lower, upper> of dates, timestamps (by microseconds) or integers, null bounds open; flags as in date_range."""
    step = {"date": lambda c: F.date_add(c, 1), "timestamp": lambda c: c + F.expr("interval 1 microsecond")}.get(kind.removesuffix("_ntz"), lambda c: c + F.lit(1).cast(kind))
    low, high = lower.cast(kind), upper.cast(kind)
    return F.struct((low if flags & LOWER_INCLUSIVE else step(low)).alias("lower"), (step(high) if flags & UPPER_INCLUSIVE else high).alias("upper"))


def range_size(a: Column, kind: str) -> Column:
    """Days of dates, microseconds of timestamps, count of integers, as long; null if a bound is open."""
    if kind == "date":
        return F.datediff(a["upper"], a["lower"]).cast("bigint")
    if kind.startswith("timestamp"):
        return F.timestamp_diff("MICROSECOND", a["lower"], a["upper"])
    return a["upper"].cast("bigint") - a["lower"].cast("bigint")


def range_order(a: Column, descending: bool = False) -> list[Column]:
    """Order by lower, then upper bound; an open lower bound is the least, an open upper one the greatest."""
    low, high = a["lower"], a["upper"]
    return [low.desc_nulls_last(), high.desc_nulls_first()] if descending else [low.asc_nulls_first(), high.asc_nulls_last()]


def date_range(lower: Column, upper: Column, flags: int = LOWER_INCLUSIVE) -> Column:
    """Half-open struct<lower, upper> of dates, null bounds open; flags tell which bounds are part of the input."""
    low = lower if flags & LOWER_INCLUSIVE else F.date_add(lower, 1)
    high = F.date_add(upper, 1) if flags & UPPER_INCLUSIVE else upper
    return F.struct(low.alias("lower"), high.alias("upper"))


def _le(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a <= b)


def range_contains(a: Column, b: Column) -> Column:
    """a holds all of b; a null bound is open."""
    low = a["lower"].isNull() | F.coalesce(a["lower"] <= b["lower"], F.lit(False))
    return low & (a["upper"].isNull() | F.coalesce(b["upper"] <= a["upper"], F.lit(False)))


def range_contained(a: Column, b: Column) -> Column:
    return range_contains(b, a)


def range_overlaps(a: Column, b: Column) -> Column:
    less = lambda x, y: x.isNull() | y.isNull() | (x < y)
    return less(a["lower"], b["upper"]) & less(b["lower"], a["upper"])


def range_adjacent(a: Column, b: Column) -> Column:
    return F.coalesce(a["upper"] == b["lower"], F.lit(False)) | F.coalesce(b["upper"] == a["lower"], F.lit(False))


JULIAN_EPOCH = 2440588  # the Julian day number of 1970-01-01


def julian_day(c: Column) -> Column:
    return F.unix_date(c.cast("date")) + JULIAN_EPOCH


def from_julian_day(c: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), c - JULIAN_EPOCH)
