"""The nine accumulators as aggregate columns, in an integer and a floating form, and a registry of own ones.

Integer inputs keep integer results: averages and variances divide with
truncation, deviations are truncated roots. Nulls are skipped, except that count
counts rows. Empty inputs give 0 for avg, var and dev, and null for min and max.
A result beyond a long raises.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

METHODS = ("count", "sum", "min", "max", "avg", "varp", "vars", "devp", "devs")

_own: dict[str, Callable[[Column], Column]] = {}


def register(method: str, f: Callable[[Column], Column]) -> None:
    """Adds an accumulator of one's own: from the input column to an aggregate column."""
    if method in METHODS:
        raise ValueError(f"{method} is built in")
    _own[method] = f


def known(method: str) -> bool:
    return method in METHODS or method in _own


def div(a: Column, b: Column) -> Column:
    """Truncating integer division."""
    return F.call_function("div", a, b)


def is_integer(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def _sum(c: Column) -> Column:
    return F.sum(c).cast("decimal(38,0)")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _integer_variance(c: Column, less: int) -> Column:
    """(n * sum of squares - sum squared) div (n * (n - less)), 0 where there is nothing to divide by.

    The sums are of the distances from the truncated mean, so that neither large
    values nor many rows overflow: a value is 2^32 * a + b, and the sums of a, b
    and their products are moved to the mean after the one pass over the rows.
    """
    x = c.cast("bigint")
    a, b = F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
    wide, free = b.cast("decimal(10,0)"), F.lit(less).cast("decimal(1,0)")
    sums = {"n": F.count(c).cast("decimal(20,0)"), "total": _sum(x.cast("decimal(19,0)")), "a": _sum(a.cast("decimal(10,0)")), "b": _sum(wide)}
    sums |= {"aa": _sum((a * a).cast("decimal(19,0)")), "ab": _sum((a * b).cast("decimal(19,0)")), "bb": _sum(wide * wide)}

    def centred(s: Column) -> Column:
        """n, the sum of distances from the mean and the sum of their squares."""
        mean = div(s["total"], s["n"])
        halves = F.struct(F.shiftright(mean, 32).cast("decimal(10,0)").alias("p"), mean.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(10,0)").alias("q"))

        def moved(m: Column) -> Column:
            n, p, q = s["n"], m["p"], m["q"]
            aa, bb = s["aa"] - 2 * p * s["a"] + n * p * p, s["bb"] - 2 * q * s["b"] + n * q * q
            ab = s["ab"] - p * s["b"] - q * s["a"] + n * p * q
            squares = _whole(F.lit(Decimal(2**64)) * _whole(aa)) + _whole(F.lit(Decimal(2**33)) * _whole(ab)) + _whole(bb)
            return F.struct(n.alias("n"), _whole(s["total"] - n * (p * F.lit(Decimal(2**32)) + q)).alias("rest"), _whole(squares).alias("squares"), (n - free).alias("freedom"))

        return _let(halves, moved)

    def divided(s: Column) -> Column:
        beyond = s["squares"] >= _whole(s["freedom"] * F.lit(Decimal(2**63)))  # a division to long would wrap around
        most = F.when(beyond, F.raise_error(F.lit("OVERFLOW: a variance is beyond a long")).cast("bigint")).otherwise(div(s["squares"], s["freedom"]))
        bottom = _whole(s["n"] * s["freedom"])

        def rounded(m: Column) -> Column:
            # what is left over is above -3 and below 1 of `bottom`; the shift by 3 keeps the division among positive numbers
            over = _whole(s["n"] * _whole(s["squares"] - m.cast("decimal(19,0)") * s["freedom"])) - _whole(s["rest"] * s["rest"])
            return m + div(_whole(over + 3 * bottom), bottom) - 3

        return _let(most, rounded)

    found = _let(F.struct(*[v.alias(k) for k, v in sums.items()]), lambda s: F.when(s["n"] > free, _let(centred(s), divided)))
    return F.coalesce(found, F.lit(0)).cast("bigint")


def integer_root(c: Column) -> Column:
    """Truncated square root of a non-negative long, exact also where a double isn't."""

    def settled(v: Column) -> Column:
        r = F.floor(F.sqrt(v.cast("double"))).cast("decimal(11,0)")
        wide = v.cast("decimal(19,0)")
        return F.when(r * r > wide, r - 1).when((r + 1) * (r + 1) <= wide, r + 1).otherwise(r).cast("bigint")

    return _let(c, settled)


def accumulate(method: str, c: Column, integer: bool) -> Column:
    """One accumulator over a column."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    if method in _own:
        return _own[method](c)
    if method == "count":
        return F.count(F.lit(1))
    if method in ("sum", "min", "max"):
        return getattr(F, method)(c)
    if integer:
        if method == "avg":
            return F.coalesce(F.when(F.count(c) > 0, div(_sum(c.cast("decimal(19,0)")), F.count(c))), F.lit(0)).cast("bigint")
        variance = _integer_variance(c, 1 if method.endswith("s") else 0)
        return variance if method.startswith("var") else integer_root(variance)
    if method == "avg":
        return zero(F.avg(c))
    named = {"varp": F.var_pop, "vars": F.var_samp, "devp": F.stddev_pop, "devs": F.stddev_samp}
    return zero(named[method](c))
