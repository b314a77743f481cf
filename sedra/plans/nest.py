"""Nests: levels of groups by plain or transformed columns, with accumulators.

One level is a grouping; several are grouping sets of one scan, coarse to fine,
with the keys and aggregates a level doesn't name null and `level` telling the level. Batch and
streaming frames take the same definition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import accumulate, is_integer
from ..functions.resolve import Resolver


@dataclass(frozen=True)
class Group:
    """A key: name and a resolver of the column, transformed or not."""

    name: str
    column: Resolver


@dataclass(frozen=True)
class Aggregate:
    """An output: name, accumulator method, and a resolver of its input (count needs none)."""

    name: str
    method: str
    column: Resolver | None = None


@dataclass(frozen=True)
class Level:
    groups: tuple[Group, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()


@dataclass(frozen=True)
class Nest:
    levels: tuple[Level, ...] = field(default_factory=tuple)

    def _aggregates(self, df: DataFrame, level: Level) -> list[Column]:
        out = []
        for a in level.aggregates:
            c = a.column(df) if a.column else F.lit(1)
            out.append(accumulate(a.method, c, is_integer(df.select(c).schema[0].dataType)).alias(a.name))
        return out

    def _ids(self) -> dict[int, Level]:
        """grouping_id -> level: a bit for each key, the first highest, set where the level doesn't name it."""
        keys = list(dict.fromkeys(g.name for level in self.levels for g in level.groups))
        out: dict[int, Level] = {}
        for level in self.levels:
            own = {g.name for g in level.groups}
            at = sum(1 << i for i, k in enumerate(reversed(keys)) if k not in own)
            if at in out:
                raise ValueError(f"two levels have the keys {sorted(own)}")
            out[at] = level
        return out

    def _named(self, df: DataFrame) -> dict[str, tuple[Column, list[int]]]:
        """Aggregates of all levels by name, and the grouping_ids of the levels that name them."""
        seen: dict[str, tuple[str, str | None]] = {}
        out: dict[str, tuple[Column, list[int]]] = {}
        for at, level in self._ids().items():
            for a, c in zip(level.aggregates, self._aggregates(df, level)):
                what = (a.method, str(a.column(df)) if a.column else None)
                if seen.setdefault(a.name, what) != what:
                    raise ValueError(f"two levels use {a.name} for different aggregates")
                out.setdefault(a.name, (c, []))[1].append(at)
        return out

    def frame(self, df: DataFrame) -> DataFrame:
        """Groups and accumulators. Null keys form a group of their own."""
        if len(self.levels) == 1:
            (level,) = self.levels
            return df.groupBy(*[g.column(df).alias(g.name) for g in level.groups]).agg(*self._aggregates(df, level))
        groups = {g.name: g.column(df) for level in self.levels for g in level.groups}
        if taken := ({*groups, *(a.name for level in self.levels for a in level.aggregates)} & {"level"}):
            raise ValueError(f"several levels have a column {taken.pop()} of their own")
        keyed = df.withColumns({f"key_{n}": c for n, c in groups.items()})
        sets = [[F.col(f"key_{g.name}") for g in level.groups] for level in self.levels]
        named = self._named(df)
        out = keyed.groupingSets(sets, *[F.col(f"key_{n}") for n in groups]).agg(F.grouping_id().alias("level"), *[c.alias(f"agg_{n}") for n, (c, _) in named.items()])
        shown = [F.when(F.col("level").isin(at), F.col(f"agg_{n}")).alias(n) if len(at) < len(self._ids()) else F.col(f"agg_{n}").alias(n) for n, (_, at) in named.items()]
        return out.select(*[F.col(f"key_{n}").alias(n) for n in groups], "level", *shown)

    def one(self, df: DataFrame, **key: object) -> DataFrame:
        """The group of this key."""
        out = self.frame(df)
        for k, v in key.items():
            out = out.where(F.col(k).eqNullSafe(F.lit(v)))
        return out

    def json(self, df: DataFrame) -> DataFrame:
        """One JSON object per group, in descending key order; null keys and values are written."""
        out = self.frame(df)
        keys = [g.name for g in self.levels[-1].groups]
        return out.orderBy(*[F.desc(k) for k in keys]).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
