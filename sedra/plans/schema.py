"""Table definitions: versions, keys and relationships, as structs and join conditions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

INVERSE = {"1:1": "1:1", "1:N": "N:1", "N:1": "1:N", "N:M": "N:M"}


@dataclass(frozen=True)
class Relation:
    """Equality pairs (own field, other field) to another table, with a cardinality."""

    name: str
    other: str
    cardinality: str
    pairs: tuple[tuple[str, str], ...]

    def inverse(self, name: str, own: str) -> Relation:
        return Relation(name, own, INVERSE[self.cardinality], tuple((b, a) for a, b in self.pairs))

    def condition(self, own: DataFrame, other: DataFrame) -> Column:
        return reduce(Column.__and__, [own[a] == other[b] for a, b in self.pairs])


@dataclass
class TableSpec:
    """A named table with versions of its struct; the last one added leads unless told otherwise."""

    name: str
    primary_key: tuple[str, ...] = ()
    versions: dict[str, StructType] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    lead: str = ""

    def add_version(self, name: str, struct: StructType) -> None:
        self.versions[name] = struct
        self.lead = name

    def leading(self) -> StructType:
        return self.versions[self.lead]

    def has(self, name: str, version: str | None = None) -> bool:
        return name in self.versions[version or self.lead].names

    def fields(self, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
        """Names in order, filtered by an include or exclude list."""
        return [n for n in self.leading().names if (include is None or n in include) and n not in (exclude or [])]

    def lifted(self, df: DataFrame) -> DataFrame:
        """df of any version with the columns of the leading one, null where it had none."""
        empty = df.sparkSession.createDataFrame([], self.leading())
        return empty.unionByName(df, allowMissingColumns=True).select(*self.leading().names)


class Schema:
    """Table definitions by name; relating two tables adds both directions."""

    def __init__(self) -> None:
        self.tables: dict[str, TableSpec] = {}

    def add(self, spec: TableSpec) -> TableSpec:
        return self.tables.setdefault(spec.name, spec)

    def relate(self, own: str, other: str, cardinality: str, *pairs: tuple[str, str]) -> Relation:
        r = Relation(f"{own}_{other}", other, cardinality, pairs)
        self.tables[own].relations[other] = r
        self.tables[other].relations[own] = r.inverse(f"{other}_{own}", own)
        return r

    def between(self, own: str, other: str) -> Relation:
        return self.tables[own].relations[other]
