"""Late-bound, case-sensitive lookup of columns and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Resolver = Callable[[DataFrame], Column]


def field(name: str, table: str | None = None) -> Resolver:
    """The column of exactly this name, or of this struct's field, in whatever frame it is given."""

    def find(df: DataFrame) -> Column:
        where = df.schema if table is None else df.schema[table].dataType
        if name not in where.names:
            raise KeyError(f"no field {name}")
        return F.col(f"`{name}`" if table is None else f"`{table}`.`{name}`")

    return find


def table(spark: SparkSession, name: str, schemas: list[str], unique: bool = False) -> str:
    """The first of schemas that has this table, as schema.table; with unique, the only one."""
    found = [f"{s}.{name}" for s in schemas if any(t.name == name for t in spark.catalog.listTables(s))]
    if not found or unique and len(found) > 1:
        raise KeyError(f"{len(found)} tables {name}")
    return found[0]
