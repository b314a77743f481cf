"""Table sets: child rows nested under their parents, level by level from the leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Node:
    """A relation of the tree: its rows, and (parent field, own field) pairs."""

    name: str
    frame: DataFrame
    on: tuple[tuple[str, str], ...] = ()
    children: tuple[Node, ...] = ()

    def find(self, path: str) -> Node:
        """A node by dotted path, e.g. nations.customers."""
        head, _, rest = path.partition(".")
        child = next(c for c in self.children if c.name == head)
        return child.find(rest) if rest else child


def fetch(node: Node) -> DataFrame:
    """One row per root row, each child relation an array of structs under its name, ordered; no children: empty.

    Children are nested before they are joined, so each level is one grouping by
    the parent's key and one join, whatever the depth. All children of one parent
    are one array by definition of the result.
    """
    out = node.frame
    for child in node.children:
        rows = fetch(child)
        keys = [F.col(own).alias(f"_{child.name}_{parent}") for parent, own in child.on]
        nested = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(child.name))
        names = [f"_{child.name}_{parent}" for parent, _ in child.on]
        joined = out.join(nested, [out[parent] == nested[n] for (parent, _), n in zip(child.on, names)], "left").drop(*names)
        kind = nested.schema[child.name].dataType
        out = joined.withColumn(child.name, F.coalesce(child.name, F.array().cast(kind)))
    return out


def flattened(parent: Node, child: Node) -> DataFrame:
    """(parent, child) pairs as two structs."""
    p = parent.frame.select(F.struct("*").alias("parent"))
    c = child.frame.select(F.struct("*").alias("child"))
    on = [F.col(f"parent.{a}") == F.col(f"child.{b}") for a, b in child.on]
    return p.join(c, on)


def counted(node: Node) -> DataFrame:
    """Root rows with the number of rows of each relation below, under its name, summed level by level from the leaves.

    Nothing is nested, so a root with a fifth of all leaves is one row of sums.
    """
    out = node.frame
    for child in node.children:
        rows = counted(child)
        names = [f"_{child.name}_{parent}" for parent, _ in child.on]
        keys = [F.col(own).alias(n) for (_, own), n in zip(child.on, names)]
        below = [d.name for d in descendants(child)]
        sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(child.name), *[F.sum(d).alias(d) for d in below])
        joined = out.join(sums, [out[parent] == sums[n] for (parent, _), n in zip(child.on, names)], "left").drop(*names)
        out = joined.fillna(0, [child.name, *below])
    return out


def descendants(node: Node) -> list[Node]:
    return [d for c in node.children for d in (c, *descendants(c))]
