"""JSON configuration of nests: a pure function from text to a Nest, with a check-only mode."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import resolve, transforms
from ..functions.aggregates import known
from .nest import Aggregate, Group, Level, Nest

PREFIX = "vh_acm_"  # fixed value: how configurations name accumulators


class ConfigError(ValueError):
    """What is wrong, and where."""


def _get(node: object, key: str, kind: type, where: str, default: object = ...):
    if not isinstance(node, dict):
        raise ConfigError(f"{where}: an object is needed")
    if key not in node:
        if default is ...:
            raise ConfigError(f"{where}: {key} is missing")
        return default
    if not isinstance(node[key], kind) or kind is int and isinstance(node[key], bool):
        raise ConfigError(f"{where}: {key} must be {kind.__name__}")
    return node[key]


def _search(node: object, where: str):
    method = _get(node, "methodName", str, where, "")
    if "field" not in method and "spht" not in method and method:
        raise ConfigError(f"{where}: unknown search path {method}")
    return resolve.field(_get(node, "fieldName", str, where))


def _transform(node: object, find, where: str):
    method = _get(node, "methodName", str, where)
    if "defaultv" in method:
        value, when_null = _get(node, "defaultValue", object, where), _get(node, "whenNull", bool, where, False)
        return lambda df: transforms.default_value(find(df), value, when_null)
    if "tsint" in method or "bucket" in method:
        unit = _get(node, "intervalType", str, where)
        if unit not in transforms.MICROS:
            raise ConfigError(f"{where}: unknown intervalType {unit}")
        interval, lower, base = _get(node, "interval", int, where, 1), _get(node, "lower", bool, where, True), _get(node, "base", str, where, "1970-01-01 00:00:00")
        return lambda df: transforms.time_bucket(find(df), interval, unit, lower, base)
    raise ConfigError(f"{where}: unknown transform {method}")


def _group(node: object, where: str) -> Group:
    name = _get(node, "columnName", str, where)
    find = _search(_get(node, "searchPath", dict, where), where)
    if _get(node, "groupByType", str, where, "") == "PrepCol":
        find = _transform(_get(node, "prepCol", dict, where), find, where)
    return Group(name, find)


def _aggregate(node: object, where: str) -> Aggregate:
    method = _get(node, "methodName", str, where).removeprefix(PREFIX)
    if not known(method):
        raise ConfigError(f"{where}: unknown accumulator {method}")
    return Aggregate(_get(node, "columnName", str, where), method, _search(_get(node, "searchPath", dict, where), where))


def _parts(node: object, where: str) -> list[tuple[object, str, Callable]]:
    """Each group and aggregate of a level, where it stands, and what reads it."""
    groups, aggregates = _get(node, "groupBy", list, where), _get(node, "aggregate", list, where, [])
    return [(g, f"{where}.groupBy[{i}]", _group) for i, g in enumerate(groups)] + [(a, f"{where}.aggregate[{i}]", _aggregate) for i, a in enumerate(aggregates)]


def _level(node: object, where: str) -> Level:
    read = [f(x, at) for x, at, f in _parts(node, where)]
    return Level(tuple(r for r in read if isinstance(r, Group)), tuple(r for r in read if isinstance(r, Aggregate)))


def _levels(text: str) -> list[tuple[object, str]]:
    try:
        node = json.loads(text)
    except ValueError as e:
        raise ConfigError(str(e)) from e
    levels = _get(node, "nestLevels", object, "nest")
    return [(x, f"nestLevels[{i}]") for i, x in enumerate(levels if isinstance(levels, list) else [levels])]


def parse(text: str) -> Nest:
    """The nest that a configuration describes; the first error raises."""
    return Nest(tuple(_level(x, where) for x, where in _levels(text)))


def table(text: str) -> Callable[[SparkSession], str]:
    """A table path, {"methodName": "table", "schemaName": .., "tableName": ..}: looked up in a session, as schema.table.

    schemaName may be a list, of which the first that has the table counts.
    """
    node = json.loads(text)
    schemas = _get(node, "schemaName", object, "table")
    name = _get(node, "tableName", str, "table")
    return lambda spark: resolve.table(spark, name, schemas if isinstance(schemas, list) else [schemas])


KEYS = {"columnName", "searchPath", "groupByType", "prepCol", "methodName"}


def check(text: str) -> list[str]:
    """Check only: all that is wrong, by place; keys that nothing reads are told with `warn: ` before them."""
    found: list[str] = []

    def tried(f: Callable, *a: object) -> object:
        try:
            return f(*a)
        except ConfigError as e:
            found.append(str(e))

    for level, where in tried(_levels, text) or []:
        for node, at, f in tried(_parts, level, where) or []:
            tried(f, node, at)
            found.extend(f"warn: {at}: {k} is not read" for k in (node if isinstance(node, dict) else {}) if k not in KEYS)
    return found


def run(text: str, df: DataFrame) -> DataFrame:
    return parse(text).frame(df)
