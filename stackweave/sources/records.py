"""Metadata as declared record types: dataclasses that become nested Spark types, rows of them, and records again.

Fields may be text, whole numbers, floats, booleans, bytes, timestamps, other record types, `X | None`, `list[X]`,
`dict[str, X]` and `Literal[...]`. A type's `version` (1 if it has none) is stored with its rows; a newer one is refused, an older one
is led up by its `upgrades`: {version: f(dict) -> dict}. What a type does not know is refused, and so is what is missing
without a default.
"""

from __future__ import annotations

import dataclasses
import datetime
import types
import typing
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType

SIMPLE = {str: StringType(), int: LongType(), float: DoubleType(), bool: BooleanType(), bytes: BinaryType(), datetime.datetime: TimestampType()}
VERSION = "_version"


def _optional(kind) -> tuple[object, bool]:
    """The type without None, and whether None was in it."""
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        rest = [k for k in typing.get_args(kind) if k is not type(None)]
        if len(rest) != 1 or len(rest) == len(typing.get_args(kind)):
            raise TypeError(f"{kind}: of several types only one and None is supported")
        return rest[0], True
    return kind, False


def fields(kind: type) -> list[tuple[str, object, bool]]:
    """Name, type without None, and whether it may be None, of each field of a record type."""
    hints = typing.get_type_hints(kind)
    return [(f.name, *_optional(hints[f.name])) for f in dataclasses.fields(kind)]


def _choices(kind) -> tuple | None:
    return typing.get_args(kind) if typing.get_origin(kind) is typing.Literal else None


def spark_type(kind) -> DataType:
    """The Spark type of a field's type, or of a record type."""
    kind, _ = _optional(kind)
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        return StructType([StructField(name, spark_type(k), null) for name, k, null in fields(kind)])
    if kind in SIMPLE:
        return SIMPLE[kind]
    if origin is typing.Literal:
        of = {type(a) for a in args}
        if len(of) != 1 or of.pop() not in SIMPLE:
            raise TypeError(f"{kind}: choices have to be of one simple type")
        return SIMPLE[type(args[0])]
    if origin is list:
        return ArrayType(spark_type(args[0]), _optional(args[0])[1])
    if origin is dict and args[0] is str:
        return MapType(StringType(), spark_type(args[1]), _optional(args[1])[1])
    raise TypeError(f"{kind} is no type of a record")


def schema(kind: type) -> StructType:
    """The schema of a table of records; the version stands beside the fields."""
    return StructType([*spark_type(kind).fields, StructField(VERSION, LongType(), False)])


def to_plain(value, kind, where: str = "record"):
    """Dicts, lists and simple values of a record, checked against its type."""
    kind, null = _optional(kind)
    if value is None:
        if not null:
            raise ValueError(f"{where} is missing")
        return None
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, kind):
            raise ValueError(f"{where} is no {kind.__name__}")
        return {name: to_plain(getattr(value, name), typing.Optional[k] if n else k, f"{where}.{name}") for name, k, n in fields(kind)}  # noqa: UP045
    if origin is list:
        return [to_plain(v, args[0], f"{where}[{k}]") for k, v in enumerate(value)]
    if origin is dict:
        return {k: to_plain(v, args[1], f"{where}[{k!r}]") for k, v in value.items()}
    choices = _choices(kind)
    if choices is not None:
        if value not in choices:
            raise ValueError(f"{where} is {value!r} and not one of {choices}")
        return value
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ValueError(f"{where} is {value!r} and no {kind.__name__}")
    return value


def from_plain(value, kind, where: str = "record"):
    """The record that dicts, lists and simple values, or rows of Spark, stand for."""
    kind, null = _optional(kind)
    if value is None:
        if not null:
            raise ValueError(f"{where} is missing")
        return None
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        held = value.asDict() if isinstance(value, Row) else dict(value)
        own = {name: (k, n) for name, k, n in fields(kind)}
        if unknown := set(held) - set(own):
            raise ValueError(f"{where} has unknown fields: {', '.join(sorted(unknown))}")
        optional = {name: typing.Optional[k] if n else k for name, (k, n) in own.items()}  # noqa: UP045
        defaults = {f.name for f in dataclasses.fields(kind) if f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING}
        given = {name: from_plain(held.get(name), optional[name], f"{where}.{name}") for name in own if name in held or name not in defaults}
        return kind(**given)
    if origin is list:
        return [from_plain(v, args[0], f"{where}[{k}]") for k, v in enumerate(value)]
    if origin is dict:
        return {k: from_plain(v, args[1], f"{where}[{k!r}]") for k, v in value.items()}
    if kind is bytes:
        value = bytes(value)
    return to_plain(value, kind, where)


def version(kind: type) -> int:
    return getattr(kind, "version", 1)


def frame(spark: SparkSession, records: list, kind: type) -> DataFrame:
    """A table of some records."""
    return spark.createDataFrame([{**to_plain(r, kind), VERSION: version(kind)} for r in records], schema(kind))


def upgraded(plain: dict, kind: type) -> dict:
    """A stored record as the type's present version has it."""
    plain = dict(plain)
    held = plain.pop(VERSION, 1)
    if held > version(kind):
        raise ValueError(f"version {held} of {kind.__name__} is newer than {version(kind)}")
    for v in range(held, version(kind)):
        plain = getattr(kind, "upgrades", {})[v](plain)
    return plain


def read(df: DataFrame, kind: type) -> Iterator:
    """The records of a table, one after another."""
    for row in df.toLocalIterator():
        yield from_plain(upgraded(row.asDict(recursive=True), kind), kind)


def _wrong(column: Column, kind, null: bool) -> Column:
    """Whether a value isn't what its type allows: missing, or none of the choices, at any depth."""
    kind, optional = _optional(kind)
    missing = F.lit(False) if null or optional else column.isNull()
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    inside = F.lit(False)
    if dataclasses.is_dataclass(kind):
        for name, k, n in fields(kind):
            inside |= _wrong(column.getField(name), k, n)
    elif origin is list:
        inside = F.exists(column, lambda v: _wrong(v, args[0], False))
    elif origin is dict:
        inside = F.exists(F.map_values(column), lambda v: _wrong(v, args[1], False))
    elif origin is typing.Literal:
        inside = ~column.isin(*args)
    return missing | F.coalesce(F.when(column.isNotNull(), inside), F.lit(False))


def invalid(df: DataFrame, kind: type) -> DataFrame:
    """The rows of a table that are no records of the type: a check of any number of rows by one expression."""
    found = F.lit(False)
    for name, k, n in fields(kind):
        found |= _wrong(F.col(f"`{name}`"), k, n)
    return df.where(found)


def structure(kind: DataType | type, name: str = "", depth: int = 0) -> str:
    """A type, or the schema of a stored table, as an indented list of its fields."""
    if isinstance(kind, type) and dataclasses.is_dataclass(kind):
        kind = schema(kind)
    pad = "  " * depth
    if isinstance(kind, StructType):
        head = [f"{pad}{name}"] if name else []
        return "\n".join([*head, *(structure(f.dataType, f.name + ("" if not f.nullable else "?"), depth + bool(name)) for f in kind.fields)])
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return structure(kind.elementType, f"{name}[]", depth)
    if isinstance(kind, MapType) and isinstance(kind.valueType, StructType):
        return structure(kind.valueType, f"{name}{{}}", depth)
    return f"{pad}{name}: {kind.simpleString()}"
