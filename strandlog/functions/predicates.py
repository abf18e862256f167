"""Filter conditions on properties, as two-valued boolean columns.

A missing property never makes a condition unknown: every leaf is settled to true or false, so `Not` is plain
negation.  Equality is strict about types: an integer never equals a float.  Ordering compares integers
with floats, strings bytewise, booleans false before true, and nothing else.  Not-a-number is unequal to
everything, itself included, and is neither less nor greater.  `Like` knows only `%`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.functions import geo

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


class Condition:
    """Base of all conditions; combine with `&`, `|` and `~`."""

    def __and__(self, other: Condition) -> Condition:
        return And([self, other])

    def __or__(self, other: Condition) -> Condition:
        return Or([self, other])

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass
class Eq(Condition):
    field: str
    value: Any


@dataclass
class Ne(Condition):
    field: str
    value: Any


@dataclass
class Gt(Condition):
    field: str
    value: Any


@dataclass
class Ge(Condition):
    field: str
    value: Any


@dataclass
class Lt(Condition):
    field: str
    value: Any


@dataclass
class Le(Condition):
    field: str
    value: Any


@dataclass
class Exists(Condition):
    field: str


@dataclass
class NotExists(Condition):
    field: str


@dataclass
class Like(Condition):
    field: str
    pattern: str


@dataclass
class In(Condition):
    field: str
    values: list


@dataclass
class Near(Condition):
    """Within some metres of a place."""

    field: str
    lat: float
    lon: float
    metres: float


@dataclass
class Within(Condition):
    """Inside a box, its edges included."""

    field: str
    south: float
    west: float
    north: float
    east: float


@dataclass
class And(Condition):
    parts: list[Condition]


@dataclass
class Or(Condition):
    parts: list[Condition]


@dataclass
class Not(Condition):
    part: Condition


def _family(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "str"
    if isinstance(value, bytes | bytearray):
        return "bytes"
    if isinstance(value, tuple) and len(value) == 2:
        return "geo"
    raise TypeError(f"not a property value: {value!r}")


def _column_family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, _INTEGERS):
        return "int"
    if isinstance(kind, _FLOATS):
        return "float"
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, T.StructType) and kind.names == ["lat", "lon"]:
        return "geo"
    return "other"


def _literal(value: Any) -> Column:
    if _family(value) == "geo":
        return F.struct(F.lit(float(value[0])).alias("lat"), F.lit(float(value[1])).alias("lon"))
    return F.lit(value)


_COMPARE = {Gt: lambda a, b: a > b, Ge: lambda a, b: a >= b, Lt: lambda a, b: a < b, Le: lambda a, b: a <= b}


class Binder:
    """Turns conditions into columns for one schema; `prefix` qualifies the property columns."""

    def __init__(self, schema: T.StructType, prefix: str = "") -> None:
        self.types = {f.name: f.dataType for f in schema.fields}
        self.prefix = prefix

    def bind(self, cond: Condition, settled: bool = True) -> Column:
        """`settled`: never null.  Without it a null stands for false, which is enough where rows are only kept or
        dropped, and leaves the comparison in a form that file scans understand."""
        if isinstance(cond, And):
            if not cond.parts:
                return F.lit(True)
            return reduce(lambda a, b: a & b, [self.bind(p, settled) for p in cond.parts])
        if isinstance(cond, Or):
            if not cond.parts:
                return F.lit(False)
            return reduce(lambda a, b: a | b, [self.bind(p, settled) for p in cond.parts])
        if isinstance(cond, Not):
            return ~self.bind(cond.part)
        out = self._leaf(cond)
        return F.coalesce(out, F.lit(False)) if settled else out

    def _leaf(self, cond: Condition) -> Column:
        kind = self.types.get(cond.field)
        if isinstance(cond, Exists | NotExists):
            absent = F.lit(True) if kind is None else F.col(self.prefix + cond.field).isNull()
            return absent if isinstance(cond, NotExists) else ~absent
        if kind is None:
            return F.lit(isinstance(cond, Ne))
        column, family = F.col(self.prefix + cond.field), _column_family(kind)
        if isinstance(cond, Eq):
            return self._equal(column, family, cond.value)
        if isinstance(cond, Ne):
            if _family(cond.value) != family or cond.value != cond.value:
                return F.lit(True)
            return column.isNull() | (column != _literal(cond.value))
        if isinstance(cond, In):
            same = [v for v in cond.values if _family(v) == family and v == v]
            if family == "geo":
                return self.bind(Or([Eq(cond.field, v) for v in same]))
            return column.isin(same) if same else F.lit(False)
        if isinstance(cond, Near | Within):
            if family != "geo":
                return F.lit(False)
            if isinstance(cond, Near):
                return geo.near(column, cond.lat, cond.lon, cond.metres)
            return geo.within(column, cond.south, cond.west, cond.north, cond.east)
        if isinstance(cond, Like):
            return self._like(column, cond.pattern) if family == "str" else F.lit(False)
        return self._ordered(column, family, cond)

    @staticmethod
    def _equal(column: Column, family: str, value: Any) -> Column:
        if _family(value) != family or value != value:
            return F.lit(False)
        out = column == _literal(value)
        if family == "float":
            out = out & ~F.isnan(column)
        return out

    @staticmethod
    def _ordered(column: Column, family: str, cond: Any) -> Column:
        given = _family(cond.value)
        numeric = {"int", "float"}
        able = {family, given} <= numeric or (family == given and family in ("str", "bool"))
        if not able or cond.value != cond.value:
            return F.lit(False)
        value = cond.value
        if {family, given} == numeric:  # mixed: both as floats
            column, value = column.cast("double"), float(value)
        out = _COMPARE[type(cond)](column, F.lit(value))
        if family == "float":
            out = out & ~F.isnan(column)
        return out

    @staticmethod
    def _like(column: Column, pattern: str) -> Column:
        """Plain prefix, suffix and containment tests where they do, since scans understand them."""
        inner = pattern.strip("%")
        if "%" not in pattern:
            out = column == pattern
        elif not inner:
            out = column.isNotNull()
        elif "%" not in inner:
            left, right = pattern.startswith("%"), pattern.endswith("%")
            out = column.contains(inner) if left and right else column.endswith(inner) if left else column.startswith(inner)
        else:
            for mark in ("\\", "_"):
                pattern = pattern.replace(mark, "\\" + mark)
            out = column.like(pattern)
        return out


def bind(cond: Condition | None, schema: T.StructType, prefix: str = "") -> Column:
    """True or false for every row."""
    return F.lit(True) if cond is None else Binder(schema, prefix).bind(cond)


def restrict(rows: DataFrame, cond: Condition | None) -> DataFrame:
    """The rows that meet the condition, with as much of it as possible left to the file scan."""
    return rows if cond is None else rows.where(Binder(rows.schema).bind(cond, settled=False))


def evaluate(cond: Condition, props: dict[str, Any]) -> bool:
    """The same rules for one property map; the model that columns are tested against."""
    if isinstance(cond, And):
        return all(evaluate(p, props) for p in cond.parts)
    if isinstance(cond, Or):
        return any(evaluate(p, props) for p in cond.parts)
    if isinstance(cond, Not):
        return not evaluate(cond.part, props)
    value = props.get(cond.field)
    if isinstance(cond, Exists):
        return value is not None
    if isinstance(cond, NotExists):
        return value is None

    def same(x: Any) -> bool:
        return value is not None and _family(x) == _family(value) and x == value

    if isinstance(cond, Eq):
        return same(cond.value)
    if isinstance(cond, Ne):
        return not same(cond.value)
    if isinstance(cond, In):
        return any(same(v) for v in cond.values)
    if isinstance(cond, Like):
        if not isinstance(value, str):
            return False
        import re

        return re.fullmatch(".*".join(map(re.escape, cond.pattern.split("%"))), value, re.S) is not None
    if value is None:
        return False
    a, b = _family(value), _family(cond.value)
    if not ({a, b} <= {"int", "float"} or (a == b and a in ("str", "bool"))):
        return False
    if a == b == "str":
        return _COMPARE[type(cond)](value.encode(), cond.value.encode())
    return _COMPARE[type(cond)](value, cond.value)
