"""Type rules: literals, sums, comparability, the unpivot lattice."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import ArgumentError, TypeMismatchError

SMALL_INTS = (T.ByteType, T.ShortType, T.IntegerType)
INTS = (*SMALL_INTS, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NUMERIC = (*INTS, *FLOATS, T.DecimalType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType)
INT_MIN, INT_MAX, LONG_MIN, LONG_MAX = -(2**31), 2**31 - 1, -(2**63), 2**63 - 1


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def is_comparable(t: T.DataType) -> bool:
    """Types with an order; binary and complex values have none."""
    return not isinstance(t, (*COMPLEX, T.BinaryType, T.NullType))


def sum_type(t: T.DataType) -> T.DataType:
    """Small integers sum to int; every other numeric type keeps its own."""
    if isinstance(t, SMALL_INTS):
        return T.IntegerType()
    if isinstance(t, T.DecimalType):
        return T.DecimalType(38, t.scale)
    if is_numeric(t):
        return t
    raise TypeMismatchError(f"{t.simpleString()} values can't be summed")


def infer_type(values: Sequence[Any]) -> T.DataType:
    """The one type of the non-null values; integers are int, or long if one needs it."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if len(kinds) > 1:
        raise TypeMismatchError(f"values of several types: {sorted(k.__name__ for k in kinds)}")
    kind = kinds.pop()
    if kind is bool:
        return T.BooleanType()
    if kind is int:
        return T.IntegerType() if all(INT_MIN <= v <= INT_MAX for v in values if v is not None) else T.LongType()
    if kind is float:
        return T.DoubleType()
    if kind is decimal.Decimal:
        return decimal_type([v for v in values if v is not None])
    fixed = {
        str: T.StringType(), bytes: T.BinaryType(), bytearray: T.BinaryType(), dt.date: T.DateType(),
        dt.timedelta: T.DayTimeIntervalType(), uuid.UUID: T.StringType(),
    }
    if kind in fixed:
        return fixed[kind]
    if kind is dt.datetime:
        aware = {v.tzinfo is not None for v in values if v is not None}
        if len(aware) > 1:
            raise TypeMismatchError("times with and without a zone in one column")
        return T.TimestampType() if aware.pop() else T.TimestampNTZType()
    raise TypeMismatchError(f"values of type {kind.__name__} can't be stored in a frame")


def decimal_type(values: Sequence[decimal.Decimal]) -> T.DecimalType:
    """The narrowest 28-digit-or-wider decimal type that holds all values."""
    scale = max([0, *(-v.as_tuple().exponent for v in values if v.is_finite())])
    whole = max([1, *(len(v.as_tuple().digits) + v.as_tuple().exponent for v in values if v.is_finite())])
    if any(not v.is_finite() for v in values) or scale + whole > 38:
        raise TypeMismatchError("a decimal value does not fit in 38 digits")
    return T.DecimalType(min(38, max(28, scale + whole)), scale)


def check_value(value: Any, t: T.DataType, nullable: bool, name: str) -> Any:
    """``value`` ready for a column of type ``t``, without any coercion between kinds."""
    if value is None:
        if not nullable:
            raise TypeMismatchError(f"column {name!r} does not take null")
        return None
    ok = False
    if isinstance(t, INTS):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(t)]
        ok = type(value) is int and -(2 ** (bits - 1)) <= value < 2 ** (bits - 1)
    elif isinstance(t, FLOATS):
        ok = type(value) is float
    elif isinstance(t, T.DecimalType):
        ok = isinstance(value, decimal.Decimal) and value.is_finite() and -value.as_tuple().exponent <= t.scale
    elif isinstance(t, T.BooleanType):
        ok = type(value) is bool
    elif isinstance(t, T.StringType):
        if isinstance(value, uuid.UUID):
            return str(value)
        ok = isinstance(value, str)
    elif isinstance(t, T.BinaryType):
        ok = isinstance(value, (bytes, bytearray))
    elif isinstance(t, T.TimestampNTZType):
        ok = isinstance(value, dt.datetime) and value.tzinfo is None
    elif isinstance(t, T.TimestampType):
        ok = isinstance(value, dt.datetime) and value.tzinfo is not None
    elif isinstance(t, T.DateType):
        ok = type(value) is dt.date
    elif isinstance(t, T.DayTimeIntervalType):
        ok = isinstance(value, dt.timedelta)
    else:
        ok = isinstance(t, COMPLEX)
    if not ok:
        raise TypeMismatchError(f"{value!r} is not a value of column {name!r} ({t.simpleString()})")
    return value


def unpivot_type(types: Sequence[T.DataType]) -> T.DataType:
    """Integers widen to int, then long, then decimal, then double; other kinds must be one and the same."""
    if not types:
        raise ArgumentError("no value columns")
    if any(isinstance(t, (*COMPLEX, T.BinaryType, T.DateType)) for t in types):
        raise TypeMismatchError("complex, binary and date values can't be unpivoted")
    if all(is_numeric(t) for t in types):
        if any(isinstance(t, FLOATS) for t in types):
            return T.DoubleType()
        decimals = [t for t in types if isinstance(t, T.DecimalType)]
        if decimals:
            scale = max(t.scale for t in decimals)
            whole = max([t.precision - t.scale for t in decimals] + [19 if any(isinstance(t, T.LongType) for t in types) else 10])
            return T.DecimalType(min(38, whole + scale), scale)
        return T.LongType() if any(isinstance(t, T.LongType) for t in types) else T.IntegerType()
    first = types[0]
    if any(type(t) is not type(first) for t in types):
        raise TypeMismatchError("value columns have no common type: " + ", ".join(t.simpleString() for t in types))
    return first


def ascending_key(c: Column, t: T.DataType) -> Column:
    """A key whose order is the frame's ascending order: NaN comes before all numbers."""
    return F.struct(~F.isnan(c), c) if isinstance(t, FLOATS) else c


def descending_key(c: Column, t: T.DataType) -> Column:
    """A key whose ascending order is the descending order of ``c``."""
    if isinstance(t, FLOATS):
        return F.struct(F.isnan(c), -c)
    if isinstance(t, T.DecimalType):
        return -c
    if isinstance(t, INTS):
        return F.bitwise_not(c)
    if isinstance(t, T.BooleanType):
        return ~c
    if isinstance(t, T.DateType):
        return -F.unix_date(c)
    if isinstance(t, T.TimestampNTZType):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(t, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(t, T.StringType):
        # Negated code points; the end mark sorts a prefix after its extensions.
        points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: -F.ascii(x))
        return F.concat(points, F.array(F.lit(1)))
    return -c
