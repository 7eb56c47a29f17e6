"""Typed predicates: ``cell("x") > 3`` becomes a Column, so filters reach the scan.

Comparison rules: the literal must be of the column's own type, a null cell raises (only string
equality and the null tests accept it), NaN compares false. ``&`` and ``|`` keep their left-to-right
short circuit: the right side is evaluated only where the left side does not decide.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import types
from tessella.errors import NullValueError, TypeMismatchError
from tessella.names import quoted, resolve


class Predicate:
    """A boolean expression that is bound to a schema when the filter is applied."""

    def __init__(self, build: Callable[[T.StructType], Column], safe: bool = False) -> None:
        self._build, self._safe = build, safe

    def bind(self, schema: T.StructType) -> Column:
        return self._build(schema)

    def __and__(self, other: Predicate) -> Predicate:
        def build(s: T.StructType) -> Column:
            left, right = self.bind(s), other.bind(s)
            # A guarded right side must stay behind the left side; a plain one may be pushed down.
            return left & right if _plain(other, s) else F.when(left, right).otherwise(F.lit(False))

        return Predicate(build, self._safe and other._safe)

    def __or__(self, other: Predicate) -> Predicate:
        def build(s: T.StructType) -> Column:
            left, right = self.bind(s), other.bind(s)
            return left | right if _plain(other, s) else F.when(left, F.lit(True)).otherwise(right)

        return Predicate(build, self._safe and other._safe)

    def __invert__(self) -> Predicate:
        return Predicate(lambda s: ~self.bind(s), self._safe)

    def __bool__(self) -> bool:
        raise TypeMismatchError("combine predicates with &, | and ~, not with and, or, not")


def _plain(p: Predicate, schema: T.StructType) -> bool:
    return p._safe or not any(f.nullable for f in schema.fields)


class Cell:
    """A column reference inside a predicate."""

    def __init__(self, name: str) -> None:
        self.name = name

    def _field(self, schema: T.StructType) -> T.StructField:
        return schema[resolve(schema.fieldNames(), self.name)]

    def _compare(self, other: Any, op: Callable[[Column, Column], Column], equality: bool) -> Predicate:
        if other is None and equality:
            # Only strings compare with null.
            def null_test(s: T.StructType) -> Column:
                f = self._field(s)
                if not isinstance(f.dataType, T.StringType):
                    raise NullValueError(f"column {f.name!r} is not a string; use is_null()")
                c = F.col(quoted(f.name))
                return op(F.when(c.isNull(), 0).otherwise(1), F.lit(0))

            return Predicate(null_test, True)

        def build(s: T.StructType) -> Column:
            f = self._field(s)
            c, t = F.col(quoted(f.name)), f.dataType
            value = _literal(other, t, f.name, equality)
            if isinstance(t, T.StringType):
                same = c.eqNullSafe(value)
                return op(F.when(same, 0).otherwise(1), F.lit(0)) if f.nullable and op is not _eq else (same if op is _eq else c != value)
            test = op(c, value)
            if isinstance(t, types.FLOATS):
                test = (test & ~F.isnan(c)) if op is not _ne else (test | F.isnan(c))
            return _guard(f, test)

        return Predicate(build)

    def __lt__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a < b, False)

    def __le__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a <= b, False)

    def __gt__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a > b, False)

    def __ge__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a >= b, False)

    def __eq__(self, other: Any) -> Predicate:  # type: ignore[override]
        return self._compare(other, _eq, True)

    def __ne__(self, other: Any) -> Predicate:  # type: ignore[override]
        return self._compare(other, _ne, True)

    __hash__ = None  # type: ignore[assignment]

    def _text(self, part: str, test: Callable[[Column, Column], Column]) -> Predicate:
        if not isinstance(part, str):
            raise TypeMismatchError("a text test needs a string")

        def build(s: T.StructType) -> Column:
            f = self._field(s)
            if not isinstance(f.dataType, T.StringType):
                raise TypeMismatchError(f"column {f.name!r} is not a string")
            return _guard(f, test(F.col(quoted(f.name)), F.lit(part)))

        return Predicate(build)

    def contains(self, part: str) -> Predicate:
        """Ordinal substring test; the empty string is in every text."""
        return self._text(part, F.contains)

    def starts_with(self, part: str) -> Predicate:
        return self._text(part, F.startswith)

    def ends_with(self, part: str) -> Predicate:
        return self._text(part, F.endswith)

    def is_null(self) -> Predicate:
        return Predicate(lambda s: F.col(quoted(self._field(s).name)).isNull(), True)

    def is_not_null(self) -> Predicate:
        return Predicate(lambda s: F.col(quoted(self._field(s).name)).isNotNull(), True)


def _eq(a: Column, b: Column) -> Column:
    return a == b


def _ne(a: Column, b: Column) -> Column:
    return a != b


def _guard(f: T.StructField, test: Column) -> Column:
    """``test``, or an error where the cell is null.

    A guarded test can't be pushed into the scan (the scan would hide the null). Columns known to hold no
    nulls (``Frame.not_null``) have no guard, and their tests are pushed down.
    """
    if not f.nullable:
        return test
    c = F.col(quoted(f.name))
    return F.when(c.isNull(), F.raise_error(F.lit(f"column '{f.name}' holds null in a comparison"))).otherwise(test)


def _literal(value: Any, t: T.DataType, name: str, equality: bool) -> Column:
    ok = False
    if isinstance(t, (T.IntegerType, T.LongType)):
        top = 31 if isinstance(t, T.IntegerType) else 63
        ok = type(value) is int and -(2**top) <= value < 2**top
    elif isinstance(t, T.DecimalType):
        ok = isinstance(value, decimal.Decimal)
        if ok:
            return F.lit(value)
    elif isinstance(t, T.DoubleType):
        ok = type(value) is float
    elif isinstance(t, T.BooleanType):
        ok = equality and type(value) is bool
    elif isinstance(t, T.StringType):
        ok = equality and isinstance(value, str)
    elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):  # an extension
        ok = isinstance(value, dt.datetime)
    elif isinstance(t, T.DateType):  # an extension
        ok = type(value) is dt.date
    if not ok:
        raise TypeMismatchError(f"column {name!r} ({t.simpleString()}) can't be compared with {value!r}")
    return F.lit(value).cast(t)


def cell(name: str) -> Cell:
    """Start a predicate on column ``name``."""
    return Cell(name)
