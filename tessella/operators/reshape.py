"""Pivot, aggregated pivot and unpivot."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import types
from tessella.errors import ArgumentError, NullValueError, TypeMismatchError
from tessella.guards import aggregate, check_aggregate
from tessella.names import ORDER, check_name, check_unique, quoted, resolve, resolve_all
from tessella.operators.frame import Frame
from tessella.plans.order import nested, with_order

#: More pivot columns than this are refused: each becomes a column of the result's schema.
MAX_PIVOT_COLUMNS = 10_000


def column_label(value: Any) -> str:
    """The column name of a pivot value: invariant, round-trippable text."""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, float):
        return _number_label(value)
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, dt.datetime):
        text = value.strftime("%Y-%m-%dT%H:%M:%S") + f".{value.microsecond:06d}0"
        return text if value.tzinfo is None else text + value.strftime("%z")[:3] + ":" + value.strftime("%z")[3:5]
    if isinstance(value, dt.timedelta):
        sign, value = ("-", -value) if value < dt.timedelta(0) else ("", value)
        minutes, seconds = divmod(value.seconds, 60)
        text = f"{minutes // 60:02d}:{minutes % 60:02d}:{seconds:02d}" + (f".{value.microseconds:06d}0" if value.microseconds else "")
        return sign + (f"{value.days}." if value.days else "") + text
    return str(value)


def _number_label(value: float) -> str:
    """Shortest round-trip digits; exponents from 1E+15 and below 1E-05 as ``1E+15``."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "-0" if str(value)[0] == "-" else "0"
    digits = decimal.Decimal(repr(value)).normalize()
    exponent = digits.adjusted()
    if -5 <= exponent < 15:
        return format(digits, "f")
    sign, figures, _ = digits.as_tuple()
    mantissa = str(figures[0]) + ("." + "".join(map(str, figures[1:])) if len(figures) > 1 else "")
    return f"{'-' if sign else ''}{mantissa}E{'+' if exponent >= 0 else '-'}{abs(exponent):02d}"


def _roles(frame: Frame, index: str, columns: str, values: str) -> tuple[str, str, str]:
    found = [resolve(frame.columns_list, n) for n in (index, columns, values)]
    check_unique(found, "pivot role")
    t = frame.field(found[1]).dataType
    if isinstance(t, (*types.COMPLEX, T.BinaryType, T.DateType)):
        raise TypeMismatchError(f"column {found[1]!r} ({t.simpleString()}) can't name columns")
    return found[0], found[1], found[2]


def _labels(frame: Frame, index: str, columns: str) -> list[tuple[Any, str]]:
    """Distinct pivot values in first-seen order (their number is the result's width, so it is bounded)."""
    seen = with_order(frame._df).groupBy(F.col(quoted(columns)).alias("v")).agg(F.min(ORDER).alias("o"))
    found = [r["v"] for r in seen.orderBy("o").select("v").limit(MAX_PIVOT_COLUMNS + 1).collect()]
    if len(found) > MAX_PIVOT_COLUMNS:
        raise ArgumentError(f"column {columns!r} has more than {MAX_PIVOT_COLUMNS} distinct values")
    if None in found:
        raise NullValueError(f"column {columns!r} holds null and can't name columns")
    labels = [(v, column_label(v)) for v in found]
    for _, name in labels:
        check_name(name, "pivot column name")
    check_unique([index, *(n for _, n in labels)], "pivot column name")
    return labels


def _pivot(frame: Frame, index: str, columns: str, labels: list[tuple[Any, str]], cell) -> DataFrame:  # noqa: ANN001
    """One partial + final aggregation on (index, pivot value), then one that spreads the cells."""
    df = with_order(frame._df)
    keyed = df.groupBy(F.col(quoted(index)).alias("i"), F.col(quoted(columns)).alias("c"))
    cells = keyed.agg(cell.alias("v"), F.min(ORDER).alias("o"))
    t = frame.field(columns).dataType
    spread: list[Column] = []
    for n, (value, _) in enumerate(labels):
        same = F.isnan("c") if isinstance(value, float) and value != value else F.col("c") == F.lit(value).cast(t)
        spread.append(F.first(F.when(same, F.col("v")), ignorenulls=True).alias(f"c{n}"))
    out = cells.groupBy("i").agg(*spread, F.min("o").alias(ORDER))
    return out.select(F.col("i").alias(index), *[F.col(f"c{n}").alias(name) for n, (_, name) in enumerate(labels)], ORDER)


def _index_only(frame: Frame, index: str) -> Frame:
    return Frame(with_order(frame._df).select(quoted(index), ORDER).limit(0))


def pivot(frame: Frame, index: str, columns: str, values: str) -> Frame:
    """Spread ``values`` over one column per distinct value of ``columns``, one row per ``index``.

    Rows and columns are in first-seen order, absent cells are null, a second row for a cell raises. Null
    is an index of its own. No rows: a frame with only the index column.
    """
    index, columns, values = _roles(frame, index, columns, values)
    labels = _labels(frame, index, columns)
    if not labels:
        return _index_only(frame, index)
    twice = F.raise_error(F.lit(f"several rows for one cell of {index!r} and {columns!r}"))
    cell = F.when(F.count(F.lit(1)) > 1, twice.cast(frame.field(values).dataType)).otherwise(F.first(quoted(values)))
    return Frame(_pivot(frame, index, columns, labels, cell))


class PivotTable:
    """An aggregated pivot: ``sum``, ``average``, ``min`` or ``max`` of each cell's rows."""

    def __init__(self, frame: Frame, index: str, columns: str, values: str) -> None:
        self._frame = frame
        self._index, self._columns, self._values = _roles(frame, index, columns, values)

    def _run(self, kind: str) -> Frame:
        f = self._frame.field(self._values)
        check_aggregate(f, kind)
        labels = _labels(self._frame, self._index, self._columns)
        if not labels:
            return _index_only(self._frame, self._index)
        return Frame(_pivot(self._frame, self._index, self._columns, labels, aggregate(f, kind)))

    def sum(self) -> Frame:
        return self._run("sum")

    def average(self) -> Frame:
        return self._run("average")

    def min(self) -> Frame:
        return self._run("min")

    def max(self) -> Frame:
        return self._run("max")


def unpivot(frame: Frame, ids: Sequence[str], values: Sequence[str], variable_name: str, value_name: str) -> Frame:
    """One row per (value column, row), all rows of the first value column first; nulls are kept."""
    kept = resolve_all(frame.columns_list, ids, "unpivot ids") if ids else []
    spread = resolve_all(frame.columns_list, values, "unpivot")
    check_unique([*kept, *spread], "unpivot role")
    for n in (variable_name, value_name):
        check_name(n)
        if any(n.lower() == c.lower() for c in frame.columns_list):
            raise ArgumentError(f"column {n!r} exists")
    check_unique([variable_name, value_name])
    t = types.unpivot_type([frame.field(c).dataType for c in spread])
    # One pass over the rows: an array of structs is exploded, nothing is scanned twice.
    items = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(c).alias("n"), F.col(quoted(c)).cast(t).alias("v")) for i, c in enumerate(spread)])
    df = with_order(frame._df).select(*map(quoted, kept), ORDER, F.explode(items).alias("__e"))
    out = df.select(*map(quoted, kept), F.col("__e.n").alias(variable_name), F.col("__e.v").alias(value_name), nested(F.col("__e.p"), F.col(ORDER)).alias(ORDER))
    declared = {variable_name} | {c for c in kept if not frame.field(c).nullable}
    if not any(frame.field(c).nullable for c in spread):
        declared.add(value_name)
    return Frame(out, frozenset(declared))
