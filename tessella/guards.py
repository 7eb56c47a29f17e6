"""Guards that turn nulls into errors inside the expression that would skip them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import types
from tessella.errors import TypeMismatchError
from tessella.names import quoted


def strict(field: T.StructField, what: str) -> Column:
    """The column of ``field``; evaluating a null raises. Non-nullable columns pay nothing."""
    c = F.col(quoted(field.name))
    if not field.nullable:
        return c
    return F.when(c.isNull(), F.raise_error(F.lit(f"column '{field.name}' holds null; {what} needs values"))).otherwise(c)


def sum_of(field: T.StructField) -> Column:
    """Type-preserving checked sum (as an aggregate or over a window)."""
    return F.sum(strict(field, "a sum"))


def check_aggregate(field: T.StructField, kind: str) -> T.DataType:
    """Result type of an aggregate, or an error if the column does not support it."""
    t = field.dataType
    if kind in ("sum", "average"):
        if not types.is_numeric(t):
            raise TypeMismatchError(f"column {field.name!r} ({t.simpleString()}) is not numeric")
        return types.sum_type(t) if kind == "sum" else T.DoubleType()
    if not types.is_comparable(t):
        raise TypeMismatchError(f"column {field.name!r} ({t.simpleString()}) has no order")
    return t


def aggregate(field: T.StructField, kind: str, over=None) -> Column:
    """One of sum, average, min, max with the frame's null, NaN and type rules; ``over``: a window."""
    t = check_aggregate(field, kind)
    run = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    c = strict(field, f"{kind}")
    if kind == "sum":
        return run(F.sum(c)).cast(t)
    if kind == "average":
        if isinstance(field.dataType, T.DecimalType):
            wide = run(F.sum(c)).cast(T.DecimalType(38, max(field.dataType.scale, 6)))
            return (wide / run(F.count(F.lit(1)))).cast("double")
        return run(F.sum(c)).cast(types.sum_type(field.dataType)).cast("double") / run(F.count(F.lit(1)))
    if isinstance(field.dataType, types.FLOATS):
        nan = F.lit(float("nan")).cast(field.dataType)
        if kind == "min":
            return F.when(run(F.max(F.isnan(c))), nan).otherwise(run(F.min(c)))
        return F.coalesce(run(F.max(F.when(~F.isnan(c), c))), F.when(run(F.max(F.isnan(c))), nan))
    return run(F.min(c) if kind == "min" else F.max(c))
