"""Adding, replacing and removing single rows. Each returns a new frame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import types
from tessella.errors import ArgumentError
from tessella.names import ORDER, check_name, check_unique, quoted
from tessella.operators.frame import Frame
from tessella.plans.order import nested, order_type, with_order


def _checked(frame: Frame, values: Mapping[str, Any]) -> dict[str, Any]:
    """Values for all columns of the frame and no others, of exactly their types."""
    if not isinstance(values, Mapping):
        raise ArgumentError("a row is a mapping of column names to values")
    for n in values:
        check_name(n)
    check_unique(values)
    given = {n.lower(): v for n, v in values.items()}
    names = {c.lower() for c in frame.columns_list}
    if set(given) != names:
        raise ArgumentError(f"the row and the frame differ in columns {sorted(set(given) ^ names)}")
    return {f.name: types.check_value(given[f.name.lower()], f.dataType, f.nullable, f.name) for f in frame.schema.fields}


def add_row(frame: Frame, values: Mapping[str, Any]) -> Frame:
    """Append one row."""
    row = _checked(frame, values)
    df = with_order(frame._df)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in frame.schema.fields])
    new = frame.spark.createDataFrame([tuple(row.values())], schema)
    new = new.withColumn(ORDER, nested(F.lit(1), F.lit(None).cast(order_type(df))))
    old = df.withColumn(ORDER, nested(F.lit(0), F.col(ORDER)))
    return Frame(old.unionByName(new), frame._declared)


def update_row(frame: Frame, i: int, values: Mapping[str, Any]) -> Frame:
    """Replace the row at ``i``."""
    row = _checked(frame, values)
    df, at = frame._order_at(i)
    marked = df.withColumn("__hit", F.col(ORDER) == at)
    out = [F.when(F.col("__hit"), F.lit(row[f.name]).cast(f.dataType)).otherwise(F.col(quoted(f.name))).alias(f.name) for f in frame.schema.fields]
    return Frame(marked.select(*out, ORDER), frame._declared)


def remove_row(frame: Frame, i: int) -> Frame:
    """Delete the row at ``i``."""
    df, at = frame._order_at(i)
    return Frame(df.filter(F.col(ORDER) != at), frame._declared)
