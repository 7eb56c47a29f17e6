"""Row order as a column.

Frames have an order that users can see (head, first-seen groups, windows with ties). Spark's rows have
none, so a frame may carry a hidden column whose ascending order is the frame's order. It is only read by
operators that depend on order; otherwise column pruning removes it, down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.names import ORDER


def with_order(df: DataFrame) -> DataFrame:
    """``df`` with the hidden column; rows without a known order get the order in which Spark reads them."""
    return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())


def order_type(df: DataFrame) -> T.DataType:
    return df.schema[ORDER].dataType


def nested(*parts: Column) -> Column:
    """An order by the first part, then the second, and so on."""
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
