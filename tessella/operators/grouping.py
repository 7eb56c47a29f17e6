"""Grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tessella.errors import ArgumentError, EmptyFrameError
from tessella.guards import aggregate, check_aggregate, strict
from tessella.names import ORDER, check_unique, quoted, resolve
from tessella.operators.frame import Frame
from tessella.plans.order import with_order

SUFFIX = {"sum": "Sum", "average": "Average", "min": "Min", "max": "Max"}


class AggregateBuilder:
    """``b.column("v").sum().average().column("w").max()``: several aggregates in one pass."""

    def __init__(self, frame: Frame) -> None:
        self._frame, self._current = frame, ""
        self.items: list[tuple[str, str]] = []

    def column(self, name: str) -> AggregateBuilder:
        self._current = resolve(self._frame.columns_list, name)
        return self

    def _add(self, kind: str) -> AggregateBuilder:
        if not self._current:
            raise ArgumentError("choose a column first")
        check_aggregate(self._frame.field(self._current), kind)
        self.items.append((self._current, kind))
        return self

    def sum(self) -> AggregateBuilder:
        return self._add("sum")

    def average(self) -> AggregateBuilder:
        return self._add("average")

    def min(self) -> AggregateBuilder:
        return self._add("min")

    def max(self) -> AggregateBuilder:
        return self._add("max")


class GroupedFrame:
    """Groups in first-seen order. Null keys raise. Aggregates are named ``{column}_{Kind}``."""

    def __init__(self, frame: Frame, keys: list[str], require_rows: bool = False) -> None:
        self._frame, self._keys, self._require_rows = frame, keys, require_rows

    def sum(self, name: str) -> Frame:
        return self.aggregate(lambda b: b.column(name).sum())

    def average(self, name: str) -> Frame:
        return self.aggregate(lambda b: b.column(name).average())

    def min(self, name: str) -> Frame:
        return self.aggregate(lambda b: b.column(name).min())

    def max(self, name: str) -> Frame:
        return self.aggregate(lambda b: b.column(name).max())

    def aggregate(self, configure: Callable[[AggregateBuilder], AggregateBuilder]) -> Frame:
        """All aggregates of one configuration in a single partial + final aggregation."""
        if not callable(configure):
            raise ArgumentError("aggregate needs a configuration function")
        builder = configure(AggregateBuilder(self._frame))
        if not isinstance(builder, AggregateBuilder):
            raise ArgumentError("the configuration must return the builder")
        if not builder.items:
            raise ArgumentError("no aggregate was configured")
        if self._require_rows and self._frame.df.isEmpty():
            raise EmptyFrameError("aggregates of no rows")
        names = [f"{c}_{SUFFIX[k]}" for c, k in builder.items]
        check_unique([*self._keys, *names], "output column")
        keys = [strict(self._frame.field(k), "grouping").alias(k) for k in self._keys]
        aggs = [aggregate(self._frame.field(c), k).alias(n) for (c, k), n in zip(builder.items, names, strict=True)]
        out = with_order(self._frame._df).groupBy(*keys).agg(*aggs, F.min(ORDER).alias(ORDER))
        return Frame(out.select(*map(quoted, [*self._keys, *names]), ORDER), frozenset([*self._keys, *names]))
