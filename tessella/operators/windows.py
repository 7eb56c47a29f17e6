"""Window calculations. A result is an expression that joins its frame with ``add_column``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import types
from tessella.errors import ArgumentError, RangeError, TypeMismatchError
from tessella.guards import aggregate, strict
from tessella.names import ORDER, quoted, resolve, resolve_all
from tessella.operators.frame import Frame


@dataclass(frozen=True)
class WindowColumn:
    """A window result bound to the rows of one frame."""

    name: str
    column: Column
    data_type: T.DataType
    nullable: bool
    lineage: object


@dataclass(frozen=True)
class WindowBuilder:
    """A window without order: partition aggregates. Without ``partition_by`` the frame is one partition
    (which Spark computes in one task)."""

    frame: Frame
    partition: tuple[str, ...] = ()

    def partition_by(self, *names: str) -> WindowBuilder:
        """Null keys form one partition; a second call replaces the first."""
        return replace(self, partition=tuple(resolve_all(self.frame.columns_list, names, "partition_by")))

    def order_by(self, name: str) -> OrderedWindow:
        return OrderedWindow(self.frame, self.partition, ())._then(name, False)

    def order_by_descending(self, name: str) -> OrderedWindow:
        return OrderedWindow(self.frame, self.partition, ())._then(name, True)

    def _spec(self) -> WindowSpec:
        return _partition(self.partition)

    def _total(self, name: str, kind: str) -> WindowColumn:
        return _aggregate(self.frame, name, kind, self._spec())

    def sum(self, name: str) -> WindowColumn:
        return self._total(name, "sum")

    def average(self, name: str) -> WindowColumn:
        return self._total(name, "average")

    def min(self, name: str) -> WindowColumn:
        return self._total(name, "min")

    def max(self, name: str) -> WindowColumn:
        return self._total(name, "max")


@dataclass(frozen=True)
class OrderedWindow:
    """A window with one or more ordering columns; ties are in frame order."""

    frame: Frame
    partition: tuple[str, ...]
    keys: tuple[tuple[str, bool], ...]

    def _then(self, name: str, descending: bool) -> OrderedWindow:
        f = self.frame.field(name)
        if not types.is_comparable(f.dataType):
            raise TypeMismatchError(f"column {f.name!r} ({f.dataType.simpleString()}) has no order")
        if f.name in [k for k, _ in self.keys]:
            raise ArgumentError(f"the window is already ordered by {f.name!r}")
        return replace(self, keys=(*self.keys, (f.name, descending)))

    def then_by(self, name: str) -> OrderedWindow:
        return self._then(name, False)

    def then_by_descending(self, name: str) -> OrderedWindow:
        return self._then(name, True)

    def _spec(self, ties: bool = True) -> WindowSpec:
        order = []
        for name, descending in self.keys:
            f = self.frame.field(name)
            key = types.ascending_key(strict(f, "a window order"), f.dataType)
            order.append(key.desc() if descending else key.asc())
        return _partition(self.partition).orderBy(*order, *([F.col(ORDER)] if ties else []))

    def _column(self, name: str, c: Column, t: T.DataType, nullable: bool) -> WindowColumn:
        return WindowColumn(name, c, t, nullable, self.frame._lineage)

    def row_number(self) -> WindowColumn:
        return self._column("RowNumber", F.row_number().over(self._spec()), T.IntegerType(), False)

    def rank(self) -> WindowColumn:
        return self._column("Rank", F.rank().over(self._spec(False)), T.IntegerType(), False)

    def dense_rank(self) -> WindowColumn:
        return self._column("DenseRank", F.dense_rank().over(self._spec(False)), T.IntegerType(), False)

    def _shift(self, name: str, offset: int, f) -> WindowColumn:  # noqa: ANN001
        if not isinstance(offset, int) or isinstance(offset, bool) or offset <= 0:
            raise RangeError("the offset must be greater than zero")
        field = self.frame.field(name)
        return self._column(field.name, f(F.col(quoted(field.name)), offset).over(self._spec()), field.dataType, True)

    def lag(self, name: str, offset: int = 1) -> WindowColumn:
        return self._shift(name, offset, F.lag)

    def lead(self, name: str, offset: int = 1) -> WindowColumn:
        return self._shift(name, offset, F.lead)

    def _end(self, name: str, f) -> WindowColumn:  # noqa: ANN001
        field = self.frame.field(name)
        whole = self._spec().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self._column(field.name, f(F.col(quoted(field.name))).over(whole), field.dataType, field.nullable)

    def first_value(self, name: str) -> WindowColumn:
        """The first value of the whole partition, null or not."""
        return self._end(name, F.first)

    def last_value(self, name: str) -> WindowColumn:
        """The last value of the whole partition, null or not."""
        return self._end(name, F.last)

    def _framed(self, name: str, kind: str, before: int) -> WindowColumn:
        return _aggregate(self.frame, name, kind, self._spec().rowsBetween(before, Window.currentRow))

    def running_sum(self, name: str) -> WindowColumn:
        return self._framed(name, "sum", Window.unboundedPreceding)

    def running_average(self, name: str) -> WindowColumn:
        return self._framed(name, "average", Window.unboundedPreceding)

    def moving_sum(self, name: str, size: int) -> WindowColumn:
        return self._framed(name, "sum", 1 - _size(size))

    def moving_average(self, name: str, size: int) -> WindowColumn:
        return self._framed(name, "average", 1 - _size(size))


def _size(size: int) -> int:
    if not isinstance(size, int) or isinstance(size, bool) or size <= 0:
        raise RangeError("the window size must be greater than zero")
    return size


def _partition(names: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*map(quoted, names)) if names else Window.partitionBy(F.lit(0))


def _aggregate(frame: Frame, name: str, kind: str, spec: WindowSpec) -> WindowColumn:
    f = frame.schema[resolve(frame.columns_list, name)]
    c = aggregate(f, kind, spec)
    t = T.DoubleType() if kind == "average" else types.sum_type(f.dataType) if kind == "sum" else f.dataType
    return WindowColumn(f.name, c, t, False, frame._lineage)
