"""Frame: an immutable, ordered, strictly validated table over a Spark DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import Row as SparkRow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import types
from tessella.errors import ArgumentError, EmptyFrameError, MissingColumnError, RangeError, TypeMismatchError
from tessella.functions.predicates import Predicate
from tessella.guards import aggregate, check_aggregate, strict
from tessella.names import ORDER, check_name, check_unique, quoted, resolve, resolve_all
from tessella.plans.order import nested, order_type, with_order


class Row:
    """One fetched row with exact-type getters; a null or another type raises."""

    def __init__(self, row: SparkRow, schema: T.StructType) -> None:
        self._row, self._schema = row, schema

    @property
    def column_names(self) -> list[str]:
        return self._schema.fieldNames()

    def has_column(self, name: str) -> bool:
        check_name(name)
        return name.lower() in {c.lower() for c in self.column_names}

    def __getitem__(self, name: str) -> Any:
        return self._row[resolve(self.column_names, name)]

    def _get(self, name: str, kind: type) -> Any:
        f = self._schema[resolve(self.column_names, name)]
        if not isinstance(f.dataType, kind):
            raise TypeMismatchError(f"column {f.name!r} is {f.dataType.simpleString()}, not {kind.__name__}")
        if (value := self._row[f.name]) is None:
            raise TypeMismatchError(f"column {f.name!r} is null in this row")
        return value

    def string(self, name: str) -> str:
        return self._get(name, T.StringType)

    def int(self, name: str) -> int:
        return self._get(name, T.IntegerType)

    def long(self, name: str) -> int:
        return self._get(name, T.LongType)

    def decimal(self, name: str) -> Any:
        return self._get(name, T.DecimalType)

    def double(self, name: str) -> float:
        return self._get(name, T.DoubleType)

    def bool(self, name: str) -> bool:
        return self._get(name, T.BooleanType)

    def datetime(self, name: str) -> Any:
        return self._get(name, (T.TimestampNTZType, T.TimestampType))  # type: ignore[arg-type]

    def as_dict(self) -> dict[str, Any]:
        return {c: self._row[c] for c in self.column_names}


class Columns:
    """Read view of a frame's columns, plus the column mutations (each returns a new frame)."""

    def __init__(self, frame: Frame) -> None:
        self._frame = frame

    def __getitem__(self, i: int) -> Series:
        if not 0 <= i < len(self._frame.columns_list):
            raise RangeError(f"column index {i} is out of range")
        return self._frame.column(self._frame.columns_list[i])

    def __iter__(self) -> Iterator[Series]:
        return (self._frame.column(c) for c in self._frame.columns_list)

    def __len__(self) -> int:
        return len(self._frame.columns_list)

    count = __len__

    def add(self, name: str, values: Any) -> Frame:
        return self._frame.add_column(name, values)

    def remove(self, name: str) -> Frame:
        return self._frame.remove_column(name)

    def rename(self, old: str, new: str) -> Frame:
        return self._frame.rename(old, new)


class Series:
    """A named column of a frame, or a detached vector of values."""

    def __init__(self, name: str, data_type: T.DataType, nullable: bool, frame: Frame | None = None, values: Sequence[Any] | None = None) -> None:
        self.name, self.data_type, self.nullable, self._frame, self._values = name, data_type, nullable, frame, values

    @classmethod
    def create(cls, name: str, values: Sequence[Any]) -> Series:
        """A detached snapshot of ``values``."""
        check_name(name, "series name")
        if values is None:
            raise ArgumentError("a series needs values")
        kept = tuple(values)
        return cls(name, types.infer_type(kept), None in kept, values=kept)

    @property
    def values(self) -> tuple[Any, ...]:
        """All values in frame order (an action for a frame's column)."""
        if self._values is None:
            assert self._frame is not None
            self._values = tuple(r[0] for r in self._frame.select(self.name).rows())
        return tuple(self._values)

    def __len__(self) -> int:
        return len(self._values) if self._values is not None else self._frame.count()  # type: ignore[union-attr]

    def __getitem__(self, i: int) -> Any:
        """The value at ``i``; a frame's column fetches that one row only."""
        if self._values is None:
            return self._frame.row(i)[self.name]  # type: ignore[union-attr]
        if not 0 <= i < len(self._values):
            raise RangeError(f"index {i} is out of range")
        return self._values[i]


class Rows:
    """The rows of a frame."""

    def __init__(self, frame: Frame) -> None:
        self._frame = frame

    def count(self) -> int:
        return self._frame.count()

    __len__ = count

    def __getitem__(self, i: int) -> Row:
        return self._frame.row(i)

    def __iter__(self) -> Iterator[Row]:
        schema = self._frame.schema
        return (Row(r, schema) for r in self._frame.iter_rows())


class FrameSchema:
    """Ordered columns with unique names, found without regard to case."""

    def __init__(self, fields: Sequence[T.StructField]) -> None:
        if not fields:
            raise ArgumentError("a schema needs at least one column")
        for f in fields:
            check_name(f.name)
        check_unique([f.name for f in fields])
        self.fields = tuple(fields)

    @classmethod
    def of(cls, frame: Frame) -> FrameSchema:
        return cls(frame.schema.fields)

    @property
    def struct(self) -> T.StructType:
        return T.StructType(list(self.fields))

    def contains_column(self, name: str) -> bool:
        check_name(name)
        return name.lower() in {f.name.lower() for f in self.fields}

    def ordinal(self, name: str) -> int:
        """The position of a column, from 0."""
        return [f.name for f in self.fields].index(resolve([f.name for f in self.fields], name))

    def column(self, name: str) -> T.StructField:
        return self.fields[self.ordinal(name)]

    def __len__(self) -> int:
        return len(self.fields)

    def __iter__(self) -> Iterator[T.StructField]:
        return iter(self.fields)


class Frame:
    """A table with at least one column, unique case-insensitive names and a row order.

    Every method validates names and types when called and returns a new frame (or a value); errors that
    depend on data (nulls, overflow) are raised by the action that computes them.
    """

    def __init__(self, df: DataFrame, not_null: frozenset[str] = frozenset(), lineage: object | None = None) -> None:
        names = [c for c in df.columns if c != ORDER]
        if not names:
            raise ArgumentError("a frame needs at least one column")
        for n in names:
            check_name(n)
        check_unique(names)
        self._df, self._declared = df, not_null
        #: Frames with equal lineage have the same rows, so a window of one fits the other.
        self._lineage = lineage if lineage is not None else object()

    # -- construction

    @classmethod
    def create(cls, spark: SparkSession, columns: Mapping[str, Sequence[Any]], schema: T.StructType | None = None) -> Frame:
        """A frame of literal columns of equal length; with ``schema``: in its order and of its types."""
        if not isinstance(columns, Mapping) or not columns:
            raise ArgumentError("a frame needs at least one column")
        data: dict[str, list[Any]] = {}
        for name, values in columns.items():
            check_name(name)
            if isinstance(values, (str, bytes)) or values is None:
                raise ArgumentError(f"column {name!r} needs a sequence of values")
            data[name] = list(values.values if isinstance(values, Series) else values)
        check_unique(data)
        if len({len(v) for v in data.values()}) > 1:
            raise ArgumentError("columns differ in length")
        if schema is None:
            schema = T.StructType([T.StructField(n, types.infer_type(v), None in v or isinstance(types.infer_type(v), (T.StringType, T.BinaryType))) for n, v in data.items()])
        else:
            check_unique(schema.fieldNames())
            given = {n.lower(): n for n in data}
            wanted = {f.name.lower() for f in schema.fields}
            if set(given) != wanted:
                raise ArgumentError(f"columns and schema differ: {sorted(set(given) ^ wanted)}")
            data = {f.name: data[given[f.name.lower()]] for f in schema.fields}
        checked = [[types.check_value(v, f.dataType, f.nullable, f.name) for v in data[f.name]] for f in schema.fields]
        rows = [(*values, i) for i, values in enumerate(zip(*checked, strict=True))]
        full = T.StructType([*schema.fields, T.StructField(ORDER, T.LongType(), False)])
        return cls(spark.createDataFrame(rows, full))

    @classmethod
    def from_dataframe(cls, df: DataFrame, not_null: Sequence[str] = ()) -> Frame:
        """Wrap a DataFrame; ``not_null`` names columns that are known to hold no nulls."""
        return cls(df, frozenset(resolve(df.columns, n) for n in not_null))

    def not_null(self, *names: str) -> Frame:
        """Promise that the columns (all, if none is named) hold no nulls: guards vanish, filters push down."""
        return self._like(self._df, self._declared | frozenset(resolve_all(self.columns_list, names, "not_null") if names else self.columns_list))

    def copy(self) -> Frame:
        """The frame itself: frames never change."""
        return self

    def _like(self, df: DataFrame, not_null: frozenset[str] | None = None) -> Frame:
        return Frame(df, self._declared if not_null is None else not_null, self._lineage)

    def _with_rows(self, df: DataFrame) -> Frame:
        return Frame(df, self._declared)

    # -- metadata

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def df(self) -> DataFrame:
        """The user columns as a DataFrame, without order."""
        return self._df.drop(ORDER) if ORDER in self._df.columns else self._df

    def df_with_position(self, name: str) -> DataFrame:
        """The user columns, and each row's place in frame order, from 1."""
        check_unique([*self.columns_list, name])
        return dense_index(with_order(self._df)).withColumn(name, (F.col("__i") + 1).cast("int")).drop("__i", ORDER)

    @property
    def rows_view(self) -> Rows:
        """Rows by position, their number, and iteration in frame order."""
        return Rows(self)

    @property
    def ordered_df(self) -> DataFrame:
        """The user columns, sorted in frame order."""
        return with_order(self._df).orderBy(ORDER).drop(ORDER)

    @property
    def columns_list(self) -> list[str]:
        return [c for c in self._df.columns if c != ORDER]

    @property
    def columns(self) -> Columns:
        return Columns(self)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in self._declared) for f in self._df.schema.fields if f.name != ORDER])

    def field(self, name: str) -> T.StructField:
        return self.schema[resolve(self.columns_list, name)]

    def column(self, name: str) -> Series:
        f = self.field(name)
        return Series(f.name, f.dataType, f.nullable, self)

    __getitem__ = column

    def has_column(self, name: str, data_type: T.DataType | None = None, nullable: bool | None = None) -> bool:
        """Whether the column exists and, where given, has exactly this type and nullability."""
        check_name(name)
        try:
            f = self.field(name)
        except MissingColumnError:
            return False
        return (data_type is None or f.dataType == data_type) and (nullable is None or f.nullable == nullable)

    def require_column(self, name: str, data_type: T.DataType | None = None, nullable: bool | None = None) -> Series:
        """The column, or an error if it is missing or of another type."""
        f = self.field(name)
        if not self.has_column(name, data_type, nullable):
            raise TypeMismatchError(f"column {f.name!r} is {f.dataType.simpleString()}{'' if f.nullable else ' not null'}, not the required type")
        return self.column(name)

    # -- rows

    def count(self) -> int:
        return self._df.count()

    def rows(self) -> list[SparkRow]:
        """All rows in frame order, on the driver."""
        return self.ordered_df.collect()

    def iter_rows(self) -> Iterator[SparkRow]:
        """All rows in frame order, fetched one partition at a time."""
        return self.ordered_df.toLocalIterator()

    def to_dict(self) -> dict[str, list[Any]]:
        rows = self.rows()
        return {c: [r[i] for r in rows] for i, c in enumerate(self.columns_list)}

    def _order_at(self, i: int) -> tuple[DataFrame, Column]:
        """The ordered DataFrame and the order value of row ``i`` as a literal-like column."""
        if not isinstance(i, int) or isinstance(i, bool) or i < 0:
            raise RangeError(f"row index {i!r} is out of range")
        df = with_order(self._df)
        found = df.select(ORDER).orderBy(ORDER).limit(i + 1).offset(i)
        if not found.take(1):
            raise RangeError(f"row index {i} is out of range")
        return df, found.scalar()

    def row(self, i: int) -> Row:
        """The row at ``i`` (a top-k plan: no other row reaches the driver)."""
        if not isinstance(i, int) or isinstance(i, bool) or i < 0:
            raise RangeError(f"row index {i!r} is out of range")
        found = with_order(self._df).orderBy(ORDER).limit(i + 1).offset(i).drop(ORDER).collect()
        if not found:
            raise RangeError(f"row index {i} is out of range")
        return Row(found[0], self.schema)

    # -- projection

    def select(self, *names: str) -> Frame:
        kept = resolve_all(self.columns_list, names, "select")
        hidden = [ORDER] if ORDER in self._df.columns else []
        return self._like(self._df.select(*map(quoted, kept), *hidden))

    def drop(self, *names: str) -> Frame:
        gone = set(resolve_all(self.columns_list, names, "drop"))
        if len(gone) == len(self.columns_list):
            raise ArgumentError("a frame needs at least one column")
        return self.select(*[c for c in self.columns_list if c not in gone])

    def remove_column(self, name: str) -> Frame:
        return self.drop(name)

    def rename(self, old: str, new: str) -> Frame:
        """Rename in place; changing only the case is allowed."""
        old = resolve(self.columns_list, old)
        check_name(new)
        if any(c.lower() == new.lower() for c in self.columns_list if c != old):
            raise ArgumentError(f"column {new!r} exists")
        declared = frozenset(new if n == old else n for n in self._declared)
        return self._like(self._df.select(*[F.col(quoted(c)).alias(new if c == old else c) for c in self._df.columns]), declared)

    def add_column(self, name: str, values: Any) -> Frame:
        """Append a window result of this frame (lazily), a series or a list of literal values (by position)."""
        from tessella.operators.windows import WindowColumn

        check_name(name)
        if any(c.lower() == name.lower() for c in self.columns_list):
            raise ArgumentError(f"column {name!r} exists")
        if isinstance(values, WindowColumn):
            if values.lineage is not self._lineage:
                raise ArgumentError("the window was made from a frame with other rows")
            df = with_order(self._df)
            new = df.withColumn(name, values.column)
            return self._like(new, self._declared | (frozenset() if values.nullable else {name}))
        if isinstance(values, Series) and values._values is None:
            assert values._frame is not None
            if values._frame._lineage is self._lineage and values.name in self.columns_list:
                return self._like(self._df.withColumn(name, F.col(quoted(values.name))))
        given = list(values.values) if isinstance(values, Series) else list(values)
        t = values.data_type if isinstance(values, Series) else types.infer_type(given)
        if len(given) != self.count():
            raise ArgumentError(f"{len(given)} values for {self.count()} rows")
        return self._zip(name, given, t)

    def _zip(self, name: str, values: list[Any], t: T.DataType) -> Frame:
        """Join literal values by position: ranks are counted per range partition, not in one task."""
        nullable = None in values
        right = self.spark.createDataFrame([(i, types.check_value(v, t, True, name)) for i, v in enumerate(values)], T.StructType([T.StructField("__i", T.LongType(), False), T.StructField(name, t, nullable)]))
        left = dense_index(with_order(self._df))
        joined = left.join(right, "__i").drop("__i")
        return self._like(joined.select(*map(quoted, [*self.columns_list, name]), ORDER), self._declared | (frozenset() if nullable else {name}))

    # -- filters, sorting, limits, distinct

    def filter(self, predicate: Predicate | Callable[[Any], bool]) -> Frame:
        """Keep rows for which the predicate holds. A Python callable runs row by row and can't be pushed down."""
        if isinstance(predicate, Predicate):
            return self._with_rows(self._df.filter(predicate.bind(self.schema)))
        if not callable(predicate):
            raise ArgumentError("filter needs a predicate")
        names = self.columns_list
        test = F.udf(lambda *v: bool(predicate(dict(zip(names, v, strict=True)))), "boolean")
        return self._with_rows(self._df.filter(test(*[F.col(quoted(c)) for c in names])))

    def sort_by(self, name: str, descending: bool = False) -> Frame:
        """Stable sort on one column; nulls raise, NaN is lowest."""
        f = self.field(name)
        if not types.is_comparable(f.dataType):
            raise TypeMismatchError(f"column {f.name!r} ({f.dataType.simpleString()}) has no order")
        key = (types.descending_key if descending else types.ascending_key)(strict(f, "sorting"), f.dataType)
        df = with_order(self._df)
        return self._with_rows(df.withColumn(ORDER, nested(key, F.col(ORDER))))

    def sort_by_descending(self, name: str) -> Frame:
        return self.sort_by(name, True)

    def head(self, n: int) -> Frame:
        """The first ``n`` rows."""
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise RangeError(f"row count {n!r} must not be negative")
        return self._with_rows(with_order(self._df).orderBy(ORDER).limit(n))

    take = head

    def distinct(self, *names: str) -> Frame:
        """First-seen row of each distinct row, or of each distinct key; null equals null."""
        keys = resolve_all(self.columns_list, names, "distinct") if names else self.columns_list
        for k in keys:
            if isinstance(self.field(k).dataType, T.MapType):
                raise TypeMismatchError(f"column {k!r} is a map and has no equality")
        df = with_order(self._df)
        if len(keys) == len(self.columns_list) and not any(isinstance(self.field(k).dataType, (T.FloatType, T.DoubleType, *types.COMPLEX)) for k in keys):
            # A row is its own key: a partial aggregate, without a sort.
            first = df.groupBy(*map(quoted, self.columns_list)).agg(F.min(ORDER).alias(ORDER))
            return self._with_rows(first)
        w = Window.partitionBy(*map(quoted, keys)).orderBy(ORDER)
        return self._with_rows(df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"))

    # -- aggregates of the whole frame

    def _scalar(self, name: str, kind: str) -> Any:
        f = self.field(name)
        check_aggregate(f, kind)
        row = self._df.agg(F.count(F.lit(1)).alias("n"), aggregate(f, kind).alias("v")).first()
        if not row["n"]:
            raise EmptyFrameError(f"{kind} of no rows")
        return row["v"]

    def sum(self, name: str) -> Any:
        return self._scalar(name, "sum")

    def average(self, name: str) -> float:
        return self._scalar(name, "average")

    def min(self, name: str) -> Any:
        return self._scalar(name, "min")

    def max(self, name: str) -> Any:
        return self._scalar(name, "max")

    # -- builders

    def group_by(self, *names: str, require_rows: bool = False):  # noqa: ANN201
        """Groups by keys; with ``require_rows`` an empty frame raises at the aggregate (one small job), else it has no groups."""
        from tessella.operators.grouping import GroupedFrame

        return GroupedFrame(self, resolve_all(self.columns_list, names, "group_by"), require_rows)

    def window(self):  # noqa: ANN201
        from tessella.operators.windows import WindowBuilder

        return WindowBuilder(self)

    def _join(self, other: Frame, kind: str):  # noqa: ANN202
        from tessella.operators.joins import PendingJoin

        if not isinstance(other, Frame):
            raise ArgumentError("a join needs another frame")
        return PendingJoin(self, other, kind)

    def inner_join(self, other: Frame):  # noqa: ANN201
        return self._join(other, "inner")

    def left_join(self, other: Frame):  # noqa: ANN201
        return self._join(other, "left")

    def right_join(self, other: Frame):  # noqa: ANN201
        return self._join(other, "right")

    def full_join(self, other: Frame):  # noqa: ANN201
        return self._join(other, "full")

    def pivot(self, index: str, columns: str, values: str) -> Frame:
        from tessella.operators.reshape import pivot

        return pivot(self, index, columns, values)

    def pivot_table(self, index: str, columns: str, values: str):  # noqa: ANN201
        from tessella.operators.reshape import PivotTable

        return PivotTable(self, index, columns, values)

    def unpivot(self, ids: Sequence[str], values: Sequence[str], variable_name: str, value_name: str) -> Frame:
        from tessella.operators.reshape import unpivot

        return unpivot(self, ids, values, variable_name, value_name)

    # -- row changes

    def add_row(self, values: Mapping[str, Any]) -> Frame:
        from tessella.operators.rows import add_row

        return add_row(self, values)

    def update_row(self, i: int, values: Mapping[str, Any]) -> Frame:
        from tessella.operators.rows import update_row

        return update_row(self, i, values)

    def remove_row(self, i: int) -> Frame:
        from tessella.operators.rows import remove_row

        return remove_row(self, i)


#: Rows drawn as bounds between ranges: ``2**BOUND_BITS - 1`` at most.
BOUND_BITS = 10


def dense_index(df: DataFrame) -> DataFrame:
    """``df`` with ``__i``: 0, 1, 2, ... in frame order, without moving all rows to one task.

    Rows are dealt to ranges of the order, ranked within each range, and shifted by the row counts of the ranges before.
    The counts come from a join (one small row per range), that is from another pass over the rows: a row's range must be
    a function of values alone, which Spark's own range partitions are not (each pass samples and merges them anew). The
    bounds are the rows with the smallest hashes, so ranges are about equal.
    """
    drawn = df.select(ORDER).orderBy(F.xxhash64(ORDER), ORDER).limit((1 << BOUND_BITS) - 1)
    bounds = drawn.agg(F.sort_array(F.collect_list(ORDER)).alias("__b"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(BOUND_BITS))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__b", at + step - 1) <= F.col(ORDER), at + step).otherwise(at))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn("__p", below).drop("__b")
    ranked = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(ORDER)))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    # One row per range: a single-task window over them is bounded by the number of bounds.
    starts = sizes.select("__p", (F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__c")).alias("__s"))
    return ranked.join(starts, "__p").withColumn("__i", (F.col("__s") + F.col("__r") - 1).cast("long")).drop("__p", "__r", "__s")


__all__ = ["Columns", "Frame", "FrameSchema", "Row", "Rows", "Series", "dense_index", "order_type"]
