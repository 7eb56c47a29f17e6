"""JSON files: one array of flat objects."""

from __future__ import annotations

import datetime as dt
import decimal
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tessella import types
from tessella.errors import FormatError, TypeMismatchError, UnsupportedError
from tessella.names import ORDER
from tessella.operators.frame import Frame
from tessella.operators.reshape import column_label
from tessella.sources.files import check_path, replacing
from tessella.sources.headers import check_header

BIG = decimal.Decimal(2) ** 96


@dataclass(frozen=True)
class JsonWriteOptions:
    indented: bool = True


class _Number(str):
    """A number as it stands in the file."""


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    seen: dict[str, Any] = {}
    for k, v in pairs:
        if k.lower() in (s.lower() for s in seen):
            raise FormatError(f"property {k!r} is used twice in one object")
        seen[k] = v
    return seen


def _number_type(text: str) -> T.DataType:
    """int, long, decimal or double: the first that holds the number."""
    value = decimal.Decimal(text)
    if not any(c in text for c in ".eE") and types.LONG_MIN <= value <= types.LONG_MAX:
        return T.IntegerType() if types.INT_MIN <= value <= types.INT_MAX else T.LongType()
    digits = value.as_tuple()
    if abs(value) < BIG and -digits.exponent <= 28 and len(digits.digits) <= 29:
        return T.DecimalType(38, max(0, -digits.exponent))
    if abs(value) <= decimal.Decimal("1.7976931348623157e308"):
        return T.DoubleType()
    raise FormatError(f"the number {text} is too large")


def _column_type(name: str, values: list[Any]) -> T.DataType:
    kinds = {("number" if isinstance(v, _Number) else type(v).__name__) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if len(kinds) > 1:
        raise TypeMismatchError(f"property {name!r} holds several kinds: {sorted(kinds)}")
    kind = kinds.pop()
    if kind == "number":
        return types.unpivot_type([_number_type(v) for v in values if v is not None])
    return T.BooleanType() if kind == "bool" else T.StringType()


def read_json(spark: SparkSession, path: str) -> Frame:
    """Read an array of flat objects; columns are in the order in which properties first appear.

    One JSON array is one value, so the driver parses it; use :func:`read_parquet` for large data.
    """
    path = check_path(path)
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise FormatError("the file is empty")
    try:
        root = json.loads(text[0].removeprefix("﻿"), parse_int=_Number, parse_float=_Number, parse_constant=_constant, object_pairs_hook=_object)
    except json.JSONDecodeError as e:
        raise FormatError(f"not JSON: {e}") from e
    if not isinstance(root, list) or not root:
        raise FormatError("the root must be an array with at least one object")
    names: dict[str, str] = {}
    for item in root:
        if not isinstance(item, dict):
            raise FormatError("every item of the array must be an object")
        for k, v in item.items():
            if isinstance(v, (dict, list)):
                raise FormatError(f"property {k!r} is nested")
            names.setdefault(k.lower(), k)
    if not names:
        raise FormatError("the objects have no properties")
    check_header(list(names.values()))
    rows = [{k.lower(): v for k, v in item.items()} for item in root]
    fields, columns = [], []
    for low, name in names.items():
        values = [r.get(low) for r in rows]
        t = _column_type(name, values)
        fields.append(T.StructField(name, t, None in values or isinstance(t, T.StringType)))
        columns.append([_convert(v, t) for v in values])
    data = [(*v, i) for i, v in enumerate(zip(*columns, strict=True))]
    return Frame(spark.createDataFrame(data, T.StructType([*fields, T.StructField(ORDER, T.LongType(), False)])))


def _constant(text: str) -> Any:
    raise FormatError(f"{text} is not JSON")


def _convert(v: Any, t: T.DataType) -> Any:
    if not isinstance(v, _Number):
        return v
    if isinstance(t, types.INTS):
        return int(v)
    return float(v) if isinstance(t, T.DoubleType) else decimal.Decimal(v)


def _value(v: Any, t: T.DataType) -> str:
    if v is None or isinstance(v, (bool, int, str)):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            raise UnsupportedError("NaN and infinity can't be written")
        return repr(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, (dt.datetime, dt.timedelta)):
        return json.dumps(column_label(v))
    if isinstance(v, dt.date):
        return json.dumps(v.isoformat())
    raise UnsupportedError(f"{t.simpleString()} values can't be written as JSON")


def write_json(frame: Frame, path: str, options: JsonWriteOptions | None = None) -> None:
    """Write one array of objects in frame order, streaming one partition at a time through the driver."""
    options = options or JsonWriteOptions()
    path = check_path(path)
    for f in frame.schema.fields:
        if isinstance(f.dataType, (*types.COMPLEX, T.BinaryType)):
            raise UnsupportedError(f"column {f.name!r} ({f.dataType.simpleString()}) can't be written as JSON")
    kinds = frame.schema.fields
    open_, sep, close = ("\n  {\n    ", ",\n    ", "\n  }") if options.indented else ("{", ",", "}")
    colon = ": " if options.indented else ":"
    with replacing(path) as out:
        out.write("[")
        some = False
        for row in frame.iter_rows():
            out.write("," if some else "")
            some = True
            out.write(open_ + sep.join(json.dumps(f.name, ensure_ascii=False) + colon + _value(v, f.dataType) for f, v in zip(kinds, row, strict=True)) + close)
        out.write("\n]" if options.indented and some else "]")
