"""CSV with strict quoting, whole-column type inference and single-file output.

Parsing is a distributed job when the file has no quoted line break: Spark's line reader splits the file and
each line is parsed by the same grammar. A file with quotes that span lines is parsed as one stream.
"""

from __future__ import annotations

import os
import decimal
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import ArgumentError, FormatError, UnsupportedError
from tessella.names import ORDER, quoted
from tessella.operators.frame import Frame
from tessella.sources.files import check_path, replacing
from tessella.sources.headers import HeaderMode, column_names, has_header


@dataclass(frozen=True)
class CsvReadOptions:
    header: HeaderMode = HeaderMode.INFER
    names: Sequence[str] | None = None
    delimiter: str = ","


@dataclass(frozen=True)
class CsvWriteOptions:
    header: bool = True
    delimiter: str = ","


def _check_delimiter(d: str) -> str:
    if not isinstance(d, str) or len(d) != 1 or d in '\0"\r\n':
        raise ArgumentError("the delimiter is one character, not NUL, a quote or a line break")
    return d


def parse(text: str, delimiter: str = ",") -> Iterator[tuple[int, list[str | None]]]:
    """Records as (line number, fields); an unquoted empty field is None, a quoted one is ''."""
    at, line, end = 0, 1, len(text)
    while at < end:
        first, fields = line, []
        while True:
            if at < end and text[at] == '"':
                field, at, line = _quoted_field(text, at, line)
                if at < end and text[at] not in (delimiter, "\r", "\n"):
                    raise FormatError(f"line {line}: text after a closing quote")
            else:
                stop = at
                while stop < end and text[stop] not in (delimiter, "\r", "\n"):
                    if text[stop] == '"':
                        raise FormatError(f"line {line}: a quote inside an unquoted field")
                    stop += 1
                field, at = text[at:stop] or None, stop
            fields.append(field)
            if at < end and text[at] == delimiter:
                at += 1
                continue
            break
        if at < end:
            at += 2 if text.startswith("\r\n", at) else 1
            line += 1
        yield first, fields


def _quoted_field(text: str, at: int, line: int) -> tuple[str, int, int]:
    parts, begin = [], line
    at += 1
    while True:
        close = text.find('"', at)
        if close < 0:
            raise FormatError(f"line {begin}: a quoted field is not closed")
        parts.append(text[at:close])
        if text.startswith('""', close):
            parts.append('"')
            at = close + 2
            continue
        field = "".join(parts)
        return field, close + 1, line + field.replace("\r\n", "\n").replace("\r", "\n").count("\n")


#: Values that inference accepts. Fixed patterns.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "")


def infer(df, names: Sequence[str]) -> list[tuple[T.DataType, Column]]:  # noqa: ANN001
    """Type and conversion of each text column, from one aggregate over all rows."""
    tests: list[Column] = []
    for i, n in enumerate(names):
        c = F.col(quoted(n))
        whole = F.when(c.rlike(INTEGER), F.expr(f"try_cast(trim({quoted(n)}) AS decimal(38,0))"))
        exact = F.when(c.rlike(DECIMAL), F.expr(f"try_cast(regexp_replace(trim({quoted(n)}), ',', '') AS double)"))
        body = F.regexp_extract(_number(c), r"^[+-]?[0-9]*\.?([0-9]*)", 1)
        digits = F.length(F.regexp_replace(F.regexp_extract(_number(c), r"^[+-]?0*([0-9.]*)", 1), r"\.", ""))
        ok = lambda test: F.bool_and(F.when(c.isNotNull(), F.coalesce(test, F.lit(False))))  # noqa: E731, B023
        tests += [
            F.count(c).alias(f"n{i}"),
            ok(F.lower(F.trim(c)).isin("true", "false")).alias(f"b{i}"),
            ok((whole >= -(2**31)) & (whole < 2**31)).alias(f"i{i}"),
            ok((whole >= F.lit(-(2**63)).cast("decimal(38,0)")) & (whole <= F.lit(2**63 - 1).cast("decimal(38,0)"))).alias(f"l{i}"),
            ok(exact.isNotNull() & (F.abs(exact) < 7.9e28) & (digits <= 29) & ~c.rlike("[eE]")).alias(f"d{i}"),
            ok(exact.isNotNull() & (F.abs(exact) < float("inf"))).alias(f"f{i}"),
            F.max(F.length(body)).alias(f"s{i}"),
        ]
    row = df.agg(*tests).first()
    found: list[tuple[T.DataType, Column]] = []
    for i, n in enumerate(names):
        c = F.col(quoted(n))
        if not row[f"n{i}"]:
            found.append((T.StringType(), c))
        elif row[f"b{i}"]:
            found.append((T.BooleanType(), F.lower(F.trim(c)) == "true"))
        elif row[f"i{i}"]:
            found.append((T.IntegerType(), F.trim(c).cast("int")))
        elif row[f"l{i}"]:
            found.append((T.LongType(), F.trim(c).cast("bigint")))
        elif row[f"d{i}"]:
            t = T.DecimalType(38, min(28, row[f"s{i}"] or 0))
            found.append((t, _number(c).cast(t)))
        elif row[f"f{i}"]:
            found.append((T.DoubleType(), _number(c).cast("double")))
        else:
            found.append((T.StringType(), c))
    return found


def _typed(df, names: Sequence[str]) -> Frame:  # noqa: ANN001
    out = [c.cast(t).alias(n) for n, (t, c) in zip(names, infer(df, names), strict=True)]
    return Frame(df.select(*out, ORDER))


def read_csv(spark: SparkSession, path: str, options: CsvReadOptions | None = None) -> Frame:
    """Read one CSV file; see :class:`HeaderMode` for the header and :func:`infer` for types."""
    options = options or CsvReadOptions()
    delimiter = _check_delimiter(options.delimiter)
    path = check_path(path)
    lines = spark.read.text(path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if not size:
        if options.header is HeaderMode.ABSENT and options.names is not None:
            names = column_names(options.header, options.names, len(options.names), list)
            return Frame(spark.createDataFrame([], T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(ORDER, T.LongType())])))
        raise FormatError("the file is empty")
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    flags = lines.agg(F.max(odd).alias("spans"), F.max(F.length(F.trim("value")) > 0).alias("any")).first()
    if not flags["any"]:
        raise FormatError("the file holds only white space")
    if flags["spans"] or _lone_cr(spark, path):
        return _read_stream(spark, path, options, delimiter)
    first = lines.select("value").limit(1).collect()[0]["value"].removeprefix("﻿")
    head = next(parse(first, delimiter))[1] if first else [None]
    names = column_names(options.header, options.names, len(head), lambda: head)
    width, header = len(names), has_header(options.header, options.names)
    numbered = lines.withColumn(ORDER, F.monotonically_increasing_id())
    if header:
        numbered = numbered.filter(F.col(ORDER) > 0)

    def fields(batches: Iterable[Any]) -> Iterator[Any]:
        import pandas as pd

        for b in batches:
            rows = []
            for text in b["value"]:
                text = text.removeprefix("﻿")
                row = next(parse(text, delimiter))[1] if text else [None]
                if len(row) != width:
                    raise FormatError(f"a record has {len(row)} fields instead of {width}: {text[:80]!r}")
                rows.append(row)
            out = pd.DataFrame(rows, columns=[f"f{i}" for i in range(width)], dtype=object)
            out[ORDER] = b[ORDER].to_numpy()
            yield out

    schema = T.StructType([*[T.StructField(f"f{i}", T.StringType()) for i in range(width)], T.StructField(ORDER, T.LongType())])
    parsed = numbered.mapInPandas(fields, schema)
    return _typed(parsed.select(*[F.col(f"f{i}").alias(n) for i, n in enumerate(names)], ORDER), names)


def _lone_cr(spark: SparkSession, path: str) -> bool:
    """Whether carriage returns are line ends of their own, which the line reader keeps in one line only with CRLF."""
    return bool(spark.read.option("lineSep", "\n").text(path).filter(F.regexp_replace("value", "\r$", "").contains("\r")).take(1))


def _read_stream(spark: SparkSession, path: str, options: CsvReadOptions, delimiter: str) -> Frame:
    """A file whose quotes span lines has one grammar state from start to end: it is parsed by one task."""
    text = spark.read.text(path, wholetext=True)
    sample = text.first()["value"].removeprefix("﻿")
    head = next(parse(sample, delimiter))[1]
    names = column_names(options.header, options.names, len(head), lambda: head)
    width, header = len(names), has_header(options.header, options.names)

    def fields(batches: Iterable[Any]) -> Iterator[Any]:
        import pandas as pd

        for b in batches:
            for value in b["value"]:
                chunk: list[list[Any]] = []
                for i, (line, row) in enumerate(parse(value.removeprefix("﻿"), delimiter)):
                    if len(row) != width:
                        raise FormatError(f"line {line}: {len(row)} fields instead of {width}")
                    if i or not header:
                        chunk.append([*row, i])
                    if len(chunk) >= 10_000:
                        yield pd.DataFrame(chunk, columns=[*[f"f{k}" for k in range(width)], ORDER])
                        chunk = []
                yield pd.DataFrame(chunk, columns=[*[f"f{k}" for k in range(width)], ORDER])

    schema = T.StructType([*[T.StructField(f"f{i}", T.StringType()) for i in range(width)], T.StructField(ORDER, T.LongType())])
    parsed = text.mapInPandas(fields, schema)
    return _typed(parsed.select(*[F.col(f"f{i}").alias(n) for i, n in enumerate(names)], ORDER), names)


def _text(value: Any, t: T.DataType, delimiter: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise UnsupportedError("NaN and infinity can't be written")
        return repr(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        if value == "" or any(c in value for c in (delimiter, '"', "\r", "\n")):
            return '"' + value.replace('"', '""') + '"'
        return value
    raise UnsupportedError(f"{t.simpleString()} values can't be written as CSV")


def write_csv(frame: Frame, path: str, options: CsvWriteOptions | None = None) -> None:
    """Write one UTF-8 file in frame order, streaming one partition at a time through the driver."""
    options = options or CsvWriteOptions()
    d = _check_delimiter(options.delimiter)
    path = check_path(path)
    for f in frame.schema.fields:
        if not isinstance(f.dataType, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
            raise UnsupportedError(f"column {f.name!r} ({f.dataType.simpleString()}) can't be written as CSV")
    kinds = [f.dataType for f in frame.schema.fields]
    with replacing(path) as out:
        if options.header:
            out.write(d.join(_text(n, T.StringType(), d) for n in frame.columns_list) + os.linesep)
        for row in frame.iter_rows():
            out.write(d.join(_text(v, t, d) for v, t in zip(row, kinds, strict=True)) + os.linesep)
