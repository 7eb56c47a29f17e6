"""A strictly validated, ordered frame API over Spark DataFrames."""

from tessella.functions import cell
from tessella.operators.frame import Frame, Row, Series
from tessella.sources import (
    CsvReadOptions, CsvWriteOptions, ExcelReadOptions, ExcelWriteOptions, HeaderMode, JsonWriteOptions, SqlWriteOptions,
    read_csv, read_excel, read_jdbc, read_json, read_parquet, read_sql, write_csv, write_excel, write_jdbc, write_json, write_parquet, write_sql,
)

__all__ = [
    "CsvReadOptions", "CsvWriteOptions", "ExcelReadOptions", "ExcelWriteOptions", "Frame", "HeaderMode", "JsonWriteOptions", "Row",
    "Series", "SqlWriteOptions", "cell", "read_csv", "read_excel", "read_jdbc", "read_json", "read_parquet", "read_sql", "write_csv",
    "write_excel", "write_jdbc", "write_json", "write_parquet", "write_sql",
]
