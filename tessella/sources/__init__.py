"""Readers and writers."""

from tessella.sources.csv import CsvReadOptions, CsvWriteOptions, read_csv, write_csv
from tessella.sources.excel import ExcelReadOptions, ExcelWriteOptions, read_excel, write_excel
from tessella.sources.headers import HeaderMode
from tessella.sources.json import JsonWriteOptions, read_json, write_json
from tessella.sources.parquet import read_parquet, write_parquet
from tessella.sources.sql import SqlWriteOptions, read_jdbc, read_sql, write_jdbc, write_sql

__all__ = [
    "CsvReadOptions", "CsvWriteOptions", "ExcelReadOptions", "ExcelWriteOptions", "HeaderMode", "JsonWriteOptions", "SqlWriteOptions",
    "read_csv", "read_excel", "read_jdbc", "read_json", "read_parquet", "read_sql", "write_csv", "write_excel", "write_jdbc", "write_json",
    "write_parquet", "write_sql",
]
