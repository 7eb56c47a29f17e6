"""Files and databases: round trips, inference, strictness, atomic writes."""

import datetime as dt
import os
import sqlite3
from decimal import Decimal

import pytest

from tessella import (
    CsvReadOptions, CsvWriteOptions, ExcelReadOptions, Frame, HeaderMode, JsonWriteOptions, read_csv, read_excel, read_json, read_sql, write_csv, write_excel, write_json, write_sql,
)
from tessella.errors import ArgumentError, FormatError, UnsupportedError


def kinds(f):
    return [x.dataType.simpleString() for x in f.schema.fields]


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_csv_types(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'T,B,I,L,D,F,M,N,E\nx,true,1,3000000000,1.50,1e40,1,,\n"a,""b",False, 2 ,4,"1,234.5",2,z,7,\n')
    f = read_csv(spark, p)
    assert [k.split("(")[0] for k in kinds(f)] == ["string", "boolean", "int", "bigint", "decimal", "double", "string", "int", "string"]
    assert f.to_dict()["T"] == ["x", 'a,"b'] and f.to_dict()["D"] == [Decimal("1.50"), Decimal("1234.50")] and f.to_dict()["N"] == [None, 7]


def test_csv_grammar(spark, tmp_path):
    f = read_csv(spark, put(tmp_path / "q.csv", '﻿A,B\r\n"x\r\ny",""\r\n,2\r\n'))
    assert f.to_dict() == {"A": ["x\r\ny", None], "B": ["", "2"]}
    for i, bad in enumerate(['A\n"x"y\n', 'A\nx"y\n', 'A\n"x\n', "A,B\n1\n", "A,a\n1,2\n", "A, \n1,2\n", "", "  \n"]):
        with pytest.raises(Exception, match="quote|fields|header|empty|white|closed"):
            read_csv(spark, put(tmp_path / f"bad{i}.csv", bad)).rows()
    p = put(tmp_path / "h.csv", "1;x\n2;y\n")
    assert read_csv(spark, p, CsvReadOptions(HeaderMode.ABSENT, delimiter=";")).to_dict() == {"Column1": [1, 2], "Column2": ["x", "y"]}
    assert read_csv(spark, p, CsvReadOptions(names=["a", "b"], delimiter=";")).count() == 2
    assert read_csv(spark, p, CsvReadOptions(HeaderMode.PRESENT, ["a", "b"], ";")).to_dict() == {"a": [2], "b": ["y"]}
    assert kinds(read_csv(spark, put(tmp_path / "o.csv", "Name,Age\n"))) == ["string", "string"]


def test_csv_write(spark, tmp_path):
    f = Frame.create(spark, {"S": ["a,b", "", None, 'q"'], "N": [1, 2, None, 4], "D": [Decimal("1.50")] * 4, "B": [True, False, None, True]})
    p = str(tmp_path / "w.csv")
    write_csv(f, p)
    assert open(p, newline="").read() == 'S,N,D,B\n"a,b",1,1.50,true\n"",2,1.50,false\n,,1.50,\n"q""",4,1.50,true\n'.replace("\n", os.linesep)
    assert read_csv(spark, p).to_dict() == f.to_dict()
    with pytest.raises(UnsupportedError):
        write_csv(Frame.create(spark, {"A": [float("nan")]}), p, CsvWriteOptions())
    assert read_csv(spark, p).count() == 4 and os.listdir(tmp_path) == ["w.csv"]


def test_json(spark, tmp_path):
    f = read_json(spark, put(tmp_path / "a.json", '[{"n":"x","i":1,"l":1,"d":1.5,"f":1e40,"b":true},{"i":2,"l":3000000000,"d":2,"late":null,"f":1}]'))
    assert f.columns_list == ["n", "i", "l", "d", "f", "b", "late"] and [k.split("(")[0] for k in kinds(f)] == ["string", "int", "bigint", "decimal", "double", "boolean", "string"]
    for i, bad in enumerate(["[]", "{}", '[{"a":{}}]', '[{"a":1,"A":2}]', '[{"a":1},{"a":"x"}]', "[1]", "nope"]):
        with pytest.raises((FormatError, ArgumentError)):
            read_json(spark, put(tmp_path / f"b{i}.json", bad))
    g = Frame.create(spark, {"t": [dt.datetime(2024, 1, 2)], "d": [Decimal("1.10")], "s": ['é"']})
    p = str(tmp_path / "w.json")
    write_json(g, p, JsonWriteOptions(False))
    assert open(p).read() == '[{"t":"2024-01-02T00:00:00.0000000","d":1.10,"s":"é\\""}]'


def test_excel(spark, tmp_path):
    f = Frame.create(spark, {"T": ["=SUM(1)", "00123", None], "B": [True, False, None], "I": [1, None, 3], "L": [3_000_000_000, 1, 2], "D": [Decimal("1.5"), Decimal("2.25"), None], "F": [1e40, 0.5, 2.0], "W": [dt.datetime(2024, 2, 29, 12, 30, 15), dt.datetime(1900, 1, 1), None]})
    p = str(tmp_path / "a.xlsx")
    write_excel(f, p)
    g = read_excel(spark, p)
    assert {k: v for k, v in g.to_dict().items() if k != "D"} == {k: v for k, v in f.to_dict().items() if k != "D"} and [str(float(x)) for x in g.to_dict()["D"][:2]] == ["1.5", "2.25"]
    assert read_excel(spark, p, ExcelReadOptions("sheet1", HeaderMode.ABSENT)).columns_list[0] == "Column1"
    with pytest.raises(ArgumentError):
        read_excel(spark, p, ExcelReadOptions("nope"))
    with pytest.raises(UnsupportedError):
        read_excel(spark, str(tmp_path / "a.xls"))
    with pytest.raises(UnsupportedError):
        write_excel(Frame.create(spark, {"A": [10**15]}), p)


def test_sql(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE E (Id INTEGER PRIMARY KEY, Name TEXT NOT NULL, Dept TEXT DEFAULT 'x', Pay BLOB)")
    f = Frame.create(spark, {"Id": [1, 2], "Name": ["a", "b"], "Pay": [b"\x01", None]})
    write_sql(f, db, "E")
    assert read_sql(spark, db, "SELECT * FROM E ORDER BY Id").to_dict() == {"Id": [1, 2], "Name": ["a", "b"], "Dept": ["x", "x"], "Pay": [b"\x01", None]}
    with pytest.raises(sqlite3.IntegrityError):
        write_sql(Frame.create(spark, {"Id": [3, 1], "Name": ["c", "d"]}), db, "E")
    assert read_sql(spark, db, "SELECT * FROM E").count() == 2
    write_sql(f.head(0), db, "E")
    for bad in ("E; DROP", "a.b.c", "1x"):
        with pytest.raises(ArgumentError):
            write_sql(f, db, bad)
    with pytest.raises((FormatError, ArgumentError)):
        read_sql(spark, db, "SELECT 1 AS a, 2 AS A")
