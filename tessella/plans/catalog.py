"""Queries over the test tables, one or more for each operator, each with equivalent SQL."""

from __future__ import annotations

import decimal
import os
import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import cell
from tessella.operators.frame import Frame, FrameSchema, Series
from tessella.sources import (
    ExcelWriteOptions, read_csv, read_excel, read_json, read_parquet, read_sql, write_csv, write_excel, write_json, write_sql,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    """A test table; the TPC-H-like tables hold no nulls."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", not_null=True)


def money(frame: Frame, *names: str) -> Frame:
    """Columns as exact decimals, so that sums do not depend on the order of addition."""
    df = frame._df
    for n in names:
        df = df.withColumn(n, F.col(n).cast("decimal(18,2)"))
    return Frame(df, frame._declared)


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _frame(name: str, sql: str | None, source: str, run: Callable[[Frame], Frame]) -> None:
    query(name, sql)(lambda spark, sf_dir: run(table(spark, sf_dir, source)).df)


# -- projection

_frame("select_cols", "SELECT c_name, c_custkey FROM customer", "customer", lambda f: f.select("C_NAME", "c_custkey"))
_frame("drop_cols", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer", "customer", lambda f: f.drop("c_name", "C_AcctBal"))
_frame("remove_col", "SELECT * EXCLUDE (c_name) FROM customer", "customer", lambda f: f.columns.remove("c_name"))
_frame("rename_col", "SELECT c_custkey AS key, * EXCLUDE (c_custkey) FROM customer", "customer", lambda f: f.rename("c_custkey", "key"))
_frame("add_values", "SELECT *, r_regionkey * 10 AS code FROM region", "region", lambda f: f.add_column("code", [0, 10, 20, 30, 40]))


# -- filters

_frame("filter_cmp_int", "SELECT p_partkey, p_size FROM part WHERE p_size >= 30", "part", lambda f: f.filter(cell("p_size") >= 30).select("p_partkey", "p_size"))
_frame("filter_cmp_long", "SELECT o_orderkey FROM orders WHERE o_custkey < 500", "orders", lambda f: f.filter(cell("o_custkey") < 500).select("o_orderkey"))
_frame("filter_cmp_double", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45.0", "lineitem", lambda f: f.filter(cell("l_quantity") > 45.0).select("l_orderkey", "l_quantity"))
_frame("filter_cmp_decimal", "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) <= 50000", "orders", lambda f: money(f, "o_totalprice").filter(cell("o_totalprice") <= decimal.Decimal("50000")).select("o_orderkey"))
_frame("filter_eq_int", "SELECT p_partkey FROM part WHERE p_size = 7 OR p_size <> 7 AND p_size > 48", "part", lambda f: f.filter((cell("p_size") == 7) | ((cell("p_size") != 7) & (cell("p_size") > 48))).select("p_partkey"))
_frame("filter_str_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'P'", "orders", lambda f: f.filter(cell("o_orderstatus") == "P").select("o_orderkey"))
_frame("filter_str_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'", "orders", lambda f: f.filter(cell("o_orderstatus") != "P").select("o_orderkey"))
_frame("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'old')", "part", lambda f: f.filter(cell("p_name").contains("old")).select("p_partkey", "p_name"))
_frame("filter_startswith", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')", "part", lambda f: f.filter(cell("p_type").starts_with("S")).select("p_partkey", "p_type"))
_frame("filter_endswith", "SELECT p_partkey, p_brand FROM part WHERE ends_with(p_brand, '3')", "part", lambda f: f.filter(cell("p_brand").ends_with("3")).select("p_partkey", "p_brand"))
_frame("filter_compound", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_size < 5) AND NOT p_brand = 'Brand#11'", "part", lambda f: f.filter(((cell("p_size") > 40) | (cell("p_size") < 5)) & ~(cell("p_brand") == "Brand#11")).select("p_partkey"))
_frame("filter_mixed", "SELECT event_id FROM events WHERE value >= 50.0 AND event_type <> 'view'", "events", lambda f: f.filter((cell("value") >= 50.0) & (cell("event_type") != "view")).select("event_id"))


@query("filter_timestamp", "SELECT event_id FROM events WHERE ts = (SELECT max(ts) FROM events) OR ts = (SELECT min(ts) FROM events)")
def _filter_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select("event_id", "ts")
    return f.filter((cell("ts") == f.max("ts")) | (cell("ts") == f.min("ts"))).select("event_id").df


# Every comparison of every number type, and equality of each.
_NUMBERS = {"int": ("part", "p_partkey", "p_size", 25, "25"), "long": ("orders", "o_orderkey", "o_custkey", 70, "70"), "decimal": ("lineitem", "l_orderkey", "l_quantity", decimal.Decimal("25.00"), "25.00"), "double": ("lineitem", "l_orderkey", "l_quantity", 25.0, "25.0")}
_OPERATORS = {"lt": ("<", lambda c, v: c < v), "le": ("<=", lambda c, v: c <= v), "gt": (">", lambda c, v: c > v), "ge": (">=", lambda c, v: c >= v), "eq": ("=", lambda c, v: c == v), "ne": ("<>", lambda c, v: c != v)}
for _kind, (_source, _key, _name, _value, _text) in _NUMBERS.items():
    for _op, (_sign, _compare) in _OPERATORS.items():
        _cast = f"CAST({_name} AS DECIMAL(18,2))" if _kind == "decimal" else _name
        _frame(
            f"compare_{_kind}_{_op}", f"SELECT {_key}, {_cast} AS {_name} FROM {_source} WHERE {_cast} {_sign} {_text}", _source,
            lambda f, kind=_kind, key=_key, name=_name, value=_value, compare=_compare: (money(f, name) if kind == "decimal" else f).filter(compare(cell(name), value)).select(key, name),
        )


@query("filter_bool_ne", "SELECT doc_id FROM labels WHERE NOT toxic = 1")
def _filter_bool_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "labels")
    return Frame(f._df.withColumn("toxic", F.col("toxic") == 1), f._declared).filter(cell("toxic") != True).select("doc_id").df  # noqa: E712


@query("filter_bool", "SELECT doc_id FROM labels WHERE toxic = 1")
def _filter_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "labels")
    return Frame(f._df.withColumn("toxic", F.col("toxic") == 1), f._declared).filter(cell("toxic") == True).select("doc_id").df  # noqa: E712


@query("filter_null", "SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE event_type = 'error' OR event_id < 10")
def _filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events")
    g = Frame(f._df.withColumn("kind", F.nullif(F.col("event_type"), F.lit("error"))), f._declared)
    return g.filter((cell("kind") == None) | (cell("event_id") < 10)).select("event_id", "kind").df  # noqa: E711


# -- construction and metadata: what they tell, as rows


def _told(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(str(k), str(v)) for k, v in rows], "item string, told string")


def _values(rows: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows) + ") AS t(item, told)"


@query("create_with_schema", "SELECT CAST(k AS BIGINT) AS id, n AS name, CAST(x AS DOUBLE) AS x FROM (VALUES (1, 'a', 1.5), (2, NULL, 2.5), (3, 'c', NULL)) AS t(k, n, x)")
def _create_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    return Frame.create(spark, {"X": [1.5, 2.5, None], "name": ["a", None, "c"], "ID": [1, 2, 3]}, schema).df


@query("series_values", _values([("name", "k"), ("count", "3"), ("first", "5"), ("values", "(5, None, 7)"), ("type", "int"), ("nullable", "True")]))
def _series_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Series.create("k", [5, None, 7])
    return _told(spark, [("name", s.name), ("count", len(s)), ("first", s[0]), ("values", s.values), ("type", s.data_type.simpleString()), ("nullable", s.nullable)])


@query("frame_series", "SELECT CAST(n_nationkey AS VARCHAR) AS item, n_name AS told FROM nation")
def _frame_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "nation").sort_by("n_nationkey")
    return _told(spark, list(zip(f["N_NationKey"].values, f["n_name"].values, strict=True)))


@query("schema_facts", _values([("r_regionkey", "int"), ("r_name", "string"), ("columns", "2"), ("second", "r_name"), ("has R_NAME", "True"), ("has other", "False"), ("has int key", "True"), ("has long key", "False"), ("contains", "True"), ("field", "r_regionkey"), ("ordinal", "1")]))
def _schema_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    facts = [(c.name, c.data_type.simpleString()) for c in f.columns]
    facts += [("columns", len(f.columns)), ("second", f.columns[1].name), ("has R_NAME", f.has_column("R_NAME")), ("has other", f.has_column("other")), ("has int key", f.has_column("r_regionkey", T.IntegerType())), ("has long key", f.has_column("r_regionkey", T.LongType()))]
    s = FrameSchema.of(f)
    return _told(spark, [*facts, ("contains", s.contains_column("R_Name")), ("field", s.column("R_REGIONKEY").name), ("ordinal", s.ordinal("r_name"))])


@query("require_column", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def _require_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem")
    name = f.require_column("L_LineNumber", T.IntegerType()).name
    return f.df.agg(F.lit(f.rows_view.count()).cast("long").alias("n"), F.sum(name).alias("total"))


@query("row_facts", "SELECT 'names' AS item, 'n_nationkey,n_name,n_regionkey' AS told UNION ALL SELECT 'name', n_name FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 4")
def _row_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = table(spark, sf_dir, "nation").sort_by("n_nationkey").rows_view[4]
    return _told(spark, [("names", ",".join(row.column_names)), ("name", row["N_NAME"]), ("region", row["n_regionkey"])])


_frame("copy_frame", "SELECT * FROM supplier", "supplier", lambda f: f.copy())


# -- sorting, limits, distinct

_frame("sort_asc_topk", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10", "customer", lambda f: f.sort_by("c_custkey").head(10))
_frame("sort_desc_topk", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10", "orders", lambda f: f.sort_by_descending("o_orderkey").head(10))
_frame("sort_text_desc", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name DESC LIMIT 5", "nation", lambda f: f.sort_by_descending("n_name").head(5).select("n_name", "n_nationkey"))
_frame("head_n", "SELECT * FROM region ORDER BY r_regionkey LIMIT 3", "region", lambda f: f.head(3))
_frame("take_n", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 7", "nation", lambda f: f.take(7))
_frame("distinct_all", "SELECT DISTINCT event_type, user_id FROM events", "events", lambda f: f.select("event_type", "user_id").distinct())
_frame("distinct_key_first", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1", "events", lambda f: f.sort_by("event_id").distinct("user_id").select("event_id", "user_id", "event_type"))


@query("get_row", "SELECT n_name, n_nationkey FROM nation WHERE n_nationkey = 3")
def _get_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "nation").sort_by("n_nationkey")
    row = f.row(3)
    return Frame.create(spark, {"n_name": [row.string("n_name")], "n_nationkey": [row.int("n_nationkey")]}).df


# -- joins


def _labels(spark: SparkSession, sf_dir: str) -> tuple[Frame, Frame]:
    """Documents and labels with misses on both sides."""
    docs = table(spark, sf_dir, "documents").filter(cell("lang") != "en").select("doc_id", "lang")
    return docs, table(spark, sf_dir, "labels")


for _kind, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query(f"join_{_kind}", f"SELECT doc_id, lang, quality, toxic FROM (SELECT doc_id, lang FROM documents WHERE lang <> 'en') d {_sql} labels USING (doc_id)")(
        lambda spark, sf_dir, kind=_kind: (lambda d, x: getattr(d, f"{kind}_join")(x).on("doc_id").df)(*_labels(spark, sf_dir))
    )


@query("join_diff_names", "SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _join_diff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.inner_join(n).on(("c_nationkey", "n_nationkey")).df


@query("join_composite", "SELECT a.conv_id, a.turn, a.role, b.n FROM conversations a JOIN (SELECT conv_id, turn, length(text) AS n FROM conversations) b USING (conv_id, turn)")
def _join_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations")
    b = Frame(a._df.select("conv_id", "turn", F.length("text").cast("bigint").alias("n"), "__ord"), a._declared)
    return a.select("conv_id", "turn", "role").inner_join(b).on("conv_id", "turn").df


@query("join_mixed_keys", "SELECT a.conv_id, a.turn, a.role, b.next_turn, b.next_role FROM conversations a LEFT JOIN (SELECT conv_id, turn - 1 AS next_turn, role AS next_role FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.next_turn")
def _join_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations")
    b = Frame(a._df.select("conv_id", (F.col("turn") - 1).alias("next_turn"), F.col("role").alias("next_role"), "__ord"), a._declared)
    return a.select("conv_id", "turn", "role").left_join(b).on("conv_id", ("turn", "next_turn")).df


@query("join_null_keys", "WITH a AS (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation), b AS (SELECT nullif(r_regionkey, 1) AS k, r_name FROM region) SELECT k, n_nationkey, r_name FROM a FULL JOIN b USING (k)")
def _join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation")._df, table(spark, sf_dir, "region")._df
    a = Frame(n.select("n_nationkey", F.nullif(F.col("n_regionkey"), F.lit(1)).alias("k"), "__ord"))
    b = Frame(r.select(F.nullif(F.col("r_regionkey"), F.lit(1)).alias("k"), "r_name", "__ord"))
    return a.full_join(b).on("k").df


@query("join_type_mismatch", "SELECT c_custkey, c_nationkey, CAST(NULL AS BIGINT) AS s_suppkey FROM customer")
def _join_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.left_join(table(spark, sf_dir, "supplier").select("s_suppkey")).on(("c_nationkey", "s_suppkey")).df


# -- aggregates

for _kind, _expr in (
    ("sum", "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2))"), ("average", "round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6)"),
    ("min", "min(CAST(l_extendedprice AS DECIMAL(18,2)))"), ("max", "max(CAST(l_extendedprice AS DECIMAL(18,2)))"),
):

    def _agg(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        value = getattr(money(table(spark, sf_dir, "lineitem"), "l_extendedprice"), kind)("l_extendedprice")
        t = {"sum": "decimal(38,2)", "average": "double"}.get(kind, "decimal(18,2)")
        return spark.range(1).select(F.lit(round(value, 6) if kind == "average" else value).cast(t).alias("v"))

    query(f"agg_{_kind}", f"SELECT {_expr} AS v FROM lineitem")(_agg)


@query("agg_sum_int", "SELECT CAST(sum(p_size) AS INTEGER) AS v FROM part")
def _agg_sum_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(table(spark, sf_dir, "part").sum("p_size")).cast("int").alias("v"))


def _rounded(f: Frame, *names: str) -> DataFrame:
    df = f.df
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


_P = "CAST(l_extendedprice AS DECIMAL(18,2))"
_Q = "CAST(l_quantity AS DECIMAL(18,2))"


@query("grp_sum", f"SELECT l_returnflag, CAST(sum({_P}) AS DECIMAL(38,2)) AS \"l_extendedprice_Sum\" FROM lineitem GROUP BY 1")
def _grp_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money(table(spark, sf_dir, "lineitem"), "l_extendedprice").group_by("l_returnflag").sum("l_extendedprice").df


@query("grp_avg", f"SELECT l_returnflag, round(CAST(sum({_P}) AS DOUBLE) / count(*), 6) AS \"l_extendedprice_Average\" FROM lineitem GROUP BY 1")
def _grp_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(money(table(spark, sf_dir, "lineitem"), "l_extendedprice").group_by("l_returnflag").average("l_extendedprice"), "l_extendedprice_Average")


_frame("grp_min", 'SELECT o_orderpriority, min(o_totalprice) AS "o_totalprice_Min" FROM orders GROUP BY 1', "orders", lambda f: f.group_by("o_orderpriority").min("o_totalprice"))
_frame("grp_max", 'SELECT o_orderpriority, max(o_orderstatus) AS "o_orderstatus_Max" FROM orders GROUP BY 1', "orders", lambda f: f.group_by("o_orderpriority").max("o_orderstatus"))
_frame("grp_sum_int", 'SELECT p_brand, CAST(sum(p_size) AS INTEGER) AS "p_size_Sum" FROM part GROUP BY 1', "part", lambda f: f.group_by("p_brand").sum("p_size"))


@query(
    "grp_multi_agg",
    f'SELECT l_returnflag, l_linestatus, CAST(sum({_Q}) AS DECIMAL(38,2)) AS "l_quantity_Sum", round(CAST(sum({_P}) AS DOUBLE) / count(*), 6) AS "l_extendedprice_Average", min({_P}) AS "l_extendedprice_Min", max(l_shipdate) AS "l_shipdate_Max" FROM lineitem WHERE l_quantity > 10.0 GROUP BY 1, 2',
)
def grouped_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, filter, one-pass grouped aggregates."""
    kept = table(spark, sf_dir, "lineitem").filter(cell("l_quantity") > 10.0)
    g = money(kept, "l_quantity", "l_extendedprice").group_by("l_returnflag", "l_linestatus")
    return _rounded(g.aggregate(lambda b: b.column("l_quantity").sum().column("l_extendedprice").average().min().column("l_shipdate").max()), "l_extendedprice_Average")


@query("grp_first_seen", "SELECT o_custkey, max(o_orderkey) AS \"o_orderkey_Max\", CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS INTEGER) AS seen FROM orders GROUP BY 1")
def _grp_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").sort_by("o_orderkey").group_by("o_custkey").max("o_orderkey").df_with_position("seen")


# -- windows

_W = "OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey)"
_O = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> Frame:
    return money(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_totalprice").rename("o_totalprice", "p")


def _windowed(name: str, sql: str, add: Callable[[Frame], Frame], rounded: tuple[str, ...] = ()) -> None:
    query(name, f"SELECT o_orderkey, {sql} FROM {_O}")(lambda spark, sf_dir: _rounded(add(_orders(spark, sf_dir)).drop("o_custkey", "o_orderstatus", "p"), *rounded))


def _w(f: Frame):  # noqa: ANN202
    return f.window().partition_by("o_custkey").order_by_descending("p").then_by("o_orderkey")


_windowed("win_row_number", f"CAST(row_number() {_W} AS INTEGER) AS v", lambda f: f.add_column("v", _w(f).row_number()))
_windowed("win_rank", "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS v", lambda f: f.add_column("v", f.window().partition_by("o_custkey").order_by("o_orderstatus").rank()))
_windowed("win_dense_rank", "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC) AS INTEGER) AS v", lambda f: f.add_column("v", f.window().partition_by("o_custkey").order_by_descending("o_orderstatus").dense_rank()))
_windowed("win_lag", f"lag(p) {_W} AS v", lambda f: f.add_column("v", _w(f).lag("p")))
_windowed("win_lead", f"lead(p) {_W} AS v", lambda f: f.add_column("v", _w(f).lead("p")))
_windowed("win_lag2", f"lag(o_orderkey, 2) {_W} AS v", lambda f: f.add_column("v", _w(f).lag("o_orderkey", 2)))
_windowed("win_first_value", f"first_value(p) {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v", lambda f: f.add_column("v", _w(f).first_value("p")))
_windowed("win_last_value", f"last_value(p) {_W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v", lambda f: f.add_column("v", _w(f).last_value("p")))
_windowed("win_part_sum", "CAST(sum(p) OVER (PARTITION BY o_custkey) AS DECIMAL(38,2)) AS v", lambda f: f.add_column("v", f.window().partition_by("o_custkey").sum("p")))
_windowed("win_part_avg", "round(CAST(sum(p) OVER (PARTITION BY o_custkey) AS DOUBLE) / count(*) OVER (PARTITION BY o_custkey), 6) AS v", lambda f: f.add_column("v", f.window().partition_by("o_custkey").average("p")), ("v",))
_windowed("win_part_min", "min(p) OVER (PARTITION BY o_custkey) AS v", lambda f: f.add_column("v", f.window().partition_by("o_custkey").min("p")))
_windowed("win_part_max", "max(p) OVER (PARTITION BY o_custkey) AS v", lambda f: f.add_column("v", f.window().partition_by("o_custkey").max("p")))
_R = f"{_W[:-1]} ROWS UNBOUNDED PRECEDING)"
_M = f"{_W[:-1]} ROWS 2 PRECEDING)"
_windowed("win_run_sum", f"CAST(sum(p) {_R} AS DECIMAL(38,2)) AS v", lambda f: f.add_column("v", _w(f).running_sum("p")))
_windowed("win_run_avg", f"round(CAST(sum(p) {_R} AS DOUBLE) / count(*) {_R}, 6) AS v", lambda f: f.add_column("v", _w(f).running_average("p")), ("v",))
_windowed("win_mov_sum", f"CAST(sum(p) {_M} AS DECIMAL(38,2)) AS v", lambda f: f.add_column("v", _w(f).moving_sum("p", 3)))
_windowed("win_mov_avg", f"round(CAST(sum(p) {_M} AS DOUBLE) / count(*) {_M}, 6) AS v", lambda f: f.add_column("v", _w(f).moving_average("p", 3)), ("v",))
_windowed("win_several", f"CAST(row_number() {_W} AS INTEGER) AS n, lag(p) {_W} AS v, CAST(sum(p) {_R} AS DECIMAL(38,2)) AS s", lambda f: f.add_column("n", _w(f).row_number()).add_column("v", _w(f).lag("p")).add_column("s", _w(f).running_sum("p")))


_WHOLE = "SELECT s_suppkey, {0} AS v FROM supplier"
_frame("win_whole_sum", _WHOLE.format("CAST(sum(s_nationkey) OVER () AS BIGINT)"), "supplier", lambda f: Frame(f.add_column("v", f.window().sum("s_nationkey")).select("s_suppkey", "v")._df.withColumn("v", F.col("v").cast("long"))))
_frame("win_whole_max", _WHOLE.format("max(s_nationkey) OVER ()"), "supplier", lambda f: f.add_column("v", f.window().max("s_nationkey")).select("s_suppkey", "v"))
_frame("win_whole_row_number", _WHOLE.format("CAST(row_number() OVER (ORDER BY s_suppkey DESC) AS INTEGER)"), "supplier", lambda f: f.add_column("v", f.window().order_by_descending("s_suppkey").row_number()).select("s_suppkey", "v"))


# -- reshape

_CELLS = {
    "sum": ("CAST(sum(p) FILTER (o_orderstatus = '{0}') AS DECIMAL(38,2))", ()), "average": ("round(CAST(sum(p) FILTER (o_orderstatus = '{0}') AS DOUBLE) / count(*) FILTER (o_orderstatus = '{0}'), 6)", ("F", "O", "P")),
    "min": ("min(p) FILTER (o_orderstatus = '{0}')", ()), "max": ("max(p) FILTER (o_orderstatus = '{0}')", ()),
}
for _kind, (_expr, _names) in _CELLS.items():
    _columns = ", ".join(f'{_expr.format(s)} AS "{s}"' for s in "FOP")
    query(f"pivot_table_{_kind}", f"SELECT o_orderpriority, {_columns} FROM (SELECT o_orderpriority, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders) GROUP BY 1")(
        lambda spark, sf_dir, kind=_kind, names=_names: _rounded(getattr(money(table(spark, sf_dir, "orders"), "o_totalprice").pivot_table("o_orderpriority", "o_orderstatus", "o_totalprice"), kind)(), *names)
    )


@query("pivot_unique", "SELECT o_orderpriority, max(n) FILTER (o_orderstatus = 'F') AS \"F\", max(n) FILTER (o_orderstatus = 'O') AS \"O\", max(n) FILTER (o_orderstatus = 'P') AS \"P\" FROM (SELECT o_orderpriority, o_orderstatus, max(o_orderkey) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def _pivot_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").group_by("o_orderpriority", "o_orderstatus").max("o_orderkey")
    return g.pivot("o_orderpriority", "o_orderstatus", "o_orderkey_Max").df


_frame("unpivot_basic", "SELECT s_suppkey, n, v FROM (SELECT s_suppkey, 's_nationkey' AS n, s_nationkey AS v FROM supplier UNION ALL SELECT s_suppkey, 's_other', s_nationkey * 2 FROM supplier)", "supplier",
       lambda f: Frame(f._df.withColumn("s_other", F.col("s_nationkey") * 2), f._declared).unpivot(["s_suppkey"], ["s_nationkey", "s_other"], "n", "v"))
_frame("unpivot_promote", "SELECT p_partkey, 'p_size' AS n, CAST(p_size AS DECIMAL(18,2)) AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', CAST(p_retailprice AS DECIMAL(18,2)) FROM part", "part",
       lambda f: Frame(money(f, "p_retailprice").unpivot(["p_partkey"], ["p_size", "p_retailprice"], "n", "v")._df.withColumn("v", F.col("v").cast("decimal(18,2)"))))


# -- row changes

_frame("row_add", "SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS'", "region", lambda f: f.add_row({"r_name": "ATLANTIS", "r_regionkey": 99}))
_frame("row_update", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'X' ELSE r_name END AS r_name FROM region", "region", lambda f: f.update_row(2, {"r_regionkey": 2, "r_name": "X"}))
_frame("row_remove", "SELECT * FROM region WHERE r_regionkey <> 1", "region", lambda f: f.remove_row(1))


# -- sources and sinks


def _shared(spark: SparkSession) -> str:
    """A new folder that the driver and the executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    local = base.removeprefix("file://") if base and (base.startswith(("file:/", "/"))) else None
    if local:
        os.makedirs(local, exist_ok=True)
    return tempfile.mkdtemp(prefix="tessella-", dir=local)


def _round_trip(write, read, name: str):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = os.path.join(_shared(spark), name)
        write(table(spark, sf_dir, "nation"), path)
        return read(spark, path).df

    return run


# Values of every kind that a text cell can hold; missing cells and empty texts differ in CSV and JSON.
_TYPED = {"i": [1, -2, 3], "l": [3_000_000_000, 4, -5], "d": [decimal.Decimal("1.50"), decimal.Decimal("-2.25"), decimal.Decimal("3.00")], "b": [True, False, True], "x": [0.5, 1e300, -2.0], "s": ['say "hi", you', "two\nlines", "\u00e9"], "n": ["a", None, "c"]}
_CSV = 'id,text,note,flag\n1,"a ""quoted"" cell, with comma","two\nlines",true\n2,,"",false\n3,plain,  spaced  ,true\n'


@query("csv_grammar", "SELECT k AS id, t AS text, n AS note, f AS flag FROM (VALUES (1, 'a \"quoted\" cell, with comma', 'two' || chr(10) || 'lines', true), (2, NULL, '', false), (3, 'plain', '  spaced  ', true)) AS v(k, t, n, f)")
def _csv_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(_shared(spark), "g.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(_CSV)
    return read_csv(spark, path).df


_TYPED_SQL = "SELECT i, {l} AS l, CAST(d AS {d}) AS d, b, CAST(x AS DOUBLE) AS x, s, n FROM (VALUES (1, 3000000000, 1.50, true, 0.5, 'say \"hi\", you', 'a'), (-2, 4, -2.25, false, 1e300, 'two' || chr(10) || 'lines', NULL), (3, -5, 3.00, true, -2.0, chr(233), 'c')) AS v(i, l, d, b, x, s, n)"


def _typed_round_trip(write, read, name: str):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = os.path.join(_shared(spark), name)
        write(Frame.create(spark, _TYPED), path)
        df = read(spark, path).df
        # Readers choose the type of a fraction; the values are compared as doubles.
        return df.withColumns({"d": F.col("d").cast("double"), "x": F.col("x").cast("double"), "l": F.col("l").cast("long"), "i": F.col("i").cast("int")})

    return run


for _name, _write, _read in (("csv", write_csv, read_csv), ("json", write_json, read_json), ("xlsx", write_excel, read_excel)):
    query(f"{_name}_typed", _TYPED_SQL.format(l="CAST(l AS BIGINT)", d="DOUBLE"))(_typed_round_trip(_write, _read, f"t.{_name}"))


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
query("csv_roundtrip", _NATION)(_round_trip(write_csv, read_csv, "n.csv"))
query("json_roundtrip", _NATION)(_round_trip(write_json, read_json, "n.json"))
query("xlsx_roundtrip", _NATION)(_round_trip(lambda f, p: write_excel(f, p, ExcelWriteOptions("Nations")), read_excel, "n.xlsx"))


@query("sql_roundtrip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _sql_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
    write_sql(table(spark, sf_dir, "nation"), db, "nation")
    return read_sql(spark, db, "SELECT * FROM nation").df


@query("parquet_roundtrip", "SELECT * FROM customer")
def _parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.sources import write_parquet

    path = os.path.join(_shared(spark), "c")
    write_parquet(table(spark, sf_dir, "customer"), path)
    return read_parquet(spark, path).df
