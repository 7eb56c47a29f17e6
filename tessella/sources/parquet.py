"""Parquet: the scalable source and sink. The row order is the file name, then the place in the file."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.names import ORDER
from tessella.operators.frame import Frame


def read_parquet(spark: SparkSession, path: str, not_null: bool = False) -> Frame:
    """Read a file or folder. ``not_null``: the columns are known to hold no nulls, so filters push down."""
    df = spark.read.parquet(path)
    order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    frame = Frame(df.withColumn(ORDER, order))
    return frame.not_null() if not_null else frame


def write_parquet(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    """Write the rows in parallel; ``read_parquet`` has them in file order."""
    frame.df.write.mode(mode).parquet(path)
