"""Shared parts of the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts, as a Java and Python character class. A fixed value.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder stands in on a single machine (``local`` masters, as in tests); on a cluster that
    is an error, since executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessella-shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; a lost executor then costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder until ``forget``: a fraction of a checkpoint's size, as columns are packed."""
    path = os.path.join(shared_folder(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._tessella_path = path
    return out


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing can read any more: it does so when the driver collects garbage.

    The driver's freed native memory goes back to the system too.
    """
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Return the native memory that the driver's JVM has freed.

    The C library keeps what the JIT compiler and hundreds of pool threads free in an arena of each thread: some 190 MB
    after one line de-duplication. A JVM without the command (before 17.0.9, or not on Linux) keeps it.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # The server's class is not exported, so its interface's method is called.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.Object, 4)
    args[0], args[1] = bean, "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(server, args)


def forget(*checkpoints: DataFrame) -> None:
    """Delete the files of checkpoints and stored tables that nothing reads any more, and the shuffle files behind them."""
    for df in checkpoints:
        if getattr(df, "_tessella_path", None):
            drop_folder(df.sparkSession, df._tessella_path)
            continue
        plan = df._jdf.queryExecution().analyzed()
        path = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None  # another plan has no files
        if path is not None and path.isDefined():
            drop_folder(df.sparkSession, path.get())
    if checkpoints:
        release(checkpoints[0].sparkSession)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def id_text(name: str) -> Column:
    """An id on its way through pandas, which would turn longs beside nulls into doubles."""
    return F.col(name).cast("long").cast("string")


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model learns from; rows without an id never do."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def spread(*columns: Column) -> Column:
    """A hash that orders rows at random but always alike."""
    return F.xxhash64(F.lit(7919), *columns)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package; Spark's own file server delivers it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-code-"), "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tessella_shipped = True
