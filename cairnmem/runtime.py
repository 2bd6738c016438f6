"""What a session needs to run this package."""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, whatever the working folder.

    This serves machines that share the driver's files, as in local mode; on a cluster the package is
    shipped with --py-files or installed.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only in local mode is one chosen here where that is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/") or "file://" + os.path.join(tempfile.gettempdir(), "cairnmem-checkpoints")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for as long as the driver lives."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/cairnmem-{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return files.makeQualified(path).toString()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of df in an order that has no ties, for any n.

    For an n that no task should hold, unlike a sort with a limit: rows are sorted by ranges, each range is
    counted, and whole ranges are taken up to the one in which the n-th row lies.
    """
    place = F.monotonically_increasing_id()
    ranked = cut(df.orderBy(*order).withColumn("_at", place))
    # One row a partition.
    counts = ranked.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    last, left = -1, n
    for r in counts:
        if left <= 0:
            break
        last, left = (r["p"] << 33) + min(left, r["n"]) - 1, left - r["n"]
    return ranked.where(F.col("_at") <= last).drop("_at")
