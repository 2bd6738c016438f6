"""Tables written to the folder that driver and executors share.

A staged table cuts lineage: if an executor is lost, its readers start again from the files, not
from the first scan.  The folder is the one that ``spark.checkpoint.dir`` names; only in local mode
(tests) is one chosen here when the setting is absent.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from cairnmem.runtime import let_workers_import, shared_folder

#: Drops a query's shuffle files as soon as its write has been committed.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
# Make a worker give freed memory back instead of keeping it for later.
_WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_TRIM_THRESHOLD_": "67108864"}


def prepare(spark: SparkSession) -> None:
    """Bound what a Python worker holds: small Arrow batches, whatever the length of the texts, and
    freed memory given back.  Sets these for the session; a smaller batch that is set already stays."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    spark.sparkContext.environment.update(_WORKER)
    let_workers_import(spark)


class Stage:
    """The staged tables of one run of an operator.

    Results read them, so they last as long as the driver; Hadoop deletes the folder when it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/cairnmem-{name}-{uuid.uuid4().hex}"
        self._n = 0
        files, path = self.files(spark, self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        #: The folder with the scheme of its store.
        self.qualified = files.makeQualified(path).toString()

    @staticmethod
    def files(spark: SparkSession, path: str):
        """The file system of a path, and the path."""
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df and return it as read back, with the same schema."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        out = df.write.option("compression", "zstd")
        with _shuffles_dropped(self.spark):
            (out.partitionBy(by) if by else out).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path).select(df.columns)
        back._cairnmem_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        for t in tables:
            files, path = self.files(self.spark, t._cairnmem_path)
            files.delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how far work is cut, never what is worked on."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
