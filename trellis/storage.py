"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []

#: most bytes of rows that go to a Python worker at once; the default is a count of rows, however long these are
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: bytes of files read for each partition of a shuffle, and bytes up to which small partitions are put together again
DEALT_BYTES, PART_BYTES = 1 << 20, 16 << 20
_DEALT, _PART = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in batches of BATCH_BYTES; a batch is held by the executor and by the worker,
    with all that the worker makes of it."""
    before = spark.conf.get(_BYTES, None)
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BYTES) if before is None else spark.conf.set(_BYTES, before)


@contextmanager
def many_parts(df: DataFrame) -> Iterator[None]:
    """What runs meanwhile deals rows out to as many partitions as the files that `df` reads call for, so that what a task
    holds does not grow with the tables; adaptive execution puts small ones together up to PART_BYTES."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().analyzed().collectLeaves()
    read = sum(min(int(str(leaves.apply(i).stats().sizeInBytes())), 1 << 40) for i in range(leaves.size()))
    before = {k: spark.conf.get(k, None) for k in (_DEALT, _PART)}
    dealt, part = int(spark.conf.get(_DEALT)), spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_PART))
    spark.conf.set(_DEALT, str(max(dealt, min(10_000, read // DEALT_BYTES))))
    spark.conf.set(_PART, f"{min(part, PART_BYTES)}b")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode, where that may be unset."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="trellis-"))
    return _own[0]


class Scratch:
    """Tables of one operator call, each under a fresh name in the shared folder.

    A written table survives lost executors, costs one pass and is read again with the schema it was written with.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        with small_batches(self.spark), many_parts(df):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._trellis_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._trellis_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
