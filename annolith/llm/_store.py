"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; where that is unset, a local session gets one of its own, and a cluster is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="annolith-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: lost executors lose nothing, and earlier stages are not run again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of the tables from ``cut`` that ``df`` reads; nothing may read them any more."""
    leaves = df._jdf.queryExecution().logical().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD" and (file := leaf.rdd().getCheckpointFile()).isDefined():
            remove(df.sparkSession, file.get())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def swept(df: DataFrame) -> None:
    """Let Spark delete shuffles and tables from ``cut`` that nothing refers to any more: its cleaner learns of these when the driver collects garbage."""
    import gc
    import time

    gc.collect()
    waiting = getattr(df.sparkSession.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(30):  # py4j tells Java within about a second what Python has let go
        time.sleep(0.1)
        if not waiting:
            break
    df.sparkSession.range(1).count()  # the scheduler and the listeners hold on to the last job until they see another
    df.sparkSession._jvm.System.gc()


#: Bytes that a Python worker gets at once (Spark's own default is 64 MB, of which several copies are in memory).
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after Arrow batches of its session were limited to 8 MB, unless the session has a limit of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, "67108864b") == "67108864b":
        conf.set(BATCH_BYTES, "8m")
    return df


def tidy() -> None:
    """Give memory that a task no longer needs back, as Python workers live on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidied(run):
    """A function over batches that tidies up when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped
