"""Session construction and the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings that do not depend on the cluster's size.  Shuffle partition counts
# are left to the cluster (AQE coalesces them), only local runs set them.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(app: str = "covenantry", cores: int | str = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Shuffle files go when the action that made them ends, not when the driver happens to collect garbage: a
# query of many steps else keeps those of all its steps.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must share.

    Only on a local master, as in tests, is a scratch folder set where none is configured.  Whoever stores tables
    there also has Spark remove the shuffle files of each step at its end.
    """
    spark.conf.set(FILE_CLEANUP, "true")
    name = spark.conf.get("spark.checkpoint.dir", None)
    if name is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    spark.conf.set(FILE_CLEANUP, "true")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark.sparkContext.getCheckpointDir() or shared_folder(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def written(df: DataFrame, *, lasting: bool = False) -> DataFrame:
    """Write to the shared checkpoint folder and read back: nothing of the plan is carried
    along, which matters where a loop would pile it up."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    if not lasting and (held := _passing.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end, but for lasting ones: what is handed on must not read any other."""
    outer = _passing.set([])
    try:
        yield
    finally:
        held = _passing.get()
        _passing.reset(outer)
        for name in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over all shuffle partitions before a stage that is heavy per row.

    A fixed number keeps AQE from folding few bytes of costly work into one task, and
    hashing by row keys takes apart what one hot key had brought together.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *columns)
