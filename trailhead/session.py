"""Session builder with the settings the operators assume.

Everything here is a default: a cluster's own configuration wins, because ``getOrCreate`` keeps the running session.
"""

from __future__ import annotations

import functools
import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole source files travel through Arrow: keep a batch small enough for a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "trailhead", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes that go to a Python worker at a time, where the session says nothing else: texts differ too much in length for rows alone.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at a time; a session's own settings win."""
    given = spark.conf.getAll
    for key, value in BATCH_LIMITS.items():
        if key not in given:
            spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, for clusters where it is only on the driver's path.

    Functions that run in Python workers import it there.
    """
    home = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", home.parent, home.name)     # the driver serves it
    spark.sparkContext.addPyFile(archive)


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="trailhead-")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset a local master gets a folder of its own; on any other
    master it is an error, since executors could not see each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or _local_folder()


#: Removes a query's shuffle files when it ends; else they stay until the driver's garbage collector finds its plan.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write a frame that several later steps read to the shared folder, and read it back.

    The table outlives a lost executor and cuts the plan; being columnar with known sizes, later steps read only the
    columns they need and Spark can plan their joins. Shuffle files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    out = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(out)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(out)
