"""Session set-up, the shared work folder and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "dataweft", shuffle_partitions: int | None = None,
              **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    ``shuffle_partitions`` is left to the cluster's own setting unless given:
    AQE coalesces small partitions, so it should be chosen for the largest shuffle.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only where it is unset and every task runs in this process (``local[n]``) a temporary folder serves, which goes with it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="dataweft-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once into the shared folder and go on from there.

    The result has no lineage, so a lost executor never re-runs (and never re-samples) what lies before.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting inside the block; work must be evaluated before the block ends."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession, n: int):
    """Shuffle into ``n`` partitions inside the block."""
    return setting(spark, "spark.sql.shuffle.partitions", str(n))


def shuffles_go(spark: SparkSession):
    """Frames made inside the block drop their shuffle files when an action on them ends, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage: files of shuffles and checkpoints go once it finds that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def swept(spark: SparkSession, every: float = 15.0) -> Iterator[None]:
    """``sweep`` every so many seconds while the block runs, for work that makes and drops many frames in one call."""
    over = threading.Event()

    def work() -> None:
        while not over.wait(every):
            sweep(spark)

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
