"""Spark sessions for local use, and what every query needs of a session it is given."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where they share the driver's file system."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own if the executors are threads of the driver, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # the setting can't be changed in a session that runs, so the folder is kept here
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        folder = _OWN[app]
    return folder.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, whatever reads them and whatever executor is lost."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A way to write tables like `written`, all of which are deleted at the end: for what is worked out inside."""
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(frame: DataFrame, part: str) -> DataFrame:
        frame.write.parquet(f"{root}/{part}")
        return spark.read.schema(frame.schema).parquet(f"{root}/{part}")

    try:
        yield save
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a task is given by `dealt`.
ROWS_A_TASK = 200_000


def dealt(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame with equal keys in one part, in so many parts that a task's share of `rows` stays the same however many there are.

    Adaptive execution leaves parts that were asked for as they are, while others are put together by their compressed bytes.
    """
    return frame.repartition(max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
