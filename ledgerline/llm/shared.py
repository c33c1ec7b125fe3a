"""Written intermediate tables in the cluster's shared folder, and joins that survive hot keys."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import shared_folder

#: A side of a join is broadcast whole up to so many rows; beyond that, only its hot keys are.
BROADCAST_ROWS = 100_000
#: A key is hot if it has at least this share of all rows, so there are never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 500


_SCOPES: list[list[Workspace]] = []


class Workspace:
    """Tables written to the shared folder, so that what follows doesn't depend on any executor's disk."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        for scope in _SCOPES:
            scope.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for place in map(self.path, names):
            self._delete(place)

    def close(self) -> None:
        """Deletes all its tables."""
        self._delete(self.root)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def gathered() -> Iterator[list[Workspace]]:
    """The workspaces of all operators that are called inside."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so only when objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def buckets_of(spark: SparkSession, items: int, most: int) -> int:
    """Enough to hold `most` items or so each and to keep the cores busy, no more: a text is named in every bucket that it has items in."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-items // most))


def as_row(docs: DataFrame) -> Column:
    """A row in one struct, so that none of its names can clash with one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def rows_of(frame: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` out of the struct in `frame`, some of them with new values, in their own types."""
    if new:  # in a step of its own, as a column of docs may be named like one that a value is computed from
        frame = frame.select("_row", F.struct(*[v.cast(docs.schema[c].dataType).alias(c) for c, v in new.items()]).alias("_new"))
    return frame.select(*[F.col("_new" if c in new else "_row").getField(c).alias(c) for c in docs.columns])


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, n_right: int, count: str) -> DataFrame:
    """left with the columns of right that has its key, null without one; right has a row for each key and a `count` of left's rows with it.

    rows: of left. right is broadcast if it has at most BROADCAST_ROWS rows; else its hot keys are, of which there
    are at most 1 / HOT_SHARE, and the others are shuffled, none of them with more than HOT_SHARE of left's rows.
    """
    if n_right <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    least = max(1.0, rows * HOT_SHARE)
    hot = right.filter(F.col(count) >= least)
    cold = right.filter(F.col(count) < least)
    is_hot = left.join(F.broadcast(hot), key, "inner")
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key, "left")
    return is_hot.unionByName(others)
