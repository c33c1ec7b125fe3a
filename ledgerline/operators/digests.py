"""Digests of logical rows that depend on the order of keys and on nothing else.

A row's frame names each column's type and length, so no two rows have the same. Rows are ranked by key over range partitions, hashed in blocks
of neighbours, the blocks' hashes in blocks again, up to one: a tree whose shape follows from the number of rows alone, so layout and
partitioning don't matter, and no task holds more than a block's hashes. A tree may be told to have so many levels; then the last takes all that
the one below it left, with two levels 64 bytes for each block of rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import scratch

#: Hashes that are put together at each step.
BLOCK = 1024


def framed(frame: DataFrame) -> Column:
    """The row as text: of each column in the order of names its type and its value's length and text, or that there is none."""

    def one(c: str) -> Column:
        kind, col = frame.schema[c].dataType, F.col(f"`{c}`")
        nested = isinstance(kind, T.ArrayType | T.StructType | T.MapType)
        text = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}) if nested else F.hex(col) if isinstance(kind, T.BinaryType) else col.cast("string")
        tag = kind.simpleString()
        return F.when(col.isNull(), f"{tag};").otherwise(F.concat(F.lit(f"{tag}:"), F.octet_length(text), F.lit(":"), text, F.lit(";")))

    return F.concat(*map(one, sorted(frame.columns)))


def ordered_hashes(frame: DataFrame, key: list[str], save) -> DataFrame:
    """rank (from 0, by key and then by the row itself), hash of each row."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frame.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)), F.sha2(framed(frame), 256).alias("h"))
    by = [*(F.col(f"k{i}").asc_nulls_first() for i in range(len(key))), F.col("h")]
    # the number parts rows that are equal in all, so that no part holds all copies of one
    dealt = save(rows.withColumn("i", F.monotonically_increasing_id()).repartitionByRange(parts, *by, F.col("i")).withColumn("part", F.spark_partition_id()), "rows")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*by)) + F.col("before") - 1
    return dealt.join(F.broadcast(before), "part").select(place.alias("rank"), "h")


def tree_level(hashes: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """rank, hash of each block of neighbours; without a block's size, of all."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "h")))  # a block
    return hashes.groupBy((F.floor(F.col("rank") / block) if block else F.lit(0)).cast("long").alias("b")).agg(listed.alias("x")).select(F.col("b").alias("rank"), F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ""), 256).alias("h"))


def keyed_digest(frame: DataFrame, key: list[str], block: int = BLOCK, levels: int | None = None) -> str:
    """SHA-256 of schema, key and the tree over all rows in the order of the key, of at most `levels` if given; for no rows, of schema and key alone."""
    with scratch(frame.sparkSession, "digest") as save:
        level, n = ordered_hashes(frame, key, save), 0
        while True:
            level, n = save(tree_level(level, None if n + 1 == levels else block), f"level{n}"), n + 1
            top = level.limit(2).collect()
            if len(top) < 2:
                break
    schema = [[c, frame.schema[c].dataType.simpleString()] for c in sorted(frame.columns)]
    return hashlib.sha256(json.dumps([schema, key, *(r.h for r in top)], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
