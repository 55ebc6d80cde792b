"""Orders over whole tables that no single task holds: ranks, running values, and what came before."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a session on one machine without it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tilequery_")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_PATHS: ContextVar[list[str] | None] = ContextVar("tables written for an order", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete, at the end of the block, the tables that operators of this module and those built on it wrote within it.

    What comes out of them is read lazily: write or collect it within the block. Without a block the tables stay in the shared folder.
    Each thread has blocks of its own."""
    paths: list[str] = []
    token = _PATHS.set(paths)
    try:
        yield paths
    finally:
        _PATHS.reset(token)
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read from there: what is computed on it later sees one and the same table."""
    path = f"{shared_dir(df.sparkSession)}/tilequery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _PATHS.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """The table that make() gives, written; what was written on the way to it is deleted."""
    with scratch(spark) as inner:
        out = written(make(), name)
        path = inner.pop()  # the result's own
    if (paths := _PATHS.get()) is not None:
        paths.append(path)
    return out


def in_parts(df: DataFrame, *order: str) -> DataFrame:
    """df dealt by ranges of `order`, with part (ascending with the order) and pos (the rank within it, from 0); written.

    Rows that are equal in all of `order` share a part, so end it with what tells rows apart."""
    at = F.monotonically_increasing_id()  # the task's number, then the row's number in it
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "in_parts")


def by_part(parts: DataFrame, size: Column) -> Column:
    """The sum of `size` (an aggregate) over the parts before a row's own; the driver holds a number for each part."""
    rows = parts.groupBy("part").agg(size.alias("n")).collect()
    per = {r["part"]: r["n"] or 0 for r in rows}
    before, total = [], 0
    for k in range(max(per, default=-1) + 1):
        before.append(total)
        total += per.get(k, 0)
    return F.get(F.lit(before or [0]), F.col("part")).cast("long")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with part and idx, the rank of each row in the order of the whole table, from 0."""
    parts = in_parts(df, *order)
    return parts.withColumn("idx", F.col("pos") + by_part(parts, F.count("*"))).drop("pos")


def carried(parts: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """parts with `name`: the greatest `value` of the rows with the same keys in earlier parts (null: there is none).

    What is looked through is a row for each key and part, so a key of any number of rows is dealt like others."""
    per = parts.groupBy(*keys, "part").agg(F.max(value).alias("own"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "part", F.max("own").over(before).alias(name)).filter(F.col(name).isNotNull())
    return parts.join(per, [*keys, "part"], "left")
