"""Reuse distances: what caches of every capacity would hold, without replaying one.

The reuse distance of a use is the number of other keys used since the last use of its key. A
cache that evicts the least recently used of C entries hits exactly where the distance is under C,
so one table of distances has the hits of all capacities.

Let uses be numbered through all shards, shard by shard, and p(i) be the number of the last use
of i's key in its shard (-1: none). Of the uses before i, those with p(j) < p(i) are all up to p(i) itself and, after it,
the first use of each other key; hence

    distance(i) = #{j < i: p(j) < p(i)} - p(i) - 1.

The count is taken over a grid of blocks of i by blocks of p: whole blocks from running sums over
the grid, the rest within one block of i and one block of p, each of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import carried, numbered, written_alone

LEAST_BLOCK = 256


def earlier_and_less(x: np.ndarray) -> np.ndarray:
    """For each place the number of earlier places with a lesser value: merges from the bottom up, all of one width at a time."""
    n = len(x)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-np.arange(n), x))] = np.arange(n)  # of equal values the later is the lesser: it isn't counted
    count = np.zeros(n, np.int64)
    order, width = np.arange(n), 1
    while width < n:
        run = np.arange(n) // width
        right = run % 2 == 1
        # the sorted left runs one after the other, each in a range of values of its own
        left = rank[order[~right]] + (run[~right] // 2) * n
        own = order[right]
        count[own] += np.searchsorted(left, rank[own] + (run[right] // 2) * n) - np.minimum((run[right] // 2) * width, len(left))
        order = order[np.argsort(rank[order] + (np.arange(n) // (2 * width)) * n, kind="stable")]
        width *= 2
    return count


def last_uses(log: DataFrame) -> DataFrame:
    """log (shard, seq, key, ...) with idx (the number of a use, by shard and seq) and last (that of the last use of its key in the shard)."""
    own = numbered(log, "shard", "seq", "key")
    # within a part by a window; for the first use there, from the parts before
    before = Window.partitionBy("part", "shard", "key").orderBy("idx")
    own = carried(own, ["shard", "key"], F.col("idx"), "carry").withColumn("last", F.coalesce(F.lag("idx").over(before), "carry"))
    return own.drop("part", "carry")


def distances(log: DataFrame, block: int | None = None) -> DataFrame:
    """log (shard, seq, key, ...) with distance, null for the first use of a key.

    A null key is a key of its own, as a null shard is a shard; rows with equal shard and seq count in the order
    of their keys. block: uses a block; by default about the root of their number, so that the grid has about as many cells as
    the log rows. A hot shard or key is many blocks like any other."""
    own = log.withColumns({"shard": F.struct("shard"), "key": F.struct("key")})  # null is a value
    uses = written_alone(lambda: last_uses(own), log.sparkSession, "uses")
    n = uses.count()
    block = block or max(LEAST_BLOCK, 1 << (max(n, 1) - 1).bit_length() // 2)
    points = uses.select("idx", F.coalesce("last", F.lit(-1)).alias("p"))
    points = points.withColumn("b", F.floor(F.col("idx") / block)).withColumn("v", F.floor(F.col("p") / block))

    side = -(-n // block)
    cells = log.sparkSession.range(side).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(-1).cast("long"), F.col("id"))).alias("v"))
    cells = cells.join(points.groupBy("b", "v").agg(F.count("*").alias("n")), ["b", "v"], "left")
    before = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # of one column all blocks before; then of one row all columns before, where the column's own past is 0 before it begins
    grid = cells.withColumn("above", F.coalesce(F.sum("n").over(before("v", "b")), F.lit(0)))
    grid = grid.select("b", "v", F.coalesce(F.sum("above").over(before("b", "v")), F.lit(0)).alias("whole"))

    def within(value: str):
        def run(group: pa.Table) -> pa.Table:
            t = group.sort_by("idx")
            return pa.table({"idx": t["idx"], "n": pa.array(earlier_and_less(np.asarray(t[value])))})

        return run

    rows = points.groupBy("b").applyInArrow(within("v"), "idx long, n long").withColumnRenamed("n", "n_row")
    columns = points.filter("v >= 0").groupBy("v").applyInArrow(within("p"), "idx long, n long").withColumnRenamed("n", "n_column")
    got = points.filter("p >= 0").join(grid, ["b", "v"]).join(rows, "idx").join(columns, "idx")
    got = got.select("idx", (F.col("whole") + F.col("n_row") + F.col("n_column") - F.col("p") - 1).alias("distance"))
    out = uses.drop("last").join(got, "idx", "left").drop("idx")
    return out.withColumns({"shard": F.col("shard.shard"), "key": F.col("key.key")})


def hit_shares(distances: DataFrame) -> DataFrame:
    """(shard, capacity, hits, uses) for every capacity at which a shard's hits change: a cache of so many entries and up to the next has these hits."""
    per = distances.groupBy("shard", "distance").agg(F.count("*").alias("n"))
    uses = F.sum("n").over(Window.partitionBy("shard"))
    up_to = Window.partitionBy("shard").orderBy(F.col("distance").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = per.select("shard", (F.col("distance") + 1).alias("capacity"), F.sum("n").over(up_to).alias("hits"), uses.alias("uses"))
    return out.filter("capacity IS NOT NULL")
