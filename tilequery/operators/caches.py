"""Replay of request logs against bounded caches, a cache per shard."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Cache(OrderedDict):
    """The state of one shard: sizes by key in order of eviction, and their sum where it is bounded."""

    bytes = 0


def replay_lru(log: DataFrame, capacity: int) -> DataFrame:
    """log (shard, seq, op, key, bytes): an LRU cache of `capacity` entries; every look-up promotes, a miss loads.

    One pass over the sorted log with the cache as the only state: linear, where a join of
    reuse distances would grow with the square of a shard."""

    def step(cache: Cache, row) -> tuple[bool | None, list[str]]:
        if row.key in cache:
            cache.move_to_end(row.key)
            return True, []
        evicted = [cache.popitem(last=False)[0]] if len(cache) >= capacity else []
        cache[row.key] = row.bytes
        return False, evicted

    return _replay(log, step)


def replay_bytes_lru(log: DataFrame, max_bytes: int, max_entries: int | None = None) -> DataFrame:
    """log (shard, seq, op get|put, key, bytes): hits and evicted keys of a cache bounded by bytes and entries.

    get promotes; put replaces and then evicts the least recent while over the bounds; an
    item larger than the bound evicts everything and itself. State is one cache of bounded
    size; rows stream through in order of (shard, seq)."""

    def step(cache: Cache, row) -> tuple[bool | None, list[str]]:
        if row.op == "get":
            hit = row.key in cache
            if hit:
                cache.move_to_end(row.key)
            return hit, []
        cache.bytes += row.bytes - cache.pop(row.key, 0)
        cache[row.key] = row.bytes
        evicted = []
        while cache and (cache.bytes > max_bytes or (max_entries is not None and len(cache) > max_entries)):
            key, size = cache.popitem(last=False)
            cache.bytes -= size
            evicted.append(key)
        return None, evicted

    return _replay(log, step)


def replay_block_fifo(log: DataFrame, capacity: int) -> DataFrame:
    """log (shard, seq, op, key, bytes): block cache whose look-ups don't renew a block; evicts by age."""

    def step(cache: Cache, row) -> tuple[bool | None, list[str]]:
        if row.key in cache:
            return True, []
        evicted = [cache.popitem(last=False)[0]] if len(cache) >= capacity else []
        cache[row.key] = row.bytes
        return False, evicted

    return _replay(log, step)


def _replay(log: DataFrame, step) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, cache = None, Cache()
        for frame in frames:
            hits, gone = [], []
            for row in frame.itertuples(index=False):
                if row.shard != shard:
                    shard, cache = row.shard, Cache()
                hit, evicted = step(cache, row)
                hits.append(hit), gone.append(evicted)
            yield frame[["shard", "seq", "op", "key"]].assign(hit=pd.array(hits, "boolean"), evicted=gone)

    rows = log.select("shard", "seq", "op", "key", "bytes").repartition("shard").sortWithinPartitions("shard", "seq")
    kind = dict(log.dtypes)
    return rows.mapInPandas(run, f"shard {kind['shard']}, seq {kind['seq']}, op string, key string, hit boolean, evicted array<string>")


def cache_stats(entries: DataFrame) -> DataFrame:
    """entries (length): size and count."""
    return entries.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.count("*").alias("entries"))
