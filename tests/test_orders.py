"""Operators over whole orders against plain Python."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequery.operators import caches, catalog, ordered, requests, reuse


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables in as many parts as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_earlier_and_less():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 64, 100, 1000):
        for x in (rng.integers(0, 5, n), rng.permutation(n), np.zeros(n, np.int64), np.arange(n)[::-1], rng.integers(-9, 1 << 40, n)):
            assert reuse.earlier_and_less(x).tolist() == [int((x[:k] < x[k]).sum()) for k in range(n)]


def test_numbered_over_many_tasks(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.lit("clash").alias("n")).repartition(9)
    got = ordered.numbered(rows, "x").collect()
    assert [r.idx for r in sorted(got, key=lambda r: r.x)] == list(range(5000)) and len({r.part for r in got}) > 1
    assert ordered.numbered(rows.filter("false"), "x").count() == 0


def log(rng, n, shards, keys):
    return [(rng.choice(shards), k, "get", rng.choice(keys), 1) for k in range(n)]


def reused(rows):
    out, seen = {}, collections.defaultdict(list)
    for shard, seq, _, key, _ in sorted(rows, key=lambda r: r[1]):
        stack = seen[shard]
        out[seq] = len(stack) - 1 - stack.index(key) if key in stack else None
        if key in stack:
            stack.remove(key)
        stack.append(key)
    return out


@pytest.mark.parametrize("block", [4, 16, None])
def test_reuse_distances_of_hot_shards_and_keys(spark, block):
    rng = random.Random(block or 1)
    rows = log(rng, 900, ["hot"] * 8 + ["b", "c", None], ["k"] * 12 + [f"k{i}" for i in range(40)] + [None])
    frame = spark.createDataFrame(rows, "shard string, seq long, op string, key string, bytes long").withColumn("idx", F.lit("clash")).drop("idx").repartition(5)
    got = reuse.distances(frame, block)
    assert {r.seq: r.distance for r in got.collect()} == reused(rows)
    shares = collections.defaultdict(list)
    for r in reuse.hit_shares(got).collect():
        shares[r.shard].append((r.capacity, r.hits, r.uses))
    for shard in ("hot", "b", None):
        own = [reused(rows)[r[1]] for r in rows if r[0] == shard]
        assert sorted(shares[shard]) == [(d + 1, sum(x is not None and x <= d for x in own), len(own)) for d in sorted({x for x in own if x is not None})]


def test_distances_tell_what_a_replay_hits(spark):
    rows = log(random.Random(2), 600, ["a", "b"], [f"k{i}" for i in range(12)])
    frame = spark.createDataFrame(rows, "shard string, seq long, op string, key string, bytes long")
    distance = {r.seq: r.distance for r in reuse.distances(frame).collect()}
    for capacity in (1, 4, 9):
        hits = {r.seq: r.hit for r in caches.replay_lru(frame, capacity).collect()}
        assert hits == {k: d is not None and d < capacity for k, d in distance.items()}


def test_distances_of_nothing(spark):
    empty = spark.createDataFrame([], "shard string, seq long, op string, key string, bytes long")
    assert reuse.distances(empty).count() == 0 and reuse.hit_shares(reuse.distances(empty)).count() == 0


def islands(rows, gap):
    out = []
    for s, o, n in sorted(r for r in rows if r[0] is not None and r[1] is not None and r[2]):
        if out and out[-1][0] == s and o <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], o + n)
            out[-1][3] += 1
        else:
            out.append([s, o, o + n, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gap", [0, 50])
def test_reads_of_a_hot_slide(spark, gap):
    rng = random.Random(gap)
    rows = [("hot", rng.randrange(60_000), rng.choice([0, 1, 30, 900])) for _ in range(1500)] + [(f"s{k % 5}", k * 97, 60) for k in range(200)]
    rows += [("hot", 10, 30_000), ("hot", 10, 30_000), (None, 1, 1), ("x", None, 1), ("x", 1, None)] + [("line", 100 * k, 100) for k in range(500)]
    frame = spark.createDataFrame(rows, "slide_id string, offset long, length long").withColumn("part", F.lit("clash")).repartition(6)
    got = requests.read_plan(frame, gap)
    assert sorted((r.slide_id, r.start, r.end, r.ranges) for r in got.collect()) == islands(rows, gap)
    parts = requests.read_plan(frame, gap, most=1000).collect()
    assert all(0 < r.end - r.start <= 1000 for r in parts)
    for slide, start, end, n in islands(rows, gap):
        own = sorted((r.start, r.end, r.ranges) for r in parts if (r.slide_id, r.island) == (slide, start))
        assert own[0][0] == start and own[-1][1] == end and all(a[1] == b[0] for a, b in zip(own, own[1:])) and sum(r[2] for r in own) == n
    assert requests.read_plan(frame.filter("false"), gap, most=10).count() == 0


def test_pages_follow_their_cursors(spark):
    names = [f"s/{k:03d}.svs" for k in range(0, 100)] + ["x.jpg", None, "s/007.svs"]
    frame = spark.createDataFrame([(n,) for n in names], "slide_id string").repartition(5)
    every = catalog.pages(frame, 10).orderBy("page", "position").collect()
    assert [r.slide_id for r in every] == sorted(n for n in names if n and n.endswith("svs")) and [(r.page, r.position) for r in every] == [(k // 10, k % 10) for k in range(101)]
    assert every[-1].next_cursor is None and every[95].next_cursor == every[99].slide_id
    unlike = frame.distinct()
    cursor, k = None, 0
    while True:  # page() by its cursors
        own = catalog.page(unlike, 30, cursor).collect()
        assert sorted(r.slide_id for r in own) == sorted(r.slide_id for r in catalog.pages(unlike, 30).filter(F.col("page") == k).collect())
        cursor, k = own[0].next_cursor, k + 1
        if cursor is None:
            break
    assert k == 4 and catalog.pages(frame.filter("false"), 10).count() == 0 and catalog.pages(frame, 1000).filter("next_cursor IS NOT NULL").count() == 0
    plan = catalog.pages(frame, 10)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


SEARCHES = [(1, "a/", "tumor"), (2, None, "TUM"), (3, "b/", None), (4, None, "x"), (5, None, ""), (6, "", "é"), (7, "a/tumor", ""), (8, None, "zz9"), (9, "A/", "or"), (10, "nothing", "o"), (11, None, "aaa"), (12, "a", None)]


def test_many_searches(spark):
    slides = ["a/Tumor_1.svs", "a/tumor_2.TIF", "b/TUMor.tiff", "b/x.jpg", "b/aaaa.svs", "c/É.svs", ".svs", "c/İx.tif", None, "a/Tumor_1.svs"]
    frame = spark.createDataFrame([(s,) for s in slides], "slide_id string")
    asked = spark.createDataFrame(SEARCHES, "search_id long, prefix string, search string").withColumn("gram", F.lit("clash"))
    got = collections.defaultdict(set)
    for r in catalog.searched(frame, asked).collect():
        assert r.slide_id not in got[r.search_id]
        got[r.search_id].add(r.slide_id)
    for i, prefix, search in SEARCHES:
        assert got[i] == {r.slide_id for r in catalog.matching(frame, prefix, search).collect()}, i
    assert "NestedLoop" not in catalog.searched(frame, asked)._jdf.queryExecution().toString() and "Cartesian" not in catalog.searched(frame, asked)._jdf.queryExecution().toString()
    assert catalog.searched(frame.filter("false"), asked).count() == 0 and catalog.searched(frame, asked.filter("false")).count() == 0


def test_scratch_tables_go(spark):
    import glob

    from tilequery.operators import chains

    rows = log(random.Random(3), 50, ["a"], ["x", "y"])
    frame = spark.createDataFrame(rows, "shard string, seq long, op string, key string, bytes long")
    links = spark.createDataFrame([("s", k, k + 1) for k in range(1, 9)], "slide_id string, offset long, next_offset long")
    folder = ordered.shared_dir(spark).removeprefix("file://") + "/tilequery/*"
    before = set(glob.glob(folder))
    with ordered.scratch(spark):
        assert reuse.distances(frame).count() == 50 and chains.followed(links.select("slide_id", F.lit(1).cast("long").alias("offset")), links).count() == 9
        assert len(set(glob.glob(folder)) - before) == 3  # one of the uses, two of the chains
    assert set(glob.glob(folder)) == before
