import datetime
import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequery import config
from tilequery.operators import caches, catalog, jpeg, requests, tiles, validation, views
from tilequery.streaming import request_log


def slides(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "slide_id string")


def test_listing_and_paging(spark):
    all_ = slides(spark, ["b.svs", "a.svs", "c.TIF", "x.jpg", "d.tiff", "a_%.svs"])
    first = catalog.page(all_, 2).collect()
    assert [r.slide_id for r in first] == ["a.svs", "a_%.svs"] and first[0].next_cursor == "a_%.svs"
    rest = catalog.page(all_, 10, cursor="a_%.svs").collect()
    assert [r.slide_id for r in rest] == ["b.svs", "c.TIF", "d.tiff"] and rest[0].next_cursor is None
    assert [r.slide_id for r in catalog.matching(all_, "a_%").collect()] == ["a_%.svs"]
    assert [r.slide_id for r in catalog.matching(all_, None, "tif").orderBy("slide_id").collect()] == ["c.TIF", "d.tiff"]
    short = catalog.page(slides(spark, ["a.jpg", "b.svs", "c.svs"]), 2, page_first=True).collect()
    assert [r.slide_id for r in short] == ["b.svs"] and short[0].next_cursor == "b.svs"
    assert catalog.connectivity(all_).first()[0] == 5
    assert catalog.page(all_.filter("false"), 5).collect() == []


def test_requests_error_order(spark):
    lv = spark.createDataFrame([("s", 0, 4, 3)], "slide_id string, level int, tiles_x long, tiles_y long")
    rows = [(1, "s", 0, 3, 2, 80), (2, "s", 0, 4, 0, 80), (3, "s", 1, 0, 0, 80), (4, "gone", 0, 0, 0, 80), (5, "gone", 9, 9, 9, 0), (6, "s", 0, 0, 0, None)]
    r = requests.resolve(spark.createDataFrame(rows, "request_id long, slide_id string, level int, tile_x long, tile_y long, quality int"), lv)
    got = {x.request_id: (x.status, x.error, x.tile_index, x.quality) for x in r.collect()}
    assert got == {
        1: (200, None, 11, 80), 2: (400, "tile_out_of_bounds", None, 80), 3: (400, "invalid_level", None, 80),
        4: (404, "not_found", None, 80), 5: (400, "invalid_quality", None, 0), 6: (200, None, 0, 80),
    }
    assert "max: 3, 2" in r.filter("request_id = 2").first().message
    assert views.error_json(r).filter("body IS NOT NULL").count() == 4


def log(spark, rows):
    return spark.createDataFrame(rows, "shard int, seq int, op string, key string, bytes long")


def test_byte_lru(spark):
    put = lambda n, k, b: (0, n, "put", k, b)
    got = caches.replay_bytes_lru(log(spark, [put(1, "a", 400), put(2, "b", 400), put(3, "c", 400)]), 1000).orderBy("seq").collect()
    assert [r.evicted for r in got] == [[], [], ["a"]]
    rows = [put(1, "a", 500), put(2, "b", 500), put(3, "c", 500), (0, 4, "get", "a", 0), put(5, "d", 500)]
    got = caches.replay_bytes_lru(log(spark, rows), 1500).orderBy("seq").collect()
    assert got[3].hit and got[4].evicted == ["b"]
    got = caches.replay_bytes_lru(log(spark, [put(1, "a", 10), put(2, "big", 2000)]), 1500).orderBy("seq").collect()
    assert got[1].evicted == ["a", "big"]


def test_block_fifo_and_lru(spark):
    seq = [(0, n, "get", k, 1) for n, k in enumerate("abca")]
    hits = [r.hit for r in caches.replay_block_fifo(log(spark, seq), 2).orderBy("seq").collect()]
    assert hits == [False, False, False, False]
    rnd = random.Random(3)
    rows = [(s, n, "get", rnd.choice("abcdefg"), 1) for s in range(5) for n in range(100)]
    want = []
    for s in range(5):
        cache = OrderedDict()
        for _, n, _, k, _ in rows[s * 100 : s * 100 + 100]:
            want.append((s, n, k in cache))
            cache.pop(k, None)
            cache[k] = 1
            if len(cache) > 3:
                cache.popitem(last=False)
    got = sorted((r.shard, r.seq, r.hit) for r in caches.replay_lru(log(spark, rows), 3).collect())
    assert got == want


def test_blocks(spark):
    e = spark.createDataFrame([("s", 100, 300), ("s", 0, 0)], "slide_id string, offset long, length long")
    assert requests.coalesced_reads(e, 256).count() == 2


def test_validation(spark):
    lv = spark.createDataFrame(
        [("ok", 0, 0, 7, 256, True, True), ("lzw", 0, 0, 5, 256, True, False), ("zero", 0, 0, 7, 0, False, True), ("none", 0, 0, None, 256, True, True)],
        "slide_id string, level int, ifd_index int, compression int, tile_width long, has_offsets boolean, has_jpeg_tables boolean",
    ).withColumn("tile_height", F.col("tile_width")).withColumn("has_counts", F.lit(True))
    got = {r.slide_id: (r.is_valid, [e.code for e in r.errors], len(r.warnings)) for r in validation.check_pyramids(slides(spark, ["ok", "lzw", "zero", "none", "empty"]), lv).collect()}
    assert got == {
        "ok": (True, [], 0), "lzw": (False, ["unsupported_compression"], 0), "zero": (False, ["missing_tile_tags", "invalid_tile_dimensions"], 0),
        "none": (False, ["missing_tag"], 0), "empty": (False, ["no_pyramid_levels"], 0),
    }


def test_jpeg_bytes(spark):
    tables, tile = b"\xff\xd8\xff\xdb\x00\x04\x01\x02\xff\xd9", b"\xff\xd8\xff\xda\x00\x02ab\xff\xd9"
    whole = b"\xff\xd8\xff\xdb\x00\x04\x01\x02\xff\xda\x00\x02ab\xff\xd9"
    assert jpeg.abbreviated(tile) and not jpeg.abbreviated(whole) and not jpeg.abbreviated(b"") and not jpeg.abbreviated(b"\xff\xd8")
    frame = b"\xff\xd8\xff\xc0\x00\x0b\x08\x01\x00\x02\x00\x01"
    assert jpeg.size_of(frame) == (512, 256)
    rows = [(1, tables, tile), (2, None, tile), (3, tables, whole), (4, tables, b""), (5, b"", tile), (6, tables, b"\xff\xd8\x0f\xfd\xb0")]
    df = spark.createDataFrame([(i, bytearray(t) if t is not None else None, bytearray(d)) for i, t, d in rows], "i int, t binary, d binary")
    got = {r.i: bytes(r.p) for r in df.select("i", jpeg.prepared(F.col("t"), F.col("d")).alias("p")).collect()}
    assert got == {1: whole, 2: tile, 3: whole, 4: b"", 5: tile, 6: b"\xff\xd8\x0f\xfd\xb0"}
    kinds = spark.createDataFrame([(bytearray(x),) for x in (tile, b"\xff\x4f\xff\x51", b"\0\0\0\x0cjP  \r\n\x87\n", b"no")], "d binary")
    assert [r[0] for r in kinds.select(jpeg.tile_format(F.col("d"))).collect()] == ["jpeg", "j2k", "jp2", None]


def test_pixels():
    level = np.arange(40 * 60 * 3, dtype=np.uint32).astype(np.uint8).reshape(40, 60, 3)
    padded = np.zeros((64, 64, 3), np.uint8)
    padded[:40, :60] = level
    pieces = [(x, y, padded[y * 32 : y * 32 + 32, x * 32 : x * 32 + 32]) for y in range(2) for x in range(2)]
    assert (tiles.composite(pieces, 60, 40, 32, 32) == level).all()
    flat = np.full((40, 60, 3), 77, np.uint8)
    assert tiles.lanczos(flat, 30, 20).shape == (20, 30, 3) and (tiles.lanczos(flat, 90, 70) == 77).all()
    assert (tiles.lanczos(level, 60, 40) == level).all()


def test_resize_equals_dense_weights():
    """Every output as the weighted sum over all inputs."""
    rng = np.random.default_rng(0)

    def dense(n, m):
        scale, centre = max(1.0, n / m), (np.arange(m) + 0.5) * n / m - 0.5
        x = (np.arange(n)[None, :] - centre[:, None]) / scale
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    for h, w, height, width in ((40, 60, 13, 7), (40, 60, 1, 1), (5, 3, 50, 31), (1, 1, 4, 4), (97, 64, 97, 20)):
        image = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        want = np.einsum("hn,nwc->hwc", dense(h, height), image.astype(float))
        want = np.clip(np.rint(np.einsum("wn,hnc->hwc", dense(w, width), want)), 0, 255)
        assert np.abs(tiles.lanczos(image, width, height) - want).max() <= 1


def test_undecodable_tiles_are_rows(spark):
    df = spark.createDataFrame([("s", bytearray(b"junk"), 80)], "slide_id string, data binary, quality int")
    assert tiles.transcode(df).first().error == "decode_error"


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t, "s", 0, 1, 1, 80), (t, "s", 0, 1, 1, 80), (t + datetime.timedelta(minutes=6), "s", 0, 2, 1, 80)]
    schema = "ts timestamp, slide_id string, level int, tile_x long, tile_y long, quality int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    for name, f in (("unique_requests", request_log.collapsed), ("counted", request_log.windowed)):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        q = f(source).writeStream.format("memory").queryName(name).outputMode("append" if name == "unique_requests" else "complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("unique_requests").count() == 2
    assert sorted(r.requests for r in spark.table("counted").collect()) == [1, 2]


def test_views(spark):
    lv = spark.createDataFrame([("a<b", 0, 100, 50, 256, 256, 1, 1, 1.0)], "slide_id string, level int, width long, height long, tile_width long, tile_height long, tiles_x long, tiles_y long, downsample double")
    assert '"level_count":1' in views.metadata_json(lv).first().body
    assert "a&lt;b" in views.viewer_pages(lv).first().body and 'Width="100"' in views.dzi_descriptors(lv).first().body
    assert views.health(spark).first().status == "healthy"


def test_settings():
    assert config.parse_bucket("s3://b/x/y") == ("b", "x/y") and config.parse_bucket("b") == ("b", "")
    with pytest.raises(ValueError):
        config.parse_bucket("http://b/x")
    with pytest.raises(ValueError):
        config.Settings("b", quality=0)
    assert config.Settings("b", endpoint="http://e").spark_options()["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_report_and_headers(spark):
    s = spark.createDataFrame([("a", "Aperio SVS", None), ("b", None, "invalid_magic"), ("c", "Aperio SVS", None)], "slide_id string, format string, error string")
    p = spark.createDataFrame([("a", True), ("c", False)], "slide_id string, is_valid boolean")
    assert {(r.format, r.outcome): r.slides for r in views.check(s, p).collect()} == {("Aperio SVS", "ok"): 1, ("unknown", "invalid_magic"): 1, ("Aperio SVS", "unsupported_format"): 1}
    plan = spark.createDataFrame([(10, 64, True), (100, 100, False)], "max_size long, size long, clamped boolean")
    assert [(r.requested_size, r.actual_size) for r in views.thumbnail_headers(plan).collect()] == [(10, 64), (None, None)]
    assert caches.cache_stats(spark.createDataFrame([(3,), (4,)], "length long")).first().asDict() == {"size": 7, "entries": 2}


def test_extents_of_all_levels(spark):
    from tilequery.plans import driver_queries

    d = "/root/testdata/sf0.001"
    wanted = {r.request_id: r for r in driver_queries.q07_resolve_requests(spark, d).collect()}
    rows = driver_queries.q36_tile_extents_all_levels(spark, d).collect()
    assert len(rows) == len(wanted) and {wanted[r.request_id].level for r in rows if r.offset is not None} >= {0, 1}
    for r in rows:
        i = wanted[r.request_id].tile_index
        assert (r.status, r.offset, r.length) == ((200, 1000 + i * 4096, 100 + i % 977) if i is not None else (wanted[r.request_id].status, None, None))
