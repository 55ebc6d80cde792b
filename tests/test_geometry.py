import pytest
from pyspark.sql import functions as F

from tilequery.functions import geometry as g
from tilequery.functions import text
from tilequery.operators import pyramid


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def L(n):
    return F.lit(n).cast("long")


@pytest.mark.parametrize("x,y,want", [(0, 0, 0), (1, 0, 1), (0, 1, 4), (3, 2, 11), (4, 0, None), (0, 3, None)])
def test_tile_index(spark, x, y, want):
    assert one(spark, g.tile_index(L(x), L(y), L(4), L(3))) == want


@pytest.mark.parametrize("x,y,want", [(0, 0, (256, 256)), (3, 0, (232, 256)), (0, 2, (256, 188)), (3, 2, (232, 188)), (4, 0, (None, 256))])
def test_edge_tiles(spark, x, y, want):
    assert (one(spark, g.tile_side(L(x), L(256), L(1000))), one(spark, g.tile_side(L(y), L(256), L(700)))) == want


@pytest.mark.parametrize("d,k,want", [(1.0, 0, True), (1.05, 0, True), (2.0, 1, True), (4.0, 2, True), (2.1, 1, True), (3.9, 2, True), (2.0, 0, False), (1.5, 1, False), (3.0, 2, False)])
def test_downsample(spark, d, k, want):
    assert one(spark, g.is_valid_downsample(F.lit(d), F.lit(k))) is want


@pytest.mark.parametrize("w,h,want", [(10000, 8000, True), (100, 100, False), (500, 500, False), (0, 0, False)])
def test_candidates(spark, w, h, want):
    assert one(spark, g.is_candidate(L(w), L(h), F.lit(True))) is want


@pytest.mark.parametrize("w,h,want", [(1, 1, 0), (2, 2, 1), (256, 256, 8), (46920, 33600, 16), (1024, 768, 10), (1000, 500, 10), (2**29, 1, 29), (2**31, 1, 31)])
def test_max_dzi_level(spark, w, h, want):
    assert one(spark, g.max_dzi_level(L(w), L(h))) == want


def test_dzi_sides(spark):
    side = lambda n, level: one(spark, g.dzi_side(L(n), F.lit(level), F.lit(7)))
    assert [(side(100, k), side(50, k)) for k in (7, 6, 0, 8)] == [(100, 50), (50, 25), (1, 1), (0, 0)]
    assert [one(spark, g.dzi_tiles(L(n), L(256))) for n in (1024, 768, 1000, 500, 100)] == [4, 3, 4, 2, 1]


@pytest.mark.parametrize("name,want", [
    ("0_0.jpg", (0, 0)), ("10_20.jpeg", (10, 20)), ("123_456", (123, 456)), ("+1_2.jpg", (1, 2)), ("invalid", None), ("0-0.jpg", None), ("a_b.jpg", None),
    ("0_0_0.jpg", None), ("4294967296_0", None), ("", None),
])
def test_coordinates(spark, name, want):
    got = one(spark, text.dzi_tile_coords(F.lit(name)))
    assert (tuple(got) if got else None) == want


def levels(spark):
    return spark.createDataFrame([("s", 0, 1.0), ("s", 1, 4.0), ("s", 2, 16.0)], "slide_id string, level int, downsample double")


def test_level_choice(spark):
    wanted = spark.createDataFrame([("s", float(d)) for d in (1, 4, 16, 2, 8, 0.5, 32)], "slide_id string, d double")
    best = {r.d: r.level for r in pyramid.best_level(levels(spark), wanted).collect()}
    assert best == {1.0: 0, 4.0: 1, 16.0: 2, 2.0: 1, 8.0: 2, 0.5: 0, 32.0: 2}
    wanted = spark.createDataFrame([("s", float(d)) for d in (1, 2, 4, 8, 16, 32)], "slide_id string, d double")
    got = {r.d: (r.level, r.scale) for r in pyramid.wsi_level(levels(spark), wanted).collect()}
    assert got == {1.0: (0, 1.0), 2.0: (0, 2.0), 4.0: (1, 1.0), 8.0: (1, 2.0), 16.0: (2, 1.0), 32.0: (2, 2.0)}


def test_build_levels_labels_and_zero_tiles(spark):
    rows = [("p", 0, 10000, 8000, 256), ("p", 1, 2500, 2000, 256), ("p", 2, 1250, 1000, 256), ("p", 3, 500, 500, 256), ("p", 4, 100, 100, 256), ("z", 0, 4096, 4096, 0)]
    ifds = spark.createDataFrame(rows, "slide_id string, ifd_index int, width long, height long, tile_width long")
    ifds = ifds.withColumn("tile_height", F.col("tile_width")).withColumn("has_tiles", F.lit(True)).withColumn("compression", F.lit(7))
    got = sorted((r.slide_id, r.level, r.ifd_index, r.downsample) for r in pyramid.build(ifds).collect())
    assert got == [("p", 0, 0, 1.0), ("p", 1, 1, 4.0), ("p", 2, 2, 8.0)]


@pytest.mark.parametrize("path,want", [("slide1.svs", True), ("a/UPPER.SVS", True), ("Mixed.Tif", True), ("m.TIFF", True), ("x.jpg", False), ("slide.svs.backup", False), ("slide_svs", False), ("", False)])
def test_slide_files(spark, path, want):
    assert one(spark, text.is_slide_file(F.lit(path))) is want


def test_descriptions(spark):
    full = "Aperio Image Library\n10000x8000 |AppMag = 40|MPP = 0.25|Filename = s.svs|StripeWidth = 2000|AppMag = 20"
    m = one(spark, text.vendor_metadata(F.lit(full)))
    assert (m.mpp, m.magnification, m.vendor, m.properties["Filename"], m.properties["AppMag"]) == (0.25, 20.0, "Aperio", "s.svs", "20")
    bad = one(spark, text.vendor_metadata(F.lit("x|MPP = invalid|AppMag = 1d")))
    assert (bad.mpp, bad.magnification, bad.vendor) == (None, None, None)
    none = one(spark, text.vendor_metadata(F.lit(None).cast("string")))
    assert (none.mpp, none.properties) == (None, {})
