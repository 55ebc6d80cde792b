import struct

import pytest
from pyspark.sql import functions as F

from tilequery.functions import text
from tilequery.operators import pyramid, requests, service, tiles, validation
from tilequery.sources import pyramid_tiff, tiff

TILE = b"\xff\xd8\xff\xda\x00\x02ab\xff\xd9"
TABLES = b"\xff\xd8\xff\xdb\x00\x04\x01\x02\xff\xd9"


def build(order="<", big=False, compression=7, tables=False, description=None, strips=False, images=((2048, 1536),)):
    """A file whose directories share one tile at offset 8000."""
    slot, count_kind, number = (8, "Q", "Q") if big else (4, "H", "I")
    values, at = bytearray(), 20_000

    def entry(tag, kind, items):
        nonlocal values
        fmt = {2: "B", 3: "H", 4: "I", 7: "B", 16: "Q"}[kind]
        raw = struct.pack(f"{order}{len(items)}{fmt}", *items)
        head = struct.pack(order + "HH" + number, tag, kind, len(items))
        if len(raw) <= slot:
            return head + raw.ljust(slot, b"\0")
        where = at + len(values)
        values += raw
        return head + struct.pack(order + number, where)

    directories, place = [], 16 if big else 8
    for k, (w, h) in enumerate(images):
        e = [entry(256, 4, [w]), entry(257, 4, [h]), entry(258, 3, [8]), entry(259, 3, [compression])]
        if description and k == 0:
            e.append(entry(270, 2, description.encode() + b"\0"))
        if strips:
            e += [entry(273, 4, [8000]), entry(278, 4, [h]), entry(279, 4, [len(TILE)])]
        else:
            n = -(-w // 256) * -(-h // 256)
            e += [entry(322, 4, [256]), entry(323, 4, [256]), entry(324, 16 if big else 4, [8000] * n), entry(325, 4, [len(TILE)] * n)]
            if tables:
                e.append(entry(347, 7, list(TABLES)))
        size = struct.calcsize("<" + count_kind) + sum(map(len, e)) + slot
        following = place + size if k < len(images) - 1 else 0
        directories.append(struct.pack(order + count_kind, len(e)) + b"".join(e) + struct.pack(order + number, following))
        place += size
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    out = (head + b"".join(directories)).ljust(8000, b"\0") + TILE
    return out.ljust(at, b"\0") + bytes(values)


FILES = {
    "le.tif": {}, "be.tif": {"order": ">"}, "big.tiff": {"big": True}, "lzw.tif": {"compression": 5}, "strip.tif": {"strips": True}, "tab.tif": {"tables": True},
    "full.svs": {"tables": True, "description": "Aperio Image\n2048x1536|MPP = 0.25|AppMag = 40"},
    "pyr.tif": {"images": ((10000, 8000), (2500, 2000), (1250, 1000), (500, 500), (100, 100))},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("slides")
    for name, options in FILES.items():
        (d / name).write_bytes(build(**options))
    (d / "short.tif").write_bytes(b"II*")
    (d / "bad.tif").write_bytes(b"PK" + b"\0" * 40)
    (d / "notes.txt").write_text("no slide")
    return d


def named(df):
    return df.withColumn("name", F.substring_index("slide_id", "/", -1))


def test_slides(spark, folder):
    got = {r.name: r for r in named(pyramid_tiff.read(spark, str(folder), "slides")).collect()}
    assert set(got) == set(FILES) | {"short.tif", "bad.tif"}
    assert got["full.svs"].format == "Aperio SVS" and got["le.tif"].format == "Generic Pyramidal TIFF"
    assert (got["be.tif"].byte_order, got["big.tiff"].is_bigtiff, got["short.tif"].error, got["bad.tif"].error) == ("MM", True, "file_too_small", "invalid_magic")


def test_pyramids_from_files(spark, folder):
    ifds = pyramid_tiff.read(spark, str(folder))
    lv = named(pyramid.build(ifds)).cache()
    got = {(r.name, r.level): (r.width, r.tiles_x, r.tile_count, r.downsample) for r in lv.collect()}
    for name in ("le.tif", "be.tif", "big.tiff", "lzw.tif", "tab.tif", "full.svs"):
        assert got[name, 0] == (2048, 8, 48, 1.0)
    assert [got["pyr.tif", k][3] for k in range(3)] == [1.0, 4.0, 8.0] and ("pyr.tif", 3) not in got and ("strip.tif", 0) not in got
    found = named(validation.check_pyramids(pyramid_tiff.read(spark, str(folder), "slides").filter("error IS NULL"), lv))
    codes = {r.name: [e.code for e in r.errors] for r in found.collect()}
    assert codes["lzw.tif"] == ["unsupported_compression"] and codes["strip.tif"] == ["no_pyramid_levels"] and codes["le.tif"] == []
    strips = named(validation.check_ifds(ifds)).filter("name = 'strip.tif'").first()
    assert [e.code for e in strips.errors] == ["strip_organization"]


def test_entries_pivot_as_directories(spark, folder):
    entries = pyramid_tiff.read(spark, str(folder), "entries")
    a = {(r.slide_id, r.ifd_index): (r.width, r.tile_width, r.compression) for r in pyramid.pivot_tags(entries).collect()}
    b = {(r.slide_id, r.ifd_index): (r.width, r.tile_width, r.compression) for r in pyramid_tiff.read(spark, str(folder)).collect()}
    assert a == b


def test_tile_bytes(spark, folder):
    path = str(folder / "tab.tif")
    lv = pyramid.build(pyramid_tiff.read(spark, path))
    arrays = pyramid_tiff.read(spark, path, "arrays").join(lv.select("slide_id", "ifd_index", "level", "tiles_x"), ["slide_id", "ifd_index"])
    wanted = spark.createDataFrame([(1, path, 0, 7, 5, 80), (2, path, 0, 8, 0, 80)], "request_id long, slide_id string, level int, tile_x long, tile_y long, quality int")
    located = requests.locate(requests.resolve(wanted, lv), pyramid.tile_extents(arrays))
    got = {r.request_id: (r.error, bytes(r.data) if r.data else None) for r in tiles.fetch(located.filter("error IS NULL").drop("error")).collect()}
    assert got == {1: (None, TILE)}
    assert bytes(arrays.first().jpeg_tables) == TABLES


def test_filter_prunes_files(spark, folder):
    reader = pyramid_tiff.PyramidTiffReader({"path": str(folder), "filespertask": "1"})
    assert len(reader.partitions()) == 10
    df = pyramid_tiff.read(spark, str(folder)).filter(F.col("slide_id") == str(folder / "le.tif"))
    assert df.count() == 1 and df.rdd.getNumPartitions() == 1


def test_values():
    data = build(description="Aperio")
    read = lambda o, n: data[o : o + n]
    h = tiff.read_header(read, len(data))
    own = tiff.by_tag(next(tiff.directories(read, h)))
    assert own[324].numbers(h, read) == [8000] * 48 and own[258].inline_number(h) == 8 and tiff.text(b"ab\0c") == "ab"
    loop = bytearray(data)
    n = struct.unpack("<H", data[8:10])[0]
    loop[10 + 12 * n : 14 + 12 * n] = struct.pack("<I", 8)  # a chain that never ends
    assert sum(1 for _ in tiff.directories(lambda o, k: bytes(loop[o : o + k]), h)) == tiff.MAX_IFDS
    with pytest.raises(tiff.TiffError):
        tiff.read_header(lambda o, k: b"II\x63\0\0\0\0\0"[o : o + k], 8)


def tables_of(spark, folder):
    lv = pyramid.build(pyramid_tiff.read(spark, str(folder)))
    return service.open_slides(spark, str(folder)), lv, pyramid_tiff.read(spark, str(folder), "arrays")


def test_open_slides(spark, folder):
    got = {r.name: r for r in named(service.open_slides(spark, str(folder))).collect()}
    assert set(got) == set(FILES) | {"short.tif", "bad.tif"}
    assert {n for n, r in got.items() if r.error is None} == {"le.tif", "be.tif", "big.tiff", "tab.tif", "full.svs", "pyr.tif"}
    assert (got["lzw.tif"].error, got["strip.tif"].error, got["short.tif"].error) == ("unsupported_format", "unsupported_format", "file_too_small")
    svs = got["full.svs"]
    assert (svs.vendor.mpp, svs.vendor.magnification, svs.width, svs.height, svs.level_count) == (0.25, 40.0, 2048, 1536, 1)
    assert got["le.tif"].warnings and got["le.tif"].vendor.mpp is None and [lv.level for lv in got["pyr.tif"].levels] == [0, 1, 2]


def test_get_tiles(spark, folder):
    """Statuses in the order of the checks, extents, repaired bytes, equal requests, and files that are gone."""
    at = lambda name: str(folder / name)
    gone, cut = folder / "gone.tif", folder / "cut.tif"
    gone.write_bytes(build())
    cut.write_bytes(build())
    tables = [t.cache() for t in tables_of(spark, folder)]
    assert all(t.count() for t in tables)
    gone.unlink()
    cut.write_bytes(build()[:8004])
    rows = [
        (1, at("tab.tif"), 0, 7, 5, 80), (2, at("tab.tif"), 0, 7, 5, 80), (3, at("tab.tif"), 0, 7, 5, None), (4, at("tab.tif"), 0, 7, 5, 90), (5, at("tab.tif"), 0, 8, 0, 80), (6, at("tab.tif"), 1, 0, 0, 80),
        (7, at("tab.tif"), 0, 0, 0, 101), (8, "/nowhere.tif", 0, 0, 0, 0), (9, "/nowhere.tif", 0, 0, 0, 50), (10, at("lzw.tif"), 0, 0, 0, 80), (11, at("strip.tif"), 0, 0, 0, 80), (12, at("bad.tif"), 9, 0, 0, 80),
        (13, at("be.tif"), 0, 1, 1, 80), (14, at("pyr.tif"), 2, 4, 3, 80), (15, at("gone.tif"), 0, 0, 0, 80), (16, at("cut.tif"), 0, 0, 0, 80), (17, at("full.svs"), 0, 0, 0, 1),
    ]
    wanted = spark.createDataFrame(rows, "request_id long, slide_id string, level int, tile_x long, tile_y long, quality int")
    got = {r.request_id: r for r in service.get_tiles(wanted, *tables, encode=False).collect()}
    repaired = TABLES[:-2] + TILE[2:]
    assert {i: (r.status, r.error) for i, r in got.items() if r.error} == {
        5: (400, "tile_out_of_bounds"), 6: (400, "invalid_level"), 7: (400, "invalid_quality"), 8: (400, "invalid_quality"), 9: (404, "not_found"), 10: (415, "unsupported_format"),
        11: (415, "unsupported_format"), 12: (415, "unsupported_format"), 15: (404, "not_found"), 16: (500, "io_error"),
    }
    assert all(bytes(got[i].data) == repaired and (got[i].offset, got[i].length) == (8000, len(TILE)) for i in (1, 2, 3, 4, 17)) and all(bytes(got[i].data) == TILE for i in (13, 14))
    assert {i for i, r in got.items() if r.cache_hit} == {2, 3} and len(got) == len(rows) and got[3].quality == 80
    assert all(r.data is None for r in got.values() if r.error)
    coded = {r.request_id: r.error for r in service.get_tiles(wanted.filter("request_id IN (1, 5, 15)"), *tables).collect()}
    slides, lv, arrays = tables
    lost = service.get_tiles(wanted.filter("request_id = 16"), slides, lv, pyramid_tiff.read(spark, str(cut), "arrays"), encode=False).collect()
    assert [(r.status, r.error, r.data) for r in lost] == [(500, "io_error", None)]
    cut.unlink()
    assert (coded[5], coded[15]) == ("tile_out_of_bounds", "not_found") and (tiles.Image is not None or coded[1] == "decode_error")


def test_thumbnails_from_files(spark, folder):
    slides, lv, arrays = tables_of(spark, folder)
    wanted = named(slides).filter("name IN ('pyr.tif', 'tab.tif')").select("slide_id", F.lit(300).alias("max_size"))
    plan = requests.thumbnail_plan(wanted, lv)
    each = named(service.thumbnail_tiles(plan, lv, arrays)).collect()
    assert sorted((r.name, r.level) for r in each) == [("pyr.tif", 2)] * 20 + [("tab.tif", 0)] * 48
    assert all(bytes(r.data) == (TABLES[:-2] + TILE[2:] if r.name == "tab.tif" else TILE) for r in each)
    got = {r.name: (r.out_width, r.out_height, r.error) for r in named(tiles.thumbnails(service.thumbnail_tiles(plan, lv, arrays))).collect()}
    assert set(got) == {"pyr.tif", "tab.tif"} and got["tab.tif"][:2] == (300, 225) and (tiles.Image is not None or got["tab.tif"][2] == "decode_error")


def test_scan_of_listed_files(spark, folder):
    files = spark.createDataFrame([(str(folder / n), (folder / n).stat().st_size) for n in ("pyr.tif", "bad.tif")] + [(str(folder / "lost.tif"), 9)], "slide_id string, size long")
    for table in ("ifds", "arrays"):
        listed = sorted(map(str, pyramid_tiff.scan(files, table).collect()))
        assert listed == sorted(map(str, pyramid_tiff.read(spark, str(folder), table).filter(F.col("slide_id") == str(folder / "pyr.tif")).collect())) and listed
    assert {r.name: r.error for r in named(pyramid_tiff.scan(files, "slides")).collect()} == {"pyr.tif": None, "bad.tif": "invalid_magic", "lost.tif": "not_found"}


def test_tiff_header(spark):
    rows = [b"II*\0\x08\0\0\0", b"MM\0*\0\0\0\x08", b"II+\0\x08\0\0\0", b"MM\0+\0\0\0\x08", b"II*\0", b"MM*\0\0\0\0\0", b"PK\x03\x04aaaa", b""]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, data binary")
    assert [r[0] for r in df.orderBy("i").select(text.is_tiff_header(F.col("data"))).collect()] == [True] * 4 + [False] * 4
