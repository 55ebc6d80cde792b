import os
import time

from test_source import build

from tilequery.operators import pyramid
from tilequery.sources import pyramid_tiff
from tilequery.streaming import arrivals

IMAGES = {"images": ((10000, 8000), (2500, 2000), (1250, 1000), (500, 500))}


def put(folder, name, **options):
    (folder / "new").mkdir(exist_ok=True)
    (folder / "new" / name).write_bytes(build(**options))


def run(spark, folder, tmp_path, fail_at=None):
    stream = arrivals.arrivals(spark, str(folder), settle=0.0)
    query = arrivals.keep_levels(stream, str(tmp_path / "table"), f"file://{tmp_path}/checkpoint")
    until = time.time() + 90
    try:
        while time.time() < until:
            query.processAllAvailable()
            if query.lastProgress is not None:
                break
    finally:
        query.stop()


def names(df):
    return sorted(os.path.basename(r.slide_id) for r in df.select("slide_id").distinct().collect())


def test_two_arrivals_and_a_restart(spark, tmp_path):
    folder = tmp_path / "slides"
    folder.mkdir()
    put(folder, "a.tif", **IMAGES)
    put(folder, "b.svs")
    (folder / "note.txt").write_text("no slide")
    run(spark, folder, tmp_path)
    assert names(arrivals.known_levels(spark, str(tmp_path / "table"))) == ["a.tif", "b.svs"]
    # while no query runs more arrive, one of them unreadable
    put(folder, "0.tiff", big=True)
    (folder / "bad.tif").write_bytes(b"PK" + b"\0" * 40)
    put(folder, "z.tif", **IMAGES)
    run(spark, folder, tmp_path)
    got = arrivals.known_levels(spark, str(tmp_path / "table"))
    assert names(got) == ["0.tiff", "a.tif", "b.svs", "z.tif"]
    want = pyramid.build(pyramid_tiff.read(spark, str(folder)))
    show = lambda df: sorted((os.path.basename(r.slide_id), r.level, r.width, r.height, r.downsample) for r in df.collect())
    assert show(got) == show(want)
    slides = {os.path.basename(r.slide_id): r.error for r in arrivals.known_slides(spark, str(tmp_path / "table")).collect()}
    assert slides == {"a.tif": None, "b.svs": None, "0.tiff": None, "z.tif": None, "bad.tif": "invalid_magic"} and arrivals.known_slides(spark, str(tmp_path / "table")).count() == 5
    # nothing new: nothing changes
    run(spark, folder, tmp_path)
    assert show(arrivals.known_levels(spark, str(tmp_path / "table"))) == show(want)


def test_marks(tmp_path):
    reader = arrivals.ArrivalsReader({"path": str(tmp_path), "settle": "0", "filespertask": "2"})
    assert reader.latestOffset() == reader.initialOffset() and [p.files for p in reader.partitions(reader.initialOffset(), reader.latestOffset())] == [[]]
    for k in range(5):
        (tmp_path / f"{k}.svs").write_bytes(b"x" * k)
        os.utime(tmp_path / f"{k}.svs", ns=(10**18, 10**18 + k // 2))
    end = reader.latestOffset()
    parts = [p.files for p in reader.partitions(reader.initialOffset(), end)]
    assert [len(p) for p in parts] == [2, 2, 1] and [os.path.basename(f[0]) for p in parts for f in p] == [f"{k}.svs" for k in range(5)]
    middle = {"time": 10**18, "path": f"{tmp_path}/1.svs"}
    both = [f for a, b in ((reader.initialOffset(), middle), (middle, end)) for p in reader.partitions(a, b) for f in p.files]
    assert both == [f for p in parts for f in p]
    slow = arrivals.ArrivalsReader({"path": str(tmp_path), "settle": "1e9"})
    assert slow.latestOffset()["time"] < 10**18 + 2
