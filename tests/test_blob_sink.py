import os

import pytest
from pyspark.sql import functions as F

from tilequery.sources import blob_sink


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def published(folder):
    """Without what a task leaves that was running when its job was aborted."""
    return [f for f in files(folder) if "_attempts/" not in f]


def tiles(spark, n, parts=4):
    rows = spark.range(n).repartition(parts, "id")
    name = F.concat(F.lit("s"), (F.col("id") % 3).cast("string"), F.lit("/0/"), F.col("id").cast("string"), F.lit("_0.jpg"))
    return rows.select("id", name.alias("name"), F.encode(F.repeat(F.col("id").cast("string"), F.lit(50)), "utf-8").alias("data"), F.col("id").cast("string").alias("note"))


def test_tile_folder_and_read_back(spark, tmp_path):
    path = str(tmp_path / "tiles")
    want = tiles(spark, 40)
    blob_sink.write_blobs(want, path)
    assert len(files(path)) == 41 and not os.path.exists(f"{path}/_attempts")
    got = blob_sink.read_blobs(blob_sink.blobs(spark, path), path, most_bytes=200)
    both = got.join(want.select("name", F.col("data").alias("w")), "name")
    assert both.filter("data = w AND error IS NULL AND size = octet_length(w) AND name LIKE concat('%/', note, '_0.jpg')").count() == 40
    # a second job adds, a repeated name is refused as a whole
    blob_sink.write_blobs(spark.createDataFrame([("more/x", b"1"), ("more/y", None)], "name string, data binary"), path)
    assert blob_sink.blobs(spark, path).count() == 42 and {r.size for r in blob_sink.blobs(spark, path).filter("name LIKE 'more%'").collect()} == {0, 1}
    before = files(path)
    for bad in ([("more/x", b"2")], [("new", b"1"), ("new", b"2")]):
        with pytest.raises(Exception, match="written before|same name"):
            blob_sink.write_blobs(spark.createDataFrame(bad, "name string, data binary"), path)
    assert files(path) == before and not os.path.exists(f"{path}/_attempts")


def test_overwrite_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    blob_sink.write_blobs(tiles(spark, 5), path)
    blob_sink.write_blobs(tiles(spark, 3), path, overwrite=True)
    assert len(files(tmp_path / "out")) == 4 and blob_sink.blobs(spark, path).count() == 3
    blob_sink.write_blobs(tiles(spark, 0), path, overwrite=True)
    assert blob_sink.blobs(spark, path).count() == 0 and len(files(tmp_path / "out")) == 1


@pytest.mark.parametrize("name", ["../x", "/x", "a/../../x", "", None, "_attempts/x", "manifests/x", "a//b"])
def test_names_stay_below_the_path(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a name"):
        blob_sink.write_blobs(spark.createDataFrame([("fine", b"1"), (name, b"1")], "name string, data binary"), str(tmp_path / "p"))
    assert published(tmp_path) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    bad = F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("data"))
    with pytest.raises(Exception, match="broken"):
        blob_sink.write_blobs(tiles(spark, 40).withColumn("data", bad), path)
    assert published(tmp_path) == []


def test_an_attempt_that_fails_leaves_nothing(tmp_path):
    import pyarrow as pa

    writer = blob_sink.BlobWriter(str(tmp_path / "p"), ["name", "data"], False)
    batch = lambda *names: pa.record_batch({"name": pa.array(names), "data": pa.array([b"12"] * len(names))})

    def broken():
        yield batch("a", "b")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    assert files(tmp_path) == []
    lost = writer.write(iter([batch("a")]))  # its executor is lost before it can tell
    good = writer.write(iter([batch("a", "c")]))
    assert lost.folder != good.folder
    writer.commit([good, None])
    assert [f for f in files(tmp_path / "p") if not f.startswith("manifests")] == ["a", "c"]


def test_missing_and_short_files(spark, tmp_path):
    path = str(tmp_path / "p")
    blob_sink.write_blobs(tiles(spark, 4, 1), path)
    os.remove(f"{path}/s0/0/0_0.jpg")
    with open(f"{path}/s1/0/1_0.jpg", "wb") as f:
        f.write(b"1")
    got = {r.note: r.error for r in blob_sink.read_blobs(blob_sink.blobs(spark, path), path).collect()}
    assert got == {"0": "not_found", "1": "io_error", "2": None, "3": None}
