"""New slides as a stream: a source that tells of files as they arrive, and a levels table that grows by them.

spark.readStream.format("slidearrivals").load(folder) has a row (slide_id, size, mtime) per slide
file, once. An offset is a listing mark: the modification time and path of the last file told. What
lies between two marks is listed anew whenever it is asked for, so a batch that is
repeated after a failure has the same files, as files don't change.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators import pyramid
from ..sources import pyramid_tiff
from ..sources.blob_sink import file_system

SCHEMA = "slide_id string, size long, mtime timestamp"
#: A file is told of when it is so many seconds old, so that none comes in behind a mark of the same moment.
SETTLE = 2.0
FILES_PER_TASK = 1024


class Arrived(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        super().__init__(files)
        self.files = files


class ArrivalsReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.settle = options["path"], float(options.get("settle", SETTLE))
        self.per_task = int(options.get("filespertask", FILES_PER_TASK))

    def _listed(self) -> list[tuple[int, str, int]]:
        """(modification time in ns, path, size) of the slide files, in order."""
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((i.mtime_ns, i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith((".svs", ".tif", ".tiff")))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        last = max((f for f in self._listed() if f[0] <= until), default=None)
        return {"time": last[0], "path": last[1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, to = (start["time"], start["path"]), (end["time"], end["path"])
        files = [(path, size, at) for at, path, size in self._listed() if after < (at, path) <= to]
        return [Arrived(files[k : k + self.per_task]) for k in range(0, len(files), self.per_task)] or [Arrived([])]

    def read(self, partition: Arrived) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for path, size, at in partition.files:
            yield path, size, datetime.fromtimestamp(at / 1e9, timezone.utc)


class SlideArrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slidearrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArrivalsReader:
        return ArrivalsReader(self.options)


def arrivals(spark: SparkSession, path: str, settle: float = SETTLE) -> DataFrame:
    """A stream of the slide files below a folder, each once, in order of their modification time.

    A file's modification time must be that of its arrival, as object stores set it: one that is copied in
    with an older time than the last mark isn't seen."""
    spark.dataSource.register(SlideArrivals)
    return spark.readStream.format("slidearrivals").option("settle", settle).load(path)


def keep_levels(stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Open the slides of a stream and add their levels and headers to a table, a folder per batch.

    A batch that is run again replaces its own folder, so no slide is there twice; known_levels() and
    known_slides() read what is there. A slide that can't be opened has its error in the latter. trigger: as of DataStreamWriter.trigger."""

    def add(batch: DataFrame, number: int) -> None:
        files = batch.select("slide_id", "size").persist()
        for name, rows in (("levels", pyramid.build(pyramid_tiff.scan(files))), ("slides", pyramid_tiff.scan(files, "slides"))):
            rows.write.mode("overwrite").parquet(f"{table.rstrip('/')}/{name}/batch={number}")
        files.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def known_levels(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table.rstrip('/')}/levels").drop("batch")


def known_slides(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table.rstrip('/')}/slides").drop("batch")
