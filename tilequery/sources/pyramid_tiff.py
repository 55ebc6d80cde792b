"""A Python data source for slide pyramids: spark.read.format("pyramidtiff").

Options: path (a file or a folder, local or any file system that pyarrow opens), table
(ifds, entries, arrays or slides). A task reads some files by ranges; a filter on slide_id
prunes files before tasks are made.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import tiff

SCHEMAS = {
    "slides": "slide_id string, size long, byte_order string, is_bigtiff boolean, first_ifd_offset long, format string, description string, error string, message string",
    "entries": "slide_id string, ifd_index int, entry_index int, tag_id int, field_type_raw int, count long, is_inline boolean, value_bytes binary, value long",
    "ifds": (
        "slide_id string, ifd_index int, width long, height long, tile_width long, tile_height long, compression int, has_tiles boolean, "
        "has_offsets boolean, has_counts boolean, is_tiled boolean, is_stripped boolean, has_jpeg_tables boolean"
    ),
    "arrays": "slide_id string, ifd_index int, offsets array<long>, byte_counts array<long>, jpeg_tables binary",
}
FORMATS = ("Generic Pyramidal TIFF", "Aperio SVS")
FILES_PER_TASK = 64


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]) -> None:
        super().__init__(paths)
        self.paths = paths


class PyramidTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table = options["path"], options.get("table", "ifds")
        self.per_task = int(options.get("filespertask", FILES_PER_TASK))
        self.only: set[str] | None = None

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("slide_id",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and f.attribute == ("slide_id",):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._fs()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        paths = sorted((i.path, i.size) for i in found if i.path.lower().endswith((".svs", ".tif", ".tiff")) and (self.only is None or i.path in self.only))
        return [Files(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = self._fs()
        for path, size in partition.paths if partition else ():
            with system.open_input_file(path) as f:

                def read(offset: int, length: int, f=f, size=size) -> bytes:
                    if offset + length > size:
                        raise tiff.TiffError("range_out_of_bounds", f"Range out of bounds: requested {length} bytes at offset {offset}, size is {size}")
                    return f.read_at(length, offset)

                yield from getattr(self, f"_{self.table}")(path, size, read)

    def _slides(self, path: str, size: int, read: tiff.Read) -> Iterator[tuple]:
        """A row per file; a file that can't be read has its error, and no job fails for it."""
        try:
            h = tiff.read_header(read, size)
            first = tiff.by_tag(next(tiff.directories(read, h)))
            raw = first[270].bytes(h, read, tiff.DESCRIPTION_BYTES) if 270 in first else b""
            yield path, size, "II" if h.order == "<" else "MM", h.big, h.first_ifd, FORMATS[b"Aperio" in raw], tiff.text(raw) if raw else None, None, None
        except (tiff.TiffError, StopIteration) as e:
            yield path, size, None, None, None, None, None, getattr(e, "code", "missing_tag"), str(e)

    def _each(self, path: str, size: int, read: tiff.Read):
        """(header, index, entries) of a file's directories; none of an unreadable file, whose error is in the slides table."""
        try:
            h = tiff.read_header(read, size)
            for k, entries in enumerate(tiff.directories(read, h)):
                yield h, k, entries
        except tiff.TiffError:
            return

    def _entries(self, path: str, size: int, read: tiff.Read) -> Iterator[tuple]:
        for h, k, entries in self._each(path, size, read):
            for n, e in enumerate(entries):
                yield path, k, n, e.tag_id, e.type_raw, e.count, e.inline, e.raw, e.inline_number(h)

    def _ifds(self, path: str, size: int, read: tiff.Read) -> Iterator[tuple]:
        for h, k, entries in self._each(path, size, read):
            own = tiff.by_tag(entries)
            number = lambda tag, own=own, h=h: own[tag].inline_number(h) if tag in own else None
            yield (
                path, k, number(256), number(257), number(322), number(323), number(259), 324 in own and 325 in own,
                324 in own, 325 in own, 322 in own and 323 in own, 273 in own, 347 in own,
            )

    def _arrays(self, path: str, size: int, read: tiff.Read) -> Iterator[tuple]:
        for h, k, entries in self._each(path, size, read):
            own = tiff.by_tag(entries)
            if 324 in own and 325 in own:
                try:
                    tables = own[347].bytes(h, read) if 347 in own else None
                    row = path, k, own[324].numbers(h, read), own[325].numbers(h, read), tables
                except tiff.TiffError:  # values beyond the end of the file: its tiles have no extents
                    continue
                yield row


class PyramidTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pyramidtiff"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "ifds")]

    def reader(self, schema) -> DataSourceReader:
        return PyramidTiffReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PyramidTiff)


def read(spark: SparkSession, path: str, table: str = "ifds"):
    register(spark)
    return spark.read.format("pyramidtiff").option("table", table).load(path)


def scan(files: DataFrame, table: str = "ifds") -> DataFrame:
    """The same tables of files that are listed in a DataFrame (slide_id: path, size long), however many: nothing is listed on the driver.

    Files are dealt over tasks by path. A file that is gone is, in the slides table, a row with the error not_found."""
    import pandas as pd

    columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, size in zip(frame.slide_id, frame["size"]):
                reader = PyramidTiffReader({"path": path, "table": table})
                try:
                    rows = list(reader.read(Files([(reader._fs()[1], int(size))])))
                except FileNotFoundError as e:
                    rows = [(path, int(size), None, None, None, None, None, "not_found", str(e))] if table == "slides" else []
                if rows:
                    yield pd.DataFrame([(path, *r[1:]) for r in rows], columns=columns)

    return files.select("slide_id", "size").distinct().mapInPandas(run, SCHEMAS[table])
