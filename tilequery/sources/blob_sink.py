"""A sink for bytes: df.write.format("blobs").mode("append").save(path), a file for each row.

Rows are (name string, data binary, note string; the note may be left out): a tile of a
folder tree, or a whole container. Writing has two phases. A task writes below a folder of
its own attempt, so that attempts never share a file; what a failed attempt has
written it deletes, and what a lost executor left is deleted at the commit (a task that still
runs when its job is aborted can leave its folder, which nothing reads). The commit
gives the files their names and then writes a manifest, which is what readers go by: blobs(spark, path).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ATTEMPTS, MANIFESTS = "_attempts", "manifests"
#: Renames at a time of the commit.
RENAMES = 32


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[tuple[str, int, str | None]]  # name, bytes, note


def file_system(path: str):
    """(file system, path in it) of a URI or local path, as pyarrow opens them."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def checked(name: str | None) -> str:
    """A name stays below the folder it is written to."""
    if not name or name.startswith("/") or ".." in name.split("/") or name.split("/")[0] in (ATTEMPTS, MANIFESTS) or name != posixpath.normpath(name):
        raise ValueError(f"not a name of a file below the path: {name!r}")
    return name


class BlobWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite, self.job = path.rstrip("/"), columns, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        folder = f"{root}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        files, made = [], set()
        try:
            for batch in iterator:
                own = dict(zip(batch.schema.names, batch.columns))
                for k in range(batch.num_rows):
                    name, data = checked(own["name"][k].as_py()), own["data"][k]
                    if (parent := posixpath.dirname(f"{folder}/{name}")) not in made:
                        system.create_dir(parent)
                        made.add(parent)
                    body = data.as_buffer() if data.is_valid else pa.py_buffer(b"")
                    with system.open_output_stream(f"{folder}/{name}") as f:
                        f.write(body)
                    files.append((name, len(body), own["note"][k].as_py() if "note" in own else None))
        except BaseException:
            _delete(system, folder)
            raise
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        import pyarrow.parquet as pq

        system, root = file_system(self.path)
        whole = [(m.folder, *f) for m in messages if m for f in m.files]
        names = [f[1] for f in whole]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name: " + next(n for k, n in enumerate(sorted(names)) if k and n == sorted(names)[k - 1]))
        before = [i.path for i in _list(system, f"{root}/{MANIFESTS}")]
        old = {n for p in before for n in pq.read_table(p, filesystem=system, columns=["name"]).column(0).to_pylist()} if before else set()
        if not self.overwrite and (twice := old & set(names)):
            self.abort(messages)
            raise ValueError(f"written before: {min(twice)}")
        for parent in {posixpath.dirname(f"{root}/{n}") for n in names}:
            system.create_dir(parent)
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: system.move(f"{f[0]}/{f[1]}", f"{root}/{f[1]}"), whole))
        system.create_dir(f"{root}/{MANIFESTS}")
        listed = pa.table({"name": pa.array(names, pa.string()), "size": pa.array([f[2] for f in whole], pa.int64()), "note": pa.array([f[3] for f in whole], pa.string())})
        waiting = f"{root}/{ATTEMPTS}/{self.job}.parquet"
        system.create_dir(f"{root}/{ATTEMPTS}")
        pq.write_table(listed, waiting, filesystem=system)
        system.move(waiting, f"{root}/{MANIFESTS}/{self.job}.parquet")
        if self.overwrite:
            for p in before:
                system.delete_file(p)
            for n in old - set(names):
                system.delete_file(f"{root}/{n}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        self._clear(system, root)

    def _clear(self, system, root: str) -> None:
        """Everything that attempts of this job left; the folder of attempts goes with the last job's."""
        _delete(system, f"{root}/{ATTEMPTS}/{self.job}")
        if not _list(system, f"{root}/{ATTEMPTS}"):
            _delete(system, f"{root}/{ATTEMPTS}")


def _list(system, folder: str) -> list:
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def _delete(system, folder: str) -> None:
    from pyarrow import fs

    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


class Blobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "name string, data binary, note string"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds.get("name") != "string" or kinds.get("data") != "binary" or kinds.get("note", "string") != "string":
            raise ValueError(f"rows must be (name string, data binary[, note string]), not {kinds}")
        return BlobWriter(self.options["path"], list(kinds), overwrite)


def write_blobs(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (name, data[, note]); a name that was written before is an error unless all is overwritten.

    A null data is an empty file, no rows give an empty manifest; other columns are ignored. A task holds one batch of rows."""
    rows.sparkSession.dataSource.register(Blobs)
    own = rows.select(*[c for c in ("name", "data", "note") if c in rows.columns])
    own.write.format("blobs").mode("overwrite" if overwrite else "append").save(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, note) of all files that were committed below the path."""
    return spark.read.schema("name string, size long, note string").parquet(f"{path.rstrip('/')}/{MANIFESTS}")


def read_blobs(files: DataFrame, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Add data, the bytes of files (name, size, ...), and error (not_found, or io_error where fewer bytes are there).

    Rows go on in groups of about most_bytes, a larger file alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, held, data, errors = 0, 0, [], []
            for k, (name, size) in enumerate(zip(names, sizes)):
                if held and held + size > most_bytes:
                    yield _with_data(batch.slice(start, k - start), data, errors)
                    start, held, data, errors = k, 0, [], []
                try:
                    with system.open_input_file(f"{root}/{checked(name)}") as f:
                        body = f.read()
                    good = len(body) == size
                    data.append(body if good else None), errors.append(None if good else "io_error")
                except FileNotFoundError:
                    data.append(None), errors.append("not_found")
                except OSError:
                    data.append(None), errors.append("io_error")
                held += size
            if data:
                yield _with_data(batch.slice(start), data, errors)

    rest = [c for c in files.columns if c not in ("name", "size", "data", "error")]
    kinds = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("name", "size", *rest)) + ", data binary, error string"
    return files.select("name", "size", *rest).mapInArrow(run, schema)


def _with_data(batch: pa.RecordBatch, data: list, errors: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, "data", "error"])
