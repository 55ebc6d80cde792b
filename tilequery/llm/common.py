"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a null id wherever a key must be compared.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, as in tests, a session on one machine gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tilequery_")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_PATHS: ContextVar[list[str] | None] = ContextVar("tables written by cut()", default=None)


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths that cut() writes within this block and that are still there, in order. Each thread has blocks of its own."""
    paths: list[str] = []
    token = _PATHS.set(paths)
    try:
        yield paths
    finally:
        _PATHS.reset(token)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there,
    a lost executor costs no recomputation of what lies before, and nothing is stored
    on one machine only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilequery/{name}-{uuid.uuid4().hex}"
    # shuffle files of this write are of no use after it
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tilequery_path = path
    if (paths := _PATHS.get()) is not None:
        paths.append(path)
    return out


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in (_PATHS.get() or ()):
            _PATHS.get().remove(name)


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables written by cut() that nothing lazy refers to any more."""
    for df in frames:
        drop_paths(df.sparkSession, [df._tilequery_path])


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a null-free Arrow string or binary array, without a copy of the bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about most_bytes of text (a longer single text is a run of its own)."""
    if batch.num_rows == 0:
        return
    _, offsets = string_buffers(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte value."""
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


#: Odd, hence invertible modulo 2**64.
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of many texts at once, each with a 64-bit content hash.

    White space is bytes 9-13 and 32. A word's hash is taken of its bytes (ASCII
    letters folded to lower case if asked for) by a polynomial over prefix sums.
    """

    _cache: dict[str, np.ndarray] = {}
    #: Powers for texts of so many bytes are kept from call to call.
    _KEPT = 1 << 21

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: bool = True, closing: np.ndarray | None = None) -> None:
        cache = self._cache
        if not cache:
            cache["values"] = byte_values()
            lower = np.arange(256)
            lower[65:91] += 32
            cache["folded"] = cache["values"][lower]
            space = np.zeros(256, bool)
            space[[9, 10, 11, 12, 13, 32]] = True
            cache["space"] = space
        n = len(raw)
        up, down = cache.get("up", ()), cache.get("down", ())
        if len(up) < n + 1:
            up, down = powers(BASE, n + 1), powers(BASE_INVERSE, n + 1)
            if n <= self._KEPT:  # a worker lives on after a long text
                cache["up"], cache["down"] = up, down
        is_word = ~cache["space"][raw]
        # a word ends where its text ends
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        starts = np.flatnonzero(is_word & (~before | first[:n]))
        last = np.zeros(n + 1, bool)
        last[offsets[1:]] = True
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        ends = np.flatnonzero(is_word & (~after | last[1:])) + 1
        if closing is not None:  # such a last byte of a longer word is not part of it
            ends = ends - ((ends - starts > 1) & closing[raw[ends - 1]])
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(cache["folded" if fold else "values"][raw] * up[:n], out=prefix[1:])
        self.starts, self.ends = starts, ends
        self.hash = mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        #: index of each text's first word; one more entry closes the last text
        self.first = np.searchsorted(starts, offsets)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text index) of every window of k words; a text of 1 to k-1 words is one shingle of all its words."""
        counts = np.diff(self.first)
        texts = np.repeat(np.arange(len(counts)), counts)
        position = np.arange(len(self.hash)) - self.first[:-1][texts] if len(texts) else np.zeros(0, np.int64)
        left = counts[texts] - position  # words from here on
        n = len(self.hash)
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        total = np.zeros(n, np.uint64)
        for i in range(k):
            part = padded[i : i + n] * np.uint64(pow(BASE, i + 1, 2**64))
            total = total + np.where(left > i, part, np.uint64(0))
        keep = (left >= k) | ((position == 0) & (left > 0))
        return mix64(total[keep]), texts[keep]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of one text."""
    flags = np.zeros(len(raw) + 2, np.int8)
    flags[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    step = np.diff(flags)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_values(raw: np.ndarray, offsets: np.ndarray, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text); case counts. A text beyond `block` bytes is hashed block by block."""
    if len(offsets) != 2 or len(raw) <= block:
        words = Words(raw, offsets, fold=False)
        return words.hash, words.first
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros(0, np.uint64), np.array([0, 0])
    parts, values, at = [], byte_values(), 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + block, "right")), at + 1)
        own = raw[starts[at] : ends[to - 1]]
        if len(own) <= block:
            parts.append(Words(own, np.array([0, len(own)]), fold=False).hash)
        else:  # one word longer than a block
            total, step = np.zeros(1, np.uint64), np.uint64(pow(BASE, block, 1 << 64))
            for lo in range((len(own) - 1) // block * block, -1, -block):
                piece = own[lo : lo + block]
                total = total * step + (values[piece] * powers(BASE, len(piece))).sum()
            parts.append(mix64(total + np.uint64(len(own))))
        at = to
    return np.concatenate(parts), np.array([0, len(starts)])
