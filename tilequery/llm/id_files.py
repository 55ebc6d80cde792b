"""Operator 11: token ids in files of range-coded blocks.

Documents are dealt by ranges of their ids, tokenised and written in ascending order through the
library's sink for bytes, which publishes the files of the attempts that counted and a manifest of them. A file is a row
of segments, little-endian throughout:

    "TQIDS1\\0\\0"; n_docs, n_ids, bytes of the code: 64 bits; ids a block, blocks, distinct ids, bytes of the two packed parts: 32 bits
    packed documents: doc_id (64 bits each), null marks (1 bit each), number of ids (64 bits each)
    packed ids: the distinct ids in ascending order, then their counts (32 bits each), the order-0 predictions
    blocks: bytes of the code, CRC-32 of the code, CRC-32 of the ids (32 bits each)
    CRC-32 of all so far; then the blocks' codes (mixing_coder), every block from a fresh state

Packed parts are compressed by zlib.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.blob_sink import blobs, read_blobs, write_blobs
from . import mixing_coder
from .common import cut, drop_paths, shared_dir, table, text_of
from .packing import ByteEncoder, single_spaced

MAGIC, HEAD = b"TQIDS2\0\0", struct.Struct("<8sQQQIIIII")
#: Ids from which a segment, and segments from which a file is closed (after a whole document).
SEGMENT_IDS, FILE_SEGMENTS = mixing_coder.BLOCK * mixing_coder.LANES, 8
#: Up to here distinct ids are found by counting, beyond by sorting.
COUNTED = 1 << 22


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, their counts, the place of every id among them)."""
    if int(ids.max()) >= COUNTED:
        own, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return own, counts, places
    counts = np.bincount(ids)
    own = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[own] = np.arange(len(own))
    return own, counts[own], place[ids]


def segment(doc_ids: list[int | None], ids: list[np.ndarray], block: int = mixing_coder.BLOCK, lanes: int = mixing_coder.LANES) -> bytes:
    """A segment of documents, each with at least one id of up to 32 bits; up to 2**24 different ids."""
    per = np.array([len(x) for x in ids], "<u8")
    whole = np.concatenate(ids)
    own, counts, places = _distinct(whole)
    shares = mixing_coder.Shares(counts)
    lengths = np.full(-(-len(whole) // block), block)
    lengths[-1] = len(whole) - block * (len(lengths) - 1)
    codes: list[bytes] = []
    for k in range(0, len(lengths), lanes):
        codes += mixing_coder.encode(places[k * block : (k + lanes) * block], lengths[k : k + lanes], shares)
    known = np.array([x is not None for x in doc_ids])
    docs = zlib.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.packbits(known).tobytes() + per.tobytes(), 1)
    counted = zlib.compress(own.astype("<u4").tobytes() + np.minimum(counts, 2**32 - 1).astype("<u4").tobytes(), 1)
    raw = whole.astype("<u4", copy=False)
    rows = [(len(c), zlib.crc32(c), zlib.crc32(raw[k * block : (k + 1) * block])) for k, c in enumerate(codes)]
    head = HEAD.pack(MAGIC, len(doc_ids), len(whole), sum(map(len, codes)), block, len(codes), len(own), len(docs), len(counted))
    head += docs + counted + np.array(rows, "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(codes)


def read_segment(raw: memoryview, lanes: int = mixing_coder.LANES) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc ids, number of ids of each, all ids, bytes of the segment); a damaged one raises ValueError with the block's number."""
    if len(raw) < HEAD.size or bytes(raw[:8]) != MAGIC:
        raise ValueError("no segment of ids begins here")
    _, n_docs, n_ids, n_code, block, n_blocks, n_own, n_packed, n_counted = HEAD.unpack(raw[: HEAD.size])
    at = HEAD.size + n_packed + n_counted + 12 * n_blocks
    if len(raw) < at + 4 + n_code or struct.unpack("<I", raw[at : at + 4])[0] != zlib.crc32(raw[:at]):
        raise ValueError("a segment's head is damaged")
    docs = zlib.decompress(raw[HEAD.size : HEAD.size + n_packed])
    counted = np.frombuffer(zlib.decompress(raw[HEAD.size + n_packed : HEAD.size + n_packed + n_counted]), "<u4")
    rows = np.frombuffer(raw, "<u4", 3 * n_blocks, at - 12 * n_blocks).reshape(-1, 3)
    known = np.unpackbits(np.frombuffer(docs, np.uint8, -(-n_docs // 8), 8 * n_docs), count=n_docs)
    doc_ids = [int(x) if ok else None for x, ok in zip(np.frombuffer(docs, "<i8", n_docs), known)]
    per = np.frombuffer(docs, "<u8", n_docs, 8 * n_docs + -(-n_docs // 8)).astype(np.int64)
    own, shares = counted[:n_own], mixing_coder.Shares(counted[n_own:])
    ends = np.cumsum(rows[:, 0].astype(np.int64)) + at + 4
    codes = [bytes(raw[e - n : e]) for e, n in zip(ends.tolist(), rows[:, 0].tolist())]
    for k, c in enumerate(codes):
        if zlib.crc32(c) != rows[k, 1]:
            raise ValueError(f"block {k} is damaged")
    lengths = np.full(n_blocks, block)
    lengths[-1] = n_ids - block * (n_blocks - 1)
    ids = np.concatenate([own[mixing_coder.decode(codes[k : k + lanes], lengths[k : k + lanes], shares)] for k in range(0, n_blocks, lanes)])
    for k in range(n_blocks):
        if zlib.crc32(ids[k * block : (k + 1) * block]) != rows[k, 2]:
            raise ValueError(f"block {k} doesn't decode to what was written")
    return doc_ids, per, ids, at + 4 + n_code


def write_ids(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
    segment_ids: int = SEGMENT_IDS, file_segments: int = FILE_SEGMENTS, block: int = mixing_coder.BLOCK,
) -> None:
    """Write the ids of every whole text, and end_id after each, in ascending order of doc_id (nulls first).

    Documents of one doc_id are in the order of their text's hash, equal ones in that of
    the input. A null or empty text is the end id alone; an empty table gives a
    manifest without files; other columns are ignored. A hot doc_id is dealt over tasks by the hash and the
    place in the input. A task holds the ids of one segment and the codes of one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = ByteEncoder.load(tokenizer_path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held, parts, counted = 0, [], 0

        def close() -> None:
            nonlocal docs, ids, held, counted
            if ids:
                parts.append(segment(docs, ids, block))
                docs, ids, held, counted = [], [], 0, counted + held

        def file() -> pa.RecordBatch:
            nonlocal parts, counted, made
            own = {"name": [f"part-{part:08d}-{made:06d}.ids"], "data": [b"".join(parts)], "note": [json.dumps({"ids": counted})]}
            parts, counted, made = [], 0, made + 1
            return pa.RecordBatch.from_pydict(own)

        for batch in batches:
            for doc, own, single in zip(batch.column(0).to_pylist(), batch.column(1), single_spaced(batch.column(1)).tolist()):
                docs.append(doc)
                encode = encoder.encode_single if single else encoder.encode
                ids.append(np.append(encode(own.as_py()), np.uint32(end_id)))
                held += len(ids[-1])
                if held >= segment_ids:
                    close()
                    if len(parts) >= file_segments:
                        yield file()
        close()
        if parts:
            yield file()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    rows = rows.select("*", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "h", "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t")
    write_blobs(dealt.mapInArrow(run, "name string, data binary, note string"), path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files that a write_ids committed; ids little-endian unsigned 32-bit, start the number of ids before.

    A file that is gone, short or damaged fails the job, with its name."""
    files = blobs(spark, path).withColumn("n", F.get_json_object("note", "$.ids").cast("long"))
    # a row for each file of some megabytes
    start = F.coalesce(F.sum("n").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("name", "size", start.alias("start"))
    n_files = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, start = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                if batch.column(4)[k].is_valid:
                    raise ValueError(f"{name}: {batch.column(4)[k]}")
                rest = memoryview(batch.column(3)[k].as_buffer())
                while len(rest):
                    try:
                        docs, per, ids, size = read_segment(rest)
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e
                    rest = rest[size:]
                    ends = np.cumsum(per)
                    first = start + ends - per
                    start += len(ids)
                    raw = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(np.append(0, 4 * ends)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first), pa.array(per), raw], names=["doc_id", "start", "n_tokens", "ids"])

    dealt = files.repartition(max(1, min(n_files, 100_000)))
    return read_blobs(dealt, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tilequery/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    out = cut(read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "id_index")
    drop_paths(spark, [path])
    return out
