"""Operator 7: bounded-space online best-fit packing.

Each partition packs its own pieces, so nothing is shuffled. A fixed number of bins is
open at a time. An integer used as a bitset says for which amounts of free space there
is an open bin; its lowest set bit from the piece's length on is the best fit, its
lowest set bit of all is the fullest bin, which closes when a bin too many is open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import string_buffers, table, text_of

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"

# The pre-tokenising pattern and the special token of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
# the same pieces of texts of code points below 0x250 where white space stands alone: without the lookahead and the large
# classes, which cost a third to a half of the encoding's time
_LETTER, _NUMBER = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾"
SINGLE_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?(?:[{_LETTER}]+|[{_NUMBER}]+|[^\s{_LETTER}{_NUMBER}]+)|\s"


class ByteEncoder:
    """Ids as the tokenizers library gives them.

    The same ranks are also served by tiktoken, which is several times faster. For texts
    of Latin letters only (code points below 0x250, where a test holds the two
    libraries' character classes equal) its ids are taken; every other text goes through
    the tokenizers library itself.
    """

    _loaded: dict[str, ByteEncoder] = {}
    OTHER = re.compile("[^\x00-ɏ]")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = self._fast(PATTERN)

    @cached_property
    def single(self):
        return self._fast(SINGLE_PATTERN)

    def _fast(self, pattern: str):
        import json

        import tiktoken

        model = json.loads(self.exact.to_str())
        vocab = model["model"]["vocab"]
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        # bytes stand as printable characters in the vocabulary: those of Latin-1 that print for themselves, the others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items() if token not in special}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def load(cls, path: str) -> ByteEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str) -> np.ndarray:
        if self.OTHER.search(text):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)

    def encode_single(self, text: str) -> np.ndarray:
        """The same for a text that single_spaced() tells of."""
        if not text.isascii() and self.OTHER.search(text):
            return self.encode(text)
        return np.asarray(self.single.encode_to_numpy(text, allowed_special="all"), np.uint32)


_WHITE = np.zeros(256, bool)
# the white space below 0x250; U+0085 and U+00A0 are pairs of bytes of their own
_WHITE[[*range(9, 14), 32, 0xC2, 0x85, 0xA0]] = True


def single_spaced(texts: pa.Array) -> np.ndarray:
    """Which of the texts surely have no two characters of white space side by side, of a null-free array."""
    raw, offsets = string_buffers(texts)
    white = _WHITE[raw]
    pairs = np.flatnonzero(white[1:] & white[:-1])
    return np.searchsorted(pairs, offsets[1:] - 1) <= np.searchsorted(pairs, offsets[:-1])


class BestFit:
    """Places pieces into bins of `capacity`, at most `open_bins` of which are open."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f: some open bin has f units free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _put(self, space: int, number: int) -> None:
        if space:
            self.bins[space].append(number)
            self.free |= 1 << space
            self.open += 1

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin number, offset in it)."""
        fits = self.free >> length
        if length and fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        self._put(space - length, number)
        return number, self.capacity - space


def pack_documents(
    df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, open_bins: int = 8192, lookahead: int = 8192,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Cut every document into pieces of at most `capacity` tokens and pack them.

    A document is the ids of its whole text and `end_id`. Returns a row per piece: doc_id,
    piece (from 0), start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), sequence_id, offset (place in the sequence, gapless from 0).
    Of a document longer than `capacity` the first piece takes what is over a multiple
    of it, so that all the others are sequences of their own. Pieces arrive in the order of
    the partition; of every `lookahead` pieces that arrived together (whole documents) the longer
    are placed first. With lookahead 1 a document is placed before the next one is seen.

    A null or empty text is the end id alone. Ties and repeated rows are packed each for
    itself; an empty table gives an empty table; other input columns are ignored.
    Sequence ids hold the partition's number in the upper bits: partitions never share
    a sequence, and a task that is run again makes a whole set of sequences again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fit = ByteEncoder.load(tokenizer_path), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        arrived: list[tuple] = []  # doc_id, piece, start, length, ids

        def placed() -> pa.RecordBatch:
            places = [(0, 0)] * len(arrived)
            for k in sorted(range(len(arrived)), key=lambda k: -arrived[k][3]):
                number, offset = fit.place(arrived[k][3])
                places[k] = (base + number, offset)
            columns = [list(c) for c in (*zip(*arrived), *zip(*places))]
            arrived.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.append(encoder.encode(text.as_py()), np.uint32(end_id))
                raw, n = own.astype("<u4").tobytes(), len(own)
                first = n % capacity or min(n, capacity)
                for p, s in enumerate([0, *range(first, n, capacity)]):
                    e = s + (first if p == 0 else capacity)
                    arrived.append((doc, p, s, e - s, raw[4 * s : 4 * e]))
                if len(arrived) >= lookahead:
                    yield placed()
        if arrived:
            yield placed()

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    return rows.mapInArrow(run, SCHEMA)


def packed(df: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
