"""Operator 2: token counts by overlap resynchronisation.

Texts up to `huge_chars` are encoded whole. A longer text is encoded in overlapping
chunks with offsets. Two chunks are spliced at a position that is a token boundary in
both and that no token can cross: the characters on its two sides stand side by side in
no vocabulary piece, so no merge ever joins them and the two sides are encoded
independently of each other. Where an overlap has no such position it is widened, in the
end to the whole rest of the text, so that counts are always those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks long"


class PieceEncoder:
    """A sentencepiece BPE model and the character pairs that can stand inside a piece."""

    _loaded: dict[str, PieceEncoder] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    @classmethod
    def load(cls, path: str) -> PieceEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def stable(self, text: str, at: int) -> bool:
        """No token can cross the position: neither side's characters merge across it."""
        return text[at - 1 : at + 1].replace(" ", "▁") not in self.inside

    def chunk(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        got = self.model.encode(text, return_type="offset_mapping")
        return got["ids"], got["offsets"]

    def encode_long(self, text: str, chunk_chars: int, overlap_chars: int) -> tuple[list[int], int]:
        """(ids of the whole text, number of encoder calls)."""
        ids: list[int] = []
        calls, accepted = 0, 0  # everything before `accepted` is in ids
        start, end = 0, min(len(text), chunk_chars)
        own, offsets = self.chunk(text[start:end])
        calls += 1
        while end < len(text):
            overlap, spliced = overlap_chars, False
            while not spliced:
                left = max(accepted, end - overlap, start)
                right = min(len(text), left + max(chunk_chars, 2 * overlap))
                if left == accepted:  # the overlap has become the whole chunk: take a longer chunk instead
                    break
                new, new_offsets = self.chunk(text[left:right])
                calls += 1
                ends = {start + b for _, b in offsets}
                begins = {left + a for a, _ in new_offsets}
                at = next((p for p in range(end - 1, left, -1) if p in ends and p in begins and self.stable(text, p)), None)
                if at is None:
                    overlap *= 2
                    continue
                ids += [i for i, (a, b) in zip(own, offsets) if accepted <= start + a and start + b <= at and not (start + a == at)]
                accepted, spliced = at, True
                start, end, own, offsets = left, right, new, new_offsets
            if not spliced:
                end = min(len(text), start + 2 * (end - start))
                own, offsets = self.chunk(text[start:end])
                calls += 1
        ids += [i for i, (a, _) in zip(own, offsets) if start + a >= accepted]
        return ids, calls


def count_tokens(
    df: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id",
    huge_chars: int = 32_768, chunk_chars: int = 8_192, overlap_chars: int = 256,
) -> DataFrame:
    """Tokens of every whole text, without begin, end or added special tokens.

    Returns doc_id, n_bytes (UTF-8), n_tokens and n_chunks (encoder calls). A null text
    counts as empty: 0 bytes, 0 tokens. Ties and repeated rows are counted each for
    itself, an empty table gives an empty table, other input columns are ignored.
    A pass over the rows where they are read: no shuffle, a batch of Arrow rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.load(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, chunks = [0] * len(texts), [1] * len(texts)
            for lo in range(0, len(texts), 256):
                small = [k for k in range(lo, min(lo + 256, len(texts))) if len(texts[k]) <= huge_chars]
                for k, ids in zip(small, encoder.model.encode([texts[k] for k in small], num_threads=1)):
                    counts[k] = len(ids)
            for k, t in enumerate(texts):
                if len(t) > huge_chars:
                    ids, chunks[k] = encoder.encode_long(t, chunk_chars, overlap_chars)
                    counts[k] = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(chunks, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "n_chunks"],
            )

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
