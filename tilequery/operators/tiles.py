"""Tile bytes: ranged reads, transcoding, thumbnails.

Pixels need a JPEG codec. Pillow is used where it is installed; without it, and for
JPEG 2000, rows come back with the error decode_error, never with an exception.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from PIL import Image
except ImportError:
    Image = None

#: Reads of a file that lie closer together than this are one read.
GAP = 262_144


def fetch(extents: DataFrame) -> DataFrame:
    """extents (slide_id = path, offset, length, ...): adds data and error.

    Equal extents are read once; a task takes its files in order of offset and joins
    neighbouring ranges into one read. A hot slide is dealt over tasks by blocks of its file."""
    wanted = extents.select("slide_id", "offset", "length").distinct().withColumn("part", F.floor(F.col("offset") / (64 << 20)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        path, handle, held, start = None, None, b"", 0
        for frame in frames:
            data, errors = [], []
            end_of = (frame.offset + frame.length).tolist()
            for k, row in enumerate(frame.itertuples(index=False)):
                try:
                    if row.slide_id != path:
                        if handle is not None:
                            handle.close()
                        path, handle = None, None
                        system, name = fs.FileSystem.from_uri(row.slide_id if "://" in row.slide_id else f"file://{row.slide_id}")
                        path, handle, held, start = row.slide_id, system.open_input_file(name), b"", 0
                    if not (start <= row.offset and row.offset + row.length <= start + len(held)):
                        last, j = end_of[k], k + 1
                        while j < len(frame) and frame.slide_id.iat[j] == path and frame.offset.iat[j] - last <= GAP and end_of[j] - row.offset <= 8 << 20:
                            last, j = max(last, end_of[j]), j + 1
                        start, held = row.offset, handle.read_at(last - row.offset, row.offset)
                    own = held[row.offset - start : row.offset - start + row.length]
                    if len(own) != row.length:
                        raise OSError("range out of bounds")
                    data.append(own), errors.append(None)
                except FileNotFoundError:
                    data.append(None), errors.append("not_found")
                except OSError:
                    data.append(None), errors.append("io_error")
            yield frame[["slide_id", "offset", "length"]].assign(data=data, error=errors)
        if handle is not None:
            handle.close()

    dealt = wanted.repartition("slide_id", "part").sortWithinPartitions("slide_id", "offset").drop("part")
    got = dealt.mapInPandas(run, "slide_id string, offset long, length long, data binary, error string")
    return extents.join(got, ["slide_id", "offset", "length"], "left")


def decode(data: bytes) -> np.ndarray | None:
    if Image is None:
        return None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except Exception:  # noqa: BLE001  an undecodable tile is a row with an error
        return None


def encode(pixels: np.ndarray, quality: int) -> bytes:
    out = io.BytesIO()
    Image.fromarray(pixels).save(out, "JPEG", quality=max(1, min(100, quality)))
    return out.getvalue()


def transcode(tiles: DataFrame) -> DataFrame:
    """tiles (..., data, quality): data always encoded anew at the clamped quality; error decode_error where it can't be."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pixels = [decode(d) if d is not None else None for d in frame.data]
            frame["data"] = [encode(p, int(q)) if p is not None else None for p, q in zip(pixels, frame.quality)]
            frame["error"] = [None if p is not None else "decode_error" for p in pixels]
            yield frame

    kinds = ", ".join(f"`{n}` {t}" for n, t in tiles.dtypes if n != "error")
    return tiles.drop("error").mapInPandas(run, kinds + ", error string")


def composite(tiles: list[tuple[int, int, np.ndarray]], width: int, height: int, tile_width: int, tile_height: int) -> np.ndarray:
    """Decoded tiles (x, y, pixels) pasted in place and clipped to the level."""
    canvas = np.zeros((height, width, 3), np.uint8)
    for x, y, pixels in tiles:
        own = pixels[: max(0, height - y * tile_height), : max(0, width - x * tile_width)]
        canvas[y * tile_height : y * tile_height + own.shape[0], x * tile_width : x * tile_width + own.shape[1]] = own
    return canvas


def _taps(n: int, m: int, lobes: int) -> tuple[np.ndarray, np.ndarray]:
    """For m outputs over n inputs: the inputs in reach of each output and their weights, outputs x taps."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    at = np.floor(centre - lobes * scale).astype(np.int64)[:, None] + np.arange(int(np.ceil(2 * lobes * scale)) + 2)
    x = (at - centre[:, None]) / scale
    w = np.where((np.abs(x) < lobes) & (at >= 0) & (at < n), np.sinc(x) * np.sinc(x / lobes), 0.0)
    return np.clip(at, 0, n - 1), w / w.sum(1, keepdims=True)


def lanczos(pixels: np.ndarray, width: int, height: int, lobes: int = 3) -> np.ndarray:
    """Separable windowed-sinc resize to exactly width x height.

    An output takes only the inputs within reach of its window: some per output and axis, however large the image is."""
    out = pixels
    for axis, m in ((0, height), (1, width)):
        source = np.moveaxis(out, axis, 0)
        at, w = _taps(source.shape[0], m, lobes)
        sums = np.zeros((m, *source.shape[1:]))
        for k in range(at.shape[1]):
            sums += w[:, k, None, None] * source[at[:, k]]
        out = np.moveaxis(sums, 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def thumbnails(tiles: DataFrame, quality: int = 80) -> DataFrame:
    """tiles (slide_id, level, width, height, tile_width, tile_height, tile_x, tile_y, out_width, out_height, data): a JPEG per slide.

    The level of a thumbnail is chosen so that its tiles are few; a group is one slide's."""
    schema = "slide_id string, out_width long, out_height long, data binary, error string"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        pixels = [(t.tile_x, t.tile_y, decode(t.data)) for t in frame.itertuples(index=False)]
        if any(p is None for _, _, p in pixels):
            return pd.DataFrame([[r.slide_id, r.out_width, r.out_height, None, "decode_error"]], columns=["slide_id", "out_width", "out_height", "data", "error"])
        canvas = composite(pixels, int(r.width), int(r.height), int(r.tile_width), int(r.tile_height))
        data = encode(lanczos(canvas, int(r.out_width), int(r.out_height)), quality)
        return pd.DataFrame([[r.slide_id, r.out_width, r.out_height, data, None]], columns=["slide_id", "out_width", "out_height", "data", "error"])

    return tiles.groupBy("slide_id").applyInPandas(one, schema)
