"""Operator 13: hard negatives by a two-dimensional block matrix product.

Anchors and rows are cut into blocks of rows. A grid of (group of anchor blocks, group of
row blocks) deals the product: the blocks of a cell meet in one task, which multiplies them
a tile and a chunk of dimensions at a time and adds the partial tiles. Only what is best in
a cell leaves it, no tile does. The product is taken twice: the first time for each
anchor's positives, the second for the rows in the windows of their scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop_cut, table
from .whitening import of_one_length, scaled_integers

SCALE = 256
ANCHOR_BLOCK, ROW_BLOCK, CHUNK, GRID = 256, 2048, 32, 64
#: Bytes of a block as 64-bit integers; longer vectors make blocks of fewer rows.
BLOCK_BYTES = 1 << 20
#: Scores of a tile.
TILE = 1 << 21
BLOCKS = "part int, made int, rows array<long>, ids array<long>, labels array<long>, data binary, bytes int, windows array<long>"
PICKS = "anchor_row long, anchor_id long, row long, id long, score long"
MINED = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, id long, score long"
MOST = 2**63 - 1


def _narrowest(x: np.ndarray) -> np.ndarray:
    least, most = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Gather (row, vec_id, label, x, windows) to blocks of at most `size` rows, in the order of arrival: a task's rows make blocks of their own.

    data has the entries of x in as few bytes as hold them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _narrowest(np.asarray(batch.column(3).flatten(), dtype="<i8"))
            own = [pa.array([batch.column(k)], pa.list_(pa.int64())) for k in range(3)]
            numbers = [pa.array([k], pa.int32()) for k in (part, made, x.itemsize)]
            windows = pa.array([batch.column(4).flatten()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*numbers[:2], *own, pa.array([x.tobytes()]), numbers[2], windows], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield gathered(whole.slice(0, size).combine_chunks().to_batches()[0])
                made += 1
                held = whole.slice(size).to_batches()
                n -= size
        if n:
            yield gathered(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.select("row", "vec_id", "label", "x", "windows").mapInArrow(run, BLOCKS)


def _numbered(side: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with their number, from 0 without a gap, and how many there are; the driver holds a number for each task that made them."""
    per, before, total = {r["part"]: r["count"] for r in side.groupBy("part").count().collect()}, [], 0
    for k in range(max(per, default=-1) + 1):
        before.append(total)
        total += per.get(k, 0)
    return side.withColumn("block", F.get(F.lit(before or [0]), F.col("part")) + F.col("made")), total


class Cell:
    """One side of a cell: its rows in order of (first, id, row), with x, rows, ids, labels and windows."""

    def __init__(self, side: pa.Table, by_label: bool) -> None:
        gathered = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.asarray(v.values) for v in side.column(c)]]) if len(side) else np.zeros(0, np.int64)
        self.rows, self.ids, self.labels = (gathered(c) for c in ("rows", "ids", "labels"))
        n = len(self.rows)
        parts = [np.frombuffer(v.as_buffer(), f"<i{k.as_py()}") for v, k in zip(side.column("data"), side.column("bytes"))]
        x = np.concatenate(parts).reshape(n, -1) if n else np.zeros((0, 0), np.int16)
        order = np.lexsort((self.rows, self.ids, self.labels) if by_label else (self.rows, self.ids))
        self.x, self.rows, self.ids, self.labels = x[order], self.rows[order], self.ids[order], self.labels[order]
        self.windows = gathered("windows").reshape(n, -1)[order] if n else np.zeros((0, 0), np.int64)

    def __len__(self) -> int:
        return len(self.rows)


def _made_exact(a: Cell, b: Cell) -> None:
    """x of both in the narrowest numbers that hold every sum of their products: floating point below 2^24 or 2^53, else int64."""
    largest = lambda x: max(-int(x.min()), int(x.max())) if x.size else 0
    most = largest(a.x) * largest(b.x) * a.x.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    a.x, b.x = a.x.astype(kind), b.x.astype(kind)


def _tile(a: np.ndarray, b: np.ndarray, chunk: int) -> np.ndarray:
    """a times b transposed: the sum of the partial tiles of each chunk of dimensions."""
    total = a[:, :chunk] @ b[:, :chunk].T
    for at in range(chunk, a.shape[1], chunk):
        total += a[:, at : at + chunk] @ b[:, at : at + chunk].T
    return total


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... start[0] + length[0] - 1, start[1], ..."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def _first(i: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the first k of each value of i, which ascends and is below n."""
    at = np.searchsorted(i, np.arange(n + 1))
    return _ranges(at[:-1], np.minimum(np.diff(at), k))


def _positives(a: Cell, b: Cell, k: int, chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(place in a, place in b, score) of the k best rows of each anchor's label in the cell, but the anchor itself; ties by place in b."""
    for label in np.unique(a.labels):
        (a0, a1), (b0, b1) = ((np.searchsorted(c.labels, label), np.searchsorted(c.labels, label, "right")) for c in (a, b))
        m = int(b1 - b0)
        step = max(1, TILE // max(m, 1))
        for at in range(a0, a1 if m else a0, step):
            to = min(at + step, a1)
            tile = _tile(a.x[at:to], b.x[b0:b1], chunk)
            # one more, as the anchor itself may be among them; with all ties of the last
            least = np.partition(tile, m - k - 1, axis=1)[:, m - k - 1, None] if m > k + 1 else tile.min(axis=1, keepdims=True)
            i, j = np.nonzero(tile >= least)
            s = tile[i, j].astype(np.int64)
            other = a.rows[at + i] != b.rows[b0 + j]
            i, j, s = i[other], j[other], s[other]
            order = np.lexsort((j, -s, i))
            order = order[_first(i[order], to - at, k)]
            yield at + i[order], b0 + j[order], s[order]


def _negatives(x: np.ndarray, labels: np.ndarray, b: Cell, low: np.ndarray, high: np.ndarray, k: int, chunk: int) -> tuple[np.ndarray, ...]:
    """(place in x, window, place in b, score) of the k best rows of another label in each window, ties by place in b.

    Row by row of tiles, a tile's scores are held only against the worst that a window still needs."""
    n, width = low.shape
    least, most = low.copy(), np.where(low <= high, high, -MOST).max(axis=1)
    i, j, s = (np.zeros(0, np.int64) for _ in range(3))
    out = [(i, i, i, i)]
    wide = max(1, TILE // max(n, 1))
    at, to = 0, min(wide, 1024, len(b))  # a small tile first
    while at < to:
        tile = _tile(x, b.x[at:to], chunk)
        need = np.where(low <= high, least, MOST).min(axis=1)
        found = np.flatnonzero((tile >= need[:, None].astype(tile.dtype)) & (tile <= most[:, None].astype(tile.dtype)))
        fi, fj = np.divmod(found, to - at)
        fs = tile.ravel()[found].astype(np.int64)
        other = labels[fi] != b.labels[at + fj]
        i, j, s = np.concatenate([i, fi[other]]), np.concatenate([j, at + fj[other]]), np.concatenate([s, fs[other]])
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        begins, used, out = np.searchsorted(i, np.arange(n)), np.zeros(len(i), bool), []
        for w in range(width):  # within an anchor the scores of a window stand together
            start = begins + np.bincount(i[s > high[i, w]], minlength=n)
            length = np.clip(begins + np.bincount(i[s >= low[i, w]], minlength=n) - start, 0, k)
            full = np.flatnonzero(length == k)
            least[full, w] = s[start[full] + k - 1]
            own = _ranges(start, length)
            used[own] = True
            out.append((i[own], np.full(len(own), w), j[own], s[own]))
        i, j, s = i[used], j[used], s[used]
        at, to = to, min(to + wide, len(b))
    return tuple(np.concatenate(c) for c in zip(*out))


def _columns(schema: str, *values: np.ndarray) -> pa.Table:
    return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(schema.split(", "), values)})


def in_cells(anchors: DataFrame, rows: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, grid: int = GRID) -> DataFrame:
    """f of the anchor blocks and the row blocks of each cell of the grid; a block is sent once to each group of the other side.

    A group has `grid` blocks at most, and fewer where the cells would not keep all cores busy."""
    (left, n_left), (right, n_right) = _numbered(anchors), _numbered(rows)
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    a_groups = max(1, -(-n_left // grid))
    b_groups = max(1, -(-n_right // grid), min(n_right, -(-2 * cores // a_groups)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("ga", F.col("block") % a_groups).withColumn("gb", every(b_groups))
    right = right.withColumn("gb", F.col("block") % b_groups).withColumn("ga", every(a_groups))
    key = [F.col(c).cast("int").alias(c) for c in ("ga", "gb")]
    own = ["rows", "ids", "labels", "data", "bytes", "windows"]
    return left.select(*key, *own).groupBy("ga", "gb").cogroup(right.select(*key, *own).groupBy("ga", "gb")).applyInArrow(f, schema)


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group, ranked from 1; Spark keeps k a group before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, chunk: int = CHUNK, grid: int = GRID,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives, of all rows.

    A row's score is its integer inner product (components floor(256*x)) with the anchor. An anchor's positives
    are its first other rows of its label; negatives are the first rows of another label
    whose score is between low % and high % of the positive's, ends included (a negative
    positive score turns the window round, so that it is empty). Returns anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    Rows with a null id or label, a null or empty vector or a null or non-finite entry take no
    part, nor do vectors of another length than the most frequent one (of equally frequent
    ones the longest). Repeated ids are rows of their own: each repeated anchor returns
    its rows, and its twin is another row. Equal scores go by smaller id. Anchors without a
    positive, and empty tables, give no rows. Other columns are ignored. Scores must fit in 64 bits.

    Memory of a task: the blocks of a cell (at most grid x BLOCK_BYTES of each side as 64-bit integers), a tile of
    TILE scores, and what the cell gives. What the ranking moves is at most `negatives` rows for each
    anchor, positive and group of row blocks; the vectors move twice for each group of anchor blocks.
    """
    own = of_one_length(vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull()), embedding)
    own = own.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), scaled_integers(embedding, SCALE, 0).alias("x"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"),
    )
    own = cut(own, "integer_vectors")
    one = own.select(F.size("x").alias("d")).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, one["d"] if one else 1)))
    anchor_block, row_block = min(anchor_block, most), min(row_block, most)
    none = F.array().cast("array<long>").alias("windows")
    of_anchors = own.filter("anchor")
    dealt = lambda df, n: cut(blocks(df.repartition(max(1, -(-n // anchor_block))), anchor_block), "anchor_blocks")
    n_anchors = of_anchors.count()
    a_blocks = dealt(of_anchors.select("*", none), n_anchors)
    b_blocks = cut(blocks(own.select("*", none), row_block), "row_blocks")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = Cell(left, True), Cell(right, True)
        if not len(a) or not len(b):
            return _columns(PICKS, *[np.zeros(0, np.int64)] * 5)
        _made_exact(a, b)
        i, j, s = (np.concatenate(c) for c in zip(*[(np.zeros(0, np.int64),) * 3, *_positives(a, b, positives, chunk)]))
        return _columns(PICKS, a.rows[i], a.ids[i], b.rows[j], b.ids[j], s)

    found = _ranked(in_cells(a_blocks, b_blocks, best, PICKS, grid), ["anchor_row"], positives)
    # windows: row, id and score of each positive by rank; -1 as a row stands for none
    of = found.groupBy(F.col("anchor_row").alias("row")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "row", "id", "score"))), lambda p: F.array(p["row"], p["id"], p["score"]))).alias("windows"))
    of = of.withColumn("windows", F.slice(F.concat("windows", F.array_repeat(F.lit(-1).cast("long"), 3 * positives)), 1, 3 * positives))
    with_windows = cut(of_anchors.join(of.hint("merge"), "row").select("row", "vec_id", "label", "x", "windows"), "windows")
    w_blocks = dealt(with_windows, n_anchors)

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = Cell(left, False), Cell(right, False)
        if not len(a) or not len(b):
            return _columns(MINED, *[np.zeros(0, np.int64)] * 8)
        _made_exact(a, b)
        windows = a.windows.reshape(len(a), -1, 3)
        bound = lambda f: np.array([[f(int(p)) if r >= 0 else None for r, _, p in one] for one in windows.tolist()], object)
        clipped = lambda x, missing: np.array([[missing if v is None else max(-MOST, min(MOST, v)) for v in one] for one in x], np.int64).reshape(windows.shape[:2])
        lows, highs = clipped(bound(lambda p: -(-low * p // 100)), MOST), clipped(bound(lambda p: high * p // 100), -MOST)
        out = []
        for at in range(0, len(a), anchor_block):
            part = slice(at, at + anchor_block)
            i, w, j, s = _negatives(a.x[part], a.labels[part], b, lows[part], highs[part], negatives, chunk)
            out.append((a.rows[at + i], a.ids[at + i], *(windows[at + i, w, c] for c in range(3)), b.rows[j], b.ids[j], s))
        return _columns(MINED, *(np.concatenate(c) for c in zip(*out)))

    mined = in_cells(w_blocks, b_blocks, within, MINED, grid)
    out = _ranked(mined, ["anchor_row", "positive_row"], negatives)
    out = cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard_negatives")
    drop_cut(own, a_blocks, b_blocks, with_windows, w_blocks)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10
"""
