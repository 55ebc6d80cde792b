"""Operator 10: benchmark decontamination by greedy string tiling.

Documents that share a seed of five words with a benchmark item are tiled with it: again
and again the longest matches that touch no marked word are found by running Karp-Rabin
hashes of word windows and marked. The share of the item's words under tiles is tested,
so passages that were taken apart and reordered are caught too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, BASE_INVERSE, NULL_ID, Words, cut, drop_cut, id_of, mix64, powers, slices, string_buffers, table, text_of

SEED_WORDS = 5
COVERAGE = 0.5
#: Items are handed to every task up to this many bytes of text; a larger benchmark is joined by its seeds.
HANDED_BYTES = 8 << 20
#: Bits that the seeds of a larger benchmark are marked in, 8 MB whatever its size; the join behind it is exact.
SIEVE_BITS = 1 << 26
#: Tasks that the documents of one seed or item are dealt over.
SALTS = 16
#: Items that a task of the join keeps hashed.
HELD_ITEMS = 1024
SCHEMA = "doc_id long, h long, item_id long, coverage double, n_tiles int, longest int"


def _windows(words: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows of s words that hold no marked word."""
    n = len(words) - s + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)))])
    busy = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(busy[s:] == busy[:-s])
    return (prefix[at + s] - prefix[at]) * powers(BASE_INVERSE, n)[at], at


class _Side:
    """Words of one side of a tiling: their prefix hashes, and which are under tiles."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.marked = words, np.zeros(len(words), bool)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)))])
        self.down = powers(BASE_INVERSE, len(words) + 1)
        self.least = np.zeros(0, bool)

    def hashes(self, at: np.ndarray, s: int) -> np.ndarray:
        return (self.prefix[at + s] - self.prefix[at]) * self.down[at]

    def open(self, s: int, least: int) -> np.ndarray:
        """Starts of the windows of s words without a marked word, all of whose windows of `least` words stand on the other side."""
        if len(self.words) < s:
            return np.zeros(0, np.int64)
        bad = np.concatenate([[0], np.cumsum(self.marked)])
        lone = np.concatenate([[0], np.cumsum(~self.least)])
        n = len(self.words) - s + 1
        return np.flatnonzero((bad[s:] == bad[:n]) & (lone[s - least + 1 :][:n] == lone[:n]))


def tile(item: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int, int]:
    """(item words under tiles, tiles, longest tile) of greedy string tiling with tiles of `least` words or more.

    Each round looks for the longest windows that stand on both sides without a marked word, by bisection of
    their length, and marks them in order of item and text. Windows are kept as places on either side, never as
    pairs, so memory is that of the two texts, however often a phrase repeats in both.
    """
    covered = tiles = longest = 0
    if min(len(item), len(text)) < least:
        return covered, tiles, longest
    a, b = _Side(item), _Side(text)
    every = [s.hashes(np.arange(len(s.words) - least + 1), least) for s in (a, b)]
    a.least, b.least = np.isin(every[0], every[1]), np.isin(every[1], every[0])

    def both(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows of s words that stand on both sides, and their hashes."""
        x, y = a.open(s, least), b.open(s, least)
        hx, hy = a.hashes(x, s), b.hashes(y, s)
        in_x, in_y = np.isin(hx, hy), np.isin(hy, hx)
        return x[in_x], hx[in_x], y[in_y], hy[in_y]

    most = min(len(item), len(text))
    while True:
        found, low = None, least - 1
        while low < most:
            mid = low + 1 if low < least else (low + most + 1) // 2
            got = both(mid)
            if len(got[0]):
                found, low = got, mid
            else:
                most = mid - 1
        if found is None or low < least:
            return covered, tiles, longest
        x, hx, y, hy = found
        order = np.argsort(hy, kind="stable")
        y, hy = y[order], hy[order]
        first, end = np.searchsorted(hy, hx, "left").tolist(), np.searchsorted(hy, hx, "right").tolist()
        free: dict[int, int] = {}  # of a window's places in the text, the first that may be unmarked
        before = tiles
        for k, p in enumerate(x.tolist()):
            if a.marked[p] or a.marked[p + low - 1]:  # tiles are never shorter, so one that overlaps covers an end
                continue
            j = free.get(first[k], first[k])
            while j < end[k] and (b.marked[y[j]] or b.marked[y[j] + low - 1]):
                j += 1
            free[first[k]] = j
            # hashes are verified word by word
            while j < end[k] and (b.marked[y[j]] or b.marked[y[j] + low - 1] or (item[p : p + low] != text[y[j] : y[j] + low]).any()):
                j += 1
            if j < end[k]:
                a.marked[p : p + low] = b.marked[y[j] : y[j] + low] = True
                covered, tiles, longest = covered + low, tiles + 1, max(longest, low)
        most = low if tiles > before else low - 1


class Items:
    """Benchmark items as word hashes, and their seeds in order."""

    def __init__(self, ids: list[int], texts: list[str], k: int) -> None:
        raw, offsets = string_buffers(pa.array(texts, pa.large_string()))
        words = Words(raw, offsets)
        self.ids = ids
        self.words = [words.hash[i:j] for i, j in zip(words.first[:-1], words.first[1:])]
        seeds, of, lengths = [], [], []
        for n, w in enumerate(self.words):
            size = min(k, len(w))  # an item of fewer words is one seed
            if size:
                h, _ = _windows(w, np.zeros(len(w), bool), size)
                seeds.append(h), of.append(np.full(len(h), n)), lengths.append(np.full(len(h), size))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        seeds, of, lengths = join(seeds, np.uint64), join(of, np.int64), join(lengths, np.int64)
        self.by_length = {}
        for size in np.unique(lengths).tolist():
            at = lengths == size
            order = np.argsort(seeds[at], kind="stable")
            self.by_length[size] = (seeds[at][order], of[at][order])

    def candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end) for each text and item that share a seed, with the stretch of words that holds all shared seeds."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for size, (seeds, of) in self.by_length.items():
            h, at = _windows(words, np.zeros(len(words), bool), size)
            if not len(h):
                continue
            lo = np.searchsorted(seeds, h, "left")
            hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == h)
            at, lo, up = at[hit], lo[hit], np.searchsorted(seeds, h[hit], "right")
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[doc + 1]
            for d, p, x, y in zip(doc[inside].tolist(), at[inside].tolist(), lo[inside].tolist(), up[inside].tolist()):
                for n in set(of[x:y].tolist()):
                    a, b = found.get((d, n), (p, p))
                    found[d, n] = (min(a, p), max(b, p + size))
        for (d, n), (a, b) in found.items():
            yield d, n, a, b

    def rows(self, batch: pa.RecordBatch, coverage: float, k: int) -> list[tuple]:
        raw, offsets = string_buffers(batch.column(2))
        words = Words(raw, offsets)
        return self.covered(words.hash, words.first, batch.column(0).to_pylist(), batch.column(1).to_pylist(), coverage, k)

    def covered(self, words: np.ndarray, first: np.ndarray, doc_ids: list, hashes: list, coverage: float, k: int) -> list[tuple]:
        """Rows of the texts (words, first word of each) whose tiles cover enough of an item."""
        out = []
        for d, n, a, b in self.candidates(words, first):
            item = self.words[n]
            covered, tiles, longest = tile(item, words[a:b], min(k, len(item)))
            if covered >= coverage * len(item):
                out.append((doc_ids[d], hashes[d], self.ids[n], covered / len(item), tiles, longest))
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "h", "item_id", "coverage", "n_tiles", "longest"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _bits(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of 64 bits, bit among them) of each seed in the sieve."""
    at = mix64(seeds) & np.uint64(bits - 1)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def sieve(theirs: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bit for each of the benchmark's seeds; tasks mark their own before anything moves, and at most bits / 64 rows are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at, bit = _bits(np.asarray(batch.column(0)).view(np.uint64), bits)
            np.bitwise_or.at(marked, at, bit)
        used = np.flatnonzero(marked)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(marked[used].view(np.int64))], names=["at", "marked"])

    got = theirs.select("seed").mapInArrow(run, "at long, marked long").groupBy("at").agg(F.bit_or("marked").alias("marked")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(got["at"])] = np.asarray(got["marked"]).view(np.uint64)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of one seed or item, dealt by document."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of the benchmark, one for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _seeds(rows: DataFrame, sizes: list[int], whole: bool = False, known: Broadcast | None = None) -> DataFrame:
    """rows: (x, y, t). Windows of each text of each of the sizes, each with its number of places there: (x, y, size, seed, places, words).
    With whole, a text of fewer words than the size is one seed of all its words and of their number.
    With known, a sieve, only windows whose bit is marked in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch in slices(rows, "t", 2 << 20):
                raw, offsets = string_buffers(batch.column(2))
                words = Words(raw, offsets)
                count = np.diff(words.first)
                for size in sizes:
                    h, of = words.shingles(size)
                    if not whole:
                        h, of = h[count[of] >= size], of[count[of] >= size]
                    if known is not None:
                        at, bit = _bits(h, 64 * len(known.value))
                        hit = (known.value[at] & bit) != 0
                        h, of = h[hit], of[hit]
                    order = np.lexsort((h, of))
                    h, of = h[order], of[order]
                    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, np.int64)
                    places = np.diff(np.append(head, len(h)))
                    h, of = h[head], of[head]
                    row, own = pa.array(of), np.minimum(count[of], size)
                    numbers = [pa.array(x.astype(np.int32)) for x in (places, count[of])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(1).take(row), pa.array(own.astype(np.int32)), pa.array(h.view(np.int64)), *numbers],
                        names=["x", "y", "size", "seed", "places", "words"],
                    )

    return rows.mapInArrow(run, "x long, y long, size int, seed long, places int, words int")


def telling_seeds(theirs: DataFrame, own: DataFrame, coverage: float, k: int) -> DataFrame:
    """The seeds of each item that a document must share one of, the rarest ones: (size, seed, item_id, g).

    Tiles of k words or more that cover c words hold c / k seeds or more of the item, in
    places counted. A document can lack all but that many places less one, so as many of the
    item's most frequent seeds needn't be looked up. A phrase that is common in the corpus
    hence makes no pairs, unless items consist of it.
    """
    often = own.join(theirs.select("size", "seed").distinct(), ["size", "seed"], "left_semi").groupBy("size", "seed").agg(F.count("*").alias("docs"))
    item = Window.partitionBy("x", "y").orderBy(F.desc("docs"), "seed")
    least = F.when(F.col("words") < k, 1).otherwise(F.ceil(F.lit(coverage) * F.col("words") / k - 1e-9))
    listed = theirs.join(often, ["size", "seed"]).withColumn("passed", F.sum("places").over(item))
    return listed.filter(F.col("passed") >= F.greatest(least, F.lit(1))).select("size", "seed", F.col("x").alias("item_id"), F.col("y").alias("g"))


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", coverage: float = COVERAGE, k: int = SEED_WORDS, handed_bytes: int = HANDED_BYTES) -> DataFrame:
    """(document, item) pairs where tiles cover at least `coverage` of the item's words.

    benchmark: item_id, text. Returns doc_id, h (xxhash64 of the text), item_id, coverage,
    n_tiles and longest (words). Words are white-space separated, ASCII letters folded; tiles
    have five words or more, or all words of a shorter item.

    Null and empty texts and items match nothing. Repeated documents and items give a row
    for each; null ids come back null. Empty tables give an empty table; other columns are
    ignored. The benchmark is handed to all tasks if its text has at most handed_bytes
    (documents then aren't shuffled at all); beyond that seeds, with windows of
    the length of each shorter item, pass a sieve of fixed size and are joined by a shuffle, in
    which a seed's or item's documents are dealt over SALTS tasks, and texts move once. Both ways give the same rows.
    """
    docs = df.select(id_of(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("t"))
    items = benchmark.select(id_of("item_id").alias("item_id"), text_of("text").alias("item"))
    size = items.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    if size <= handed_bytes:
        listed = items.orderBy("item_id", "item").collect()
        handed = df.sparkSession.sparkContext.broadcast(([r[0] for r in listed], [r[1] for r in listed]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(*handed.value, k)
            for whole in batches:
                for batch in slices(whole, "t", 4 << 20):
                    yield _batch(known.rows(batch, coverage, k))

        out = docs.mapInArrow(run, SCHEMA)
    else:
        theirs = _seeds(items.select(F.col("item_id").alias("x"), F.xxhash64("item").alias("y"), F.col("item").alias("t")), [k], whole=True)
        theirs = cut(theirs.distinct(), "item_seeds")
        short = [r[0] for r in theirs.filter(F.col("size") < k).select("size").distinct().collect()]  # at most k - 1
        known = df.sparkSession.sparkContext.broadcast(sieve(theirs))
        own = _seeds(docs.select(F.col("doc_id").alias("x"), F.col("h").alias("y"), "t"), [*sorted(short), k], known=known)
        own = _dealt(own.select("size", "seed", F.col("x").alias("doc_id"), F.col("y").alias("h")))
        # only seeds that some item has are written: a small part of the corpus
        own = cut(own.join(_spread(theirs.select("size", "seed").distinct()), ["size", "seed", "salt"], "left_semi"), "seeds")
        telling = _spread(telling_seeds(theirs, own, coverage, k))
        pairs = cut(own.join(telling, ["size", "seed", "salt"]).select("doc_id", "h", "item_id", "g").distinct(), "pairs")
        drop_cut(own, theirs)
        listed = _dealt(pairs).join(_spread(items.withColumn("g", F.xxhash64("item"))), ["item_id", "g", "salt"])
        both = docs.join(listed, ["doc_id", "h"])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, words = None, None  # a document's pairs come one after the other
            held: dict[tuple[int, int], Items] = {}
            for batch in batches:
                rows = []
                ids, hashes, items_, marks = (batch.column(c).to_pylist() for c in (0, 1, 3, 5))
                for i, own in enumerate(zip(ids, hashes)):
                    if own != key:
                        key, words = own, Words(*string_buffers(batch.column(2).slice(i, 1)))
                    if (items_[i], marks[i]) not in held:
                        if len(held) >= HELD_ITEMS:
                            held.clear()
                        held[items_[i], marks[i]] = Items([items_[i]], [batch.column(4)[i].as_py()], k)
                    rows += held[items_[i], marks[i]].covered(words.hash, words.first, [own[0]], [own[1]], coverage, k)
                yield _batch(rows)

        out = both.select("doc_id", "h", "t", "item_id", "item", "g").mapInArrow(one, SCHEMA)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), "h", real("item_id"), "coverage", "n_tiles", "longest")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")
