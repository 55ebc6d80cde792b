"""Operator 6: repeated passages by hash-compared suffix sorting.

A text is a row of symbols, bytes or words. Every string of `length` symbols is assigned
to one anchor in it, the position of its least hash of `gram` symbols, so equal strings
have equal anchors at equal distances. Strings of one text with one anchor form a context,
known by a 128-bit digest of its symbols. Contexts that occur twice are repeated as a
whole. Different contexts with a shared anchor are suffix-sorted from the anchor on, to
the right and to the left: prefix polynomial hashes and binary search give the common
extension of two suffixes, mergesort orders them by it, and neighbours are verified symbol
by symbol. The extensions tell for each distance whether another string is equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, NULL_ID, byte_values, cut, drop_cut, id_of, mix64, powers, slices, string_buffers, table, text_of, word_bounds, word_values


@dataclass(frozen=True)
class Measure:
    """What counts as a repeated string: so many bytes, or words told apart by white space."""

    length: int
    gram: int
    words: bool = False

    @property
    def span(self) -> int:
        """Strings that can have one anchor."""
        return self.length - self.gram + 1

    def symbols(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts and where each text begins among them."""
        return word_values(raw, offsets) if self.words else (raw, offsets)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.words else byte_values()[symbols]

    def packed(self, symbols: bytes | np.ndarray) -> np.ndarray:
        return np.frombuffer(symbols, np.uint64 if self.words else np.uint8)


BYTES = Measure(400, 128)
#: Passages of over 50 words.
PASSAGES = Measure(51, 17, words=True)
#: A longer text is scanned in segments of so many string starts.
SEGMENT = 1 << 20
#: An anchor with more different contexts is taken apart until no group is larger.
GROUP = 2048


def prefix_hashes(values: np.ndarray, base: int = BASE) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def digests(symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two int64 of BLAKE2b for each stretch of symbols first..end-1."""
    size, raw = symbols.itemsize, memoryview(np.ascontiguousarray(symbols)).cast("B")
    found = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip((first * size).tolist(), (end * size).tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


class SuffixOrder:
    """Sorts suffixes of one buffer, each of a group, within their groups.

    raw: symbols; values: what is hashed of each. start, length: of each suffix; group:
    ascending. Neighbours in the order are compared symbol by symbol; if their hashes
    collided, all is sorted again with another base.
    """

    def __init__(self, raw: np.ndarray, values: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, base: int = BASE) -> None:
        self.raw, self.start, self.length = raw, start, length
        while True:
            self.prefix, self.down = prefix_hashes(values, base), powers(pow(base, -1, 1 << 64), len(raw) + 1)
            self.order = self._mergesort(group)
            self.new = np.ones(len(group), bool)
            self.new[1:] = group[self.order][1:] != group[self.order][:-1]
            self.common = np.zeros(len(group), np.int64)  # with the one before in the order
            after = np.flatnonzero(~self.new)
            self.common[after] = self._extension(self.order[after - 1], self.order[after])
            if self._verified(after):
                return
            base = (base * 0x9E3779B97F4A7C15 + 2) % (1 << 64) | 1

    def _extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common prefix of suffixes x and y, by binary search over hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = (self.prefix[a + mid] - self.prefix[a]) * self.down[a] == (self.prefix[b + mid] - self.prefix[b]) * self.down[b]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def _less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self._extension(x, y)
        ended_x, ended_y = n == self.length[x], n == self.length[y]
        last = len(self.raw) - 1
        return np.where(ended_x | ended_y, ended_x & ~ended_y, self.raw[np.minimum(self.start[x] + n, last)] < self.raw[np.minimum(self.start[y] + n, last)])

    def _mergesort(self, group: np.ndarray) -> np.ndarray:
        """Bottom-up: a suffix's place after a merge is its place in its own run and its rank in the other."""
        order = np.arange(len(group))
        first = np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - first
        local = order - first
        width = 1
        while len(group) and width < size.max():
            at = np.flatnonzero(size > width)
            run = local[at] // width
            own = local[at] % width
            left = run % 2 == 0
            other = np.where(left, run + 1, run - 1) * width
            low = np.zeros(len(at), np.int64)
            high = np.clip(size[at] - other, 0, width)
            x = order[at]
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) // 2
                y = order[first[at[todo]] + other[todo] + mid]
                # rank: members of the right run less than x; of the left run, not greater than x
                before = np.where(left[todo], self._less(y, x[todo]), ~self._less(x[todo], y))
                low[todo], high[todo] = np.where(before, mid + 1, low[todo]), np.where(before, high[todo], mid)
            place = first[at] + np.minimum(run, np.where(left, run, run - 1)) * width + own + low
            order[place] = x
            width *= 2
        return order

    def _verified(self, after: np.ndarray) -> bool:
        """Whether neighbours agree symbol by symbol as far as their hashes say, and ascend behind that."""
        last = len(self.raw) - 1
        for lo in range(0, len(after), 4096):
            at = after[lo : lo + 4096]
            n, a, b = self.common[at], self.order[at - 1], self.order[at]
            each = np.repeat(np.arange(len(at)), n)
            step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            if (self.raw[self.start[a][each] + step] != self.raw[self.start[b][each] + step]).any():
                return False
            behind = (n == self.length[a]) | (self.raw[np.minimum(self.start[a] + n, last)] < self.raw[np.minimum(self.start[b] + n, last)])
            if not behind.all():
                return False
        return True


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], fore[width - 1 : width - 1 + m])


def anchors(symbols: np.ndarray, offsets: np.ndarray, measure: Measure) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, anchor hash, context digest, last start of the first context, contexts) of runs of strings with one anchor and context."""
    n, length, gram = len(symbols), measure.length, measure.gram
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, np.zeros((0, 2), np.int64), none, none
    prefix, down = prefix_hashes(measure.values(symbols)), powers(BASE_INVERSE, n + 1)
    grams = mix64((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    shift = np.uint64(30)
    least = sliding_least((grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64), measure.span)
    anchor = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    valid = np.arange(n - length + 1) + length <= offsets[1:][text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    context = digests(symbols, first, ends + length)
    of, gram = text[first], grams[anchor[first]].view(np.int64)
    # in periodic text one context follows itself: such a run is one row, and repeated in any case
    fresh = np.ones(len(first), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (context[1:] != context[:-1]).any(1) | (first[1:] != ends[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(first)) - 1 if len(head) else head
    base = offsets[of[head]]
    return of[head], first[head] - base, ends[tail] - base, anchor[first[head]] - base, gram[head], context[head], ends[head] - base, tail - head + 1


def _pieces(batch: pa.RecordBatch, measure: Measure) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(rows, place of the first symbol, symbols, offsets) of runs of texts; long texts come in overlapping segments."""
    for part in slices(batch, "t", 1 << 20):
        symbols, offsets = measure.symbols(*string_buffers(part.column(part.schema.get_field_index("t"))))
        if part.num_rows == 1 and len(symbols) > SEGMENT + measure.length:
            for s in range(0, len(symbols) - measure.length + 1, SEGMENT):
                own = symbols[s : s + SEGMENT + measure.length - 1]
                yield part, s, own, np.array([0, len(own)])
        else:
            yield part, 0, symbols, offsets


def find_anchors(docs: DataFrame, measure: Measure) -> DataFrame:
    """docs: (doc_id, h, t). A row per anchor, or run of n anchors with equal contexts one after another: hash, context digest, document, string starts first..last (own_last: of the first context), anchor."""
    names = ["gram", "c1", "c2", "doc_id", "h", "first", "last", "anchor", "own_last", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, symbols, offsets in _pieces(batch, measure):
                text, first, last, anchor, gram, context, own_last, n = anchors(symbols, offsets, measure)
                if len(text):
                    row = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram), pa.array(context[:, 0]), pa.array(context[:, 1]), part.column(0).take(row), part.column(1).take(row),
                         pa.array(start + first), pa.array(start + last), pa.array(start + anchor), pa.array(start + own_last), pa.array(n)],
                        names=names,
                    )

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true flags in each row."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def repeated_strings(
    symbols: np.ndarray, offsets: np.ndarray, left: np.ndarray, group: np.ndarray, measure: Measure, within: tuple[np.ndarray, np.ndarray] | None = None, place: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first start, last start) of strings that are equal to one of another context.

    Contexts of one anchor form a group (ascending numbers); left: symbols before the
    anchor; within: the least and greatest distance from the anchor that is asked for.
    place: ascending places of the contexts; only strings that equal one of an earlier place.
    """
    m, size, length = len(left), np.diff(offsets), measure.length
    values = measure.values(symbols)
    right = SuffixOrder(symbols, values, offsets[:-1] + left, size - left, group)
    backward = SuffixOrder(symbols[::-1].copy(), values[::-1].copy(), len(symbols) - offsets[:-1] - left, left, group)
    most = []
    for s in (right, backward):
        best = np.zeros(m, np.int64)
        np.maximum.at(best, s.order, s.common)
        np.maximum.at(best, s.order[:-1], s.common[1:])
        most.append(best)
    # a string that begins d symbols before the anchor needs d symbols to the left and the rest to the right
    low = np.maximum(length - most[0], left - (size - length))
    high = np.minimum(most[1], left)
    if within is not None:
        low, high = np.maximum(low, within[0]), np.minimum(high, within[1])
    equal = np.zeros((m, measure.span), bool)
    possible = low <= high
    rank = np.empty(m, np.int64)
    for d in range(int(low[possible].min()) if possible.any() else 0, int(high[possible].max()) + 1 if possible.any() else 0):
        on = np.flatnonzero((low <= d) & (d <= high))
        if len(on) < 2:
            continue
        classes = []
        for s, depth in ((right, length - d), (backward, d)):
            rank[s.order] = np.cumsum(s.new | (s.common < depth))
            classes.append(rank[on].copy())
        key = classes[0] * (m + 1) + classes[1]
        _, head, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        on = on[count[inverse] > 1] if place is None else on[place[on] > place[on[head]][inverse]]
        equal[on, left[on] - d] = True
    return _runs(equal)


CONTEXT = "k1 long, k2 long, lo int, hi int, doc_id long, h long, first long, left long, lone boolean, symbols binary"


def compare_contexts(contexts: DataFrame, measure: Measure, keep_first: bool) -> DataFrame:
    """contexts: as CONTEXT says. Spans (doc_id, h, a, b) of symbols to remove, found by sorting the suffixes of each group (k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def keys(t: pa.Table) -> np.ndarray:
            return np.stack([np.asarray(t["k1"]), np.asarray(t["k2"])], 1)

        def spans(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            size = 8 if measure.words else 1
            raw, offsets = string_buffers(t["symbols"].chunk(0))
            key, column = keys(t), lambda c: np.asarray(t[c]).astype(np.int64)
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]).any(1)))
            place = None
            if keep_first:  # repeated rows are one place
                at = np.stack([group, *(column(c) for c in ("doc_id", "h", "first"))], 1)
                place = np.cumsum(np.append(True, (at[1:] != at[:-1]).any(1)))
            row, first, last = repeated_strings(measure.packed(raw.tobytes()), offsets // size, column("left"), group, measure, (column("lo"), column("hi")), place)
            if not keep_first:  # contexts that occur twice are removed as a whole
                lone = np.asarray(t["lone"])[row]
                row, first, last = row[lone], first[lone], last[lone]
            start = np.asarray(t["first"])[row]
            at = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [t["doc_id"].chunk(0).take(at), t["h"].chunk(0).take(at), pa.array(start + first), pa.array(start + last + measure.length)], names=["doc_id", "h", "a", "b"]
            )

        for whole in batches:
            for lo in range(0, whole.num_rows, GROUP):
                t = pa.Table.from_batches([whole.slice(lo, GROUP)])
                rest = t if rest is None else pa.concat_tables([rest, t])
                if rest.num_rows < GROUP:
                    continue
                key = keys(rest)
                done = int(np.argmax((key == key[-1]).all(1)))
                if done:
                    yield spans(rest.slice(0, done))
                    rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield spans(rest)

    dealt = contexts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc_id", "h", F.col("first") + F.col("left"))
    return dealt.mapInArrow(run, "doc_id long, h long, a long, b long")


def take_apart(contexts: DataFrame, measure: Measure) -> DataFrame:
    """Contexts of large groups in smaller ones: one for the lower and one for the upper half of the distances.

    All strings at distances lo..hi hold the lo symbols before the anchor and length - hi
    symbols from there on; the digest of these is the key of the new group, so
    equal strings stay together. At one distance the group is one string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "symbols", 1 << 22):
                raw, offsets = string_buffers(batch.column(9))
                symbols, offsets = measure.packed(raw.tobytes()), offsets // (8 if measure.words else 1)
                lo, hi, left = (np.asarray(batch.column(k)).astype(np.int64) for k in (2, 3, 7))
                least, most, mid = left - (np.diff(offsets) - measure.length), left, (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    row = np.flatnonzero((a <= b) & (np.maximum(a, least) <= np.minimum(b, most)))
                    a, b, anchor = a[row], b[row], offsets[:-1][row] + left[row]
                    key = digests(symbols, anchor - a, anchor + measure.length - b) ^ mix64((a << 32 | b).astype(np.uint64)).view(np.int64)[:, None]
                    at = pa.array(row)
                    own = [pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(own + [batch.column(k).take(at) for k in range(4, 10)], names=batch.schema.names)

    return contexts.mapInArrow(run, CONTEXT)


def same_string(contexts: DataFrame, measure: Measure, keep_first: bool) -> DataFrame:
    """Spans of groups at one distance: each is one string, as often as it has members, however many they are."""
    own = contexts.withColumn("a", F.col("first") + F.col("left") - F.col("lo"))
    place = F.struct("doc_id", "h", "a")
    per = own.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("least")).filter("n > 1")
    out = own.join(per, ["k1", "k2"]).filter(place != F.col("least") if keep_first else F.col("lone"))
    return out.select("doc_id", "h", "a", (F.col("a") + measure.length).alias("b"))


def repeated_spans(docs: DataFrame, measure: Measure = BYTES, keep_first: bool = False, group: int = GROUP) -> DataFrame:
    """(doc_id, h, spans): spans of symbols, overlapping and in no order, of the documents (doc_id, h, t) that have repeated strings."""
    found = cut(find_anchors(docs, measure), "anchors")
    context = ["gram", "c1", "c2"]
    kinds = cut(found.groupBy(*context).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "h", "first", F.col("own_last").alias("last"), "anchor")).alias("r")), "contexts")
    often = kinds.filter("n > 1").select(*context, F.col("r.doc_id").alias("d0"), F.col("r.h").alias("h0"), F.col("r.first").alias("f0"))
    end = (F.col("last") + measure.length).alias("b")
    if keep_first:
        # all but the first place of the context; there, what follows its first period
        again = found.join(often, context).withColumn("same", (F.col("doc_id") == F.col("d0")) & (F.col("h") == F.col("h0")) & (F.col("first") == F.col("f0")))
        whole = again.filter("NOT same OR n > 1").select("doc_id", "h", F.when(F.col("same"), F.col("own_last") + 1).otherwise(F.col("first")).alias("a"), end)
    else:
        whole = found.join(often, context, "left_semi").select("doc_id", "h", F.col("first").alias("a"), end)
    shared = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("lone")).filter("kinds > 1" if keep_first else "kinds > 1 AND lone > 0").select("gram")
    wanted = kinds.join(shared, "gram").select("gram", (F.col("n") == 1).alias("lone"), "r.*")
    length, words, span = measure.length, measure.words, measure.span

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        kinds_ = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                cols = [[] for _ in names]
                symbols, offsets = measure.symbols(*string_buffers(batch.column(2)))
                size, raw = symbols.itemsize, memoryview(np.ascontiguousarray(symbols)).cast("B")
                for doc, h, base, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets.tolist(), batch.column(3)):
                    for w in wants.as_py():
                        own = raw[(base + w["first"]) * size : (base + w["last"] + length) * size].tobytes()
                        for c, v in zip(cols, (w["gram"], 0, 0, span - 1, doc, h, w["first"], w["anchor"] - w["first"], w["lone"], own)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_)], names=names)

    # a document has a bounded number of anchors: about one in a third of the length
    per_doc = wanted.groupBy("doc_id", "h").agg(F.collect_set(F.struct("gram", "lone", "first", "last", "anchor")).alias("wants"))
    rest = cut(docs.join(per_doc, ["doc_id", "h"]).select("doc_id", "h", "t", "wants").mapInArrow(fetch, CONTEXT), "suffixes")
    spans, used = [whole], [found, kinds, rest]
    while True:
        sizes = rest.groupBy("k1", "k2").agg(F.count("*").alias("members")).filter(F.col("members") > group).select("k1", "k2")
        large = cut(sizes, "large")
        used.append(large)
        if large.isEmpty():
            spans.append(compare_contexts(rest, measure, keep_first))
            break
        spans.append(compare_contexts(rest.join(large, ["k1", "k2"], "left_anti"), measure, keep_first))
        parts = cut(take_apart(rest.join(large, ["k1", "k2"], "left_semi"), measure), "suffixes")
        used.append(parts)
        spans.append(same_string(parts.filter("lo = hi"), measure, keep_first))
        rest = parts.filter("lo < hi")
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    out = cut(every.groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    drop_cut(*used)
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (), as_text: bool = False,
    measure: Measure = BYTES, keep_first: bool = False, also: Measure | None = None,
) -> DataFrame:
    """Remove every byte covered by a string of the measure's length that also starts anywhere else.

    Texts are UTF-8 bytes (or their words, each with the white space behind it); strings
    never cross documents; overlaps count; strings are judged on the input. Of
    each string all places go or, with keep_first, all but the one of the least
    (doc_id, h, start), so that every removed byte still stands in another place. Returns a
    row per row of df: doc_id, h (xxhash64 of the text), n_bytes, n_removed, n_spans
    (maximal removed runs), kept (the bytes that remain; with as_text a string without
    characters that were cut in two), n_also and n_also_spans (symbols and maximal runs that
    repeat by the measure `also`, which are not removed; 0 without it) and `carry`, columns of df in
    this order (one that has the name of another column of the result is told by its place).

    A null text is empty and, as any text shorter than a string, loses nothing. A repeated
    row is another place where its strings start, so copies lose all of
    them; with keep_first rows of equal id and text are treated alike, and count as one place. A
    null doc_id comes back null; an empty table gives an empty table; other columns are ignored.
    """
    docs = df.select(id_of(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("t"), F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("rest"))
    spans = repeated_spans(docs.drop("rest"), measure, keep_first)
    if also is not None:
        spans = spans.join(repeated_spans(docs.drop("rest"), also).withColumnRenamed("spans", "also"), ["doc_id", "h"], "full")
    else:
        spans = spans.withColumn("also", F.lit(None).cast(spans.schema["spans"].dataType))
    words = measure.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 8 << 20):
                sizes, removed, runs, kept, shared, shared_runs = [], [], [], [], [], []
                raw, offsets = string_buffers(batch.column(2))
                for lo, hi, found, more in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(3), batch.column(4)):
                    own, found, more = raw[lo:hi], merged(found.as_py() or ()), merged(more.as_py() or ())
                    if words and found:
                        begins = np.append(word_bounds(own)[0], hi - lo).tolist()
                        found = [(begins[a], begins[b]) for a, b in found]
                    ends = [0, *(x for span in found for x in span), hi - lo]
                    kept.append(b"".join(own[a:b].tobytes() for a, b in zip(ends[::2], ends[1::2])))
                    sizes.append(hi - lo), runs.append(len(found)), removed.append(hi - lo - len(kept[-1]))
                    shared.append(sum(b - a for a, b in more)), shared_runs.append(len(more))
                numbers = [pa.array(c, pa.int64()) for c in (sizes, removed, runs, shared, shared_runs)]
                left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *numbers, left, batch.column(5)], names=["doc_id", "h", "n_bytes", "n_removed", "n_spans", "n_also", "n_also_spans", "kept", "rest"]
                )

    out = docs.join(spans, ["doc_id", "h"], "left").select("doc_id", "h", "t", "spans", "also", "rest")
    kind = "string" if as_text else "binary"
    out = out.mapInArrow(run, f"doc_id long, h long, n_bytes long, n_removed long, n_spans long, n_also long, n_also_spans long, kept {kind}, rest {docs.schema['rest'].dataType.simpleString()}")
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id")
    return out.select(own, "h", "n_bytes", "n_removed", "n_spans", "n_also", "n_also_spans", "kept", *[F.col("rest")[f"c{k}"].alias(c) for k, c in enumerate(carry)])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, and the words of repeated passages of over 50 words."""
    out = remove_repeats(table(spark, sf_dir, "documents"), also=PASSAGES)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("n_also").alias("n_passage_words"), F.col("n_also_spans").alias("n_passages"))


#: All strings of a small table, counted by digest; bytes are pairs of hex digits. Likewise the rows of 51 words.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n, coalesce(text, '') AS text FROM documents),
c AS (SELECT k, n, c, substr(x, 2 * c + 1, {2 * (256 + BYTES.length)}) AS x FROM (SELECT k, x, n, unnest(range(0, n - {BYTES.length - 1}, 256)) AS c FROM d)),
w AS (SELECT k, c + i AS i, md5(substr(x, 2 * i + 1, {2 * BYTES.length})) AS h FROM (SELECT k, x, c, unnest(range(0, least(256, n - {BYTES.length - 1} - c))) AS i FROM c)),
often AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > {BYTES.length}, true) AS fresh FROM w WHERE h IN (SELECT h FROM often)),
g AS (SELECT k, i, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) AS g FROM r),
spans AS (SELECT k, min(i) AS a, max(i) + {BYTES.length} AS b FROM g GROUP BY k, g),
s AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS start FROM spans),
t AS (
  SELECT d.k, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM s JOIN d ON d.k = s.k GROUP BY d.k
),
pw AS (SELECT k, regexp_extract_all(text, '[^\x09-\x0D\x20]+') AS words FROM d),
ph AS (SELECT k, i, md5(array_to_string(list_slice(words, i + 1, i + {PASSAGES.length}), ' ')) AS h FROM (SELECT k, words, unnest(range(0, len(words) - {PASSAGES.length - 1})) AS i FROM pw)),
po AS (SELECT h FROM ph GROUP BY h HAVING count(*) > 1),
pr AS (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > {PASSAGES.length}, true) AS fresh FROM ph WHERE h IN (SELECT h FROM po)),
pg AS (SELECT k, i, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) AS g FROM pr),
ps AS (SELECT k, count(*) AS n, sum(m) AS m FROM (SELECT k, max(i) + {PASSAGES.length} - min(i) AS m FROM pg GROUP BY k, g) GROUP BY k)
SELECT doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256,
  coalesce(ps.m, 0)::BIGINT AS n_passage_words, coalesce(ps.n, 0)::BIGINT AS n_passages
FROM d LEFT JOIN t ON t.k = d.k LEFT JOIN ps ON ps.k = d.k
"""
