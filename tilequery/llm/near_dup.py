"""Operator 3: near duplicates by ProbMinHash, banding and verification.

Every shingle of five words sends exponential arrivals, at a rate of its weight, to
random registers; a register keeps the element that arrives first, so two texts agree
in a register with their probability Jaccard similarity. An element stops when its next
arrival is later than all registers of its text. A second set of registers, with all weights 1,
does the same for the Jaccard similarity of sets. Registers are banded; texts that share a
band are compared on their whole texts, and verified links are closed to classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Words, cut, drop_cut, id_of, mix64, slices, string_buffers, table, text_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
#: Estimates below this are not verified: five standard deviations under the threshold.
LEAST_ESTIMATE = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
BLOCK = 1024
#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE = 1 << 20
#: Bits of a text's bitmap of shingles.
BITS = 4096
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, count) of the distinct shingles of each text, in order of text and shingle."""
    shingle, text = Words(raw, offsets).shingles(k)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return shingle[first], text[first], np.diff(np.append(first, len(shingle)))


def prob_minhash(element: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """(n_texts, m) elements that arrive first in each register; 0 for texts without elements."""
    best = np.full(n_texts * m, np.inf)
    who = np.zeros(n_texts * m, np.uint64)
    latest = np.full(n_texts, np.inf)
    at = np.zeros(len(element))
    k = 0
    while len(element):
        h = mix64(element + np.uint64((k + 1) * int(GOLDEN) % 2**64))
        at = at - np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / weight
        alive = at < latest[text]
        if not alive.all():
            element, weight, text, at, h = element[alive], weight[alive], text[alive], at[alive], h[alive]
        register = ((mix64(h ^ GOLDEN) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        slot = text * m + register
        np.minimum.at(best, slot, at)
        won = best[slot] == at
        who[slot[won]] = element[won]
        k += 1
        if k < 8 or k % 8 == 0:
            latest = best.reshape(n_texts, m).max(1)
    return who.reshape(n_texts, m)


def sketches(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE_WORDS) -> DataFrame:
    """A row per row of df: key (md5 of its words), doc_id, h (of the text), bands, sketch (a byte per register, weighted and then unweighted), and number and weight of its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.arange(bands, dtype=np.uint64) * GOLDEN
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                n = batch.num_rows
                raw, offsets = string_buffers(batch.column(2))
                shingle, of, count = weighted_shingles(raw, offsets, k)
                who = prob_minhash(shingle, 1.0 + np.log(count), of, n, bands * rows)
                # with all weights 1; texts without repeated shingles have those already
                uneven = np.unique(of[count > 1])
                mine = np.isin(of, uneven)
                plain = who.copy()
                plain[uneven] = prob_minhash(shingle[mine], np.ones(int(mine.sum())), np.searchsorted(uneven, of[mine]), len(uneven), bands * rows)
                size = np.bincount(of, minlength=n)
                # (text, band), each once: a band that both sets of registers agree in counts once
                listed, band = [], []
                for registers, text_no in ((who, np.flatnonzero(size)), (plain[uneven], uneven)):
                    registers = registers[text_no] if registers is who else registers
                    keys = mark[None, :].repeat(len(text_no), 0)
                    for r in range(rows):
                        keys = mix64(keys * np.uint64(31) + registers[:, r::rows] + np.uint64(r))
                    listed.append(text_no.repeat(bands)), band.append(keys.ravel())
                listed, band = np.concatenate(listed), np.concatenate(band)
                order = np.lexsort((band, listed))
                listed, band = listed[order], band[order]
                new = np.ones(len(listed), bool)
                new[1:] = (listed[1:] != listed[:-1]) | (band[1:] != band[:-1])
                listed, band = np.searchsorted(listed[new], np.arange(n + 1)).astype(np.int32), band[new]
                data = raw.tobytes()
                keys = [hashlib.md5(b" ".join(data[a:b].lower().split())).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()), batch.column(0), batch.column(1),
                        pa.ListArray.from_arrays(pa.array(listed, pa.int32()), pa.array(band.view(np.int64))),
                        pa.array([x.tobytes() for x in (mix64(np.concatenate([who, plain], 1)) & np.uint64(255)).astype(np.uint8)], pa.binary()),
                        pa.array(size), pa.array(np.bincount(of, 1.0 + np.log(count), n)),
                    ],
                    names=["key", "doc_id", "h", "bands", "sketch", "size", "weight"],
                )

    own = df.select(id_of(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("t"))
    return own.mapInArrow(run, "key binary, doc_id long, h long, bands array<long>, sketch binary, size long, weight double")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of Jaccard (sets) and probability Jaccard (counts) of two sorted (shingles, counts)."""
    if len(a[0]) == 0 or len(b[0]) == 0:
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0]
    shared = int(both.sum())
    if not shared:
        return 0.0
    out = shared / (len(a[0]) + len(b[0]) - shared)
    if out < THRESHOLD and (a[1].max() > 1 or b[1].max() > 1):
        x = 1.0 + np.log(np.concatenate([a[1][at[both]], np.delete(a[1], at[both]), np.ones(len(b[0]) - shared)]))
        y = 1.0 + np.log(np.concatenate([b[1][both], np.ones(len(a[0]) - shared), b[1][~both]]))
        x[len(a[0]) :] = 0.0
        y[shared : len(a[0])] = 0.0
        pairs, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
        common = (pairs > 0).all(1)
        ratio = np.maximum(pairs[None, :, 0] / pairs[common, None, 0], pairs[None, :, 1] / pairs[common, None, 1])
        out = max(out, float((n[common] / (ratio * n).sum(1)).sum()))
    return out


#: Tasks that the partners of one text are dealt over.
SALTS = 16


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) of keys whose whole texts are as similar as the threshold.

    The partners of a text are dealt over SALTS groups. A group is sent the text once, before its partners, and
    keeps its shingles while they stream by; so a text with a million near copies isn't sent a million times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in (part for whole in batches for part in slices(whole, "t", SLICE)):
            raw, offsets = string_buffers(batch.column(3))
            shingle, of, count = weighted_shingles(raw, offsets, k)
            first = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
            keep = []
            for n, is_pivot in enumerate(batch.column(2).to_pylist()):
                own = shingle[first[n] : first[n + 1]], count[first[n] : first[n + 1]]
                if is_pivot:
                    pivot = own[0].copy(), own[1].copy()
                keep.append(not is_pivot and similarity(pivot, own) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    text_of_key = lambda name: texts.select(F.col("key").alias(name), "t")
    pivots = salted.select("a", "salt").distinct().join(text_of_key("a"), "a").select("a", F.col("a").alias("b"), F.lit(True).alias("is_pivot"), "t", "salt")
    partners = salted.join(text_of_key("b"), "b").select("a", "b", F.lit(False).alias("is_pivot"), "t", "salt")
    dealt = pivots.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("is_pivot"))
    return dealt.select("a", "b", "is_pivot", "t").mapInArrow(run, "a binary, b binary")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger share of equal bytes of the weighted and the unweighted halves of sketches, row by row."""
    return (a == b).reshape(len(a), 2, -1).mean(2).max(1)


def estimated(pairs: DataFrame, nodes: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """The pairs whose sketches agree, in either half, in a share of bytes of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (string_buffers(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(agreement(a, b) >= least))

    sa, sb = nodes.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), nodes.select(F.col("key").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the least key of each connected component, for keys that have links.

    Labels go to neighbours and jump to their label's label until nothing changes; each
    round is written to the shared folder."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        up = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("up"))
        jump = labels.select(F.col("key").alias("up"), F.col("label").alias("far"))
        new = cut(up.join(jump, "up").select("key", F.least("up", "far").alias("label"), "old"), "labels")
        changed = new.filter("label <> old").limit(1).count()
        drop_cut(labels)
        labels = new
        if not changed:
            drop_cut(edges)
            return labels


def unshared(texts: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(key, lone, lone_weight): number and weight of the shingles that no other of the texts has; none: no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                raw, offsets = string_buffers(batch.column(1))
                shingle, of, count = weighted_shingles(raw, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle.view(np.int64)), batch.column(0).take(pa.array(of)), pa.array(1.0 + np.log(count))], names=["shingle", "key", "w"]
                )

    rows = texts.select("key", "t").mapInArrow(run, "shingle long, key binary, w double")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("w").alias("w")).filter("n = 1")
    return once.groupBy("key").agg(F.count("*").alias("lone"), F.sum("w").alias("lone_weight"))


def bitmaps(texts: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(key, bits): which of BITS values the hashes of a text's shingles take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                raw, offsets = string_buffers(batch.column(1))
                shingle, of, _ = weighted_shingles(raw, offsets, k)
                flags = np.zeros((batch.num_rows, BITS), bool)
                flags[of, (shingle % np.uint64(BITS)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(flags, axis=1)], pa.binary())], names=["key", "bits"])

    return texts.select("key", "t").mapInArrow(run, "key binary, bits binary")


def crossing(rows: DataFrame, least: float = LEAST_ESTIMATE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs in buckets that hold several components, between components only.

    A bucket's main component is not compared with itself. The others (outside) meet all
    rows of the bucket, in blocks of BLOCK rows a side, so a task holds two blocks
    however large the bucket is. Emitted are pairs whose sketches agree enough and that
    can be as similar as the threshold: they share at most the shingles that each has in
    common with any other text (size - lone), so their Jaccard similarity is at most
    c / (a + b - c), and their probability Jaccard at most the smaller share of weight; and
    they differ in at least x shingles, the bits in which their bitmaps differ, so their
    Jaccard similarity is at most (a + b - x) / (a + b + x).
    Variants of one text whose own changes make them unlike all others drop out here, before
    they meet the others.
    """
    threshold -= 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            keys, comps, left = t["key"].to_pylist(), t["comp"].to_pylist(), np.asarray(t["left"])
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(keys), -1)
            size, shared, weight, part = (np.asarray(t[c]) for c in ("size", "shared", "weight", "part"))
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint8).reshape(len(keys), -1)
            group = np.stack([np.asarray(t[c]) for c in ("bkey", "i", "j")], 1)
            new = np.ones(len(keys), bool)
            new[1:] = (group[1:] != group[:-1]).any(1)
            a, b = [], []
            for s, e in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(keys))):
                out, all_ = np.flatnonzero(left[s:e]) + s, np.flatnonzero(~left[s:e]) + s
                for x in out:
                    most = np.minimum(shared[all_], shared[x])
                    can = most >= threshold * (size[all_] + size[x] - most)
                    # all counts 1: both similarities are one
                    uneven = (weight[all_] > size[all_]) | (weight[x] > size[x])
                    can |= uneven & (np.minimum(part[all_] / weight[all_], part[x] / weight[x]) >= threshold)
                    near, uneven = all_[can], uneven[can]
                    if len(near):
                        differ, both = np.bitwise_count(bits[near] ^ bits[x]).sum(1, dtype=np.int64), size[near] + size[x]
                        can = uneven | (both - differ >= threshold * (both + differ))
                        near = near[can & (agreement(sketch[near], sketch[x]) >= least)]
                    for y in near:
                        if comps[x] != comps[y]:
                            a.append(min(keys[x], keys[y])), b.append(max(keys[x], keys[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            same = np.ones(rest.num_rows, bool)
            for c in ("bkey", "i", "j"):
                v = np.asarray(rest[c])
                same &= v == v[-1]
            done = int(np.argmax(same))
            if done:
                yield pairs(rest.slice(0, done))
                rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    blocks, out_blocks = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n_out") / BLOCK)
    own, sizes = F.xxhash64("key"), ["size", "shared", "weight", "part", "bits"]
    rows = rows.filter((F.col("shared") >= threshold * F.col("size")) | (F.col("part") >= threshold * F.col("weight")))
    base = rows.withColumn("bj", F.pmod(own, blocks).cast("int")).withColumn("bi", F.pmod(own, out_blocks).cast("int"))
    right = base.select("bkey", F.explode(F.sequence(F.lit(0), out_blocks.cast("int") - 1)).alias("i"), F.col("bj").alias("j"), "key", "comp", "sketch", *sizes, F.lit(False).alias("left"))
    left = base.filter("comp <> main").select("bkey", F.col("bi").alias("i"), F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("j"), "key", "comp", "sketch", *sizes, F.lit(True).alias("left"))
    dealt = right.union(left).repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Classes of near-duplicate texts.

    Returns a row per row of df: doc_id, h (xxhash64 of the text), class_id (least doc_id of
    the class), class_size and keep (true for the rows of the class's first document by
    (doc_id, h); repeated rows of it are all true). Similarity is that of five-word shingles
    of white-space separated words with ASCII letters folded: the larger of Jaccard and
    probability Jaccard with weights 1 + ln(count); a text of one to four words is one
    shingle. Classes are the connected components of pairs at or above the threshold.
    A pair exactly at 0.8 shares no band with probability 7e-6.

    Texts of the same words, however many, are one node of the graph. Null and empty
    texts are copies of each other. A null doc_id comes back null. An empty table gives
    an empty table; other columns are ignored.
    """
    rows = cut(sketches(df, text, doc_id), "sketches")
    nodes = cut(rows.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("rep"), *[F.first(c).alias(c) for c in ("bands", "sketch", "size", "weight")]), "nodes")
    members = nodes.select("key", F.explode("bands").alias("bkey"))
    sizes = members.groupBy("bkey").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(members.join(sizes, "bkey"), "members")
    # the pivot of a bucket: the text that shares most places in buckets, hence most central
    central = members.groupBy("key").agg(F.sum("n").alias("c"))
    pivots = members.join(central, "key").groupBy("bkey").agg(F.max(F.struct("c", "key")).alias("p")).select("bkey", F.col("p.key").alias("a"))
    star = members.join(pivots, "bkey").filter("key <> a").select("a", F.col("key").alias("b")).distinct()
    star = cut(estimated(star, nodes), "star")
    texts = _texts(df, text, doc_id, nodes, members)
    links = cut(verified(star, texts, threshold), "links")
    first_labels = labels = components(links)
    rest = members.join(labels.drop("old"), "key", "left").select("bkey", "key", "n", F.coalesce("label", "key").alias("comp"))
    mains = rest.groupBy("bkey", "comp").agg(F.count("*").alias("k"), F.max("n").alias("n")).groupBy("bkey").agg(
        F.max(F.struct("k", "comp")).alias("m"), F.max("n").alias("total")
    )
    mains = mains.filter("m.k < total").select("bkey", F.col("m.comp").alias("main"), (F.col("total") - F.col("m.k")).alias("n_out"))
    rest = cut(rest.join(mains, "bkey"), "rest")
    open_texts = texts.join(rest.select("key").distinct(), "key", "left_semi")
    sizes = nodes.select("key", "sketch", "size", "weight").join(bitmaps(open_texts), "key").join(unshared(open_texts), "key", "left")
    sizes = sizes.withColumn("shared", F.col("size") - F.coalesce("lone", F.lit(0))).withColumn("part", F.col("weight") - F.coalesce("lone_weight", F.lit(0.0)))
    more = cut(crossing(rest.join(sizes.drop("lone", "lone_weight"), "key"), threshold=threshold), "crossing")
    more_links = cut(verified(more, texts, threshold), "links")
    labels = components(links.union(more_links))
    known = rows.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("n"))
    known = known.join(labels.drop("old"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    classes = known.groupBy("label").agg(F.min("rep").alias("rep"), F.sum("n").alias("class_size"))
    of = known.select("key", "label").join(classes, "label").select("key", "rep", "class_size")
    out = rows.select("key", "doc_id", "h").join(of, "key")
    real = lambda c: F.when(c != NULL_ID, c)
    out = out.select(
        real(F.col("doc_id")).alias("doc_id"), "h", real(F.col("rep.doc_id")).alias("class_id"), "class_size",
        ((F.col("doc_id") == F.col("rep.doc_id")) & (F.col("h") == F.col("rep.h"))).alias("keep"),
    )
    done = cut(out, "classes")
    drop_cut(rows, nodes, members, star, texts, links, first_labels, rest, more, more_links, labels)
    return done


def _texts(df: DataFrame, text: str, doc_id: str, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(key, t) of the keys in buckets with others, each from its first document."""
    needed = nodes.select("key", "rep.doc_id", "rep.h").join(members.select("key").distinct(), "key", "left_semi")
    own = df.select(id_of(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("t"))
    return cut(own.join(needed, ["doc_id", "h"]).select("key", "t").dropDuplicates(["key"]), "texts")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


#: All pairs by an exact join of shingles, both similarities, and the closure of the links; for small tables.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), k AS (SELECT doc_id, array_to_string(w, ' ') AS key FROM d), n AS (SELECT DISTINCT array_to_string(w, ' ') AS key, w FROM d),
s AS (
  SELECT key, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT key, w, unnest(range(1, len(w) - 3)) AS i FROM n)
  UNION ALL SELECT key, key FROM n WHERE len(w) BETWEEN 1 AND 4
), c AS (SELECT md5(key) AS key, s, 1 + ln(count(*)) AS x FROM s GROUP BY ALL), z AS (SELECT key, count(*) AS n, max(x) AS most FROM c GROUP BY 1),
p AS (
  SELECT a.key AS a, b.key AS b, count(*) AS shared FROM c a JOIN c b ON a.s = b.s AND a.key < b.key GROUP BY ALL
), j AS (SELECT a, b, shared / (y.n + z.n - shared) AS j, greatest(y.most, z.most) > 1 AS often FROM p JOIN z y ON y.key = a JOIN z ON z.key = b),
near AS (SELECT a, b FROM j WHERE j < 0.8 AND often AND j >= 0.4),
u AS (SELECT near.a, near.b, s, sum(x) FILTER (key = near.a) AS x, sum(x) FILTER (key = near.b) AS y FROM near JOIN c ON key IN (near.a, near.b) GROUP BY ALL),
g AS (SELECT a, b, coalesce(x, 0) AS x, coalesce(y, 0) AS y, count(*) AS n FROM u GROUP BY ALL),
weighted AS (
  SELECT a, b, sum(n / total) AS j FROM (SELECT i.a, i.b, i.x, i.y, i.n, sum(greatest(o.x / i.x, o.y / i.y) * o.n) AS total FROM g i JOIN g o ON o.a = i.a AND o.b = i.b WHERE i.x > 0 AND i.y > 0 GROUP BY ALL) GROUP BY ALL
), l AS (SELECT a, b FROM j WHERE j >= 0.8 UNION SELECT a, b FROM weighted WHERE j >= 0.8),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT key, doc_id, coalesce((SELECT least(min(r.b), md5(key)) FROM r WHERE r.a = md5(key)), md5(key)) AS c FROM k)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id, count(*) OVER (PARTITION BY c) AS class_size FROM m
"""
