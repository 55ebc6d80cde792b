"""Operator 5: quality classification by importance resampling.

Two generative models over hashed n-grams (words, pairs of neighbouring words, and both of word shapes; each counted once
a document), one of labelled good text and one of all text, give every document an importance weight, the product of its
n-grams' probability ratios. Documents are sampled without replacement by Gumbel top-k over the log weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, NULL_ID, Words, byte_values, cut, id_of, mix64, powers, slices, string_buffers, table, text_of

#: The lower half is for single words, three eighths for pairs, the last eighth for shapes.
BUCKETS = 1 << 19
#: At most so many labelled good documents fit the target model.
TARGET_DOCS = 20_000
#: Pseudo-count of an n-gram in either model, on the scale of the target's counts.
SMOOTHING = 1.0
#: A labelled good document that is lost weighs so many times one of the others that is kept.
KEEP_WEIGHT = 4.0
#: Ratios within so many standard deviations of 1 count as 1.
DEVIATIONS = 4.0
#: Relative deviation of counts between like bodies of text (groups of copies, topics), besides that of chance.
SPREAD = 0.15
#: N-grams of so many documents count half when the scale of the models is taken.
HALF_WEIGHT = 100


def shapes(raw: np.ndarray, words: Words) -> np.ndarray:
    """A hash of each word's shape: runs of capitals, of small or other letters, of digits, and of each other sign, one symbol each."""
    kind = np.arange(256)
    kind[65:91], kind[97:123], kind[128:], kind[48:58] = 65, 97, 97, 48
    symbol = kind[raw]
    new = np.ones(len(raw), bool)
    new[1:] = symbol[1:] != symbol[:-1]
    new[words.starts] = True
    rank = np.cumsum(new)  # symbols up to here
    n = int(rank[-1]) if len(rank) else 0
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values()[symbol[new]] * powers(BASE, n), out=prefix[1:])
    first = rank[words.starts] - 1 if len(words.starts) else np.zeros(0, np.int64)
    last = rank[words.ends - 1] if len(words.starts) else first
    return mix64((prefix[last] - prefix[first]) * powers(BASE_INVERSE, n + 1)[first] + (last - first).astype(np.uint64))


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the n-grams of each text, each once a text: its words without
    closing punctuation, its pairs of neighbouring words, and the shapes of its words and
    pairs, each with the eighth of the text's words that it makes up. The shape of a pair
    tells besides whether its words are the same.
    """
    closing = np.zeros(256, bool)
    closing[[ord(c) for c in ".,;:!?"]] = True
    words = Words(raw, offsets, closing=closing)
    n = np.diff(words.first)
    of = np.repeat(np.arange(len(n)), n)
    two = np.flatnonzero(of[1:] == of[:-1])  # first words of pairs
    join = lambda x, y, z=0: mix64(x * np.uint64(BASE) + mix64(y + np.uint64(z)))
    pair = join(words.hash[two], words.hash[two + 1])
    shape = shapes(raw, words)
    same = (words.hash[two] == words.hash[two + 1]).astype(np.uint64)
    kinds = np.concatenate([shape, join(shape[two], shape[two + 1] + same, 1)])
    whose = np.concatenate([of, of[two]])
    order = np.lexsort((kinds, whose))
    kinds, whose = kinds[order], whose[order]
    head = np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]) | (whose[1:] != whose[:-1]))) if len(kinds) else np.zeros(0, np.int64)
    count, kinds, whose = np.diff(np.append(head, len(order))), kinds[head], whose[head]
    level = -(-8 * count // np.maximum(n[whose], 1))
    half, most = buckets // 2, buckets - buckets // 8
    grams = np.concatenate([words.hash % np.uint64(half), np.uint64(half) + pair % np.uint64(most - half), np.uint64(most) + mix64(kinds + level.astype(np.uint64)) % np.uint64(buckets - most)])
    key = np.unique(np.concatenate([of, of[two], whose]) * buckets + grams.astype(np.int64))
    return key % buckets, key // buckets


def good_ids(labels: DataFrame, most: int) -> list[int]:
    """Up to `most` ids labelled good and not toxic (in all their rows), in the order of a hash of the id."""
    per = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = per.filter((F.col("q") == 1) & (F.col("t") == 0))
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()]


def ngram_counts(docs: DataFrame, good: np.ndarray, buckets: int) -> np.ndarray:
    """(2, buckets) counts over all documents and over the good ones; tasks add up their own before anything moves."""
    handed = docs.sparkSession.sparkContext.broadcast(np.sort(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for whole in batches:
            for batch in slices(whole, "t", 2 << 20):
                raw, offsets = string_buffers(batch.column(2))
                bucket, of = features(raw, offsets, buckets)
                chosen = np.isin(np.asarray(batch.column(0)), handed.value)[of]
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[chosen], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "good"])

    summed = docs.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    got = summed.toArrow()  # at most a row per bucket
    out = np.zeros((2, buckets), np.int64)
    at = np.asarray(got["bucket"])
    out[0, at], out[1, at] = np.asarray(got["raw"]), np.asarray(got["good"])
    return out


def typical_share(counts: np.ndarray) -> float:
    """The target's share in the count of a typical n-gram: the median over running text, in which n-grams weigh less the rarer they are.

    With the raw model on this scale an n-gram that is as typical of the target as most
    are has ratio 1, and a long document doesn't gain weight by its length alone."""
    raw, good = counts[0].astype(np.float64), counts[1].astype(np.float64)
    at = np.flatnonzero(raw)
    if not len(at):
        return 0.0
    share = good[at] / raw[at]
    order = np.argsort(share, kind="stable")
    total = np.cumsum((raw[at] ** 2 / (raw[at] + HALF_WEIGHT))[order])
    return float(share[order][np.searchsorted(total, total[-1] / 2)])


def log_weights(docs: DataFrame, counts: np.ndarray, good: np.ndarray, smoothing: float) -> DataFrame:
    """(doc_id, h, n, log_weight); a document's own n-grams are taken out of both models before it is weighed, and
    a ratio is drawn towards 1 by DEVIATIONS times its own uncertainty, so rare n-grams say nothing."""
    buckets = counts.shape[1]
    scale = typical_share(counts)
    handed = docs.sparkSession.sparkContext.broadcast((counts.astype(np.float64), np.sort(good)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (raw, target), ids = handed.value
        for whole in batches:
            for batch in slices(whole, "t", 2 << 20):
                text, offsets = string_buffers(batch.column(2))
                bucket, of = features(text, offsets, buckets)
                own = np.isin(np.asarray(batch.column(0)), ids)[of]
                expected = np.maximum(raw[bucket] - 1, 0) * scale + smoothing
                ratio = np.log((np.maximum(target[bucket] - own, 0) + smoothing) / expected)
                ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - DEVIATIONS * np.sqrt(1 / expected + SPREAD**2), 0)
                weight = np.bincount(of, ratio, batch.num_rows)
                size = np.bincount(of, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int64)), pa.array(weight.astype(np.float64))], names=["doc_id", "h", "n", "log_weight"])

    return docs.mapInArrow(run, "doc_id long, h long, n long, log_weight double")


def sample_size(scores: DataFrame, labels: DataFrame, keep_weight: float = KEEP_WEIGHT) -> int:
    """Documents at or above the weight that parts labelled good documents best from the others.

    Labels meet scores (no texts) by id; classes are counted in quarters of a unit of weight."""
    per = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q IS NOT NULL AND t IS NOT NULL")
    unit = F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(4 * F.col("log_weight")))).alias("unit")
    seen = scores.join(per, "doc_id").groupBy(unit, ((F.col("q") == 1) & (F.col("t") == 0)).alias("good")).count().collect()
    every = {r[0]: r[1] for r in scores.groupBy(unit).count().collect()}
    good, bad = np.zeros(4001), np.zeros(4001)
    for r in seen:
        (good if r["good"] else bad)[int(r["unit"]) + 2000] += r["count"]
    if not good.sum() or not bad.sum():
        return sum(every.values())
    lost = np.concatenate([[0], np.cumsum(good)])[:-1] / good.sum()
    let_in = np.cumsum(bad[::-1])[::-1] / bad.sum()
    least = int(np.argmin(keep_weight * lost + let_in)) - 2000
    return sum(n for u, n in every.items() if u >= least)


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of column `key`, by histograms of ever smaller ranges."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            return low
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("at")
        counted = keys.filter(F.col("key").between(low, high)).groupBy(at).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        above = 0
        for r in sorted(counted, key=lambda r: -r["at"]):
            if above + r["n"] >= k:
                k -= above
                if (r["a"], r["b"]) == (low, high):
                    return low
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return low


def importance_resample(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS,
    target_docs: int = TARGET_DOCS, smoothing: float = SMOOTHING, k: int | None = None, seed: int = 0,
) -> DataFrame:
    """Weigh all documents and keep k of them by Gumbel top-k.

    labels: doc_id, quality, toxic. The target model is fitted on up to target_docs labelled
    good documents, the raw model on all documents. k: how many to keep; else as many as lie
    on the good side of the weight that parts the labelled documents best.

    Returns a row per row of df: doc_id, h (xxhash64 of the text), log_weight, key (with its
    Gumbel noise, drawn from a hash of the row) and kept. Null and empty texts have
    log weight 0. Rows tied with the k-th, repeated rows above all, are kept with it. A null
    doc_id comes back null. Without labelled good documents all weights are 0 and all rows
    are kept; an empty table gives an empty table; other columns are ignored.
    """
    docs = df.select(id_of(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("t"))
    good = np.asarray(good_ids(labels, target_docs), np.int64)
    counts = ngram_counts(docs, good, buckets)
    if not counts[1].sum():
        scores = docs.select("doc_id", "h", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("log_weight"))
    else:
        scores = log_weights(docs, counts, good, smoothing)
    uniform = ((F.xxhash64("doc_id", "h", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) + 0.5) / float(1 << 52)
    scores = cut(scores.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    if k is None:
        k = sample_size(scores, labels) if counts[1].sum() else scores.count()
    least = kth_largest(scores, k)
    kept = F.col("key") >= least if least is not None else F.lit(False)
    return scores.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "h", "log_weight", "key", kept.alias("kept"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("log_weight", 6).alias("log_weight"), "kept")
