"""Operators on embeddings against numpy and brute force."""

import collections
import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequery.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, score string, block string"
BAD = [None, [], [1.0, None, 2.0, 0.0], [1.0, math.nan, 2.0, 0.0], [math.inf, 1.0, 2.0, 0.0], [1.0, 2.0]]


def vectors(n, d, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1 + k) for k in range(d)], rnd.randrange(3), i, "clash", "clash") for i in range(n)]
    return rows + [rows[5], rows[5], (None, rows[7][1], 1, None, None, None), (n + 1, rows[8][1], None, 1, None, None)]


def integers(rows, scale, shift, d):
    out = []
    for r in rows:
        v = r[1]
        if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v):
            out.append((r, [math.floor(scale * float(np.float32(c))) + shift for c in v]))
    return out


@pytest.mark.parametrize("d", [1, 4, 11])
def test_whitening_equals_numpy(spark, d):
    rows = vectors(60, d, d) + [(900 + k, v, 1, 1, None, None) for k, v in enumerate(BAD) if v is None or len(v) != d]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    own = integers(rows, 1024, 100_000, d)
    x = np.array([v for _, v in own], dtype=object)
    n, s = len(x), x.sum(0)
    deviations = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    centred = (x - np.array([float(t) / n for t in s])).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    want = centred @ basis / np.sqrt(values)
    assert len(got) == n * min(8, d) and {r.n for r in got} == {n}
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == collections.Counter((r[0], v) for (r, _), v in zip(own, deviations))
    total = sum(deviations) / n**3
    sign = {}
    for k in range(min(8, d)):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        assert all(abs(r.explained / (values[k] / total) - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine.values())
        for (row, _), w in zip(own, want[:, k]):
            sign.setdefault(k, np.sign(mine[row[0]].whitened) * np.sign(w))
            assert abs(mine[row[0]].whitened * sign[k] - w) < 1e-7


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None, 1, 1, None, None)])).count() == 0
    assert whitening.whiten(frame([(i, [1.0, 2.0], 1, 1, None, None) for i in range(5)])).count() == 0
    # one direction of variance only: the others aren't returned
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 0.5], 1, 1, None, None) for i in range(9)])).collect()
    assert len(line) == 9 and {r.component for r in line} == {1} and line[0].identity_error < 1e-9 and abs(line[0].explained - 1) < 1e-9


def brute(rows, d, positives, negatives):
    own = [(k, r[0], r[2], np.array(v, dtype=object)) for k, (r, v) in enumerate(integers(rows, 256, 0, d)) if r[0] is not None and r[2] is not None]
    out = collections.Counter()
    for k, i, lab, x in own:
        if i % 10:
            continue
        scored = sorted(((-int(x @ y), j, other, m) for m, j, other, y in own if m != k))
        for p in [t for t in scored if t[2] == lab][:positives]:
            near = [t for t in scored if t[2] != lab and 30 * -p[0] <= 100 * -t[0] <= 90 * -p[0]][:negatives]
            out.update((i, p[1], rank + 1, t[1], -p[0], -t[0]) for rank, t in enumerate(near))
    return out


@pytest.mark.parametrize(("d", "chunk", "grid", "size"), [(4, 3, 1, 7), (11, 4, 2, 16), (4, 32, 4, 1000)])
def test_hard_negatives_equal_brute_force(spark, d, chunk, grid, size):
    rows = vectors(150, d, 3) + [(900 + k, v, 1, 1, None, None) for k, v in enumerate(BAD) if v is None or len(v) != d]
    rows += [(1000 + k, rows[3][1], k % 3, 1, None, None) for k in range(20)]  # ties
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, positives=4, negatives=6, anchor_block=size, row_block=size * 2, chunk=chunk, grid=grid).collect()
    key = lambda r: (r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
    want = brute(rows, d, 4, 6)
    assert collections.Counter(map(key, got)) == want and len(want) > 50


def test_scores_beyond_floating_point(spark):
    big = [(i, [float(2**18) + i, float(i), 2.0**19], i % 2, 1, None, None) for i in range(30)]
    got = hard_negatives.mine(spark.createDataFrame(big, SCHEMA), F.col("vec_id") % 10 == 0, positives=2, negatives=3, low=1, high=1000).collect()
    assert got and max(r.negative_score for r in got) > 2**53
    assert all(r.negative_score == sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(big[r.anchor_id][1], big[r.negative_id][1])) for r in got)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(10, [1.0], 1, 1, None, None), (11, None, 1, 1, None, None)], SCHEMA)
    assert hard_negatives.mine(one, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(one, F.col("vec_id") == -1).count() == 0


def test_hard_negatives_write_no_scores(spark, monkeypatch):
    """What is written grows with the vectors and the result, not with anchors times rows; a vector in many copies gives ties over all blocks."""
    rnd, d = np.random.default_rng(5), 6
    x = rnd.normal(size=(3000, d)).astype(np.float32)
    x[rnd.random(3000) < 0.4] = x[7]
    labels, ids = rnd.integers(0, 3, 3000), rnd.permutation(3000)
    paths, written = [], hard_negatives.cut

    def cut(df, name):
        out = written(df, name)
        paths.append(sum(f.stat().st_size for f in pathlib.Path(out._tilequery_path.removeprefix("file://")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(hard_negatives, "cut", cut)
    frame = spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, labels)], "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(frame.repartition(3), F.col("vec_id") % 5 == 0, positives=3, negatives=4, anchor_block=64, row_block=128, grid=3).toPandas()
    assert sum(paths) < 3_000_000  # 600 x 3,000 scores are 14 MB
    ints = np.floor(256 * x.astype(float)).astype(np.int64)
    want = set()
    for a in np.flatnonzero(ids % 5 == 0)[::10]:
        s = ints @ ints[a]
        order = [o for o in np.lexsort((ids, -s)) if o != a]
        for p in [o for o in order if labels[o] == labels[a]][:3]:
            near = [o for o in order if labels[o] != labels[a] and 30 * s[p] <= 100 * s[o] <= 90 * s[p]][:4]
            want |= {(ids[a], ids[p], k + 1, ids[o], s[p], s[o]) for k, o in enumerate(near)}
    own = got[got.anchor_id.isin(ids[np.flatnonzero(ids % 5 == 0)[::10]])]
    assert {tuple(r) for r in own.itertuples(index=False)} == want and len(own) == len(want) > 200
