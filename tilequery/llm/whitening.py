"""Operator 12: whitening of embeddings by the singular value decomposition of distributed rows.

Entries become integers, so counts and sums are exact. The rows less their mean form a
distributed matrix in the JVM, which MLlib decomposes; a singular value s of it stands for
the eigenvalue s*s/n of the covariance with divisor n. The total variance isn't taken from
the decomposition but from the exact deviations of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SCALE, SHIFT = 1024, 100_000
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def finite(column: str) -> Column:
    """The vector is there and all its entries are numbers."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(False))


def of_one_length(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows with a finite vector of the most frequent length, of equally frequent ones the longest."""
    rows = vectors.filter(finite(embedding))
    sizes = rows.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(embedding) == (sizes["d"] if sizes else 0))


def scaled_integers(embedding: str, scale: int, shift: int) -> Column:
    """floor(scale * entry) + shift of the entries of a finite vector."""
    x = F.transform(embedding, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + shift)
    # Spark may take this before the rows are filtered
    return F.when(finite(embedding), x)


def fit_list(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): the integer vectors that take part, all of one length."""
    return of_one_length(vectors, embedding).select(F.col(vec_id).cast("long").alias("vec_id"), scaled_integers(embedding, SCALE, SHIFT).alias("x"))


def whiten(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Project every vector on the components of greatest variance, each scaled to variance 1.

    Returns a row per remaining vector and component (numbered from 1 by falling
    variance): vec_id, component, n (vectors in all), deviation (the vector's exact
    sum of squares of n*x-S), whitened, explained (the component's share of the
    total variance) and identity_error (one value: the largest entry of the covariance of
    whitened less the identity, taken over all vectors).

    Null and empty vectors and those with a null or non-finite entry go, as do vectors
    of another length than the most frequent one (of equally frequent ones the longest). Components
    without variance are not returned; equal vectors only, or an empty table, give no rows. Repeated rows and null ids count
    and return each for itself. A sum beyond 64 bits (entries beyond about 2**40) fails, it doesn't give
    wrong figures. Other columns are ignored. Moved are sums and the d x d Gram matrix, which
    MLlib brings to the driver: d is the length of a vector, whatever their number.
    """
    spark = vectors.sparkSession
    rows = fit_list(vectors, vec_id, embedding)
    sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not sums:
        return spark.createDataFrame([], SCHEMA)
    n, s = sums[0]["n"], [r["s"] for r in sums]
    mean = np.array([float(Fraction(v, n)) for v in s])
    mean_literal, s_literal = F.array(*map(F.lit, mean.tolist())), F.array(*[F.lit(v).cast("long") for v in s])

    apart = F.zip_with("x", s_literal, lambda x, t: (F.lit(n).cast("long") * x - t).cast("decimal(19,0)"))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))
    rows = rows.withColumn("deviation", deviation)
    total = rows.agg(F.sum("deviation")).first()[0]  # n**3 times the total variance
    if not total:
        return spark.createDataFrame([], SCHEMA)

    centred = rows.select(array_to_vector(F.zip_with("x", mean_literal, lambda x, m: x - m)).alias("row"))
    # all components are asked for: MLlib then solves the Gram matrix by LAPACK, to double precision
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row")).computeSVD(len(s), computeU=False)
    sigma = np.asarray(svd.s.toArray())
    # what is left of a direction without variance is rounding
    sigma = sigma[sigma**2 > sigma[0] ** 2 * len(s) * np.finfo(float).eps][:components]
    basis = np.asarray(svd.V.toArray())[:, : len(sigma)]
    eigen = sigma * sigma / n
    explained = [float(e / (Fraction(int(total)) / n**3)) for e in eigen]
    scaled = basis / np.sqrt(eigen)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, len(mean))
                w = (x - mean) @ scaled
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, np.ascontiguousarray(w.T))], names=["vec_id", "deviation", *names])

    names = [f"w{k}" for k in range(len(sigma))]
    schema = "vec_id long, deviation decimal(38,0), " + ", ".join(f"{c} double" for c in names)
    done = cut(rows.select("vec_id", "deviation", "x").mapInArrow(project, schema), "whitened")
    middle = done.agg(*[F.avg(c).alias(c) for c in names]).first()
    cells = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    products = [F.sum((F.col(names[i]) - middle[i]) * (F.col(names[j]) - middle[j])) for i, j in cells]
    error = max(abs(v / n - (i == j)) for v, (i, j) in zip(done.agg(*products).first(), cells))

    each = F.posexplode(F.array(*[F.struct(F.col(c).alias("w"), F.lit(e).alias("e")) for c, e in zip(names, explained)])).alias("k", "v")
    return done.select("vec_id", "deviation", each).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("v.w").alias("whitened"), F.col("v.e").alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
