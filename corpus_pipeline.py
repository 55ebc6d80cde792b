"""Corpus pipeline over `documents`: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame; all but the last return the columns of documents. run() writes each stage's
result as Parquet into the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.llm.common import cut, drop_paths, id_of, table, tables_written, text_of
from tilequery.llm.decontaminate import leaks
from tilequery.llm.importance import importance_resample
from tilequery.llm.near_dup import near_duplicates
from tilequery.llm.packing import packed
from tilequery.llm.suffix_dedup import PASSAGES, remove_repeats


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns numbered, so that none can clash, and the key of a row: its id and its text's hash; the numbered names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    key = [id_of(at["doc_id"]).alias("key_id"), F.xxhash64(text_of(at["text"])).alias("key_h")]
    return docs.toDF(*names).select("*", *key), names


def _chosen(docs: DataFrame, rows: DataFrame, how: str, once: bool = False) -> DataFrame:
    """The documents that are (left_semi) or aren't (left_anti) among rows (doc_id, h); once: one row of each key."""
    keyed, names = _keyed(docs)
    keys = rows.select(id_of("doc_id").alias("key_id"), F.col("h").alias("key_h"))
    out = keyed.join(keys, ["key_id", "key_h"], how)
    return (out.dropDuplicates(["key_id", "key_h"]) if once else out).select(names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling doesn't draw go."""
    scored = importance_resample(docs, table(spark, sf_dir, "labels"))
    return _chosen(docs, scored.filter("kept"), "left_semi")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the least doc_id."""
    return _chosen(docs, near_duplicates(docs).filter("keep"), "left_semi", once=True)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each passage of over 50 words that repeats, all places but the first are cut out of the texts; every document stays."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = remove_repeats(docs, carry=carry, as_text=True, measure=PASSAGES, keep_first=True)
    # the result's own columns come first, then those carried, each told by its place
    own = len(out.columns) - len(carry)
    place = {c: own + k for k, c in enumerate(carry)} | {"doc_id": 0, "text": out.columns.index("kept")}
    out = out.toDF(*[f"c{k}" for k in range(len(out.columns))])
    text = F.col(f"c{place['text']}")
    return out.select(*[F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"c{place[c]}").alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return _chosen(docs, found, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [("quality", quality), ("near_dup", near_dup), ("repeats", repeats), ("benchmark", benchmark), ("packing", packing)]

#: Tokenisation, suffix sorting and resampling can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with tables_written() as own:
            docs = cut(stage(spark, docs, sf_dir), name)
            # what the stage wrote for itself, and its input, are read no more
            drop_paths(spark, [*before, *own[:-1]])
        before = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
