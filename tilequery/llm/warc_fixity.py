"""Operator 4: Merkle fixity audit of WARC files and a replica of them.

Each replica has a manifest of its own: the digest, length and byte range of every record that
it holds, in its own order; only these move from there on. Over each manifest a tree is built.
A leaf is a slot of the file's key space, which the record's key alone tells, and a node covers
a range of slots and the byte offsets of their records; so a record that is absent or inserted
changes the nodes above its slot and no others. The roots of the two trees are compared, and from level to
level only the children of nodes that differ are fetched from either tree; records of
slots that differ are matched by key, digest and number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop_cut, table

FILE_RECORDS = 512
FANOUT = 16


def warc_record(url: Column, date: str, body: Column) -> Column:
    """A response record: header lines, an empty line, the body, two empty lines."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, body: Column, date: str, file_records: int = FILE_RECORDS) -> DataFrame:
    """The records that one replica holds: file_id, slot, key, page_id, length and hash.

    Files hold the pages of a range of `file_records` ids, a slot for each. A null page_id is dealt by a
    hash of its address over 1024 files with negative numbers and their slots, and its key is a hash of the address. body: what
    the replica holds of a page (null: it hasn't the record).
    """
    url = F.coalesce("url", F.lit(""))
    file_id = F.coalesce(F.floor(F.col("page_id") / file_records), -1 - F.pmod(F.crc32(url), F.lit(1024)))
    slot = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.floor(F.crc32(url) / 1024)), F.lit(file_records))
    record = warc_record(url, date, body)
    return pages.select(
        file_id.cast("long").alias("file_id"), slot.cast("long").alias("slot"), F.coalesce(F.col("page_id").cast("long"), F.xxhash64(url)).alias("key"),
        F.col("page_id").cast("long"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash"),
    ).filter("hash IS NOT NULL")


def manifest(records: DataFrame) -> DataFrame:
    """Number the records of each file and sum up their offsets: file_id, idx, slot, key, page_id, length, hash, start, end.

    Records of a file are ordered by page_id and, of one page_id, as the replica has them. They are sorted by ranges, so
    a file however large is dealt over tasks; each task numbers its part of a file, and the counts and
    bytes of a file's earlier parts are added. Written to the shared folder.
    """
    order = ["file_id", "page_id", "key", "tie"]
    # records of one page are told apart by their place in the input, else they'd all meet in one task
    dealt = records.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, size = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file_id, length = np.asarray(batch.column(0)), np.asarray(batch.column(4))
            new = np.append(True, file_id[1:] != file_id[:-1])
            first, run_of = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.cumsum(length)
            idx = np.arange(len(file_id)) - first[run_of]
            end = total - (total[first] - length[first])[run_of]
            if file_id[0] == last:
                idx[run_of == 0] += count
                end[run_of == 0] += size
            last, count, size = file_id[-1], int(idx[-1]) + 1, int(end[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(idx), part)), pa.array(idx), pa.array(end)], names=[*batch.schema.names, "part", "idx", "end"])

    own = "file_id long, slot long, key long, page_id long, length long, hash string"
    numbered = dealt.select("file_id", "slot", "key", "page_id", "length", "hash").mapInArrow(run, f"{own}, part long, idx long, end long")
    numbered = cut(numbered, "manifest_parts")
    parts = numbered.groupBy("file_id", "part").agg(F.max("idx").alias("n"), F.max("end").alias("bytes"))
    before = Window.partitionBy("file_id").orderBy("part")
    parts = parts.withColumn("parts", F.count("*").over(Window.partitionBy("file_id"))).withColumn("n0", F.sum(F.col("n") + 1).over(before) - F.col("n") - 1)
    parts = parts.withColumn("bytes0", F.sum("bytes").over(before) - F.col("bytes"))
    # a task has at most two files that go on in other tasks, so these are at most two rows a task
    parts = parts.filter("parts > 1").select("file_id", "part", "n0", "bytes0")
    out = numbered.join(parts, ["file_id", "part"], "left")
    end = F.col("end") + F.coalesce("bytes0", F.lit(0))
    out = out.select("file_id", (F.col("idx") + F.coalesce("n0", F.lit(0))).alias("idx"), "slot", "key", "page_id", "length", "hash", (end - F.col("length")).alias("start"), end.alias("end"))
    done = cut(out, "manifest")
    drop_cut(numbered)
    return done


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def slots(manifest: DataFrame) -> DataFrame:
    """The leaves: (side, file_id, idx = slot, hash, start, end).

    The one record of a slot is its hash. Several make a set: digests with their numbers are
    put together by the first three signs of the digest, then these; so a page of any number
    of records, alike or not, never meets in one task, and their order doesn't count."""
    each = manifest.groupBy("side", "file_id", "slot", "hash").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    ends = [F.min("start").alias("start"), F.max("end").alias("end")]
    several = F.transform(F.sort_array(F.collect_list(F.struct("hash", "n"))), lambda x: F.concat(x["hash"], F.lit(":"), x["n"].cast("string")))
    single = lambda n: F.when((F.count("*") == 1) & (F.first(n) == 1), F.first("hash"))
    parts = each.groupBy("side", "file_id", "slot", F.substring("hash", 1, 3).alias("part")).agg(
        F.coalesce(single("n"), _joined(several)).alias("hash"), F.sum("n").alias("n"), *ends
    )
    own = F.coalesce(single("n"), _joined(F.transform(F.sort_array(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"])))
    return parts.groupBy("side", "file_id", F.col("slot").alias("idx")).agg(own.alias("hash"), *ends)


def merkle_tree(manifest: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """The trees of a manifest's sides: tree[0] the slots, tree[depth] the roots; (side, file_id, idx, hash, start, end), each level written once."""
    tree = [cut(slots(manifest), "merkle")]
    for _ in range(depth):
        # at most `fanout` children, in order; an empty slot or node counts as an empty string
        children = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        grouped = tree[-1].groupBy("side", "file_id", F.floor(F.col("idx") / fanout).cast("long").alias("idx"))
        node = _joined(F.transform(children, lambda x: x["hash"]))
        tree.append(cut(grouped.agg(node.alias("hash"), F.min("start").alias("start"), F.max("end").alias("end")), "merkle"))
    return tree


def two_sided(a: DataFrame, b: DataFrame) -> DataFrame:
    """The manifests of two replicas as one table with side."""
    own = ["file_id", "idx", "slot", "key", "page_id", "length", "hash", "start", "end"]
    return a.select(F.lit("a").alias("side"), *own).union(b.select(F.lit("b"), *own))


#: Tasks that equal records of one page are dealt over where some of them have no counterpart.
SALTS = 16


def _unmatched(below: DataFrame) -> DataFrame:
    """Records of one side that the other has fewer of: of equal ones as many as are too many, the last; with k, their order by key."""
    key = ["file_id", "key", "hash"]
    sides = below.groupBy(*key).agg(F.sum(F.when(F.col("side") == "a", 1).otherwise(-1)).alias("over")).filter("over <> 0")
    more = sides.select(*key, F.when(F.col("over") > 0, "a").otherwise("b").alias("side"), F.abs("over").alias("over"))
    ranked = below.join(more, ["side", *key]).withColumn("salt", F.pmod("idx", F.lit(SALTS)))
    for by in ([*key, "salt"], key):  # first within a salt, so that equal records don't meet in one task
        last = Window.partitionBy(*by).orderBy(F.desc("idx"))
        ranked = ranked.withColumn("r", F.row_number().over(last)).filter("r <= over")
    return ranked.withColumn("k", F.row_number().over(Window.partitionBy("file_id", "key", "side").orderBy("idx")))


def fixity_audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT, least_depth: int = 1) -> DataFrame:
    """Compare the manifests of two replicas and locate the records that differ.

    a, b: manifests of the same file_records, each in its replica's own order. Returns a row per record that differs: file_id, seq (place in
    the file, of a's record where there is one), page_id, status (digest, length, missing_in_b, missing_in_a), the byte
    range and digest in each replica and both roots (null where a replica has nothing of the file).

    A record is matched by its key (the page_id; the address where that is null) and its digest,
    wherever it stands: an absent or inserted record is one row, however many follow it.
    Of several records of one key, equal ones are matched by their number (the last ones are those too
    many), and what is left on both sides is paired in order as changed. Equal
    replicas or empty tables give no rows. Trees are as deep as the largest slot needs and least_depth asks.
    Other columns are ignored. If very many records of one key differ, their pairing is one task's sort.
    """
    both = two_sided(a, b)
    most = both.agg(F.max("slot")).first()[0]
    depth = least_depth
    while fanout**depth <= (most or 0):
        depth += 1
    tree = merkle_tree(both, fanout, depth)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        """Nodes of a level, below the nodes `within`, that differ."""
        nodes = tree[level]
        if within is not None:
            up = within.select("file_id", F.col("idx").alias("parent"))
            nodes = nodes.withColumn("parent", F.floor(F.col("idx") / fanout).cast("long")).join(up, ["file_id", "parent"], "left_semi")
        pairs = nodes.groupBy("file_id", "idx").agg(of("a", "hash").alias("a_hash"), of("b", "hash").alias("b_hash"))
        return pairs.filter(~F.col("a_hash").eqNullSafe(F.col("b_hash")))

    suspects = roots = cut(differing(depth, None), "suspects")
    used = [roots]
    for level in range(depth - 1, -1, -1):
        suspects = cut(differing(level, suspects), "suspects")
        used.append(suspects)
    left = _unmatched(both.join(suspects.select("file_id", F.col("idx").alias("slot")), ["file_id", "slot"], "left_semi"))
    own = F.struct("idx", "page_id", "length", "hash", "start", "end").alias("own")
    found = left.select("side", "file_id", "key", "k", own).groupBy("file_id", "key", "k").agg(of("a", "own").alias("a"), of("b", "own").alias("b"))
    status = F.when(F.col("b").isNull(), "missing_in_b").when(F.col("a").isNull(), "missing_in_a").when(F.col("a.length") != F.col("b.length"), "length").otherwise("digest")
    roots = roots.select("file_id", F.col("a_hash").alias("root_a"), F.col("b_hash").alias("root_b"))
    out = found.join(roots, "file_id").select(
        "file_id", F.coalesce("a.idx", "b.idx").alias("seq"), F.coalesce("a.page_id", "b.page_id").alias("page_id"), status.alias("status"),
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("start", "end", "hash")], "root_a", "root_b",
    )
    out = cut(out, "fixity")
    drop_cut(*used, *tree)
    return out


def _damaged() -> Column:
    """A replica with planted damage, told by a digest of the address: a changed sign, a lost last sign, a missing record."""
    html = F.coalesce("html", F.lit(""))
    mark = F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 2)
    middle = (F.length(html) / 2).cast("int")
    sign = F.when(F.substring(html, middle + 1, F.lit(1)) == "X", "Y").otherwise("X")
    changed = F.concat(F.substring(html, F.lit(1), middle), sign, F.substring(html, middle + 2, F.length(html)))
    shorter = F.substring(html, F.lit(1), F.greatest(F.length(html) - 1, F.lit(0)))
    return F.when(mark == "00", changed).when(mark == "01", shorter).when(mark == "02", F.lit(None).cast("string")).otherwise(html)


DATE = "2024-01-01T00:00:00Z"


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    replicas = [manifest(records(pages, body, DATE)) for body in (F.coalesce("html", F.lit("")), _damaged())]
    return fixity_audit(*replicas, least_depth=3)


def _oracle() -> str:
    record = "'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || url || e || 'WARC-Date: " + DATE + "' || e || 'Content-Length: ' || strlen({0})::VARCHAR || e || e || {0} || e || e"
    levels = []
    for k in range(1, 4):
        levels.append(f"""n{k} AS (SELECT file_id, idx // {FANOUT} AS idx,
  sha256(string_agg(coalesce(ah, ''), '' ORDER BY idx)) AS ah, sha256(string_agg(coalesce(bh, ''), '' ORDER BY idx)) AS bh
  FROM n{k - 1} GROUP BY 1, 2)""")
    return f"""
WITH p AS (
  SELECT page_id // {FILE_RECORDS} AS file_id, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS e,
         substr(sha256(coalesce(url, '')), 1, 2) AS mark FROM pages
), d AS (
  SELECT *, CASE mark WHEN '00' THEN substr(html, 1, length(html) // 2) || CASE substr(html, length(html) // 2 + 1, 1) WHEN 'X' THEN 'Y' ELSE 'X' END || substr(html, length(html) // 2 + 2)
    WHEN '01' THEN substr(html, 1, length(html) - 1) WHEN '02' THEN NULL ELSE html END AS damaged FROM p
), r AS (SELECT file_id, page_id, url, html, {record.format('html')} AS ra, {record.format('damaged')} AS rb FROM d
), h AS (
  SELECT file_id, page_id, row_number() OVER w - 1 AS idx, strlen(ra) AS la, sha256(ra) AS ah, strlen(rb) AS lb, sha256(rb) AS bh,
    sum(strlen(ra)) OVER w AS ea, sum(strlen(rb)) OVER w AS eb
  FROM r WINDOW w AS (PARTITION BY file_id ORDER BY page_id, sha256(url || chr(10) || html) ROWS UNBOUNDED PRECEDING)
), n0 AS (SELECT file_id, idx, ah, bh FROM h), {', '.join(levels)}
SELECT h.file_id, h.idx AS seq, page_id,
  CASE WHEN h.bh IS NULL THEN 'missing_in_b' WHEN la <> lb THEN 'length' ELSE 'digest' END AS status,
  (ea - la)::BIGINT AS a_start, ea::BIGINT AS a_end, h.ah AS a_hash,
  CASE WHEN h.bh IS NOT NULL THEN (eb - lb)::BIGINT END AS b_start, CASE WHEN h.bh IS NOT NULL THEN eb::BIGINT END AS b_end, h.bh AS b_hash,
  n3.ah AS root_a, n3.bh AS root_b
FROM h JOIN n3 ON h.file_id = n3.file_id WHERE h.ah IS DISTINCT FROM h.bh
"""


#: Trees of the query have three levels above the records (512 records, 16 children).
ORACLE = _oracle()
