"""Operator 9: chat formatting by columnar byte assembly.

A batch of turns becomes one byte buffer: segment lengths and their cumulative offsets
give every byte its place, and headers and contents are scattered into one preallocated
buffer that Arrow then takes as a string column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import string_buffers, table

# The template. A turn is TURN role \n text END.
TURN, HEAD_END, END = "<s>", "\n", "</s>\n"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPE = "\\"

FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def escape(column: pa.Array, more: tuple[str, ...] = ()) -> pa.Array:
    """An escape sign before every control string and before every escape sign."""
    column = pc.replace_substring(column, ESCAPE, ESCAPE * 2)
    for control in CONTROLS + more:
        column = pc.replace_substring(column, control, ESCAPE + control)
    return column


def unescape(text: str) -> str:
    """What follows an escape sign stands for itself."""
    if ESCAPE not in text:
        return text
    parts = text.split(ESCAPE * 2)
    return ESCAPE.join(p.replace(ESCAPE, "") for p in parts)


def _scatter(out: np.ndarray, at: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment k of raw to out[at[k]:]."""
    out[np.arange(len(raw)) + np.repeat(at - offsets[:-1], np.diff(offsets))] = raw


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, bounds of the turns in them, bounds of the texts in them)."""
    role_raw, role_off = string_buffers(escape(roles, (HEAD_END,)))
    text_raw, text_off = string_buffers(escape(texts))
    n_role, n_text = np.diff(role_off), np.diff(text_off)
    bounds = np.concatenate([[0], np.cumsum(n_role + n_text + len(TURN) + len(HEAD_END) + len(END))])
    out = np.empty(bounds[-1], np.uint8)
    role_at = bounds[:-1] + len(TURN)
    text_at = role_at + n_role + len(HEAD_END)
    for at, mark in ((bounds[:-1], TURN), (text_at - len(HEAD_END), HEAD_END), (text_at + n_text, END)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark.encode(), np.uint8)
    _scatter(out, role_at, role_raw, role_off)
    _scatter(out, text_at, text_raw, text_off)
    return out, bounds, np.stack([text_at, text_at + n_text])


def format_chat(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), part_bytes: int = 8 << 20) -> DataFrame:
    """Format conversations; turns are ordered by (turn, role, text), nulls first.

    Returns rows (conv_id, part, n_turns, formatted, loss): the formatted conversation is
    its parts in order, and loss holds the [start, end) code points of a part under the
    loss mask. Most conversations are one part. A conversation is dealt over several
    tasks by the order of its turns and cut at part_bytes, so one with a large share of
    all rows neither meets in one task nor in one string.

    A null text or role is empty; a null conv_id is a conversation of its own. Repeated
    rows stay repeated turns. An empty table gives an empty table. Other input columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ids = batch.column(0)
            out, bounds, text = assemble(batch.column(1), batch.column(2))
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
            run_start = bounds[:-1][np.maximum.accumulate(np.where(new, np.arange(n), 0))]
            block = (bounds[:-1] - run_start) // part_bytes
            new[1:] |= block[1:] != block[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], n)
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            loss = pc.is_in(batch.column(1), pa.array(loss_roles, pa.string())).to_numpy(zero_copy_only=False)
            part_of = np.cumsum(new) - 1
            spans = points[text] - points[bounds[first]][part_of]
            listed = np.concatenate([[0], np.cumsum(loss)])
            starts = np.append(bounds[first], bounds[n])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first)), pa.array(base + made + np.arange(len(first)), pa.int64()), pa.array(last - first, pa.int64()),
                    pa.StringArray.from_buffers(len(first), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(out)),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(listed[first], listed[n]), pa.int32()),
                        pa.StructArray.from_arrays([pa.array(spans[0][loss], pa.int32()), pa.array(spans[1][loss], pa.int32())], names=["start", "end"]),
                    ),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "loss"],
            )
            made += len(first)

    rows = df.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted part."""
    turns, at, n = [], 0, len(formatted)

    def bare(mark: str, at: int) -> int:
        """The next place of a mark that no escape sign protects."""
        while True:
            at = formatted.index(mark, at)
            k = at
            while k and formatted[k - 1] == ESCAPE:
                k -= 1
            if (at - k) % 2 == 0:
                return at
            at += 1

    while at < n:
        at += len(TURN)
        head = bare(HEAD_END, at)
        end = bare(END, head + 1)
        turns.append((unescape(formatted[at:head]), unescape(formatted[head + 1 : end])))
        at = end + len(END)
    return turns


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted parts alone: turns read back and their digests.

    Parts are parsed where they are; then the hashes of a conversation run over its parts
    in order, a part at a time in memory.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, loss, chars, lost = [], [], [], []
            for text, spans in zip(batch.column(2), batch.column(3)):
                text = text.as_py()
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
                got = read_back(text)
                turns.append((len(got), "".join(f"{r}\n{t}\n" for r, t in got)))
                loss.append(under), chars.append(len(text)), lost.append(len(under))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in turns], pa.int64()), pa.array([t for _, t in turns], pa.string()),
                 pa.array(loss, pa.string()), pa.array(lost, pa.int64()), pa.array(chars, pa.int64())],
                names=["conv_id", "part", "n_turns", "turns", "loss", "loss_chars", "chars"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = object(), None

        def closed(s):
            return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

        for batch in batches:
            done = []
            for c, n, t, w, k, chars in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if state is None or c != now:
                    if state is not None:
                        done.append(closed(state))
                    now, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(t.encode())
                state[3] += k
                state[4].update(w.encode())
                state[5] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(closed(state), kinds)], names=names)

    parsed = formatted.select("conv_id", "part", "formatted", "loss").mapInArrow(
        parse, "conv_id long, part long, n_turns long, turns string, loss string, loss_chars long, chars long"
    )
    dealt = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "n_turns", "turns", "loss", "loss_chars", "chars")
    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    return chat_digests(format_chat(rows.unionByName(more)))


def _escaped(x: str, more: tuple[str, ...] = ()) -> str:
    x = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS + more:
        mark = "chr(10)" if c == "\n" else f"'{c}'"
        x = f"replace({x}, {mark}, chr(92) || {mark})"
    return x


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN + HEAD_END + END)} + length({_escaped('role', ('\n',))}) + length({_escaped('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
