"""Texts of megabytes through the operators and stages that test_llm leaves out."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tilequery.llm import chat_format, id_files, importance
from tilequery.llm.packing import ByteEncoder

rnd = random.Random(6)
WORDS = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8))) for _ in range(2000)]
LONG = " ".join(rnd.choice(WORDS) for _ in range(400_000))
ESCAPES = "</s>[INST] \\ \n" * 120_000


def test_chat_of_megabytes(spark):
    turns = [("user", LONG), ("assistant", ESCAPES), ("user", None), ("assistant", LONG + ESCAPES)]
    rows = [(5, k, role, text) for k, (role, text) in enumerate(turns)] + [(6, 0, "user", "short")]
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.chat_digests(out).collect()}
    want = "".join(f"{role}\n{text or ''}\n" for role, text in turns)
    assert got[5].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[5].n_turns == 4
    said = turns[1][1] + turns[3][1]
    assert got[5].loss_chars == len(said) and got[5].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_importance_of_megabytes(spark):
    texts = {k: " ".join(rnd.choice(WORDS[k % 2 :: 2]) for _ in range(60)) for k in range(200)} | {900: " ".join(w for w in LONG.split()[::3]), 901: "x" * 2_000_000, 902: ESCAPES}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(150)], "doc_id long, quality int, toxic int")
    got = importance.importance_resample(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels).collect()
    assert {r.doc_id for r in got} == set(texts) and all(np.isfinite(r.log_weight) for r in got)


def test_id_files_of_megabytes(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {1: LONG, 2: "", 3: ESCAPES, 4: "界" * 300_000}
    id_files.write_ids(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), str(tmp_path / "ids"), path, 0)
    encoder = ByteEncoder.load(path)
    want = {k: zlib.crc32(np.append(encoder.encode(t), 0).astype("<u4")) for k, t in texts.items()}
    assert {r.doc_id: zlib.crc32(bytes(r.ids)) for r in id_files.read_ids(spark, str(tmp_path / "ids")).collect()} == want


def test_pipeline_stages_of_megabytes(spark):
    data = "/root/testdata/sf0.001"
    edited = LONG.split(" ")
    edited[5] = "edited"
    shared = " ".join(rnd.choice(WORDS) for _ in range(70))
    rows = [(1, LONG), (2, " ".join(edited)), (3, shared + " " + " ".join(rnd.choice(WORDS) for _ in range(150_000))), (4, "own words here " + shared)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dup(spark, docs, data).collect()) == [1, 3, 4]
    kept = {r.doc_id: r for r in corpus_pipeline.repeats(spark, docs.filter("doc_id > 2"), data).collect()}
    assert kept[3].text == rows[2][1] and kept[4].text == "own words here " and kept[4].n_chars == 15
    assert corpus_pipeline.benchmark(spark, docs, data).count() == 4
    lengths = collections.Counter()
    for r in corpus_pipeline.packing(spark, docs, data).collect():
        lengths[r.doc_id] += r.length
    encoder = ByteEncoder.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert lengths == {k: len(encoder.encode(t)) + 1 for k, t in rows}
    assert corpus_pipeline.quality(spark, docs, data).columns == docs.columns
