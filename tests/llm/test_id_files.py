"""Range-coded ids: exact round trips, damage, and the query's rows against the tokenizers library."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tilequery.llm import id_files, mixing_coder, packing
from tilequery.sources import blob_sink

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


def cases():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 50257, 300)
    yield "one", np.array([7])
    yield "same", np.zeros(5000, np.int64)
    yield "all different", np.arange(50257)
    yield "uniform", rng.integers(0, 50257, 9001)
    yield "phrases", np.concatenate([words[rng.integers(0, 290) :][:8] for _ in range(900)])
    yield "32 bits", rng.integers(0, 2**32, 3000)
    yield "largest", np.array([2**32 - 1, 0, 2**32 - 1])
    yield "skewed", np.minimum(rng.geometric(0.001, 20000), 4000)


@pytest.mark.parametrize(("name", "ids"), list(cases()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize(("block", "lanes"), [(64, 5), (1000, 1024), (4096, 3)])
def test_round_trip(name, ids, block, lanes):
    cuts = [0, *sorted(set(np.random.default_rng(1).integers(1, len(ids), 7).tolist())), len(ids)] if len(ids) > 1 else [0, 1]
    parts = [ids[a:b].astype(np.uint32) for a, b in zip(cuts, cuts[1:])]
    docs = [None if k == 1 else -k for k in range(len(parts))]
    raw = id_files.segment(docs, parts, block, lanes)
    got_docs, per, got, size = id_files.read_segment(memoryview(raw + b"more"), lanes)
    assert got_docs == docs and per.tolist() == [len(p) for p in parts] and size == len(raw)
    assert (got == ids).all()


def test_predictions_shorten_the_code():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 3000, 6) for _ in range(60)]
    ids = np.concatenate([words[k] for k in rng.integers(0, 60, 9000)]).astype(np.uint32)
    raw = id_files.segment([1], [ids])
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    order0 = -(share * np.log2(share)).sum() / 8 * len(ids)
    assert len(raw) < 0.5 * order0


def test_blocks_are_coded_alone():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50, 700)
    own, counts, places = id_files._distinct(ids)
    shares = mixing_coder.Shares(counts)
    lengths = np.array([100] * 7)
    codes = mixing_coder.encode(places, lengths, shares)
    for k in range(7):
        assert (own[mixing_coder.decode([codes[k]], lengths[:1], shares)] == ids[100 * k : 100 * k + 100]).all()
        assert mixing_coder.encode(places[100 * k : 100 * k + 100], lengths[:1], shares) == [codes[k]]


def test_damage_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 700
    raw = id_files.segment([1, 2], [ids[:100], ids[100:]], 256)
    rng = np.random.default_rng(4)
    for at in [0, 9, 50, 60, len(raw) - 1, *rng.integers(0, len(raw), 60).tolist()]:
        bad = bytearray(raw)
        bad[at] ^= 1 << int(rng.integers(0, 8))
        with pytest.raises(ValueError):
            id_files.read_segment(memoryview(bytes(bad)))
    with pytest.raises(ValueError):
        id_files.read_segment(memoryview(raw[:-1]))


@pytest.mark.parametrize("n", [16382, 16383, 16384, 40000])
def test_narrow_and_wide_tables(n):
    rng = np.random.default_rng(6)
    ids = np.concatenate([np.arange(n), np.tile(rng.integers(0, n, 9), 300), rng.integers(n - 5, n, 300)])
    docs, per, got, _ = id_files.read_segment(memoryview(id_files.segment([1], [ids.astype(np.uint32)], 512, 64)))
    assert (got == ids).all()


def test_a_block_takes_little_memory():
    """Most time of the coder goes by waiting for its tables."""
    shares = mixing_coder.Shares(np.ones(4000, np.int64))
    tables = mixing_coder._Mixture(100, shares)
    assert sum(x.nbytes for x in vars(tables).values() if isinstance(x, np.ndarray)) <= 100 * 2500


def test_many_different_ids():
    """A named id of the least weight has a width of the interval, whatever the number of ids."""
    rng = np.random.default_rng(7)
    ids = rng.permutation(1 << 20)[: 400 * 2048].reshape(400, 2048)
    ids[:, 1900:] = np.repeat(ids[:, 1900:1974], 2, 1)
    ids[:, 2000:] = ids[:, 1000:1048]
    docs, per, got, _ = id_files.read_segment(memoryview(id_files.segment([1], [ids.reshape(-1).astype(np.uint32)])))
    assert (got == ids.reshape(-1)).all()


def test_texts_without_neighbouring_white_space():
    rng = random.Random(8)
    atoms = [" ", " ", "\n", "\t", "\x85", "\xa0", "\x1c", "a", "Bc", "é", "à", "12", "²", "'s", "'", "!?", "<|endoftext|>", "<|", "世", "_"]
    texts = ["".join(rng.choices(atoms, k=rng.randint(0, 9))) for _ in range(4000)]
    texts += [chr(a) + b + "a" for a in range(0x250) for b in " a1!\n"] + [b + chr(a) for a in range(0x250) for b in " a1!\n"]
    encoder, model = packing.ByteEncoder.load(PATH), Tokenizer.from_file(PATH)
    single = packing.single_spaced(pa.array(["x  y", *texts]).slice(1))
    assert 1000 < single.sum() < len(texts)
    for text, own in zip(texts, single.tolist()):
        assert not own or encoder.encode_single(text).tolist() == model.encode(text, add_special_tokens=False).ids, text
    assert packing.single_spaced(pa.array(["", " ", "  ", "a ", " b", "a \n", "a\xa0 b"])).tolist() == [True, True, False, True, True, False, False]
    assert len(packing.single_spaced(pa.array([], pa.string()))) == 0


def expected(rows):
    model = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = id_files.op11_id_files(spark, DATA).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_awkward_rows(spark, tmp_path):
    rows = [(5, "five <|endoftext|> of it", "x"), (None, "no id", "x"), (3, None, "x"), (3, "", "x"), (-2, "é世界" * 9000, "x"), (9, "same", "x"), (9, "same", "x"), (9, "other", None), (2**62, "ab " * 200_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "'a' AS start", "1 AS h", "2 AS tie", "3 AS t").repartition(3)
    path = str(tmp_path / "a")
    id_files.write_ids(frame, path, PATH, 0, segment_ids=100, file_segments=1, block=128)
    got = sorted(id_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -2, 3, 3, 5, 9, 9, 9, 2**62]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    want = {(d, n, c) for d, _, n, c in expected([r[:2] for r in rows])}
    assert {(r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got} == want
    assert blob_sink.blobs(spark, path).count() >= 2
    with pytest.raises(Exception, match="written before|ids"):
        id_files.write_ids(frame.limit(1), path, PATH, 0)
    name = f"{path}/{blob_sink.blobs(spark, path).first().name}"
    size = os.path.getsize(name)
    with open(name, "r+b") as f:
        f.seek(size - 2)
        last = f.read(1)
        f.seek(size - 2)
        f.write(bytes([last[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        id_files.read_ids(spark, path).collect()


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "e")
    id_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 0)
    assert id_files.read_ids(spark, path).count() == 0
