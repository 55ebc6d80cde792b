"""Batch-wide decoding against the reader of single files, and on bad and short input."""

import random
import struct

import pytest

from tilequery.sources import tiff, tiff_batch

KINDS = {1: "B", 3: "H", 4: "I", 16: "Q"}


def container(order, big, directories, loop=False):
    """A container of directories of entries (tag, type, values or bytes)."""
    o, slot, head = order, 8 if big else 4, 16 if big else 8
    at = head
    body, tail = b"", []
    sizes = [(8 if big else 2) + len(d) * (20 if big else 12) + slot for d in directories]
    arrays = head + sum(sizes)
    for k, d in enumerate(directories):
        body += struct.pack(o + ("Q" if big else "H"), len(d))
        for tag, kind, values in d:
            raw = values if isinstance(values, bytes) else struct.pack(f"{o}{len(values)}{KINDS[kind]}", *values)
            n = len(values)
            if len(raw) <= slot:
                own = raw.ljust(slot, b"\0")
            else:
                own = struct.pack(o + ("Q" if big else "I"), arrays)
                tail.append(raw)
                arrays += len(raw)
            body += struct.pack(o + "HH" + ("Q" if big else "I"), tag, kind, n) + own
        at += sizes[k]
        body += struct.pack(o + ("Q" if big else "I"), at if k + 1 < len(directories) else head if loop else 0)
    first = struct.pack(o + "HHHQ", 43, 8, 0, 16) if big else struct.pack(o + "HI", 42, 8)
    return (b"II" if o == "<" else b"MM") + first + body + b"".join(tail)


def made(rng, order, big):
    number = lambda kind: rng.randrange(1 << {3: 16, 4: 32, 16: 62}[kind])
    directory = lambda: [(tag, kind, [number(kind) for _ in range(rng.choice([0, 1, 1, 2, 3, 40]))]) for tag in (256, 257, 322, 324, 325, 324) for kind in [rng.choice([3, 4, 16])]] + [(270, 2, b"Aperio|MPP = 0.25\0"), (347, 7, b"\xff\xd8\xff\xd9"), (999, 99, b"12")]
    return container(order, big, [directory() for _ in range(rng.randint(1, 4))])


@pytest.fixture(scope="module")
def files():
    rng = random.Random(4)
    good = {f"f{k}": made(rng, rng.choice("<>"), rng.random() < 0.5) for k in range(60)}
    good["loop"] = container("<", False, [[(256, 3, [5])], [(256, 4, [6])]], loop=True)
    good["empty directory"] = container(">", True, [[], [(257, 3, [7])]])
    return good


def single(data):
    def read(offset, length):
        if offset + length > len(data):
            raise tiff.TiffError("range_out_of_bounds", "")
        return data[offset : offset + length]

    return read


def test_entries_and_arrays_equal_the_single_reader(spark, files):
    frame = spark.createDataFrame(list(files.items()), "slide_id string, data binary").repartition(3)
    want, arrays = set(), {}
    for name, data in files.items():
        read = single(data)
        h = tiff.read_header(read, len(data))
        for k, d in enumerate(tiff.directories(read, h)):
            want |= {(name, k, n, e.tag_id, e.type_raw, e.count, e.inline, bytes(e.raw), e.inline_number(h)) for n, e in enumerate(d)}
            for tag, e in tiff.by_tag(d).items():
                if tag in (256, 257, 322, 324, 325):
                    arrays[name, k, tag] = e.numbers(h, read)
    got = tiff_batch.entries(frame).collect()
    assert {(*r[:7], bytes(r.value_bytes), r.value) for r in got} == want and len(got) == len(want)
    assert max(r.ifd_index for r in got if r.slide_id == "loop") == 99
    rows = tiff_batch.value_arrays(frame, [256, 257, 322, 324, 325]).collect()
    assert {(r.slide_id, r.ifd_index, r.tag_id): r["values"] for r in rows} == arrays and len(rows) == len(arrays) and all(r.error is None for r in rows)
    others = tiff_batch.value_arrays(frame, [347, 999]).collect()
    assert {(r.tag_id, r.error, r["values"]) for r in others} == {(347, "invalid_tag_value", None), (999, "unknown_field_type", None)} or {r.error for r in others} == {"invalid_tag_value", "unknown_field_type"}


def test_headers(spark, files):
    le = files["loop"]
    bad = {
        "null": None, "short": b"II*\0", "magic": b"XX" + le[2:], "version": b"II\x2c\0" + le[4:], "offset": le[:4] + struct.pack("<I", 1 << 20) + le[8:], "big and short": b"II\x2b\0\x08\0\0\0",
        "big slot": b"MM\0\x2b\0\x04" + b"\0" * 20, "far": b"II\x2b\0\x08\0\0\0" + struct.pack("<Q", 1 << 63), "cut directory": le[:20], "count": le[:8] + b"\xff\xff" + le[10:],
    }
    want = {
        "null": "file_too_small", "short": "file_too_small", "magic": "invalid_magic", "version": "invalid_version", "offset": "invalid_ifd_offset", "big and short": "file_too_small",
        "big slot": "invalid_bigtiff_offset_size", "far": "invalid_ifd_offset", "cut directory": "range_out_of_bounds", "count": "range_out_of_bounds",
    }
    frame = spark.createDataFrame([*bad.items(), *files.items()], "slide_id string, data binary")
    got = {r.slide_id: r for r in tiff_batch.headers(frame).collect()}
    assert {k: got[k].error for k in bad} == want and all(got[k].error is None for k in files)
    assert all(got[k].byte_order == ("II" if v[:2] == b"II" else "MM") and got[k].is_bigtiff == (43 in v[2:4]) and got[k].size == len(v) for k, v in files.items())
    assert got["loop"].directories == 100 and got["empty directory"].directories == 2 and got["magic"].byte_order is None and got["version"].byte_order == "II"
    assert tiff_batch.entries(frame.filter("slide_id IN ('null', 'magic', 'cut directory', 'far')")).count() == 0
    assert tiff_batch.headers(frame.filter("false")).count() == 0 and tiff_batch.value_arrays(frame.filter("false"), [324]).count() == 0


def test_values_of_a_cut_file(spark, monkeypatch):
    monkeypatch.setattr(tiff_batch, "MOST_VALUES", 5)
    whole = container(">", False, [[(324, 4, list(range(1000, 1010))), (325, 16, [1 << 63, 5])]])
    rows = [(f"{n}", whole[:n]) for n in range(len(whole) - 60, len(whole) + 1)]
    got = {(r.slide_id, r.tag_id): r for r in tiff_batch.value_arrays(spark.createDataFrame(rows, "slide_id string, data binary"), [324, 325]).collect()}
    for name, data in rows:
        a = max(0, len(data) - (len(whole) - 56)) // 4
        b = max(0, len(data) - (len(whole) - 16)) // 8
        if (name, 324) in got:
            assert got[name, 324]["values"] == list(range(1000, 1010))[:a] and got[name, 324].error == (None if a >= 10 else "range_out_of_bounds")
            assert got[name, 325]["values"] == [None, 5][:b] and got[name, 325].error == (None if b >= 2 else "range_out_of_bounds")
    assert len(got) >= 2 * 56
