"""Chains and segment walks against plain Python."""

import random

import pyarrow as pa
import pytest

from tilequery.operators import chains, jpeg


def walked(head, links, most):
    out, at = [], head
    while at and len(out) < most:
        out.append((len(out), at, links.get(at)))
        at = links.get(at)
    return out


@pytest.mark.parametrize("most", [1, 3, 16, 100])
def test_chains(spark, most):
    shapes = {
        "end": (1, {1: 2, 2: 3, 3: 0}), "self": (1, {1: 1}), "loop": (1, {1: 2, 2: 3, 3: 4, 4: 2}), "all": (5, {5: 6, 6: 7, 7: 5}), "broken": (1, {1: 9}), "none": (0, {1: 2}), "gone": (4, {}),
        "long": (1, {k: k + 1 for k in range(1, 300)} | {300: 0}), "hundred": (1, {k: k + 1 for k in range(1, 100)} | {100: 0}), "fork": (1, {1: 3, 2: 3, 3: 0}), "far loop": (1, {k: k + 1 for k in range(1, 130)} | {130: 128}),
    }
    heads = spark.createDataFrame([(s, h) for s, (h, _) in shapes.items()] + [(None, 1)], "slide_id string, offset long")
    rows = [(s, a, b) for s, (_, links) in shapes.items() for a, b in links.items()] + [("end", 1, 2), ("end", 3, None), (None, 1, 2)]
    links = spark.createDataFrame(rows, "slide_id string, offset long, next_offset long")
    got = {}
    for r in chains.followed(heads, links, most).collect():
        got.setdefault(r.slide_id, []).append((r.position, r.offset, r.next_offset))
    assert {s: sorted(v) for s, v in got.items()} == {s: w for s, (h, l) in shapes.items() if (w := walked(h, l, most))}
    if most == 100:
        out = {r.slide_id: (r.length, r.outcome, r.loop_at, r.loop_length, r.shared) for r in chains.outcomes(heads, links, most).collect()}
        assert out == {
            "end": (3, "end", None, None, 0), "self": (100, "loop", 0, 1, 0), "loop": (100, "loop", 1, 3, 1), "all": (100, "loop", 0, 3, 0), "broken": (1, "broken", None, None, 0), "none": (0, "empty", None, None, 0),
            "gone": (0, "broken", None, None, 0), "long": (100, "cut", None, None, 0), "hundred": (100, "end", None, None, 0), "fork": (2, "end", None, None, 1), "far loop": (100, "cut", None, None, 0),
        }


def segments(data):
    at = 2
    while data[:2] == b"\xff\xd8" and at + 1 < len(data):
        if data[at] != 0xFF or data[at + 1] == 0xFF:
            at += 1
        elif data[at + 1] in (0, 1, *range(0xD0, 0xDA)):
            at += 2
        else:
            yield data[at + 1], at + 2
            if at + 3 >= len(data):
                return
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")


def plain(data):
    tables = scan = False
    size = None
    for marker, at in segments(data or b""):
        scan = scan or (marker == 0xDA and not tables)
        tables = tables or marker in (0xDB, 0xC4, 0xDA)
        if size is None and 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and at + 7 <= len(data):
            size = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
    return scan, size


def test_segment_walks_of_a_batch():
    rng = random.Random(1)
    pieces = [b"\xff", b"\xff\x00", b"\xff\xd9", b"\xff\xdb\x00\x04ab", b"\xff\xc4\x00\x02", b"\xff\xda\x00\x02", b"\xff\xc0\x00\x0b\x08\x01\x02\x03\x04\x01\x01\x11\x00", b"\xff\xc8\x00\x02", b"\xff\xe1\x00\x08\xff\xda\xff\xc1xx", b"abc", b"\x00", b"\xff\xee\x00\x00", b"\xff\xcf\x00\x20"]
    streams = [None, b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff", b"\xdb\x00"] + [rng.choice([b"\xff\xd8"] * 5 + [b"", b"\xff"]) + b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    column = pa.array(streams, pa.binary())
    for part in (column, column.slice(7, 1000), column.slice(3, 0)):
        width, height = jpeg.sizes(part)
        got = [(bool(a), None if w < 0 else (w, h)) for a, w, h in zip(jpeg.abbreviated_of(part), width.tolist(), height.tolist())]
        assert got == [plain(x.as_py()) for x in part]
    assert len({g for g in got}) <= 1 and sum(x[1] is not None for x in map(plain, streams)) > 200
