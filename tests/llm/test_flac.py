import random

import pytest

from curatrix.llm import flac

from awkward_rows import AWKWARD


def test_round_trip_of_all_kinds_of_blocks():
    rng = random.Random(1)
    raw = [b"", b"x" * 192, bytes(range(192)), bytes(rng.randrange(256) for _ in range(4000)), b"\xff\xf8\x14\x02\x00" * 700, b"\x00\xff" * 1000, bytes(960), ("né " * 30000).encode()]
    payloads = [flac.padded(r) for r in raw]
    files = flac.encode_files(payloads)
    for p, f, (back, offsets) in zip(payloads, files, flac.decode_files(files), strict=True):
        assert back == p and len(offsets) == len(p) // flac.BLOCK
        assert all(f[o : o + 2] == b"\xff\xf8" for o in offsets)


def test_each_damaged_byte_of_a_frame_is_found():
    (f,) = flac.encode_files([flac.padded(b"some text to be stored " * 20)])
    for at in range(len(f) - 40, len(f)):
        bad = bytearray(f)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_files([bytes(bad)])


def test_seek_table_points_at_frames():
    (f,) = flac.encode_files([flac.padded(b"abc" * 20000)])
    at = f.index(b"\x83", 42) if f[42] == 0x83 else 42
    size = int.from_bytes(f[at + 1 : at + 4], "big")
    points = [f[at + 4 + i : at + 22 + i] for i in range(0, size, 18)]
    first = at + 4 + size
    for p in points:
        sample, offset = int.from_bytes(p[:8], "big"), int.from_bytes(p[8:16], "big")
        assert sample % (flac.BLOCK * flac.SEEK_EVERY) == 0 and f[first + offset : first + offset + 2] == b"\xff\xf8"


def test_rows(awkward, empty):
    out = flac.read_back(flac.store(awkward)).collect()
    assert sorted((r.doc_id or 0, bytes(r.pcm)) for r in out) == sorted((i or 0, flac.padded((t or "").encode())) for i, t in AWKWARD)
    same = {r.feature for r in out if r.doc_id in (2, 3)}
    assert len(same) == 1 and flac.read_back(flac.store(empty)).count() == 0
