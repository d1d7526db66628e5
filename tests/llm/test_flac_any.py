"""Files of every form that a small writer can make, against the samples they were made of."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_flac
from awkward_rows import AWKWARD
from curatrix.llm import flac, flac_any


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8))


def subframe(rng, out, x, depth):
    wasted = 0
    while all(v % 2 == 0 for v in x) and any(x) and wasted < 3:
        x, wasted, depth = [v >> 1 for v in x], wasted + 1, depth - 1
    n = len(x)
    choice = rng.choice(["verbatim", "fixed"] + ["lpc"] * (n > 3) + (["constant"] * 9 if len(set(x)) == 1 else []))
    order = rng.randint(0, min(4, n - 1)) if choice == "fixed" else rng.randint(1, min(8, n - 1)) if choice == "lpc" else 0
    out.put(0, 1)
    out.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[choice], 6)
    out.put(int(wasted > 0), 1)
    if wasted:
        out.put(1, wasted)
    if choice == "constant":
        return out.put(x[0], depth)
    if choice == "verbatim":
        return [out.put(v, depth) for v in x]
    taps, shift = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order] if choice == "fixed" else [rng.randint(-60, 60) for _ in range(order)], 0
    for v in x[:order]:
        out.put(v, depth)
    if choice == "lpc":
        precision, shift = rng.randint(7, 15), rng.randint(0, 8)
        out.put(precision - 1, 4)
        out.put(shift, 5)
        for t in taps:
            out.put(t, precision)
    r = [x[i] - (sum(t * x[i - 1 - j] for j, t in enumerate(taps)) >> shift) for i in range(order, n)]
    method = rng.randint(0, 1)
    parts = rng.choice([p for p in range(5) if n % (1 << p) == 0 and n >> p >= max(order, 1)])
    out.put(method, 2)
    out.put(parts, 4)
    at = 0
    for p in range(1 << parts):
        m = (n >> parts) - (0 if p else order)
        some, at = r[at : at + m], at + m
        if rng.random() < 0.2 and max(map(abs, some), default=0) < 1 << 29:
            raw = max([0, *(v.bit_length() + 1 if v >= 0 else (v + 1).bit_length() + 1 for v in some if v)])
            out.put((1 << 4 + method) - 1, 4 + method)
            out.put(raw, 5)
            for v in some:
                out.put(v, raw)
            continue
        z = [2 * v if v >= 0 else -2 * v - 1 for v in some]
        k = min(max(0, (sum(z) // max(1, len(z))).bit_length() - rng.randint(0, 2)), 30 if method else 14)
        out.put(k, 4 + method)
        for v in z:
            out.put(1, (v >> k) + 1)
            out.put(v, k)


def made(rng, channels, depth, sizes):
    """A file and its samples by channel."""
    total, frames, samples = sum(sizes), b"", [[] for _ in range(channels)]
    variable = len(set(sizes[:-1])) > 1
    for number, n in enumerate(sizes):
        top = (1 << depth - 1) - 1
        loud = rng.choice([0, 3, top // 9, top])
        x = [[rng.randint(-loud, loud) << rng.choice([0, 0, 0]) for _ in range(n)] for _ in range(channels)]
        if rng.random() < 0.3:
            x = [[v // 4 * 4 for v in c] for c in x]
        out = Out()
        out.put(0x7FFC, 15)
        out.put(int(variable), 1)
        code = next((c for c, s in flac_any.SIZES.items() if s == n), 6 if n <= 256 else 7)
        rate = rng.choice([0, 9, 12, 13])
        pairing = rng.choice([1, 8, 9, 10]) if channels == 2 else channels - 1
        said = next((c for c, d in flac_any.DEPTHS.items() if d == depth), 0)
        for value, bits in ((code, 4), (rate, 4), (pairing, 4), (rng.choice([0, said]), 3), (0, 1)):
            out.put(value, bits)
        first = sum(sizes[:number]) if variable else number
        for byte in chr(first).encode() if first < 0xD800 else bytes([0xF0 | first >> 18, 0x80 | first >> 12 & 63, 0x80 | first >> 6 & 63, 0x80 | first & 63]):
            out.put(byte, 8)
        if code in (6, 7):
            out.put(n - 1, 8 if code == 6 else 16)
        out.put(44, {12: 8, 13: 16}.get(rate, 0))
        out.put(plain_flac.crc(out.bytes(), 8, 0x07), 8)
        y, wide = x, [0] * channels
        if pairing == 8:
            y, wide = [x[0], [a - b for a, b in zip(*x, strict=True)]], [0, 1]
        elif pairing == 9:
            y, wide = [[a - b for a, b in zip(*x, strict=True)], x[1]], [1, 0]
        elif pairing == 10:
            y, wide = [[(a + b) >> 1 for a, b in zip(*x, strict=True)], [a - b for a, b in zip(*x, strict=True)]], [0, 1]
        for c, w in zip(y, wide, strict=True):
            subframe(rng, out, c, depth + w)
        frame = out.bytes()
        frames += frame + plain_flac.crc(frame, 16, 0x8005).to_bytes(2, "big")
        for s, c in zip(samples, x, strict=True):
            s += c
    width = (depth + 7) // 8
    raw = b"".join(v.to_bytes(width, "little", signed=True) for row in zip(*samples, strict=True) for v in row)
    info = bytes(10) + ((8000 << 44) | (channels - 1 << 41) | (depth - 1 << 36) | total).to_bytes(8, "big") + hashlib.md5(raw).digest()
    other = b"made by a test"
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x84" + len(other).to_bytes(3, "big") + other + frames, samples, raw


FORMS = [(1, 16, [192, 192, 5]), (2, 16, [576, 576]), (2, 24, [256, 100, 300]), (1, 8, [4096]), (3, 12, [16, 17, 18]), (2, 20, [1]), (8, 8, [64, 64]), (1, 16, [])]


@pytest.mark.parametrize(("channels", "depth", "sizes"), FORMS)
def test_files_of_every_form(channels, depth, sizes):
    for seed in range(6):
        file, samples, raw = made(random.Random(f"{seed}{channels}{depth}{sizes}"), channels, depth, sizes)
        s, x, blocks = flac_any.decode(file)
        assert (s.channels, s.depth, s.rate) == (channels, depth, 8000)
        assert x.T.tolist() == samples and flac_any.packed(x, depth) == raw
        assert [(b[0], b[1]) for b in blocks] == [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]
        assert all(file[at : at + 1] == b"\xff" for _, _, at in blocks)
        if sizes:
            assert plain_flac.decode(file)[2] == samples


def test_damage_is_found():
    file, _, _ = made(random.Random(1), 2, 16, [192, 192])
    for at in range(flac_any.head(file).first, len(file), 7):
        bad = bytearray(file)
        bad[at] ^= 0x24
        with pytest.raises(ValueError):
            flac_any.decode(bytes(bad))
    for n in (0, 3, 20, 50, len(file) - 1, len(file) - 200):
        with pytest.raises(ValueError):
            flac_any.decode(file[:n])


def test_long_unary_numbers_cross_windows(monkeypatch):
    monkeypatch.setattr(flac_any, "WINDOW", 3)
    data = bytes(20) + b"\x01" + bytes(1) + b"\x80"
    b = flac_any.Bits(data, 0)
    assert [b.unary(), b.unary()] == [167, 8]
    with pytest.raises(ValueError):
        b.unary()


def test_reads_what_the_batch_writer_writes():
    payloads = [flac.padded((t or "").encode()) for _, t in AWKWARD]
    for p, f, (back, offsets) in zip(payloads, files := flac.encode_files(payloads), flac.decode_files(files), strict=True):
        s, x, blocks = flac_any.decode(f)
        assert (x[:, 0] + 128).astype(np.uint8).tobytes() == p == back
        assert [b[2] for b in blocks] == offsets.tolist()
        assert all(s.first + o == blocks[at // flac.BLOCK][2] for at, o in s.seek)


def test_rows(spark, empty):
    file, _, raw = made(random.Random(3), 2, 16, [192, 64])
    df = spark.createDataFrame([(1, file, 5, "a"), (2, None, 5, "a"), (3, b"no", 5, "a"), (1, file, 5, "a")], "doc_id long, media binary, k0 int, t string")
    got = sorted(flac_any.pcm(df).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.channels, r.samples, r.error, r.k0, r.t) for r in got] == [(1, 2, 256, None, 5, "a")] * 2 + [(2, None, None, None, 5, "a"), (3, None, None, "not a FLAC stream", 5, "a")]
    assert bytes(got[0].pcm) == raw and [(b.sample, b.samples) for b in got[0].blocks] == [(0, 192), (192, 64)]
    assert flac_any.pcm(empty.select("doc_id", F.lit(None).cast("binary").alias("media"))).count() == 0
