"""A plain reader of FLAC files after the published format, bit by bit, to hold the operator's files against."""

import hashlib


class Bits:
    def __init__(self, data, at=0):
        self.data, self.at = data, at * 8

    def read(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | (self.data[self.at >> 3] >> (7 - (self.at & 7))) & 1
            self.at += 1
        return out

    def signed(self, n):
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self):
        n = 0
        while not self.read(1):
            n += 1
        return n


def crc(data, bits, poly):
    c, top, mask = 0, 1 << (bits - 1), (1 << bits) - 1
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
    return c


def residuals(b, size, order):
    method, parts = b.read(2), 1 << b.read(4)
    assert method in (0, 1)
    width = 4 + method
    out = []
    for p in range(parts):
        n, k = size // parts - (order if p == 0 else 0), b.read(width)
        if k == (1 << width) - 1:
            raw = b.read(5)
            out += [b.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            z = b.unary() << k | b.read(k)
            out.append(z >> 1 if z % 2 == 0 else -(z >> 1) - 1)
    return out


def subframe(b, size, depth):
    assert b.read(1) == 0
    kind = b.read(6)
    wasted = b.unary() + 1 if b.read(1) else 0
    depth -= wasted
    if kind == 0:
        x = [b.signed(depth)] * size
    elif kind == 1:
        x = [b.signed(depth) for _ in range(size)]
    else:
        order = kind - 8 if kind < 32 else kind - 31
        x = [b.signed(depth) for _ in range(order)]
        if kind < 32:
            coefficients, shift = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order], 0
        else:
            precision, shift = b.read(4) + 1, b.signed(5)
            coefficients = [b.signed(precision) for _ in range(order)]
        for r in residuals(b, size, order):
            x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coefficients)) >> shift))
    return [v << wasted for v in x]


def decode(data):
    """(channels, bits a sample, samples of each channel, seek points, offset of each frame) of a file."""
    assert data[:4] == b"fLaC"
    at, last, seek, info = 4, False, [], None
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            b = Bits(body, 10)
            b.read(20)
            info = (b.read(3) + 1, b.read(5) + 1, b.read(36), body[18:34])
        elif kind == 3:
            seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
    channels, depth, total, digest = info
    first, frames, out = at, [], [[] for _ in range(channels)]
    while at < len(data):
        b = Bits(data, at)
        assert b.read(14) == 0x3FFE and b.read(1) == 0
        b.read(1)
        code, rate, kind, sample, _ = b.read(4), b.read(4), b.read(4), b.read(3), b.read(1)
        lead = b.read(8)
        for _ in range(0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1):
            b.read(8)
        size = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}.get(code) or b.read(8 if code == 6 else 16) + 1
        b.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
        bits = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}[sample]
        head = b.at >> 3
        assert crc(data[at:head], 8, 0x07) == b.read(8)
        x = [subframe(b, size, bits + (kind == 8 and c == 1) + (kind == 9 and c == 0) + (kind == 10 and c == 1)) for c in range(2 if kind >= 8 else kind + 1)]
        if kind == 8:
            x[1] = [a - d for a, d in zip(*x, strict=True)]
        elif kind == 9:
            x[0] = [d + c for d, c in zip(*x, strict=True)]
        elif kind == 10:
            mid = [2 * m + (s & 1) for m, s in zip(*x, strict=True)]
            x = [[(m + s) >> 1 for m, s in zip(mid, x[1], strict=True)], [(m - s) >> 1 for m, s in zip(mid, x[1], strict=True)]]
        end = (b.at + 7) >> 3
        assert crc(data[at:end], 16, 0x8005) == int.from_bytes(data[end : end + 2], "big")
        frames.append((at, at - first, len(out[0]), size))
        for o, v in zip(out, x, strict=True):
            o += v
        at = end + 2
    assert all(len(o) == total for o in out)
    width = (depth + 7) // 8
    assert hashlib.md5(b"".join(int(v).to_bytes(width, "little", signed=True) for row in zip(*out, strict=True) for v in row)).digest() == digest
    return channels, depth, out, seek, frames
