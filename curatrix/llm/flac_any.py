"""A reader of FLAC files of any form: channels, depths, block sizes, predictors and Rice partitions.

It goes frame by frame, as a frame's end is known only once its last residual is read, and
keeps the bits of one frame at a time as positions of ones, so that a unary number is one
step. The batch reader of :mod:`flac` is the fast way for the files that module writes.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .flac import CRC8, CRC16, FIXED

# The format's codes of block sizes, of sample depths and of what follows a header.
SIZES = {1: 192} | {k: 576 << (k - 2) for k in range(2, 6)} | {k: 256 << (k - 8) for k in range(8, 16)}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
RATE_BYTES = {12: 1, 13: 2, 14: 2}
#: Most bytes of the stream that are unpacked into bits at once.
WINDOW = 1 << 16


class Bits:
    """Numbers of a byte string, bit by bit."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.low, self.high = data, at * 8, 0, 0
        self.ones = np.zeros(0, np.int64)

    def read(self, n: int) -> int:
        a, b = self.at, self.at + n
        if b > len(self.data) * 8:
            raise ValueError("the stream ends within a frame")
        whole = int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big")
        self.at = b
        return (whole >> (-b & 7)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """How many zeros stand before the next one, which is read too."""
        while True:
            if not self.low <= self.at < self.high:
                self._unpack(self.at >> 3)
            k = int(np.searchsorted(self.ones, self.at))
            if k < len(self.ones):
                n = int(self.ones[k]) - self.at
                self.at += n + 1
                return n
            # All zeros up to the end of the window: go on behind it.
            start = self.at
            while k == len(self.ones):
                if self.high >= len(self.data) * 8:
                    raise ValueError("the stream ends within a frame")
                self._unpack(self.high >> 3)
                k = 0 if len(self.ones) else len(self.ones)
            n = int(self.ones[0]) - start
            self.at = start + n + 1
            return n

    def _unpack(self, byte: int) -> None:
        part = np.frombuffer(self.data, np.uint8, min(WINDOW, len(self.data) - byte), byte)
        self.low, self.high = byte * 8, (byte + len(part)) * 8
        self.ones = np.flatnonzero(np.unpackbits(part)) + self.low

    def rice(self, n: int, k: int) -> list[int]:
        """``n`` signed numbers of Rice parameter ``k``."""
        out = []
        unary, read = self.unary, self.read
        for _ in range(n):
            z = unary() << k | (read(k) if k else 0)
            out.append((z >> 1) ^ -(z & 1))
        return out


@dataclass
class Stream:
    """What the head of a file says; ``depth`` is bits a sample."""

    rate: int
    channels: int
    depth: int
    samples: int
    md5: bytes
    first: int  # byte of the first frame
    seek: list[tuple[int, int]]  # sample, byte from the first frame on


def head(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, seek, info = 4, False, [], None
    while not last:
        if at + 4 > len(data):
            raise ValueError("the head is cut off")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), body[18:34])
        elif kind == 3:
            points = (struct.unpack_from(">QQH", body, i) for i in range(0, size - 17, 18))
            seek = [(s, o) for s, o, _ in points if s != (1 << 64) - 1]
        at += 4 + size
    if info is None:
        raise ValueError("the head has no STREAMINFO")
    return Stream(*info, at, seek)


def _checksum(data: bytes, table: np.ndarray, bits: int) -> int:
    c, t = 0, table.tolist()
    if bits == 8:
        for byte in data:
            c = t[c ^ byte]
    else:
        for byte in data:
            c = ((c << 8) & 0xFFFF) ^ t[(c >> 8) ^ byte]
    return c


def _residuals(b: Bits, size: int, order: int) -> list[int]:
    method = b.read(2)
    if method > 1:
        raise ValueError("unknown coding of residuals")
    width, parts, out = 4 + method, 1 << b.read(4), []
    if size % parts or size // parts < order:
        raise ValueError("partitions don't fit the block")
    for p in range(parts):
        n, k = size // parts - (0 if p else order), b.read(width)
        if k == (1 << width) - 1:
            raw = b.read(5)
            out += [b.signed(raw) for _ in range(n)]
        else:
            out += b.rice(n, k)
    return out


def _subframe(b: Bits, size: int, depth: int) -> np.ndarray:
    if b.read(1):
        raise ValueError("a subframe has no head")
    kind, wasted = b.read(6), 0
    if b.read(1):
        wasted = b.unary() + 1
    depth -= wasted
    if kind == 0:
        return np.full(size, b.signed(depth) << wasted, np.int64)
    if kind == 1:
        return np.array([b.signed(depth) for _ in range(size)], np.int64) << wasted
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if not 0 <= order <= size:
        raise ValueError("unknown kind of subframe")
    x = [b.signed(depth) for _ in range(order)]
    shift, taps = 0, FIXED[order] if kind < 32 else ()
    if kind >= 32:
        precision, shift = b.read(4) + 1, b.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("a predictor has no precision")
        taps = [b.signed(precision) for _ in range(order)]
    back = list(taps)[::-1]
    for r in _residuals(b, size, order):
        x.append(r + (sum(map(int.__mul__, back, x[len(x) - order :])) >> shift) if order else r)
    return np.array(x, np.int64) << wasted


def _number(b: Bits) -> int:
    """A frame's or sample's number in its code of one to seven bytes."""
    lead = b.read(8)
    more = 0
    while lead & (0x80 >> more):
        more += 1
    if more in (1, 8):
        raise ValueError("a frame's number is broken")
    n = lead & (0x7F >> more)
    for _ in range(max(0, more - 1)):
        n = n << 6 | b.read(8) & 0x3F
    return n


def decode(data: bytes) -> tuple[Stream, np.ndarray, list[tuple[int, int, int]]]:
    """The head, samples (a row for each point in time, a column for each channel), and of each block its first
    sample, its samples and the byte of the file where it begins. Raises ValueError if a checksum doesn't hold."""
    s = head(data)
    at, done, blocks, parts = s.first, 0, [], []
    while at < len(data):
        b = Bits(data, at)
        if b.read(15) != 0x7FFC:
            raise ValueError("a frame doesn't begin where it should")
        variable, code, rate, pairing, depth = b.read(1), b.read(4), b.read(4), b.read(4), b.read(3)
        b.read(1)
        number = _number(b)
        size = SIZES.get(code) or (b.read(8) + 1 if code == 6 else b.read(16) + 1 if code == 7 else 0)
        b.read(8 * RATE_BYTES.get(rate, 0))
        end = b.at >> 3
        if _checksum(data[at:end], CRC8, 8) != b.read(8):
            raise ValueError("a frame's head differs from its checksum")
        depth = DEPTHS.get(depth, s.depth)
        if not size or pairing > 10 or variable and number != done:
            raise ValueError("a frame's head can't be read")
        side = {8: 1, 9: 0, 10: 1}.get(pairing)  # this one of two channels holds their difference
        x = [_subframe(b, size, depth + (c == side)) for c in range(pairing + 1 if side is None else 2)]
        if pairing == 8:
            x[1] = x[0] - x[1]
        elif pairing == 9:
            x[0] = x[0] + x[1]
        elif pairing == 10:
            twice = (x[0] << 1) | (x[1] & 1)
            x = [(twice + x[1]) >> 1, (twice - x[1]) >> 1]
        end = (b.at + 7) >> 3
        if _checksum(data[at:end], CRC16, 16) != int.from_bytes(data[end : end + 2], "big") or end + 2 > len(data):
            raise ValueError("a frame differs from its checksum")
        if len(x) != s.channels:
            raise ValueError("a frame has other channels than its file")
        blocks.append((done, size, at))
        parts.append(np.stack(x, 1))
        done, at = done + size, end + 2
    samples = np.concatenate(parts) if parts else np.zeros((0, s.channels), np.int64)
    if s.samples and s.samples != done:
        raise ValueError("samples are missing")
    if any(s.md5) and hashlib.md5(packed(samples, s.depth)).digest() != s.md5:
        raise ValueError("samples differ from their checksum")
    return s, samples, blocks


def packed(samples: np.ndarray, depth: int) -> bytes:
    """Samples in turn over channels, each in as few whole bytes as ``depth`` needs, little-endian, signed."""
    width = (depth + 7) // 8
    return samples.astype("<i8").view(np.uint8).reshape(*samples.shape, 8)[..., :width].tobytes()


def pcm(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of ``df`` and, of the FLAC file in ``media_col``: ``rate``, ``channels``, ``depth``, ``samples`` (in each channel),
    ``pcm`` (see :func:`packed`) and ``blocks`` (array of the first sample, samples and byte offset of each block), ``error``.

    A null file has nulls. A file that can't be read has nulls and says why in ``error``. Rows stand for
    themselves; an empty table gives an empty result. A file is one row, so it may hold what a row may.
    """

    def factory():
        def work(files: pa.Array) -> list[pa.Array]:
            rows = []
            for f in files.to_pylist():
                try:
                    s, x, blocks = decode(f) if f is not None else (None, None, None)
                    rows.append((s.rate, s.channels, s.depth, len(x), packed(x, s.depth), blocks, None) if s else (None,) * 7)
                except ValueError as e:
                    rows.append((None,) * 6 + (str(e),))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.struct([("sample", pa.int64()), ("samples", pa.int32()), ("byte", pa.int64())])), pa.string())
            named = lambda v: [dict(zip(("sample", "samples", "byte"), b, strict=True)) for b in v] if v is not None else None
            return [pa.array([named(r[i]) if i == 5 else r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return work

    keep = {c: common.column(df, c) for c in df.columns}
    fields = "rate int, channels int, depth int, samples long, pcm binary, blocks array<struct<sample:long,samples:int,byte:long>>, error string"
    return common.map_texts(df, keep, common.column(df, media_col), fields, factory)
