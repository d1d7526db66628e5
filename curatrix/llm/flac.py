"""FLAC in numpy: whole batches of frames are coded and decoded side by side.

Samples are bytes less 128, one channel, 8 bits, 192 samples a frame. A step of the
decoder reads the next Rice code of every frame of a batch at once, so the bit by bit
dependence inside a frame costs one array operation for thousands of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 192
RATE = 8000
#: Bytes whose frames are coded in step: a step costs the same for few frames as for many.
STEP_BYTES = 2 << 20
#: A seek point for every so many frames.
SEEK_EVERY = 64
#: The format's fixed predictors of order 0 to 4.
FIXED = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)]
LPC_ORDER, LPC_SHIFT, LPC_BITS = 2, 6, 9
CONSTANT, VERBATIM, RICE = 0, 1, 2


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c & top else 0)) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each range, all ranges in step."""
    table = CRC8 if bits == 8 else CRC16
    crc = np.zeros(len(starts), np.uint32)
    order = np.argsort(-lens, kind="stable")
    s, n = starts[order], lens[order]
    left = np.searchsorted(-n, -np.arange(1, (int(n[0]) if len(n) else 0) + 1), "right")
    c = crc[order]
    for i, m in enumerate(left):
        byte = data[s[:m] + i]
        if bits == 8:
            c[:m] = table[c[:m] ^ byte]
        else:
            c[:m] = ((c[:m] << 8) & 0xFFFF) ^ table[(c[:m] >> 8) ^ byte]
    crc[order] = c
    return crc


def _coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 like code: bytes (rows of 7) and their lengths."""
    out = np.zeros((len(n), 7), np.uint8)
    size = np.ones(len(n), np.int64)
    for k, limit in enumerate((7, 11, 16, 21, 26, 31, 36)):
        size[n >= (1 << limit)] = k + 2
    for k in range(1, 8):
        rows = size == k
        if not rows.any():
            continue
        v = n[rows]
        if k == 1:
            out[rows, 0] = v
            continue
        lead = (0xFF00 >> k) & 0xFF
        out[rows, 0] = lead | (v >> (6 * (k - 1)))
        for j in range(1, k):
            out[rows, j] = 0x80 | ((v >> (6 * (k - 1 - j))) & 0x3F)
    return out, size


def _residuals(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    r = x
    yield 0, r
    for order in range(1, 3):
        r = np.diff(r, axis=1)
        yield order, r


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameter of the fewest bits near the mean, and those bits."""
    mean = np.maximum(z.mean(axis=1), 0.5)
    guess = np.clip(np.log2(mean).astype(np.int64), 0, 13)
    best, bits = guess, np.full(len(z), 1 << 40, np.int64)
    for d in (-1, 0, 1):
        k = np.clip(guess + d, 0, 14)
        n = (z >> k[:, None]).sum(axis=1) + z.shape[1] * (1 + k)
        better = n < bits
        best, bits = np.where(better, k, best), np.where(better, n, bits)
    return best, bits


def _predictor(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a linear predictor of order 2 for each block."""
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1) + 1e-9, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    a = np.stack([(r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -top, top).astype(np.int64)


def encode_blocks(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of rows of BLOCK samples (int) with those frame numbers: bytes and offsets."""
    n = len(x)
    x = x.astype(np.int32)
    kind, order, param = np.full(n, VERBATIM), np.zeros(n, np.int64), np.zeros(n, np.int64)
    bits = np.full(n, 8 + 8 * BLOCK, np.int64)
    coefs = np.zeros((n, LPC_ORDER), np.int64)
    lpc = np.zeros(n, bool)
    for o, r in _residuals(x):
        k, b = _rice(_zigzag(r))
        b = b + 8 + 8 * o + 10
        better = b < bits
        bits, param = np.where(better, b, bits), np.where(better, k, param)
        kind[better], order[better] = RICE, o
    c = _predictor(x)
    guess = (c[:, :1] * x[:, 1:-1] + c[:, 1:] * x[:, :-2]) >> LPC_SHIFT
    residual = (x[:, 2:] - guess).astype(np.int32)
    k, b = _rice(_zigzag(residual))
    b = b + 8 + 8 * LPC_ORDER + 4 + 5 + LPC_BITS * LPC_ORDER + 10
    better = b < bits
    bits, param, lpc = np.where(better, b, bits), np.where(better, k, param), better
    kind[better], order[better], coefs[better] = RICE, LPC_ORDER, c[better]
    same = (x == x[:, :1]).all(axis=1)
    kind[same], order[same], bits[same], lpc[same] = CONSTANT, 0, 16, False

    coded, coded_len = _coded_number(number)
    head = 4 + coded_len + 1
    size = head + (bits + 7) // 8 + 2
    ends = np.cumsum(size)
    starts = ends - size
    out = np.zeros(int(ends[-1]) + 16 if n else 16, np.uint8)
    for i, byte in enumerate((0xFF, 0xF8, 0x14, 0x02)):  # fixed blocks of 192, 8000 Hz, mono, 8 bits
        out[starts + i] = byte
    for i in range(7):
        rows = coded_len > i
        out[starts[rows] + 4 + i] = coded[rows, i]
    out[starts + 4 + coded_len] = _crc(out, starts, 4 + coded_len, 8)

    at, fields = (starts + head) * 8, []  # fields: bit offsets, widths up to 9, values

    def put(rows: np.ndarray, offset: np.ndarray, width: int | np.ndarray, value: np.ndarray) -> None:
        fields.append((offset, np.broadcast_to(width, offset.shape).astype(np.int64), np.asarray(value, np.int64) & ((1 << np.asarray(width, np.int64)) - 1)))

    subtype = np.where(kind == CONSTANT, 0, np.where(kind == VERBATIM, 1, np.where(lpc, 31 + order, 8 + order)))
    put(np.arange(n), at, 8, np.where(lpc, (32 + order - 1), subtype) << 1)
    here = at + 8
    rows = np.flatnonzero(kind == CONSTANT)
    put(rows, here[rows], 8, x[rows, 0])
    rows = np.flatnonzero(kind == VERBATIM)
    put(rows, (here[rows, None] + 8 * np.arange(BLOCK)).ravel(), 8, x[rows].ravel())
    rice = np.flatnonzero(kind == RICE)
    for j in range(2):
        rows = rice[order[rice] > j]
        put(rows, here[rows] + 8 * j, 8, x[rows, j])
    here = here + 8 * order
    rows = np.flatnonzero(lpc)
    put(rows, here[rows], 4, np.full(len(rows), LPC_BITS - 1))
    put(rows, here[rows] + 4, 5, np.full(len(rows), LPC_SHIFT))
    for j in range(LPC_ORDER):
        put(rows, here[rows] + 9 + LPC_BITS * j, LPC_BITS, coefs[rows, j])
    here = here + np.where(lpc, 9 + LPC_BITS * LPC_ORDER, 0)
    put(rice, here[rice] + 6, 4, param[rice])  # method 0, partition order 0 before it
    here = here + 10
    for o in range(3):
        for is_lpc in (False, True):
            rows = rice[(order[rice] == o) & (lpc[rice] == is_lpc)]
            if not len(rows):
                continue
            r = residual[rows] if is_lpc else np.diff(x[rows], n=o, axis=1) if o else x[rows]
            z, k = _zigzag(r).astype(np.int64), param[rows, None]
            length = (z >> k) + 1 + k
            end = here[rows, None] + np.cumsum(length, axis=1)
            width = np.broadcast_to(k + 1, z.shape)
            put(rows, (end - width).ravel(), width.ravel(), ((1 << k) | (z & ((1 << k) - 1))).ravel())
    offset = np.concatenate([f[0] for f in fields])
    width = np.concatenate([f[1] for f in fields])
    value = np.concatenate([f[2] for f in fields]) << (24 - (offset & 7) - width)
    byte = offset >> 3
    for i in range(3):  # fields share bytes but no bits, so a sum puts them together
        part = (value >> (16 - 8 * i)) & 0xFF
        if i < 2 or part.any():
            out[: len(out)] += np.bincount(byte + i, weights=part, minlength=len(out))[: len(out)].astype(np.uint8)
    crc = _crc(out, starts, size - 2, 16)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    return out[: int(ends[-1]) if n else 0], np.concatenate([starts, ends[-1:]]) if n else np.zeros(1, np.int64)


def file_head(samples: int, md5: bytes, frame_sizes: np.ndarray) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE."""
    smallest, largest = (int(frame_sizes.min()), int(frame_sizes.max())) if len(frame_sizes) else (0, 0)
    info = struct.pack(">HH", BLOCK, BLOCK) + smallest.to_bytes(3, "big") + largest.to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | samples).to_bytes(8, "big") + md5
    first = np.cumsum(frame_sizes) - frame_sizes
    points = b"".join(struct.pack(">QQH", i * BLOCK, int(first[i]), BLOCK) for i in range(0, len(frame_sizes), SEEK_EVERY))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload; its length is a positive multiple of BLOCK."""
    blocks = np.array([len(p) // BLOCK for p in payloads], np.int64)
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
    first = np.cumsum(blocks) - blocks
    number = np.arange(len(x)) - np.repeat(first, blocks)
    data, offsets = encode_blocks(x, number)
    sizes, signed = np.diff(offsets), (x & 0xFF).astype(np.uint8)
    out = []
    for i, p in enumerate(payloads):
        a, b = first[i], first[i] + blocks[i]
        md5 = hashlib.md5(signed[a:b].tobytes()).digest()
        out.append(file_head(len(p), md5, sizes[a:b]) + data[offsets[a] : offsets[b]].tobytes())
    return out


def _head(data: bytes) -> tuple[int, int, bytes]:
    """Where frames begin, how many samples there are, and the checksum of all of them."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, samples, md5 = 4, 0, b""
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            info = data[at + 4 : at + 4 + size]
            block, _ = struct.unpack(">HH", info[:4])
            packed = int.from_bytes(info[10:18], "big")
            samples, md5 = packed & ((1 << 36) - 1), info[18:34]
            if block != BLOCK or (packed >> 36) & 31 != 7 or (packed >> 41) & 7:
                raise ValueError("only mono 8-bit streams of 192 samples a block are read")
        at += 4 + size
        if kind & 0x80:
            return at, samples, md5


class _Bits:
    """A cursor for each frame over one byte array; reads move all of some cursors."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(padded) - 8,), (1,))
        self.at, self.keep = at.astype(np.int64) * 8, padded

    def window(self, rows) -> np.ndarray:
        at = self.at[rows]
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, rows, n) -> np.ndarray:
        out = (self.window(rows) >> np.uint64(64 - n)).astype(np.int64)
        self.at[rows] += n
        return out

    def signed(self, rows, n: int) -> np.ndarray:
        v = self.read(rows, n)
        return v - ((v >> (n - 1)) << n)


def decode_files(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and the byte offset of every frame, for each file; checksums are verified."""
    heads = [_head(f) for f in files]
    data = np.frombuffer(b"".join(files), np.uint8)
    base = np.cumsum([0, *map(len, files)])
    blocks = np.array([s // BLOCK for _, s, _ in heads], np.int64)
    most, last = int(blocks.max(initial=0)), base[1:]
    samples = np.zeros((int(blocks.sum()), BLOCK), np.int64)
    first = np.cumsum(blocks) - blocks
    place = np.zeros(len(samples), np.int64)
    # Where a frame ends is known only once it is read; sync codes give candidates,
    # the header checksum and the frame number tell true ones.
    starts, number, owner = _frame_starts(data, base, np.array([h[0] for h in heads]), blocks)
    place[first[owner] + number] = starts
    if len(starts) != len(samples) or most and (np.bincount(owner, minlength=len(files)) != blocks).any():
        raise ValueError("frames are missing")
    ends = np.concatenate([place[1:], [0]])
    ends[first + blocks - 1] = last
    samples[:] = _decode_frames(data, place, ends, _coded_length(data, place))
    raw = (samples & 0xFF).astype(np.uint8)
    plain = (raw + 128).astype(np.uint8)
    out = []
    for i, (_, n, md5) in enumerate(heads):
        a, b = first[i], first[i] + blocks[i]
        if n and hashlib.md5(raw[a:b].tobytes()).digest() != md5:
            raise ValueError("samples differ from their checksum")
        out.append((plain[a:b].tobytes(), place[a:b] - base[i]))
    return out


def _coded_length(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    lead = data[starts + 4]
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, np.where(lead < 0xFE, 6, 7))))))


def _frame_starts(data: np.ndarray, base: np.ndarray, head: np.ndarray, blocks: np.ndarray):
    """Chains of frames: from each file's first frame on, all files in step.

    A candidate is a sync code followed by a header whose checksum holds and whose
    number is its index among the file's frames; the checksum of the whole frame,
    verified afterwards, settles it.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    hit = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    hit = hit[hit + 6 <= n]
    owner = np.searchsorted(base, hit, "right") - 1
    fits = hit >= (base[:-1] + head)[owner]
    fits &= (data[hit + 2] == 0x14) & (data[hit + 3] == 0x02)
    hit, owner = hit[fits], owner[fits]
    size = _coded_length(data, hit)
    whole = hit + 5 + size <= n
    hit, owner, size = hit[whole], owner[whole], size[whole]
    good = _crc(data, hit, 4 + size, 8) == data[hit + 4 + size]
    hit, owner, size = hit[good], owner[good], size[good]
    lead = data[hit + 4].astype(np.int64)
    number = np.where(size == 1, lead, lead & ((1 << np.maximum(7 - size, 0)) - 1))
    for j in range(1, 7):
        rows = size > j
        number[rows] = (number[rows] << 6) | (data[hit[rows] + 4 + j] & 0x3F)
    keep = number < blocks[owner]
    hit, owner, number = hit[keep], owner[keep], number[keep]
    # The same number twice: the one that follows its predecessor by a whole, valid frame.
    key = owner * (int(blocks.max()) + 1) + number
    order = np.lexsort((hit, key))
    key, hit, owner, number = key[order], hit[order], owner[order], number[order]
    if len(key) and (np.diff(key) == 0).any():
        hit, owner, number = _by_checksum(data, base, key, hit, owner, number, blocks)
    return hit, number, owner


def _by_checksum(data, base, key, hit, owner, number, blocks):
    """Resolve doubtful candidates of a file by walking from frame to frame."""
    keep = []
    doubtful = set(owner[1:][np.diff(key) == 0].tolist())
    for f in doubtful:
        rows = np.flatnonzero(owner == f)
        by_number: dict[int, list[int]] = {}
        for r in rows:
            by_number.setdefault(int(number[r]), []).append(int(r))
        paths = [[r] for r in by_number[0][:1]]
        for k in range(1, int(blocks[f]) + 1):
            step = []
            for path in paths:
                a = hit[path[-1]]
                for r in by_number.get(k, []) if k < blocks[f] else [None]:
                    b = hit[r] if r is not None else base[f + 1]
                    if b - a > 8 and _crc(data, np.array([a]), np.array([b - a - 2]), 16)[0] == (int(data[b - 2]) << 8 | int(data[b - 1])):
                        step.append([*path, r])
            paths = step
        keep += [r for r in paths[0] if r is not None] if paths else []
    rows = np.array(sorted([*keep, *np.flatnonzero(~np.isin(owner, list(doubtful))).tolist()]), np.int64)
    return hit[rows], owner[rows], number[rows]


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, coded: np.ndarray) -> np.ndarray:
    n = len(starts)
    x = np.zeros((BLOCK, n), np.int64)  # one row a sample: steps read and write whole rows
    if not n:
        return x.T
    crc = _crc(data, starts, ends - starts - 2, 16)
    if (crc != (data[ends - 2].astype(np.uint32) << 8 | data[ends - 1])).any():
        raise ValueError("a frame differs from its checksum")
    bits, every = _Bits(data, starts + 5 + coded), np.arange(n)
    kind = bits.read(every, 8) >> 1
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    rows = np.flatnonzero(kind == 0)
    x[:, rows] = bits.signed(rows, 8)
    rows = np.flatnonzero(kind == 1)
    for t in range(BLOCK if len(rows) else 0):
        x[t, rows] = bits.signed(rows, 8)
    rows = np.flatnonzero(kind >= 8)
    for t in range(int(order.max())):
        some = rows[order[rows] > t]
        x[t, some] = bits.signed(some, 8)
    longest = max(1, int(order.max()))
    coefs, shift = np.zeros((longest, n), np.int64), np.zeros(n, np.int64)
    lpc = np.flatnonzero(kind >= 32)
    if len(lpc):
        precision = bits.read(lpc, 4) + 1
        shift[lpc] = bits.signed(lpc, 5)
        for p in np.unique(precision):
            for j in range(longest):
                some = lpc[(precision == p) & (order[lpc] > j)]
                coefs[j, some] = bits.signed(some, int(p))
    for o in range(1, 5):
        some = np.flatnonzero(kind == 8 + o)
        for j, c in enumerate(FIXED[o] if len(some) else ()):
            coefs[j, some] = c
    if (bits.read(rows, 6) != 0).any():
        raise ValueError("only one Rice partition with 4-bit parameters is read")
    k = bits.read(rows, 4)
    # Rows of one order lie together, so a step moves one slice of them.
    rank = np.argsort(order[rows], kind="stable")
    rows, k = rows[rank], k[rank].astype(np.uint64)
    have = np.searchsorted(order[rows], np.arange(BLOCK), "right")
    at, words = bits.at[rows], bits.words
    co, sh, o_ = coefs[:, rows], shift[rows], order[rows]
    y = x[:, rows]
    low = (np.uint64(1) << k) - np.uint64(1)
    for t in range(BLOCK):
        m = int(have[t])
        a = at[:m]
        w = words[a >> 3].astype(np.uint64) << (a & 7).astype(np.uint64)
        zeros = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        far = np.flatnonzero(zeros >= 32)
        q, skip = zeros, zeros
        if len(far):
            q = zeros.copy()
            for i in far:
                q[i] = _zeros(data, int(a[i]))
            a2 = a + q
            w = words[a2 >> 3].astype(np.uint64) << (a2 & 7).astype(np.uint64)
            skip = np.zeros_like(q)
        rest = (w << (skip.astype(np.uint64) + np.uint64(1))) >> (np.uint64(63) - k[:m]) >> np.uint64(1)
        z = (q << k[:m].astype(np.int64)) | (rest & low[:m]).astype(np.int64)
        at[:m] = a + q + 1 + k[:m].astype(np.int64)
        r = (z >> 1) ^ -(z & 1)
        guess = np.zeros(m, np.int64)
        for j in range(min(t, len(co))):
            guess += co[j, :m] * y[t - 1 - j, :m]
        y[t, :m] = r + (guess >> sh[:m])
    x[:, rows] = y
    return x.T


def _zeros(data: np.ndarray, at: int) -> int:
    n = 0
    while not (data[(at + n) >> 3] >> (7 - ((at + n) & 7))) & 1:
        n += 1
    return n


def padded(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of BLOCK bytes."""
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``media``: a FLAC file of the text's UTF-8 bytes, for each row.

    A null text is the empty text; its file holds one block of spaces. Null and repeated
    keys, repeated rows and extra columns change nothing; an empty table gives an empty
    result. Equal texts give equal files.
    """

    def factory():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(encode_files([padded(t.encode()) for t in texts.to_pylist()]), pa.binary())]

        return work

    text = common.text_or_empty(df, text_col)
    keep = {id_col: common.column(df, id_col), "n_bytes": F.octet_length(text).cast("long")}
    return common.map_texts(df, keep, text, "media binary", factory, STEP_BYTES)


def read_back(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of ``df`` and the decoded file: ``pcm`` (bytes), ``block_samples``,
    ``block_offsets`` (where in the file each block begins; block i holds the samples
    from i * block_samples on), ``feature``.

    Raises an error if a checksum of a frame or of a file doesn't hold; null media too.
    """

    def factory():
        def work(files: pa.Array) -> list[pa.Array]:
            read = decode_files(files.to_pylist())
            return [
                pa.array([p for p, _ in read], pa.binary()),
                pa.array([BLOCK] * len(read), pa.int32()),
                pa.array([o for _, o in read], pa.list_(pa.int64())),
                pa.array([feature(p) for p, _ in read], pa.string()),
            ]

        return work

    keep = {c: common.column(df, c) for c in df.columns}
    return common.map_texts(df, keep, common.column(df, media_col), "pcm binary, block_samples int, block_offsets array<long>, feature string", factory, STEP_BYTES)


def feature(pcm: bytes) -> str:
    """Peak, mean, mean square, sign changes and the checksum of the samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int16) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"peak={int(np.abs(x).max())};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};power={int((x.astype(np.int32) ** 2).sum(dtype=np.int64)) / len(x):.4f};changes={changes};crc={zlib.crc32(pcm):08x}"
