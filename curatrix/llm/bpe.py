"""Byte-pair vocabularies: a streaming encoder, a decoder and a token counter.

The encoder is a transducer over bytes. After each byte it knows the last token
that the merge list gives to what was read of a pre-token: an automaton over the
vocabulary names the tokens that end there, and one look-up of a pair decides which
of them it is, as a sequence of tokens is the result of the merges exactly if each two
neighbours are what the merges give for their joined bytes. The merge list's sufficient
lookahead is worked out once; a token that ends that many bytes before what was
read is stable and emitted, so what is held doesn't grow with the pre-token.

The counter runs the merges themselves with a heap and a linked list.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the published pre-token pattern of the byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens up to this many characters are remembered, at most so many at a time.
#: Those that were not met while as many others were are forgotten.
CACHED_CHARS, CACHED_WORDS = 64, 250_000
#: Longer texts are cut into pre-tokens lazily, so that memory doesn't grow with the text.
LAZY_CHARS, LAZY_TOKENS = 1 << 20, 1 << 16
#: Pairs of tokens whose fit is remembered, at most.
KNOWN_PAIRS = 500_000
NEVER = 1 << 30


def _byte_names() -> dict[str, int]:
    """The characters that stand for the bytes in published byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return names | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A merge list: ranks of pairs, bytes of tokens, special tokens.

    A pair must come after the pairs that make its two sides, as in every trained list.
    """

    def __init__(self, tokens: list[bytes], pairs: list[tuple[int, int, int]], special: dict[str, int]):
        self.tokens, self.special = tokens, special
        self.of_bytes = {b: i for i, b in enumerate(tokens) if b}
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(pairs)}
        self.merged = [c for _, _, c in pairs]
        self.longest = max(map(len, tokens))
        self.byte_ids = [self.of_bytes[bytes([b])] for b in range(256)]
        self.parts = {c: (a, b, r) for r, (a, b, c) in reversed(list(enumerate(pairs)))}
        if any(self.parts[x][2] > r for r, (a, b, _) in enumerate(pairs) for x in (a, b) if x in self.parts):
            raise ValueError("a pair comes before a pair that makes one of its sides")
        same = {r: r for r in range(len(pairs))} | {NEVER: NEVER}  # one object for each number
        self.head = [self._edge(t, 0, same) for t in range(len(tokens))]
        self.tail = [self._edge(t, 1, same) for t in range(len(tokens))]
        self.known: dict[int, bool] = {}
        self.reached = {b: t for b, t in self.of_bytes.items() if t in self.parts and self._whole(t) or len(b) == 1}
        self.lookahead = self.sufficient_lookahead(pairs)

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, "rb") as f:
            return cls.parsed(f.read())

    @classmethod
    def parsed(cls, source: bytes) -> Merges:
        spec = json.loads(source)
        names, model = _byte_names(), spec["model"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        tokens = [b""] * (1 + max([*model["vocab"].values(), *special.values()]))
        for text, i in model["vocab"].items():
            if text not in special:
                tokens[i] = bytes(names[c] for c in text)
        pairs = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]))
        return cls(tokens, pairs, special)

    def _edge(self, t: int, side: int, same: dict[int, int]) -> tuple[int, ...]:
        """Symbol and rank at which it is merged on, in turn, along one side of a token, from its byte up."""
        up = [NEVER, t]
        while t in self.parts:
            rank, t = self.parts[t][2], self.parts[t][side]
            up += (same[rank], t)
        return tuple(up[::-1])

    def _whole(self, t: int) -> bool:
        """Do the merges turn the token's own bytes into it?"""
        a, b, r = self.parts[t]
        return (a not in self.parts or self._whole_known(a)) and (b not in self.parts or self._whole_known(b)) and self.fits(a, b, r)

    @lru_cache(maxsize=None)  # noqa: B019  one vocabulary lives as long as its worker
    def _whole_known(self, t: int) -> bool:
        return self._whole(t)

    def fits(self, left: int, right: int, until: int = NEVER) -> bool:
        """Do no merges of a rank under ``until`` cross the border of the two tokens?"""
        a, b, i, j, rank = self.tail[left], self.head[right], 0, 0, self.rank
        while True:
            rx, ry = a[i + 1], b[j + 1]
            r = rank.get((a[i], b[j]), NEVER)
            if r < rx and r <= ry and r < until:
                return False
            if rx <= ry:
                if rx == NEVER:
                    return True
                i += 2
            else:
                j += 2

    def sufficient_lookahead(self, pairs: list[tuple[int, int, int]]) -> int:
        """How many bytes before the end of what was read the bytes to come can change a token at most.

        Merges happen in the order of the list. Bytes to come first matter where a merge (u, v)
        crosses the end of what was read: u lies before it. From then on the results with
        and without them differ from the start of u on, and a later merge carries the difference
        over its own u if its v stands there, which then begins with the bytes of the u before. So
        the bound is the largest sum of |u| over chains of ever later merges of this kind; it
        is found in one pass over the list.
        """
        furthest: dict[bytes, int] = {}
        for a, b, _ in pairs:
            u, v = self.tokens[a], self.tokens[b]
            reach = len(u) + max((furthest.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
            furthest[u] = max(furthest.get(u, 0), reach)
        return max(furthest.values(), default=0)

    def automaton(self) -> tuple[dict[int, int], list[int], list[int], list[int], list[int]]:
        """Suffix automaton of the tokens that merges make: steps by (state, byte), the state to fall
        back to, the longest token that ends in a state; by token, the longest shorter one that it ends
        with, and its length."""
        step, fail, ends, depth = {}, [0], [-1], [0]
        for raw, t in self.reached.items():
            node = 0
            for b in raw:
                to = step.get(node << 8 | b)
                if to is None:
                    to = step[node << 8 | b] = len(fail)
                    fail.append(0)
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                node = to
            ends[node] = t
        shorter, size = [-1] * len(self.tokens), [len(b) for b in self.tokens]
        # Shallow states first: what a state falls back to is shallower and done.
        for key in sorted(step, key=lambda k: depth[step[k]]):
            node, b, to = key >> 8, key & 255, step[key]
            if node:
                back = fail[node]
                while back and back << 8 | b not in step:
                    back = fail[back]
                fail[to] = step.get(back << 8 | b, 0)
            below = ends[fail[to]]
            if ends[to] < 0:
                ends[to] = below
            else:
                shorter[ends[to]] = below
        return step, fail, ends, shorter, size


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Transducer:
    """Bytes of one pre-token in, tokens out once they are stable.

    It keeps the last token after each byte since the last emitted one. Of the tokens that
    lead to the newest byte those that end the lookahead or more before it are emitted,
    so twice the lookahead and a token are held at most.
    """

    def __init__(self, merges: Merges):
        self.m, self.parts = merges, merges.automaton()
        self.ahead = max(merges.lookahead, merges.longest)
        self.held = 0  # most states kept so far
        self.reset()

    def reset(self) -> None:
        self.last = [-1]  # the token before the last emitted border (-1: none), then the last token after each byte
        self.node = 0

    def feed(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), self.ahead):
            self._advance(data[k : k + self.ahead])
            self.held = max(self.held, len(self.last))
            if len(self.last) > self.ahead + 1:
                yield from self._stable()
            if len(self.m.known) > KNOWN_PAIRS:
                self.m.known.clear()

    def _advance(self, data: bytes) -> None:
        """The last token after each new byte: the one that ends there and fits the token before it."""
        step, fail, ends, shorter, size = self.parts
        last, node, known, fits = self.last, self.node, self.m.known, self.m.fits
        end = len(last)
        for b in data:
            to = step.get(node << 8 | b)
            while to is None:
                node = fail[node]
                to = step.get(node << 8 | b)
            node = to
            t = ends[node]
            while True:
                start = end - size[t]
                if start >= 0:  # else it would reach over the border
                    left = last[start]
                    if left < 0:
                        break
                    pair = left << 32 | t
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = fits(left, t)
                    if ok:
                        break
                t = shorter[t]
            last.append(t)
            end += 1
        self.node = node

    def _stable(self) -> Iterator[int]:
        """Emit the tokens that end the lookahead or more before the newest byte."""
        last, size, at = self.last, self.parts[4], len(self.last) - 1
        border = at - self.ahead
        while at > border:
            at -= size[last[at]]
        if at > 0:
            yield from self._path(at)
            self.last = last[at:]  # its first is the token before the border

    def _path(self, end: int) -> list[int]:
        out, last, size = [], self.last, self.parts[4]
        while end:
            out.append(last[end])
            end -= size[out[-1]]
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._path(len(self.last) - 1)
        self.reset()
        return out


class Memory(dict):
    """Results of pre-tokens in two generations, so that common ones survive a bounded size."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def __missing__(self, word: str):
        out = self.older.get(word)
        if out is None:
            out = self.made(word)
        if len(word) <= CACHED_CHARS:
            self[word] = out
        return out

    def turn(self) -> None:
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()


class Encoder(Memory):
    """Pre-tokens as packed little-endian ids; texts are cut at special tokens first."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.m, self.t = merges, Transducer(merges)
        self.find = regex.compile(PRETOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None

    def made(self, word: str) -> bytes:
        raw = word.encode()
        one = self.m.reached.get(raw)
        ids = [one] if one is not None else [*self.t.feed(raw), *self.t.finish()]
        return pack(ids)

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text in packed pieces; memory stays bounded for long texts."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield pack([self.m.special[part]])
            elif len(part) <= LAZY_CHARS:
                yield b"".join(map(self.__getitem__, self.find.findall(part)))
            else:
                words = (x.group() for x in self.find.finditer(part))
                while some := list(islice(words, LAZY_TOKENS)):
                    yield b"".join(map(self.__getitem__, some))
        self.turn()

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))


class Decoder:
    """Ids to text piece by piece; holds back the bytes of a character that isn't complete."""

    def __init__(self, merges: Merges):
        self.table = [*merges.tokens]
        for text, i in merges.special.items():
            self.table[i] = text.encode()
        self.rest = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if need > back else 0
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.rest + b"".join(map(self.table.__getitem__, ids))
        keep = self._open(data)
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


class Counter(Memory):
    """How many tokens a pre-token has, found with a heap over linked symbols."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.m = merges
        self.find = regex.compile(PRETOKEN)
        self.special = Encoder(merges).special

    def made(self, word: str) -> int:
        return self.merged_length(word.encode())

    def merged_length(self, raw: bytes) -> int:
        """Initial symbols less merges: pop the pair of lowest rank, leftmost first, link over it."""
        rank, merged = self.m.rank, self.m.merged
        symbol = [self.m.byte_ids[b] for b in raw]
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = rank.get((symbol[i], symbol[i + 1]))
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if j >= n or symbol[i] < 0 or rank.get((symbol[i], symbol[j])) != r:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbol[i], symbol[j] = merged[r], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                s = rank.get((symbol[i], symbol[k]))
                if s is not None:
                    heapq.heappush(heap, (s, i))
            h = left[i]
            if h >= 0:
                s = rank.get((symbol[h], symbol[i]))
                if s is not None:
                    heapq.heappush(heap, (s, h))
        return n - merges

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                total += 1
            elif len(part) <= LAZY_CHARS:
                total += sum(map(self.__getitem__, self.find.findall(part)))
            else:
                total += sum(self[x.group()] for x in self.find.finditer(part))
        self.turn()
        return total


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text with the vocabulary at ``path`` and decode the ids again.

    Returns one row for each row: ``id_col`` as it is, ``ids`` (binary: little-endian
    unsigned 32-bit ids; see :func:`ids_array`) and ``decoded`` (string). A null text is
    the empty text: no ids, empty string. Null or repeated keys, repeated rows and extra
    columns of any name change nothing; an empty table gives an empty result. The length
    of a text is bounded only by what one row may hold. The driver reads the vocabulary
    and sends it to the executors; its size doesn't depend on the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(_source(path))

    def factory():
        merges = _received(path, shared)
        encoder, decoder = _worker(path, "encoder", lambda: Encoder(merges)), Decoder(merges)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, decoded = [], []
            for text in texts.to_pylist():
                packed, back = [], []
                for piece in encoder.pieces(text):
                    packed.append(piece)
                    back.append(decoder.feed(np.frombuffer(piece, "<u4").tolist()))
                back.append(decoder.finish())
                ids.append(b"".join(packed))
                decoded.append("".join(back))
            return [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]

        return work

    return common.map_texts(df, {id_col: common.column(df, id_col)}, common.text_or_empty(df, text_col), "ids binary, decoded string", factory)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every text without making ids.

    Returns one row for each row: ``id_col``, ``n_bytes`` and ``n_tokens``. A null text
    counts as empty (0, 0); null or repeated keys, repeated rows, extra columns and empty
    tables need no care, as each row stands for itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(_source(path))

    def factory():
        counter = _worker(path, "counter", lambda: Counter(_received(path, shared)))

        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())]

        return work

    text = common.text_or_empty(df, text_col)
    keep = {id_col: common.column(df, id_col), "n_bytes": F.octet_length(text).cast("long")}
    return common.map_texts(df, keep, text, "n_tokens long", factory)


def ids_array(packed):
    """A column of packed ids as array<long>, four bytes each."""
    at = lambda i, k: F.conv(F.hex(F.substring(packed, i * 4 + k + 1, 1)), 16, 10).cast("long")
    return F.transform(
        F.when(F.length(packed) > 0, F.sequence(F.lit(0), (F.length(packed) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: at(i, 0) + at(i, 1) * 256 + at(i, 2) * 65536 + at(i, 3) * 16777216,
    )


_workers: dict = {}


def _worker(path: str, kind: str, make):
    """One instance for each Python worker: its remembered pre-tokens outlive a task."""
    if (path, kind) not in _workers:
        _workers[path, kind] = make()
    return _workers[path, kind]


@lru_cache(maxsize=2)
def _source(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _received(path: str, shared) -> Merges:
    return _worker(path, "merges", lambda: Merges.parsed(shared.value))
