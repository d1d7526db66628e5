"""Removal of long word sequences that a document with a smaller id also has.

Recompression: in each round, runs of one symbol and pairs of two are replaced by new
symbols whose names are hashes of what they stand for, so a name means the same in
every document and no naming table has to be shared. Which pairs are joined depends
on the two names alone; so equal word sequences get equal symbols but for a bounded
border. A window is anchored at the symbol of least name in its interior. Anchors and
the words around them that every such window has are named and brought together.

Further rounds let symbols grow to hundreds of words. One of a window's length or more
that a smaller id has too, told by the hash of all of its words, reveals a long repeat,
and settles all windows within it at once. What is left, windows at anchors that several
documents share, is compared window by window, by hash and anchor's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
#: Most words of a symbol after each round.
CAPS = (2, 4, 4)
#: The same of the rounds after these, in which symbols grow by a half each on average.
GROWN = (6, 9, 14, 21, 32, 48, 72, 108, 162, 256)
#: Words at either end of a window whose symbols may depend on what lies outside: a run
#: and a pair may reach over the border in each round.
BORDER = sum(2 * (c - 1) for c in CAPS)
#: Text bytes of a bucket of documents; the names and windows of as many texts share one.
BUCKET_BYTES = 4 << 20
#: Buckets of names for each bucket of documents: small enough that tasks which get several by chance stay even.
SPREAD = 4
#: Names of anchors that a task holds before what it knows of them is combined and sent.
HELD_NAMES = 1 << 20
#: Most buckets of documents whose windows of one name meet at once; more meet in several steps.
FAN = 1024

_U = np.uint64
_BASE = _U(0x5851F42D4C957F2D)


class Words:
    """Words of many texts with sums from which the hash of any range follows."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = common.flat_bytes(texts)
        self.starts, self.ends, self.first = common.word_spans(self.raw, self.offsets, common.SPACE)
        self.hash = common.word_hashes(self.raw, self.starts, self.ends)
        self.n = np.diff(self.first)
        power, self.inverse = _powers(len(self.hash) + 1)
        self.sums = np.zeros(len(self.hash) + 1, _U)
        np.cumsum(self.hash * power[: len(self.hash)], out=self.sums[1:])

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a up to b."""
        return common.mix64((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(_U))


_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0]) < n:
        size = max(n, 1 << 16)
        back = _U(pow(int(_BASE), -1, 1 << 64))
        _cache[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, x, _U))]) for x in (_BASE, back)]
    return _cache[0], _cache[1]


def _round(name: np.ndarray, start: np.ndarray, border: np.ndarray, k: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after a round of runs and of pairs."""
    # Runs: maximal blocks of one name, if not too long; a longer one stays as it is.
    n = len(name)
    head = np.ones(n, bool)
    head[1:] = (name[1:] != name[:-1]) | border[start[1:n]]
    at = np.flatnonzero(head)
    ends = np.append(at[1:], n)
    short = (start[ends] - start[at]) <= cap
    keep = head | ~np.repeat(short, ends - at)
    length = np.repeat(ends - at, ends - at)[keep]
    block = np.repeat(short & (ends - at > 1), ends - at)[keep]
    name, start = name[keep], np.append(start[:-1][keep], start[-1])
    name[block] = common.mix64(name[block] * _U(3) + length[block].astype(_U) * common._MUL + _U(2 * k + 1))
    # Pairs: a left symbol and a right one, if not too long together. Which are left ones the names tell: half of them, or,
    # for more pairs at the cost of a look to the left, those of a value below both neighbours'.
    n = len(name)
    value = common.mix64(name + _U((k + 1) * int(common._MUL) & (1 << 64) - 1))
    join = np.zeros(n, bool)
    if k < len(CAPS):
        left = (value & _U(1)).astype(bool)
        join[:-1] = left[:-1] & ~left[1:]
    else:
        join[:-1] = value[:-1] < value[1:]
        join[1:] &= (value[1:] < value[:-1]) | border[start[1:n]]
    join[:-1] &= ~border[start[1:n]] & (start[2:] - start[:-2] <= cap)
    at = np.flatnonzero(join)
    name[at] = common.mix64(name[at] + common.mix64(name[at + 1] ^ _U(k + 17)) * _U(5))
    keep = np.ones(n, bool)
    keep[at + 1] = False
    return name[keep], np.append(start[:-1][keep], start[-1])


def recompressed(words: Words, caps: tuple[int, ...] = CAPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the symbols after each round, and the first word of each (and the end)."""
    name, start = words.hash.copy(), np.arange(len(words.hash) + 1)
    border = np.zeros(len(words.hash) + 1, bool)
    border[words.first] = True  # no symbol reaches over two texts
    for k, cap in enumerate(caps):
        if len(name):
            name, start = _round(name, start, border, k, cap)
        yield name, start


#: Names of long symbols have this bit, those of anchors don't.
LONG = _U(1 << 63)


class Windows:
    """All windows of the texts: first word, hash, and the name of the anchor with its surroundings; and the long symbols:
    document, words and name."""

    def __init__(self, words: Words, window: int):
        count = np.maximum(words.n - window + 1, 0)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(words.first[:-1], count)
        self.count = count
        rounds = list(recompressed(words, CAPS + GROWN))
        name, start = rounds[len(CAPS) - 1]
        # Symbols that lie in the interior: start >= at + BORDER, end <= at + window - BORDER.
        low = np.searchsorted(start[:-1], self.at + BORDER)
        high = np.searchsorted(start[1:], self.at + (window - BORDER), "right")
        best = _least(name, low, high)
        self.anchor = common.mix64(words.ranges(start[best] - BORDER, start[best + 1] + BORDER) ^ name[best]) & ~LONG
        self.words, self.window = words, window
        start = rounds[-1][1]
        long_ = np.flatnonzero(np.diff(start) >= window)
        self.long_from, self.long_to = start[long_], start[long_ + 1]
        self.long_doc = np.searchsorted(words.first, self.long_from, "right") - 1
        self.long_name = words.ranges(self.long_from, self.long_to) | LONG

    def within(self, chosen: np.ndarray) -> np.ndarray:
        """Is each window within one of the chosen long symbols?"""
        step = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(step, self.long_from[chosen], 1)
        np.add.at(step, self.long_to[chosen] - self.window + 1, -1)
        return (np.cumsum(step) > 0)[self.at]

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        return self.words.ranges(self.at[rows], self.at[rows] + self.window)


def _least(name: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the first least name in each range, by tables of powers of two."""
    best = np.zeros(len(low), np.int64)
    if not len(low):
        return best
    size = np.floor(np.log2(high - low)).astype(np.int64)
    table = np.arange(len(name))
    for k in range(int(size.max()) + 1):
        if k:
            half = 1 << (k - 1)
            a, b = table[:-half], table[half:]
            table = np.where(name[b] < name[a], b, a)
        rows = np.flatnonzero(size == k)
        a, b = table[low[rows]], table[high[rows] - (1 << k)]
        best[rows] = np.where(name[b] < name[a], b, a)
    return best


def _xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column (the published XXH64 of eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << _U(r)) | (v >> _U(64 - r))
    h = np.full(len(x), 42, _U) + p5 + _U(8)
    h ^= turn(x.view(_U) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return (h ^ (h >> _U(32))).view(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of each bucket that has any, in their order."""
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        edges = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        for b, rows in zip(sorted_[edges].tolist(), np.split(order, edges[1:]), strict=True):
            yield b, rows


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Packed lists: kind, bucket, documents, how many values each has, and the values. Lists of kind ASKED go to
#: the buckets of their names and wait for others; those of kind TOLD go to the buckets of their documents.
ASKED, TOLD = 0, 1
_LISTS = "kind int, b int, docs binary, counts binary, values binary"
_LIST_SCHEMA = pa.schema([("kind", pa.int32()), ("b", pa.int32()), *[(c, pa.binary()) for c in ("docs", "counts", "values")]])
#: The same for windows: the bucket they come from, and runs of windows with one document and anchor.
_RUNS = "kind int, b int, origin int, docs binary, names binary, sizes binary, hashes binary"
_RUN_SCHEMA = pa.schema([("kind", pa.int32()), ("b", pa.int32()), ("origin", pa.int32()), *[(c, pa.binary()) for c in ("docs", "names", "sizes", "hashes")]])


def _lists(doc: np.ndarray, value: np.ndarray, bucket: np.ndarray, kind: int = TOLD) -> pa.RecordBatch:
    """Rows of _LISTS for values sorted by document."""
    rows = []
    for b, r in _by_bucket(bucket):
        d, n = _counted(doc[r])
        rows.append((kind, b, d.tobytes(), n.tobytes(), value[r].tobytes()))
    return _packed(rows, _LIST_SCHEMA)


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each document."""
    return _xxhash64(doc) % buckets


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of neighbouring equal ones, and how many there are."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x))).astype(np.int32)


def _unlisted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Document and value of all rows of _LISTS."""
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
    return np.repeat(docs, counts), np.frombuffer(b"".join(table.column("values").to_pylist()), _U)


def _with_id(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Texts and ids of the rows that have an id."""
    has = part.column(0).is_valid()
    part = part.filter(has)
    return part.column(1), part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(buckets: int, window: int):
    """Anchors and long symbols of the documents. An anchor that several documents of one task have is TOLD to these; the
    first and the last of them ask for all, so a frequent name costs a task two entries. A long symbol is TOLD to
    all but the first, which asks."""

    def combined(doc: np.ndarray, name: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, name))
        doc, name = doc[order], name[order]
        head = np.append(True, name[1:] != name[:-1])
        last = np.append(head[1:], True)
        group = np.cumsum(head) - 1
        long_ = name >= LONG
        shared = np.where(long_, doc[head][group] < doc, (doc[head] < doc[last])[group])
        asks = head | last & shared & ~long_
        for rows, kind in ((asks, ASKED), (shared, TOLD)):
            rows = np.flatnonzero(rows)
            rows = rows[np.argsort(doc[rows], kind="stable")]
            bucket = (name[rows] % _U(SPREAD * buckets)).astype(np.int64) if kind == ASKED else _home(doc[rows], buckets)
            yield _lists(doc[rows], name[rows], bucket, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, names, held = [], [], 0
        for batch in batches:
            for part in common.slices(batch, 1):
                texts, ids = _with_id(part)
                w = Windows(Words(texts), window)
                if not len(w.at):
                    continue
                turn = np.append(True, (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1]))
                docs += [ids[w.doc[turn]], ids[w.long_doc]]
                names += [w.anchor[turn], w.long_name]
                held += int(turn.sum()) + len(w.long_name)
                if held >= HELD_NAMES:
                    yield from combined(np.concatenate(docs), np.concatenate(names))
                    docs, names, held = [], [], 0
        if held:
            yield from combined(np.concatenate(docs), np.concatenate(names))

    return run


def _shared(buckets: int):
    """Anchors that documents of different ids have, back to buckets of documents; long symbols to all but the least."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() == TOLD:
            return table
        doc, name = _unlisted(table)
        order = np.lexsort((doc, name))
        doc, name = doc[order], name[order]
        once = np.append(True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        doc, name = doc[once], name[once]
        same = name[1:] == name[:-1]
        many = np.append(False, same) | np.append(same, False) & (name < LONG) if len(doc) else np.zeros(0, bool)
        doc, name = doc[many], name[many]
        order = np.argsort(doc, kind="stable")
        doc, name = doc[order], name[order]
        return pa.Table.from_batches([_lists(doc, name, _home(doc, buckets))])

    return run


def _parts(texts: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in texts.combine_chunks().to_batches():
        yield from common.slices(batch, 1)


class _Lookup:
    """Is (document, value) in a list?"""

    def __init__(self, doc: np.ndarray, value: np.ndarray):
        self.keys = np.sort(common.mix64(doc.view(_U) * common._MUL) ^ value)

    def has(self, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
        key = common.mix64(doc.view(_U) * common._MUL) ^ value
        if not len(self.keys):
            return np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key


def _settled(doc: np.ndarray, name: np.ndarray, hashed: np.ndarray, buckets: int, origin: int, last: bool = False, told: tuple = ()) -> pa.RecordBatch:
    """Rows of _RUNS. Of the documents with one window the least asks on (unless this is the last step), the
    others are TOLD that it goes, and so are those of ``told`` (documents, hashes)."""
    order = np.lexsort((doc, name, hashed))
    doc, name, hashed = doc[order], name[order], hashed[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (name[1:] != name[:-1])) if len(doc) else np.zeros(0, bool)
    gone = doc > doc[new][np.cumsum(new) - 1]
    rows = []
    for kind, some in ((TOLD, gone),) if last else ((ASKED, new), (TOLD, gone)):
        d, n, h = doc[some], name[some], hashed[some]
        if kind == TOLD:  # one entry for each document and window
            if told:
                d, h = np.concatenate([d, told[0]]), np.concatenate([h, told[1]])
            n = np.zeros(len(d), _U)
        row = np.lexsort((h, n, d))
        d, n, h = d[row], n[row], h[row]
        if kind == TOLD:
            once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(d) else np.zeros(0, bool)
            d, n, h = d[once], n[once], h[once]
        for b, r in _by_bucket((n % _U(SPREAD * buckets)).astype(np.int64) if kind == ASKED else _home(d, buckets)):
            at = np.flatnonzero(np.append(True, (d[r][1:] != d[r][:-1]) | (n[r][1:] != n[r][:-1])))
            sizes = np.diff(np.append(at, len(r))).astype(np.int32)
            rows.append((kind, b, origin, d[r][at].tobytes(), n[r][at].tobytes() if kind == ASKED else b"", sizes.tobytes(), h[r].tobytes()))
    return _packed(rows, _RUN_SCHEMA)


def _candidates(buckets: int, window: int):
    """Windows within long symbols that a smaller id has are TOLD to go; others at shared anchors go to the buckets of
    their anchors' names."""

    def run(key: tuple, texts: pa.Table, shared: pa.Table) -> pa.Table:
        found, told = [], []
        known = _Lookup(*_unlisted(shared)) if shared.num_rows else None
        for part in _parts(texts.select(["id", "text"])) if known else ():
            some, ids = _with_id(part)
            w = Windows(Words(some), window)
            if not len(w.at):
                continue
            inside = w.within(known.has(ids[w.long_doc], w.long_name))
            rows = np.flatnonzero(inside)
            told.append((ids[w.doc[rows]], w.hashes(rows)))
            rows = np.flatnonzero(known.has(ids[w.doc], w.anchor) & ~inside)
            found.append((ids[w.doc[rows]], w.anchor[rows], w.hashes(rows)))
        if not found:
            return pa.Table.from_batches([], _RUN_SCHEMA)
        doc, name, hashed = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_batches([_settled(doc, name, hashed, buckets, key[0].as_py(), told=tuple(np.concatenate(c) for c in zip(*told, strict=True)))])

    return run


def _met(buckets: int, last: bool):
    """One step of meeting: windows of one name from some of the buckets, at last from all."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() == TOLD:
            return table
        get = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        size = get("sizes", np.int32)
        doc, name = np.repeat(get("docs", np.int64), size), np.repeat(get("names", _U), size)
        return pa.Table.from_batches([_settled(doc, name, get("hashes", _U), buckets, key[2].as_py(), last)])

    return run


def _kept(window: int, schema: pa.Schema):
    """Texts without the words of removed windows."""

    def run(texts: pa.Table, removed: pa.Table) -> pa.Table:
        get = lambda c, kind: np.frombuffer(b"".join(removed.column(c).to_pylist()), kind)
        known, out = _Lookup(np.repeat(get("docs", np.int64), get("sizes", np.int32)), get("hashes", _U)), []
        for part in _parts(texts.select(["id", "text"])):
            w = Words(part.column(1))
            n = len(w.hash)
            gone = np.zeros(n, bool)
            count = np.maximum(w.n - window + 1, 0)
            if len(known.keys) and count.any():
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                valid = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(count)), count)
                at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
                hit = at[known.has(ids[doc], w.ranges(at, at + window)) & valid[doc]]
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, hit, 1)
                np.add.at(step, hit + window, -1)
                gone = np.cumsum(step[:n]) > 0
            data, texts_, spans = w.raw.tobytes(), [], []
            removed_n = np.zeros(len(w.n), np.int64)
            some = np.flatnonzero(w.n)
            if len(some):
                removed_n[some] = np.add.reduceat(gone.astype(np.int64), w.first[some])
            for i in range(len(w.n)):
                a, b = int(w.first[i]), int(w.first[i + 1])
                words = data[int(w.offsets[i]) : int(w.offsets[i + 1])].split()
                if removed_n[i]:
                    g = gone[a:b]
                    words = [x for x, y in zip(words, g.tolist(), strict=True) if not y]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                    spans.append([{"from": int(x), "to": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                else:
                    spans.append([])
                texts_.append(b" ".join(words).decode())
            columns = [part.column(0), pa.array(w.n, pa.int64()), pa.array(removed_n), pa.array(spans, schema.field("removed").type), pa.array(texts_, pa.string())]
            out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def without_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without the words that lie in a window a smaller id's document has too.

    Returns one row for each row: ``id_col`` (long), ``n_words``, ``n_removed``, ``removed``
    (array of from, to: word ranges, ends exclusive) and ``kept`` (the other words joined by
    one space). Windows are judged on the input. Ids are integers; equal ids are one
    document as regards order, so repeated rows are all kept. A row without an id neither
    loses words nor takes any from others. A null text has no words. Texts shorter than a
    window stay. Extra columns are left aside; an empty table gives an empty result.

    Documents meet only in buckets whose number follows the size of the input, as packed
    lists of names. What one task or bucket knows already is combined before it is sent:
    a name costs a task two entries and a window a bucket of documents one, however many
    documents have it; windows from more than FAN buckets meet in steps. Rows of one id
    share a bucket, so ids should not repeat without bound.
    """
    if window <= 2 * BORDER + 2 * max(CAPS):
        raise ValueError(f"a window has more than {2 * BORDER + 2 * max(CAPS)} words")
    common.bounded_batches(df.sparkSession)
    text = common.text_or_empty(df, text_col)
    docs = df.select(common.column(df, id_col).cast("long").alias("id"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(common.shuffle_partitions(df.sparkSession), -(-size // BUCKET_BYTES))
    anchors = docs.mapInArrow(_anchors(buckets, window), _LISTS)
    shared = anchors.groupBy("kind", "b").applyInArrow(_shared(buckets), _LISTS)
    placed = docs.withColumn("b", F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(buckets)).cast("int"))
    windows = placed.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(_candidates(buckets, window), _RUNS)
    salts = buckets
    while salts > 1:
        # What was told before passes by its own bucket; ``origin`` is the part of the buckets that has met.
        salts = -(-salts // FAN)
        windows = windows.withColumn("origin", F.when(F.col("kind") == ASKED, F.pmod("origin", F.lit(salts))).otherwise(0))
        windows = windows.groupBy("kind", "b", "origin").applyInArrow(_met(buckets, salts == 1), _RUNS)
    removed = windows.where(F.col("kind") == TOLD)
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", span), ("kept", pa.string())])
    out = placed.groupBy("b").cogroup(removed.groupBy("b")).applyInArrow(_kept(window, schema), "id long, n_words long, n_removed long, removed array<struct<`from`:int,`to`:int>>, kept string")
    return out.withColumnRenamed("id", id_col)
