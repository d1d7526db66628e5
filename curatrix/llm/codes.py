"""Product codes of vectors: Lloyd rounds in which kd-trees over the parts are filtered.

A vector is cut into equal parts, each part is named by the nearest entry of its codebook.
Components are integers (``floor(SCALE * x)``), so that sums, distances and ties are exact
and no result depends on partitions. Trees are built once, over blocks of bounded size, and
written with the box, sum and count of each node; a round walks them with the entries that
can still be nearest somewhere in a node's box. Where one is left the whole node is its own,
and the node's cached sum and count are all that is added.

Only codebooks pass through the driver: parts x entries x components numbers, whatever the
number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Most points of a leaf, and most bytes (at four a component) of a block of vectors that trees are built over.
LEAF, BLOCK_BYTES = 128, 4 << 20
#: Labels with more than this share of all rows are few (as many as the share's inverse) and meet their sums by broadcast.
HEAVY_SHARE = 1e-4


def kept(df: DataFrame, vector_col: str = "embedding", parts: int = PARTS) -> Column:
    """Vectors with ``parts`` equal parts and finite components only; false for null ones."""
    v = common.column(df, vector_col)
    n = F.size(v)
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    return F.coalesce((n > 0) & (n % parts == 0) & sound, F.lit(False))


def whole_numbers(vectors: np.ndarray, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component; raises ValueError where a squared distance needn't fit in 64 bits."""
    v = np.floor(vectors.astype(np.float64) * scale)
    if len(v) and not np.abs(v).max() < np.sqrt(2.0**60 / dims):
        raise ValueError("components are too large for exact distances")
    return v.astype(np.int64)


def exact_floats(points: np.ndarray, entries: np.ndarray) -> bool:
    """Whether products and sums over these stay whole numbers below 2 ** 53, so that doubles hold them exactly."""
    top = max([1, *(int(np.abs(x).max()) for x in (points, entries) if x.size)])
    return 8 * points.shape[-1] * top * top < 1 << 53


class Tree:
    """A kd-tree over the rows of ``points``: rows in the tree's order, and for each node its range
    of rows, box, sum and children (0 for a leaf; the root is node 0)."""

    FIELDS = ("order", "points", "ranges", "low", "high", "total")

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points))
        ranges, low, high, total, todo = [], [], [], [], [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            at = len(ranges)
            if parent >= 0:
                ranges[parent][2 + side] = at
            rows = points[order[a:b]]
            low.append(rows.min(0))
            high.append(rows.max(0))
            total.append(rows.sum(0))
            ranges.append([a, b, 0, 0])
            wide = int(np.argmax(high[-1] - low[-1]))
            if b - a > LEAF and high[-1][wide] > low[-1][wide]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, wide], half)]
                todo += [(a + half, b, at, 1), (a, a + half, at, 0)]
        self.order, self.points, self.ranges = order, points[order], np.array(ranges)
        self.low, self.high, self.total = np.array(low), np.array(high), np.array(total)

    def packed(self) -> list[bytes]:
        """The fields as bytes; components in two bytes each where they fit, else in eight."""
        small = all(np.abs(x).max() < 1 << 15 for x in (self.low, self.high))
        kind = {"order": "<i4", "ranges": "<i4", "total": "<i8"}
        return [(b"2" if small else b"8") + getattr(self, f).astype(kind.get(f, "<i2" if small else "<i8")).tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, fields: list[bytes], dims: int) -> Tree:
        self = cls.__new__(cls)
        kind = {"order": "<i4", "ranges": "<i4", "total": "<i8"}
        for name, raw in zip(cls.FIELDS, fields, strict=True):
            flat = np.frombuffer(raw, kind.get(name, "<i2" if raw[:1] == b"2" else "<i8"), offset=1)
            width = {"order": 0, "ranges": 4}.get(name, dims)
            setattr(self, name, flat.astype(np.int64).reshape(-1, width) if width else flat.astype(np.int64))
        return self

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry of each row (in the tree's order), rows and sums of each entry, and how many rows were assigned by whole nodes.

        In a node the entry nearest to its middle is compared with each other one that is left: their distances to a
        point differ by a linear function of it, whose least value over the box is at a corner. An entry that is
        farther even there, or as far and behind in the order, is nearest to no point of the node.
        """
        kind = np.float64 if exact_floats(self.points, entries) else np.int64
        z, points, low, high = (x.astype(kind) for x in (entries, self.points, self.low, self.high))
        square = (z * z).sum(1)
        found = np.zeros(len(points), np.int64)
        count, total = np.zeros(len(z), np.int64), np.zeros(entries.shape, np.int64)
        by_node, todo = 0, [(0, np.arange(len(z)))]
        while todo:
            node, left = todo.pop()
            a, b, first, second = self.ranges[node]
            if len(left) > 1:
                some, lo, hi = z[left], low[node], high[node]
                best = int(np.argmin(square[left] - some @ (lo + hi)))
                w = some - some[best]
                least = square[left] - square[left[best]] - 2 * np.maximum(w * lo, w * hi).sum(1)
                left = left[(least < 0) | ((least == 0) & (left <= left[best]))]
            if len(left) == 1:
                found[a:b] = left[0]
                count[left[0]] += b - a
                total[left[0]] += self.total[node]
                by_node += b - a
            elif first:
                todo += [(second, left), (first, left)]
            else:
                own = left[np.argmin(square[left] - 2 * (points[a:b] @ z[left].T), axis=1)]
                found[a:b] = own
                order = np.argsort(own, kind="stable")
                heads = np.flatnonzero(np.diff(own[order], prepend=-1))
                used = own[order][heads]
                count[used] += np.diff(np.append(heads, b - a))
                total[used] += np.add.reduceat(self.points[a:b][order], heads, axis=0)
        return found, count, total, by_node


def trees(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", beside: tuple[str, ...] = (), dims: int = 0, parts: int = PARTS) -> DataFrame:
    """A row for each block of vectors: arrays of their ids and of the columns ``beside``, and the trees of the parts.

    ``df`` holds vectors of one length only.
    """
    names = ["k0", *[f"k{i + 1}" for i in range(len(beside))]]
    source = df.select(*[common.column(df, c).alias(n) for c, n in zip((id_col, *beside), names, strict=True)], F.transform(common.column(df, vector_col), lambda x: x.cast("double")).alias("v"))
    kinds = [source.schema[n].dataType.simpleString() for n in names]
    ddl = ", ".join([*[f"{n} array<{k}>" for n, k in zip(names, kinds, strict=True)], "trees array<binary>"])
    most, width = max(1, BLOCK_BYTES // (4 * dims)), dims // parts

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        vectors = whole_numbers(pc.list_flatten(rows.column("v")).to_numpy().reshape(-1, dims), dims)
        packed = [f for p in range(parts) for f in Tree(vectors[:, p * width : (p + 1) * width]).packed()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(n).combine_chunks()) for n in names]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.list_(pa.binary()))], names=[*names, "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == most:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    common.bounded_batches(df.sparkSession)
    return source.mapInArrow(run, ddl)


def _walked(column: pa.Array, books: np.ndarray) -> Iterator[list[tuple[Tree, tuple]]]:
    for raw in column.to_pylist():
        step = len(Tree.FIELDS)
        made = [Tree.unpacked(raw[p * step : (p + 1) * step], books.shape[2]) for p in range(len(books))]
        yield [(t, t.nearest(books[p])) for p, t in enumerate(made)]


def lloyd(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its parts, unused entries as they were.

    A task adds up what its trees say, so it sends at most parts x entries x (components + 1) numbers, and as
    many reach the driver.
    """
    shape = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((*shape[:2], shape[2] + 1), np.int64)
        for batch in batches:
            for walked in _walked(batch.column(0), books):
                for p, (_, (_, count, total, _)) in enumerate(walked):
                    sums[p, :, 0] += count
                    sums[p, :, 1:] += total
        place = np.flatnonzero(np.broadcast_to(sums[:, :, :1] > 0, sums.shape))
        if len(place):
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.reshape(-1)[place])], names=["place", "total"])

    added = blocks.select("trees").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((*shape[:2], shape[2] + 1), np.int64)
    sums.reshape(-1)[added.column("place").to_numpy()] = added.column("total").to_numpy()
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


def encoded(blocks: DataFrame, books: np.ndarray, names: tuple[str, ...]) -> DataFrame:
    """``names`` (the id and the columns beside it), code (a byte for each part) and error (squared distances summed over the parts)."""
    kinds = [blocks.schema[f"k{i}"].dataType.elementType.simpleString() for i in range(len(names))]
    columns = [f"k{i}" for i in range(len(names))]
    ddl = ", ".join([*[f"{c} {k}" for c, k in zip(columns, kinds, strict=True)], "code binary, error long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, walked in enumerate(_walked(batch.column(len(columns)), books)):
                n = len(walked[0][0].order)
                code, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for p, (tree, (found, *_)) in enumerate(walked):
                    code[tree.order, p] = found
                    error[tree.order] += ((tree.points - books[p][found]) ** 2).sum(1)
                kept = [batch.column(c).slice(i, 1).flatten() for c in range(len(columns))]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), n, [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*kept, packed, pa.array(error)], names=[*columns, "code", "error"])

    out = blocks.select(*columns, "trees").mapInArrow(run, ddl)
    return out.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "code", "error")


def compressed(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", beside: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(id, ``beside``, code, error) of each kept vector, and the codebooks (parts x entries x components).

    Left out are null vectors, those with null or non-finite components, and those that have no ``parts`` equal
    parts or another length than the kept vector of the smallest id. Codebooks start as the parts of the ``entries``
    kept vectors of the smallest ids, ties by components; fewer vectors give fewer entries, and rows without an id are
    coded but start no entry. Repeated rows count as often as they stand there. An empty table gives no rows and
    empty codebooks. Columns are taken by position, so names of other columns don't matter.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte for each part, so there are 1 to 256 entries")
    sound = df.where(kept(df, vector_col, parts))
    named = sound.select(common.column(sound, id_col).alias("id"), F.transform(common.column(sound, vector_col), lambda x: x.cast("double")).alias("v"))
    smallest = named.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    dims = len(smallest[0].v) if smallest else parts
    alike = sound.where(F.size(common.column(sound, vector_col)) == dims)
    first = named.where(F.col("id").isNotNull() & (F.size("v") == dims)).orderBy("id", "v").limit(entries).collect()  # ``entries`` vectors
    start = whole_numbers(np.array([r.v for r in first]).reshape(-1, dims), dims)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    if not len(start):
        alike = alike.limit(0)
    blocks = common.written(trees(alike, id_col, vector_col, beside, dims, parts), f"{common.scratch(df.sparkSession)}/trees")
    for _ in range(rounds if len(start) else 0):
        books = lloyd(blocks, books)
    return encoded(blocks, books, (id_col, *beside)), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def label_sums(df: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its label; null is a label. ``df`` is read more than once.

    Labels that hold a large share of the rows are few by arithmetic; their sums are broadcast and their rows stay
    where they are. Rows of all other labels meet their sums by a shuffle in which no label is large.
    """
    sums = common.written(df.groupBy(F.col(label).alias("__label")).agg(F.sum(value).alias(name), F.count("*").alias("__n")), f"{common.scratch(df.sparkSession)}/sums")
    rows = sums.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first().n
    heavy = sums.where(F.col("__n") > F.lit(rows * HEAVY_SHARE))
    light = sums.where(F.col("__n") <= F.lit(rows * HEAVY_SHARE))
    met = df.join(F.broadcast(heavy.select(F.col("__label").alias("__heavy"), F.col(name).alias("__sum"))), F.col(label).eqNullSafe(F.col("__heavy")), "left")
    columns = df.columns
    if light.isEmpty():
        return met.select(*columns, F.col("__sum").alias(name))
    rest = df.join(light, F.col(label).eqNullSafe(F.col("__label"))).select(*columns, name)
    return met.where(F.col("__sum").isNotNull()).select(*columns, F.col("__sum").alias(name)).unionByName(rest)
