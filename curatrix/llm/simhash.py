"""SimHash fingerprints and groups of documents whose fingerprints nearly agree."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import components
from ..operators.joins import shuffled
from . import common

BITS = 64
#: Buckets of up to so many fingerprints are compared pair by pair; larger ones through
#: their common neighbours, which finds the same links.
PAIRWISE = 64
#: Minima of a text's shingle hashes, and how many of them a block is made of: two texts that share 0.8 of their shingles
#: agree in one of the 16 blocks at least with probability 0.998.
MINIMA, PER_BLOCK = 80, 5
#: Pairs whose share of equal minima is this far below the similarity aren't compared (five standard deviations).
MARGIN = 0.22
#: Texts of a block that are compared pair by pair; those of a larger one with the first and with a part of about so many.
BLOCK_PAIRS, PART = 32, 4
#: Rows of a crowded block, and hashes of theirs, that meet as many others at a time where its groups are compared with each other.
ROWS, HASHES = 500, 500_000
#: Ids of documents to drop are broadcast up to so many, and so many bytes; else joined by shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Words and hashes of a text are made for about so many bytes at a time.
PIECE_BYTES = 1 << 18

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_OFFSETS = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; a piece ends between two words."""
    at, n = 0, len(text)
    while at < n:
        gap = _SPACE.search(text, at + PIECE_BYTES)
        end = gap.start() if gap else n
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits that more than half of the shingle hashes have; 0 without words."""
    import xxhash

    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    counts, n, rest = np.zeros(BITS, np.int64), 0, []
    for words in _words(text):
        words = rest + words
        k = len(words) - shingle + 1
        if k > 0:
            counts += _bit_counts(map(hashed, map(b" ".join, zip(*[words[i:] for i in range(shingle)]))), k)
            n += k
        rest = words[max(0, k) :]
    if not n and rest:
        counts, n = _bit_counts([hashed(b" ".join(rest))], 1), 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def _bit_counts(hashes: Iterable[int], n: int) -> np.ndarray:
    """How many of the hashes have each bit."""
    index = np.fromiter(hashes, "<u8", n).view(np.uint8).reshape(-1, 8) + _OFFSETS
    return (np.bincount(index.ravel(), minlength=2048).reshape(8, 256) @ _BIT).reshape(-1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col`` and ``fingerprint`` (long, the 64 bits as they are) for each row.

    Words are what spaces, tabs and line ends separate, A-Z in lower case; every
    occurrence of a shingle counts. Fewer words than a shingle: the whole sequence is
    one; none, or a null text: fingerprint 0. Repeated rows, null keys and extra
    columns are kept out of the arithmetic; an empty table gives an empty result.
    """

    def factory():
        def work(texts: pa.Array) -> list[pa.Array]:
            made = [fingerprint(t.encode(), shingle) for t in texts.to_pylist()]
            return [pa.array(np.array(made, np.uint64).view(np.int64))]

        return work

    return common.map_texts(df, {id_col: common.column(df, id_col)}, common.text_or_empty(df, text_col), "fingerprint long", factory)


def _masks(distance: int, spare: int) -> list[tuple[int, list[int]]]:
    """(mask of agreeing bits, positions of the other bits) for each choice of blocks.

    ``distance + spare`` blocks; bits that differ lie in ``distance`` of them at most,
    so two close fingerprints agree on ``spare`` whole blocks of some choice.
    """
    n = distance + spare
    edges = [round(i * BITS / n) for i in range(n + 1)]
    out = []
    for chosen in combinations(range(n), spare):
        held = {b for k in chosen for b in range(edges[k], edges[k + 1])}
        mask = sum(1 << b for b in held)
        out.append((mask - (1 << 64) if mask >> 63 else mask, [b for b in range(BITS) if b not in held]))
    return out


def links(prints: DataFrame, distance: int = 2, spare: int = 3) -> DataFrame:
    """Links between different fingerprints at ``distance`` or fewer bits: columns a, b (long).

    ``prints`` has one column ``fp`` of distinct longs. Every pair at that distance is
    linked directly, or, in a bucket of more than PAIRWISE fingerprints, through one
    that is at that distance from both; so components are exact. Work in a bucket grows
    in proportion to its size. Buckets are keyed by three of five blocks (38 bits or
    more), so unrelated fingerprints rarely meet. Distance 0 gives no links.
    """
    if not 0 <= distance <= 2:
        raise ValueError("links within 0, 1 or 2 bits are supported")
    masks = _masks(2, spare)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, (m, _) in enumerate(masks)])).alias("x")).select("fp", "x.c", "x.k")
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    # The join below needs the rows of a bucket, not their number, to be held: it may be split.
    met = shuffled(keyed, sizes, ["c", "k"])
    few = (
        met.where(F.col("n") <= PAIRWISE)
        .groupBy("c", "k")
        .agg(F.array_sort(F.collect_list("fp")).alias("v"))
        .select(
            F.explode(
                F.flatten(
                    F.transform(
                        "v",
                        lambda a, i: F.transform(
                            F.filter(F.slice("v", i + 2, F.size("v")), lambda b: F.bit_count(a.bitwiseXOR(b)) <= distance),
                            lambda b: F.struct(a.alias("a"), b.alias("b")),
                        ),
                    )
                )
            ).alias("x")
        )
        .select("x.a", "x.b")
    )
    many = met.where(F.col("n") > PAIRWISE)
    flips = [F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in free]) for _, free in masks]
    flip = F.element_at(F.array(*flips), F.col("c") + 1)
    balls = (
        many.select("c", "fp", F.explode(flip).alias("f"))
        .select("c", "fp", F.col("fp").bitwiseXOR(F.col("f")).alias("ball"))
        .groupBy("c", "ball")
        .agg(F.collect_list("fp").alias("v"))  # at most one for each free bit, and itself
        .where(F.size("v") > 1)
    )
    # All in a ball are within one bit of its centre and within two of each other.
    if distance < 2:
        balls = balls.where(F.array_contains("v", F.col("ball")) if distance else F.lit(False))
    hub = F.array_min("v") if distance == 2 else F.col("ball")
    return few.union(balls.select(F.explode("v").alias("b"), hub.alias("a")).where("a <> b").select("a", "b"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row for each row: ``id_col``, ``fingerprint`` (long) and ``component_id``.

    Rows with one fingerprint are one node, whatever their number, so groups of copies
    cost a partial aggregation and no pairs. ``component_id`` is the smallest id that
    links lead to, the row's own included; null only if all ids of the component are.
    Repeated rows and ids are kept. An empty table gives an empty result.
    """
    spark = df.sparkSession
    root = common.scratch(spark)
    prints = common.written(fingerprints(df, id_col, text_col, shingle), f"{root}/prints")
    nodes = common.written(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(common.column(prints, id_col)).alias("least")), f"{root}/nodes")
    parts = components(links(nodes.select("fp"), distance))
    held = nodes.join(parts, nodes.fp == parts.node)
    least = held.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = held.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    alone = nodes.join(parts, nodes.fp == parts.node, "left_anti").select(F.col("fp").alias("__fp"), F.col("least").alias("component_id"))
    return prints.join(linked.union(alone), F.col("fingerprint") == F.col("__fp")).drop("__fp")


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted different hashes of a text's shingles, which are as those of ``fingerprint``."""
    made, rest = [np.zeros(0, np.uint64)], []
    for words in _words(text):
        joined = b" ".join(words)
        hashed = common.word_hashes(*_spans(joined))
        rest = np.concatenate([rest, hashed]) if len(rest) else hashed
        k = len(rest) - shingle + 1
        if k > 0:
            made.append(_runs(rest, shingle, k))
            rest = rest[k:]
    if len(made) == 1 and len(rest):
        made.append(_runs(rest, len(rest), 1))
    return np.unique(np.concatenate(made))


def _sequence(text: bytes) -> bytes:
    """128 bits of a text's words in their order."""
    import xxhash

    whole, first = xxhash.xxh3_128(), True
    for words in _words(text):
        if words:
            whole.update((b"" if first else b" ") + b" ".join(words))
            first = False
    return whole.digest()


def _spans(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(joined, np.uint8)
    starts, ends, _ = common.word_spans(raw, np.array([0, len(raw)]), common.SPACE)
    return raw, starts, ends


def _runs(words: np.ndarray, size: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = common.mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n] + np.uint64(1))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """MINIMA numbers, of which two sets share about as many as of their union they have in common.

    Hashes are dealt into MINIMA bins, whose least ones count; an empty bin takes that of the next one that isn't, marked by how
    far that is.
    """
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    if not len(hashes):
        return out.view(np.int64)
    bins = (hashes % np.uint64(MINIMA)).astype(np.int64)
    np.minimum.at(out, bins, hashes)
    have = np.flatnonzero(np.bincount(bins, minlength=MINIMA))
    at = np.arange(MINIMA)
    following = have[np.searchsorted(have, at) % len(have)]
    return common.mix64(out[following] + ((following - at) % MINIMA).astype(np.uint64)).view(np.int64)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row: ``id_col``, ``fingerprint`` and ``component_id``, groups being what links between texts lead to
    that have ``similarity`` of their different shingles (of their union) in common.

    Texts of the same words, in whatever case and with whatever white space, are one node. Pairs that may be similar come from
    fingerprints within two bits (``links``), and from blocks of minima. All are compared by their whole sets of shingle
    hashes. In a block of more than BLOCK_PAIRS texts each is compared with the first one and with those that it meets in a
    random part of about PART; after that, those of a block that aren't in one group yet are compared with all of its other groups (``_met_apart``), so
    no link between groups is lost and work grows with the texts unless a block has many groups. Two in a thousand pairs are in no
    common block and may be missed. A text without words is similar to its like. Null texts are empty; repeated
    rows, null ids and other columns are as in ``near_groups``.
    """
    spark = df.sparkSession
    root = common.scratch(spark)

    def factory():
        def work(texts: pa.Array) -> list[pa.Array]:
            prints, words, least = [], [], []
            for t in texts.to_pylist():
                raw = t.encode()
                prints.append(fingerprint(raw, shingle))
                words.append(_sequence(raw))
                least.append(minima(_shingle_hashes(raw, shingle)))
            flat = pa.array(np.concatenate(least) if least else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1) * MINIMA, pa.int32()), flat)
            return [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(words, pa.binary()), lists]

        return work

    id_ = common.column(df, id_col)
    made = common.map_texts(df, {id_col: id_}, common.text_or_empty(df, text_col), "fingerprint long, words binary, least array<long>", factory)
    prints = common.written(made, f"{root}/prints")
    own = common.column(prints, id_col)
    nodes = prints.groupBy("words").agg(F.min(own).alias("first"), F.min("fingerprint").alias("fp"), F.min("least").alias("least"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), f"{root}/nodes")
    blocks = _blocks(nodes)
    pairs = common.written(_candidates(nodes, blocks, similarity), f"{root}/pairs")

    def sets():
        def work(texts: pa.Array) -> list[pa.Array]:
            parts = [_shingle_hashes(t.encode(), shingle) for t in texts.to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            words = pa.array([_sequence(t.encode()) for t in texts.to_pylist()], pa.binary())
            return [words, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))]

        return work

    def hashed(some: DataFrame, name: str) -> DataFrame:
        """node, hashes: the whole sets of nodes, from the text of the first row of each; written."""
        wanted = common.written(some.distinct().join(nodes.select("node", "first", "words"), "node"), f"{root}/{name}-wanted")
        size = wanted.agg(F.count("*").alias("n")).first().n
        named = wanted.select(F.col("first").alias("__first"), "node", "words")
        texts = df.select(id_.alias("id"), common.text_or_empty(df, text_col).alias("text")).join(F.broadcast(named) if size <= BROADCAST_IDS else named, F.col("id") == F.col("__first"))
        held = common.map_texts(texts, {"node": F.col("node"), "words": F.col("words")}, F.col("text"), "own binary, hashes array<long>", sets)
        return common.written(held.where("own = words").groupBy("node").agg(F.min("hashes").alias("hashes")), f"{root}/{name}-sets")  # rows of one id

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of a table of pairs those that are similar; written."""
        held = hashed(pairs.select(F.explode(F.array("a", "b")).alias("node")), name)
        a, b = held.select(F.col("node").alias("a"), F.col("hashes").alias("x")), held.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        close = pairs.join(a, "a").join(b, "b").withColumn("both", both).where(F.col("both") >= F.lit(similarity) * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")
        return common.written(close, f"{root}/{name}")

    close = verified(pairs, "links")
    parts = components(close)
    rest = common.written(_apart(blocks, parts), f"{root}/rest")
    if not rest.isEmpty():
        more = common.written(_met_apart(rest, hashed(rest.select("node"), "more"), similarity), f"{root}/more")
        if not more.isEmpty():
            parts = components(close.unionByName(more))
    grouped = nodes.select("words", "node", "first").join(parts.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    found = common.written(grouped.join(least, "root").select(F.col("words").alias("__words"), "component_id"), f"{root}/groups")
    return prints.join(found, F.col("words") == F.col("__words")).select(own.alias(id_col), "fingerprint", "component_id")


def _blocks(nodes: DataFrame) -> DataFrame:
    """node, c, k: each node in its blocks of minima."""
    blocks = [F.struct(F.lit(i).alias("c"), F.xxhash64(F.slice("least", i * PER_BLOCK + 1, PER_BLOCK)).alias("k")) for i in range(MINIMA // PER_BLOCK)]
    return nodes.select("node", F.explode(F.array(*blocks)).alias("x")).select("node", "x.c", "x.k")


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of pairs a, b those whose minima don't rule out that they are similar."""
    left, right = nodes.select(F.col("node").alias("a"), F.col("least").alias("x")), nodes.select(F.col("node").alias("b"), F.col("least").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_may_be("x", "y", similarity)).select("a", "b")


def _may_be(x: str, y: str, similarity: float):
    """Do two rows of minima agree in so many that their sets may be similar?"""
    alike = F.aggregate(F.zip_with(x, y, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return alike >= F.lit((similarity - MARGIN) * MINIMA)


def _apart(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """c, k, node, root, top: the rows of crowded blocks of more than one group, each with its group and the block's largest one."""
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_PAIRS)
    roots = parts.select(F.col("node").alias("__node"), "root")
    held = shuffled(keyed, sizes, ["c", "k"]).join(roots, F.col("node") == F.col("__node"), "left").select("c", "k", "node", F.coalesce("root", "node").alias("root"))
    groups = held.groupBy("c", "k", "root").agg(F.count("*").alias("m"))
    top = groups.groupBy("c", "k").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    return shuffled(held, top.select("c", "k", F.col("top.root").alias("top")), ["c", "k"])


def _met_apart(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a < b: similar nodes of different groups in the blocks of ``rest``.

    The largest group of a block is met by the others only. Both sides of a block are dealt into parts of about ROWS rows and
    HASHES hashes, and each pair of parts is compared as a whole: the join gives similar pairs and no candidates. Work
    grows with a block's rows times those outside its largest group.
    """
    held = shuffled(rest, sets, ["node"])
    outside = F.col("root") != F.col("top")
    deals = lambda some: F.ceil(F.greatest(F.count_if(some) / ROWS, F.sum(F.when(some, F.size("hashes")).otherwise(0)) / HASHES, F.lit(1)))
    dealt = held.groupBy("c", "k").agg(deals(F.lit(True)).alias("np"), deals(outside).alias("nq"))
    held = shuffled(held, dealt, ["c", "k"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n))
    one = held.select("c", "k", own("np").alias("p"), every("nq").alias("q"), "node", "root", "top", "hashes")
    others = held.where(outside).select(F.col("c").alias("oc"), F.col("k").alias("ok"), every("np").alias("op"), own("nq").alias("oq"), F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("hashes").alias("other_hashes"))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        return _similar(left, right, similarity)

    return one.groupBy("c", "k", "p", "q").cogroup(others.groupBy("oc", "ok", "op", "oq")).applyInArrow(compared, "a long, b long").distinct()


def _similar(left: pa.Table, right: pa.Table, similarity: float) -> pa.Table:
    """a < b: pairs of a row of ``left`` and one of ``right`` of another group whose sets have ``similarity`` of their union in common."""
    out = [np.zeros((0, 2), np.int64)]
    if left.num_rows and right.num_rows:
        u, ru, top = (left.column(c).to_numpy() for c in ("node", "root", "top"))
        v, rv = (right.column(c).to_numpy() for c in ("other", "other_root"))
        sizes, hashes = _flat(right.column("other_hashes"))
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(v)), sizes)[order]
        n, own = _flat(left.column("hashes"))
        ends = np.cumsum(n)
        for i in range(len(u)):
            mine = own[ends[i] - n[i] : ends[i]]
            lo, hi = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            count = hi - lo
            at = np.repeat(hi - np.cumsum(count), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(v))
            # Of two rows outside the largest group each pair comes twice, once from either side.
            close = (rv != ru[i]) & ((ru[i] == top[i]) | (u[i] < v)) & (both >= similarity * (n[i] + sizes - both))
            out.append(np.stack([np.minimum(u[i], v[close]), np.maximum(u[i], v[close])], axis=1))
    pairs = np.concatenate(out)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each row has, and the hashes of all rows."""
    lists = pa.concat_arrays(column.chunks)
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()


def _candidates(nodes: DataFrame, keyed: DataFrame, similarity: float) -> DataFrame:
    """a < b: nodes that may be similar, by the first node of each fingerprint near another's and by blocks of minima."""
    of_print = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    same = nodes.join(of_print, "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    heads = [of_print.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "ab"]
    near = links(of_print.select("fp"), 2).join(heads[0], "a").join(heads[1], "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    met = shuffled(keyed, sizes, ["c", "k"])
    few = met.where(F.col("n") <= BLOCK_PAIRS).groupBy("c", "k").agg(F.array_sort(F.collect_list("node")).alias("v"))
    each = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    listed = few.select(F.explode(each).alias("x")).select("x.a", "x.b")
    # A crowded block is dealt into parts of about PART, each block in its own way; no task holds it.
    many = met.where(F.col("n") > BLOCK_PAIRS)
    stars = many.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    share = F.greatest(F.ceil(F.col("n") / PART), F.lit(1))
    dealt = many.select("c", "k", F.pmod(F.xxhash64("node", "c"), share).alias("part"), "node")
    near_by = dealt.groupBy("c", "k", "part").agg(F.array_sort(F.collect_list("node")).alias("v"))
    steps = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    all_ = [t.select("a", "b") for t in (same, near, listed, stars, near_by.select(F.explode(steps).alias("x")).select("x.a", "x.b"))]
    out = all_[0]
    for t in all_[1:]:
        out = out.unionByName(t)
    out = out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _alike(out, nodes, similarity)


def hex64(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """The rows of ``df`` that stay if one document of each near group does: the one of the smallest id.

    Groups are those of fingerprints within ``distance`` bits, or with ``similarity`` those of ``similar_groups``. All columns stay, whatever their names. Of several rows with that id one stays. Rows
    without an id have no place in the order: all of them stay.
    """
    id_ = common.column(df, id_col)
    key, nth_col = common.unused(df, "id"), common.unused(df, "nth")
    some = df.where(id_.isNotNull())
    groups = near_groups(some, id_col, text_col, shingle, distance) if similarity is None else similar_groups(some, id_col, text_col, shingle, similarity)
    own = common.column(groups, id_col)
    named = groups.groupBy(own.alias(key)).agg(F.count_if(own == F.col("component_id")).alias("n"))
    named = common.written(named.where("n <> 1"), f"{common.scratch(df.sparkSession)}/named")
    dropped = named.where("n = 0").select(key)
    size = dropped.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(key).cast("string"))).alias("bytes")).first()
    # Texts move only if the list of what goes is long.
    kept = df.join(F.broadcast(dropped) if size.n <= BROADCAST_IDS and (size.bytes or 0) <= BROADCAST_BYTES else dropped, id_ == F.col(key), "left_anti")
    if not named.where("n > 1").isEmpty():
        order = Window.partitionBy(common.column(kept, id_col)).orderBy(F.xxhash64(*[common.column(kept, c) for c in kept.columns]))
        nth = F.when(common.column(kept, id_col).isNull(), 1).otherwise(F.row_number().over(order))
        kept = kept.withColumn(nth_col, nth).where(F.col(nth_col) == 1).drop(nth_col)
    return kept
