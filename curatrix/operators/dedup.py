"""Exact duplicates, and near duplicates by SimHash of character grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import column, content_hash
from ..sources.sinks import checkpointed, forgotten
from .joins import met, shuffled
from .near import near_keep

__all__ = ["banded_pairs", "components", "exact_groups", "fingerprint_links", "leakage", "message_fingerprint", "near_classes", "near_keep", "near_links", "simhash", "spanning_links"]

GRAM = 4
#: Slots for hashes of grams in a task (16 bytes each); characters and pieces of texts whose grams are counted at once.
SLOTS, PIECE, PIECES = 1 << 20, 1 << 16, 256
#: Bits of a fingerprint are cut into six blocks; two that differ in three bits at most agree on three of them.
BLOCKS, AGREEING = 6, 3
#: Buckets of up to so many fingerprints are compared pair by pair where only classes are asked for; larger ones through
#: the fingerprints one and two bits away from theirs, whose number doesn't depend on the bucket's.
PAIRWISE = 500


def exact_groups(df: DataFrame, key: Column, id_col: str, split: str | None = None) -> DataFrame:
    """hash, n, first id [, n_splits] of every content that occurs more than once."""
    extra = [F.count_distinct(split).alias("n_splits")] if split else []
    return df.groupBy(key.alias("hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), *extra).where("n > 1")


def _hash(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode("utf-8"), digest_size=8).digest(), "big")


class _Hashes:
    """Hashes of grams, for many at once. A slot keeps the last gram that fell to it, so memory is bounded."""

    def __init__(self):
        self.keys, self.hashes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.hashes[0] = _hash("\0" * GRAM)  # the gram whose key is zero; that falls to slot 0

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        """Of grams of four characters of 16 bits each, the first one lowest."""
        slot = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SLOTS.bit_length())
        out = self.hashes[slot]
        lacks = np.flatnonzero(self.keys[slot] != keys)
        if len(lacks):
            new, first, back = np.unique(keys[lacks], return_index=True, return_inverse=True)
            grams = new.astype("<u8").tobytes().decode("utf-16-le")
            found = np.array([_hash(grams[i : i + GRAM]) for i in range(0, len(grams), GRAM)], np.uint64)
            out[lacks] = found[back]
            slot = slot[lacks[first]]
            self.keys[slot], self.hashes[slot] = new, found
        return out

    def of_grams(self, code: np.ndarray) -> np.ndarray:
        """Of the gram that begins at each character but the last three."""
        at = [code[i : len(code) - GRAM + 1 + i] for i in range(GRAM)]
        keys = at[0].astype(np.uint64)
        for i in range(1, GRAM):
            keys |= at[i].astype(np.uint64) << np.uint64(16 * i)
        if code.max() < 1 << 16:
            return self.of_keys(keys)
        odd = np.flatnonzero(np.maximum.reduce(at) >> 16)
        keys[odd] = 0
        out = self.of_keys(keys)
        rows, back = np.unique(np.stack([c[odd] for c in at], axis=1), axis=0, return_inverse=True)
        out[odd] = np.array([_hash("".join(map(chr, row))) for row in rows.tolist()], np.uint64)[back.reshape(-1)]
        return out


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Lists of (number of the text, piece): all grams of texts of four characters or more, each in one piece."""
    out, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - GRAM + 1, PIECE):
            out.append((i, t[at : at + PIECE + GRAM - 1]))
            size += len(out[-1][1])
            if size >= PIECE or len(out) == PIECES:
                yield out
                out, size = [], 0
    if out:
        yield out


def _bit_counts(texts: list[str], hashes: _Hashes) -> np.ndarray:
    """For each text and bit, in how many hashes of its grams the bit is set."""
    counts = np.zeros((len(texts), 64), np.int64)
    for pieces in _pieces(texts):
        code = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le"), "<u4")
        sizes = np.array([len(p) for _, p in pieces])
        whole = np.ones(len(code), bool)  # grams that don't reach into the next piece
        for k in range(1, GRAM):
            whole[np.cumsum(sizes) - k] = False
        raw = hashes.of_grams(code)[whole[: len(code) - GRAM + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)
        row = np.repeat(np.arange(len(pieces)) << 8, sizes - GRAM + 1)
        here = np.empty((len(pieces), 64), np.int64)
        for j in range(8):
            # How often each value of a byte occurs in a piece, then of each bit.
            times = np.bincount(row + raw[:, j], minlength=len(pieces) << 8)
            for b in range(8):
                here[:, 8 * j + b] = times.reshape(len(pieces), 128 >> b, 2, 1 << b)[:, :, 1].sum(axis=(1, 2))
        np.add.at(counts, [i for i, _ in pieces], here)
    return counts


@F.pandas_udf(LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64 bits over blake2b hashes of all grams of four characters, white space left out.

    The whole text is the gram if it is that short; an empty text has 0; null stays null. Grams are looked up and their
    bits counted for many texts at once.
    """
    hashes = _Hashes()
    for batch in batches:
        texts = ["".join(t.split()) if t is not None else "" for t in batch]
        grams = np.array([max(len(t) - GRAM + 1, 0) for t in texts], np.int64)
        values = np.packbits(2 * _bit_counts(texts, hashes) >= grams[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).tolist()
        values = [v if n else _hash(t) if t else 0 for v, n, t in zip(values, grams.tolist(), texts, strict=True)]
        # A series of integers and nulls would pass through doubles, which lose the low bits.
        yield pd.Series([None if t is None else _signed(v) for v, t in zip(values, batch, strict=True)], dtype="Int64")


def banded_pairs(df: DataFrame, id_col: str, print_col: str, distance: int = 3, hash_col: str | None = None) -> DataFrame:
    """left_id, right_id, bits: rows whose fingerprints differ in up to ``distance`` (0 to 3) bits.

    Distinct fingerprints are compared, each bucket of three equal blocks by a join on it; rows
    of one fingerprint are then listed with their partners of other fingerprints. With
    ``hash_col``, the hash of the content, rows of one fingerprint whose contents differ are
    pairs of 0 bits too. For classes of copies use ``near_links`` or ``near_keep``, which
    don't list all pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the blocks find all pairs at 0 to 3 bits")
    links = fingerprint_links(df.select(F.col(print_col).alias("fp")).where("fp is not null").distinct(), distance)
    content = F.col(hash_col) if hash_col else F.lit(None)
    left = df.select(F.col(id_col).alias("left_id"), F.col(print_col).alias("a"), content.alias("left_hash"))
    right = df.select(F.col(id_col).alias("right_id"), F.col(print_col).alias("b"), content.alias("right_hash"))
    both = left.join(links, "a").join(right, "b").select("left_id", "right_id", "bits")
    if hash_col:
        same = left.join(right, F.col("a") == F.col("b")).where("left_hash < right_hash")
        both = both.union(same.select("left_id", "right_id", F.lit(0).alias("bits")))
    return both.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "bits")


def near_links(df: DataFrame, id_col: str, hash_col: str, print_col: str, distance: int = 3) -> DataFrame:
    """id, near_id, bits, kind: all near pairs of rows, held by links of representatives.

    The row of the smallest id stands for its content, and that of the smallest id for its
    fingerprint. ``copy`` leads from a row to the one of its content; ``fingerprint`` from
    that to the one of its fingerprint, whose content is another (0 bits); ``near`` from one
    fingerprint's to another's. Two rows of different content are a pair if they lead to one
    fingerprint or to two that are linked. Ids are unique; rows without a content are in no pair.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the blocks find all pairs at 0 to 3 bits")
    # Written before the filter, which would make the fingerprints once more.
    rows = checkpointed(df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("hash"), F.col(print_col).alias("fp"))).where("hash is not null and fp is not null")
    contents = checkpointed(rows.groupBy("fp", "hash").agg(F.min("id").alias("first")))
    heads = checkpointed(contents.groupBy("fp").agg(F.min("first").alias("head")))
    copies = rows.join(contents, ["fp", "hash"]).where("id <> first").select("id", F.col("first").alias("near_id"), F.lit(0).alias("bits"), F.lit("copy").alias("kind"))
    same = contents.join(heads, "fp").where("first <> head").select(F.col("first").alias("id"), F.col("head").alias("near_id"), F.lit(0).alias("bits"), F.lit("fingerprint").alias("kind"))
    a, b = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    near = fingerprint_links(heads.select("fp"), distance).join(a, "a").join(b, "b").select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("near_id"), "bits", F.lit("near").alias("kind"))
    return copies.union(same).union(near)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    return [_signed(sum(1 << b for k in chosen for b in range(edges[k], edges[k + 1]))) for chosen in combinations(range(BLOCKS), AGREEING)]


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """fp, c, k: each fingerprint at its bits of each choice of blocks."""
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    return prints.select("fp", F.explode(keys).alias("x")).select("fp", "x.c", "x.k")


def fingerprint_links(prints: DataFrame, distance: int) -> DataFrame:
    """a < b, bits: different fingerprints (column fp, distinct) at up to ``distance`` bits.

    Each is keyed by all choices of three blocks (32 bits or so), so that unrelated ones
    rarely meet however many there are.
    """
    masks = _masks()
    # Both sides of the join read the table that is written here; fingerprints are made once.
    keyed = _keyed(checkpointed(prints.select("fp")), masks)
    l, r = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    pairs = shuffled(l, r, ["c", "k"]).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    bits = F.bit_count(differ)
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    # A pair that agrees for several choices counts for the first only; no distinct is needed.
    return pairs.where((bits <= distance) & (F.col("c") == first)).select("a", "b", bits.alias("bits"))


def spanning_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) at up to ``distance`` bits (0 to 3) whose classes are those
    of all such links.

    A bucket of up to PAIRWISE is compared pair by pair. In a larger one each fingerprint
    names what is one bit away from it, and two bits for distance 3; two that are within
    the distance name one in common, and those that name the same are linked through one of
    them. So work grows in proportion to the fingerprints, however close they lie.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the blocks find all pairs at 0 to 3 bits")
    masks = _masks()
    keyed = _keyed(checkpointed(prints.select("fp")), masks)
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpointed(shuffled(keyed, sizes, ["c", "k"]))
    few = met.where(F.col("n") <= PAIRWISE)
    l, r = few.select("c", "k", F.col("fp").alias("a")), few.select("c", "k", F.col("fp").alias("b"))
    pairs = shuffled(l, r, ["c", "k"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()
    many = met.where(F.col("n") > PAIRWISE).select("fp", "c")
    flips = []
    for c, m in enumerate(masks):
        free = [1 << b for b in range(64) if not m >> b & 1]
        flips += [(c, 0, 0)] + [(c, 1, _signed(x)) for x in free if distance] + [(c, 2, _signed(x | y)) for x, y in combinations(free, 2) if distance == 3]
    offs = prints.sparkSession.createDataFrame(flips, "c int, d int, f long")
    named = many.join(F.broadcast(offs), "c").select("fp", "c", "d", F.col("fp").bitwiseXOR(F.col("f")).alias("ball"))  # 10,600 rows at most
    # Nearest first: what is one bit off the middle is two bits at most from its like, and three from what is two bits off.
    hubs = named.groupBy("c", "ball").agg(F.min(F.struct("d", "fp")).alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1).select("c", "ball", "hub")
    hubs = hubs.where(F.col("hub.d") <= (1 if distance > 1 else 0))
    balls = shuffled(named, hubs, ["c", "ball"]).where(F.col("d") + F.col("hub.d") <= distance).select(F.col("fp").alias("a"), F.col("hub.fp").alias("b")).where("a <> b").distinct()
    return pairs.union(balls)


def near_classes(df: DataFrame, id_col: str, hash_col: str, print_col: str, distance: int = 3) -> DataFrame:
    """id, class_id, n_copies, n_same: the class of each row under links at up to ``distance`` bits.

    ``class_id`` is the smallest id that links lead to, the row's own included; ``n_copies``
    how many other rows have its content, ``n_same`` how many other contents its fingerprint. A row without
    a content or a fingerprint is alone in its class and has null counts. One row for each row;
    nothing grows with the square of a class.
    """
    rows = checkpointed(df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("hash"), F.col(print_col).alias("fp")))
    told = rows.where("hash is not null and fp is not null")
    contents = checkpointed(told.groupBy("fp", "hash").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    heads = checkpointed(contents.groupBy("fp").agg(F.min("first").alias("head"), F.count("*").alias("contents")))
    parts = components(spanning_links(heads.select("fp"), distance))
    held = heads.join(parts, heads.fp == parts.node, "left").withColumn("root", F.coalesce("root", "fp"))
    least = held.groupBy("root").agg(F.min("head").alias("class_id"))
    large = held.groupBy("root").agg(F.count("*").alias("n"))
    least_of = checkpointed(met(held.drop("node"), least.join(large, "root"), ["root"], "n").select("fp", "class_id", "contents"))
    # The rows of a large class stay where they are; so do the contents of a fingerprint that has many.
    sizes = contents.groupBy("fp").agg(F.count("*").alias("n"))
    facts = met(contents, least_of.join(sizes, "fp"), ["fp"], "n").select("fp", "hash", "class_id", (F.col("rows") - 1).alias("n_copies"), (F.col("contents") - 1).alias("n_same"), F.col("rows").alias("n"))
    out = met(rows, checkpointed(facts), ["fp", "hash"], "n", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), "n_copies", "n_same")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of a table of links a, b (long, not null); root is the least node it is linked to.

    Rounds of large and small stars: each node points its larger neighbours, then its smaller
    ones, at the least it sees. Each round is written, so a lost executor costs one round;
    their number grows with the logarithm of the longest chain. Repeated links and links from
    a node to itself are allowed; without links the result is empty.
    """

    def proper(t: DataFrame) -> DataFrame:
        return t.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = checkpointed(proper(links))
    seen = mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = proper(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("x"))
        before, now = now, checkpointed(proper(small.select("x.a", "x.b")))
        forgotten(before)
        last, seen = seen, mark(now)
        if seen == last:
            break
    leaves = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def leakage(left: DataFrame, right: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """key_type, value that both tables have, for each kind of key."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("key_type"), c.cast("string").alias("value")) for n, c in keys.items()])).alias("x")
    l, r = (t.select(pairs).select("x.*").where("value is not null").distinct() for t in (left, right))
    return l.join(r, ["key_type", "value"], "left_semi")


def message_fingerprint(c: Column | str) -> Column:
    return content_hash(F.to_json(column(c)))
