"""Near copies without pairs: counts, nearest partners and greedy choice, however many rows lie close together.

Fingerprints of 64 bits in six blocks that differ in up to three bits agree outside some three blocks. So they meet in
the bucket of those blocks' other bits. Buckets of up to LISTED fingerprints are compared pair by pair. In a larger one
each fingerprint adds itself to what lies one and two bits off it, within the bucket's free bits, and reads off
what others have added there: at its own place those one and two bits away, at the places one bit off itself those
three bits away (each three times, besides those one bit away). Work grows with the fingerprints and not with their pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import checkpointed, forgotten
from .joins import met, shuffled
from .selection import positions

BLOCKS, MOST = 6, 3
#: Most fingerprints of a bucket that are compared pair by pair.
LISTED = 2000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _free(blocks: tuple[int, ...]) -> list[int]:
    """The bits of some blocks."""
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    return [b for k in blocks for b in range(edges[k], edges[k + 1])]


def _choices(*sizes: int) -> list[list[int]]:
    """Free bits of each choice of so many blocks."""
    return [_free(chosen) for size in sizes for chosen in combinations(range(BLOCKS), size)]


def _keyed(prints: DataFrame, choices: list[list[int]]) -> DataFrame:
    """fp, c, k: each fingerprint at the bits that aren't free, for each choice."""
    keys = [F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(~_signed(sum(1 << b for b in free)))).alias("k")) for i, free in enumerate(choices)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.c", "x.k")


def _flips(spark, choices: list[list[int]], low: int, high: int) -> DataFrame:
    """c, d, f: every choice of ``low`` to ``high`` free bits, as bits to flip; 13,000 rows at most."""
    rows = [(i, d, _signed(sum(1 << b for b in bits))) for i, free in enumerate(choices) for d in range(low, high + 1) for bits in combinations(free, d)]
    return spark.createDataFrame(rows, "c int, d int, f long")


def _buckets(prints: DataFrame, choices: list[list[int]]) -> DataFrame:
    """fp, c, k, n: the buckets of more than one fingerprint; written."""
    keyed = _keyed(prints, choices)
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    return checkpointed(shuffled(keyed, sizes, ["c", "k"]))


def _placed(many: DataFrame, flips: DataFrame) -> DataFrame:
    """The rows of ``many`` (fp, c, ...) at each place that the flips of their choice lead to."""
    return many.join(F.broadcast(flips), "c").withColumn("ball", F.col("fp").bitwiseXOR(F.col("f"))).drop("f")


def near_counts(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """fp, split, n1, n2, n3, nearest: for each fingerprint and each split, what the split has at 1, 2 and 3 bits.

    ``nodes`` has (fp, split, weight, id), each fingerprint of a split once, without nulls. Counts are sums of weights, and exact;
    ``nearest`` is a struct (bits, id): for each distance up to ``distance`` the least id, as array by distance. A
    fingerprint and split with nothing near have no row.

    A pair that differs in j blocks meets in several choices of free blocks; counts over choices of three, two and
    one blocks, taken 1, -3 and 6 times, have it once.
    """
    if not 0 <= distance <= MOST:
        raise ValueError("the blocks find all pairs at 0 to 3 bits")
    spark = nodes.sparkSession
    prints = checkpointed(nodes.select("fp").distinct())
    wide = _choices(MOST)
    close = checkpointed(_buckets(prints, wide).select("fp").distinct())  # all others are near nothing
    choices = _choices(MOST, 2, 1)
    times = {3: 1, 2: -3, 1: 6}
    weights = [times[size] for size in (3, 2, 1) for _ in combinations(range(BLOCKS), size)]
    taken = F.element_at(F.array(*map(F.lit, weights)), F.col("c") + 1)
    buckets = _buckets(close, choices)
    held = nodes.withColumnRenamed("fp", "b")
    at = lambda d: F.sum(F.when(F.col("bits") == d, F.col("part"))).alias(f"n{d}")
    first = lambda d: F.min(F.when(F.col("bits") == d, F.col("id"))).alias(f"id{d}")

    few = buckets.where(F.col("n") <= LISTED)
    left, right = few.select("c", "k", F.col("fp").alias("a")), few.select("c", "k", F.col("fp").alias("b")).join(held, "b")
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = shuffled(left, right, ["c", "k"]).withColumn("bits", bits).where(F.col("bits").between(1, distance)).withColumn("part", taken * F.col("weight"))
    listed = pairs.groupBy(F.col("a").alias("fp"), "split").agg(*[at(d) for d in (1, 2, 3)], *[first(d) for d in (1, 2, 3)])

    many = checkpointed(buckets.where(F.col("n") > LISTED).select("fp", "c"))
    if many.isEmpty():
        return _summed(listed, distance)
    added = _placed(many, _flips(spark, choices, 1, min(distance, 2))).join(held, F.col("fp") == F.col("b"))
    when = lambda d, c: F.when(F.col("d") == d, F.col(c))
    balls = added.groupBy("c", "ball", "split").agg(*[F.coalesce(F.sum(when(d, "weight")), F.lit(0)).alias(f"c{d}") for d in (1, 2)], *[F.min(when(d, "id")).alias(f"m{d}") for d in (1, 2)])
    reads = _placed(many, _flips(spark, choices, 0, 1 if distance == MOST else 0))
    seen = shuffled(reads, checkpointed(balls), ["c", "ball"])
    own, off = F.col("d") == 0, F.col("d") == 1
    found = seen.groupBy("fp", "c", "split").agg(
        F.sum(F.when(own, F.col("c1"))).alias("n1"), F.sum(F.when(own, F.col("c2"))).alias("n2"), F.sum(F.when(off, F.col("c2"))).alias("o3"),
        F.min(F.when(own, F.col("m1"))).alias("id1"), F.min(F.when(own, F.col("m2"))).alias("id2"), F.min(F.when(off, F.col("m2"))).alias("id3"),
    )
    sizes = F.element_at(F.array(*[F.lit(len(free)) for free in choices]), F.col("c") + 1)
    # Of what two bits off a neighbouring place holds, those one bit away are found from all other places but their own.
    three = (F.coalesce("o3", F.lit(0)) - (sizes - 1) * F.coalesce("n1", F.lit(0))) / 3 if distance == MOST else F.lit(0)
    weighed = found.select("fp", "split", *[(taken * x).cast("long").alias(f"n{d}") for d, x in ((1, F.col("n1")), (2, F.col("n2")), (3, three))], "id1", "id2", "id3")
    return _summed(listed.unionByName(weighed), distance)


def _summed(parts: DataFrame, distance: int) -> DataFrame:
    sums = [F.coalesce(F.sum(f"n{d}"), F.lit(0)).cast("long").alias(f"n{d}") for d in (1, 2, 3)]
    return parts.groupBy("fp", "split").agg(*sums, F.array(*[F.min(f"id{d}") for d in range(1, distance + 1)]).alias("nearest") if distance else F.array().alias("nearest"))


def near_rows(df: DataFrame, id_col: str, hash_col: str, print_col: str, split: str, distance: int = 3) -> DataFrame:
    """id, hash, split, other_split, near, bits, near_id: for each content of each split, named by its least id, and each
    split that has other contents within ``distance`` bits: how many, and of those with a smaller id the nearest (its bits and least id).

    ``near`` counts contents of the other split, exactly; ``near_id`` is null where all of them have larger ids, so of
    two near contents the later one names the earlier. Rows without a content or a fingerprint are near nothing; a null split is
    ''. Rows grow with the contents and splits, not with pairs.
    """
    told = df.where(F.col(hash_col).isNotNull() & F.col(print_col).isNotNull())
    contents = told.groupBy(F.col(print_col).alias("fp"), F.col(hash_col).alias("hash"), F.coalesce(F.col(split), F.lit("")).alias("split")).agg(F.min(id_col).alias("id"))
    contents = checkpointed(contents)
    heads = contents.groupBy("fp", "split").agg(F.count("*").alias("n"), F.min(F.struct("id", "hash")).alias("m"))
    heads = checkpointed(heads.select("fp", "split", "n", F.col("m.id").alias("m_id"), F.col("m.hash").alias("m_hash")))
    apart = near_counts(heads.select("fp", "split", F.col("n").alias("weight"), F.col("m_id").alias("id")), distance)
    # Of one fingerprint: other contents, and the least two ids, since one may be the content's own.
    second = met(contents, heads.select("fp", "split", "n", "m_hash"), ["fp", "split"], "n").where("hash <> m_hash").groupBy("fp", "split").agg(F.min("id").alias("s_id"))
    one = heads.join(second, ["fp", "split"], "left").select("fp", "split", F.col("n").alias("n0"), "m_id", "m_hash", "s_id")
    facts = one.join(apart, ["fp", "split"], "full_outer")
    by_print = facts.groupBy("fp").agg(F.collect_list(F.struct(F.col("split").alias("o"), "n0", "m_id", "m_hash", "s_id", "n1", "n2", "n3", "nearest")).alias("facts"))  # an entry for each split
    sizes = heads.groupBy("fp").agg(F.sum("n").alias("n"))
    own = contents.groupBy("fp", "hash").agg(F.collect_list("split").alias("splits"))  # as many as splits
    spread = met(contents.join(own, ["fp", "hash"]), by_print.join(sizes, "fp"), ["fp"], "n")
    x = spread.select("id", "hash", "split", "splits", F.explode("facts").alias("x")).select("id", "hash", "split", "splits", "x.*")
    mine = F.array_contains("splits", F.col("o"))
    same = F.coalesce(F.col("n0"), F.lit(0)) - mine.cast("long")
    near = same + sum((F.coalesce(f"n{d}", F.lit(0)) for d in range(1, distance + 1)), F.lit(0))
    zero = F.when(mine & (F.col("m_hash") == F.col("hash")), F.col("s_id")).otherwise(F.col("m_id"))
    ids = [zero, *[F.get("nearest", F.lit(d - 1)) for d in range(1, distance + 1)]]
    earlier = F.coalesce(*[F.when(i < F.col("id"), F.struct(F.lit(d).alias("bits"), i.alias("near_id"))) for d, i in enumerate(ids)])
    out = x.select("id", "hash", "split", F.col("o").alias("other_split"), near.alias("near"), earlier.alias("e")).where("near > 0")
    return out.select("id", "hash", "split", "other_split", "near", F.col("e.bits").alias("bits"), F.col("e.near_id").alias("near_id"))


def near_keep(df: DataFrame, id_col: str, print_col: str, priority: Column, distance: int = 3) -> DataFrame:
    """``accepted``: the greedy choice in the order (priority, id) that takes a row unless it is within ``distance`` bits
    of one taken before; not components: a row near to a rejected one only is taken.

    Rows of one fingerprint: the first one stands for all, the others are rejected. Rows without a fingerprint count as
    of one that is near no other. Among the others, rounds take every fingerprint that no earlier undecided one is near to, and
    reject what is near to those. A pair is listed once, from the later one to the earlier one, and goes on to the next
    round only while both are undecided. Within crowded buckets no pair is listed: a place carries the earliest undecided
    one that is one, and that is two bits off it. Each round is written; their number grows with the longest chain of ever
    earlier neighbours.
    """
    if not 0 <= distance <= MOST:
        raise ValueError("the blocks find all pairs at 0 to 3 bits")
    spark = df.sparkSession
    ordered = df.select(F.col(id_col).alias("id"), F.col(print_col).alias("fp"), priority.alias("p"))
    head = checkpointed(positions(ordered.groupBy("fp").agg(F.min(F.struct("p", "id")).alias("key")), "key"))
    prints = head.where("fp is not null").select("fp", F.col("position").alias("o"))
    choices = _choices(MOST)
    buckets = _buckets(prints.select("fp"), choices)
    few = buckets.where(F.col("n") <= LISTED)
    many = checkpointed(buckets.where(F.col("n") > LISTED).select("fp", "c"))
    crowded = not many.isEmpty()
    l, r = few.select("c", "k", F.col("fp").alias("a")), few.select("c", "k", F.col("fp").alias("b"))
    pairs = shuffled(l, r, ["c", "k"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()
    placed = pairs.join(prints.select(F.col("fp").alias("a"), F.col("o").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("o").alias("y")), "b")
    later = F.col("x") > F.col("y")
    pairs = checkpointed(placed.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("fp"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("before")))
    adding, reading = _flips(spark, choices, 1, min(distance, 2)), _flips(spark, choices, 0, 1 if distance == MOST else 0)
    crowded = crowded and distance > 0

    def behind(some: DataFrame, readers: DataFrame) -> DataFrame:
        """fp: those of ``readers`` (fp, o) that an earlier one of ``some`` (fp, o) is near to in a crowded bucket."""
        balls = _placed(many.join(some, "fp"), adding).groupBy("c", "ball").agg(*[F.min(F.when(F.col("d") == d, F.col("o"))).alias(f"m{d}") for d in (1, 2)])
        seen = shuffled(_placed(many.join(readers.withColumnRenamed("o", "own"), "fp"), reading), balls, ["c", "ball"])
        return seen.where(F.when(F.col("d") == 0, F.least("m1", "m2")).otherwise(F.col("m2")) < F.col("own")).select("fp")

    open_ = checkpointed(prints)
    taken = None
    while not open_.isEmpty():
        waiting = pairs.select("fp")
        if crowded:
            waiting = checkpointed(waiting.unionByName(behind(open_, open_)).distinct())
        new = checkpointed(open_.join(waiting, "fp", "left_anti"))
        taken = new if taken is None else taken.unionByName(new)
        # What is near to a taken one comes after it; else that would have had to wait.
        rest = open_.join(waiting, "fp", "left_semi")
        near = pairs.join(new.select(F.col("fp").alias("before")), "before", "left_semi").select("fp")
        if crowded:
            near = near.unionByName(behind(new, rest))
        was_open, open_ = open_, checkpointed(rest.join(near, "fp", "left_anti"))
        had, pairs = pairs, checkpointed(pairs.join(open_.select("fp"), "fp", "left_semi").join(open_.select(F.col("fp").alias("before")), "before", "left_semi").select("fp", "before"))
        for table in (was_open, had, *([waiting] if crowded else [])):
            forgotten(table)
    heads = head.where("fp is null").select(F.col("key.id").alias("__id"))
    if taken is not None:
        heads = heads.unionByName(head.join(taken.select("fp"), "fp").select(F.col("key.id").alias("__id")))
    return df.join(heads, F.col(id_col) == F.col("__id"), "left").withColumn("accepted", F.col("__id").isNotNull()).drop("__id")
