"""Deterministic sampling, quotas, splits and queues.

Every order is total: a hash of an id, then the id. Nothing depends on the order of the
input or on partitions. Windows are over strata; a limit over all rows is a top-k, which
keeps k rows a task and doesn't sort the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column, rank, share


def bottom_k(df: DataFrame, k: int, *parts: Column | str, tie: str) -> DataFrame:
    """The k rows of the smallest hash ranks, ties by ``tie``; column ``rank_hex`` added."""
    return df.withColumn("rank_hex", rank(*parts)).orderBy("rank_hex", tie).limit(k)


def round_robin(df: DataFrame, strata: list[str], order: Column, tie: str, limit: int | None = None) -> DataFrame:
    """Rows in rounds over the strata: the first of each, then the second of each, ...

    ``nth`` is the row's place in its stratum. With ``limit`` that many rows stay, the
    strata in sorted order within a round.
    """
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy(order, tie))
    out = df.withColumn("nth", nth)
    # A row beyond ``limit`` in its stratum can't be taken; saying so lets Spark cut strata before the shuffle.
    return out if limit is None else out.where(F.col("nth") <= limit).orderBy("nth", *strata).limit(limit)


def largest_remainder(df: DataFrame, weight: Column, total: int, name: str) -> DataFrame:
    """``quota`` of each row: floors of its share of ``total``, the rest by largest fraction, then name.

    For tables of groups; the one window over all of them has a row for each group.
    """
    w = Window.partitionBy(F.lit(1))
    exact = weight * F.lit(total) / F.sum(weight).over(w)
    base = df.withColumn("__w", weight).withColumn("__exact", exact).withColumn("__floor", F.floor("__exact").cast("long"))
    base = base.withColumn("__left", F.lit(total) - F.sum("__floor").over(w))
    nth = F.row_number().over(w.orderBy(F.round(F.col("__exact") - F.col("__floor"), 9).desc(), name))
    return base.withColumn("quota", F.col("__floor") + (nth <= F.col("__left")).cast("long")).drop("__w", "__exact", "__floor", "__left")


def proportional_subset(df: DataFrame, group: str, total: int, order: Column, tie: str) -> DataFrame:
    """``total`` rows with each group's share of the table, by ``order`` within groups. Null is a group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    quotas = largest_remainder(sizes, F.col("n"), total, group).select(group, "quota")
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order, tie))
    placed = df.withColumn("nth", nth).where(F.col("nth") <= total)
    return placed.join(quotas.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group"))).where("nth <= quota").drop("__group")


def two_level_subset(df: DataFrame, outer: str, inner: str, total: int, order: Column, tie: str) -> DataFrame:
    """Proportional quotas for ``outer`` groups, then within each for its ``inner`` groups. Null is a group."""
    sizes = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    by_outer = sizes.groupBy(outer).agg(F.sum("n").alias("n_outer"))
    top = largest_remainder(by_outer, F.col("n_outer"), total, outer).withColumnRenamed("quota", "outer_quota")
    w = Window.partitionBy(outer)
    both = sizes.join(top.withColumnRenamed(outer, "__outer"), F.col(outer).eqNullSafe(F.col("__outer"))).drop("__outer").withColumn("__exact", F.col("n") * F.col("outer_quota") / F.col("n_outer"))
    both = both.withColumn("__floor", F.floor("__exact").cast("long"))
    left = F.col("outer_quota") - F.sum("__floor").over(w)
    nth = F.row_number().over(w.orderBy(F.round(F.col("__exact") - F.col("__floor"), 9).desc(), inner))
    quotas = both.withColumn("quota", F.col("__floor") + (nth <= left).cast("long")).select(outer, inner, "quota")
    place = F.row_number().over(Window.partitionBy(outer, inner).orderBy(order, tie))
    named = quotas.withColumnsRenamed({outer: "__outer", inner: "__inner"})
    same = F.col(outer).eqNullSafe(F.col("__outer")) & F.col(inner).eqNullSafe(F.col("__inner"))
    return df.withColumn("nth", place).where(F.col("nth") <= total).join(named, same).where("nth <= quota").drop("__outer", "__inner")


def split_targets(df: DataFrame, strata: list[str], targets: dict[str, int], split: str, order: Column, tie: str) -> DataFrame:
    """For each split its target of rows, round robin over the strata; what a split lacks is
    filled from the other splits' leftovers in hash order."""
    total, chosen = sum(targets.values()), None
    for s, n in targets.items():
        part = round_robin(df.where(F.col(split) == s), strata, order, tie, n)
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("nth", *strata))  # over a split's target of rows
        part = part.withColumn("place", place)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("backfill", F.lit(False))
    short = total - chosen.count()
    if short <= 0:
        return chosen
    rest = df.join(chosen.select(tie), tie, "left_anti").orderBy(order, tie).limit(short)
    return chosen.unionByName(rest.withColumn("backfill", F.lit(True)), allowMissingColumns=True)


def threshold_split(df: DataFrame, fraction: float, *parts: Column | str) -> DataFrame:
    """``split``: validation where the hash of the parent lies below the fraction, else train."""
    return df.withColumn("split", F.when(share(*parts) < F.lit(int(fraction * (1 << 60))), "validation").otherwise("train"))


def dealt(size: int, many: int, lacking: list[int]) -> list[tuple[int, int]]:
    """(split, how many) in turn: ``many`` groups of one size, each to the split whose deviation it lessens most.

    ``lacking`` is what each split lacks of its target, and is changed. A split that lacks a whole group or more gains by all
    of it, so the first such split is filled until it lacks less than a group, then the next. Then each one that lacks
    anything takes one group, the one that lacks most first. All later groups only add to the deviation, wherever
    they go: the first split has them.
    """
    out = []

    def give(i: int, n: int) -> None:
        lacking[i] -= n * size
        out.append((i, n))

    for i in range(len(lacking)):
        n = min(many, max(lacking[i], 0) // size)
        if n:
            give(i, n)
            many -= n
    for i in sorted((i for i, x in enumerate(lacking) if 0 < x < size), key=lambda i: -lacking[i])[:many]:
        give(i, 1)
        many -= 1
    if many:
        give(0, many)
    return out


def greedy_group_split(df: DataFrame, group: str, salt: str, ratios: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """``split``: whole groups, largest first (then by hash), each to the split that leaves the
    least total deviation from the targets; ties go to the earlier split.

    Groups of one size that follow each other differ in hash only, so they are dealt out together, in whole numbers and
    as many steps as there are splits (``dealt``). The walk holds a row for each different size; n rows have
    no more than about the root of 2 n of them. Ratios are taken as the decimal fractions they are written as.
    """
    from fractions import Fraction
    from math import lcm

    from .joins import met

    sizes = df.groupBy(group).agg(F.count("*").alias("size"))  # null is a group
    ranked = positions(sizes.withColumn("hashed", rank(F.lit(salt), group)), "size", "hashed", group)
    runs = ranked.groupBy("size").agg(F.count("*").alias("many"), F.min("position").alias("first"))
    names, parts = [n for n, _ in ratios], [Fraction(str(r)) for _, r in ratios]
    unit = lcm(*[p.denominator for p in parts])

    def walk(batches):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("size", ascending=False)
        total = sum(int(s) * int(m) for s, m in zip(rows["size"], rows["many"], strict=True))
        lacking = [int(p * unit) * total for p in parts]
        for size, many, first in zip(rows["size"].tolist(), rows["many"].tolist(), rows["first"].tolist(), strict=True):
            turns, nth = [], 1
            for i, n in dealt(size * unit, many, lacking):
                turns.append({"from_nth": nth, "to_nth": nth + n - 1, "split": names[i]})
                nth += n
            yield pd.DataFrame({"size": [size], "many": [many], "first": [first], "turns": [turns]})

    spans = runs.coalesce(1).mapInPandas(walk, "size long, many long, first long, turns array<struct<from_nth:long,to_nth:long,split:string>>")
    # Sizes that most groups have meet their turns by broadcast.
    placed = met(ranked.select(group, "size", "position"), spans, ["size"], "many")
    nth = F.col("position") - F.col("first") + 1
    turn = F.get(F.filter("turns", lambda t: nth.between(t["from_nth"], t["to_nth"])), F.lit(0))
    facts = placed.select(group, "size", turn["split"].alias("split"))
    return met(df, facts, [group], "size")


def capped_selection(df: DataFrame, bucket: str, targets: dict[str, int], margin: str, parent: str, cap: int, tie: str) -> DataFrame:
    """Lowest margins first to each bucket's target, scarcest bucket first, at most ``cap`` rows of
    a parent over all buckets. Raises ValueError where a target can't be met.

    Within a bucket rows are taken in order (margin, then ``tie``, which is unique), so a parent's rows are the first of its own that
    its remaining cap allows. All buckets are settled at once: from what each (bucket, parent) is thought to have taken,
    what is left of the parents' caps in later buckets, and so what each takes, until nothing changes. After each
    step one more bucket is final at least, mostly all are after two or three. A step reads at most ``cap`` rows of each (bucket, parent),
    placed once over ranges of (bucket, margin, tie). A null parent has its cap like others.
    """
    from ..sources.sinks import checkpointed

    spark = df.sparkSession
    wanted = {b: n for b, n in targets.items() if n}
    if not wanted:
        return df.limit(0)
    have = {r[bucket]: r["count"] for r in df.where(F.col(bucket).isin(*wanted)).groupBy(bucket).count().collect()}  # a row for each target
    order = sorted(wanted, key=lambda b: (have.get(b, 0) / wanted[b], b))
    named = F.broadcast(spark.createDataFrame([(b, i, wanted[b]) for i, b in enumerate(order)], f"__b `{df.schema[bucket].dataType.simpleString()}`, turn int, target long".replace("`", "")))
    rows = df.join(named, F.col(bucket) == F.col("__b")).select("turn", "target", F.col(margin).alias("m"), F.col(tie).alias("t"), F.col(parent).alias("p"))
    nth = F.row_number().over(Window.partitionBy("turn", "p").orderBy("m", "t"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= cap)
    placed = checkpointed(positions(first, "turn", "m", "t", part="part"))
    cells = checkpointed(placed.select("turn", "p").distinct().withColumn("used", F.lit(0).cast("long")))
    while True:
        used = cells.withColumnsRenamed({"turn": "u_turn", "p": "u_p"})
        allowed = placed.join(used, (F.col("turn") == F.col("u_turn")) & F.col("p").eqNullSafe(F.col("u_p"))).where(F.col("nth") <= F.lit(cap) - F.col("used")).drop("u_turn", "u_p", "used")
        allowed = checkpointed(allowed)
        sizes = allowed.groupBy(F.col("turn").alias("s_turn")).agg(F.count("*").alias("n"))  # a row for each bucket
        earlier = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("s_turn").rowsBetween(Window.unboundedPreceding, -1))
        starts = F.broadcast(sizes.select("s_turn", F.coalesce(earlier, F.lit(0)).alias("before")))
        numbered = carried(allowed, F.lit(1), "sum", "upto", "part", "position").join(starts, F.col("turn") == F.col("s_turn"))
        taken = numbered.where(F.col("upto") - F.col("before") <= F.col("target")).select("turn", "p", "t")
        counts = taken.groupBy("turn", "p").agg(F.count("*").alias("n")).withColumnsRenamed({"turn": "c_turn", "p": "c_p"})
        met_ = cells.join(counts, (F.col("turn") == F.col("c_turn")) & F.col("p").eqNullSafe(F.col("c_p")), "left")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
        after = checkpointed(met_.select("turn", "p", before.alias("now"), "used", F.coalesce("n", F.lit(0)).alias("n")))
        if after.where("now <> used").isEmpty():
            break
        cells = after.select("turn", "p", F.col("now").alias("used"))
    got = {r.turn: r.n for r in after.groupBy("turn").agg(F.sum("n").alias("n")).collect()}  # a row for each bucket
    for i, b in enumerate(order):
        if got.get(i, 0) < wanted[b]:
            raise ValueError(f"bucket {b} has too few rows within the cap")
    keys = checkpointed(taken.select(F.col("t").alias("__t")))
    few = sum(wanted.values()) <= 1_000_000
    return df.join(F.broadcast(keys) if few else keys, F.col(tie) == F.col("__t"), "left_semi")


def risk_sample(df: DataFrame, score: Column, limit: int, strata: list[str], order: Column, tie: str, least: int = 3, share_of_risk: float = 0.6) -> DataFrame:
    """``selection_type`` risk or control: up to round-half-even(limit * share) rows of a score of
    ``least`` or more, controls to fill, then whatever rows are left, all round robin."""
    scored = df.withColumn("risk_score", score)
    want = round(limit * share_of_risk)  # halves to even
    risk = round_robin(scored.where(F.col("risk_score") >= least), strata, order, tie, want).withColumn("selection_type", F.lit("risk"))
    n = min(want, scored.where(F.col("risk_score") >= least).count())
    control = round_robin(scored.where(F.col("risk_score") < least), strata, order, tie, limit - n).withColumn("selection_type", F.lit("control"))
    both = risk.unionByName(control)
    rest = limit - n - min(limit - n, scored.where(F.col("risk_score") < least).count())
    if rest > 0:
        more = round_robin(scored.join(both.select(tie), tie, "left_anti"), strata, order, tie, rest).withColumn("selection_type", F.lit("fallback"))
        both = both.unionByName(more)
    return both


def priority_queue(df: DataFrame, reason: Column, quotas: list[tuple[str, int]], order: Column, tie: str, total: int) -> DataFrame:
    """``reason`` quotas in their order of priority, by hash within each, then fill to ``total``."""
    ranked = df.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("reason").orderBy(order, tie))
    priority = F.coalesce(*[F.when(F.col("reason") == r, F.lit(i)) for i, (r, _) in enumerate(quotas)], F.lit(len(quotas)))
    quota = F.coalesce(*[F.when(F.col("reason") == r, F.lit(n)) for r, n in quotas], F.lit(0))
    placed = ranked.withColumn("nth", nth).where(F.col("nth") <= total).withColumn("priority", priority).withColumn("within", F.col("nth") <= quota)
    return placed.orderBy(F.col("within").desc(), F.when(F.col("within"), F.col("priority")), order, tie).limit(total)


def tiered_sequence(spark, limit: int, scenarios: list[str], tiers: tuple[str, str, str]) -> DataFrame:
    """idx, tier, scenario: half, a quarter and the rest of ``limit`` in the tiers, scenarios in turn."""
    a, b = limit // 2, limit // 2 + limit // 4
    base = spark.range(limit).select(F.col("id").alias("idx"))
    base = base.withColumn("tier", F.when(F.col("idx") < a, tiers[0]).when(F.col("idx") < b, tiers[1]).otherwise(tiers[2]))
    start = F.when(F.col("idx") < a, 0).when(F.col("idx") < b, a).otherwise(b)
    return base.withColumn("scenario", F.element_at(F.array(*map(F.lit, scenarios)), (F.pmod(F.col("idx") - start, F.lit(len(scenarios))) + 1).cast("int")))


def occurrence(df: DataFrame, key: str, order: str, offset: int = 0) -> DataFrame:
    """``occurrence``: how many rows of the key came before, plus ``offset``."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1 + offset)


def numbered_slice(df: DataFrame, key: str, order: list, offset: int, limit: int, whole: bool = False) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of each key; with ``whole`` a key that has fewer raises ValueError."""
    if whole:
        few = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < offset + limit)
        if not few.isEmpty():
            raise ValueError(f"a {key} has fewer than {offset + limit} rows")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth").between(offset + 1, offset + limit))


def variants(df: DataFrame, n: int) -> DataFrame:
    """Each row ``n`` times with ``variant`` 0 to n - 1."""
    return df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def first_occurrence(df: DataFrame, key: Column | str, order: str) -> DataFrame:
    """``duplicate_of``: null for the first row of each key, else that row's ``order`` value. Null is a key.

    The first of each key comes from a partial aggregation, so a frequent key costs no sort.
    """
    keyed = df.withColumn("__key", column(key))
    first = keyed.groupBy(F.col("__key").alias("__of")).agg(F.min(order).alias("__first"))
    joined = keyed.join(first, F.col("__key").eqNullSafe(F.col("__of")))
    return joined.withColumn("duplicate_of", F.when(F.col(order) != F.col("__first"), F.col("__first"))).drop("__key", "__of", "__first")


def positions(df: DataFrame, *order: str, part: str | None = None) -> DataFrame:
    """``position``: the row's place (from 0) in an order; ``part``, if named, is the range of the order that it lies in.

    Places come from range partitions and their counts, not from one window over all rows.
    """
    from ..sources.sinks import checkpointed

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__low"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    offsets = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).select("__part", "__before", "__low")
    placed = ranged.join(F.broadcast(offsets), "__part")
    named = [F.col("__part").alias(part)] if part else []
    return placed.select(*[F.col(c) for c in df.columns], *named, (F.col("__before") + F.col("__at") - F.col("__low")).alias("position"))


def carried(df: DataFrame, value: Column, kind: str, name: str, part: str, position: str) -> DataFrame:
    """``name``: the ``sum`` or ``max`` of ``value`` over all rows up to this one, in the order of ``position``.

    ``part`` numbers ranges of that order, as ``positions`` names them. What holds before a range comes from one value for
    each range, so no task has more than a range.
    """
    of, both = {"sum": (F.sum, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), "max": (F.max, F.greatest)}[kind]
    totals = df.groupBy(F.col(part).alias("__of")).agg(of(value).alias("__total"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.withColumn("__before", of("__total").over(earlier)).select("__of", "__before")
    here = of(value).over(Window.partitionBy(part).orderBy(position))
    out = df.withColumn("__here", here).join(F.broadcast(before), F.col(part) == F.col("__of"))
    return out.withColumn(name, both("__before", "__here")).drop("__here", "__of", "__before")


def shards(df: DataFrame, n: int, *order: str) -> DataFrame:
    """``shard``: the rows dealt out in turn by their place in the order."""
    placed = positions(df, *order)
    return placed.withColumn("shard", F.pmod(F.col("position"), F.lit(n)).cast("int")).drop("position")


def merged(parts: list[DataFrame], wanted: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The union of shards; raises ValueError unless its keys are unique and exactly the wanted ones. With ``order``, a
    column of ``wanted``, the rows come sorted by it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    counts = out.groupBy(key).agg(F.count("*").alias("n"))
    bad = counts.join(wanted.select(key).distinct().withColumn("__wanted", F.lit(1)), key, "full_outer").where("n is null or n > 1 or __wanted is null")
    if not bad.isEmpty():
        raise ValueError("shards don't cover the wanted keys exactly once")
    if order is None:
        return out
    placed = wanted.select(F.col(key).alias("__key"), F.col(order).alias("__order"))
    return out.join(placed, F.col(key) == F.col("__key")).orderBy("__order", key).drop("__key", "__order")


def shuffled(df: DataFrame, seed: str, key: str, limit: int | None = None) -> DataFrame:
    """The rows in an order that a seed and a key give, or the first ``limit`` of it; the same for any partitioning."""
    ordered = df.withColumn("__rank", rank(F.lit(seed), key)).orderBy("__rank", key)
    return (ordered if limit is None else ordered.limit(limit)).drop("__rank")


def seeded_split(df: DataFrame, fraction: float, seed: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(validation, train) by a hash of a seed and a key: about ``fraction`` of the rows, the same for any partitioning."""
    named = threshold_split(df, fraction, F.lit(seed), key)
    return tuple(named.where(F.col("split") == s).select(*df.columns) for s in ("validation", "train"))


def head_split(df: DataFrame, percent: float, *order: str) -> tuple[DataFrame, DataFrame]:
    """(validation, train): the first ``percent`` of the rows in an order, and the rest."""
    cut = df.select(F.struct(*order).alias("k"))
    n = int(df.count() * percent / 100)
    if not n:
        return df.limit(0), df
    last = cut.orderBy("k").limit(n).agg(F.max("k").alias("k")).withColumnRenamed("k", "__last")
    bound = last.first()["__last"]
    first = F.struct(*order) <= F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(bound, order, strict=True)])
    return df.where(first), df.where(~first)


def balanced_preferences(df: DataFrame, level: str, kind: str, limit: int, order: Column, tie: str) -> DataFrame:
    """40 % response, 25 % decision (half of them each kind of target), 35 % parameter pairs by hash;
    what a group lacks is filled from the others' leftovers, and the result is in hash order."""
    want = {("response", None): round(limit * 0.4), ("decision", "action"): round(limit * 0.25) // 2, ("decision", "response"): round(limit * 0.25) - round(limit * 0.25) // 2}
    want[("parameter", None)] = limit - sum(want.values())
    group = F.when(F.col(level) == "decision", F.concat(F.lit("decision:"), F.col(kind))).otherwise(F.col(level))
    quota = F.coalesce(*[F.when(group == (f"{a}:{b}" if b else a), F.lit(n)) for (a, b), n in want.items()], F.lit(0))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order, tie))
    placed = df.withColumn("nth", nth).where(F.col("nth") <= limit).withColumn("within", F.col("nth") <= quota)
    return placed.orderBy(F.col("within").desc(), order, tie).limit(limit).drop("nth")


def capped_pairs(pairs: DataFrame, left: str, right: str, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` pairs in the order (right, left) of a report, and whether there were more."""
    some = pairs.orderBy(right, left).limit(most + 1)
    return some.limit(most), some.count() > most
