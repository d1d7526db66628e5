"""Rates, percentiles, transitions, paired differences and bootstrap intervals."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType

from ..functions.text import rank, share

#: Bits of a key that a pass over the rows settles; a group has two to that power counts at most.
DIGIT = 20
#: Rows up to which wanted places are broadcast. With more of them, groups beyond this share of all rows (no more than
#: its inverse) still meet theirs by broadcast, and all others by a shuffle in which no group is large.
WANTED_ROWS, LARGE_SHARE = 100_000, 1e-4


def rate(flag: Column) -> Column:
    """Share of true; absent counts as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def rate_where(flag: Column, eligible: Column) -> Column:
    """Share of true among eligible rows; 0 without any."""
    n = F.count_if(eligible)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(eligible & F.coalesce(flag, F.lit(False))) / n)


def grouped_rates(df: DataFrame, group: str, flag: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count_if(flag).alias("passed"), F.count("*").alias("total"), rate(flag).alias("rate"))


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """field, value, n of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return df.select(pairs).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def error_counts(df: DataFrame, errors: str) -> DataFrame:
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, key: str, n: int) -> DataFrame:
    """Largest counts first, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def linear(c: Column | str, p: float) -> Column:
    """Percentile between neighbours in proportion, of values few enough for one buffer; see ``percentiles``."""
    return F.percentile(c, F.lit(p))


def nearest(c: Column | str, p: float) -> Column:
    """The value of rank ceil(p n); 0 for no values. Of values few enough for one buffer; see ``percentiles``."""
    name = c if isinstance(c, str) else None
    if name is None:
        raise ValueError("nearest needs a column name")
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)"), F.lit(0))


def _double_key(df: DataFrame, c: str) -> DataFrame:
    """``c`` (a double) as a long in the same order: its exponent and mantissa, or minus those. NaN is above all."""
    top = F.lit(float("inf"))
    size = F.abs(c)
    finite = F.when(size < top, size).otherwise(F.lit(0.0))
    out = df.withColumn("__a", finite).withColumn("__e", F.greatest(F.least(F.coalesce(F.floor(F.log2("__a")), F.lit(-1022)), F.lit(1023)), F.lit(-1022)))
    low, high = F.pow(F.lit(2.0), F.col("__e")), F.pow(F.lit(2.0), F.col("__e") + 1)
    # The logarithm may be off by one near a power of two.
    off = F.when(F.col("__a") >= high, 1).when((F.col("__a") < low) & (F.col("__e") > -1022), -1).otherwise(0)
    out = out.withColumn("__e", F.col("__e") + off)
    mantissa = ((F.col("__a") / F.pow(F.lit(2.0), F.col("__e")) - 1) * F.lit(2.0**52)).cast("long")
    whole = (F.col("__e") + 1023).cast("long") * F.lit(1 << 52) + mantissa
    key = F.when(F.isnan(c), F.lit((1 << 63) - 1)).when(size == top, F.lit(2047 << 52)).otherwise(whole)
    return out.withColumn("__key", F.when(F.col(c) < 0, -key).otherwise(key)).drop("__a", "__e")


def keyed(df: DataFrame, c: str, kind: DataType) -> DataFrame:
    """``df`` with ``__key``, a long whose order is that of the numbers in column ``c``, and which is theirs alone."""
    if isinstance(kind, IntegralType):
        return df.withColumn("__key", F.col(c).cast("long"))
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return df.withColumn("__key", (F.col(c) * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long"))
    if isinstance(kind, FloatType | DoubleType):
        return _double_key(df, c)
    raise ValueError(f"percentiles need numbers of up to 64 bits, not {kind.simpleString()}")


def _places(kind: str, p: float, n: Column) -> list[Column]:
    """Places (from 0) in the order of ``n`` values that a percentile is made from."""
    exact = (n - 1) * F.lit(p)
    if kind == "linear":
        return [F.floor(exact), F.ceil(exact)]
    if kind == "nearest":
        return [F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0))]
    if kind == "even":
        return [F.bround(exact).cast("long")]
    raise ValueError(f"no percentile of the kind {kind}")


def percentiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``groups`` and a column for each of ``wanted`` (name: kind and p): exact percentiles of the numbers in ``value``.

    Kinds: ``linear`` between neighbours in proportion, ``nearest`` the value of rank ceil(p n), ``even`` the value of
    index round((n - 1) p), halves to even. Nulls don't count; a group without numbers has null, and 0 for ``nearest``.
    Null is a group; without ``groups`` there is one row.

    No values are held: numbers become 64-bit keys of the same order, and each pass over the rows counts, for all
    groups and places at once, the next DIGIT bits of the keys that begin as the one looked for does. At most as many
    passes as the widest group has digits: one for whole numbers within a million of each other, four for doubles; fewer
    where each number looked for stands alone before.
    """
    from ..sources.sinks import checkpointed

    names = [f"g{i}" for i in range(len(groups))] or ["g0"]
    cols = [F.col(g).alias(n) for g, n in zip(groups, names, strict=False)] or [F.lit(0).alias("g0")]
    rows = keyed(df.select(*cols, F.col(value).alias("v")), "v", df.schema[value].dataType)
    sizes = checkpointed(rows.groupBy(*names).agg(F.count("v").alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high")))
    told = sizes.agg(F.bit_or(F.col("low").bitwiseXOR(F.col("high"))).alias("x"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("groups")).first()
    top = ((told.x or 0) & ((1 << 64) - 1)).bit_length()
    shifts = [*range(max(top - DIGIT, 0), 0, -DIGIT), 0]

    places = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(i).alias("i"), at.alias("at")) for name, (kind, p) in wanted.items() for i, at in enumerate(_places(kind, p, F.col("n")))])
    state = sizes.where("n > 0").select(*names, "n", F.explode(places).alias("x")).select(*names, "n", "x.*", F.lit(0).cast("long").alias("prefix"))
    before = 0
    for shift in shifts:
        first = shift == shifts[0]
        part = rows.where(F.col("__key").isNotNull()).withColumn("prefix", F.lit(0).cast("long") if first else F.shiftright("__key", before))
        if not first:
            part = _begin_alike(part, state, names, told.n, told.groups * 2 * len(wanted) <= WANTED_ROWS)
        counts = part.groupBy(*names, "prefix", F.shiftright("__key", shift).alias("digit")).agg(F.count("*").alias("c"), F.min("v").alias("v"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*names, "prefix").orderBy("digit"))  # two to the DIGIT rows at most
        counts = counts.withColumn("upto", upto).select(*[F.col(n).alias(f"c_{n}") for n in names], F.col("prefix").alias("c_prefix"), "digit", "c", "v", "most", "upto")
        same = F.col("prefix") == F.col("c_prefix")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"c_{n}"))
        met = state.join(counts, same).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
        state = checkpointed(met.select(*names, "n", "name", "i", (F.col("at") - F.col("upto") + F.col("c")).alias("at"), F.col("digit").alias("prefix"), F.col("v").alias("found"), (F.col("v") < F.col("most")).alias("open")))
        before = shift
        if not shift or state.where("open").isEmpty():
            break
    found = lambda name, i: F.max(F.when((F.col("name") == name) & (F.col("i") == i), F.col("found")))
    out = []
    for name, (kind, p) in wanted.items():
        one = found(name, 0)
        if kind == "linear":
            exact = (F.max("n") - 1) * F.lit(p)
            lower, upper = F.floor(exact), F.ceil(exact)
            a, b = one.cast("double"), found(name, 1).cast("double")
            one = F.when((lower == upper) | (a == b), a).otherwise((upper - exact) * a + (exact - lower) * b)
        out.append(one.alias(name))
    values = state.groupBy(*names).agg(*out) if out else state.select(*names).distinct()
    values = values.select(*[F.col(n).alias(f"c_{n}") for n in names], *wanted)
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"c_{n}"))
    shown = [F.coalesce(name, F.lit(0)).alias(name) if kind == "nearest" else F.col(name) for name, (kind, _) in wanted.items()]
    if not groups:
        whole = df.sparkSession.range(1).select(F.lit(0).alias("g0"))  # a row for an empty table, too
        return whole.join(values, same, "left").select(*shown)
    return sizes.select(*names).join(values, same, "left").select(*[F.col(n).alias(g) for n, g in zip(names, groups, strict=True)], *shown)


def _begin_alike(part: DataFrame, state: DataFrame, names: list[str], rows: int, few: bool) -> DataFrame:
    """The rows whose key begins as one that is looked for in their group does."""
    on = [*names, "prefix"]
    prefixes = state.select(*on, "n").distinct().withColumnsRenamed({c: f"w_{c}" for c in [*on, "n"]})

    def met(left: DataFrame, right: DataFrame, keys: list[str] = on, how: str = "left_semi") -> DataFrame:
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        return left.join(right, same, how)

    if few:  # WANTED_ROWS at most
        return met(part, F.broadcast(prefixes))
    large = prefixes.where(F.col("w_n") > F.lit(rows * LARGE_SHARE))  # of 1 / LARGE_SHARE groups at most
    others = met(part, F.broadcast(large.select(*[f"w_{n}" for n in names]).distinct()), names, "left_anti")
    return met(part, F.broadcast(large)).unionByName(met(others, prefixes.where(F.col("w_n") <= F.lit(rows * LARGE_SHARE))))


def half_even(df: DataFrame, c: str, ps: tuple[float, ...]) -> DataFrame:
    """p, value: the value of index round((n - 1) p), halves to even, from counts of equal values.

    Running counts over ranges of the distinct values stand in for the sorted list; only
    the ranges' totals are brought together.
    """
    from ..sources.sinks import checkpointed

    sizes = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    ranged = checkpointed(sizes.repartitionByRange(c).withColumn("part", F.spark_partition_id()))
    before = F.sum("m").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranged.join(F.broadcast(offsets), "part").withColumn("upto", F.sum("n").over(w) + F.col("before"))
    total = df.agg(F.count(c).alias("total"))
    wanted = total.select("total", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")).withColumn("at", F.bround((F.col("total") - 1) * F.col("p")))
    met = upto.join(F.broadcast(wanted), (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
    return met.select("p", F.col(c).alias("value"))


def summary(c: str, limits: tuple[float, ...] = ()) -> list[Column]:
    """Count, least, largest, mean, and for each limit how many exceed it and their share."""
    out = [F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("largest"), F.avg(c).alias("mean")]
    for x in limits:
        out += [F.count_if(F.col(c) > x).alias(f"over_{x:g}"), (F.count_if(F.col(c) > x) / F.count(c)).alias(f"share_over_{x:g}")]
    return out


def rollup_summary(df: DataFrame, outer: str, inner: str, *aggregates: Column) -> DataFrame:
    """Aggregates for each ``outer`` group as a whole and by ``inner``; inner is null for the whole."""
    return df.groupingSets([[F.col(outer)], [F.col(outer), F.col(inner)]], F.col(outer), F.col(inner)).agg(*aggregates)


def transitions(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """How many rows went from pass or fail to pass or fail."""
    word = lambda c: F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail")
    return df.groupBy(F.concat(word(before), F.lit("_to_"), word(after)).alias("transition")).agg(F.count("*").alias("n"))


def paired_deltas(runs: DataFrame, run: str, case: str, value: str) -> DataFrame:
    """left_run, right_run, n, delta: mean difference of each two runs over the cases.

    Runs have each case once. Each case's values are joined to each other, so the work is
    cases times pairs of runs.
    """
    l = runs.select(F.col(run).alias("left_run"), F.col(case).alias("case"), F.col(value).cast("double").alias("l"))
    r = runs.select(F.col(run).alias("right_run"), F.col(case).alias("case"), F.col(value).cast("double").alias("r"))
    return l.join(r, "case").where("left_run < right_run").groupBy("left_run", "right_run").agg(F.count("*").alias("n"), F.avg(F.col("r") - F.col("l")).alias("delta"))


def same_cases(runs: DataFrame, run: str, case: str) -> None:
    """Raises ValueError unless all runs have the same cases, each once."""
    n = runs.select(run).distinct().count()
    bad = runs.groupBy(case).agg(F.count("*").alias("n"), F.count_distinct(run).alias("d")).where((F.col("n") != n) | (F.col("d") != n))
    if not bad.isEmpty():
        raise ValueError("runs differ in their cases")


def bootstrap_exact(df: DataFrame, group: str, value: str, order: str, resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Mean and percentile interval by resampling with the standard library's generator.

    The values are taken in ``order``, ties by value, so partitions don't matter. A group's
    values are one task's: for the sizes at which this is run, a few thousand; tables of any
    size go through ``bootstrap_hashed``.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["__order", "v"])["v"].tolist()
        rng, n = random.Random(seed), len(v)
        means = sorted(sum(v[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
        at = lambda p: _between(means, p)
        tail = (1 - confidence) / 2
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [sum(v) / n], "low": [at(tail)], "high": [at(1 - tail)]})

    kind = df.schema[group].dataType.simpleString()
    src = df.select(group, F.col(value).cast("double").alias("v"), F.col(order).alias("__order"))
    return src.groupBy(group).applyInPandas(one, f"`{group}` {kind}, mean double, low double, high double")


def _between(ordered: list[float], p: float) -> float:
    at = (len(ordered) - 1) * p
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


#: Modulus of the bootstrap's draws.
PRIME = (1 << 61) - 1
#: Cumulative Poisson probabilities of mean 1.
POISSON = ("0.36787944117", "0.73575888234", "0.91969860293", "0.98101184312", "0.99634015317", "0.99940581518", "0.99991675885", "0.99998975081")


def poisson_limits() -> list[int]:
    """The probabilities as whole numbers below PRIME, rounded down."""
    return [int(x[2:]) * PRIME // 10 ** len(x[2:]) for x in POISSON]


def times_mod_prime(a: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(a * r + c) modulo PRIME, of numbers below it: products are made of halves of 31 bits, and 2 ** 61 counts as 1."""
    low, u = np.uint64((1 << 31) - 1), np.uint64
    a1, a0, r1, r0 = a >> u(31), a & low, r >> u(31), r & low
    mid = a1 * r0 + a0 * r1
    x = (a1 * r1 << u(1)) + (mid >> u(30)) + ((mid & u((1 << 30) - 1)) << u(31)) + a0 * r0
    x = (x & u(PRIME)) + (x >> u(61)) + c
    x = (x & u(PRIME)) + (x >> u(61))
    return np.where(x >= u(PRIME), x - u(PRIME), x)


def bootstrap_hashed(df: DataFrame, key: str, value: str, resamples: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """Poisson bootstrap for tables of any size: each row counts 0, 1, 2, ... times in a resample.

    A row's number (60 bits) comes from a hash of (seed, key), once; the resample's line over it modulo a prime, whose
    slope and offset are hashed too, is the draw. A task adds the rows of its Arrow batches to two numbers for each
    resample, so no row is repeated and ``resamples`` rows a task are all that is shuffled. Rows without a value or a key
    aren't drawn.
    """
    lines = df.sparkSession.range(resamples).orderBy("id").select(share(F.lit(seed), F.lit("a"), "id").alias("a"), share(F.lit(seed), F.lit("c"), "id").alias("c")).collect()  # a line for each resample
    slope, offset = np.array([r.a + 1 for r in lines], np.uint64), np.array([r.c for r in lines], np.uint64)
    limits = np.array(poisson_limits(), np.uint64)
    step = max(1, (1 << 18) // max(resamples, 1))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times = np.zeros(resamples), np.zeros(resamples, np.int64)
        for batch in batches:
            r, v = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(r), step):
                x = times_mod_prime(slope[None, :], r[at : at + step, None], offset[None, :])
                t = np.searchsorted(limits, x, "right")
                total += v[at : at + step] @ t
                times += t.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(times)], names=["b", "total", "times"])

    rows = df.select(share(F.lit(seed), key).alias("r"), F.col(value).cast("double").alias("v")).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    means = rows.mapInArrow(drawn, "b long, total double, times long").groupBy("b").agg((F.sum("total") / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    tail = (1 - confidence) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.count("*").alias("resamples"))


def active_telemetry(df: DataFrame, device: Column, use: str, *peaks: str) -> DataFrame:
    """Mean use over samples with any, over all samples if none has; and peaks."""
    active = F.avg(F.when(F.col(use) > 0, F.col(use)))
    return df.groupBy(device.alias("device")).agg(F.coalesce(active, F.avg(use)).alias("mean_use"), F.count("*").alias("samples"), *[F.max(p).alias(f"peak_{p}") for p in peaks])


def steady_latency(df: DataFrame, run: str, order: str, seconds: str, tokens: str) -> DataFrame:
    """Calls, percentiles and tokens a second, over all calls and without each run's first."""
    first = df.groupBy(run).agg(F.min(order).alias("__first"))
    s = df.join(first, run).withColumn("__later", F.col(order) > F.col("__first")).withColumn("__steady", F.when(F.col("__later"), F.col(seconds)))
    ranks = percentiles(df.where(F.col(run).isNotNull()), [run], seconds, {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    means = s.groupBy(run).agg(F.count("*").alias("calls"), F.avg("__steady").alias("steady_mean"), (F.sum(F.when(F.col("__later"), F.col(tokens))) / F.sum("__steady")).alias("steady_tokens_per_second"))
    return means.join(ranks, run).select(run, "calls", "p50", "p95", "steady_mean", "steady_tokens_per_second")
