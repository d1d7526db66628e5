"""Exact percentiles by narrowing keys, and the bootstrap's draws."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import metrics

WANTED = {"a": ("linear", 0.5), "b": ("linear", 0.95), "c": ("nearest", 0.5), "d": ("nearest", 0.99), "e": ("even", 0.5), "f": ("nearest", 0.0), "g": ("linear", 1.0)}


def plain(values, kind, p):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return 0 if kind == "nearest" else None
    at = (len(v) - 1) * p
    if kind == "nearest":
        return v[max(math.ceil(len(v) * p) - 1, 0)]
    if kind == "even":
        return v[round(at)]
    low, high = math.floor(at), math.ceil(at)
    return v[low] if low == high or v[low] == v[high] else (high - at) * v[low] + (at - low) * v[high]


def same(x, y):
    return x is y is None or x == y or (x != x and y != y)


def check(spark, rows, kind, groups=("grp",)):
    df = spark.createDataFrame(rows, f"grp string, v {kind}").repartition(3)
    got = {r.grp: r for r in metrics.percentiles(df, list(groups), "v", WANTED).collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, values in by.items():
        for name, (how, p) in WANTED.items():
            want = plain([None if v is None else float(v) for v in values], how, p)
            assert same(None if got[g][name] is None else float(got[g][name]), want), (g, name, got[g][name], want)


@pytest.mark.parametrize("digit", [7, 16])
def test_whole_numbers_and_doubles_of_any_size(spark, monkeypatch, digit):
    monkeypatch.setattr(metrics, "DIGIT", digit)
    rng = random.Random(digit)
    ints = [(rng.choice(["x", "y", None]), rng.choice([None, rng.randint(-9, 9), rng.randint(-(1 << 30), 1 << 30)])) for _ in range(400)]
    check(spark, [*ints, ("none", None), ("one", 5)], "long")
    if digit == 16:
        odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1.0, math.nextafter(1, 0), math.nextafter(2, 0), 2.0]
        made = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(150)]
        check(spark, [(rng.choice("xy"), v) for v in [*odd, *odd, *made]], "double")


def test_keys_have_the_order_of_doubles(spark):
    rng = random.Random(1)
    bits = [rng.getrandbits(64) for _ in range(4000)] + [(e << 52) + d for e in range(0, 2047, 7) for d in (0, 1, (1 << 52) - 1)]
    values = sorted({v for v in (struct.unpack("<d", struct.pack("<Q", b))[0] for b in bits) if not math.isnan(v)})
    df = metrics.keyed(spark.createDataFrame([(v,) for v in values], "v double"), "v", spark.createDataFrame([], "v double").schema["v"].dataType)
    keys = [r["__key"] for r in df.orderBy("v").collect()]
    assert keys == sorted(set(keys)) and len(keys) == len(values)


def test_many_groups_meet_their_places_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(metrics, "WANTED_ROWS", 3)
    monkeypatch.setattr(metrics, "LARGE_SHARE", 0.2)
    monkeypatch.setattr(metrics, "DIGIT", 4)
    rng = random.Random(2)
    check(spark, [("hot" if i % 3 == 0 else f"g{i % 40}", rng.randint(0, 5000)) for i in range(600)], "int")


def test_no_groups_no_rows_and_decimals(spark):
    df = spark.createDataFrame([(1,), (2,), (10,)], "v int").select((F.col("v") / 4).cast("decimal(9,2)").alias("v"))
    r = metrics.percentiles(df, [], "v", WANTED).first()
    assert (float(r.a), float(r.c), float(r.e), float(r.g)) == (0.5, 0.5, 0.5, 2.5)
    assert [tuple(x) for x in metrics.percentiles(df.limit(0), [], "v", {"a": ("linear", 0.5), "b": ("nearest", 0.5)}).collect()] == [(None, 0)]
    assert metrics.percentiles(df.withColumn("k", F.lit(1)).limit(0), ["k"], "v", WANTED).count() == 0
    with pytest.raises(ValueError):
        metrics.percentiles(spark.createDataFrame([("x",)], "v string"), [], "v", WANTED)


def test_draws_are_exact_modulo_the_prime():
    rng = random.Random(3)
    top = metrics.PRIME - 1
    a, r, c = ([rng.choice([0, 1, top, rng.randrange(top)]) for _ in range(3000)] for _ in range(3))
    got = metrics.times_mod_prime(*(np.array(x, np.uint64) for x in (a, r, c)))
    assert got.tolist() == [(x * y + z) % metrics.PRIME for x, y, z in zip(a, r, c, strict=True)]


def test_bootstrap_counts_every_row_as_its_draws_say(spark):
    import hashlib

    number = lambda *p: int(hashlib.sha256(":".join(map(str, p)).encode()).hexdigest()[:15], 16)
    rows = [(i, float(i % 7)) for i in range(150)]
    limits = metrics.poisson_limits()
    means = []
    for b in range(30):
        t = [sum((((number("s", "a", b) + 1) * number("s", i) + number("s", "c", b)) % metrics.PRIME) >= x for x in limits) for i, _ in rows]
        means.append(sum(x * v for x, (_, v) in zip(t, rows, strict=True)) / sum(t))
    means.sort()
    got = metrics.bootstrap_hashed(spark.createDataFrame(rows, "id int, v double").repartition(3), "id", "v", 30, "s").first()
    assert got.low == pytest.approx(plain(means, "linear", 0.025)) and got.high == pytest.approx(plain(means, "linear", 0.975)) and got.resamples == 30
    none = metrics.bootstrap_hashed(spark.createDataFrame([(1, None), (None, 2.0)], "id int, v double"), "id", "v", 5, "s").first()
    assert (none.low, none.high) == (None, None)
