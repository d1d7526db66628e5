"""Near copies by counts and places, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import audit, dedup, joins, near


def made_prints(rng, n, bases=2, flips=5):
    out = []
    for base in [rng.getrandbits(64) for _ in range(bases)]:
        for _ in range(n):
            p = base
            for _ in range(rng.randint(0, flips)):
                p ^= 1 << rng.randrange(64)
            out.append(p)
    return [*out, 0, 1, (1 << 64) - 1]


@pytest.fixture(params=[2000, 3])
def listed(request, monkeypatch):
    """Buckets compared pair by pair, and read off their places."""
    monkeypatch.setattr(near, "LISTED", request.param)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_counts_and_nearest(spark, listed, distance):
    rng = random.Random(distance)
    nodes = {}
    for p in made_prints(rng, 40):
        for s in rng.sample(["train", "test", "x"], rng.choice([1, 1, 2])):
            nodes[(p, s)] = (rng.randint(1, 4), len(nodes) + 7)
    df = spark.createDataFrame([(near._signed(p), s, w, i) for (p, s), (w, i) in nodes.items()], "fp long, split string, weight long, id long")
    want = {}
    for p in {p for p, _ in nodes}:
        for (q, s), (w, i) in nodes.items():
            d = (p ^ q).bit_count()
            if 1 <= d <= distance:
                n, ids = want.setdefault((near._signed(p), s), ([0, 0, 0], [[], [], []]))
                n[d - 1] += w
                ids[d - 1].append(i)
    rows = [r for r in near.near_counts(df, distance).collect() if r.n1 or r.n2 or r.n3]
    got = {(r.fp, r.split): (r.n1, r.n2, r.n3) for r in rows}
    assert got == {k: tuple(n) for k, (n, _) in want.items()}
    for r in rows:
        ids = want[(r.fp, r.split)][1]
        # Of three bits the id may be one of one bit, which is nearer and counts before.
        for d in range(distance):
            if d < 2 or not ids[0]:
                assert r.nearest[d] == (min(ids[d]) if ids[d] else None)


@pytest.mark.parametrize("distance", [0, 2, 3])
def test_rows_name_the_nearest_earlier_one(spark, listed, distance):
    rng = random.Random(10 + distance)
    prints = made_prints(rng, 25, flips=4)
    contents = [(f"h{k}", rng.choice(prints)) for k in range(70)]
    rows = []
    for i in range(160):
        h, p = rng.choice(contents)
        rows.append((i, h, near._signed(p), rng.choice(["a", "b", None])))
    df = spark.createDataFrame([*rows, (900, None, 1, "a"), (901, "x", None, "a")], "id long, hash string, fp long, split string").repartition(3)
    first = {}
    for i, h, p, s in sorted(rows, key=lambda r: r[0]):
        first.setdefault((h, p % (1 << 64), s or ""), i)
    want = {}
    for (h, p, s), i in first.items():
        for (k, q, t), j in first.items():
            d = (p ^ q).bit_count()
            if h != k and d <= distance:
                n, best = want.get((i, h, s, t), (0, None))
                if j < i:
                    best = min(x for x in (best, (d, j)) if x)
                want[(i, h, s, t)] = (n + 1, best)
    got = {(r.id, r.hash, r.split, r.other_split): (r.near, (r.bits, r.near_id) if r.near_id is not None else None) for r in near.near_rows(df, "id", "hash", "fp", "split", distance).collect()}
    assert got == want and any(b and b[0] == distance for _, b in want.values())


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_greedy_choice(spark, listed, distance):
    rng = random.Random(20 + distance)
    prints = [rng.choice(made_prints(rng, 30, flips=6)) for _ in range(20)] + made_prints(rng, 50, flips=6)
    rows = [(i, near._signed(p), rng.randrange(5)) for i, p in enumerate(prints)] + [(5000, None, 1), (5001, None, 0)]
    df = spark.createDataFrame(rows, "id long, fp long, p int").repartition(3)
    kept = []
    for i, p, _ in sorted(rows[:-2], key=lambda r: (r[2], r[0])):
        if all(((p ^ q) % (1 << 64)).bit_count() > distance for _, q in kept):
            kept.append((i, p))
    got = near.near_keep(df, "id", "fp", F.col("p"), distance)
    assert sorted(r.id for r in got.where("accepted").collect()) == sorted([i for i, _ in kept] + [5001])
    assert got.count() == len(rows) and got.columns == ["id", "fp", "p", "accepted"]
    assert near.near_keep(df.limit(0), "id", "fp", F.col("p"), distance).count() == 0


def test_greedy_pairs_are_listed_once_and_while_undecided(spark, monkeypatch):
    """In a chain of eight, each three bits from the next, rounds take one and reject the next; all pairs were read in both directions in each round."""
    written, plain = [], near.checkpointed

    def noted(df):
        out = plain(df)
        if out.columns == ["fp", "before"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(near, "checkpointed", noted)
    df = spark.createDataFrame([(i, (1 << 3 * i) - 1) for i in range(8)], "id long, fp long")
    assert sorted(r.id for r in near.near_keep(df, "id", "fp", F.lit(0)).where("accepted").collect()) == [0, 2, 4, 6]
    assert written == [7, 5, 3, 1, 0]


def test_findings_of_one_class_grow_with_its_rows(spark, monkeypatch):
    """A crowd within three bits of each other: pairs would be 19,900."""
    monkeypatch.setattr(near, "LISTED", 50)
    rows = [(i, f"h{i}", 1 << i % 50 if i % 4 else (1 << i % 50) | 1 << 60, "train" if i % 10 else "test") for i in range(200)]
    found = audit.near_findings(spark.createDataFrame(rows, "id long, hash string, fp long, split string"), 3).collect()
    assert len(found) <= 2 * len(rows) and {r.code for r in found} == {"near_duplicate", "near_duplicate_split_leakage"}
    by = {(int(r.key), r.code): r for r in found}
    for i, _, p, s in rows:
        for code, ok in (("near_duplicate", lambda t, s=s: t == s), ("near_duplicate_split_leakage", lambda t, s=s: t != s)):
            others = [((p ^ q).bit_count(), j) for j, _, q, t in rows if j != i and ok(t) and (p ^ q).bit_count() <= 3]
            earlier = [x for x in others if x[1] < i]
            assert ((i, code) in by) == bool(earlier)
            if earlier:
                r = by[(i, code)]
                assert r.near == len(others) and (r.bits, int(r.other)) == min(earlier)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_of_large_and_small_keys(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "LARGE_SHARE", 0.2)
    rows = [(i, None if i % 2 else i % 14) for i in range(100)] + [(200, 99)]
    df = spark.createDataFrame(rows, "i int, k int")
    facts = df.where("k is null or k <> 99").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    most = {k: max(i for i, q in rows if q == k) for _, k in rows}
    want = {(i, k, most[k] if k != 99 else None) for i, k in rows if how == "left" or k != 99}
    got = joins.met(df, facts, ["k"], "n", how)
    assert got.columns == ["i", "k", "most"] and {tuple(r) for r in got.collect()} == want


def test_exploded_fingerprints_meet_by_shuffle(spark, monkeypatch):
    """They look small to Spark, and would pass through the driver if one side were broadcast."""
    plans, plain = [], near.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    for module in (near, dedup):
        monkeypatch.setattr(module, "checkpointed", noted)
    prints = spark.range(50).select(F.xxhash64("id").alias("fp"))
    near._buckets(plain(prints), near._choices(near.MOST))
    dedup.spanning_links(plain(prints))
    met = [p for p in plans if "Generate" in p]
    assert len(met) == 2 and not any("Broadcast" in p for p in met)
