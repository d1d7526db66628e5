"""Groups of one size dealt out together, against one step for each."""

import random

from pyspark.sql import functions as F

from curatrix.operators import selection
from curatrix.sources import sinks


def walk(size, many, lacking):
    """One group after the other, each to the split whose deviation it lessens most."""
    turns = []
    for _ in range(many):
        change = [abs(x - size) - abs(x) for x in lacking]
        i = change.index(min(change))
        lacking[i] -= size
        turns.append(i)
    return turns


def test_dealing_is_the_walk():
    rng = random.Random(1)
    for _ in range(3000):
        size, many = rng.randint(1, 9), rng.randint(0, 25)
        lacking = [rng.randint(-20, 60) for _ in range(rng.randint(1, 4))]
        one, all_ = lacking[:], lacking[:]
        want = walk(size, many, one)
        got = selection.dealt(size, many, all_)
        assert [i for i, n in got for _ in range(n)] == want and all_ == one and len(got) <= 2 * len(lacking) + 1


def test_any_number_of_groups_takes_as_few_steps():
    n = 10**9
    assert selection.dealt(10, n, [8 * n, n, n]) == [(0, 8 * n // 10), (1, n // 10), (2, n // 10)]


def test_hot_contents_are_one_entry(spark):
    df = spark.range(1000).select(F.sha2(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")), 256).alias("h"))
    got = [sinks.content_set_hash(d, F.col("h")).first() for d in (df, df.repartition(7))]
    assert got[0] == got[1] and got[0].n_rows == 1000
    other = sinks.content_set_hash(df.unionByName(df.where("h = sha2('hot', 256)").limit(1)), F.col("h")).first()
    assert other.content_set_sha256 != got[0].content_set_sha256 and other.n_rows == 1001
    assert sinks.content_set_hash(df.limit(0), F.col("h")).first().n_rows == 0


def test_all_buckets_are_settled_together(spark):
    """A chain of buckets that take each other's parents."""
    buckets = [f"b{i}" for i in range(9)]
    rows = [(i * 10 + j, b, f"p{(i + j) % 4}", float(j)) for i, b in enumerate(buckets) for j in range(8)]
    targets = {b: 2 for b in buckets[:8]}
    df = spark.createDataFrame(rows, "id long, b string, p string, m double")
    used, want = {}, set()
    for b in sorted(targets):
        n = 0
        for i, _, p, _ in sorted((r for r in rows if r[1] == b), key=lambda r: (r[3], r[0])):
            if n < 2 and used.get(p, 0) < 5:
                used[p] = used.get(p, 0) + 1
                n += 1
                want.add(i)
    assert {r.id for r in selection.capped_selection(df, "b", targets, "m", "p", 5, "id").collect()} == want
