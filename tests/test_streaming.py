"""Requests in event time against the replay of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import policy
from curatrix.streaming import requests


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, requests.STATE_STORE)
    yield
    spark.conf.set(key, before)


def told(spark, df, files, tmp_path, name, **options):
    """The outcomes of a stream over files that come one after the other."""
    for n, part in enumerate(files):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in/{n:03}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
    out = requests.ordered_outcomes(stream, "user", "at", "id", "ok", **options)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name).collect()


def test_shuffled_requests_give_the_batch_result(spark, store, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcd"), rng.randrange(40), rng.random() < 0.4) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, user string, minute int, ok boolean").select("id", "user", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("minute"))).alias("at"), "ok")
    want = {(r.user, r.id): r.outcome for r in policy.replay_requests(df.withColumn("o", F.col("user")), "o", "at", F.col("ok"), F.lit("refund")).collect()}
    held = df.collect()
    rng.shuffle(held)
    # Later requests of another user move the watermark past all others; theirs alone are still waiting.
    end = [[(1000 + k, "z", held[0].at.replace(day=3 + k), True)] for k in range(2)]
    rows = told(spark, df, [held[:20], held[20:40], held[40:], *end], tmp_path, "shuffled", delay="1 day")
    assert {(r.user, int(r.row)): r.outcome for r in rows if r.user != "z"} == want and len({o for o in want.values()}) == 3
    assert all(a.at <= b.at for u in "abcd" for a, b in zip([r for r in rows if r.user == u], [r for r in rows if r.user == u][1:]))


def test_keys_are_forgotten_and_late_rows_dropped(spark, store, tmp_path):
    df = spark.sql("select 1L as id, 'a' as user, timestamp'2024-01-01' as at, true as ok")
    day = lambda n: df.first().at.replace(day=n)
    files = [[(1, "a", day(1), True)], [(2, "b", day(5), True)], [(3, "b", day(9), False)], [(4, "a", day(2), True)], [(5, "a", day(12), True)], [(6, "b", day(20), True)], [(7, "b", day(25), True)]]
    got = {int(r.row): r.outcome for r in told(spark, df, files, tmp_path, "forgotten", delay="1 hour", keep="4 days")}
    assert 4 not in got  # later than the watermark
    assert got[1] == "OK" and got[5] == "OK" and got[2] == "OK"  # the flag of "a" is gone by day 12
    assert got[3] == "DUPLICATE_REQUEST"
