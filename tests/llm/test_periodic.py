"""Runs of words against a check of every stretch and every period."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from awkward_rows import AWKWARD
from curatrix.llm import periodic, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def smallest(words):
    """The smallest period of a whole sequence."""
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        a = 0
        while a < n - q:
            b = a
            while b < n - q and words[b] == words[b + q]:
                b += 1
            if b > a and b - a + q >= max(6, 4 * q) and smallest(words[a : b + q]) == q:
                out.add((a, b - a + q, q))
            a = b + 1
    return sorted(out)


def brute_kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def brute_words(doc_id, text):
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def contract(doc_id, text):
    words = brute_words(doc_id, text)
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(brute_kept(words, found))))


def runs_of(words):
    numbers = np.array(words, np.int64)
    counts, _ = periodic.lag_counts(numbers, np.array([0, len(numbers)]))
    return periodic.runs(numbers, counts)


def repetitive(rng, n):
    """Words of which many repeat with nested and neighbouring periods."""
    out = []
    while len(out) < n:
        block = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 9))]
        out += block * rng.choice([1, 1, 3, 4, 5, 9]) + block[: rng.randint(0, len(block))]
    return out[:n]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_few_words(words):
    assert runs_of(words) == brute_runs(words)


def test_runs_of_repetitive_words():
    rng = random.Random(5)
    for _ in range(300):
        words = repetitive(rng, rng.randint(0, 120))
        assert runs_of(words) == brute_runs(words)


@pytest.mark.parametrize("cost", [0, 1e9])
def test_counts_are_exact_by_either_way(cost, monkeypatch):
    """All words by autocorrelation, and none."""
    monkeypatch.setattr(periodic, "FFT_COST", cost)
    rng = np.random.default_rng(3)
    n = [0, 3, 5, 6, 7, 400, 1, 900]
    words = np.concatenate([rng.zipf(1.4, k) % 50 for k in n])
    first = np.concatenate([[0], np.cumsum(n)])
    got, base = periodic.lag_counts(words, first)
    for d, k in enumerate(n):
        w = words[first[d] : first[d + 1]]
        want = [int((w[:-q] == w[q:]).sum()) for q in range(1, k // 4 + 1)] if k >= 6 else []
        assert got[base[d] : base[d + 1]].tolist() == want


def test_long_texts_of_one_word_and_of_frequent_words_take_little_time():
    began = time.perf_counter()
    n = 300_000
    assert runs_of([7] * n) == [(0, n, 1)]
    rng = np.random.default_rng(1)
    words = rng.zipf(1.3, n) % 1000
    words[1000:9000] = np.tile(words[1000:1800], 10)
    assert (1000, 8000, 800) in [(s, m, q) for s, m, q in runs_of(words) if q == 800] or any(s <= 1000 and s + m >= 9000 and q == 800 for s, m, q in runs_of(words))
    assert time.perf_counter() - began < 30


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    """A hash that knows lengths only."""
    monkeypatch.setattr(periodic.common, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    import pyarrow as pa

    words = "aa bb aa bb aa bb aa bb cc dd aa".split()
    n, found, text = periodic._work(None)(pa.array([" ".join(words)]))
    assert [(x["start"], x["length"], x["period"]) for x in found.to_pylist()[0]] == brute_runs(words) == [(0, 8, 2)]
    assert text.to_pylist() == ["aa bb cc dd aa"]


def documents():
    rng = random.Random(8)
    docs = [(i, t) for i, t in AWKWARD if t is None or len(t) < 20_000]
    docs += [(1000 + i, " ".join(f"w{x}" for x in repetitive(rng, rng.randint(0, 90)))) for i in range(120)]
    docs += [(2000 + i, " \n".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 150)))) for i in range(120)]
    return docs


def test_query_against_brute_force(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.columns == names and [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((contract(i, t) for i, t in docs), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs) > 10


def test_awkward_rows_and_columns(spark, awkward, empty):
    got = periodic.collapsed(awkward).select("doc_id", "n_words", F.to_json("runs").alias("r"), "collapsed").collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[2].n_words, by_id[2].r, by_id[2].collapsed) == (0, "[]", "") == (by_id[4].n_words, by_id[4].r, by_id[4].collapsed)
    assert periodic.collapsed(empty).collect() == []


def test_ties_go_to_the_earlier_run(spark):
    text = "a b a b a b a b x c d c d c d c d"
    row = periodic.collapsed(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(periodic.strongest(F.col("runs")).alias("b")).first()
    assert tuple(row.b) == (0, 8, 2)
