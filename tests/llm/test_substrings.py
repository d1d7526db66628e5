import random
import re

import pytest

from curatrix.llm import substrings

from awkward_rows import AWKWARD


def brute(rows, window=50):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for a in range(len(w) - window + 1) if i is not None else ():
            x = tuple(w[a : a + window])
            least[x] = min(least.get(x, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out.append((i or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, b int")
    got = substrings.without_repeats(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)
    for r in got:
        assert sum(s.to - s["from"] for s in r.removed) == r.n_removed


@pytest.mark.parametrize("alphabet", [2, 5, 400])
def test_shared_passages(spark, alphabet):
    rng = random.Random(alphabet)
    word = lambda: f"é{rng.randrange(alphabet)}"
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 80, 200]))] for _ in range(5)] + [["a"] * 120, ["a", "b"] * 60]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w += p[a:] + [word() for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice([i, i, i - 1]), rng.choice([" ", "\n", "\t "]).join(w)))
    check(spark, rows)


@pytest.mark.parametrize(("fan", "held"), [(2, 40), (3, 1 << 20)])
def test_windows_that_meet_in_steps(spark, monkeypatch, fan, held):
    monkeypatch.setattr(substrings, "FAN", fan)
    monkeypatch.setattr(substrings, "HELD_NAMES", held)
    rng = random.Random(fan)
    hot = [f"h{rng.randrange(40)}" for _ in range(90)]  # in most documents, whole or in part
    rows = []
    for i in range(60):
        a, b = rng.randint(0, 20), rng.randint(60, 90)
        rows.append((rng.randrange(10**9), " ".join([f"x{i}"] * rng.randint(0, 3) + hot[a:b] + [f"y{i}"] * rng.randint(0, 60))))
    check(spark, rows)


def test_long_symbols_are_the_same_in_long_repeats(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    core = [word() for _ in range(3000)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 90))] + core + [word() for _ in range(rng.randint(0, 90))]) for _ in range(4)] + [" ".join(core)]
    w = substrings.Windows(substrings.Words(pa.array(texts)), 50)
    by_doc = [set(w.long_name[w.long_doc == i].tolist()) for i in range(5)]
    shared = set.intersection(*by_doc)
    assert len(shared) >= 10 and int((w.long_to - w.long_from).max()) > 150
    assert min(w.long_name) >= substrings.LONG > max(w.anchor)
    chosen = np.isin(w.long_name, list(shared))
    settled = w.within(chosen)
    assert all(any(a <= at and at + 50 <= b for a, b in zip(w.long_from[chosen], w.long_to[chosen], strict=True)) == s for at, s in list(zip(w.at.tolist(), settled.tolist(), strict=True))[::97])
    assert settled.mean() > 0.4
    check(spark, [(7 - i, t) for i, t in enumerate(texts)] + [(9, " ".join(core[100:2500])), (1, " ".join(core[1500:]))])


def test_names_of_many_buckets_are_dealt_in_the_time_of_what_there_is():
    import numpy as np

    bucket = np.array([10**9, 5, 10**9, 0, 5])
    assert [(b, r.tolist()) for b, r in substrings._by_bucket(bucket)] == [(0, [3]), (5, [1, 4]), (10**9, [0, 2])]
    assert list(substrings._by_bucket(bucket[:0])) == []


def test_awkward_rows(spark, empty):
    check(spark, [*AWKWARD, (0, AWKWARD[9][1]), (None, AWKWARD[9][1])])
    assert substrings.without_repeats(empty).count() == 0


def test_interior_symbols_do_not_depend_on_what_surrounds_them():
    import pyarrow as pa

    rng = random.Random(0)
    core = [f"w{rng.randrange(30)}" for _ in range(50)]
    found = []
    for k in range(30):
        around = lambda: [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 60))]  # noqa: E731, B023
        left = around()
        w = substrings.Windows(substrings.Words(pa.array([" ".join(left + core + around())])), 50)
        found.append(int(w.anchor[len(left)]))
    assert len(set(found)) == 1
