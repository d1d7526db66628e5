import random
import re

import pytest
from pyspark.sql import functions as F

from curatrix.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items, window=13):
    out = []
    for i, t in docs:
        w = words(t)
        hit, names = set(), set()
        for k, u in items:
            v = words(u)
            m = min(window, len(v))
            for j in range(len(v) - m + 1) if v else ():
                for a in range(len(w) - m + 1):
                    if w[a : a + m] == v[j : j + m]:
                        hit |= set(range(a, a + m))
                        names.add(str(k)) if k is not None else None
        out.append((i or 0, len(w), len(hit), sorted(names)))
    return sorted(out)


def random_case(rng, alphabet):
    items = [(k, " ".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 6, 7, 12, 13, 14, 30])))) for k in range(8)] + [(None, "x y z"), (50, None), (51, "...")]
    docs = []
    for i in range(25):
        w = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            v = rng.choice(items)[1] or ""
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.3 else x for x in v.split()]
        docs.append((i, ", ".join(w)))
    return docs + [(None, "x, y, z"), (3, docs[3][1]), (98, None), (99, "")], items


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, w int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got) == brute(docs, items)
    for r in got:
        assert sum(s.b - s.a + 1 for s in r.spans) == r.n_hit and all(x.b + 1 < y.a for x, y in zip(r.spans, r.spans[1:]))


def test_small_alphabets_with_repeats_and_short_items(spark):
    check(spark, *random_case(random.Random(1), ["a", "b"]))


def test_usual_words(spark):
    check(spark, *random_case(random.Random(2), [f"w{i}" for i in range(300)] + ["É", "日本"]))


def test_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    check(spark, *random_case(random.Random(4), ["a", "b", "c"]))


def test_empty_tables_and_cleaning(spark, awkward, empty):
    items = spark.createDataFrame([(1, "plain words stand here and here")], "item_id long, text string")
    assert decontaminate.contaminated(empty, items).count() == 0
    assert {r.n_hit for r in decontaminate.contaminated(awkward, items.limit(0)).collect()} == {0}
    kept = decontaminate.clean(awkward, items)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2, 3, 4, 7, 8, 9, 10]


@pytest.mark.parametrize("most", [0, 200_000])
def test_cleaning_keeps_columns_of_any_name(spark, awkward, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    items = spark.createDataFrame([(1, "plain words stand here and here")], "item_id long, text string")
    named = awkward.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("__id", "__Digest", "row", "digest", "doc", "p"))])
    kept = decontaminate.clean(named, items)
    assert kept.columns == named.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2, 3, 4, 7, 8, 9, 10]


@pytest.mark.parametrize("most", [0, 200_000])
def test_items_of_one_line_are_one_group(spark, monkeypatch, most):
    """What is broadcast doesn't grow with the items that share a line."""
    sent = []
    send = F.broadcast
    monkeypatch.setattr(decontaminate.F, "broadcast", lambda df: sent.append((df.columns, df.count())) or send(df))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    line = " ".join(f"word{i}" for i in range(20))
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(line).alias("text"))
    docs = spark.createDataFrame([(i, f"before {line} after {i}" if i % 2 else "clean words") for i in range(6)], "doc_id long, text string")
    want = sorted(map(str, range(20_000)))
    for r in decontaminate.contaminated(docs, items).collect():
        assert (r.n_hit, r["items"]) == ((20, want) if r.doc_id % 2 else (0, []))
    assert all("item" not in columns and n < 20 for columns, n in sent) and bool(sent) == bool(most)


def test_frequent_gram_with_many_surroundings_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(6)
    gram = "a b c d e f"
    around = lambda n: " ".join(rng.choice(["g", "h", "i"]) for _ in range(n))
    items = [(k, f"{around(rng.randint(0, 9))} {gram} {around(rng.randint(0, 9))}".strip()) for k in range(40)]
    docs = [(i, f"{around(rng.randint(0, 12))} {gram} {around(rng.randint(0, 12))}") for i in range(40)]
    check(spark, docs, items)
