"""Languages of held-out documents, and the filter against plain sets."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from awkward_rows import AWKWARD
from curatrix.llm import classify, language, queries

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    """All grams of a text, repeats included, by walking over it."""
    flat = " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        flat += "" if c == " " and flat[-1] == " " else c
    flat += "" if flat[-1] == " " else " "
    return [flat[i : i + k] for k in language.SIZES for i in range(len(flat) - k + 1) if " " not in flat[i + 1 : i + k - 1]]


def named(text):
    name, owner, _ = language.grams(pa.array([text]))
    assert not owner.any()
    return name


def test_grams_are_those_of_a_plain_walk():
    rng = random.Random(3)
    texts = ["", " ", "a", "ab c", "Été, İx 12 ﬁ\x00日本", "x" * 9] + ["".join(rng.choice("abcé .1") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    name, owner, some = language.grams(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        want = plain_grams(t)
        got = name[owner == i]
        assert len(got) == len(want)
        for g, h in zip(want, got.tolist(), strict=True):
            assert seen.setdefault(g, h) == h
        assert some[i] == any(c.isalpha() for c in t)
    assert len(set(seen.values())) == len(seen)


def model_of(sets):
    """A filter with the grams of words of each language, as plain sets say."""
    rows = 1 << 12
    bits = np.zeros((rows, 1 + (len(sets) - 1) // 64), np.uint64)
    for i, words in enumerate(sets.values()):
        for r in language.places(named(" ".join(words)), rows):
            bits[r, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    return language.LanguageFilters(list(sets), [1] * len(sets), bits)


def test_filter_answers_with_all_languages_of_a_gram_and_few_others():
    rng = random.Random(4)
    words = lambda: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)]
    sets = {f"l{i}": words() for i in range(70)}  # more than a word of bits
    model = model_of(sets)
    for lang, some in sets.items():
        best, score, most = model.scores(pa.array([" ".join(some), "", "12 !"]))
        assert sets[model.languages[best[0]]] == sets[lang]
        assert 0 < score[0] <= 1 and most[0] >= len(named(" ".join(some))) - 1e-6
        assert best[1:].tolist() == [-1, -1] and score[1:].tolist() == [0, 0]


def test_counts_are_corrected_for_full_filters():
    """A language whose filter is fuller claims more grams by chance, but doesn't win by that."""
    rng = np.random.default_rng(5)
    bits = np.zeros((1 << 12, 1), np.uint8)
    bits[rng.random(len(bits)) < 0.9, 0] |= 1
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(400)]
    for r in language.places(named(" ".join(words[:100])), len(bits)):
        bits[r, 0] |= 2
    model = language.LanguageFilters(["full", "true"], [9, 1], bits)
    text = " ".join(words)  # a quarter of it is "true"; 0.73 of all grams are in "full" by chance
    best, *_ = model.scores(pa.array([text]))
    assert model.languages[best[0]] == "true"


def test_held_out_documents(spark):
    out = queries.op11_language_id(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = out.collect()
    assert len(rows) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(true[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


def test_held_out_labels_and_other_columns_are_no_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    held = classify.fold(F.col("doc_id"), 4) == 2
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    other.write.parquet(f"{tmp_path}/b/documents.parquet")
    got = [sorted(map(tuple, queries.op11_language_id(spark, f"{tmp_path}/{x}").collect())) for x in "ab"]
    assert got[0] == got[1]


@pytest.mark.parametrize("known", [True, False])
def test_awkward_rows(spark, awkward, empty, known):
    docs = awkward.withColumn("lang", F.when(F.lit(known) & (F.col("doc_id") != 7), "en"))
    model = language.fit(docs, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in language.predicted(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    for i, t in AWKWARD:
        assert (i, "en" if known and t and any(c.isalpha() for c in t) else "und") in got
    assert language.predicted(empty, model, {"doc_id": F.col("doc_id")}).collect() == []
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predicted(docs, nothing, {}).collect()} == {"und"}


def test_sample_is_bounded_and_the_same_for_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGE_ROWS", 20)
    monkeypatch.setattr(language, "SAMPLE_ROWS", 30)
    rows = [(i, f"text {i}", "a" if i % 10 else "b") for i in range(400)] + [(None, "x", "a"), (5, "other", "a"), (6, "x", None)]
    got = []
    for n in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
        got.append(sorted(map(tuple, language.sample(df, F.lit(True), "doc_id", "text", "lang").collect())))
    assert got[0] == got[1] and len(got[0]) == 30 and sum(x == "b" for x, _ in got[0]) == 15
