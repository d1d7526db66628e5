import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.llm import classify

SF = "/root/testdata/sf0.1"


def split(spark, column, n, out):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("text", column, classify.fold(F.col("doc_id"), n).alias("f")).orderBy("doc_id").collect()
    held, used = [r for r in rows if r.f == out], [r for r in rows if r.f != out]
    return used, held


@pytest.mark.parametrize(("kind", "column", "n", "out"), [(classify.FactorisationMachine, "quality", 3, 1), (classify.ConvolutionalClassifier, "toxic", 5, 0)])
def test_held_out_accuracy(spark, kind, column, n, out):
    used, held = split(spark, column, n, out)
    model = kind.fit(pa.array([r.text for r in used]), np.array([r[column] for r in used]))
    s, y = model.score(pa.array([r.text for r in held])), np.array([r[column] for r in held])
    assert ((s >= 0.5) == y).mean() > 0.97
    assert ((0 <= s) & (s <= 1)).all()


def area(score, y):
    """Share of pairs of a toxic and a clean text in which the toxic one scores higher."""
    rank = np.empty(len(y))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_training_beats_random_filters_and_counted_words(spark):
    used, held = split(spark, "toxic", 5, 0)
    texts, label = pa.array([r.text for r in used]), np.array([r.toxic for r in used])
    after, y = pa.array([r.text for r in held]), np.array([r.toxic for r in held])
    trained = classify.ConvolutionalClassifier.fit(texts, label)
    random_ = classify.ConvolutionalClassifier.fit(texts, label, epochs=0)
    # The table: a text scores as its word of the largest log odds, cut where the F measure is best.
    words = classify.Corpus(texts)
    rows = classify.frequent(words, words.bucket)
    doc = np.repeat(np.arange(words.texts), words.n)
    met = np.unique(doc * (rows.max() + 1) + rows[words.bucket])
    one, all_ = (np.bincount(met[k] % (rows.max() + 1), minlength=rows.max() + 1) for k in (label[met // (rows.max() + 1)] == 1, slice(None)))
    odds = np.log((one + 0.5) / label.sum()) - np.log((all_ - one + 3.5) / (1 - label).sum())
    odds[0] = 0

    def table(t):
        w = classify.Words(t)
        best = np.zeros(w.texts)
        np.maximum.at(best, np.repeat(np.arange(w.texts), w.n), odds[rows[w.bucket]])
        return best

    by_table, cut = table(after), classify._threshold(table(texts), label)
    right = lambda s: float((s == (y == 1)).mean())
    scores = {"trained": trained.score(after), "random": random_.score(after)}
    assert right(scores["trained"] >= 0.5) > max(right(scores["random"] >= 0.5), right(by_table >= cut))
    assert area(scores["trained"], y) > max(area(scores["random"], y), area(by_table, y)) + 0.01
    assert (trained.shift != trained.shift[0]).any()  # languages have thresholds of their own


def test_machine_uses_the_sum_of_squares_identity():
    rng = np.random.Generator(np.random.PCG64(0))
    texts = pa.array([" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(60)])
    m = classify.FactorisationMachine.fit(texts, np.arange(60) % 2)
    w = classify.Words(texts.slice(0, 1))
    x = np.concatenate([np.full(w.n[0], 1 / np.sqrt(w.n[0])), np.ones(len(classify.STATISTICS))])
    i = np.concatenate([m.rows[w.bucket], m._bins(classify.structure(w))[0]])
    pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
    want = classify.sigmoid(m.bias[0] + float(m.w[i] @ x) + pairs)
    assert abs(m.score(texts.slice(0, 1))[0] - want) < 1e-5


def test_metadata_are_fields_of_their_own(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    texts = pa.array([" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(400)])
    value = rng.normal(size=(400, 1))
    value[::10] = np.nan
    label = (np.nan_to_num(value[:, 0], nan=1.0) > 0).astype(int)
    m = classify.FactorisationMachine.fit(texts, label, value)
    assert ((m.score(texts, value) >= 0.5) == label).mean() > 0.9
    assert np.allclose(m.score(texts), m.score(texts, np.full((400, 1), np.nan)))  # absent is missing
    none = classify.FactorisationMachine.fit(texts, label, np.zeros((400, 1)))
    assert np.allclose(none.score(texts, np.full((400, 1), np.nan)) - none.score(texts, np.zeros((400, 1))), 0, atol=0.2)
    docs = spark.createDataFrame([(i, t.as_py(), None if np.isnan(v) else float(v), str(v)) for i, (t, v) in enumerate(zip(texts, value[:, 0], strict=True))], "doc_id long, text string, `a.b` double, s string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(label)], "doc_id long, quality int")
    by_table = classify.fit_quality(docs, labels, F.lit(True), metadata=("a.b", "s", "not there"))
    got = classify.scored(docs, by_table, {"doc_id": F.col("doc_id")}, metadata=("a.b", "s", "not there")).orderBy("doc_id").collect()
    assert ((np.array([r.score for r in got]) >= 0.5) == label).mean() > 0.9


def test_scores_do_not_depend_on_the_batch():
    texts = ["", "you idiot", "a fine day", "x " * 3000, "é"]
    label = np.array([0, 1, 0, 0, 0] * 30)
    for kind in (classify.FactorisationMachine, classify.ConvolutionalClassifier):
        m = kind.fit(pa.array(texts * 30), label)
        together = m.score(pa.array(texts))
        assert np.allclose(together, [m.score(pa.array([t]))[0] for t in texts])


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 5000)) for i in range(90)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    whole = classify.sample(docs, labels, "quality", F.lit(True))
    assert whole.num_rows == 90
    assert classify.sample(docs, labels, "quality", F.lit(True), rows=40).equals(whole.slice(0, 40).combine_chunks())
    few = classify.sample(docs, labels, "quality", F.lit(True), size=12_000)
    lengths = [len(t) for t in few.column("text").to_pylist()]
    assert few.num_rows == 62 and sum(lengths) <= 12_000 and lengths.count(5000) == 2


def test_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, 0), (None, 1), (9, None), (1, 0), (77, 1)], "doc_id long, quality int")
    model = classify.fit_quality(awkward, labels, F.lit(True))
    out = classify.scored(awkward, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert classify.scored(empty, model, {"doc_id": F.col("doc_id")}).count() == 0
    for fit in (classify.fit_quality, classify.fit_toxicity):
        none = fit(empty, labels.withColumn("toxic", F.lit(0)).limit(0), F.lit(True))
        assert len(none.score(pa.array(["", "a"]))) == 2
