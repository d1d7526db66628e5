"""Text classifiers trained here: a factorisation machine and a convolutional network.

Both look words up by hash: 2 ** HASH_BITS buckets, of which those that occur in at
least MIN_DOCS training texts have a row of parameters; all others share a row of
zeros. The network looks up the first bytes of a word in the same way, so a word that
wasn't met speaks through its stem; to the machine it says nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HASH_BITS = 20
MIN_DOCS = 3
#: Most labelled rows that a model is fitted on, those of the smallest hashed ids, and most bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20
#: Bytes of a word that make its stem.
STEM = 5


def sample(
    df: DataFrame,
    labels: DataFrame,
    label_col: str,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = SAMPLE_ROWS,
    size: int = SAMPLE_BYTES,
    metadata: tuple[str, ...] = (),
) -> pa.Table:
    """Columns text, label, and a double for each of ``metadata``, of at most ``rows`` labelled rows for which ``usable`` holds.

    ``usable`` is a condition on the column ``id`` (the key). Null keys or labels and
    labels other than 0 and 1 are left out; of several labels of one key the largest
    counts. The rows are those of the smallest hashes of their keys, whatever the
    partitioning; of these a text that would take the sum over ``size`` bytes is left out,
    and those after it may still fit. The bounds make it safe to send the keys to all
    executors and the texts to the driver.
    """
    key, label = common.column(labels, id_col), common.column(labels, label_col)
    chosen = (
        labels.select(key.alias("id"), label.cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & usable)
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    more = [f"m{i}" for i in range(len(metadata))]
    texts = df.select(common.column(df, id_col).alias("id"), F.struct(common.text_or_empty(df, text_col).alias("text"), *[_number(df, c).alias(m) for c, m in zip(metadata, more, strict=True)]).alias("row"))
    joined = texts.join(F.broadcast(chosen), "id")  # at most ``rows`` keys
    once = joined.groupBy("id").agg(F.min("row").alias("row"), F.min("label").alias("label"))
    held = common.written(once.select(F.xxhash64("id").alias("rank"), "id", "row.*", "label"), f"{common.scratch(df.sparkSession)}/sample")
    sizes = held.select("rank", "id", F.octet_length("text").alias("n")).orderBy("rank", "id").toArrow()  # ``rows`` at most
    fit, used = [], 0
    for n in sizes.column("n").to_pylist():
        fit.append(used + n <= size)
        used += n * fit[-1]
    if not all(fit):
        keys = df.sparkSession.createDataFrame(sizes.filter(pa.array(fit)).select(["id"]))
        held = held.join(F.broadcast(keys), "id", "left_semi")
    return held.orderBy("rank", "id").select("text", "label", *more).toArrow()


def _number(df: DataFrame, name: str) -> Column:
    """A column as a number; null where it isn't one, and where there is no such column."""
    return F.lit(None).cast("double") if name not in df.columns else common.column(df, name).try_cast("double")


class Words:
    """Texts as hashed words: bucket of each word, and where each text's words begin."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = common.flat_bytes(texts)
        low = common.LOWER[self.raw]
        self.starts, self.ends, self.first = common.word_spans(low, self.offsets, common.NOT_ALNUM)
        self.hashes = common.word_hashes(low, self.starts, self.ends)
        self.bucket = (self.hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        self.n = np.diff(self.first)
        self.texts = len(self.n)

    def stems(self) -> np.ndarray:
        """Buckets of the words' first STEM bytes."""
        hashes = common.word_hashes(common.LOWER[self.raw], self.starts, np.minimum(self.ends, self.starts + STEM))
        return (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Corpus:
    """The buckets of all words of many texts, their stems' or their structure, made slice by slice."""

    def __init__(self, texts: pa.Array, with_structure: bool = False, with_stems: bool = False):
        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        bucket, stem, n, stats = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros((0, len(STATISTICS)))]
        for part in common.slices(batch, 0):
            words = Words(part.column(0))
            bucket.append(words.bucket.astype(np.int32))
            n.append(words.n)
            if with_structure:
                stats.append(structure(words))
            if with_stems:
                stem.append(words.stems().astype(np.int32))
        self.bucket, self.stem, self.n, self.stats = np.concatenate(bucket), np.concatenate(stem), np.concatenate(n), np.concatenate(stats)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.texts = len(self.n)


def frequent(words: Corpus, bucket: np.ndarray) -> np.ndarray:
    """Row of each bucket: 1, 2, ... for buckets met in MIN_DOCS texts, 0 for all others."""
    met, step = np.zeros(1 << HASH_BITS, np.int64), 256
    for a in range(0, words.texts, step):
        b = min(words.texts, a + step)
        doc = np.repeat(np.arange(b - a), words.n[a:b])
        pairs = np.unique(doc << HASH_BITS | bucket[words.first[a] : words.first[b]])
        met += np.bincount(pairs & ((1 << HASH_BITS) - 1), minlength=1 << HASH_BITS)
    rows = np.zeros(1 << HASH_BITS, np.int32)
    some = np.flatnonzero(met >= MIN_DOCS)
    rows[some] = np.arange(1, len(some) + 1)
    return rows


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the rows of each text; zero for texts without any."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adagrad:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        seen = self.seen.setdefault(name, np.full(value.shape, 1e-8))
        seen[rows] += grad * grad
        value[rows] -= self.rate * grad / np.sqrt(seen[rows])


# --- Structure of a text -------------------------------------------------------

_CLASS = np.full(256, 7, np.int64)  # 7: punctuation and signs
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[32], _CLASS[10], _CLASS[[9, 11, 12, 13]] = 4, 5, 4
_CLASS[[44, 46, 59, 58, 39, 45]] = 6  # ordinary punctuation
_IS_LINE = common.flags((10, 10))
STATISTICS = ("lower", "upper", "digit", "other", "blank", "line", "stop", "sign", "word_length", "length", "distinct", "repeated_lines", "runs", "words_a_line", "echoes")


def structure(words: Words) -> np.ndarray:
    """STATISTICS of each text: shares of kinds of bytes, repetition, lengths."""
    n = words.texts
    size = np.diff(words.offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 8 + _CLASS[words.raw], minlength=n * 8).reshape(n, 8)
    some = np.maximum(size, 1)[:, None]
    count = np.maximum(words.n, 1)
    owner = np.repeat(np.arange(n), words.n)
    both = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (words.hashes >> np.uint64(24)))
    distinct = np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=n)
    a, b, first = common.word_spans(words.raw, words.offsets, _IS_LINE)
    lines = np.diff(first)
    line_owner = np.repeat(np.arange(n), lines)
    line_key = np.unique((line_owner.astype(np.uint64) << np.uint64(40)) | (common.word_hashes(words.raw, a, b) >> np.uint64(24)))
    line_kinds = np.bincount((line_key >> np.uint64(40)).astype(np.int64), minlength=n)
    run = np.zeros(len(words.raw), bool)
    run[1:] = (words.raw[1:] == words.raw[:-1]) & (words.raw[1:] < 128)
    runs = np.bincount(doc[run], minlength=n)
    echo = np.zeros(len(owner), bool)  # a word that repeats the one before it
    echo[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    echoes = np.bincount(owner[echo], minlength=n)
    lengths = np.bincount(owner, weights=words.ends - words.starts, minlength=n)
    return np.column_stack(
        [
            kinds / some,
            lengths / count,
            np.log1p(size),
            distinct / count,
            1 - line_kinds / np.maximum(lines, 1),
            runs / some[:, 0],
            np.log1p(words.n / np.maximum(lines, 1)),
            echoes / count,
        ]
    )


# --- Factorisation machine -------------------------------------------------------


class FactorisationMachine:
    """Weights and low-rank interactions of hashed words, of binned statistics and of binned metadata.

    score = sigmoid(bias + sum w x + (|sum v x|^2 - sum |v|^2 x^2) / 2): linear in the
    number of features. A word's x is 1 / sqrt(words); a bin has x = 1. A missing value of
    the metadata has a bin of its own; a bin that no text of the sample has says nothing.
    """

    RANK, BINS, EPOCHS, BATCH = 8, 16, 12, 128

    @classmethod
    def fit(cls, texts: pa.Array, label: np.ndarray, metadata: np.ndarray | None = None) -> FactorisationMachine:
        self = cls()
        words = Corpus(texts, with_structure=True)
        stats = words.stats if metadata is None else np.column_stack([words.stats, metadata])
        self.fields = stats.shape[1]
        self.rows = frequent(words, words.bucket)
        self.vocabulary = int(self.rows.max()) + 1
        cuts = np.linspace(0, 1, cls.BINS)[1:-1]  # the last bin is for what is missing
        self.edges = [np.quantile(c, cuts) if len(c := stats[~np.isnan(stats[:, i]), i]) else np.zeros(len(cuts)) for i in range(self.fields)]
        size = self.vocabulary + self.fields * cls.BINS
        rng = np.random.Generator(np.random.PCG64(10))
        self.bias = np.zeros(1)
        self.w, self.v = np.zeros(size), rng.normal(0, 0.05, (size, cls.RANK))
        self.v[0] = 0
        if not len(label):
            return self
        self.bias[0] = np.log((label.sum() + 1) / (len(label) - label.sum() + 1))
        word, first = self.rows[words.bucket], words.first
        bins, opt = self._bins(stats), Adagrad(0.08)
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3))
        weight = np.sqrt(weight)
        for _ in range(cls.EPOCHS):
            order = rng.permutation(len(label))
            for k in range(0, len(order), cls.BATCH):
                docs = order[k : k + cls.BATCH]
                index = np.concatenate([np.concatenate([word[first[d] : first[d + 1]], bins[d]]) for d in docs])
                n = first[docs + 1] - first[docs]
                x = np.concatenate([np.concatenate([np.full(m, 1 / np.sqrt(max(m, 1))), np.ones(bins.shape[1])]) for m in n])
                start = np.concatenate([[0], np.cumsum(n + bins.shape[1])])
                used, inverse = np.unique(index, return_inverse=True)
                vx = self.v[index] * x[:, None]
                total = sums(vx, start)
                z = self.bias[0] + sums(self.w[index] * x, start) + 0.5 * ((total**2).sum(1) - sums((vx**2).sum(1), start))
                error = (sigmoid(z) - label[docs]) * weight[docs] / len(docs)
                each = np.repeat(error, n + bins.shape[1]) * x
                gw = np.bincount(inverse, each, len(used)) + 1e-5 * self.w[used]
                gv = np.column_stack([np.bincount(inverse, each * (np.repeat(total[:, f], n + bins.shape[1]) - vx[:, f]), len(used)) for f in range(cls.RANK)]) + 1e-5 * self.v[used]
                known = used > 0
                opt.step("w", self.w, gw[known], used[known])
                opt.step("v", self.v, gv[known], used[known])
                opt.step("bias", self.bias, np.array([error.sum()]))
        never = np.ones(size, bool)
        never[word], never[bins.ravel()] = False, False
        self.v[never] = 0
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        return self

    def _bins(self, stats: np.ndarray) -> np.ndarray:
        at = [np.where(np.isnan(stats[:, i]), self.BINS - 1, np.searchsorted(e, stats[:, i], "right")) + self.vocabulary + i * self.BINS for i, e in enumerate(self.edges)]
        return np.column_stack(at) if len(stats) else np.zeros((0, self.fields), np.int64)

    def score(self, texts: pa.Array, metadata: np.ndarray | None = None) -> np.ndarray:
        words = Words(texts)
        stats = structure(words)
        if self.fields > len(STATISTICS):
            missing = np.full((words.texts, self.fields - len(STATISTICS)), np.nan)
            stats = np.column_stack([stats, missing if metadata is None else metadata])
        bins = self._bins(stats)
        row = self.rows[words.bucket]
        x = 1 / np.sqrt(np.maximum(words.n, 1))
        total = sums(self.v[row], words.first) * x[:, None] + self.v[bins].sum(1)
        square = (self.v**2).sum(1)
        squares = sums(square[row], words.first) * x**2 + square[bins].sum(1)
        linear = sums(self.w[row], words.first) * x + self.w[bins].sum(1)
        return sigmoid(self.bias[0] + linear + 0.5 * ((total**2).sum(1) - squares))


# --- Convolutional network -------------------------------------------------------

#: Frequent words by which the language of a text is guessed.
LANGUAGE_WORDS = {
    "en": "the of and to in is that it for was with as be this are at by from".split(),
    "fr": "le la les des et que pour une dans qui du sur pas est avec au".split(),
    "de": "der die das und ist nicht mit von den dem ein sich auf im zu".split(),
    "es": "el los las para con una por del que su como no al lo se y".split(),
}


def _language_table() -> np.ndarray:
    out = np.zeros(1 << HASH_BITS, np.int8)
    for i, some in enumerate(LANGUAGE_WORDS.values()):
        out[Words(pa.array(some)).bucket] = i + 1
    return out


class ConvolutionalClassifier:
    """Hashed embeddings, filters over 1, 2 and 3 words, maximum over the text, one output.

    A word's embedding is the sum of its own and its stem's. All parameters start at random
    and are trained; in training a part of the words is known by their stems only, as new
    words are later. The output is shifted by a threshold for the guessed language of the
    text, so that 0.5 separates the classes in each of them. A network that is trained has
    its filters applied to the embeddings once; scoring adds looked-up rows.
    """

    WIDTHS, FILTERS, DIMS, EPOCHS, BATCH, PAD = (1, 2, 3), 12, 12, 8, 16, 2
    UNNAMED = 0.5  # share of words that are known by their stems only, in training
    CALIBRATION = 0.2  # last share of the sample, not trained on
    LEAST = 40  # texts of a language that get a threshold of their own

    @classmethod
    def fit(cls, texts: pa.Array, label: np.ndarray, epochs: int | None = None) -> ConvolutionalClassifier:
        self = cls()
        words = Corpus(texts, with_stems=True)
        rng = np.random.Generator(np.random.PCG64(9))
        self.rows, self.stems = frequent(words, words.bucket), frequent(words, words.stem)
        self.languages = _language_table()
        named = int(self.rows.max()) + 1
        self.stems[self.stems > 0] += named - 1
        held = int(len(label) * cls.CALIBRATION)
        train = np.arange(len(label) - held)
        self.e = rng.normal(0, 0.1, (max(named, int(self.stems.max()) + 1), cls.DIMS))
        self.e[0] = 0
        self.f = [rng.normal(0, np.sqrt(2 / (w * cls.DIMS)), (w, cls.DIMS, cls.FILTERS)) for w in cls.WIDTHS]
        self.b = [np.zeros(cls.FILTERS) for _ in cls.WIDTHS]
        n = len(cls.WIDTHS) * cls.FILTERS
        self.o, self.c = rng.normal(0, np.sqrt(1 / n), n), np.zeros(1)
        self.shift = np.zeros(len(LANGUAGE_WORDS) + 1)
        if len(label):
            self._train(words, label, train, rng, cls.EPOCHS if epochs is None else epochs)
        self._settle()
        if held:
            rest = pa.RecordBatch.from_arrays([texts.slice(len(train))], names=["t"])
            parts = [self._logits(Words(part.column(0))) for part in common.slices(rest, 0)]
            z, language = (np.concatenate(x) for x in zip(*parts, strict=True))
            self._calibrate(z, language, label[len(train) :])
        return self

    def _train(self, words: Corpus, label: np.ndarray, train: np.ndarray, rng, epochs: int) -> None:
        row, stem = self.rows[words.bucket], self.stems[words.stem]
        dense, sparse = Adagrad(0.05), Adagrad(0.1)
        self.c[0] = np.log((label[train].sum() + 1) / ((label[train] == 0).sum() + 1))
        n_filters = self.FILTERS
        for _ in range(epochs):
            order = rng.permutation(train)
            for k in range(0, len(order), self.BATCH):
                docs = order[k : k + self.BATCH]
                place, source, start, n, size = _placed(words.first, docs, self.PAD)
                index = np.zeros((2, size), np.int64)
                index[0, place] = np.where(rng.random(len(source)) < self.UNNAMED, 0, row[source])
                index[1, place] = stem[source]
                emb, m = self.e[index[0]] + self.e[index[1]], size - self.PAD
                hidden, picks = [], []
                for f, b, w in zip(self.f, self.b, self.WIDTHS, strict=True):
                    conv = sum(emb[j : m + j] @ f[j] for j in range(w)) + b
                    best = np.stack([start[i] + conv[start[i] : start[i] + max(1, x)].argmax(0) for i, x in enumerate(n)])
                    picks.append(best)
                    hidden.append(np.take_along_axis(conv, best, 0))
                h = np.concatenate(hidden, 1)
                act = np.maximum(h, 0)
                error = (sigmoid(act @ self.o + self.c[0]) - label[docs]) / len(docs)
                go, gh = act.T @ error, (error[:, None] * self.o) * (h > 0)
                met, pull = [], []
                for i, (f, b, w) in enumerate(zip(self.f, self.b, self.WIDTHS, strict=True)):
                    g, best = gh[:, i * n_filters : (i + 1) * n_filters], picks[i]
                    gf = np.zeros_like(f)
                    for j in range(w):
                        at = best + j  # word under each filter's winning place
                        gf[j] = np.einsum("bfd,bf->df", emb[at], g)
                        ge = (g[:, :, None] * f[j].T[None]).reshape(-1, self.DIMS)
                        met += [index[0, at].ravel(), index[1, at].ravel()]
                        pull += [ge, ge]
                    dense.step(f"f{i}", f, gf + 1e-5 * f)
                    dense.step(f"b{i}", b, g.sum(0))
                used, inverse = np.unique(np.concatenate(met), return_inverse=True)
                total = np.zeros((len(used), self.DIMS))
                np.add.at(total, inverse, np.concatenate(pull))
                known = used > 0
                sparse.step("e", self.e, total[known], used[known])
                dense.step("o", self.o, go + 1e-5 * self.o)
                dense.step("c", self.c, np.array([error.sum()]))

    def _settle(self) -> None:
        """Apply the filters to every embedding: a row of sums for each width and place."""
        self.table = np.concatenate([self.e @ f[j] for f, w in zip(self.f, self.WIDTHS, strict=True) for j in range(w)], 1).astype(np.float32)
        self.e = None

    def _logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        docs = np.arange(words.texts)
        if not len(docs):
            return np.zeros(0), np.zeros(0, np.int64)
        place, source, start, n, size = _placed(words.first, docs, self.PAD)
        index = np.zeros((2, size), np.int64)
        index[0, place], index[1, place] = self.rows[words.bucket][source], self.stems[words.stems()][source]
        m, at, pooled = size - self.PAD, 0, []
        for b, w in zip(self.b, self.WIDTHS, strict=True):
            conv = np.zeros((m, self.FILTERS), np.float32)
            for j in range(w):
                for row in index[:, j : m + j]:
                    conv += self.table[row, at : at + self.FILTERS]
                at += self.FILTERS
            # A window that begins in a text sees its words and padding, none of the next text.
            ends = start + np.maximum(n, 1)
            bound = np.column_stack([start, ends]).ravel()
            conv = np.concatenate([conv, np.zeros((self.PAD, self.FILTERS), np.float32)])
            pooled.append(np.maximum.reduceat(conv, bound, axis=0)[::2] + b)
        h = np.maximum(np.concatenate(pooled, 1), 0)
        doc = np.repeat(docs, words.n)
        hits = np.bincount(doc * (len(LANGUAGE_WORDS) + 1) + self.languages[words.bucket], minlength=len(docs) * (len(LANGUAGE_WORDS) + 1)).reshape(len(docs), -1)
        hits[:, 0] = 0
        return h @ self.o + self.c[0], np.where(hits.max(1) > 0, hits.argmax(1), 0)

    def _calibrate(self, z: np.ndarray, language: np.ndarray, label: np.ndarray) -> None:
        """Thresholds of the best F measure: on all held texts, then for each language."""
        self.shift[:] = _threshold(z, label)
        for k in range(1, len(self.shift)):
            some = language == k
            if some.sum() >= self.LEAST and label[some].sum() >= 5:
                self.shift[k] = (_threshold(z[some], label[some]) + self.shift[0]) / 2

    def score(self, texts: pa.Array) -> np.ndarray:
        z, language = self._logits(Words(texts))
        return sigmoid(z - self.shift[language])


def _placed(first: np.ndarray, docs: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Where the texts' words go if ``pad`` empty places (and one at least in each) follow a text, which
    words they are, where the texts start, their words, and the places of all (``pad`` more at the end)."""
    n = first[docs + 1] - first[docs]
    size = np.maximum(n, 1) + pad
    start = np.cumsum(size) - size
    total = int(n.sum())
    within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start, n) + within, np.repeat(first[docs], n) + within, start, n, int(size.sum()) + pad


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap below the output at which the F measure is best."""
    if not len(z) or not y.sum():
        return 0.0
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    k = int(f.argmax())
    below = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + below) / 2)


# --- On DataFrames -----------------------------------------------------------------


def scored(df: DataFrame, model, keep: dict[str, Column], text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and ``score`` of each row; a null text is scored as empty, a null of the metadata as missing.

    ``metadata`` are those that the model was fitted with, if any. The model's size is bounded by its
    buckets and by the rows it was fitted on. Each row stands for itself: repeated ones are scored alike, an empty table
    gives no rows, and columns are taken by what ``keep`` names, so names of others don't matter.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        def work(texts: pa.Array, *more: pa.Array) -> list[pa.Array]:
            beside = (_matrix(more),) if more else ()
            return [pa.array(shared.value.score(texts, *beside).astype(np.float64))]

        return work

    return common.map_texts(df, keep, common.text_or_empty(df, text_col), "score double", factory, beside=tuple(_number(df, c) for c in metadata))


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])


def _fitted(kind, df: DataFrame, labels: DataFrame, label_col: str, usable: Column, metadata: tuple[str, ...] = (), **names):
    rows = sample(df, labels, label_col, usable, metadata=metadata, **names)
    texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    beside = (np.column_stack([rows.column(f"m{i}").to_numpy() for i in range(len(metadata))]),) if metadata else ()
    return kind.fit(texts, rows.column("label").to_numpy().astype(np.int64), *beside)


def fit_quality(df: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", **names) -> FactorisationMachine:
    """A factorisation machine fitted on ``sample``'s rows; without any (empty tables, no usable labels) it scores all alike (0.5).

    Rows of one id teach once, by the least of their texts; other columns are left aside."""
    return _fitted(FactorisationMachine, df, labels, label_col, usable, **names)


def fit_toxicity(df: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", **names) -> ConvolutionalClassifier:
    """A convolutional network fitted on ``sample``'s rows and calibrated on their last fifth; without any it isn't trained.

    Rows of one id teach once, by the least of their texts; other columns are left aside."""
    return _fitted(ConvolutionalClassifier, df, labels, label_col, usable, **names)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n
