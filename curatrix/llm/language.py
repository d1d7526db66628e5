"""Language by bit-sliced Bloom filters over letter grams.

A row of the filter holds a bit for each language; a gram selects HASHES rows, and their
conjunction is the set of languages that have the gram. A text's grams are looked up, the bits of
each language counted, and what a language's filter answers by chance is subtracted: of the
grams a language doesn't have, its filter still claims the share of its set bits to the power
of the number of hashes. The language with the most grams left is the text's.

A language has a gram if at least LEAST of its sampled texts do and their share of them is no less than RATIO
times the largest share among the languages, so that a word that strays into other languages' texts is no gram of
theirs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Letters of a gram; the border of a word counts as one, at either end.
SIZES = (3, 4)
HASHES = 3
LEAST, RATIO = 2, 0.2
#: Most texts of a language, and of all languages, that filters are made from: those of the smallest hashed ids, in turn
#: over the languages.
LANGUAGE_ROWS, SAMPLE_ROWS = 1000, 20_000
#: Most bytes of the filter, and most rows; more languages than that leaves rows for mean fewer rows.
FILTER_BYTES, FILTER_ROWS = 32 << 20, 1 << 20
UNDETERMINED = "und"
#: Looked-up grams at a time.
STEP = 1 << 18


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit names of all grams of the texts in lower case, the text of each gram, and whether each text has a letter.

    A gram of k letters lies within a word or touches its ends; letters of one word that is shorter make none, but with
    its borders a word of one letter makes one of three.
    """
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts.to_pylist()]
    n = np.array([len(c) + 1 for c in codes], np.int64)
    text = np.repeat(np.arange(len(codes)), n)
    flat = np.zeros(int(n.sum()) + 1, np.uint64)  # a border before, between and behind the texts
    first = np.cumsum(n) - n
    for a, c in zip(first.tolist(), codes, strict=True):
        flat[a + 1 : a + 1 + len(c)] = c
    inside = letters()[flat.astype(np.int64)]
    flat[~inside] = 0
    some = np.zeros(len(codes), bool)
    some[text[np.flatnonzero(inside) - 1]] = True
    single = np.ones(len(flat), bool)
    single[1:] = inside[1:] | inside[:-1]  # of several borders one stays
    flat, text, inside = flat[single], np.append(text, len(codes))[np.maximum(np.flatnonzero(single) - 1, 0)], inside[single]
    names, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for size in SIZES:
        m = len(flat) - size + 1
        if m <= 0:
            continue
        whole = np.ones(m, bool)
        for k in range(1, size - 1):
            whole &= inside[k : k + m]
        at = np.flatnonzero(whole)
        name = np.full(len(at), size, np.uint64)
        for k in range(size):
            name = common.mix64(name * np.uint64(0x9E3779B97F4A7C15) + flat[at + k]) if k % 2 else name * np.uint64(0x9E3779B97F4A7C15) + flat[at + k]
        names.append(common.mix64(name))
        owners.append(text[at + 1])
    return np.concatenate(names), np.concatenate(owners), some


class LanguageFilters:
    """The filter: rows x words of 64 languages, or narrower where fewer do."""

    def __init__(self, languages: list[str], texts: list[int], bits: np.ndarray):
        self.languages, self.bits = languages, bits
        n = len(languages)
        #: Where nothing tells languages apart the one with most texts is taken, then the first by name.
        self.order = sorted(range(n), key=lambda i: (-texts[i], languages[i]))
        self.chance = self.counted(bits) ** HASHES if n else np.zeros(0)

    def counted(self, rows: np.ndarray) -> np.ndarray:
        """The share of rows that have each language's bit."""
        return np.array([self._bit(rows, i).mean() for i in range(len(self.languages))])

    def _bit(self, rows: np.ndarray, i: int) -> np.ndarray:
        return (rows[:, i // 64] >> rows.dtype.type(i % 64)) & rows.dtype.type(1)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), its share of the corrected counts of all, and grams met, of each text."""
        name, owner, some = grams(texts)
        n, k = len(texts), len(self.languages)
        total, hits = np.bincount(owner, minlength=n).astype(np.float64), np.zeros((n, k))
        for a in range(0, len(name), STEP):
            rows = places(name[a : a + STEP], len(self.bits))
            met = self.bits[rows[0]]
            for r in rows[1:]:
                met &= self.bits[r]
            own = owner[a : a + STEP]
            for i in range(k):
                hits[:, i] += np.bincount(own, self._bit(met, i), n)
        left = np.maximum(hits - total[:, None] * self.chance, 0) / np.maximum(1 - self.chance, 1e-9)
        if not k:
            return np.full(n, -1), np.zeros(n), np.zeros(n)
        turn = left[:, self.order]
        best = np.array(self.order)[np.argmax(turn, axis=1)]
        most, all_ = turn.max(1), turn.sum(1)
        return np.where(some, best, -1), np.where(some & (all_ > 0), most / np.where(all_ > 0, all_, 1), 0.0), most


def places(name: np.ndarray, rows: int) -> list[np.ndarray]:
    """The HASHES rows of each gram; ``rows`` is a power of two."""
    bits = rows.bit_length() - 1
    mask = np.uint64(rows - 1)
    return [((name >> np.uint64(64 - bits * (i + 1)) if bits * (i + 1) <= 64 else common.mix64(name + np.uint64(i))) & mask).astype(np.int64) for i in range(HASHES)]


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang and text of at most LANGUAGE_ROWS documents of each language and SAMPLE_ROWS in all.

    They are those of the smallest hashes of their ids, whatever the partitioning. Languages are counted first, so
    that only a few times as many rows as are taken go into the order of a frequent language. Of rows with one id the one
    of least language and text is taken; rows without an id or a language are left out.
    """
    named = docs.select(common.column(docs, id_col).alias("id"), common.column(docs, lang_col).cast("string").alias("lang"))
    named = named.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & usable)
    sizes = named.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    near = named.join(sizes, "lang").where((F.col("n") <= 4 * LANGUAGE_ROWS) | (share < F.lit(4.0 * LANGUAGE_ROWS) / F.col("n")))
    once = near.groupBy("id").agg(F.min("lang").alias("lang")).withColumn("rank", F.struct(F.pmod(F.xxhash64("id"), F.lit(1 << 20)), F.xxhash64("id"), F.col("id")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    chosen = once.withColumn("nth", nth).where(F.col("nth") <= LANGUAGE_ROWS).orderBy("nth", "rank").limit(SAMPLE_ROWS).select("id", "lang")
    texts = docs.select(common.column(docs, id_col).alias("id"), common.column(docs, lang_col).cast("string").alias("lang"), common.text_or_empty(docs, text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), ["id", "lang"])  # at most SAMPLE_ROWS keys
    return met.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("x")).select("x.lang", "x.text")


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Filters of the languages of a bounded sample of the documents for which ``usable`` (a condition on ``id``) holds.

    Grams are counted and filter rows put together by Spark; the driver gets the languages of the sample and the
    filter's rows, at most FILTER_BYTES. Without documents of a language there are no languages.
    """
    spark = docs.sparkSession
    texts = common.written(sample(docs, usable, id_col, text_col, lang_col), f"{common.scratch(spark)}/sample")
    known = sorted((r.lang, r["count"]) for r in texts.groupBy("lang").count().collect())  # of at most SAMPLE_ROWS rows
    languages, n = [x for x, _ in known], [c for _, c in known]
    words = max(1, -(-len(languages) // 64))
    rows = min(FILTER_ROWS, 1 << ((FILTER_BYTES // (8 * words)).bit_length() - 1))
    kind = next((t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= bits), np.uint64)
    filled = np.zeros((rows, words), np.uint64)
    if languages:
        number = {x: i for i, x in enumerate(languages)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, 1):
                    name, owner, _ = grams(part.column(1))
                    lang = np.array([number[x] for x in part.column(0).to_pylist()], np.int64)
                    order = np.lexsort((owner, name))
                    name, owner = name[order], owner[order]
                    new = np.ones(len(name), bool)
                    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])  # a text counts once for a gram
                    made = pa.table({"gram": name[new].view(np.int64), "lang": lang[owner[new]], "one": np.ones(int(new.sum()), np.int64)})
                    yield from made.group_by(["gram", "lang"]).aggregate([("one", "sum")]).rename_columns(["gram", "lang", "n"]).to_batches()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                name = batch.column(0).to_numpy().view(np.uint64)
                for r in places(name, rows):
                    yield pa.RecordBatch.from_arrays([pa.array(r), *batch.columns[1:]], names=["row", "word", "mask"])

        counts = texts.mapInArrow(count, "gram long, lang long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
        share = F.col("n") / F.element_at(F.array(*[F.lit(float(c)) for c in n]), (F.col("lang") + 1).cast("int"))
        shares = counts.where(F.col("n") >= LEAST).withColumn("share", share)
        top = shares.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("x"), F.max("share").alias("top"))
        had = top.select("gram", F.explode("x").alias("x"), "top").where(F.col("x.share") >= RATIO * F.col("top"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("x.lang", F.lit(64)).cast("int"))
        masks = had.groupBy("gram", F.floor(F.col("x.lang") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("mask"))
        made = masks.select("gram", "word", "mask").mapInArrow(placed, "row long, word long, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        filled[made.column("row").to_numpy(), made.column("word").to_numpy()] = made.column("mask").to_numpy().view(np.uint64)
    return LanguageFilters(languages, n, filled.astype(kind))


def predicted(docs: DataFrame, model: LanguageFilters, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score of each row.

    A text that is null or has no letter, and any text where no language was learned, is ``und`` with score 0. The score
    is the language's share of the corrected counts of all languages, 0 where no gram is known; such a text is
    given the language that most sampled texts have. Rows of one text are judged alike; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most FILTER_BYTES

    def factory():
        m = held.value
        names = pa.array([*m.languages, UNDETERMINED])

        def work(texts: pa.Array) -> list[pa.Array]:
            best, score, _ = m.scores(texts)
            return [names.take(pa.array(np.where(best < 0, len(m.languages), best))), pa.array(score)]

        return work

    return common.map_texts(docs, keep, common.text_or_empty(docs, text_col), "lang_pred string, score double", factory)
