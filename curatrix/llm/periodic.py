"""Runs of words that repeat with a period, found by counting matches at each lag.

A run of period q has q-periodic neighbours: three periods of words that equal the word q
places on. So lags with too few matches hold no run. Matches are counted exactly for all lags of
a text: words that occur often by one FFT autocorrelation each, all others by the differences
of their places. Lags are taken in ascending order; what a run explains at multiples of its
period is subtracted there, so a text that repeats throughout isn't scanned again for
each multiple. At a lag that has matches enough, islands of them are looked for from places one
lag apart, of which an island holds three; only there are words compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A run has so many periods at least, and so many words.
PERIODS, WORDS = 4, 6
#: An FFT over N places counts as so many differences of places for each place and doubling.
FFT_COST = 0.25


def needed(q: np.ndarray | int) -> np.ndarray | int:
    """Consecutive matches at lag q that a run of period q has at least."""
    return np.maximum(WORDS - q, (PERIODS - 1) * q)


def lag_counts(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches at the lags 1 to n // PERIODS of each text, one text after the other, and where each text's begin.

    ``words`` are numbers of words, ``first`` the place of each text's first one.
    """
    n = np.diff(first)
    lags = np.where(n >= WORDS, n // PERIODS, 0)
    base = np.concatenate([[0], np.cumsum(lags)])
    out = np.zeros(base[-1], np.int64)
    if not base[-1]:
        return out, base
    text = np.repeat(np.arange(len(n)), n)
    order = np.argsort(words, kind="stable")
    w, doc = words[order], text[order]
    changed = np.ones(len(w), bool)
    changed[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    new = np.flatnonzero(changed)
    size = np.diff(np.append(new, len(w)))
    points = 2 ** np.ceil(np.log2(np.maximum(2 * n, 2)))
    heavy = (size.astype(np.float64) ** 2 / 2 > FFT_COST * points[doc[new]] * np.log2(points[doc[new]])) & (lags[doc[new]] > 0)
    spectra: dict[int, np.ndarray] = {}
    for g in np.flatnonzero(heavy):
        d = int(doc[new[g]])
        at = np.zeros(int(points[d]))
        at[order[new[g] : new[g] + size[g]] - first[d]] = 1
        spectrum = np.fft.rfft(at)
        spectra[d] = spectra.get(d, 0) + (spectrum.real**2 + spectrum.imag**2)
    for d, power in spectra.items():
        out[base[d] : base[d + 1]] += np.rint(np.fft.irfft(power, int(points[d]))[1 : lags[d] + 1]).astype(np.int64)
    # Differences of places: with the next place of the same word, the one after it, and so on while in reach.
    light = np.repeat(~heavy & (size > 1) & (lags[doc[new]] > 0), size)
    last = np.repeat(new + size, size)
    left = np.flatnonzero(light)
    step = 0
    while len(left):
        step += 1
        left = left[left + step < last[left]]
        lag = order[left + step] - order[left]
        near = lag <= lags[doc[left]]
        left = left[near]
        at = base[doc[left]] + lag[near] - 1
        if len(at) * 8 > len(out):
            out += np.bincount(at, minlength=len(out))
        else:
            np.add.at(out, at, 1)
    return out, base


def islands(words: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches that have period q, can't be extended, and are long enough for a run.

    Long enough ones hold three places (five for q = 1) that are multiples of q and equal the next multiple.
    """
    least, n = int(needed(q)), len(words)
    spaced = words[::q]
    same = spaced[:-1] == spaced[1:]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    some = end - begin >= least // q
    out = []
    for k0, k1 in zip(begin[some].tolist(), end[some].tolist(), strict=True):
        a, b = max(0, (k0 - 1) * q + 1), min(n - q, k1 * q)
        match = words[a:b] == words[a + q : b + q]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], match.view(np.int8), [0]])))
        s, e = edge[::2], edge[1::2]
        long_ = e - s >= least
        out += [(a + x, y - x + q) for x, y in zip(s[long_].tolist(), e[long_].tolist(), strict=True)]
    return out


def runs(words: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; ``matches`` are those at lags 1, 2, ... (and are changed).

    A stretch of period q whose smallest period is less was found at that one, with the same ends. Of two runs with
    periods p < q, p a divisor of q, no pair of words q apart lies in both, so what is subtracted at q for p's runs
    are matches that q's own runs don't have.
    """
    lags = np.arange(1, len(matches) + 1)
    found: dict[tuple[int, int], int] = {}
    for q in lags[matches >= needed(lags)].tolist():
        if matches[q - 1] < needed(q):
            continue
        for start, length in islands(words, q):
            if found.setdefault((start, length), q) == q:
                upto = min(len(matches), length - 1) // q
                explained = length - q * np.arange(2, upto + 1)
                matches[2 * q - 1 : upto * q : q] -= explained
    return sorted((s, n, q) for (s, n), q in found.items())


def covered(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _exact(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words by their bytes."""
    known: dict[bytes, int] = {}
    data = raw.tobytes()
    return np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words of each text with one space between."""
    n = np.diff(first)
    size = ends - starts + 1
    size[first[1:][n > 0] - 1] -= 1  # no space behind a text's last word
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.full(offsets[-1], 32, np.uint8)
    length = ends - starts
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[place + np.repeat(offsets[:-1], length)] = raw[place + np.repeat(starts, length)]
    bounds = offsets[first]
    if bounds[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))


def _work(order: Callable[[int, int], np.ndarray | None] | None):
    def work(texts: pa.Array, *beside: pa.Array) -> list[pa.Array]:
        raw, offsets = common.flat_bytes(texts)
        starts, ends, first = common.word_spans(raw, offsets, common.SPACE)
        if order is not None:
            index = np.arange(len(starts))
            for d, h in enumerate(beside[0].to_pylist()):
                a, b = int(first[d]), int(first[d + 1])
                made = None if h is None or a == b else order(h, b - a)
                if made is not None:
                    index[a:b] = a + made
            starts, ends = starts[index], ends[index]
        words = common.word_hashes(raw, starts, ends).view(np.int64)
        matches, base = lag_counts(words, first)
        lags = np.arange(len(matches)) - np.repeat(base[:-1], np.diff(base)) + 1
        maybe = np.unique(np.searchsorted(base, np.flatnonzero(matches >= needed(lags)), "right") - 1)
        found, drop = [[] for _ in range(len(texts))], np.zeros(len(starts), bool)
        for d in maybe.tolist():
            a, b = int(first[d]), int(first[d + 1])
            found[d] = runs(words[a:b], matches[base[d] : base[d + 1]])
            if found[d]:
                numbers = _exact(raw, starts[a:b], ends[a:b])
                if int(numbers.max()) + 1 != len(np.unique(words[a:b])):  # two words of one hash
                    found[d] = runs(numbers, lag_counts(numbers, np.array([0, b - a]))[0])
                drop[a:b] = covered(found[d], b - a)
        n = [len(f) for f in found]
        flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 3)
        struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), struct)
        left = np.concatenate([[0], np.cumsum(~drop)])[first]
        return [pa.array(np.diff(first), pa.int64()), listed, _joined(raw, starts[~drop], ends[~drop], left)]

    return work


def collapsed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Callable[[int, int], np.ndarray | None] | None = None, beside: Column | None = None) -> DataFrame:
    """id, n_words, runs (start, length, period by start and period), and the text without what repeats.

    Words are stretches of anything but white space; of each run its first period stays, and kept words are joined by
    one space. With ``order`` the words are first put in an order: it gets the value of ``beside`` and the number of words,
    and returns the index of the word for each place, or None; a null ``beside`` and a text without words stay as they are.

    A null or empty text, or one of white space, has no words, no runs and an empty text. Rows of one id are rows of
    their own. An empty table gives no rows, and columns of other names are left out. Words are compared by 64-bit
    hashes first; where that gives runs, they are compared by their bytes.
    """
    keep = {id_col: common.column(df, id_col)}
    fields = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return common.map_texts(df, keep, common.text_or_empty(df, text_col), fields, lambda: _work(order), beside=() if order is None else (beside,))


def strongest(found: Column) -> Column:
    """The run with the most periods, compared exactly; of equals the first. Null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(found, none, lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))
