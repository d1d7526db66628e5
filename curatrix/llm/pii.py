"""Personal data in texts, plain and disguised, with spans in the source text.

A text is read twice: as it is (base spans) and, where disguises occur, after
transducers have rewritten it: look-alike characters become ASCII, invisible ones
disappear, spelled digits become digits, "at" and "dot" in their disguises become @
and dots. Each rewritten character carries the range of source characters it stands
for, so what is found afterwards maps back to the source.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, rank of the kind, end

# The base patterns. Digits and dots outside a run can't begin a match
# inside it, so a look-behind and possessive repeats find the same matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``local@label(.label)+``, found from their at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """Base spans, sorted by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- Disguises -------------------------------------------------------------------

#: Characters that look like an ASCII one, and characters that don't show.
_ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЅЈοαεινρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXISJoaeivptuABEZHIKMNOPTYX", strict=True))
_ALIKE |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full width
_ALIKE |= {chr(base + i): str(i) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_ALIKE |= {"﹫": "@", "․": ".", "。": ".", "．": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
_ALIKE |= {chr(0x2080 + i): str(i) for i in range(10)} | {"⁰": "0", "¹": "1", "²": "2", "³": "3"} | {chr(0x2070 + i): str(i) for i in range(4, 10)}
_ALIKE |= {c: "" for c in "​‌‍⁠﻿­"}
_ALIKE_AT = re.compile("[" + re.escape("".join(_ALIKE)) + "]")
_SIGNS = re.compile("[" + re.escape("".join(c for c, a in _ALIKE.items() if not a or not a.isalpha())) + "]")
#: Digits as words.
_SPELLED = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789", strict=True))
_WORD = r"(?:" + "|".join(_SPELLED) + r"|double|triple)"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z])(?:plus[\s,-]{{1,2}})?(?:{_WORD}|[0-9])(?:[\s,-]{{1,2}}(?:{_WORD}|[0-9]+)(?![A-Za-z0-9])){{6,}}+", re.I)
_SPELLED_ONE = re.compile(rf"plus|{_WORD}|[0-9]+", re.I)
#: Runs of digits and words for them of any length; the detectors tell whether one is something.
_PIECE = rf"(?:{_WORD}|[0-9]++)(?![A-Za-z0-9])"
_SPELLED_MIXED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s,-]{{1,2}}|(?<!\+)\+\s?)?\(?{_PIECE}(?:[\s,()-]{{1,3}}{_PIECE})++", re.I)
_HAS_SPELLED = [w for w in _SPELLED if len(w) > 2]
_DOT = r"(?:\s*(?:\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{\s*(?:dot|\.)\s*\}|<\s*(?:dot|\.)\s*>)\s*|\s+dot\s+)"
#: Signs between a name and a domain: in brackets, as a word, or bare with a blank at its sides at most.
_SIGNS_AT = (re.compile(r"[\[({<]\s*+(?:at|@)\s*+[\])}>]", re.I), re.compile(r"(?<=\s)at(?=\s)", re.I), re.compile("@"))
_BRACKETS, _WORD_AT, _BARE = range(3)
#: What may stand to the right of a sign, and to its left read backwards. A word for the sign joins names by plain dots only.
_RIGHT = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)+", re.I)
_TOD = r"(?:\s*(?:\]\s*(?:tod|\.)\s*\[|\)\s*(?:tod|\.)\s*\(|\}\s*(?:tod|\.)\s*\{|>\s*(?:tod|\.)\s*<)\s*|\s+tod\s+)"
_LEFT = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:{_TOD}|\.)[A-Za-z0-9_%+-]++)*", re.I)
_LEFT_PLAIN = re.compile(r"[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*")
_DOT_AT = re.compile(_DOT, re.I)
_DOTTED = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])", re.I)

_GROUP = rf"{_PIECE}(?:[\s,-]{{1,2}}{_PIECE}){{0,2}}+"
_SPELLED_DOTTED = re.compile(rf"(?<![A-Za-z0-9.]){_GROUP}(?:(?:{_DOT}|\.){_GROUP}){{3}}", re.I)
_SPELLED_DOTTED_ONE = re.compile(rf"dot|\.|{_WORD}|[0-9]+", re.I)
_ALIKE_LETTERS = {ord(c): a for c, a in _ALIKE.items() if a.isalpha()}


class Tape:
    """A text and, for each of its characters, the source range it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = self.ends = None  # the identity until something is rewritten

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace ranges of the tape, in order and without overlap."""
        if not changes:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _look_alikes(tape: Tape) -> None:
    """ASCII for look-alikes; letters only in words that mix scripts, so that foreign words stay."""
    if tape.text.isascii() or not _ALIKE_AT.search(tape.text):
        return
    changes = [(m.start(), m.end(), _ALIKE[m.group()]) for m in _SIGNS.finditer(tape.text)]
    for m in re.finditer(r"[^\s]+", tape.text):
        word = m.group()
        if not word.isascii() and ("@" in word or "＠" in word or "﹫" in word) and re.search(r"[A-Za-z.]", word):
            changes += [(m.start() + x.start(), m.start() + x.end(), _ALIKE[x.group()]) for x in _ALIKE_AT.finditer(word) if _ALIKE[x.group()].isalpha()]
    tape.rewrite(sorted(changes))
    # Letters of what is an address once all letters are ASCII.
    plain = tape.text.translate(_ALIKE_LETTERS)
    if plain == tape.text:
        return
    changes, done = [], 0
    for a, _, _, b in _addresses(plain):
        if a and plain[a - 1].isalnum():  # the tail of a foreign word
            continue
        changes += [(x, x + 1, plain[x]) for x in range(max(a, done), b) if plain[x] != tape.text[x]]
        done = max(done, b)
    tape.rewrite(changes)


def _addresses(text: str) -> list[tuple[int, int, int, int]]:
    """Disguised addresses: where each begins, where its sign (with blanks) begins and ends, where it ends.

    They are found from their signs. What is read for one lies between the sign before it and
    the one after it, so the time is in proportion to the text, however long names are.
    """
    low = text.lower()
    dots = "dot" in low or "[.]" in low or "(.)" in low or "{.}" in low or "<.>" in low
    kinds = [_BRACKETS] if any(x in low for x in "[({<") else []
    kinds += [k for k, part in ((_WORD_AT, "at"), (_BARE, "@")) if dots and part in low]
    marks = sorted((m.start(), m.end(), k) for k in kinds for m in _SIGNS_AT[k].finditer(text))
    out, floor = [], 0
    for a, b, kind in marks:
        if a < floor:  # the bare sign in brackets, or one in what was taken
            continue
        left, right, most = a, b, 1 if kind == _BARE else len(text)
        while left > floor and a - left < most and text[left - 1].isspace():
            left -= 1
        while right < len(text) and right - b < most and text[right].isspace():
            right += 1
        before = (_LEFT_PLAIN if kind == _WORD_AT else _LEFT).match(text[floor:left][::-1])
        after = _RIGHT.match(text, right) if before else None
        floor = b
        # A bracketed sign needs no more than a domain; the others need a "dot" too.
        if after and (kind == _BRACKETS or _DOT_AT.search(after.group())):
            out.append((left - before.end(), left, right, after.end()))
            floor = after.end()
    return out


def _joined(run: str, one: re.Pattern) -> str:
    """A run of digits and words for them as digits, signs and dots only."""
    out, times = [], 1
    for x in one.finditer(run):
        word = x.group().lower()
        if word in ("double", "triple"):
            times = 2 if word == "double" else 3
            continue
        out.append({"plus": "+", "dot": "."}.get(word) or _SPELLED.get(word, word) * times)
        times = 1
    return "".join(out)


def _spelled_spans(tape: Tape) -> None:
    """Rewrite the spelled runs that are wholly personal data once they are digits."""
    for pattern, one in ((_SPELLED_DOTTED, _SPELLED_DOTTED_ONE), (_SPELLED_MIXED, _SPELLED_ONE)):
        changes = []
        for m in pattern.finditer(tape.text):
            run = m.group()
            if not any(w in run.lower() for w in _SPELLED):
                continue
            new = ("+" if run[0] == "+" else "") + _joined(run, one)
            if any(a == 0 and b == len(new) for a, _, b in find(new)):
                changes.append((m.start(), m.end(), new))
        tape.rewrite(changes)


def _spelled_digits(tape: Tape) -> None:
    low = tape.text.lower()
    if not any(w in low for w in _HAS_SPELLED):
        return
    _spelled_spans(tape)
    changes = []
    for m in _SPELLED_RUN.finditer(tape.text):
        times, last = 1, None
        for x in _SPELLED_ONE.finditer(m.group()):
            word, a, b = x.group().lower(), m.start() + x.start(), m.start() + x.end()
            if last is not None and a > last:
                changes.append((last, a, ""))  # what stands between two pieces of the run
            last = b
            if word in ("double", "triple"):
                times = 2 if word == "double" else 3
                changes.append((a, b, ""))
                continue
            changes.append((a, b, "+" if word == "plus" else _SPELLED.get(word, word) * times))
            times = 1
    tape.rewrite(changes)


def _signs_in_words(tape: Tape) -> None:
    low = tape.text.lower()
    dots = "dot" in low or "[.]" in low or "(.)" in low or "{.}" in low or "<.>" in low
    if dots:
        changes = []
        for m in _DOTTED.finditer(tape.text):
            changes += [(m.start() + x.start(), m.start() + x.end(), ".") for x in _DOT_AT.finditer(m.group())]
        tape.rewrite(changes)
    changes = []
    for a, left, right, b in _addresses(tape.text):
        for x, y in ((a, left), (right, b)):
            changes += [(x + m.start(), x + m.end(), ".") for m in _DOT_AT.finditer(tape.text[x:y])]
        changes.append((left, right, "@"))
    tape.rewrite(sorted(changes))


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans together with disguised ones.

    A disguised span is one that appears only after rewriting and doesn't overlap a
    span of its kind; it covers whole source characters, markers included.
    """
    base = find(text)
    tape = Tape(text)
    _look_alikes(tape)
    _spelled_digits(tape)
    _signs_in_words(tape)
    if tape.starts is None:
        return base, base
    taken = {k: [(a, b) for a, r, b in base if r == k] for k in range(len(KINDS))}  # in order, without overlap
    more = []
    for a, k, b in find(tape.text):
        s, e = tape.source(a, b)
        if text[s:e] == tape.text[a:b]:
            continue
        before = bisect_left(taken[k], (e,)) - 1  # the last one that begins before this one ends
        if before < 0 or taken[k][before][1] <= s:
            more.append((s, k, e))
    return base, sorted([*base, *more]) if more else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each text in code points, ends exclusive.

    Returns one row for each row: ``id_col``, ``base`` and ``spans`` (arrays of kind,
    start, end by start, then kind). A null text is the empty text, without spans.
    Null and repeated keys, repeated rows, extra columns: a row stands for itself.
    """

    def structs(found: list[list[Span]]) -> pa.Array:
        flat = [x for spans in found for x in spans]
        ends = [0]
        for spans in found:
            ends.append(ends[-1] + len(spans))
        fields = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int32()), pa.array([b for _, _, b in flat], pa.int32())], ["kind", "start", "end"]
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)

    def factory():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = [find_all(t) for t in texts.to_pylist()]
            return [structs([b for b, _ in found]), structs([s for _, s in found])]

        return work

    kind = "array<struct<kind:string,start:int,end:int>>"
    return common.map_texts(df, {id_col: common.column(df, id_col)}, common.text_or_empty(df, text_col), f"base {kind}, spans {kind}", factory)


def mask(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with each span of its texts replaced by <KIND>; overlapping spans by the first's.

    Null texts stay null. ``length_col``, if the table has it, gets the new length.
    All other columns stay, whatever their names. Repeated rows are masked alike; an empty table stays empty.
    """

    def factory():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([masked(t) for t in texts.to_pylist()], pa.string())]

        return work

    others = [c for c in df.columns if c != text_col]
    keep = {f"c{i}": common.column(df, c) for i, c in enumerate(others)} | {"missing": common.column(df, text_col).isNull()}
    made = common.map_texts(df, keep, common.text_or_empty(df, text_col), "masked string", factory)
    text = F.when(~F.col("missing"), F.col("masked"))
    columns = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: text}
    if length_col in columns:
        own = df.schema[length_col].dataType
        columns[length_col] = F.when(text.isNotNull(), F.char_length(text)).otherwise(columns[length_col]).cast(own)
    return made.select(*[columns[c].alias(c) for c in df.columns])


def masked(text: str) -> str:
    out, at = [], 0
    for a, k, b in find_all(text)[1]:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]]) if out else text
