"""Runs of words that repeat with a period, found through string synchronising sets.

A run is a stretch of words with smallest period q that is at least ``max(least, 4 q)`` words long and that no
neighbouring word extends keeping the period. ``find`` gives every run of many texts at once; they lie in one array, with
a word of its own between neighbours, so that nothing repeats across them.

Periods 1 to 3 are read off directly, by comparing the words with those 1 to 3 places on. For periods from t to 2t - 1,
t = 4, 8, 16 ..., the synchronising set of scale t holds the places i at which the least hash of the t-word fragments that
begin at i to i + t is that at i or at i + t. Whether i belongs to it depends on the 2t words from i only, so a stretch of
period q is synchronised with period q. Fragments with a period of t / 4 or less are left out of the hashes, or else a
stretch of such a period would put all its places into the set. They are the parts of the runs that the smaller scales
found, and those runs are reported there: the sets omit only what has been supplied already. Every t places in a run
of a period from t on hold a synchronising place, unless 3t - 1 words in a row have a period of t / 4 or less, and then
by Fine and Wilf the run's period would be that one. So in such a run, 4q words or longer, two neighbouring synchronising
places with equal 2t-word contexts are q apart; a smaller distance would be a smaller period. Such pairs propose periods.
A proposal is measured in steps of t words by fragment hashes, and if it may reach 4q, word by word to its exact ends.

Hashes have 64 bits. A collision could hide a run, with a probability below 10^-6 in a text of ten million words; it
cannot make one up, as the ends are found on the words. Work grows with n log n, memory with n; texts are taken together
up to about ``group_words`` words, a longer text by itself.

Defined cases: a null or empty text has no words and no run; a text is one row of one task, whatever its length; repeated
rows and rows without an identifier get answers of their own; an empty table gives an empty result; other columns are
ignored by ``mark`` and passed through by ``collapse``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many periods make a run.
POWER = 4
#: Periods below this are read off directly.
FIRST_SCALE = 4
Run = tuple[int, int, int]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours: from the least so far of blocks of n, forwards and backwards."""
    blocks = -(-len(x) // n)
    padded = np.full(blocks * n, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, n)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: len(x) - n + 1], forward[n - 1 : len(x)])


class Words:
    """The words of several texts as numbers, each text followed by a number that comes once."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes + 1)
        self.word = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
        self.word[ends - 1] = codes.max(initial=-1) + 1 + np.arange(len(sizes))
        self.word[self.word < 0] = codes
        self.text = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.start = ends - sizes - 1
        self.size = sizes
        self.runs: dict[int, list[Run]] = {}
        self.periodic: list[tuple[int, int, int]] = []  # (first, end, period) of all runs, in places of the array

    def extent(self, i: int, q: int) -> tuple[int, int]:
        """First place and end of the stretch of period ``q`` around the equal words at i and i + q."""
        word = self.word
        hi, step = i, 64
        while True:
            n = min(step, len(word) - q - hi)
            unlike = np.flatnonzero(word[hi : hi + n] != word[hi + q : hi + q + n])
            hi += int(unlike[0]) if len(unlike) else n
            if len(unlike) or n < step:
                break
            step *= 2
        lo, step = i, 64
        while True:
            n = min(step, lo)
            unlike = np.flatnonzero(word[lo - n : lo] != word[lo - n + q : lo + q])
            lo -= n - 1 - int(unlike[-1]) if len(unlike) else n
            if len(unlike) or n < step:
                break
            step *= 2
        return lo, hi + q

    def add(self, lo: int, hi: int, q: int, least: int) -> None:
        self.periodic.append((lo, hi, q))
        if hi - lo >= least:
            t = int(self.text[lo])
            self.runs.setdefault(t, []).append((lo - int(self.start[t]), hi - lo, q))


def small_periods(w: Words, least: int) -> None:
    """Stretches of periods 1 to 3, directly."""
    for q in range(1, FIRST_SCALE):
        equal = np.concatenate([[False], w.word[:-q] == w.word[q:], [False]])
        change = np.flatnonzero(equal[1:] != equal[:-1])
        lo, hi = change[0::2], change[1::2] + q
        long = hi - lo >= POWER * q
        for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
            if q == 1 or w.word[a] != w.word[a + 1] or not (w.word[a : b - 1] == w.word[a + 1 : b]).all():
                w.add(a, b, q, least)


def find(codes: np.ndarray, sizes: np.ndarray, least: int = 6) -> list[list[Run]]:
    """For each text, given its words' numbers in a row, its runs (start, length, period) in order."""
    w = Words(codes, sizes)
    if len(codes):
        small_periods(w, least)
        hashed = mixed(w.word.astype(np.uint64) + np.uint64(1))
        for k in (1, 2):  # hashes of 2 words, then of 4
            hashed = doubled(hashed, k)
        place, t = np.arange(len(w.word)), FIRST_SCALE
        while True:
            keep = (w.size >= POWER * t)[w.text[place]]  # only those can hold a run of this scale
            place, hashed = place[keep], hashed[keep]
            if not len(place):
                break
            longer = doubled(hashed, t)
            scale(w, place, hashed, longer, t, least)
            hashed, t = longer, 2 * t
    return [sorted(w.runs.get(i, [])) for i in range(len(sizes))]


def doubled(hashed: np.ndarray, t: int) -> np.ndarray:
    """Hashes of the 2t words from each place, from those of t words; where there are fewer, the array's end is meant."""
    later = np.zeros_like(hashed)
    later[:-t] = hashed[t:]
    return mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + mixed(later + np.uint64(t)))


def scale(w: Words, place: np.ndarray, hashed: np.ndarray, context: np.ndarray, t: int, least: int) -> None:
    """Add the runs of periods t to 2t - 1. ``place`` are the words that still count, whole texts of them; ``hashed``
    and ``context`` the hashes of the t and 2t words from each."""
    n = len(place)
    if n < POWER * t:
        return
    order = hashed.copy()
    # fragments of a small period: t words within a run of a period of t / 4 or less
    inside = np.zeros(n + 1, np.int32)
    for lo, hi, q in w.periodic:
        if POWER * q <= t and hi - lo >= t:
            at = int(np.searchsorted(place, lo))
            if at < n and place[at] == lo:
                inside[at] += 1
                inside[at + hi - lo - t + 1] -= 1
    out = np.iinfo(np.uint64).max
    order[np.cumsum(inside[:-1]) > 0] = out
    lowest = window_least(order, t + 1)  # of the fragments at i to i + t
    m = len(lowest)
    chosen = np.flatnonzero(((lowest == order[:m]) | (lowest == order[t : t + m])) & (lowest != out))
    # neighbours with equal contexts: a stable sort leaves equal ones in the order of their places
    by = np.argsort(context[chosen], kind="stable")
    i, j = chosen[by[:-1]], chosen[by[1:]]
    q = j - i
    pair = (context[i] == context[j]) & (q >= t) & (q < 2 * t)
    i, q = i[pair], q[pair]
    if not len(i):
        return
    # whole steps of t words that are equal to the right and to the left; more than 3q are not needed
    reach = np.zeros(len(i), np.int64)
    for sign in (1, -1):
        going = np.arange(len(i))
        at = i if sign > 0 else i - t
        for _ in range((POWER - 1) * 2):
            here = at[going]
            fits = (here >= 0) & (here + q[going] + t <= n)
            going, here = going[fits], here[fits]
            going = going[hashed[here] == hashed[here + q[going]]]
            if not len(going):
                break
            reach[going] += t
            at = at + sign * t
    may = reach + 2 * (t - 1) >= (POWER - 1) * q
    i, q = i[may], q[may]
    first = place[i]
    known: dict[int, int] = {}  # of each period, the end of the stretch found last
    for k in np.lexsort((first, q)).tolist():
        a, d = int(first[k]), int(q[k])
        if a < known.get(d, -1):
            continue
        lo, hi = w.extent(a, d)
        known[d] = hi - d
        if hi - lo >= POWER * d:
            w.add(lo, hi, d, least)


def words_of(text: bytes | None) -> list[bytes]:
    """The maximal runs of characters other than the space and U+0009 to U+000D."""
    return (text or b"").split()


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those that a run contains after its first period."""
    gone = np.zeros(n + 1, np.int32)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def groups(batches: Iterator[pa.RecordBatch], text: str, group_words: int, least: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[list[Run]]]]:
    """Slices of the batches of about ``group_words`` words, with the words and the runs of their texts."""
    for batch in batches:
        column, at = batch.column(text).cast(pa.binary()), 0
        while at < batch.num_rows:
            words: list[list[bytes]] = []
            total = 0
            while at + len(words) < batch.num_rows and (not words or total < group_words):
                words.append(words_of(column[at + len(words)].as_py()))
                total += len(words[-1])
            codes = pd.factorize(np.array([x for own in words for x in own], dtype=object))[0] if total else np.array([], np.int64)
            yield batch.slice(at, len(words)), words, find(codes.astype(np.int64), np.array([len(x) for x in words], np.int64), least)
            at += len(words)


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 6, group_words: int = 1 << 18) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period) in order, and the text without the words that a run contains
    after its first period, joined by single spaces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from quarry.schemas import struct

    kind = df.schema[id_col].dataType.simpleString()
    spec = struct(f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    schema = to_arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, found in groups(batches, "text", group_words, least):
            collapsed = []
            for own, runs in zip(words, found, strict=True):
                if runs:
                    own = [own[i] for i in np.flatnonzero(kept(len(own), runs)).tolist()]
                collapsed.append(b" ".join(own).decode())
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
            made = [part.column("id"), pa.array([len(x) for x in words], pa.int64()), pa.array(rows, schema.field("runs").type), pa.array(collapsed, schema.field("collapsed").type)]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, spec)


def collapse(df: DataFrame, text_col: str = "text", *, least: int = 6, group_words: int = 1 << 18) -> DataFrame:
    """``df`` with its texts' runs cut to their first period; a text without a run stays as it is, white space too."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, found in groups(batches, text_col, group_words, least):
            texts = part.column(text_col).to_pylist()
            for k, runs in enumerate(found):
                if runs:
                    texts[k] = b" ".join(words[k][i] for i in np.flatnonzero(kept(len(words[k]), runs)).tolist()).decode()
            columns = [pa.array(texts, schema.field(c).type) if c == text_col else part.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, df.schema)
