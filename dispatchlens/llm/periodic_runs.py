"""Runs of repeated words: stretches of a text that repeat with a period.

A run is a stretch of consecutive words whose words ``period`` apart are equal,
that no neighbouring word extends, of at least ``REPEATS`` periods and ``LEAST``
words; its period is the smallest that the stretch has.

Periods up to ``SHORT`` are scanned lag by lag.  Longer ones go by scales: the scale
(low, high] hashes all word groups of ``high`` words and keeps the minimum of every
window of ``high`` groups.  Inside a run of a period of that scale a group of words
occurs once a period, so the window minima are the occurrences of one group, a period
apart.  A scale spans a factor of 1.5, so that four periods always hold two windows
with different occurrences: no run can be missed.  Neighbouring equal minima at a
distance inside the scale are seeds.  A seed is extended to both sides by comparing
hashes of growing stretches, and what it yields is compared word by word.

Words are compared as 64-bit hashes of their bytes.

Defined results: null and empty texts have no words and no runs; documents of equal
text have equal runs, each row its own; a null ``doc_id`` stays null; other columns
are not read, whatever their names.  A text is worked on whole, in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import per_row
from .text import BYTE_VALUE, MIX, SOLID, flat, hashes, mix64, powers, words

REPEATS, LEAST, SHORT = 4, 6, 12
SLICE = 1 << 20


class Sequences:
    """Word hashes of several texts end to end, with hashes of their stretches."""

    def __init__(self, word: np.ndarray, at: np.ndarray):
        self.word, self.at = word, at
        self.owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * powers(MIX, len(word)), out=self.sums[1:])
        self.doubled, self.size = word, 1

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i and from j (i < j) are equal, by hash."""
        here, there = self.sums[i + n] - self.sums[i], self.sums[j + n] - self.sums[j]
        return here * powers(MIX, len(self.word) + 1)[j - i] == there

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i and j on (or before them) are equal, ``most`` at most."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i - mid, j - mid, mid) if back else self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def groups(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on; n must not fall from call to call.

        Doubled sizes are mixed from two halves, any other from the two doubled ones
        that cover it, so that no arrangement of words makes hashes collide.
        """
        while 2 * self.size <= n:
            self.doubled = mix64(self.doubled[:-self.size] * MIX + self.doubled[self.size:])
            self.size *= 2
        shift, count = n - self.size, len(self.word) - n + 1
        return mix64(self.doubled[:count] * MIX + self.doubled[shift:shift + count])


def least_places(value: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost least value of every window of ``width`` values, each once, ascending."""
    bits = max(1, int(len(value)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    packed = (mix64(value) & ~mask) | np.arange(len(value), dtype=np.uint64)
    blocks = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(value)] = packed
    blocks = blocks.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(value) - width + 1
    place = (np.minimum(onward[:n], upto[width - 1:width - 1 + n]) & mask).astype(np.int64)
    return place[np.concatenate([[True], place[1:] != place[:-1]])]


def stretches(word: np.ndarray, at: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and lag of what repeats at one lag, by comparing all words."""
    same = np.zeros(max(0, len(word) - lag) + 2, np.int8)
    same[1:-1] = word[:-lag] == word[lag:]
    for k in range(1, lag + 1) if len(at) > 2 else ():  # pairs across the border of two texts
        cross = at[1:-1] - k
        same[1 + cross[(cross >= 0) & (cross < len(same) - 2)]] = 0
    turn = np.diff(same)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    length = end - start + lag
    ok = length >= max(LEAST, REPEATS * lag)
    return start[ok], length[ok], np.full(ok.sum(), lag)


def short_runs(seq: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and lag of the stretches that repeat at a lag of up to ``SHORT``."""
    found = []
    for lag in range(1, min(SHORT, len(seq.word) - 1) + 1):
        found.append(stretches(seq.word, seq.at, lag))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def scales(longest: int) -> list[tuple[int, int]]:
    """(low, high] for the periods over ``SHORT`` that a text of ``longest`` words can hold."""
    out, low = [], SHORT
    while REPEATS * (low + 1) <= longest:
        high = (3 * low + 4) // 2
        out.append((low, high))
        low = high
    return out


def long_runs(seq: Sequences, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and lag of the stretches that repeat at a lag in (low, high]."""
    none = (np.zeros(0, np.int64),) * 3
    if len(seq.word) < 2 * high:
        high = len(seq.word) // 2
        if high <= low:
            return none
    group = seq.groups(high)
    at = least_places(group, min(high, len(group)))
    order = np.argsort(group[at], kind="stable")
    i, j = at[order[:-1]], at[order[1:]]
    lag = j - i
    ok = (group[i] == group[j]) & (lag > low) & (lag <= high)
    ok[ok] = seq.owner[i[ok]] == seq.owner[j[ok]]
    if not ok.any():
        return none
    i, j, lag = i[ok], j[ok], lag[ok]
    text = seq.owner[i]
    start = i - seq.common(i, j, i - seq.at[text], back=True)
    length = j + seq.common(i, j, seq.at[text + 1] - j, back=False) - start
    ok = length >= np.maximum(LEAST, REPEATS * lag)
    found = np.unique(np.stack([start[ok], length[ok], lag[ok]]), axis=1)
    # Equal hashes may be of unequal stretches, never the reverse: what differs is looked up lag by lag.
    good = np.array([np.array_equal(seq.word[s:s + n - q], seq.word[s + q:s + n]) for s, n, q in found.T], bool)
    if not good.all():
        again = [found[:, good]]
        for t, q in {(int(seq.owner[s]), int(q)) for s, _, q in found[:, ~good].T}:
            a, b = seq.at[t], seq.at[t + 1]
            s, n, q = stretches(seq.word[a:b], np.array([0, b - a]), q)
            again.append(np.stack([s + a, n, q]))
        found = np.unique(np.concatenate(again, axis=1), axis=1)
    return tuple(found)


def prime_parts(n: int) -> list[int]:
    """The prime divisors of n."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def smallest(period: np.ndarray, lag: int) -> bool:
    """Whether these ``lag`` words, repeated, have no smaller period: it would divide ``lag``."""
    return not any(np.array_equal(period[:-d], period[d:]) for d in (lag // p for p in prime_parts(lag)))


def find_runs(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it, length and period of all runs, ordered by text, start and period.

    ``word`` are the word hashes of all texts end to end, ``at`` the texts' limits.
    """
    count = np.diff(at)
    seq = Sequences(word, at)
    found = [np.stack([seq.owner[s], s - at[seq.owner[s]], n, q]) for s, n, q in [short_runs(seq)]]
    for low, high in scales(int(count.max(initial=0))):
        few = np.flatnonzero(count >= REPEATS * (low + 1))
        if len(few) < len(seq.at) - 1:  # only the texts that can hold such a period
            inside = np.repeat(count >= REPEATS * (low + 1), count)
            seq = Sequences(word[inside], np.concatenate([[0], np.cumsum(count[few])]))
        start, length, lag = long_runs(seq, low, high)
        text = seq.owner[start]
        found.append(np.stack([few[text], start - seq.at[text], length, lag]))
    text, start, length, lag = np.concatenate(found, axis=1)
    ok = np.array([smallest(word[i:i + q], q) for i, q in zip((at[text] + start).tolist(), lag.tolist())], bool)
    text, start, length, lag = (x[ok] for x in (text, start, length, lag))
    order = np.lexsort((lag, start, text))
    return text[order], start[order], length[order], lag[order]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words with one blank between them."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))[kept]
    first, size = starts[kept], ends[kept] - starts[kept] + 1
    after = np.cumsum(size)
    place = np.arange(after[-1] if len(after) else 0) + np.repeat(first - (after - size), size)
    out = data[np.minimum(place, len(data) - 1)] if len(place) else np.zeros(0, np.uint8)
    out[after - 1] = 32
    # The blank after a text's last word goes.
    last = np.zeros(len(out), bool)
    if len(owner):
        last[after[np.flatnonzero(np.append(owner[1:] != owner[:-1], True))] - 1] = True
    length = np.bincount(owner, size, n).astype(np.int64)
    length[length > 0] -= 1
    limits = np.concatenate([[0], np.cumsum(length)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(out[~last].tobytes())) \
        .cast(pa.string())


def repeated_tail(at: np.ndarray, seed: list[int | None]) -> np.ndarray:
    """The word that stands at each place once texts whose seed ends in 0 repeat a part of themselves to their end."""
    source = np.arange(at[-1])
    for k, h in enumerate(seed):
        n = int(at[k + 1] - at[k])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[at[k] + a:at[k + 1]] = at[k] + a + np.arange(n - a) % p
    return source


def annotated(docs: DataFrame, text: str = "text", plant: Column | None = None) -> DataFrame:
    """``doc_id``, n_words, its ``runs`` (array of start, length, period by start, period) and its ``collapsed`` text.

    The collapsed text holds the words that no run contains after its first
    period, one blank apart.  ``plant`` is a seed for each row, see ``repeated_tail``.
    """
    def work(part: pa.RecordBatch) -> list:
        data, limits = flat(part.column("k_body"))
        starts, ends, at = words(data, limits, SOLID)
        word = hashes(data, starts, ends, BYTE_VALUE)
        source = repeated_tail(at, part.column("k_seed").to_pylist())
        word, starts, ends = word[source], starts[source], ends[source]
        owner, start, length, period = find_runs(word, at)
        step = np.zeros(len(word) + 1, np.int64)
        np.add.at(step, at[owner] + start + period, 1)
        np.add.at(step, at[owner] + start + length, -1)
        kept = np.cumsum(step)[:-1] == 0
        items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)],
                                           names=["start", "length", "period"])
        n = len(at) - 1
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), items)
        return [np.diff(at).astype(np.int64), lists, joined(data, starts, ends, at, kept)]

    rows = docs.select("doc_id", (F.lit(None).cast("long") if plant is None else plant).alias("k_seed"),
                       F.col(text).alias("k_body"))
    return per_row(rows, "k_body", ["doc_id", "k_seed"],
                   "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
                   work, SLICE).drop("k_seed")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run of greatest length / period, and hashes of all runs and of the collapsed text."""
    def greater(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    best = F.reduce("runs", F.get("runs", F.lit(0)), greater)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
