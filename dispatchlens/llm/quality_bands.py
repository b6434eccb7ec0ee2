"""Quality rules by compression bands.

A text that Zstandard shrinks far more than prose of its length repeats itself;
one that hardly shrinks is noise.  The ratio falls with length, so the limits
depend on it.  The ratio of the whole text and the ratios of its fixed chunks are
held against them: a text fails if its own ratio is outside the band of its
length, or if more than half of its full chunks are outside the chunk band.

Counts of words, symbols, repeated lines and repeated 8-word windows come with
the verdict; texts with fewer than 20 words, or with over 30 % of their words in
repeated windows, fail whatever their ratio.

Defined results: a null or empty text has no words and fails; rows are judged one
by one, so repeated rows, ties and empty tables need no rule; other columns are
passed on untouched and never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .tables import per_row
from .text import MIX, flat, mix64, slices

#: Fixed values. Upper limit of the UTF-8 length, smallest and largest ratio.
BANDS = ((150, 0.0, 1.5), (300, 0.45, 0.98), (600, 0.42, 0.92), (1_200, 0.44, 0.85), (2_500, 0.43, 0.75),
         (5_000, 0.42, 0.65), (10_000, 0.40, 0.60), (30_000, 0.375, 0.58), (1 << 62, 0.33, 0.56))
CHUNK = 2_048
CHUNK_BAND = (0.455, 0.85)
LEVEL = 3
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, kept boolean, ratio double, odd_chunks double")


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside windows of ``n`` words that occur at least twice.  Hashes find, words decide."""
    if len(words) <= n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        windows = windows * MIX + h[k:k + len(windows)]
    windows = mix64(windows)
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    seen: dict[tuple, list[int]] = {}
    for at in np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist():
        seen.setdefault(tuple(words[at:at + n]), []).append(at)
    cover = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(cover, places, 1)
            np.add.at(cover, np.array(places) + n, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    n_words, chars = len(words), len(text.translate(None, SPACES)) - sum_continuation(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEATED * n_words
    ratio = len(zstd.compress(text)) / len(text) if text else 0.0
    low, high = next((a, b) for limit, a, b in BANDS if len(text) < limit)
    chunks = [len(zstd.compress(text[k:k + CHUNK])) / CHUNK for k in range(0, len(text) - CHUNK + 1, CHUNK)]
    odd = sum(not CHUNK_BAND[0] <= x <= CHUNK_BAND[1] for x in chunks) / max(1, len(chunks))
    kept = not failed and low <= ratio <= high and odd <= 0.5
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return n_words, chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept, ratio, odd


def sum_continuation(text: bytes) -> int:
    """UTF-8 bytes that continue a code point."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


def measures(column: pa.Array) -> list[list]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    data, limits = flat(column)
    raw = data.tobytes()
    rows = [measure(raw[a:b], zstd) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
    return [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in MEASURES.split(",")]


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: ``keep`` columns, the measures and the verdict ``kept``."""
    return per_row(docs, text, list(keep), MEASURES, lambda part: measures(part.column(text)))


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield part.filter(pa.array(measures(part.column(text))[6], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
