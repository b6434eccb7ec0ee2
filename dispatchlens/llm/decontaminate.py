"""Benchmark decontamination with sparse suffix arrays over the training text.

Each run of training rows (a shard) is turned into words.  The positions whose
first words (up to ``LEAD``) also begin some benchmark window are kept and sorted
by the words that follow: the shard's suffix array.  Every window of every
benchmark item, that is every test suffix cut to ``window`` words, is then binary
searched; the range found holds all its places.  Windows that follow each other
in both texts join into longest verbatim matches.

Shards are runs of rows, so no key is shuffled and a common passage or a group of
copies costs its own rows only.  The benchmark is sent to the executors in blocks
of at most ``block_bytes`` (measured first); with several blocks the rows pass one
search after the other, each in workers of its own, and gather their matches.

Defined results: null and empty texts have no words, hence no match; an item of
fewer words than ``window`` is one window, one of none has no window; items with
equal text all count; a null item_id reads ``null``; repeated document rows are
judged one by one; an empty benchmark finds nothing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, flat, grams, hashes, slices, within, words

WINDOW, LEAD = 10, 3
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 2 << 20

MATCH = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))


class TestSuffixes:
    """The windows of a block of items, ready for searching."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        data, limits = flat(texts)
        data = LOWER[data]
        raw = data.tobytes()
        starts, ends, at = words(data, limits)
        h = hashes(data, starts, ends)
        found: dict[bytes, list[tuple[str, int]]] = {}
        self.size: dict[bytes, int] = {}
        lead: list[set[int]] = [set() for _ in range(LEAD + 1)]
        lead_hash = [grams(h, q) if q else h for q in range(LEAD + 1)]
        for i, name in enumerate(ids):
            a, b = int(at[i]), int(at[i + 1])
            m = min(window, b - a)
            for x in range(a, b - m + 1) if m else ():
                key = b"".join(raw[s:e] + b" " for s, e in zip(starts[x:x + m], ends[x:x + m], strict=True))
                found.setdefault(key, []).append((name, x - a))
                self.size[key] = m
                q = min(LEAD, m)
                lead[q].add(int(lead_hash[q][x]))
        self.keys = sorted(found)
        self.places = found
        self.lead = [np.array(sorted(s), np.uint64) for s in lead]
        self.bits = []
        for x in self.lead:
            bits = np.zeros(1 << 20, bool)
            bits[x >> np.uint64(44)] = True
            self.bits.append(bits)

    def begins(self, q: int, h: np.ndarray) -> np.ndarray:
        """Positions of ``h`` whose first ``q`` words begin a window."""
        maybe = np.flatnonzero(self.bits[q][h >> np.uint64(44)])
        return maybe[np.isin(h[maybe], self.lead[q])]


def shard_matches(text: pa.Array, test: TestSuffixes, window: int) -> tuple[np.ndarray, list[dict[str, list]]]:
    """Words of each row, and its verbatim matches: item -> [(start word, words)]."""
    data, limits = flat(text)
    data = LOWER[data]
    starts, ends, at = words(data, limits)
    count, total = np.diff(at), len(starts)
    rows: list[dict] = [{} for _ in count]
    if not total or not test.keys:
        return count, rows
    h = hashes(data, starts, ends)
    kept = []
    for q in range(1, LEAD + 1):
        if len(test.lead[q]) and total >= q:
            p = test.begins(q, grams(h, q))
            kept.append(p[within(at, q, total)[p]])
    positions = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    if not len(positions):
        return count, rows
    doc = np.searchsorted(at, positions, "right") - 1
    raw, s, e = data.tobytes(), starts, ends
    suffixes = []
    for p, last in zip(positions.tolist(), np.minimum(positions + window, at[doc + 1]).tolist(), strict=True):
        suffixes.append(b"".join([raw[a:b] + b" " for a, b in zip(s[p:last].tolist(), e[p:last].tolist(), strict=True)]))
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    array = [suffixes[k] for k in order]
    runs: list[dict[tuple[str, int], list[tuple[int, int]]]] = [{} for _ in count]
    for key in test.keys:
        a = bisect_left(array, key)
        if a == len(array) or not array[a].startswith(key):
            continue
        for k in order[a:bisect_left(array, key + b"\xff", a)]:
            p, d = int(positions[k]), int(doc[k])
            for name, x in test.places[key]:
                start = p - int(at[d])
                runs[d].setdefault((name, start - x), []).append((start, test.size[key]))
    for d, found in enumerate(runs):
        for (name, _), places in found.items():
            places.sort()
            joined = rows[d].setdefault(name, [])
            before = None
            for start, m in places:
                if before is not None and start == before + 1:
                    joined[-1] = (joined[-1][0], start + m - joined[-1][0])
                else:
                    joined.append((start, m))
                before = start
    return count, rows


def blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about ``block_bytes`` at most; no item is split."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                             F.coalesce("text", F.lit("")).alias("text")).where("length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def sent_blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator:
    """Each block of the benchmark as a broadcast of ids and texts."""
    for block in blocks(benchmark, block_bytes):
        items = block.toArrow()  # at most about block_bytes
        yield docs.sparkSession.sparkContext.broadcast(
            (items.column("item").to_pylist(), items.column("text").combine_chunks()))


def matches(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of every document, ``n_words`` and its longest verbatim ``matches``."""
    found = docs.select(*keep, F.col("text").alias("_text"), F.lit(0).cast("long").alias("n_words"),
                        F.array().cast("array<struct<item: string, start: long, words: long>>").alias("matches"))
    for sent in sent_blocks(docs, benchmark, block_bytes):
        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(*sent.value, window)
            for part in slices(batches, "_text", SHARD_BYTES):
                count, rows = shard_matches(part.column("_text"), test, window)
                made = [old + [{"item": k, "start": a, "words": m} for k, v in sorted(r.items()) for a, m in v]
                        for old, r in zip(part.column("matches").to_pylist(), rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), part.column("_text"), pa.array(count, pa.int64()), pa.array(made, MATCH)],
                    names=part.schema.names)

        found = found.mapInArrow(run, found.schema)
    return found.drop("_text")


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and the items' hash from ``matches``; native expressions."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("a"),
                                                                   (m["start"] + m["words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(spans, start, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"),
        F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select(
        *keep, "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0).cast("long")).alias("longest_match"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any match, with all their columns."""
    for sent in sent_blocks(docs, benchmark, block_bytes):
        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(*sent.value, window)
            for part in slices(batches, "text", SHARD_BYTES):
                rows = shard_matches(part.column("text"), test, window)[1]
                yield part.filter(pa.array([not r for r in rows], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def sql(window: int = WINDOW) -> str:
    """DuckDB text of ``digest(matches(...))`` but for the longest match."""
    pattern, up, low = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    take = f"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{pattern}')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {take} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {take} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({window}, len(w)) AS m,
              unnest(list_transform(range(0, len(w) - least({window}, len(w)) + 1),
                                    lambda i: array_to_string(w[i + 1:i + least({window}, len(w))], ' '))) AS t
       FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, m, i, array_to_string(w[i + 1:i + m], ' ') AS t
       FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i
             FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.t = bw.t),
place AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t
         FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(place.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(item.t, '')) AS items_sha256,
       coalesce(place.n, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)"""
