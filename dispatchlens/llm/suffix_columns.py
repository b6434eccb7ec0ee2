"""Removal of repeated byte strings by column-wise multi-document sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere else
is found exactly.

1. **Anchors.** Of the hashes of all ``SEED``-byte strings inside a ``length``-byte
   string, the least marks an anchor.  It depends on the string alone, so two equal
   strings have anchors of equal hash at equal places, and only anchors whose hash
   occurs twice can lie in a repeat.  The bytes around an anchor that can share a
   string with it, ``2 * length - SEED`` of them, are its context.
2. **Equal contexts** enter the collection once, with their number; counts are
   combined before the shuffle, so copies of a document cost one row a partition.
3. **Columns.** Contexts of one anchor hash, aligned at the anchor, form a
   collection of strings.  From the last column to the first each string inserts one
   symbol: the order of all suffixes that start in the column follows from the last
   round by the Burrows-Wheeler (last-to-first) step, a stable sort by the new
   symbol, and the common prefixes of neighbours from range minima.  Neighbours that
   share ``length`` symbols are repeated strings.  Strings that start in different
   columns have different anchors and are never compared, so each round keeps its
   own column of the transform and costs the number of strings, not the text so far.
   Spark's sorted shuffle partitions are the sequential files that rounds read.
4. **Large collections** (over ``max_strings`` contexts) are dealt anew: the range of
   columns is halved, and a half goes to the collection of the bytes that all its
   strings share.  Equal spans leave the search at once and lone strings too, until
   the collections are small or a half is a single string.

Defined results: a null or empty text has no bytes; texts shorter than ``length``
are never touched; equal rows repeat each other, and a repeated row is judged like
its twins; a null doc_id is a key of its own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .text import BASE, BYTE_VALUE, MIX, flat, hashes, mix64, slices

LENGTH, SEED = 200, 64
MAX_STRINGS = 4_096
CHUNK = 8_192
CONTEXT_BASE, CONTEXT_VALUE = BASE + np.uint64(0x5DEECE66C), mix64(BYTE_VALUE)
ROW = ["k_id", "k_text"]
#: Bytes of text that a task works on at once; results do not depend on it.
SLICE = 1 << 18


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The text with a key of its row: equal rows share it, others differ in id or in the text's hash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k_id"),
                       F.xxhash64(text).alias("k_text"), F.coalesce(text, F.lit("")).alias("k_body"))


def sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of each n neighbours."""
    span, out = 1, x
    while 2 * span <= n:
        out = pick(out[:-span], out[span:])
        span *= 2
    return out if span == n else pick(out[:len(x) - n + 1], out[n - span:n - span + len(x) - n + 1])


def anchors_of(data: np.ndarray, limits: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place, seed hash and context hash of every anchor."""
    n, span = len(data), length - SEED + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    at = np.arange(n - SEED + 1)
    seed = hashes(data, at, at + SEED, BYTE_VALUE)
    least = (seed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    end_of = np.repeat(limits[1:], np.diff(limits))
    whole = (end_of[:n - length + 1] - at[:n - length + 1]) >= length
    low = np.zeros(n - SEED + span, np.uint32)
    low[span - 1:span - 1 + len(whole)] = np.where(whole, sliding(least, span, np.minimum), 0)
    picked = np.flatnonzero(least == sliding(low, span, np.maximum))
    row = np.searchsorted(limits, picked, "right") - 1
    a = np.maximum(picked + SEED - length, limits[row])
    b = np.minimum(picked + length, limits[row + 1])
    context = hashes(data, a, b, CONTEXT_VALUE, CONTEXT_BASE)
    context = mix64(context + (picked - a).astype(np.uint64) * MIX + (b - picked).astype(np.uint64))
    return row, picked - limits[row], seed[picked].view(np.int64), context.view(np.int64)


def anchors(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            row, place, seed, context = anchors_of(*flat(part.column("k_body")), length)
            keys = [part.column(k).take(pa.array(row)) for k in ROW]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(place.astype(np.int32)), pa.array(seed), pa.array(context)],
                                             names=[*ROW, "place", "seed", "context"])

    return rows.where(F.octet_length("k_body") >= length).mapInArrow(
        run, "k_id long, k_text long, place int, seed long, context long")


def contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted context, where in it the text begins, and its place in the text."""
    lists = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("place", "seed")).alias("wanted"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            data, limits = flat(part.column("k_body"))
            lists = part.column("wanted")
            row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
            items = lists.flatten()
            place = items.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
            start = place + SEED - length
            raw, size = data.tobytes(), np.diff(limits)[row]
            a, b = np.maximum(start, 0), np.minimum(place + length, size)
            body = [raw[x:y] for x, y in zip((a + limits[row]).tolist(), (b + limits[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k).take(pa.array(row)) for k in ROW), pa.array(start), items.field("seed"),
                 pa.array((a - start).astype(np.int32)), pa.array(body, pa.binary())],
                names=[*ROW, "start", "seed", "skip", "body"])

    return rows.join(lists, ROW).select(*ROW, "k_body", "wanted").mapInArrow(
        run, "k_id long, k_text long, start long, seed long, skip int, body binary")


def repeated_columns(group: np.ndarray, text: np.ndarray, skip: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """For strings in rising ``group`` order, which ``length``-symbol strings of the columns occur twice in the group.

    ``text`` has a row for each column; a string's symbols lie in columns ``skip`` to ``end``.
    """
    n, width = len(group), len(text)
    order, prefix = np.arange(n), np.zeros(n + 1, np.int64)
    found = np.zeros((width - length + 1, n), bool)
    base = group.astype(np.int64) * 257
    for column in range(width - 1, -1, -1):
        symbol = np.where((skip <= column) & (column < end), text[column].astype(np.int64), 256)
        key = (base + symbol)[order]
        step = np.argsort(key, kind="stable")
        key = key[step]
        same = (key[1:] == key[:-1]) & (key[1:] % 257 != 256)
        between = np.column_stack([step[:-1][same] + 1, step[1:][same] + 1]).ravel()
        order = order[step]
        shared = np.zeros(n + 1, np.int64)
        if len(between):
            shared[1:n][same] = np.minimum.reduceat(prefix, between)[::2] + 1
        prefix = shared
        if column <= width - length:
            twice = np.flatnonzero(prefix[:n] >= length)
            found[column, order[twice]] = True
            found[column, order[twice - 1]] = True
    return found


def column_search(strings: DataFrame, length: int) -> DataFrame:
    """Repeated spans of strings that are sorted by collection: row key, first and last byte of a run."""
    width, span = 2 * length - SEED, length - SEED + 1

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        data, limits = flat_binary(batch.column("body"))
        skip = batch.column("skip").to_numpy().astype(np.int64)
        sizes = np.diff(limits)
        grid = np.zeros((n, width), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        grid[row, np.arange(len(data)) - limits[row] + skip[row]] = data
        bucket = batch.column("bucket").to_numpy()
        group = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
        found = repeated_columns(group, np.ascontiguousarray(grid.T), skip, skip + sizes, length)
        found = np.vstack([found, np.zeros((1, n), bool)])
        low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
        column = np.arange(span + 1)[:, None]
        found &= (column >= low) & (column <= high)
        edge = np.diff(found.astype(np.int8), axis=0, prepend=0)
        who, first = np.nonzero(edge.T == 1)
        last = np.nonzero(edge.T == -1)[1]
        start = batch.column("start").to_numpy()[who]
        keys = [batch.column(k).take(pa.array(who)) for k in ROW]
        return pa.RecordBatch.from_arrays([*keys, pa.array(start + first), pa.array(start + last - 1 + length)],
                                          names=[*ROW, "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if left is not None:
                batch = pa.concat_batches([left, batch])
            bucket = batch.column("bucket").to_numpy()
            at = 0
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            while len(cuts) and cuts[-1] > at:  # whole collections, about CHUNK strings at a time
                to = cuts[max(0, np.searchsorted(cuts, at + CHUNK, "right") - 1)]
                to = int(to if to > at else cuts[np.searchsorted(cuts, at, "right")])
                yield solve(batch.slice(at, to - at))
                at = to
            left = batch.slice(at)
        if left is not None and left.num_rows:
            yield solve(left)

    return strings.select(*ROW, "start", "skip", "body", "bucket", "low", "high").repartition("bucket") \
        .sortWithinPartitions("bucket").mapInArrow(run, "k_id long, k_text long, a long, b long")


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[limits[0]:limits[-1]], limits - limits[0]


def halves(strings: DataFrame, length: int) -> DataFrame:
    """Each string once for each half of its columns, with the collection of the bytes common to the half."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    split = F.array(F.struct(F.col("low"), middle.alias("high")),
                    F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    out = strings.withColumn("half", F.explode(split)).withColumns({"low": F.col("half.low"), "high": F.col("half.high")})
    out = out.drop("half").where("low <= high")

    def piece(a: Column, b: Column) -> Column:  # bytes in columns a to b, as far as the text goes
        first = F.greatest(a - F.col("skip"), F.lit(0))
        return F.substring("body", first + 1, F.greatest(b - F.col("skip") - first, F.lit(0)))

    whole = (F.greatest("low", "skip") + length <= F.least(F.col("high") + length, F.col("skip") + F.octet_length("body")))
    out = out.where(whole)
    shared, span = piece(F.col("high"), F.col("low") + length), piece(F.col("low"), F.col("high") + length)
    return out.withColumns({"bucket": F.xxhash64("bucket", "low", "high", shared),
                            "span": F.xxhash64("low", F.greatest("skip", "low"), span, shared)})


def clipped(strings: DataFrame, length: int) -> DataFrame:
    """Row key and the bytes of the range of columns that lie in the text."""
    first, last = F.greatest("low", "skip"), F.least(F.col("high") + length, F.col("skip") + F.octet_length("body"))
    return strings.select(*ROW, (F.col("start") + first).alias("a"), (F.col("start") + last).alias("b"))


def searched(strings: DataFrame, length: int, max_strings: int) -> DataFrame:
    """Repeated spans of all strings, with large collections dealt anew."""
    parts = []
    while True:
        sizes = strings.groupBy("bucket").agg(F.count("*").alias("strings"))
        large = stored(sizes.where(F.col("strings") > max_strings).select("bucket"))
        if large.isEmpty():
            parts.append(column_search(strings, length))
            break
        parts.append(column_search(strings.join(large, "bucket", "left_anti"), length))
        half = stored(halves(strings.join(large, "bucket"), length))
        spans = half.groupBy("bucket", "span").agg(F.count("*").alias("same"))
        twice = spans.where("same > 1").select("bucket", "span")
        parts.append(clipped(half.join(twice, ["bucket", "span"]), length))
        partners = stored(spans.groupBy("bucket").agg(F.count("*").alias("spans")).where("spans > 1").select("bucket"))
        # One string for each span: those that occur twice are settled and stay as partners.
        fields = [c for c in half.columns if c not in ("bucket", "span")]
        one = half.groupBy("bucket", "span").agg(F.min(F.struct(*fields)).alias("s")).select("bucket", "s.*")
        strings = stored(one.join(partners, "bucket"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, max_strings: int = MAX_STRINGS) -> DataFrame:
    """Key of each row with a repeated string and its spans [a, b) of bytes, in any order and overlapping."""
    rows = keyed(docs, text)
    marks = stored(anchors(rows, length))
    seeds = marks.groupBy("seed").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"))
    # Stored, so that the join has an exchange on both sides and Spark can split hot seeds.
    seeds = stored(seeds.where("n > 1").select("seed", (F.col("c0") != F.col("c1")).alias("mixed")))
    twice = stored(marks.join(seeds, "seed"))
    mixed = twice.where("mixed").drop("mixed")
    distinct = stored(mixed.groupBy("seed", "context").agg(
        F.count("*").alias("n"), F.min(F.struct(*ROW, "place")).alias("at")).select("seed", "context", "n", "at.*"))
    copies = mixed.join(distinct.where("n > 1").select("seed", "context"), ["seed", "context"])
    strings = stored(contexts(rows, distinct, length).withColumnsRenamed({"seed": "bucket"}).withColumns(
        {"low": F.lit(0), "high": F.lit(length - SEED)}).dropDuplicates(["bucket", *ROW, "start"]))
    equal = twice.where("not mixed").select(*ROW, "place").unionByName(copies.select(*ROW, "place"))
    equal = equal.select(*ROW, F.greatest(F.col("place") + SEED - length, F.lit(0)).cast("long").alias("a"),
                         (F.col("place") + length).cast("long").alias("b"))
    spans = equal.unionByName(searched(strings, length, max_strings))
    return spans.groupBy(*ROW).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def cut(body: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many went and in how many runs."""
    kept, at, gone, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        b = min(b, len(body))
        if b <= end:
            continue
        if a > end:
            runs += 1
            kept.append(body[at:a])
            gone += b - a
        else:
            gone += b - end
        at = end = b
    kept.append(body[at:])
    return b"".join(kept), gone, runs


def span_lists(part: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    return [[(x["a"], x["b"]) for x in spans or ()] for spans in part.column("spans").to_pylist()]


def marked(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """Every row of ``docs``, as it is, beside the spans of its key."""
    left = docs.withColumns({"k_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "k_text": F.xxhash64(text)})
    return left.join(found, ROW, "left")


def digest(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and counts of each row's bytes, removed bytes and runs, and the hash of what is left."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            data, limits = flat(part.column("k_body"))
            raw, out = data.tobytes(), []
            for a, b, spans in zip(limits[:-1].tolist(), limits[1:].tolist(), span_lists(part), strict=True):
                kept, gone, runs = cut(raw[a:b], spans)
                out.append((b - a, gone, runs, hashlib.sha256(kept).hexdigest()))
            columns = [list(x) for x in zip(*out, strict=True)] if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = marked(docs.select("doc_id", F.col(text).alias("k_body")), found, "k_body")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "k_body", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; the columns stay.

    A code point that lost some of its bytes goes wholly.  A row of whose text only
    white space is left is dropped if something was cut from it.
    """
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            texts, bodies = part.column("k_body").to_pylist(), []
            for body, spans in zip(texts, span_lists(part), strict=True):
                bodies.append(cut(body.encode(), spans)[0].decode("utf-8", "ignore") if spans else body)
            stay = [not was or was == now or bool(now.strip()) for was, now in zip(texts, bodies, strict=True)]
            columns = [pa.array(bodies, part.column("k_body").type) if name == "k_body" else part.column(name)
                       for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    renamed = docs.select(*(F.col(f.name).alias("k_body" if f.name == text else f"c_{i}") for i, f in enumerate(schema)),
                          F.col("doc_id").alias("doc_id"))
    names = renamed.columns[:-1]
    rows = marked(renamed, repeats(docs, text, length), "k_body")
    out = rows.select(*names, "spans").mapInArrow(run, renamed.select(*names).schema)
    return out.toDF(*schema.names)
