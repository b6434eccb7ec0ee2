"""Near-duplicate texts by BagMinHash signatures of word shingles.

A text is a bag of five-word shingles with counts.  Each shingle owns independent
Poisson processes over bands of weight levels (0, 1], (1, 2], (2, 4], (4, 8] ...;
a band's points come at the band's rate, with a level inside the band and one of
``SIZE`` components.  A shingle of count w takes the points of levels up to w: whole
bands below w and, by their level, part of the last.  The earliest point of each
component is the signature, and two bags agree in a component with the probability
of their weighted Jaccard similarity.  Points are drawn in rising order and only
until they can no longer be earliest, so a long text costs about a point a shingle.

Texts of equal word sequence are one node.  Nodes that agree in all ``ROWS``
components of one of ``BANDS`` bands meet in a bucket.  A bucket compares its most
popular node (the one that meets most nodes over all bands) with the others, which
links nearly all that can be linked at the cost of its size.  What is then still
unlinked in a bucket is searched whole: sizes and shingles that no other such node
has rule out most nodes before any pair is made, and all pairs that they leave are
compared.  Compared pairs are verified on their whole bags: sum of least counts by
sum of largest counts.

At a similarity of 0.8 a pair shares no band with probability 5e-5.  Nodes are
64-bit hashes of the word sequence: among 25 billion texts about 17 would clash.

Defined results: null is empty; texts of one to four words are one shingle; texts
without words are linked to equal texts only; repeated rows are copies; rows of a
null doc_id get the id -1 as class; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, merged
from .tables import stored
from .text import BASE, BYTE_VALUE, MIX, flat, grams, hashes, inverse, mix64, powers, salt, slices, uniform, within, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Standard deviations from the expected number of differing components up to which a pair is compared.
DEVIATIONS = 4.0
SLICE = 1 << 19
KEY = ["k_id", "k_text"]


def bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each row's words, and row, shingle and count of all bags."""
    data, limits = flat(text)
    n = len(limits) - 1
    starts, ends, at = words(data, limits)
    h = hashes(data, starts, ends)
    count = np.diff(at)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(MIX, len(h)), out=sums[1:])
    node = mix64((sums[at[1:]] - sums[at[:-1]]) * powers(inverse(MIX), len(h) + 1)[at[:-1]] + count.astype(np.uint64))
    bare = count == 0
    node[bare] = mix64(~hashes(data, limits[:-1][bare], limits[1:][bare], BYTE_VALUE, BASE))
    row = np.repeat(np.arange(n), count)
    ok = within(at, SHINGLE, len(h))
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    owner = np.concatenate([row[:len(ok)][ok], few])
    shingle = np.concatenate([grams(h, SHINGLE)[ok], mix64(node[few])])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])])[:len(owner)])
    return node, owner[new], shingle[new], np.diff(np.append(new, len(owner)))


def signatures(n: int, owner: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """n x SIZE earliest times."""
    times = np.full((n, SIZE), np.inf)
    flat_times = times.reshape(-1)
    row, seed, rate, low, weight = [], [], [], [], []
    band, floor = 0, 0
    while True:  # the bands (0, 1], (1, 2], (2, 4] ... that the counts reach
        part = np.flatnonzero(count > floor)
        if not len(part):
            break
        row.append(owner[part])
        seed.append(mix64(shingle[part] + salt(band + 1)))
        rate.append(np.full(len(part), max(1, floor), np.float64))
        low.append(np.full(len(part), floor))
        weight.append(count[part])
        band, floor = band + 1, max(1, 2 * floor)
    if not row:
        return times
    row, seed, rate, low, weight = map(np.concatenate, (row, seed, rate, low, weight))
    clock, number = np.zeros(len(row)), 0
    total = np.maximum(1.0, np.bincount(row, rate, n))
    alive = np.arange(len(row))
    while len(alive):
        # Few processes make many points each: draw so many at once as a row still needs in the mean.
        need = float(np.median(SIZE * 6.0 / total[row[alive]]))
        steps = int(min(64, max(1, need if number == 0 else need / 2)))
        steps = min(steps, max(1, (1 << 20) // len(alive)))
        draw = mix64(seed[alive, None] + np.arange(number, number + steps, dtype=np.uint64) * np.uint64(2) * MIX)
        # Summed in order from the clock on: the bits of a time must not depend on how many points are drawn at once.
        gaps = -np.log(uniform(draw)) / rate[alive, None]
        when = np.cumsum(np.column_stack([clock[alive], gaps]), axis=1)[:, 1:]
        mark = mix64(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        component = (mark % np.uint64(SIZE)).astype(np.int64)
        level = low[alive, None] + 1 + np.floor(uniform(mix64(mark)) * rate[alive, None]).astype(np.int64)
        target = row[alive, None] * SIZE + component
        better = (level <= weight[alive, None]) & (when < flat_times[target])
        np.minimum.at(flat_times, target[better], when[better])
        clock[alive] = when[:, -1]
        number += steps
        alive = alive[clock[alive] < times.max(axis=1)[row[alive]]]
    return times


def band_keys(times: np.ndarray) -> np.ndarray:
    bits = times.view(np.uint64).reshape(len(times), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * MIX
    for k in range(ROWS):
        key = mix64(key * MIX + bits[:, :, k])
    return key.view(np.int64)


def sketches(times: np.ndarray) -> np.ndarray:
    """Four bits of each component, sixteen to a 64-bit word."""
    nibble = mix64(times.view(np.uint64)) & np.uint64(15)
    padded = np.zeros((len(times), -(-SIZE // 16) * 16), np.uint64)
    padded[:, :SIZE] = nibble
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (padded.reshape(len(times), -1, 16) << shift).sum(axis=2, dtype=np.uint64).view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """Number of components in which two sketches differ."""
    total = F.lit(0)
    for k in range(-(-SIZE // 16)):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def signed(docs: DataFrame, text: str) -> DataFrame:
    """Row key, node, band keys and sketch of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            node, owner, shingle, count = bags(part.column("k_body"))
            times = signatures(len(node), owner, shingle, count)
            keys, sketch = band_keys(times), sketches(times)
            bare = ~np.isin(np.arange(len(node)), owner)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(bare, 0, BANDS))]).astype(np.int32)),
                pa.array(keys[~bare].ravel()))
            words_of = pa.ListArray.from_arrays(
                pa.array((np.arange(len(node) + 1) * sketch.shape[1]).astype(np.int32)), pa.array(sketch.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in KEY), pa.array(node.view(np.int64)), lists, words_of],
                                             names=[*KEY, "node", "bands", "sketch"])

    return row_keys(docs, text).mapInArrow(run, "k_id long, k_text long, node long, bands array<long>, sketch array<long>")


def row_keys(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k_id"),
                       F.xxhash64(text).alias("k_text"), F.col(text).alias("k_body"))


def whole_bags(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """Bag of each wanted node: its shingles as hashes of shingle and copy number."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            node, owner, shingle, count = bags(part.column("k_body"))
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            every = mix64(np.repeat(shingle, count) + copy.astype(np.uint64) * MIX).view(np.int64)
            sizes = np.bincount(np.repeat(owner, count), minlength=len(node))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                             pa.array(every))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], names=["node", "bag"])

    # The list grows with the data: a shuffle join at every size, never a broadcast of it.
    rows = row_keys(docs, text).join(wanted.hint("merge"), KEY).select("k_body")
    return rows.mapInArrow(run, "node long, bag array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap by ``similarity`` at least."""
    sides = pairs.join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b") \
        .join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return sides.where(shared >= similarity * (F.size("bag_a") + F.size("bag_b") - shared) - 1e-9).select("a", "b")


def open_buckets(at: DataFrame, *more) -> DataFrame:
    """A row for each bucket whose nodes are not all linked, with further aggregates."""
    found = at.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), *more)
    return found.where("l0 <> l1").drop("l0", "l1")


def possible_pairs(at: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of unlinked nodes of a bucket that their sizes and lone shingles let reach ``similarity``.

    A shingle that no other node of an open bucket has can't be shared.  With n
    shingles, u of them lone, two bags overlap by n - u of either at most, and need
    s / (1 + s) of both sizes together.  So a node whose partners would have to be
    smaller than any of its bucket is done, before any pair is made.  Of the pairs,
    those whose sketches differ in more components than a pair at ``similarity`` does
    once in 7,800 times (binomial, 40 of 125 at 0.8) are left out as well.
    """
    agree = similarity + (1 - similarity) / 16
    most = SIZE * (1 - agree) + DEVIATIONS * (SIZE * agree * (1 - agree)) ** 0.5
    need = similarity / (1 + similarity)
    nodes = stored(at.select("node").distinct())
    shingles = nodes.join(bag, "node").select("node", F.explode("bag").alias("shingle"))
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1") \
        .groupBy("node").agg(F.count("*").alias("lone"))
    sizes = nodes.join(bag.select("node", F.size("bag").alias("n"), "sketch", "bands"), "node").join(alone, "node", "left") \
        .select("node", "n", "sketch", "bands", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))
    at = stored(at.select("bucket", "node", "label").join(sizes, "node"))
    largest = at.groupBy("bucket").agg(F.min("n").alias("least_n"))
    able = at.join(largest, "bucket").where(F.col("common") >= need * (F.col("n") + F.col("least_n")) - 1e-9).drop("least_n")
    per_label = able.groupBy("bucket", "label").agg(F.count("*").alias("nodes"))
    main = per_label.groupBy("bucket").agg(F.max(F.struct("nodes", "label")).alias("m"), F.count("*").alias("labels")) \
        .where("labels > 1").select("bucket", F.col("m.label").alias("main"))
    able = stored(able.join(main, "bucket"))
    x, y = able.where("label <> main").alias("x"), able.alias("y")
    on = ((F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label"))
          & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
          & (F.least("x.common", "y.common") >= need * (F.col("x.n") + F.col("y.n")) - 1e-9)
          & (differing(F.col("x.sketch"), F.col("y.sketch")) <= int(most))
          & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")))  # once, not in each common bucket
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def linked(members: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """``node`` and ``label`` of the nodes that have links; ``members`` are bucket, node and the node's popularity."""
    heads = members.groupBy("bucket").agg(F.max(F.struct("popularity", "node")).alias("head")).select("bucket", "head.node")
    rest = stored(members.select("bucket", "node").join(heads.withColumnRenamed("node", "head"), "bucket").where("node <> head"))
    stars = stored(verified(rest.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), bag, similarity))
    labels = components(stars)
    at = stored(rest.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    pairs = possible_pairs(at.join(open_buckets(at), "bucket"), bag, similarity)
    more = stored(verified(pairs, bag, similarity))
    return labels if more.isEmpty() else merged(labels, more)


def classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Row key of every row, the key of its class's least row, and the number of distinct texts in the class."""
    rows = stored(signed(docs, text))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct(*KEY)).alias("least"), F.first("bands").alias("bands"),
                                              F.first("sketch").alias("sketch")))
    meets = nodes.select("node", "least", F.explode("bands").alias("bucket"))
    shared = meets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    meets = stored(meets.join(stored(shared), "bucket"))
    popular = stored(meets.groupBy("node", "least").agg(F.sum("n").alias("popularity")))
    bag = whole_bags(docs, popular.select("least.*"), text)
    bag = stored(bag.join(nodes.select("node", "sketch", "bands"), "node"))
    members = meets.select("bucket", "node").join(popular.select("node", "popularity"), "node")
    labels = linked(members, bag, similarity)
    named = nodes.select("node", "least").join(labels, "node", "left") \
        .select("node", "least", F.coalesce("label", "node").alias("label"))
    named = stored(named)
    heads = named.groupBy("label").agg(F.min("least").alias("head"), F.count("*").alias("n_texts"))
    named = named.join(heads, "label").select("node", "head", "n_texts")
    return rows.select(*KEY, "node").join(named, "node").select(*KEY, "head", "n_texts")


def report(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, its class (the least doc_id in it) and the class's number of distinct texts."""
    found = classes(docs, text, similarity)
    return found.select(F.col("k_id").alias("doc_id"), F.col("head.k_id").alias("class_id"), "n_texts")


def one_of_each(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the least row of each class only; of equal rows, one."""
    heads = classes(docs, text, similarity).select("head.*").distinct()
    names = docs.columns
    flat_docs = docs.toDF(*(f"c_{i}" for i in range(len(names))))
    of = {name: f"c_{i}" for i, name in enumerate(names)}
    keyed = flat_docs.withColumns({"k_id": F.coalesce(F.col(of["doc_id"]).cast("long"), F.lit(-1)),
                                   "k_text": F.xxhash64(of[text])})
    return keyed.join(heads, KEY).dropDuplicates(KEY).drop(*KEY).toDF(*names)
