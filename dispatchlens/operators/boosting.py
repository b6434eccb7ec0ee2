"""Second-order boosted regression trees on Spark (M6, M7), several models at a time (M8).

Training rows are binned once and kept as one numpy block a partition, with each
model's predictions beside them.  Everything a tree needs is one kind of job: a task
sends its rows through the unfinished trees and sums gradients and counts per (model,
node, feature, bin); the sums of all tasks meet on the driver, whose part grows with
nodes and bins, not with rows.  Of two children only the smaller is scanned, the other
is its parent less it.  The blocks are an RDD because they carry state from round to
round; it is checkpointed to the shared folder as it goes, so a lost executor costs some rounds.

Gradients are whole multiples of ``UNIT`` minutes, so sums are exact and a model depends on
its rows only, not on their order, partitions or cores.

With squared error a row's Hessian is 1.  A split's gain is GL^2/(HL+l2) + GR^2/(HR+l2) -
G^2/(H+l2), a leaf's value -G/(H+l2); ties go to the first feature and bin.  ``leaves = 0``
grows level by level to ``max_depth``; otherwise the leaf of the largest gain is split next
until there are so many.  As a node's split depends on its own rows only, jobs run ahead
of that order: each expands all leaves that the order reaches with what is known.
"""

from __future__ import annotations

import heapq
import json
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.serializers import CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir

UNIT = 2.0 ** -24
#: Rounds between two checkpoints.
KEPT_ROUNDS = 25
#: Codes of columns that are summed as one.
PACKED = 256
#: Bytes of sums that tasks send straight to the driver; more meet on executors first, in so many pieces.
DIRECT = 1 << 20
PIECES = 4
FEATURES = "features"


@dataclass(frozen=True)
class BoostConfig:
    max_iter: int = 300
    max_depth: int = 8
    step_size: float = 0.05
    subsampling_rate: float = 1.0
    column_rate: float = 1.0
    l2: float = 1.0
    leaves: int = 0
    min_rows: int = 1
    max_bins: int = 256


@dataclass
class Tree:
    """Nodes in order of their making; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, gradient: int, rows: int, l2: float) -> int:
        self.feature.append(-1)
        self.bin.append(0)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(-gradient * UNIT / (rows + l2) if rows else 0.0)
        self.rows.append(int(rows))
        self.gain.append(0.0)
        return len(self.feature) - 1

    def compact(self) -> "Tree":
        """What places and values need, as arrays: quick to send."""
        return Tree(*map(np.array, (self.feature, self.bin, self.left, self.right, self.value)))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of binned features ends in."""
        feature, at_bin, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        going = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(going):
            at = node[going]
            down = np.where(bins[going, feature[at]] <= at_bin[at], left[at], right[at])
            node[going] = down
            going = going[feature[down] >= 0]
        return node


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of 64 bits."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn(key: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Which rows or columns a seed draws: each with probability ``rate``, by its key."""
    if rate >= 1:
        return np.ones(len(key), bool)
    return mixed(key ^ mixed(np.array([seed], np.uint64))[0]) < np.uint64(int(rate * 2 ** 64))


class BoostedModel:
    """Fitted trees over the raw features: a row goes left where its value is at most the threshold."""

    def __init__(self, base: float, rate: float, trees: list[Tree], edges: list[list[float]], names: int):
        self.base, self.rate, self.trees, self.edges, self.n_features = base, rate, trees, edges, names

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.scored(vector_to_array(F.col(FEATURES))))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(e), x[:, k]) for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, 1), int)

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * np.array(tree.value)[tree.places(bins)]
        return out

    def scored(self, features: Column) -> Column:
        model = type(self)(self.base, self.rate, [t.compact() for t in self.trees], self.edges, self.n_features)

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack(x.to_numpy()) if len(x) else np.zeros((0, model.n_features))))

        return F.pandas_udf(run, "double")(features)

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the gain of all splits."""
        total = np.zeros(self.n_features)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += g
        return DenseVector(total / total.sum() if total.sum() else total)

    def to_json(self) -> str:
        return json.dumps({"base": self.base, "rate": self.rate, "edges": self.edges, "n_features": self.n_features,
                           "trees": [t.__dict__ for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> "BoostedModel":
        d = json.loads(text)
        return cls(d["base"], d["rate"], [Tree(**t) for t in d["trees"]], d["edges"], d["n_features"])


class Boosted:
    """Estimator of one model; see ``fit_together`` for several."""

    def __init__(self, config: BoostConfig, label: str = C.TARGET, seed: int = C.SEED, key: str = C.KEY):
        self.config, self.label, self.seed, self.key = config, label, seed, key

    def copy(self) -> "Boosted":
        return Boosted(self.config, self.label, self.seed, self.key)

    def fit(self, df: DataFrame) -> BoostedModel:
        return fit_together(df, [(self.config, None)], self.label, self.seed, self.key)[0]


def bin_edges(df: DataFrame, max_bins: int) -> list[list[float]]:
    """Per feature, the values that end a bin: all but the largest, or quantiles of them where there are many."""
    x = vector_to_array(F.col(FEATURES))
    first = df.select(F.size(x)).first()
    if first is None:
        raise ValueError("no rows to train on")
    share = F.array(*(F.lit(k / max_bins) for k in range(max_bins + 1)))
    wide = df.select(x.alias("_x")).select(*(F.col("_x")[k].alias(f"x{k}") for k in range(first[0])))
    found = wide.agg(*(F.percentile_approx(F.nanvl(c, F.lit(None)), share, 10_000).alias(c) for c in wide.columns)).first()
    return [sorted(set(found[c] or []))[:-1] for c in wide.columns]


def _blocks(df: DataFrame, edges: list[list[float]], label: str, key: str, fold: str | None, models: int):
    """One (bins, label in units, key, fold, predictions: models x rows) a partition."""
    have = key in df.columns
    cols = df.select(F.xxhash64(key if have else FEATURES).alias("k"), F.col(label).cast("double").alias("y"),
                     (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), vector_to_array(F.col(FEATURES)).alias("x"))

    def block(batches):
        parts = [(b.column("k").to_numpy(), b.column("y").to_numpy(), b.column("fold").to_numpy(),
                  b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows]
        if parts:
            k, y, part, x = (np.concatenate(p) for p in zip(*parts))
            bins = np.stack([np.searchsorted(np.array(e), x[:, c]) for c, e in enumerate(edges)], axis=1)
            yield bins.astype(np.uint8 if max(map(len, edges)) < 256 else np.uint16), y, k.view(np.uint64), part, np.zeros((models, len(y)))

    import pyarrow as pa

    def packed(batches):
        for made in block(batches):
            yield pa.RecordBatch.from_arrays([pa.array([CPickleSerializer().dumps(made)], pa.binary())], names=["block"])

    return cols.mapInArrow(packed, "block binary").rdd.map(lambda r: CPickleSerializer().loads(bytes(r.block)))


def summed(rdd, work, size: int = 0) -> list[np.ndarray]:
    """Sum over all partitions of the arrays that ``work`` makes of a block, ``size`` bytes or so.

    Where the arrays of all partitions are large they meet on executors, each of which adds up
    some of the rows, so the driver gets every sum once however many partitions there are.
    """
    def added(blocks):
        out = None
        for block in blocks:
            part = work(block)
            out = part if out is None else [x + y for x, y in zip(out, part)]
        return [] if out is None else [out]

    def packed(arrays):
        return [zlib.compress(CPickleSerializer().dumps(arrays), 1)]

    made, parts = rdd.mapPartitions(added), rdd.getNumPartitions()
    if parts * size > DIRECT:
        pieces = min(parts, PIECES)
        cut = made.flatMap(lambda arrays: [(k, p) for k, p in enumerate(zip(*(np.array_split(x, pieces) for x in arrays)))])
        met = dict(cut.reduceByKey(lambda a, b: [x + y for x, y in zip(a, b)], pieces).collect())
        return [np.concatenate(x) for x in zip(*(met[k] for k in range(pieces)))]
    out = None
    for sent in made.flatMap(packed).collect():
        part = CPickleSerializer().loads(zlib.decompress(sent))
        out = part if out is None else [x + y for x, y in zip(out, part)]
    return out


@dataclass
class Bundles:
    """Binned features as fewer columns of codes.

    Features of two bins of which no row has two in the upper one share a column: code 0 is
    none of them, others are one feature's upper bin.  Other features are columns of their own.
    """

    columns: list[list[int]]
    edges: list[list[float]]

    def __post_init__(self):
        self.column, self.upper = np.zeros(len(self.edges), np.intp), np.zeros(len(self.edges), np.int64)
        for c, members in enumerate(self.columns):
            for k, f in enumerate(members):
                self.column[f], self.upper[f] = c, k + 1 if len(members) > 1 else 0
        self.codes = [len(m) + 1 if len(m) > 1 else len(self.edges[m[0]]) + 1 for m in self.columns]
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    @classmethod
    def found(cls, together: np.ndarray, binary: list[int], edges: list[list[float]]) -> "Bundles":
        """``together`` counts the rows that have two of the ``binary`` features in the upper bin."""
        columns, at = [], {f: k for k, f in enumerate(binary)}
        for f in binary:
            for members in columns:
                if len(members) < 254 and not together[at[f], [at[m] for m in members]].any():
                    members.append(f)
                    break
            else:
                columns.append([f])
        return cls(columns + [[f] for f, e in enumerate(edges) if f not in at and e], edges)

    def coded(self, bins: np.ndarray) -> np.ndarray:
        """Columns x rows."""
        out = np.zeros((len(self.columns), len(bins)), np.uint8 if max(self.codes, default=1) <= 256 else np.uint16)
        for c, members in enumerate(self.columns):
            for k, f in enumerate(members):
                out[c] += bins[:, f] * (k + 1 if len(members) > 1 else 1)
        return out

    def spread(self, sums: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Sums per code of all columns, and per node, as sums per bin of all features."""
        out = np.zeros((len(sums), int(self.start[-1])), np.int64)
        for f, a in enumerate(self.start[:-1]):  # features of one bin
            out[:, a] = total
        first = 0
        for members, n in zip(self.columns, self.codes):
            for k, f in enumerate(members):
                if len(members) == 1:
                    out[:, self.start[f]:self.start[f + 1]] = sums[:, first:first + n]
                else:
                    out[:, self.start[f] + 1] = sums[:, first + k + 1]
                    out[:, self.start[f]] = total - sums[:, first + k + 1]
            first += n
        return out

    def steps(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Each node's column, and the node that follows it by code (leaves follow themselves)."""
        feature, at_bin, left, right = (np.array(x) for x in (tree.feature, tree.bin, tree.left, tree.right))
        code, nodes = np.arange(max(self.codes, default=1)), np.arange(len(feature), dtype=np.int32)
        column = np.where(feature >= 0, self.column[feature], 0)
        upper = self.upper[feature][:, None]  # the code of a bundled feature's upper bin
        down = np.where(upper > 0, (code == upper) & (at_bin < 1)[:, None], code > at_bin[:, None])
        follows = np.where(down, right[:, None], left[:, None]).astype(np.int32)
        return column, np.where((feature >= 0)[:, None], follows, nodes[:, None])


class Packs:
    """Columns of codes of which as many as make ``PACKED`` codes together are one column, for fewer passes over the rows."""

    def __init__(self, bundles: Bundles):
        self.bundles, self.members, self.sizes = bundles, [], []
        for c in sorted(range(len(bundles.codes)), key=lambda c: (-bundles.codes[c], c)):
            for p, size in enumerate(self.sizes):
                if size * bundles.codes[c] <= PACKED:
                    self.members[p].append(c)
                    self.sizes[p] *= bundles.codes[c]
                    break
            else:
                self.members.append([c])
                self.sizes.append(bundles.codes[c])
        self.pack, self.stride = (np.zeros(len(bundles.codes), np.intp) for _ in range(2))
        self.code = np.zeros((max(len(bundles.codes), 1), max(self.sizes, default=1)), np.int64)  # by column and code of its pack
        for p, members in enumerate(self.members):
            stride = 1
            for c in members:
                self.pack[c], self.stride[c] = p, stride
                self.code[c] = np.arange(self.code.shape[1]) // stride % bundles.codes[c]
                stride *= bundles.codes[c]

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Packs x rows, of columns x rows."""
        out = np.zeros((len(self.members), codes.shape[1]), np.uint8 if max(self.sizes, default=1) <= 256 else np.uint16)
        for c, code in enumerate(codes):
            out[self.pack[c]] += code * int(self.stride[c])
        return out

    def apart(self, sums: np.ndarray) -> np.ndarray:
        """Sums per code of all packs as sums per code of all columns."""
        first = np.concatenate([[0], np.cumsum(self.bundles.codes)]).astype(int)
        out, at = np.zeros((len(sums), int(first[-1])), np.int64), 0
        for members, size in zip(self.members, self.sizes):
            shaped = sums[:, at:at + size].reshape(len(sums), *(self.bundles.codes[c] for c in reversed(members)))
            for k, c in enumerate(members):
                out[:, first[c]:first[c + 1]] = shaped.sum(axis=tuple(a for a in range(1, shaped.ndim) if a != len(members) - k))
            at += size
        return out

    def masks(self, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        """Of 64 nodes at a time (words x packs x codes): bit k says that a code lies on the way to the k-th node."""
        feature, at_bin, left, right = (np.array(x) for x in (tree.feature, tree.bin, tree.left, tree.right))
        fits = np.zeros((len(feature), len(self.sizes), self.code.shape[1]), bool)
        fits[0], level = True, np.zeros(1, np.intp)
        while len(level := level[feature[level] >= 0]):
            column, upper = self.bundles.column[feature[level]], self.bundles.upper[feature[level]][:, None]
            code, last = self.code[column], at_bin[level, None]
            down = np.where(upper > 0, (code == upper) & (last < 1), code > last)
            for child, way in ((left[level], ~down), (right[level], down)):
                fits[child] = fits[level]
                fits[child, self.pack[column]] &= way
            level = np.concatenate([left[level], right[level]])
        bits = np.zeros((-(-len(nodes) // 64) * 64, *fits.shape[1:]), bool)
        bits[:len(nodes)] = fits[nodes]
        words = np.packbits(bits.reshape(-1, 64, *fits.shape[1:]), axis=1, bitorder="little")
        return np.ascontiguousarray(np.moveaxis(words, 1, -1)).view("<u8")[..., 0]

    def passing(self, codes: np.ndarray, tree: Tree, nodes: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows that ``some`` is true for, those that pass one of ``nodes`` (none below another), and which of these."""
        rows, which = [np.zeros(0, np.intp)], [np.zeros(0, np.intp)]
        for w, word in enumerate(self.masks(tree, nodes)):
            bits = word[0].take(codes[0])
            for mask, code in zip(word[1:], codes[1:]):
                bits &= mask.take(code)
            rows.append(np.flatnonzero((bits != 0) & some))
            # One bit is set; as a double its exponent is its place.
            which.append(64 * w + (bits[rows[-1]].astype(np.float64).view(np.int64) >> 52) - 1023)
        return np.concatenate(rows), np.concatenate(which)


def code_places(codes: np.ndarray, tree: Tree, steps: tuple[np.ndarray, np.ndarray], rows: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The node that each of ``rows`` ends in; with ``wanted`` (true for nodes to find) -1 where it is no such one."""
    column, follows = steps
    flat, n, wide = codes.ravel(), codes.shape[1], follows.shape[1]
    inner = np.array(tree.feature) >= 0
    if wanted is not None:  # go on only where a wanted node lies below
        useful = wanted.copy()
        for node in range(len(inner) - 1, -1, -1):
            if inner[node]:
                useful[node] |= useful[tree.left[node]] or useful[tree.right[node]]
        inner = inner & useful & ~wanted
    follows = follows.ravel()
    out = np.zeros(len(rows), np.int32)
    if inner[0]:
        going, at, own = np.arange(len(rows)), out, rows
        while len(going):
            at = follows[at * wide + flat[column[at] * n + own]]
            out[going] = at
            on = inner[at]
            going, at, own = going[on], at[on], own[on]
    return out if wanted is None else np.where(wanted[out], out, -1)


def code_sums(codes: np.ndarray, sizes: list[int], rows: np.ndarray, slot: np.ndarray | None, slots: int, gradient: np.ndarray,
              weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Per slot: sums of ``gradient`` and counts by code of all columns, and over all rows (slots x codes, then slots)."""
    g, h = (np.zeros((slots, sum(sizes)), np.int64) for _ in range(2))
    tg, th = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for a in range(0, len(rows), 1 << 16):  # sums below 2**53 are exact as doubles
        some = slice(a, a + (1 << 16))
        here, value, by = rows[some], gradient[some], None if slot is None else slot[some].astype(np.int64)
        count = None if weight is None else weight[some]
        base = np.zeros(len(here), np.int64) if by is None else by
        tg += np.bincount(base, value, slots).astype(np.int64)
        th += np.bincount(base, count, slots).astype(np.int64)
        first = 0
        for c, size in enumerate(sizes):
            code = codes[c][here]
            place = code if by is None else by * size + code
            g[:, first:first + size] += np.bincount(place, value, slots * size).astype(np.int64).reshape(slots, size)
            h[:, first:first + size] += np.bincount(place, count, slots * size).astype(np.int64).reshape(slots, size)
            first += size
    return g, h, tg, th


def bundled_blocks(df: DataFrame, edges: list[list[float]], label: str, key: str, fold: str | None, models: int):
    """``_blocks`` with bundled codes (columns x rows) for bins, on as many tasks as there are cores or more; and the bundles."""
    sc = df.sparkSession.sparkContext
    raw = _blocks(df, edges, label, key, fold, models)
    parts = raw.getNumPartitions()
    if parts < sc.defaultParallelism:
        raw = _blocks(df.repartition(sc.defaultParallelism, *[key][:key in df.columns]), edges, label, key, fold, models)
    elif parts > sc.defaultParallelism:
        raw = raw.coalesce(max(sc.defaultParallelism, parts // 8))
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    binary = [f for f, e in enumerate(edges) if len(e) == 1]
    compared = [binary[k:k + 512] for k in range(0, len(binary), 512)]

    def pairs(block):
        out = []
        for group in compared:
            made = np.zeros((len(group), len(group)), np.int64)
            for a in range(0, len(block[0]), 1 << 16):
                on = (block[0][a:a + (1 << 16), group] > 0).astype(np.float32)
                made += (on.T @ on).astype(np.int64)
            out.append(made)
        return out

    together = np.ones((len(binary), len(binary)), np.int64)  # features that were not compared stay apart
    if compared:
        for k, part in enumerate(summed(raw, pairs, 8 * max(map(len, compared)) ** 2) or []):
            together[512 * k:512 * k + len(part), 512 * k:512 * k + len(part)] = part
    bundles = Bundles.found(together, binary, edges)
    state = raw.map(lambda b: (bundles.coded(b[0]), *b[1:])).persist(StorageLevel.MEMORY_AND_DISK)
    return state, raw, bundles


def best_splits(gradient: np.ndarray, rows: np.ndarray, start: np.ndarray, columns: np.ndarray, cfg: BoostConfig):
    """Of each node (a row of sums per bin): gain, feature and last bin on the left of its best split, and the left's sums.

    ``start`` are the features' first bins and the end of the last; ``columns`` which features may be used.
    """
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    g, h = np.cumsum(gradient, axis=1), np.cumsum(rows, axis=1)
    before = start[owner] - 1
    left_g, left_h = g - np.where(before >= 0, g[:, before], 0), h - np.where(before >= 0, h[:, before], 0)
    total_g, total_h = left_g[:, start[1] - 1:start[1]], left_h[:, start[1] - 1:start[1]]
    right_g, right_h = total_g - left_g, total_h - left_h
    part = lambda a, b: (a * UNIT) ** 2 / np.maximum(b + cfg.l2, 1e-12)
    gain = part(left_g, left_h) + part(right_g, right_h) - part(total_g, total_h)
    last = np.arange(len(owner)) == start[owner + 1] - 1
    fine = ~last & columns[owner] & (left_h >= cfg.min_rows) & (right_h >= cfg.min_rows)
    gain = np.where(fine, gain, -np.inf)
    at = gain.argmax(axis=1)
    row = np.arange(len(at))
    return gain[row, at], owner[at], at - start[owner[at]], left_g[row, at], left_h[row, at]


class Growing:
    """A tree of one round of one model, on the driver."""

    def __init__(self, cfg: BoostConfig, start: np.ndarray, columns: np.ndarray):
        self.cfg, self.start, self.columns = cfg, start, columns
        self.tree, self.sums, self.split, self.depth, self.scan = Tree(), {}, {}, {}, []

    def root(self, gradient: np.ndarray, rows: np.ndarray) -> None:
        end = self.start[1]
        node = self.tree.add(int(gradient[:end].sum()), int(rows[:end].sum()), self.cfg.l2)
        self.depth[node] = 0
        self.known({node: (gradient, rows)})

    def known(self, sums: dict) -> None:
        """Find the splits of nodes whose sums have come."""
        if sums:
            g, h = (np.stack(x) for x in zip(*sums.values()))
            for node, gain, f, b, lg, lh in zip(sums, *best_splits(g, h, self.start, self.columns, self.cfg)):
                self.sums[node] = sums[node]
                if gain > 1e-9:
                    self.split[node] = (float(gain), int(f), int(b), int(lg), int(lh))

    def reached(self) -> list[int]:
        """The nodes that the order of growth splits, as far as it is known."""
        if not self.cfg.leaves:
            return [n for n in range(len(self.tree.rows)) if n in self.split]
        out, queue = [], [(-self.split[0][0], 0)] if 0 in self.split else []
        while queue and len(out) < self.cfg.leaves - 1:
            _, node = heapq.heappop(queue)
            out.append(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                if child in self.split:
                    heapq.heappush(queue, (-self.split[child][0], child))
        return out

    def expand(self) -> list[int]:
        """Split all leaves that are reached; returns the smaller children, whose sums are wanted."""
        self.scan = []
        for node in self.reached():
            if self.tree.left[node] >= 0:
                continue
            gain, f, b, lg, lh = self.split[node]
            g, h = (int(x[:self.start[1]].sum()) for x in self.sums[node])
            tree = self.tree
            tree.feature[node], tree.bin[node], tree.gain[node] = f, b, gain
            tree.left[node] = tree.add(lg, lh, self.cfg.l2)
            tree.right[node] = tree.add(g - lg, h - lh, self.cfg.l2)
            self.depth[tree.left[node]] = self.depth[tree.right[node]] = self.depth[node] + 1
            if self.depth[node] + 1 < self.cfg.max_depth:
                small = tree.left[node] if lh <= h - lh else tree.right[node]
                self.scan.append((node, small, tree.left[node] + tree.right[node] - small))
            else:
                del self.sums[node]
        return [small for _, small, _ in self.scan]

    def scanned(self, gradient: np.ndarray, rows: np.ndarray) -> None:
        sums = {}
        for k, (node, small, large) in enumerate(self.scan):
            g, h = self.sums.pop(node)
            sums[small], sums[large] = (gradient[k], rows[k]), (g - gradient[k], h - rows[k])
        self.known(sums)

    def finished(self) -> Tree:
        """The tree; what was expanded ahead of the order of growth is taken back."""
        if self.cfg.leaves:
            keep, tree = set(self.reached()), self.tree
            for node in range(len(tree.rows)):
                if node not in keep:
                    tree.feature[node], tree.left[node], tree.right[node], tree.gain[node] = -1, -1, -1, 0.0
        return self.tree


def fit_together(df: DataFrame, models: list[tuple[BoostConfig, int | None]], label: str = C.TARGET, seed: int = C.SEED,
                 key: str = C.KEY, fold: str | None = None, edges: list[list[float]] | None = None) -> list[BoostedModel]:
    """Fit several boosted models in the same jobs; a model with a fold number leaves the rows of that ``fold`` out."""
    sc = df.sparkSession.sparkContext
    ensure_checkpoint_dir(df.sparkSession)
    edges = edges if edges is not None else bin_edges(df, max(cfg.max_bins for cfg, _ in models))
    n_models = len(models)
    coded, raw, bundles = bundled_blocks(df, edges, label, key, fold, n_models)
    start, size, packs = bundles.start, sum(bundles.codes), Packs(bundles)
    coded.unpersist()
    state = coded.map(lambda b: (packs.packed(b[0]), *b[1:])).persist(StorageLevel.MEMORY_AND_DISK)

    def trains(part: np.ndarray, m: int) -> np.ndarray:
        return part != models[m][1] if models[m][1] is not None else np.ones(len(part), bool)

    def totals(block):
        _, y, _, part, _ = block
        units = np.rint(y / UNIT)
        return [np.array([[units[trains(part, m)].sum(), trains(part, m).sum()] for m in range(n_models)])]

    found = summed(state, totals)[0]
    base = [float(s * UNIT / n) if n else 0.0 for s, n in found]
    done: list[list[Tree]] = [[] for _ in models]
    trees: list[Tree] = []
    old, sent = [raw], []

    def updated(block, trees):
        codes, y, k, part, scores = block
        scores, every = scores.copy(), np.ones(len(y), bool)
        for m, tree in enumerate(trees or [None] * n_models):
            if tree is None:
                scores[m] = base[m]
            elif tree.feature[0] < 0:
                scores[m] += models[m][0].step_size * tree.value[0]
            else:
                ends = np.flatnonzero(tree.feature < 0)
                rows, end = packs.passing(codes, tree, ends, every)
                scores[m, rows] += models[m][0].step_size * tree.value[ends[end]]
        return codes, y, k, part, scores

    def sums_of(block, turn, growing, wanted):
        """Gradients and counts of the wanted nodes of each model, per code and in all."""
        codes, y, k, part, scores = block
        out = []
        for m, (cfg, _) in enumerate(models):
            if wanted[m] is None:
                continue
            some = trains(part, m)
            if cfg.subsampling_rate < 1:
                some &= drawn(k, cfg.subsampling_rate, seed + 7919 * turn)
            if growing[m] is None:
                rows, slot, slots = np.flatnonzero(some), None, 1
            else:
                rows, slot = packs.passing(codes, growing[m], wanted[m], some)
                slots = len(wanted[m])
            g, h, tg, th = code_sums(codes, packs.sizes, rows, slot, slots, np.rint((scores[m][rows] - y[rows]) / UNIT))
            out.append((packs.apart(g), packs.apart(h), tg, th))
        return [np.concatenate(x) for x in zip(*out)]

    def wanted_sums(state, turn, growing, wanted):
        """Per model the wanted nodes' gradients and counts per bin."""
        slots = [len(w) if w else 0 for w in wanted]
        g, h, tg, th = summed(state, lambda b: sums_of(b, turn, growing, wanted), sum(slots) * (size + 1) * 16)
        g, h, end = bundles.spread(g, tg), bundles.spread(h, th), np.cumsum(slots)
        return [(g[e - n:e], h[e - n:e]) for e, n in zip(end, slots)]

    for turn in range(max(cfg.max_iter for cfg, _ in models)):
        active = [turn < cfg.max_iter for cfg, _ in models]
        # Trees are sent beside the jobs: what tasks get would grow with the rounds since a checkpoint.
        before, step = state, sc.broadcast([t.compact() for t in trees])
        state = before.map(lambda b, step=step: updated(b, step.value)).persist(StorageLevel.MEMORY_AND_DISK)
        kept = turn % KEPT_ROUNDS == KEPT_ROUNDS - 1
        if kept:
            state.checkpoint()
        old.append(before)
        sent.append(step)
        columns = [drawn(np.arange(len(edges), dtype=np.uint64), cfg.column_rate, seed + 104729 * turn + 1) for cfg, _ in models]
        growing = [Growing(cfg, start, c if c.any() else np.ones(len(edges), bool)) for (cfg, _), c in zip(models, columns)]
        found = wanted_sums(state, turn, [None] * n_models, [[0] if a else None for a in active])
        for rdd in old:
            rdd.unpersist()
        for past in sent if kept else ():
            past.unpersist()
        old = []
        for m in np.flatnonzero(active):
            growing[m].root(found[m][0][0], found[m][1][0])
        while True:
            wanted = [(grow.expand() or None) if a else None for grow, a in zip(growing, active)]
            if not any(wanted):
                break
            partial = [g.tree.compact() if w else None for g, w in zip(growing, wanted)]
            found = wanted_sums(state, turn, partial, wanted)
            for m, w in enumerate(wanted):
                if w:
                    growing[m].scanned(*found[m])
                else:
                    growing[m].scan = []
        trees = []
        for m, grow in enumerate(growing):
            tree = grow.finished() if active[m] else Tree([-1], [0], [-1], [-1], [0.0], [0], [0.0])
            trees.append(tree)
            if active[m]:
                done[m].append(tree)
    state.unpersist()
    for past in sent:
        past.destroy()
    return [BoostedModel(base[m], models[m][0].step_size, done[m], edges, len(edges)) for m in range(n_models)]
