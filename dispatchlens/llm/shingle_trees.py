"""N-gram Jaccard join: texts linked when their sets of word shingles overlap enough.

Texts of equal sets are one node.  Shingles have one global order, by how often a sketch
of fixed size counted their bucket over all documents and then by hash.  A node's rarest
shingles, its prefix, are posted: two nodes that reach ``PERCENT`` share at least
``shares`` of their posted shingles, so nodes and pairs with fewer are out.

Sets that meet in a bucket (a posted shingle) are joined by a prefix tree: sets in
the global order, frequent shingles first, so that similar ones share long paths.
``Tree`` keeps it level by level, level k holding the places from ``CUTS[k - 1]`` to
``CUTS[k]`` of all paths; a probe goes down with the overlap that it has with a
path, once for all sets below, and leaves a subtree as soon as the shingles missed
on the way are more than its largest set may miss, or all its sets are linked
with the probe already.  Where a subtree is one set, its ``Parities`` and the probe's
tell how many shingles the two differ in at least, before the rest of the path is read.

First every node joins one tree, in its most popular bucket, with the bucket's most
popular node as first probe and then all that it did not link.  Large buckets are cut
into chunks by hash, the popular node goes to each.  That links nearly all that can be
linked.  Of buckets whose nodes are then not all in one component, pairs of different
components and first trees are compared: of small buckets those that may share enough, of
large ones the nodes outside the largest component with chunks of all others.  A pair that
meets in large buckets only shares so many that each node may leave its most popular ones
but the last of that number.  Nothing is capped.

Nodes and shingles are known by 64-bit hashes.

Defined results: A-Z are lower-cased; texts without words, and null, have an empty set,
are linked with nothing and are their own component; texts of one to three words have
one shingle; a component's id is its smallest ``doc_id`` (nulls aside); repeated rows
are linked; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, merged
from .tables import bitmap, has, stored
from .text import MIX, SOLID, flat, grams, hashes, inverse, mix64, powers, salt, slices, within, words

SHINGLE, PERCENT = 4, 85
#: Buckets of the sketch that orders shingles, as a power of two, and how many counts travel together.
SKETCH, PIECE = 21, 4096
#: Up to so many nodes of a bucket are compared as counted pairs.
SMALL = 32
#: Shingles of a chunk of a large bucket.
CHUNK = 1 << 20
#: Shingles that probes compare at once, beyond those of one probe below one node.
STEP = 1 << 21
#: Pairs of a probe and a node that are looked at together.
PAIRS = 1 << 18
#: Bits of a set's parities for each of its shingles, at least.
DENSE = 2
#: Ends of the levels of a tree.
CUTS = [4 << k for k in range(40)]
SLICE = 1 << 20


def sorted_by(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``order`` by ``key``, ties as they stand; 16 bits at a time, which numpy sorts by counting."""
    for shift in range(0, int(key.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of all rows, by row; and the limits of the rows."""
    data, limits = flat(text)
    n = len(limits) - 1
    starts, ends, at = words(data, limits, SOLID)
    h = hashes(data, starts, ends)
    count = np.diff(at)
    owner = np.repeat(np.arange(n), count)
    ok = within(at, SHINGLE, len(h))
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(MIX, len(h)), out=sums[1:])
    whole = (sums[at[few + 1]] - sums[at[few]]) * powers(inverse(MIX), len(h) + 1)[at[few]]
    row = np.concatenate([owner[:len(ok)][ok], few])
    token = np.concatenate([grams(h, SHINGLE)[ok], mix64(whole + salt(7) * count[few].astype(np.uint64))])
    order = sorted_by(np.argsort(token), row)
    row, token = row[order], token[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])])[:len(row)]
    row, token = row[new], token[new]
    return row, token, np.searchsorted(row, np.arange(n + 1))


def nodes_of(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set; 0 for empty sets."""
    sums = np.zeros((2, len(token) + 1), np.uint64)
    np.cumsum(mix64(token), out=sums[0, 1:])
    np.cumsum(mix64(token ^ salt(3)), out=sums[1, 1:])
    one, two = sums[:, at[1:]] - sums[:, at[:-1]]
    size = np.diff(at)
    node = mix64(one * MIX + two + size.astype(np.uint64) * salt(5))
    node[size == 0] = 0
    return node


def needed(n):
    """Of n shingles, how many any partner shares."""
    return (PERCENT * n + 99) // 100


def shares(n: np.ndarray) -> np.ndarray:
    """How many posted shingles two nodes share at least, the smaller having n; that many more are posted."""
    return np.maximum(1, n // 20)


#: Sets that are smaller have no different partner.
FEWEST = next(n for n in range(1, 1000) if 100 * n >= PERCENT * (n + 1))


def sketched(docs: DataFrame) -> np.ndarray:
    """In how many documents the shingles of each bucket stand, over all documents; of fixed size."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, np.int64)
        for part in slices(batches, "k_body", SLICE):
            np.add.at(total, (sets(part.column(0))[1] >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
        for at in range(0, len(total), PIECE):
            if total[at:at + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at:at + PIECE]], pa.list_(pa.int64()))],
                                                 names=["first", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, first in enumerate(batch.column("first").to_pylist()):
                sums[first] = sums.get(first, 0) + batch.column("counts")[k].values.to_numpy()
        for first, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([total], pa.list_(pa.int64()))], names=["first", "counts"])

    schema = "first long, counts array<long>"
    found = docs.mapInArrow(count, schema).repartition("first").mapInArrow(add, schema).toArrow()
    out = np.zeros(1 << SKETCH, np.uint32)
    for first, counts in zip(found["first"].to_pylist(), found["counts"]):
        out[first:first + PIECE] = np.minimum(counts.values.to_numpy(), 0xFFFFFFFF)
    return out


def ordered(row: np.ndarray, token: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """An order by row, then from rare to frequent shingles, of shingles by row and hash."""
    return sorted_by(sorted_by(np.arange(len(token)), sketch[(token >> np.uint64(64 - SKETCH)).astype(np.int64)]), row)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def signed(docs: DataFrame, text: str, sketch) -> DataFrame:
    """doc_id, size and hash of every row's set, and its posted shingles."""
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("node"),
                         F.array(F.lit(0).cast("long")).alias("prefix")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "k_body", SLICE):
            row, token, at = sets(part.column("k_body"))
            node, size = nodes_of(token, at), np.diff(at)
            token = token[ordered(row, token, sketch.value)]
            posted = np.where(size < FEWEST, 0, np.minimum(size, size - needed(size) + shares(size)))
            head = np.arange(len(token)) - np.repeat(at[:-1], size) < np.repeat(posted, size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(node.view(np.int64)),
                                              lists(token[head], posted)], names=["doc_id", "n", "node", "prefix"])

    return docs.select("doc_id", F.col(text).alias("k_body")).mapInArrow(run, schema)


def whole_sets(docs: DataFrame, text: str, wanted: DataFrame, sketch) -> DataFrame:
    """The sets of the ``wanted`` nodes, frequent shingles first."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("node")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "k_body", SLICE):
            row, token, at = sets(part.column("k_body"))
            node, size = nodes_of(token, at), np.diff(at)
            keep = np.zeros(len(node), bool)
            for k in np.flatnonzero(has(bits.value, node) & (size >= FEWEST)).tolist():
                keep[k] = node[k] not in seen
                seen.add(node[k])
            inside = keep[row]
            row, token = row[inside], token[inside]
            token = token[ordered(row, token, sketch.value)[::-1]]  # rows in reverse as well
            yield pa.RecordBatch.from_arrays([pa.array(node[keep][::-1].copy().view(np.int64)), lists(token, size[keep][::-1])],
                                             names=["node", "shingles"])

    found = docs.select(F.col(text).alias("k_body")).mapInArrow(run, "node long, shingles array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def two_powers(least: np.ndarray) -> np.ndarray:
    """The smallest power of two that is not below each of ``least``."""
    return 1 << np.ceil(np.log2(np.maximum(least, 1))).astype(np.int64)


class Parities:
    """Of each set, for each of ``DENSE`` to 2 * ``DENSE`` bits a shingle, whether an odd number of its shingles falls there.

    Two sets differ in at least as many shingles as bits.
    """

    def __init__(self, token: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        self.words = two_powers(-(-DENSE * size // 64))
        self.row = np.zeros((2, len(size)), np.int64)  # in the table of a set's own width, and of half of it
        self.tables = {}
        start = np.cumsum(self.words) - self.words
        flat = np.zeros(int(self.words.sum()), np.uint64)
        for a in range(0, len(token), SLICE):
            some = token[a:a + SLICE]
            owner = np.searchsorted(at, np.arange(a, a + len(some)), "right") - 1
            bit = some & (64 * self.words[owner] - 1).astype(np.uint64)
            # The last bits of a place are those of its word, so a half folds onto the other.
            np.bitwise_xor.at(flat, start[owner] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        for wide in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == wide)
            table = flat[(start[rows][:, None] + np.arange(wide)).ravel()].reshape(len(rows), wide)
            self._add(0, rows, wide, table)
            if wide > 1:
                self._add(1, rows, wide // 2, table[:, :wide // 2] ^ table[:, wide // 2:])

    def _add(self, half: int, rows: np.ndarray, wide: int, table: np.ndarray) -> None:
        before = self.tables.get(wide, np.zeros((0, wide), np.uint64))
        self.row[half, rows] = len(before) + np.arange(len(rows))
        self.tables[wide] = np.concatenate([before, table])

    def apart(self, mine: np.ndarray, other: "Parities", its: np.ndarray) -> np.ndarray:
        """In how many shingles sets ``mine`` of these and ``its`` of the others differ at least."""
        out = np.zeros(len(mine), np.int64)
        wide = np.minimum(self.words[mine], other.words[its])
        fits = np.maximum(self.words[mine], other.words[its]) <= 2 * wide
        for w in np.unique(wide[fits]).tolist():
            pairs = np.flatnonzero(fits & (wide == w))
            for some in np.array_split(pairs, -(-len(pairs) * w // STEP)):
                a = self.tables[w][self.row[(self.words[mine[some]] > w).astype(np.int64), mine[some]]]
                b = other.tables[w][other.row[(other.words[its[some]] > w).astype(np.int64), its[some]]]
                out[some] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out


class Tree:
    """Prefix trees of the sets of several groups, level by level."""

    def __init__(self, group: np.ndarray, label: np.ndarray, token: np.ndarray, at: np.ndarray, home: np.ndarray | None = None):
        size, home = np.diff(at), label if home is None else home
        sums = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(mix64(token) * powers(MIX, len(token)), out=sums[1:])
        back = powers(inverse(MIX), len(token) + 1)
        deep = int(np.searchsorted(CUTS, size.max(initial=1))) + 1
        cuts = []
        for k in range(deep):  # a hash of the path down to each level's end; a set that ends there stands alone
            upto = np.minimum(size, CUTS[k])
            cuts.append(mix64((sums[at[:-1] + upto] - sums[at[:-1]]) * back[at[:-1]] * MIX + (size <= CUTS[k])))
        self.order = np.lexsort((*cuts[::-1], group))
        self.size, self.label, home = size[self.order], label[self.order], home[self.order]
        self.start, self.token = at[:-1][self.order], token
        self.parities = Parities(token, at)
        group = group[self.order]
        new = np.concatenate([[True], group[1:] != group[:-1]])[:len(group)]
        self.groups = group[new]
        self.levels = [np.flatnonzero(new)]  # the first set below each node; level 0 is a group's root
        for k in range(deep):
            h = cuts[k][self.order]
            new = new | np.concatenate([[True], h[1:] != h[:-1]])[:len(new)]
            self.levels.append(np.flatnonzero(new))
        n = len(group)
        self.facts = []  # of what is below a node: largest and smallest set, label and home
        for first in self.levels:
            self.facts.append([f.reduceat(x, first) if n else x for f, x in
                               ((f, x) for x in (self.size, self.label, home) for f in (np.maximum, np.minimum))])
        self.below = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(self.levels, self.levels[1:])]
        self.lone = [np.diff(np.append(first, n)) == 1 for first in self.levels]

    def links(self, group: np.ndarray, label: np.ndarray, token: np.ndarray, at: np.ndarray,
              home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probe and set (as they were given) of all links between different labels and homes of a group."""
        size, home = np.diff(at), label if home is None else home
        own = mix64(token + np.repeat(mix64(np.arange(len(size), dtype=np.uint64) + salt(1)), size))
        own.sort()
        probe = np.flatnonzero(np.isin(group, self.groups))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        parities = Parities(token, at)
        todo = [(0, probe, np.searchsorted(self.groups, group[probe]), np.zeros(len(probe), np.int64))]
        while todo:
            level, above, node, overlap = todo.pop()
            first, wide = self.below[level][node], self.below[level][node + 1] - self.below[level][node]
            if len(above) > 1 and wide.sum() > PAIRS:
                half = len(above) // 2
                todo += [(level, above[:half], node[:half], overlap[:half]), (level, above[half:], node[half:], overlap[half:])]
                continue
            child = np.arange(wide.sum()) + np.repeat(first - (np.cumsum(wide) - wide), wide)
            probe, had, fresh = np.repeat(above, wide), np.repeat(overlap, wide), np.repeat(~self.lone[level][node] | (level == 0), wide)
            start = CUTS[level - 1] if level else 0
            largest, smallest, high, low, last, first = (x[child] for x in self.facts[level + 1])
            n = size[probe]
            on = ((high != label[probe]) | (low != label[probe])) & ((last != home[probe]) | (first != home[probe])) \
                & (100 * largest >= PERCENT * n) & (100 * n >= PERCENT * smallest) & (start - had <= largest - self.least(n, largest))
            alone = np.flatnonzero(on & fresh & self.lone[level + 1][child])
            sample = self.order[self.levels[level + 1][child[alone]]]
            on[alone] = parities.apart(probe[alone], self.parities, sample) <= (n + largest - 2 * self.least(n, largest))[alone]
            probe, child, had, largest, n = probe[on], child[on], had[on], largest[on], n[on]
            sample = self.levels[level + 1][child]
            length = np.minimum(self.size[sample], CUTS[level]) - start
            after = np.cumsum(length)
            cuts = np.unique(np.searchsorted(after, np.arange(0, after[-1] if len(after) else 0, STEP)))
            for a, b in zip(cuts, [*cuts[1:], len(probe)]):
                some = slice(int(a), int(b))
                todo += self._step(level, start, own, probe[some], child[some], had[some], largest[some], n[some], sample[some], length[some],
                                   label, found)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _step(self, level, start, own, probe, child, had, largest, n, sample, length, label, found) -> list:
        """Reads the shingles of a level below ``child``; adds the links that are ``found``, returns what goes on to the next level."""
        end = np.cumsum(length)
        place = np.arange(end[-1]) + np.repeat(self.start[sample] + start - (end - length), length)
        key = mix64(self.token[place] + np.repeat(mix64(probe.astype(np.uint64) + salt(1)), length))
        at_key = np.searchsorted(own, key)
        at_key[at_key == len(own)] = 0
        has_now = had + np.add.reduceat((own[at_key] == key).astype(np.int64), end - length)
        ended = largest <= CUTS[level]
        good = ended & (100 * has_now >= PERCENT * (n + largest - has_now)) & (self.label[sample] != label[probe])
        found.append((probe[good], self.order[sample[good]]))
        on = ~ended & (CUTS[level] - has_now <= largest - self.least(n, largest))
        return [(level + 1, probe[on], child[on], has_now[on])] if on.any() else []

    @staticmethod
    def least(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Overlap that sets of n and m shingles need."""
        return -(-PERCENT * (n + m) // (100 + PERCENT))


def joined(members: DataFrame, sets_of: DataFrame, whole: bool) -> DataFrame:
    """Links (a, b) of groups; ``members`` are g1, g2 (a group), node, label, home and role.

    Role 2 is a first probe and role 1 a probe, both also sets of the tree; role 0 only
    a set of the tree, role 3 only a probe.  With ``whole``, what the first probe has
    not linked is a probe as well.  Nodes of one home are not compared.
    """
    def work(group, role, node, label, home, token, at) -> pa.RecordBatch:
        def some(rows):
            size = np.diff(at)[rows]
            after = np.cumsum(size)
            where = np.arange(after[-1] if len(after) else 0) - np.repeat(after - size - at[:-1][rows], size)
            return token[where], np.concatenate([[0], after])

        inside = np.flatnonzero(role != 3)
        pairs = []
        for turn in range(2 if whole else 1):
            probes = np.flatnonzero(role == 2) if whole and not turn else np.flatnonzero(role > 0)
            if whole and turn:
                first = np.zeros(len(np.unique(group)), np.int64)
                names, number = np.unique(group, return_inverse=True)
                first[number[role == 2]] = label[role == 2]
                probes = np.flatnonzero(label != first[number])
            tree = Tree(group[inside], label[inside], *some(inside), home[inside])
            p, s = tree.links(group[probes], label[probes], *some(probes), home[probes])
            p, s = probes[p], inside[s]
            pairs.append((node[p], node[s]))
            if whole and not turn:
                label = label.copy()
                label[s] = label[p]
        a, b = (np.concatenate(x) for x in zip(*pairs))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            weight += len(batch.column("shingles").flatten())
            if weight > 2 * CHUNK:  # all groups but the last, which may go on in the next batch
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                g1, g2 = (rows.column(c).to_numpy() for c in ("g1", "g2"))
                cut = np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))
                if len(cut):
                    yield taken(rows.slice(0, int(cut[-1]) + 1))
                    held = [rows.slice(int(cut[-1]) + 1)]
                    weight = len(held[0].column("shingles").flatten())
                else:
                    held = [rows]
        if held:
            yield taken(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def taken(rows: pa.RecordBatch) -> pa.RecordBatch:
        g1, g2, role, node, label, home = (rows.column(c).to_numpy() for c in ("g1", "g2", "role", "node", "label", "home"))
        group = np.concatenate([[0], np.cumsum((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))])
        column = rows.column("shingles")
        size = column.value_lengths().to_numpy().astype(np.int64)
        return work(group, role, node, label, home, column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(size)]))

    held = members.join(sets_of, "node").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return held.select("g1", "g2", "role", "node", "label", "home", "shingles").mapInArrow(run, "a long, b long")


def meetings(nodes: DataFrame) -> DataFrame:
    """token, node and size n of the nodes that may have a partner, and how many nodes the token has."""
    posted = nodes.select(F.explode("prefix").alias("token"))
    common = stored(posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    bits = nodes.sparkSession.sparkContext.broadcast(bitmap(common))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            token = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), prefix.value_lengths().to_numpy())
            on = has(bits.value, token.view(np.uint64))
            row = pa.array(row[on])
            yield pa.RecordBatch.from_arrays([pa.array(token[on]), batch.column("node").take(row), batch.column("n").take(row)],
                                             names=["token", "node", "n"])

    at = nodes.select("node", "n", "prefix").mapInArrow(run, "token long, node long, n long")
    for _ in range(2):  # what loses its partners takes others along
        counts = at.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
        at = stored(at.drop("c").join(counts, "token"))
        least = F.expr(f"greatest(1, ({PERCENT} * n + 99) div 100 div 20)")
        able = at.groupBy("node", "n").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("node")
        at = at.join(able, "node", "left_semi")
    counts = at.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    return stored(at.drop("c").join(counts, "token"))


def chunks(weight):
    return F.ceil(weight / F.lit(CHUNK)).cast("int")


def first_links(at: DataFrame, sets_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of each node's most popular bucket; and homes: nodes of one were compared there."""
    home = at.groupBy("node", "n").agg(F.max(F.struct("c", "token")).alias("m"), F.sum("c").alias("popularity"))
    home = stored(home.select("node", "n", F.col("m.token").alias("g1"), "popularity"))
    heads = home.groupBy("g1").agg(F.max(F.struct("popularity", "node")).alias("m"), chunks(F.sum("n")).alias("chunks"), F.count("*").alias("c")) \
        .where("c > 1").select("g1", F.col("m.node").alias("head"), "chunks")
    heads = stored(heads)
    every = home.select("node", "g1").join(heads, "g1").withColumn("g2", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    rest = every.where("node <> head").select("node", "g1", "g2", F.lit(0).alias("role"))
    first = heads.select(F.col("head").alias("node"), "g1", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("g2"), F.lit(2).alias("role"))
    members = rest.unionByName(first).withColumns({"label": F.col("node"), "home": F.col("node")})
    return joined(members, sets_of, whole=True), every.select("node", F.xxhash64("g1", "g2").alias("home"))


def other_links(at: DataFrame, labels: DataFrame, homes: DataFrame, sets_of: DataFrame) -> DataFrame | None:
    """Links between components that meet in a bucket."""
    at = at.select("token", "node", "n", "c").join(labels.join(homes, "node", "full"), "node", "left")
    at = at.withColumns({"label": F.coalesce("label", "node"), "home": F.coalesce("home", "node")})
    open_ones = at.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    at = stored(at.join(open_ones, "token"))
    # Large buckets that a node may share, and those that it has to be met in by partners that share no small one.
    able = F.expr(f"greatest(1, ({PERCENT} * n + 99) div 100 div 20)")
    many = at.where(F.col("c") > SMALL)
    per_node = Window.partitionBy("node").orderBy(F.desc("c"), "token")
    many = stored(many.join(many.groupBy("node").agg(F.count("*").alias("large")), "node").withColumn("place", F.row_number().over(per_node))
                  .where((F.col("large") >= able) & (F.col("place") >= able)))
    large = at.where(F.col("c") > SMALL).groupBy("node").agg(F.count("*").alias("large"))
    few = at.where(F.col("c") <= SMALL).join(large, "node", "left").withColumn("large", F.coalesce("large", F.lit(0)))
    x, y = few.alias("x"), few.alias("y")
    fits = (100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
                   & (F.col("x.home") != F.col("y.home")) & fits)
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")) \
        .agg(F.count("*").alias("k"), F.min(F.least("x.n", "y.n")).alias("n"), F.min(F.least("x.large", "y.large")).alias("large"),
             *(F.min(f"{side}.{c}").alias(c + to) for side, to in (("x", "_a"), ("y", "_b")) for c in ("label", "home")))
    pairs = stored(pairs.where("k >= greatest(1, n div 20 - large)"))
    probe = pairs.groupBy("a").agg(F.min("label_a").alias("label"), F.min("home_a").alias("home")) \
        .select(F.col("a").alias("g1"), F.lit(0).alias("g2"), F.col("a").alias("node"), "label", "home", F.lit(3).alias("role"))
    members = probe.unionByName(pairs.select(F.col("a").alias("g1"), F.lit(0).alias("g2"), F.col("b").alias("node"),
                                             F.col("label_b").alias("label"), F.col("home_b").alias("home"), F.lit(0).alias("role")))
    # Large buckets: chunks of all their nodes, and to each chunk the nodes outside the main component.
    per = many.groupBy("token", "label").agg(F.count("*").alias("k"), F.sum("n").alias("weight"))
    main = per.groupBy("token").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels"), chunks(F.sum("weight")).alias("chunks")) \
        .where("labels > 1").select(F.col("token").alias("g1"), F.col("m.label").alias("main"), "chunks")
    many = many.withColumnRenamed("token", "g1").join(main, "g1")
    trees = many.select("g1", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("g2"), "node", "label", "home", F.lit(0).alias("role"))
    probes = many.where("label <> main").select("g1", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("g2"),
                                                "node", "label", "home", F.lit(3).alias("role"))
    return joined(members.unionByName(trees).unionByName(probes), sets_of, whole=False).distinct()


def linked(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id."""
    send = docs.sparkSession.sparkContext.broadcast
    body = docs.select(F.col(text).alias("k_body"))
    sketch = send(sketched(body))
    rows = stored(signed(docs, text, sketch))
    nodes = rows.where(F.col("n") >= FEWEST).groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    at = meetings(stored(nodes))
    sets_of = stored(whole_sets(docs, text, at.select("node").distinct(), sketch))
    found, homes = first_links(at, sets_of)
    found, homes = stored(found), stored(homes)
    labels = stored(components(found))
    more = stored(other_links(at, labels, homes, sets_of))
    if not more.isEmpty():
        labels = stored(merged(labels, more))
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = stored(least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "label").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                   F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
